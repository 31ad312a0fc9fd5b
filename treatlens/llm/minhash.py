"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sets are sketched (``sketches``) and filed under each band of their sketch, and links are always confirmed on
the full sets of shingle hashes:

1. Documents of equal sets are one class.
2. Within a band's bucket every class is compared with the bucket's centre only.
   Confirmed links give labels; buckets of two classes or one label are settled.
3. In the other buckets the classes outside the most frequent label are compared
   with each other and with those inside it, in blocks of bounded size; a pair is
   compared only in the first bucket it shares and only while its labels differ.
   Tasks emit spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.llm.components import components
from treatlens.llm.simhash import shingles, words_of
from treatlens.llm.sketches import band_keys
from treatlens.llm.tables import chunks, tidy
from treatlens.session import cut_lineage

#: At similarity 0.85 a pair misses all bands with probability 7e-9, at 0.6 it meets in one with 0.93.
BANDS, ROWS = 32, 5
#: Classes of a bucket that one task compares with as many others, and text hashed at once.
BLOCK, PART_BYTES = 256, 1 << 20
def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for run in chunks([t or "" for t in texts], PART_BYTES):
            yield batch.column(0).slice(run[0], len(run)), [np.unique(shingles(words_of(texts[i]), width)) for i in run]


def _key(held: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(held.tobytes())


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``size`` and, of sets that are not empty, ``key`` (128 bits of the set) and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets_of(batches, width):
            bands = iter(band_keys([s for s in sets if len(s)], BANDS, ROWS))
            keys, filed = zip(*[(_key(s), next(bands).tobytes()) if len(s) else (None, None) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(filed, pa.binary())],
                names=["doc_id", "size", "key", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, size long, key binary, bands binary")


def _filed(classes: DataFrame) -> DataFrame:
    """``bucket``, ``key``, ``size``: every class under each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(bands), batch.column(0).take(at), batch.column(1).take(at)], names=["bucket", "key", "size"])

    return classes.select("key", "size", "bands").mapInArrow(tidy(run), "bucket long, key binary, size long")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``key``, ``bands`` and ``held``, the shingle hashes, of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches, width):
            own = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_key(s) for s in own], pa.binary()),
                    pa.array([b.tobytes() for b in band_keys(own, BANDS, ROWS)], pa.binary()),
                    pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                ],
                names=["key", "bands", "held"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "key binary, bands binary, held array<long>")


def _alike(a: str, b: str, percent: int) -> str:
    """Whether set sizes allow the similarity."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _centre_links(filed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` of classes with the centre of a bucket."""
    pairs = filed.filter("key <> centre").filter(_alike("size", "centre_size", percent)).select("key", "centre").distinct()
    held = sets.select("key", "held")
    centres = held.select(F.col("key").alias("centre"), F.col("held").alias("held_too"))
    both = pairs.join(held, "key").join(centres, "centre")
    met = both.select("key", "centre", F.size(F.array_intersect("held", "held_too")).cast("long").alias("n"), (F.size("held") + F.size("held_too")).cast("long").alias("total"))
    return met.filter(f"100 * n >= {percent} * (total - n)").select(F.col("key").alias("a"), F.col("centre").alias("b"))


def _units(filed: DataFrame) -> DataFrame:
    """Rows (bucket, key, label, f, h): entries of the blocks ``f`` and ``h`` that one task compares.

    ``f`` numbers blocks outside the bucket's most frequent label, ``h`` blocks
    inside it (0 and up) or further ones outside it (-1 and down). Block numbers
    come from hashes, so no bucket is sorted or gathered.
    """
    by_label = filed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"))
    open_ = most.filter("total > m.n").select(
        "bucket", F.col("m.label").alias("main"),
        F.ceil(F.col("m.n") / BLOCK).cast("int").alias("n_in"), F.ceil((F.col("total") - F.col("m.n")) / BLOCK).cast("int").alias("n_out"),
    )
    rows = filed.join(open_, "bucket").select("*", F.xxhash64("key").alias("_x"))
    inside = rows.filter("label = main").select("bucket", "key", "label", "n_out", F.expr("pmod(_x, n_in)").alias("h"))
    inside = inside.select("bucket", "key", "label", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("f"), F.col("h").cast("int"))
    outside = rows.filter("label <> main").select("bucket", "key", "label", "n_in", "n_out", F.expr("cast(pmod(_x, n_out) as int)").alias("o"))
    with_main = outside.select("bucket", "key", "label", F.col("o").alias("f"), F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("h"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("p")
    among = outside.select("bucket", "key", "label", "o", other).select(
        "bucket", "key", "label", F.least("o", "p").alias("f"), (-1 - F.greatest("o", "p")).alias("h")
    )
    return inside.unionByName(with_main).unionByName(among)


def confirmed(label: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, bucket: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between entries of different labels; each found link makes its labels one.

    Pairs that share a band before ``bucket`` are left to that bucket.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(int(codes.max()) + 1, bool)
    place = (bands == bucket).argmax(axis=1)
    before = np.arange(bands.shape[1]) < place[:, None]
    label = label.copy()
    for x in range(len(sets) - 1):
        y = np.arange(x + 1, len(sets))
        y = y[(label[y] != label[x]) & (100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x]))]
        y = y[~((bands[y] == bands[x]) & before[x]).any(axis=1)]
        if not len(y):
            continue
        mark[codes[starts[x] : ends[x]]] = True
        for part in y:
            if label[part] == label[x]:
                continue
            common = int(np.count_nonzero(mark[codes[starts[part] : ends[part]]]))
            if 100 * common >= percent * (sizes[x] + sizes[part] - common):
                label[label == label[part]] = label[x]
                yield x, int(part)
        mark[codes[starts[x] : ends[x]]] = False


def _block_links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` between labels."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        labels = rows["label"].to_pylist()
        number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        bands = np.frombuffer(b"".join(rows["bands"].to_pylist()), np.int64).reshape(-1, BANDS)
        held = [np.asarray(h.values, np.int64) for h in rows["held"]]
        own = np.array([number[x] for x in labels], np.int64)
        links = list(confirmed(own, held, bands, key[0].as_py(), percent))
        return pa.table({c: pa.array([labels[link[i]] for link in links], pa.binary()) for i, c in enumerate("ab")})

    return units.join(sets, "key").groupBy("bucket", "f", "h").applyInArrow(run, "a binary, b binary")


def similar_sets(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept``, one row per row of ``docs``.

    Texts (lower-cased A-Z) are sets of distinct runs of ``width`` words, or of
    their whole sequence if shorter. Documents are linked if 100 * intersection
    >= ``percent`` * union; ``component_id`` is the smallest ``doc_id`` that links
    reach, ``kept`` whether it is the document's own. Null texts and texts without
    words have empty sets, linked with nothing. Rows with one ``doc_id`` are linked each by its own text. Rows with a null
    ``doc_id`` take no part: their component is null and they are kept. Other
    columns are not read.
    """
    marked = cut_lineage(_marked(docs, width), "marked")
    classes = cut_lineage(
        marked.filter("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("node"), F.first("size").alias("size"), F.min("bands").alias("bands")
        ),
        "classes",
    )
    rows = _filed(classes)
    centre = rows.groupBy("bucket").agg(F.min(F.struct("key", "size")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    centre = centre.select("bucket", F.col("c.key").alias("centre"), F.col("c.size").alias("centre_size"), "n")
    filed = cut_lineage(rows.join(centre, "bucket"), "filed")
    asked = filed.select("key").distinct().join(classes.select("key", F.col("node").alias("doc_id")), "key").select("doc_id").distinct()
    full = _full_sets(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), width)
    sets = cut_lineage(full.join(filed.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "sets")
    first = cut_lineage(components(_centre_links(filed, sets, percent)), "labels")
    label = F.coalesce("component", "key").alias("label")
    labelled = filed.filter("n > 2").join(first.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", label)
    second = components(_block_links(_units(cut_lineage(labelled, "labelled")), sets, percent))
    labels = classes.join(first.withColumnRenamed("node", "key"), "key", "left").select("key", "node", label)
    joined = labels.join(second.select(F.col("node").alias("label"), F.col("component").alias("_c")), "label", "left").select(
        "key", "node", F.coalesce("_c", "label").alias("label")
    )
    joined = cut_lineage(joined, "joined")
    smallest = joined.groupBy("label").agg(F.min("node").alias("component_id"))
    found = joined.join(smallest, "label").select("key", "component_id")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return marked.join(found, "key", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), named.alias("component_id"),
        F.coalesce(F.col("doc_id") == named, F.lit(True)).alias("kept"),
    )
