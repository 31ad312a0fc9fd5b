"""SimHash near-duplicates: 64-bit fingerprints, compared by bit planes.

Fingerprints within ``radius`` bits share whole bit blocks: of ``radius + 2``
blocks at least two are equal. Every distinct fingerprint is filed under each
pair of its blocks, and only entries of one file are compared. A task stores its
fingerprints vertically (one array per bit), compares all entries with the ones
a step further at once, adds up differing bits in carry-save counters, and drops
the 64-entry words in which every counter has passed the radius.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.llm.components import components
from treatlens.llm.sketches import band_keys
from treatlens.llm.tables import WORD, chunks, rows_of, tidy
from treatlens.session import cut_lineage

BITS = 64
#: A file above this many entries is split by a further pair of blocks of its other bits.
FILE_ROWS = 2048
_WORD = re.compile(WORD.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8").translate(_LOWER))


def shingles(words: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of ``width`` words joined by spaces, or of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    stops = ends[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the shingle hashes, repeats included; 0 without words.

    A null text counts as empty.
    """
    return _majority(shingles(words_of(text), width, seed))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        part = np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += part.sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, seed) for t in rows_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def blocks_of(n: int, low: int = 0, high: int = BITS) -> list[int]:
    """Bit masks of ``n`` nearly equal runs of the bits from ``low`` to ``high``."""
    edges = [low + (high - low) * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def pair_masks(radius: int) -> list[int]:
    """Masks of every pair of ``radius + 2`` blocks; close fingerprints agree on one of them."""
    return [a | b for a, b in combinations(blocks_of(radius + 2), 2)]


def _masked(fp: Column, masks: list[int]) -> Column:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("m"), fp.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])


class Planes:
    """Bit planes of a run of fingerprints: plane ``b`` holds bit ``b`` of 64 entries per word."""

    def __init__(self, fps: np.ndarray) -> None:
        self.n = len(fps)
        padded = np.zeros(-(-self.n // 64) * 64 + 64, np.uint64)
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.words = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")

    def ahead(self, bit: int, step: int, at: np.ndarray) -> np.ndarray:
        """Words ``at`` of plane ``bit`` as seen ``step`` entries further on."""
        whole, part = divmod(step, 64)
        plane, last = self.words[bit], self.words.shape[1] - 1
        out = plane[np.minimum(at + whole, last)] >> np.uint64(part)
        if part:
            out |= plane[np.minimum(at + whole + 1, last)] << np.uint64(64 - part)
        return out

    def close(self, step: int, radius: int, asked: np.ndarray) -> np.ndarray:
        """First entries ``i`` with ``asked[i]`` that differ from entry ``i + step`` in at most ``radius`` bits."""
        padded = np.zeros(self.words.shape[1] * 64, bool)
        padded[: len(asked)] = asked
        wanted = np.packbits(padded, bitorder="little").view("<u8")
        at = np.flatnonzero(wanted)
        alive = wanted[at]
        levels = radius.bit_length()
        counter = np.zeros((levels, len(at)), np.uint64)
        passed = np.zeros(len(at), np.uint64)
        for bit in range(BITS):
            carry = self.words[bit][at] ^ self.ahead(bit, step, at)
            for level in range(levels):  # carry-save: add one bit to every counter
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            passed |= carry
            if bit % 8 == 7:
                over = passed | _above(counter, radius)
                keep = (alive & ~over) != 0
                if not keep.any():
                    return np.empty(0, np.int64)
                if keep.mean() < 0.7:
                    at, alive, passed, counter = at[keep], alive[keep], passed[keep], counter[:, keep]
        hits = alive & ~(passed | _above(counter, radius))
        bits = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        return at[row] * 64 + col


    def within(self, fps: np.ndarray, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``i < j`` within ``radius`` bits, ``i`` from ``first`` to ``last``: these entries against all at once.

        Counters of the whole block are carried on together; it is abandoned once all exceed the radius.
        """
        own = fps[first:last, None]
        levels, shape = radius.bit_length(), (last - first, self.words.shape[1])
        counter, passed = np.zeros((levels, *shape), np.uint64), np.zeros(shape, np.uint64)
        for bit in range(BITS):
            carry = self.words[bit] ^ (np.uint64(0) - (own >> np.uint64(bit) & np.uint64(1)))
            for level in range(levels):
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            passed |= carry
            if bit % 16 == 15 and not (~(passed | _above(counter.reshape(levels, -1), radius).reshape(shape))).any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.ascontiguousarray(~(passed | _above(counter.reshape(levels, -1), radius).reshape(shape)))
        bits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : self.n]
        i, j = np.nonzero(bits)
        later = j > i + first
        return i[later] + first, j[later]


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``, by a bitwise comparison from the highest bit."""
    above = np.zeros(counter.shape[1], np.uint64)
    equal = np.full(counter.shape[1], np.uint64(2**64 - 1))
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counter[level]
        else:
            above |= equal & counter[level]
            equal &= ~counter[level]
    return above


def _files(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return list(zip(edges, edges[1:]))


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int, masks: list[int] | None = None, depth: int = 0) -> Iterator[tuple]:
    """Index pairs within ``radius`` among entries of equal key; none is lost.

    Files above ``FILE_ROWS`` are filed again under each of the given masks
    (further pairs of blocks), which part their entries unless these agree on
    nearly all bits.
    """
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    sizes = np.array([b - a for a, b in _files(keys)], np.int64)
    size_of = np.repeat(sizes, sizes)
    large = (size_of > FILE_ROWS) & (depth < 2) & (masks is not None)
    if large.any():
        big = np.flatnonzero(large)
        code = np.unique(keys[big], return_inverse=True)[1].astype(np.uint64)
        for mask in masks:
            finer = np.unique(np.stack([code, fps[big] & np.uint64(mask)]), axis=1, return_inverse=True)[1].ravel()
            for i, j in close_pairs(finer, fps[big], radius, masks, depth + 1):
                yield order[big[i]], order[big[j]]
    rest = np.flatnonzero(~large & (size_of > 1))
    if not len(rest):
        return
    keys, fps, size_of, order = keys[rest], fps[rest], size_of[rest], order[rest]
    planes = Planes(fps)
    step = 1
    while step < len(keys):
        same = keys[:-step] == keys[step:]
        if not same.any():
            break
        i = planes.close(step, radius, same)
        if len(i):
            yield order[i], order[i + step]
        step += 1


def forest(n: int, pairs: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n - 1`` of the pairs that connect what all of them connect."""
    root = np.arange(n)
    out_i, out_j = [], []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = a, b
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                out_i.append(a)
                out_j.append(b)
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def links_within(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` between node ids, enough to connect all pairs within ``radius`` bits.

    ``nodes`` has one row ``(node, fp)`` per distinct fingerprint. Each task
    emits a spanning forest of the links it finds, so its output is never larger
    than its input, however dense a group of near copies is.
    """
    masks = pair_masks(radius)
    filed = nodes.select("node", "fp", F.explode(_masked(F.col("fp"), masks)).alias("e")).select(
        "node", "fp", F.col("e.m").alias("m"), F.col("e.k").alias("k")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        ids = whole["node"].to_numpy()
        fps = whole["fp"].to_numpy().view(np.uint64)
        pair = np.stack([whole["m"].to_numpy().astype(np.uint64), whole["k"].to_numpy().view(np.uint64)])
        key = np.unique(pair, axis=1, return_inverse=True)[1].ravel()
        distinct, number = np.unique(ids, return_inverse=True)
        pairs = ((number[i], number[j]) for i, j in close_pairs(key, fps, radius, masks))
        i, j = forest(len(distinct), pairs)
        yield pa.RecordBatch.from_arrays([pa.array(distinct[i]), pa.array(distinct[j])], names=["a", "b"])

    return filed.repartition(F.col("m"), F.col("k")).select("node", "fp", "m", "k").mapInArrow(
        tidy(compare), "a long, b long"
    )


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable by links.

    Exact copies share a fingerprint and meet in one sum per task; only distinct
    fingerprints are compared. Texts without words have fingerprint zero and
    link like others. Rows with a null ``doc_id`` get a fingerprint and, unless a
    document with an id has the same, a null component. Repeated rows each come
    back.
    """
    marked = cut_lineage(fingerprints(docs, width, seed), "fingerprints")
    classes = cut_lineage(
        marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "classes"
    )
    found = components(links_within(classes, radius))
    labels = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


#: Bands and coordinates of one: at similarity 0.8 a pair misses all bands with probability 3e-6, above 0.85 below 3e-8.
BANDS, BAND_ROWS = 24, 4
#: Entries of one file that a task compares with as many others.
UNIT_ROWS = 1024
#: Entries up to which units are compared all together, step by step.
SMALL_UNIT = 48
_UNIT = ["bucket", "i", "j"]


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for run in chunks([t or "" for t in texts], 1 << 20):
            yield batch.column(0).slice(run[0], len(run)), [shingles(words_of(texts[i]), width, seed) for i in run]


def _sketches(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """``doc_id``, ``fp``, ``size`` (distinct shingles), ``key`` (128 bits of their set) and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, listed in _shingle_sets(batches, width, seed):
            sets = [np.unique(h) for h in listed]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.array([_majority(h) for h in listed], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([b.tobytes() for b in band_keys(sets, BANDS, BAND_ROWS)], pa.binary()),
                ],
                names=["doc_id", "fp", "size", "key", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fp long, size long, key binary, bands binary")


def _filed(classes: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``fp``, ``size``: every class under each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(bands), *[batch.column(c).take(at) for c in range(3)]], names=["bucket", "node", "fp", "size"])

    return classes.select("node", "fp", "size", "bands").mapInArrow(tidy(run), "bucket long, node long, fp long, size long")


def _in_units(filed: DataFrame, parts: Column) -> DataFrame:
    """Rows with ``i <= j``, the numbers of two parts of their bucket; each pair of parts is one unit."""
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = filed.select("*", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"))
    return dealt.withColumn("i", F.least("part", "_other")).withColumn("j", F.greatest("part", "_other")).drop("_other")


def _units(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """All rows of a task, those of a unit together and by node, with the number of their unit."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    whole = pa.Table.from_batches(parts)
    whole = whole.take(pa.compute.sort_indices(whole, [(k, "ascending") for k in [*_UNIT, "node"]]))
    keys = np.stack([whole[k].to_numpy().astype(np.int64) for k in _UNIT])
    return whole, np.concatenate([[0], np.cumsum((np.diff(keys, axis=1) != 0).any(axis=0))])


def _near(unit: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit within ``radius`` bits: small units all together, larger ones by blocks of entries."""
    sizes = np.bincount(unit)
    small = np.flatnonzero(sizes[unit] <= SMALL_UNIT)
    for a, b in close_pairs(unit[small], fps[small], radius):
        yield small[a], small[b]
    for low, high in _files(unit):
        if high - low > SMALL_UNIT:
            own = fps[low:high]
            planes = Planes(own)
            for at in range(0, high - low, 128):
                a, b = planes.within(own, at, min(at + 128, high - low), radius)
                yield low + a, low + b


def _candidates(rows: pa.Table, unit: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit within ``radius`` bits (by bit planes) whose sizes allow the similarity.

    Entries of one part meet in the unit of that part alone.
    """
    fps, sizes, part, i, j, node = (rows[c].to_numpy() for c in ("fp", "size", "part", "i", "j", "node"))
    for a, b in _near(unit, fps.view(np.uint64), radius):
        low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        fine = (low >= similarity * high - 1e-9) & ((part[a] != part[b]) | (i[a] == j[a])) & (node[a] != node[b])
        if fine.any():
            yield a[fine], b[fine]


def confirmed(
    values: np.ndarray, offsets: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float
) -> Iterator[tuple[int, int]]:
    """Those candidates ``a, b`` (sorted by ``a``) whose sets reach the similarity; each makes two labels one.

    Entry k's set is ``values[offsets[k] : offsets[k + 1]]``, never empty. An
    entry with many candidates is held against the whole unit in one pass.
    """
    if not len(a):
        return
    codes = np.unique(values, return_inverse=True)[1].ravel()
    sizes, label = np.diff(offsets), label.copy()
    mark = np.zeros(len(codes), bool)
    for low, high in _files(a):
        x = int(a[low])
        y = b[low:high][label[b[low:high]] != label[x]]
        if not len(y):
            continue
        own = codes[offsets[x] : offsets[x + 1]]
        mark[own] = True
        if 16 * len(y) < len(sizes):
            common = np.array([np.count_nonzero(mark[codes[offsets[k] : offsets[k + 1]]]) for k in y.tolist()])
        else:
            common = np.add.reduceat(mark[codes], offsets[:-1], dtype=np.int64)[y]
        mark[own] = False
        for k in y[common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9].tolist():
            if label[k] != label[x]:
                label[label == label[k]] = label[x]
                yield x, k


def _set_of(docs: DataFrame, nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """``node`` and ``held``, the distinct shingle hashes, of the texts that stand for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, listed in _shingle_sets(batches, width, seed):
            held = pa.array([np.unique(h).view(np.int64) for h in listed], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), held], names=["node", "held"])

    asked = nodes.select(F.col("node").alias("doc_id")).distinct()
    return docs.select("doc_id", "text").join(asked, "doc_id", "left_semi").mapInArrow(tidy(run), "node long, held array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets reach the similarity."""
    pairs = cut_lineage(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = cut_lineage(_set_of(docs, nodes, width, seed), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}")) for c in "ab")
    common = F.size(F.array_intersect("held_a", "held_b")).cast("double").alias("n")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", common, (F.size("held_a") + F.size("held_b")).alias("total"))
    return met.filter(F.col("n") >= similarity * (F.col("total") - F.col("n")) - 1e-9).select("a", "b")


def similar_links(docs: DataFrame, classes: DataFrame, similarity: float, radius: int, width: int = 5, seed: int = 42) -> DataFrame:
    """Links ``(a, b)`` between nodes that connect all pairs within ``radius`` bits and of at least this Jaccard similarity.

    ``classes`` has one row ``(node, fp, size, bands)`` per distinct set. Classes
    that share a band are compared by the bit planes of their fingerprints, in
    units of bounded size; a pair of similarity 0.8 shares one but for 3e-6.
    A unit first asks for the links of a spanning forest only; where candidates
    of different components remain afterwards, they are all held against the
    sets. Shingle sets are made only for nodes that have a candidate.
    """
    filed = _filed(classes.filter("size > 0"))
    several = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / UNIT_ROWS).cast("int")
    filed = cut_lineage(filed.join(several, "bucket"), "filed")
    columns = [*_UNIT, "node", "fp", "size", "part"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _units(batches)
        if got is not None:
            rows, unit = got
            a, b = forest(rows.num_rows, _candidates(rows, unit, radius, similarity))
            node = rows["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], names=["a", "b"])

    asked = _in_units(filed, parts).select(*columns).repartition(*_UNIT).mapInArrow(tidy(ask), "a long, b long")
    first = cut_lineage(_confirmed(asked, docs, similarity, width, seed), "links")
    label = cut_lineage(components(first), "labels")
    named = filed.filter("n > 2").join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("bucket")
    columns = [*columns, "label"]

    def remain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _units(batches)
        if got is None:
            return
        rows, unit = got
        labels, hit = rows["label"].to_numpy(), np.zeros(rows.num_rows, bool)
        for a, b in _candidates(rows, unit, radius, similarity):
            open_ = labels[a] != labels[b]
            hit[a[open_]] = hit[b[open_]] = True
        hit &= np.bincount(unit)[unit] > 2  # the one pair of a unit has been asked for
        yield from rows.filter(pa.array(hit)).select(columns).combine_chunks().to_batches()

    left = _in_units(named.join(mixed, "bucket"), parts).select(*columns).repartition(*_UNIT).mapInArrow(
        tidy(remain), "bucket long, i int, j int, node long, fp long, size long, part int, label long"
    )
    left = cut_lineage(left, "remaining")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _units(batches)
        if got is None:
            return
        rows, unit = got
        label, node = rows["label"].to_numpy(), rows["node"].to_numpy()
        first, last = [], []
        for a, b in _candidates(rows, unit, radius, similarity):
            open_ = label[a] != label[b]
            first.append(a[open_])
            last.append(b[open_])
        if not first:
            return
        a, b = np.concatenate(first), np.concatenate(last)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        lists = rows["held"].combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        out = []
        for low, high in _files(unit):  # one unit after the other
            pairs = slice(*np.searchsorted(a, [low, high]))
            sets = values[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            for x, y in confirmed(*sets, label[low:high], a[pairs] - low, b[pairs] - low, similarity):
                out.append((int(node[low + x]), int(node[low + y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    settled = left.join(_set_of(docs, left, width, seed), "node").repartition(*_UNIT).select(*columns, "held").mapInArrow(
        tidy(settle), "a long, b long"
    )
    return first.unionByName(settled)


def similar_documents(docs: DataFrame, similarity: float = 0.8, radius: int = 28, width: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``component_id`` by links of at least this Jaccard similarity of ``width``-word shingles.

    Texts of equal shingle sets are one node; texts without words are equal. Pairs
    over ``radius`` bits apart are not met. Null ids get the component of equal
    sets. Of several texts with one id the links of each count for all.
    """
    marked = cut_lineage(_sketches(docs, width, seed), "sketches")
    classes = cut_lineage(
        marked.filter("doc_id IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").cast("long").alias("node"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands")
        ),
        "classes",
    )
    found = components(similar_links(docs, classes, similarity, radius, width, seed))
    labels = classes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labels, "key", "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4, similarity: float | None = None) -> DataFrame:
    """The document of each component with the smallest ``doc_id``; columns as they were.

    With a ``similarity``, links within ``radius`` bits count only if the shingle
    sets reach that Jaccard similarity. Of repeated rows with that id one stays.
    Rows with a null id stay.
    """
    texts = docs.select("doc_id", "text")
    groups = near_duplicates(texts, radius, width) if similarity is None else similar_documents(texts, similarity, radius, width)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    first = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*names).unionByName(docs.filter("doc_id IS NULL").select(*names))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
