"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Both tokenizers see a text with a space before it; their tokens are laid out by
byte offsets. Per batch two ``merge_asof`` joins, keyed by document, find for each
token's start the token of the other side that covers it; the union of both
directions is every overlap. Offsets where tokens of both sides end cut them into
groups that spell the same bytes.

How many documents hold a pair of ids linked is a sum over the corpus. A chunk of
documents sends each of its pairs once, with its own count, and gets the totals
back by joins on the pair and on the chunk; links themselves never leave their
chunk's row. A pair that every document holds is one row per chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as flatten

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treatlens.llm.bpe import SPLIT, byte_letters
from treatlens.llm.phrase_dedup import seal, unseal
from treatlens.llm.tables import chunks, tidy
from treatlens.session import cut_lineage

#: Text that is aligned at once, and that is tokenized at once (both more if one text is longer).
CHUNK_BYTES, PART_BYTES = 4 << 20, 1 << 18
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokens:
    """A vocabulary's bytes by id."""

    def __init__(self, spelled: dict[int, bytes]) -> None:
        self.size = 1 + max(spelled)
        table = [spelled.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - ends + sizes, sizes)]


class Aligner:
    """Side A: a byte-level BPE file of ``tokenizers`` (JSON text); side B: a ``sentencepiece`` model's bytes.

    Added tokens of A are not looked for in texts. Side B puts the space before
    the text by itself.
    """

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken

        data = json.loads(spec)
        letters, bpe = byte_letters(), data["model"]
        special = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in bpe["vocab"].items() if t not in special}
        made = [bpe["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
        if bpe["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(set(made)):
            raise ValueError("only plain byte-level BPE files whose ids follow the order of merges are supported")
        self._a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a = Tokens({i: b for b, i in ranks.items()})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b = Tokens({i: self._piece(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size()) if not self._b.is_control(i)})
        self._words = np.array(
            [f"{i}{end}" for size, ends in ((self.a.size, ",|"), (self.b.size, ",;")) for end in ends for i in range(size)], object
        )

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides end to end, and how many each text has."""

        def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            n = np.array([len(x) for x in ids], np.int64)
            return np.fromiter(flatten.from_iterable(ids), np.int64, int(n.sum())), n

        return *flat([self._a.encode_ordinary(" " + t) for t in texts]), *flat(self._b.encode(texts, num_threads=1) if texts else [])

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of side A, its tokens per text, the same of side B.

        Texts that are null, empty or not spelled by both sides have no tokens.
        """
        parts = []
        whole = [(t or "").encode() for t in texts]
        for run in chunks(whole, PART_BYTES):
            a, n_a, b, n_b = self._encode([texts[i] or "" for i in run])
            want = [b" " + whole[i] if whole[i] else b"" for i in run]
            fine = self._spells(self.a, a, n_a, want) & self._spells(self.b, b, n_b, want) & np.array([len(w) > 0 for w in want])
            parts.append((a[np.repeat(fine, n_a)], np.where(fine, n_a, 0), b[np.repeat(fine, n_b)], np.where(fine, n_b, 0)))
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (none, none, none, none)

    @staticmethod
    def _spells(side: Tokens, ids: np.ndarray, n: np.ndarray, want: list[bytes]) -> np.ndarray:
        got = side.bytes_of(ids).tobytes()
        ends = np.append(0, np.cumsum(side.lengths[ids]))[np.cumsum(n)].tolist()
        return np.array([got[s:e] == w for s, e, w in zip([0, *ends], ends, want)], bool)

    def align(self, texts: list[str | None]) -> Alignment:
        return Alignment(self, *self.tokens(texts))

    def spell_groups(self, got: Alignment) -> Iterator[str]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``, ids in order."""
        group_a = np.cumsum(got.cut_a) - got.cut_a
        group_b = np.cumsum(got.cut_b) - got.cut_b
        first_b = np.searchsorted(group_b, group_a)
        last_a = np.searchsorted(group_a, group_b, "right")
        code = np.empty(len(got.a) + len(got.b), np.int64)
        code[np.arange(len(got.a)) + first_b] = got.a + self.a.size * got.cut_a
        code[np.arange(len(got.b)) + last_a] = 2 * self.a.size + got.b + self.b.size * got.cut_b
        ends = np.cumsum(got.n_a + got.n_b).tolist()
        for s, e in zip([0, *ends], ends):
            yield "".join(self._words[code[s:e]].tolist())[:-1]


class Alignment:
    """Tokens of some texts laid end to end: ids, owners, ends, group cuts, and ``link_a``/``link_b``, all overlaps."""

    def __init__(self, by: Aligner, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        self.doc_a, self.doc_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
        # Both sides of a text have the same bytes, so offsets through all texts agree too.
        self.end_a, self.end_b = np.cumsum(by.a.lengths[a]), np.cumsum(by.b.lengths[b])
        self.start_a, self.start_b = self.end_a - by.a.lengths[a], self.end_b - by.b.lengths[b]
        self.cut_a, self.cut_b = np.isin(self.end_a, self.end_b), np.isin(self.end_b, self.end_a)
        left = pd.DataFrame({"doc": self.doc_a, "at": self.start_a, "a": np.arange(len(a))})
        right = pd.DataFrame({"doc": self.doc_b, "at": self.start_b, "b": np.arange(len(b))})
        over_a = pd.merge_asof(left, right, on="at", by="doc")  # B's token over each start of A
        over_b = pd.merge_asof(right, left, on="at", by="doc")
        held = over_b["a"].to_numpy(np.int64)
        inner = self.start_a[held] < self.start_b  # equal starts are among those of A
        self.link_a = np.concatenate([over_a["a"].to_numpy(np.int64), held[inner]])
        self.link_b = np.concatenate([over_a["b"].to_numpy(np.int64), over_b["b"].to_numpy(np.int64)[inner]])


@lru_cache(maxsize=1)
def _aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


def _shared(docs: DataFrame, path_a: str, path_b: str):
    """Both files go to the executors once; their size is the vocabularies', whatever the corpus."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of about ``CHUNK_BYTES`` at a time."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for run in chunks([t or "" for t in texts], CHUNK_BYTES):
            yield batch.column(0).slice(run[0], len(run)), [texts[i] for i in run]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """Per document the ids and byte ends of both sides, ``links`` and groups.

    ``a_ids``, ``a_ends``, ``b_ids``, ``b_ends``; ``links``: all pairs of token
    numbers whose bytes overlap; ``a_in_group``, ``b_in_group``: tokens of each
    group. Ends count from the space before the text. Texts that are null, empty
    or not spelled byte for byte by both sides have empty arrays. Repeated rows
    are aligned each; other columns are not read.
    """
    shared = _shared(docs, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _some(batches):
            got = _aligner(*shared.value).align(texts)
            columns: dict[str, list] = {c: [] for c in _ALIGNED}
            first_a, first_b = (np.append(0, np.cumsum(n)) for n in (got.n_a, got.n_b))
            order = np.lexsort((got.link_b, got.link_a))
            links = np.stack([got.link_a[order], got.link_b[order]], axis=1)
            for d in range(len(texts)):
                a, b = slice(*first_a[d : d + 2]), slice(*first_b[d : d + 2])
                base = got.start_a[a][:1].sum()
                l0, l1 = np.searchsorted(links[:, 0], first_a[d : d + 2])
                columns["a_ids"].append(got.a[a])
                columns["a_ends"].append(got.end_a[a] - base)
                columns["b_ids"].append(got.b[b])
                columns["b_ends"].append(got.end_b[b] - base)
                columns["links"].append([{"a": i, "b": j} for i, j in (links[l0:l1] - [first_a[d], first_b[d]]).tolist()])
                for side, cut in (("a_in_group", got.cut_a[a]), ("b_in_group", got.cut_b[b])):
                    columns[side].append(np.diff(np.flatnonzero(cut), prepend=-1))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, _ALIGNED[c]) for c, v in columns.items()]], names=[id_col, *_ALIGNED])

    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ", ".join(f"{c} array<long>" if c != "links" else "links array<struct<a: long, b: long>>" for c in _ALIGNED)
    return docs.select(id_col, "text").mapInArrow(tidy(run), f"{id_col} {kind}, {numbers}")


_ALIGNED = {c: pa.list_(pa.int64()) for c in ("a_ids", "a_ends", "b_ids", "b_ends")}
_ALIGNED |= {"links": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))}
_ALIGNED |= {c: pa.list_(pa.int64()) for c in ("a_in_group", "b_in_group")}

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _chunk(aligner: Aligner, texts: list[str | None]) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Group hashes and counts of some texts, their pairs of ids by falling number of documents, and that number."""
    got = aligner.align(texts)
    n = len(texts)
    spelled = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligner.spell_groups(got)]
    doc = got.doc_a[got.link_a]
    width = aligner.a.size * aligner.b.size
    key, times = np.unique(doc * width + got.a[got.link_a] * aligner.b.size + got.b[got.link_b], return_counts=True)
    code, at, held = np.unique(key % width, return_inverse=True, return_counts=True)
    order = np.argsort(-held, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    # Common pairs have small numbers, so steps between a document's sorted numbers pack well.
    owner, at = key // width, place[at]
    sort = np.lexsort((at, owner))
    owner, at, times = owner[sort], at[sort], times[sort]
    step = np.diff(at, prepend=0)
    head = np.diff(owner, prepend=-1) != 0
    step[head] = at[head]
    counts = {
        "n_a": got.n_a, "n_b": got.n_b, "n_groups": np.bincount(got.doc_a[got.cut_a], minlength=n),
        "n_links": np.bincount(doc, minlength=n),
        "pairs": np.bincount(owner, minlength=n), "step": step.astype(np.uint32), "times": times.astype(np.uint32),
    }
    return spelled, counts, code[order], held[order]


def _totals(payload: bytes, n: np.ndarray, best: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over each document's links from the corpus-wide numbers of its chunk's pairs."""
    got = unseal(payload)
    owner = np.repeat(np.arange(len(got["pairs"])), got["pairs"])
    sums = np.cumsum(got["step"].astype(np.int64))
    first = np.cumsum(got["pairs"]) - got["pairs"]
    before = np.append(0, sums)[first]
    at = sums - np.repeat(before, got["pairs"])
    times = got["times"].astype(np.int64)
    size = len(got["pairs"])
    out = {c: got[c] for c in _COUNTS}
    for name, value in (("n_best", times * best[at]), ("count_sum", times * n[at])):
        out[name] = np.zeros(size, np.int64)
        np.add.at(out[name], owner, value)
    return out


def alignment_summary(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per document counts and group hash; and the corpus's table of linked pairs of ids.

    Documents: ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``
    (links to a partner that the A id has in most documents, ties included),
    ``count_sum`` (over links, in how many documents the pair is linked) and
    ``groups_sha256``. Pairs: ``a``, ``b``, ``n_docs``, ``best``. Texts without
    tokens (see ``align_tokens``) have zeros and an empty hash text. Each row
    counts as a document, also with a null or repeated id; other columns are not
    read.
    """
    shared = _shared(docs, path_a, path_b)
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _some(batches):
            spelled, counts, code, held = _chunk(_aligner(*shared.value), texts)
            row = [uuid.uuid4().int >> 65, ids.to_pylist(), spelled, seal(**counts), code, held]
            types = [pa.int64(), pa.list_(ids.type), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=_CHUNK)

    made = docs.select(id_col, "text").mapInArrow(
        tidy(first), f"chunk long, ids array<{kind}>, spelled array<string>, payload binary, code array<long>, held array<long>"
    )
    made = cut_lineage(made, "chunks")  # read twice, and a chunk's number must not change
    size_b = _aligner(*shared.value).b.size
    counted = made.select(F.explode(F.arrays_zip("code", "held")).alias("p")).groupBy("p.code").agg(F.sum("p.held").alias("n"))
    a = F.expr(f"code div {size_b}")
    most = F.max("n").over(Window.partitionBy("a"))  # an A id has no more partners than B has ids
    pairs = cut_lineage(counted.withColumn("a", a).withColumn("best", F.col("n") == most), "pairs")

    def second(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        out = _totals(left["payload"][0].as_py(), n, best)
        ids, spelled = left["ids"].chunk(0).values, left["spelled"].chunk(0).values
        return pa.table([ids, *[pa.array(out[c]) for c in [*_COUNTS, "n_best", "count_sum"]], spelled], names=[id_col, *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    known = made.select(F.col("chunk").alias("of"), F.posexplode("code").alias("at", "code")).join(pairs.select("code", "n", "best"), "code")
    rows = (
        made.select("chunk", "ids", "spelled", "payload").groupBy("chunk")
        .cogroup(known.select("of", "at", "n", "best").groupBy("of"))
        .applyInArrow(second, f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in [*_COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string")
    )
    return rows, pairs.select("a", F.expr(f"code % {size_b}").alias("b"), F.col("n").alias("n_docs"), "best")


_CHUNK = ["chunk", "ids", "spelled", "payload", "code", "held"]
