"""Byte-level BPE by speculation: propose greedily, verify pairs in bulk, merge only what fails.

A word's proposal is its greedy longest match against the vocabulary. A token
sequence is the true encoding exactly if no merge could cross any boundary
between neighbours before the merges that formed them; that is checked for all
distinct neighbour pairs of a batch at once with arrays. Words with a bad pair
are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain as flatten
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.llm.tables import rows_of, tidy

#: Splits text before the merges (public pattern of byte-level vocabularies); white space is Unicode's property.
_S = r"\p{White_Space}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+"
#: Words a task remembers, and the longest of them.
MEMORY, MEMORY_CHARS = 150_000, 64
NEVER = int(np.iinfo(np.int64).max)
_SPACE_AFTER_SPACE = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder built from the JSON text of a ``tokenizers`` file.

    Supported: a ByteLevel pre-tokenizer without prefix space, a BPE model and
    plain added tokens; anything else is refused.
    """

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]
        odd = [t for t in data["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if (
            model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data["normalizer"]
            or data["post_processor"] or odd or model.get("dropout") or not pre.get("use_regex", True)
        ):
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in self.vocab.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.text_of = [str(i) for i in range(size)]
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self._rank_by_code: dict[int, int] = {}
        self._made: list[int] = []
        spelled = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = spelled[a], spelled[b], spelled[a + b]
            self._made.append(made)
            self._rank_by_code.setdefault(left * size + right, rank)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = left, right, rank
        codes = np.array(list(self._rank_by_code), np.int64)
        ranks = np.array(list(self._rank_by_code.values()), np.int64)
        order = np.argsort(codes)
        self._codes, self._ranks, self._size = codes[order], ranks[order], size
        self._proposals = self._trusted()
        self._longest: dict[bytes, int] = {}
        for token in self._proposals:
            if len(token) > 3:
                self._longest[token[:4]] = max(self._longest.get(token[:4], 0), len(token))
        self._pattern = regex.compile(SPLIT)
        marks = sorted(self.special, key=len, reverse=True)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self._pairs: dict[int, bool] = {}
        self._word_ids: dict[str, tuple[int, ...]] = {}
        self._chunk_ids: dict[str, tuple[int, ...]] = {}

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self._size + b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], NEVER)

    def conflicts(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether a merge across the boundary of neighbours ``a b`` comes before those that formed them.

        The boundary touches the right spine of ``a`` and the left spine of
        ``b``. A pair of spine tokens merges if its rank is below that of the
        merge that takes up the left one, and not above that of the right one
        (equal ranks go left to right). ``inner`` leaves out the pair ``a b``.
        """
        bad = np.zeros(len(a), bool)
        rows, x, x_until = np.arange(len(a)), a, np.full(len(a), NEVER)
        first = True
        while len(rows):
            at, y, y_until, top = np.arange(len(rows)), b[rows], np.full(len(rows), NEVER), first
            while len(at):
                r = self._rank_of(x[at], y)
                hit = (r < NEVER) & (r < x_until[at]) & (r <= y_until)
                if not (top and inner):
                    bad[rows[at[hit]]] = True
                top = False
                more = (self.rank[y] >= 0) & ~bad[rows[at]]
                at, y_until, y = at[more], self.rank[y[more]], self.left[y[more]]
            first = False
            more = (self.rank[x] >= 0) & ~bad[rows]
            rows, x_until, x = rows[more], self.rank[x[more]], self.right[x[more]]
        return bad

    def _trusted(self) -> dict[bytes, int]:
        """Tokens whose bytes encode to the token itself; only these are proposed."""
        made = np.flatnonzero(self.rank >= 0)
        good = self.rank < 0
        fine = np.zeros(len(self.rank), bool)
        fine[made] = ~self.conflicts(self.left[made], self.right[made], inner=True)
        for t in made[np.argsort(self.rank[made])]:
            good[t] = fine[t] and good[self.left[t]] and good[self.right[t]]
        return {b: i for b, i in self.vocab.items() if good[i] and (len(b) == 1 or self.rank[i] >= 0)}

    def propose(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        find, longest = self._proposals.get, self._longest.get
        while at < n:
            size = min(n - at, longest(word[at : at + 4], 3))
            while size > 1:
                token = find(word[at : at + size])
                if token is not None:
                    break
                size -= 1
            else:
                token = self.vocab[word[at : at + 1]]
            out.append(token)
            at += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        tokens = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        if len(tokens) > 200:
            return self._merge_long(tokens)
        size, rank, made = self._size, self._rank_by_code.get, self._made
        ranks = [rank(a * size + b, NEVER) for a, b in zip(tokens, tokens[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            tokens[i] = made[low]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] * size + tokens[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(tokens[i] * size + tokens[i + 1], NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same in n log n, for words of any length."""
        n = len(tokens)
        size, rank, made = self._size, self._rank_by_code.get, self._made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = rank(tokens[i] * size + tokens[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, tokens[i], tokens[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words: proposals, one bulk check of their neighbour pairs, merges where it fails."""
        raw = [w.encode("utf-8") for w in words]
        proposals = [self.propose(b) for b in raw]
        sizes = np.array([len(p) for p in proposals], np.int64)
        flat = np.fromiter(flatten.from_iterable(proposals), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[:-1] == owner[1:]
        codes = (flat[:-1] * self._size + flat[1:])[inside]
        distinct, back = np.unique(codes, return_inverse=True)
        known = self._pairs
        fresh = np.array([c for c in distinct.tolist() if c not in known], np.int64)
        if len(fresh):
            if len(known) > 2 * MEMORY:
                known.clear()
                fresh = distinct
            known.update(zip(fresh.tolist(), self.conflicts(fresh // self._size, fresh % self._size).tolist()))
        bad = np.array([known[c] for c in distinct.tolist()], bool)
        failing = np.unique(owner[:-1][inside][bad[back]]) if len(codes) else np.empty(0, np.int64)
        for i in failing.tolist():
            proposals[i] = self.merge(raw[i])
        return [tuple(p) for p in proposals]

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text that split into words on their own.

        A space after a character that is no white space always begins a word,
        so the text may be cut there before the slower pattern is asked.
        """
        if self._marks and self._marks.search(text):
            parts = self._marks.split(text)
            return [c for i, p in enumerate(parts) if p for c in ([p] if i % 2 else self._chunks(p))]
        if _SPACE_AFTER_SPACE.search(text) or text.startswith(" "):
            return self._pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if rest else [first]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; a null text counts as empty."""
        chunks = [self._chunks(t) if t else [] for t in texts]
        held = self._chunk_ids
        fresh = list({c for x in chunks for c in x if c not in held})
        words = [[c] if c in self.special else self._pattern.findall(c) for c in fresh]
        known = self._word_ids
        known.update({text: (i,) for text, i in self.special.items()})
        new = list({w for x in words for w in x if w not in known})
        known.update(zip(new, self.encode_words(new)))
        held.update((c, tuple(flatten.from_iterable(map(known.__getitem__, w)))) for c, w in zip(fresh, words))
        out = [np.fromiter(flatten.from_iterable(map(held.__getitem__, x)), np.int32) for x in chunks]
        for memory in (held, known):
            if len(memory) > MEMORY:  # forget the older half, and what is long
                for key in list(islice(memory, len(memory) // 2)):
                    del memory[key]
        for memory, keys in ((held, fresh), (known, new)):
            for key in keys:
                if len(key) > MEMORY_CHARS:
                    memory.pop(key, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.flat[where].tobytes().decode("utf-8", "replace")

    def id_text(self, ids: np.ndarray) -> str:
        return ",".join(map(self.text_of.__getitem__, ids.tolist()))


def _coder(df: DataFrame, path: str):
    """The coder goes to the executors once; its size is the vocabulary's, whatever the corpus.

    A Python worker keeps its copy, with the words it remembers, from task to task.
    """
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(ByteBpe(f.read()))


def _some(rows: list, limit: int = 2_000_000) -> Iterator[list]:
    """Runs of texts of about ``limit`` characters."""
    run, size = [], 0
    for row in rows:
        run.append(row)
        size += len(row or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``ids`` of every whole text; null and empty texts have no ids.

    Added tokens found in a text take their id. Repeated rows are encoded each;
    other columns are not read.
    """
    shared = _coder(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            ids = [x for part in _some(rows_of(batch, "text")) for x in coder.encode(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of ids; null ids count as none."""
    shared = _coder(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in rows_of(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: number of ids, hash of the ids, hash of the decoded text.

    Same contract as ``encode`` and ``decode``, without moving the ids between
    processes: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.
    """
    shared = _coder(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            n, first, second = [], [], []
            for part in _some(rows_of(batch, "text")):
                for ids in coder.encode(part):
                    n.append(len(ids))
                    first.append(hashlib.sha256(coder.id_text(ids).encode()).hexdigest())
                    second.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), "text").mapInArrow(
        tidy(run), f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
