"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

Every byte covered by a string of ``WINDOW`` bytes that also starts in a document
with a smaller id goes. A rolling hash cuts each text into phrases: the trigger of
a window is the smallest ``GRAM``-byte hash inside it, so equal windows have equal
triggers, and the windows of one trigger form one phrase of at most 80 bytes.

1. Dictionary and parse. Phrases are dealt out by trigger; a task sorts them, and
   every occurrence of a phrase later than its first document is settled as a
   whole. This is all that exact copies and the inside of shared passages need.
2. Suffix order. Only phrases that differ but share a trigger (the ends of shared
   passages, and chance) are compared by content: the suffixes of the dictionary's
   phrases are sorted, and joining that order with the parse (who holds which
   phrase) puts equal windows of all documents side by side.
3. The covered spans go back to their documents.

Triggers with very many phrases are dealt out window by window instead, after each
task has reduced them to first documents, so no trigger is the work of one task.
Rows between steps are compressed columns, one row per task and target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treatlens.llm.tables import chunks, tidy
from treatlens.session import cut_lineage

WINDOW, GRAM = 50, 20
#: Phrases of one trigger above which its windows are dealt out one by one.
HOT_PHRASES = 256
#: Bytes of text handled at once in a task, and hashed at once.
BATCH_BYTES, HASH_BYTES = 6 << 20, 1 << 18
#: Bytes of text dealt out at once: larger blocks for each of many targets compress better.
PACK_BYTES = 24 << 20
#: Most text that one task takes on average, whatever the session's number of partitions.
TASK_BYTES = 32 << 20
SPANS, TRIGGERS, OPEN, TEXTS, PHRASES, ROWS = range(6)
_ROW = "target int, kind int, payload binary"
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


# --- rows between steps ---------------------------------------------------


def seal(**columns: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed block.

    Blocks are many and small, one per batch and target, so that the head is one
    short line. Bytes of one place of all numbers stand together, and what zstd
    does not shorten is kept as it is.
    """
    zstd, head, body = pa.Codec("zstd", compression_level=3), [], []
    for name, v in columns.items():
        raw = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
        packed = zstd.compress(raw, asbytes=True)
        body.append(min(raw, packed, key=len))
        head.append(f"{name} {v.dtype.str} {len(v)} {len(body[-1])}")
    return ";".join(head).encode() + b"\n" + b"".join(body)


def unseal(payload: bytes) -> dict[str, np.ndarray]:
    at = payload.index(b"\n") + 1
    zstd, out = pa.Codec("zstd"), {}
    for column in payload[: at - 1].decode().split(";"):
        name, kind, n, size = column.split(" ")
        whole, part = int(n) * np.dtype(kind).itemsize, payload[at : at + int(size)]
        raw = part if len(part) == whole else zstd.decompress(part, whole, asbytes=True)
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, int(n)).T).view(kind).reshape(-1) if whole else np.empty(0, kind)
        at += int(size)
    return out


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    target, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(target, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
        names=["target", "kind", "payload"],
    )


def _runs(ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    """Document of each record as runs; records of a document stand together."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    first = np.flatnonzero(new)
    return {"id": np.diff(ids[first], prepend=0), "tag": tags[first], "run": np.diff(np.append(first, len(ids))).astype(np.int32)}


def _docs_of(got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.cumsum(got["id"]), got["run"]), np.repeat(got["tag"], got["run"])


def _joined(parts: list[dict[str, np.ndarray]], names: Iterable[str]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) for n in names}


def doc_target(ids: np.ndarray, buckets: int) -> np.ndarray:
    mixed = _mix(ids.astype(np.int64).view(np.uint64))
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _dealt(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Records of each target, in their order."""
    order = np.argsort(target, kind="stable")
    edges = np.flatnonzero(np.diff(target[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(target[part[0]]), part


def _span_rows(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> list:
    """Covered spans, merged within a document, dealt out by document."""
    if not len(ids):
        return []
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], end[order]
    # Running end within a document: ids are numbered so that one pass serves all.
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    base = (np.cumsum(new) - 1) << 40
    reach = np.maximum.accumulate(base + end)
    head = np.ones(len(ids), bool)
    head[1:] = (base + start)[1:] > reach[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(ids)) - 1
    ids, tags, start, end = ids[first], tags[first], start[first], (reach - base)[last]
    return [
        (t, SPANS, seal(**_runs(ids[p], tags[p]), start=start[p].astype(np.int32), end=end[p].astype(np.int32)))
        for t, p in _dealt(doc_target(ids, buckets))
    ]


# --- phrases --------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, sizes: Iterable[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of each size, by doubling."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(_BASE, n, 1 << 64))

    doubled, size = {1: _TABLE[data]}, 1
    while size * 2 <= max(sizes):
        a = doubled[size]
        doubled[size * 2] = a[:-size] * power(size) + a[size:]
        size *= 2
    out = {}
    for size in sizes:
        value, at = None, 0
        for step in sorted(doubled, reverse=True):
            if size & step:
                part = doubled[step][at:]
                value = part if value is None else value[: len(part)] * power(step) + part
                at += step
        out[size] = value
    return out


def triggers(data: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of texts laid end to end: text number, first window, windows, trigger and phrase hash."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = len(data) - WINDOW + 1
    if n < 1:
        return {k: np.empty(0, t) for k, t in (("doc", np.int64), ("a", np.int64), ("n", np.uint8), ("key", np.uint64), ("phrase", np.uint64))}
    hashes = rolling(data, (GRAM, WINDOW))
    grams, windows = _mix(hashes[GRAM]), hashes[WINDOW]
    # Sliding minimum by doubling; the low bits carry its place, so ties go to the left.
    span, want = 1, WINDOW - GRAM + 1
    low = grams & ~np.uint64(31)
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:] + np.uint64(span))
        span *= 2
    if span < want:
        low = np.minimum(low[: span - want], low[want - span :] + np.uint64(want - span))
    inside = np.zeros(n + WINDOW, np.int32)  # windows that stay within their text
    long_enough = lengths >= WINDOW
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, (starts + lengths - WINDOW + 1)[long_enough], -1)
    at = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    pos = at + (low[at] & np.uint64(31)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (pos[1:] != pos[:-1])
    first = np.flatnonzero(new)
    doc_first = np.searchsorted(starts, at[first], "right") - 1
    a, b, p = at[first], at[np.append(first[1:], len(at)) - 1], pos[first]
    place = ((b - a) * 64 + (p - a)).astype(np.uint64)
    phrase = _mix(windows[a] * np.uint64(3) + _mix(windows[b]) * np.uint64(7) + place)
    return {"doc": doc_first, "a": a - starts[doc_first], "n": (b - a + 1).astype(np.uint8), "key": grams[p], "phrase": phrase}


def cut_phrases(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``triggers`` of any number of texts in bounded memory; a long text is cut where windows begin."""
    pieces, owner, base = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), HASH_BYTES):
            pieces.append(text[at : at + HASH_BYTES + WINDOW - 1])
            owner.append(i)
            base.append(at)
    parts = []
    for run in chunks(pieces, HASH_BYTES):
        lengths = np.array([len(pieces[i]) for i in run], np.int64)
        got = triggers(np.frombuffer(b"".join(pieces[i] for i in run), np.uint8), lengths)
        at = np.array(run)[got["doc"]]
        parts.append({**got, "a": got["a"] + np.array(base)[at], "doc": np.array(owner)[at]})
    return _joined(parts, ("doc", "a", "n", "key", "phrase")) if parts else triggers(np.empty(0, np.uint8), np.empty(0, np.int64))


def first_docs(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each record's group; groups are consecutive numbers of sorted records."""
    edge = np.ones(len(group), bool)
    edge[1:] = group[1:] != group[:-1]
    return np.minimum.reduceat(ids, np.flatnonzero(edge))[np.cumsum(edge) - 1] if len(ids) else ids


# --- the steps, each over one task's rows ---------------------------------


def _tag(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42)


def _texts_of(batches: Iterator[pa.RecordBatch], tagged: bool, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, content tags (zeros unless ``tagged``) and UTF-8 bytes of documents, some ``size`` bytes at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for run in chunks(texts, size):
            own = [texts[i] for i in run]
            tags = np.array([_tag(t) if tagged else 0 for t in own], np.uint64).view(np.int64)
            yield ids[run], tags, own


def parse_texts(buckets: int, tagged: bool) -> Callable:
    """Documents -> phrases by trigger, and spans that a document of the same task settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, texts in _texts_of(batches, tagged, BATCH_BYTES):
            got = cut_phrases(texts)
            doc_ids = ids[got["doc"]]
            same = np.argsort(got["key"] ^ _mix(got["phrase"]), kind="stable")
            first = np.empty_like(doc_ids)
            first[same] = first_docs((got["key"] ^ _mix(got["phrase"]))[same], doc_ids[same])
            late = doc_ids > first
            d = got["doc"][late]
            end = got["a"][late] + got["n"][late] + WINDOW - 1
            rows = _span_rows(ids[d], tags[d], got["a"][late], end, buckets)
            sent = np.flatnonzero(~late)
            target = ((got["key"][sent] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            for t, part in _dealt(target):
                p = sent[part]
                d, a = got["doc"][p], got["a"][p]
                phrase = got["phrase"][p]
                rows.append((t, TRIGGERS, seal(
                    **_runs(ids[d], tags[d]), a=np.diff(a, prepend=0).astype(np.int32), n=got["n"][p],
                    key=got["key"][p].astype(np.uint32), low=phrase.astype(np.uint32),
                    high=(phrase >> np.uint64(32)).astype(np.uint16),
                )))
            yield _rows(rows)

    return run


def match_phrases(buckets: int) -> Callable:
    """Phrases of a task's triggers -> spans of repeated phrases, and phrases to compare by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for target, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != TRIGGERS:
                    yield _rows([(target, kind, payload)])
                    continue
                got = unseal(payload)
                ids, tags = _docs_of(got)
                key = got["key"].astype(np.uint64) | (np.uint64(target) << np.uint64(32))
                phrase = got["low"].astype(np.uint64) | (got["high"].astype(np.uint64) << np.uint64(32))
                parts.append({"ids": ids, "tags": tags, "a": np.cumsum(got["a"]).astype(np.int64), "n": got["n"], "key": key, "phrase": phrase})
        if not parts:
            return
        x = _joined(parts, ("ids", "tags", "a", "n", "key", "phrase"))
        order = np.lexsort((x["phrase"], x["key"]))
        x = {k: v[order] for k, v in x.items()}
        new_key = np.ones(len(order), bool)
        new_key[1:] = x["key"][1:] != x["key"][:-1]
        new_phrase = new_key.copy()
        new_phrase[1:] |= x["phrase"][1:] != x["phrase"][:-1]
        by_phrase = np.cumsum(new_phrase)
        by_key = np.cumsum(new_key) - 1
        first = first_docs(by_phrase, x["ids"])
        late = x["ids"] > first
        yield _rows(_span_rows(x["ids"][late], x["tags"][late], x["a"][late], x["a"][late] + x["n"][late] + WINDOW - 1, buckets))
        # Several phrases with one trigger, in several documents: their ends need a look.
        phrases = np.bincount(by_key, weights=new_phrase).astype(np.int64)
        heads = np.flatnonzero(new_key)
        several = (phrases > 1) & (np.maximum.reduceat(first, heads) > np.minimum.reduceat(first, heads))
        open_ = np.flatnonzero(several[by_key] & ~late)
        hot = phrases[by_key[open_]] > HOT_PHRASES
        ids, tags = x["ids"][open_], x["tags"][open_]
        to = np.where(hot, -1, (x["key"][open_] >> np.uint64(32)).astype(np.int64)).astype(np.int32)
        order = np.lexsort((x["a"][open_], tags, ids))
        open_, ids, tags, to = open_[order], ids[order], tags[order], to[order]
        yield _rows([
            (t, OPEN, seal(**_runs(ids[p], tags[p]), a=x["a"][open_[p]].astype(np.int32), n=x["n"][open_[p]], to=to[p]))
            for t, p in _dealt(doc_target(ids, buckets))
        ])

    return run


def _text_block(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], part: np.ndarray) -> bytes:
    return seal(
        id=ids[part], tag=tags[part], size=np.array([len(texts[i]) for i in part], np.int64),
        text=np.frombuffer(b"".join(texts[i] for i in part), np.uint8),
    )


def _docs_in(payload: bytes) -> list[tuple[int, int, bytes]]:
    got = unseal(payload)
    ends = np.cumsum(got["size"]).tolist()
    whole = got["text"].tobytes()
    return [(i, t, whole[e - s : e]) for i, t, s, e in zip(got["id"].tolist(), got["tag"].tolist(), got["size"].tolist(), ends)]


def pack_texts(buckets: int, tagged: bool) -> Callable:
    """Documents as compressed blocks by document target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, texts in _texts_of(batches, tagged, PACK_BYTES):
            yield _rows([(t, TEXTS, _text_block(ids, tags, texts, p)) for t, p in _dealt(doc_target(ids, buckets))])

    return run


def pack_rows(buckets: int, tagged: bool) -> Callable:
    """Documents with their other columns (a struct) as compressed blocks by document target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, tags, texts in _texts_of(iter([batch]), tagged, PACK_BYTES):
                rest = batch.column(2).slice(at, len(ids))
                at += len(ids)
                rows = []
                for t, p in _dealt(doc_target(ids, buckets)):
                    block = _text_block(ids, tags, texts, p)
                    own = pa.RecordBatch.from_arrays([rest.take(pa.array(p))], names=["rest"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(own)
                    rows.append((t, ROWS, len(block).to_bytes(8, "little") + block + sink.getvalue().to_pybytes()))
                yield _rows(rows)

    return run


def _task(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple], dict[int, list[dict]]]:
    """All documents ``(id, tag, bytes)`` of a task and its other blocks by kind."""
    docs, other = [], {SPANS: [], OPEN: []}
    for batch in batches:
        for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if kind == TEXTS:
                docs += _docs_in(payload)
            else:
                other[kind].append(unseal(payload))
    return docs, other


def suffix_order(segments: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record and offset of every window of the segments, and whether an earlier document holds it.

    ``segments`` are phrases end to end, ``size`` their lengths. Suffixes are
    sorted by their first ``WINDOW`` bytes; equal neighbours are one window.
    """
    count = size - WINDOW + 1
    record = np.repeat(np.arange(len(size)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + offset
    windows = np.lib.stride_tricks.sliding_window_view(segments, WINDOW)[start]
    text = np.ascontiguousarray(windows).view(f"S{WINDOW}").ravel()
    order = np.argsort(text, kind="stable")
    ranked = windows[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    late = np.empty(len(order), bool)
    late[order] = ids[record[order]] > first_docs(np.cumsum(new), ids[record[order]])
    return record, offset, late


def open_phrases(buckets: int) -> Callable:
    """Documents and their open phrases -> the phrases' bytes, dealt out by trigger or, if hot, by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, other = _task(batches)
        if not other[OPEN]:
            return
        text = {(i, t): b for i, t, b in docs}
        parts = []
        for got in other[OPEN]:
            ids, tags = _docs_of(got)
            parts.append({"ids": ids, "tags": tags, "a": got["a"].astype(np.int64), "n": got["n"].astype(np.int64), "to": got["to"]})
        x = _joined(parts, ("ids", "tags", "a", "n", "to"))
        order = np.lexsort((x["a"], x["tags"], x["ids"]))
        x = {k: v[order] for k, v in x.items()}
        pieces = [
            text[i, t][a : a + n + WINDOW - 1]
            for i, t, a, n in zip(x["ids"].tolist(), x["tags"].tolist(), x["a"].tolist(), x["n"].tolist())
        ]
        rows = []
        hot = x["to"] < 0

        def send(target: np.ndarray, ids: np.ndarray, tags: np.ndarray, a: np.ndarray, own: list[bytes]) -> None:
            for t, p in _dealt(target):
                rows.append((t, PHRASES, seal(
                    **_runs(ids[p], tags[p]), a=a[p].astype(np.int32), size=np.array([len(own[i]) for i in p], np.int32),
                    text=np.frombuffer(b"".join(own[i] for i in p), np.uint8),
                )))

        calm = np.flatnonzero(~hot)
        send(x["to"][calm], x["ids"][calm], x["tags"][calm], x["a"][calm], [pieces[i] for i in calm])
        at = np.flatnonzero(hot)
        if len(at):
            own = [pieces[i] for i in at]
            whole = np.frombuffer(b"".join(own), np.uint8)
            record, offset, late = suffix_order(whole, np.array([len(b) for b in own], np.int64), x["ids"][at])
            ids, tags, a = x["ids"][at][record], x["tags"][at][record], x["a"][at][record] + offset
            rows += _span_rows(ids[late], tags[late], a[late], a[late] + WINDOW, buckets)
            windows = [own[r][o : o + WINDOW] for r, o in zip(record[~late].tolist(), offset[~late].tolist())]
            target = np.array([xxhash.xxh64_intdigest(w, 1) % buckets for w in windows], np.int64)
            send(target, ids[~late], tags[~late], a[~late], windows)
        yield _rows(rows)

    return run


def sort_phrases(buckets: int) -> Callable:
    """Open phrases of a task -> spans whose windows an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for target, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != PHRASES:
                    yield _rows([(target, kind, payload)])
                    continue
                got = unseal(payload)
                ids, tags = _docs_of(got)
                parts.append({"ids": ids, "tags": tags, "a": got["a"].astype(np.int64), "size": got["size"].astype(np.int64), "text": got["text"]})
        if not parts:
            return
        x = _joined(parts, ("ids", "tags", "a", "size", "text"))
        record, offset, late = suffix_order(x["text"], x["size"], x["ids"])
        record, at = record[late], (x["a"][record] + offset)[late]
        yield _rows(_span_rows(x["ids"][record], x["tags"][record], at, at + WINDOW, buckets))

    return run


def _by_doc(blocks: list[dict]) -> dict[tuple[int, int], list[np.ndarray]]:
    """Start and end of every covered span by document."""
    spans: dict[tuple[int, int], list[np.ndarray]] = {}
    for got in blocks:
        edge = np.cumsum(got["run"])
        for i, t, n, e in zip(np.cumsum(got["id"]).tolist(), got["tag"].tolist(), got["run"].tolist(), edge.tolist()):
            spans.setdefault((i, t), []).append(np.stack([got["start"][e - n : e], got["end"][e - n : e]]))
    return spans


def _cut(text: bytes, held: list[np.ndarray] | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and maximal removed runs."""
    if not held:
        return text, 0, 0
    kept, removed, runs, at = [], 0, 0, 0
    both = np.concatenate(held, axis=1)
    for a, b in both[:, np.argsort(both[0], kind="stable")].T.tolist():
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            removed -= a - b
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and all their spans -> what is left, with counts and hash."""
    docs, other = _task(batches)
    spans = _by_doc(other[SPANS])
    out = []
    for i, t, text in docs:
        left, removed, runs = _cut(text, spans.get((i, t)))
        tag = t or int(np.uint64(_tag(text)).view(np.int64))
        out.append((i, tag, len(text), removed, runs, hashlib.sha256(left).hexdigest(), left))
        if len(out) == 2000:
            yield _result(out)
            out = []
    if out:
        yield _result(out)


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and all their spans -> other columns, text that is left, whether it was cut."""
    blocks, spans = [], []
    for batch in batches:
        for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans.append(unseal(payload)) if kind == SPANS else blocks.append(payload)
    held = _by_doc(spans)
    for payload in blocks:
        size = int.from_bytes(payload[:8], "little")
        docs = _docs_in(payload[8 : 8 + size])
        rest = pa.ipc.open_stream(payload[8 + size :]).read_next_batch().column(0)
        left = [_cut(text, held.get((i, t))) for i, t, text in docs]
        texts = pa.array([b.decode("utf-8", "ignore") for b, _, _ in left], pa.string())
        yield pa.RecordBatch.from_arrays([rest, texts, pa.array([n > 0 for _, n, _ in left], pa.bool_())], names=["rest", "left", "cut"])


_RESULT = "doc_id long, tag long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _RESULT.split(", ")]
    )


# --- the operator ---------------------------------------------------------


def _buckets(docs: DataFrame) -> int:
    """The session's shuffle partitions, or as many as keep ``TASK_BYTES`` of text to one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_BYTES))


def _tagged(named: DataFrame) -> bool:
    """Whether rows share a ``doc_id``, so that only their texts' tags tell them apart."""
    return not named.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _step(rows: DataFrame, n: int, fn: Callable) -> DataFrame:
    return rows.repartitionById(n, F.col("target")).mapInArrow(tidy(fn), _ROW)


def _spans(named: DataFrame, n: int, tagged: bool) -> DataFrame:
    """Covered spans of ``named`` (doc_id, text), dealt out by document."""
    matched = cut_lineage(_step(named.mapInArrow(tidy(parse_texts(n, tagged)), _ROW), n, match_phrases(n)), "phrases")
    packed = named.mapInArrow(tidy(pack_texts(n, tagged)), _ROW)
    opened = _step(packed.unionByName(matched.filter(f"kind = {OPEN}")), n, open_phrases(n))
    settled = cut_lineage(_step(opened, n, sort_phrases(n)), "spans")
    return matched.filter(f"kind = {SPANS}").unionByName(settled)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of every document.

    Returns ``doc_id``, ``tag`` (xxhash64 of the text), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and
    ``kept`` (bytes). Texts are whole UTF-8 bytes, null counts as empty. Rows
    with one ``doc_id`` do not affect each other, repeated or not; a null
    ``doc_id`` comes before and after nothing, so such rows keep their text.
    Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = own.filter("doc_id IS NOT NULL")
    n, tagged = _buckets(named), _tagged(named)
    packed = named.mapInArrow(tidy(pack_texts(n, tagged)), _ROW)
    done = packed.unionByName(_spans(named, n, tagged)).repartitionById(n, F.col("target")).mapInArrow(tidy(cut_texts), _RESULT)
    loose = own.filter("doc_id IS NULL").select(
        "doc_id", F.xxhash64("text").alias("tag"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"),
    )
    return done.unionByName(loose)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each text reduced to what is left, and ``n_chars``, where there is one, to its length.

    Every row stays, also with an empty text. Bytes of a character of which a
    part was removed go with it. Null texts stay null. Columns may have any
    names; they travel with their text, so no join brings them together.
    """
    names = [c for c in docs.columns if c != "text"]
    text = F.col("text")
    rest = F.struct(text.isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), rest.alias("rest"))
    named = own.filter("doc_id IS NOT NULL")
    n, tagged = _buckets(named), _tagged(named)
    kind = T.StructType([own.schema["rest"], T.StructField("left", T.StringType()), T.StructField("cut", T.BooleanType())])
    rows = named.mapInArrow(tidy(pack_rows(n, tagged)), _ROW).unionByName(_spans(named.select("doc_id", "text"), n, tagged))
    done = rows.repartitionById(n, F.col("target")).mapInArrow(tidy(cut_rows), kind)
    loose = own.filter("doc_id IS NULL").select("rest", F.col("text").alias("left"), F.lit(False).alias("cut"))
    new = {"text": F.when(~F.col("rest.none"), F.col("left"))}
    if "n_chars" in names:
        held = F.col(f"rest.c{names.index('n_chars')}")
        new["n_chars"] = F.when(F.col("cut"), F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(held)
    columns = [new[c] if c in new else F.col(f"rest.c{names.index(c)}") for c in docs.columns]
    return done.unionByName(loose).select(*[v.alias(c) for v, c in zip(columns, docs.columns)])
