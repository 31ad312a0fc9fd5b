import hashlib
import random

import numpy as np
import pytest

from treatlens.llm import phrase_dedup
from treatlens.llm.phrase_dedup import remove_repeats, without_repeats


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in data:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        covered = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                covered[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((i, len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd\u00e9") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(9)) for _ in range(5)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, "a" * 400), (501, "a" * 30 + "b" + "a" * 120), (502, rows[0][1]), (503, "common line " * 10), (504, "x" + "common line " * 9)]
    rows += [(600, ""), (601, None), (602, "z" * 49), (603, "z" * 50), (604, "z" * 50), (605, "\0" * 80), (606, "\0" * 60 + "q")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1, 256])
def test_equals_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(phrase_dedup, "HOT_PHRASES", hot)
    rows = texts(hot)
    got = remove_repeats(docs(rows, extra=["tag", "kept"])).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_long_text_is_cut_without_loss(spark, docs, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "HASH_BYTES", 256)
    monkeypatch.setattr(phrase_dedup, "BATCH_BYTES", 2048)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, long), (2, "head " + long[1000:3000] + " tail"), (3, long[2900:3100])]
    got = remove_repeats(docs(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_tasks_follow_the_size_of_the_texts(docs, monkeypatch):
    rows = texts(3)
    monkeypatch.setattr(phrase_dedup, "TASK_BYTES", 1000)
    frame = docs(rows)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert phrase_dedup._buckets(frame) == -(-size // 1000)
    got = remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_null_and_repeated_ids(spark, docs, empty_docs):
    t = "some passage that is surely longer than fifty bytes, as it must be"
    got = sorted(((r.doc_id, r.n_removed) for r in remove_repeats(docs([(None, t), (7, t), (7, t), (7, t + "!"), (8, t)])).collect()), key=str)
    assert got == [(7, 0), (7, 0), (7, 0), (8, len(t)), (None, 0)]
    assert remove_repeats(empty_docs).count() == 0


def test_columns_come_back_with_shortened_texts(spark, docs):
    t = "\u00e9" * 40
    frame = docs([(1, t + "tail"), (2, "head" + t), (3, None), (None, t), (4, t), (4, t)], extra=["tag", "kept", "_id", "_tag", "_kept", "_text_tag"])
    out = without_repeats(frame)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, t + "tail", 44), (2, "head", 4), (3, None, None), (None, t, 40), (4, "", 0), (4, "", 0)], key=str)


def test_blocks_of_few_records_are_small():
    """A batch makes a block for each target, so that their heads would outgrow the records on large tables."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 500):
        block = {"id": np.arange(n) * 7, "run": np.ones(n, np.int32), "n": rng.integers(1, 31, n).astype(np.uint8),
                 "key": rng.integers(0, 2**32, n).astype(np.uint32), "high": rng.integers(0, 2**16, n).astype(np.uint16)}
        sealed = phrase_dedup.seal(**block)
        got = phrase_dedup.unseal(sealed)
        assert list(got) == list(block) and all(got[k].dtype == v.dtype and (got[k] == v).all() for k, v in block.items())
        assert len(sealed) < 200 + 10 * n


def test_texts_are_told_apart_only_where_ids_repeat(docs):
    assert not phrase_dedup._tagged(docs(texts(3)))
    assert phrase_dedup._tagged(docs([(1, "a"), (2, "b"), (1, "c")]))
