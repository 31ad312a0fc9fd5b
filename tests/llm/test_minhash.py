import random

import numpy as np
import pytest

from treatlens.llm import minhash
from treatlens.llm.minhash import similar_sets
from treatlens.llm.sketches import sketch

SPACES = "\t\n\x0b\x0c\r"


def shingle_set(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACES else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=85):
    """Sorted (doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = [i for i, _ in rows]
    links = [
        (x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y]
        and 100 * min(len(sets[x]), len(sets[y])) >= percent * max(len(sets[x]), len(sets[y]))
        and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])
    ]
    moved = True
    while moved:
        moved = False
        for x, y in links:
            low = min(label[x], label[y])
            if label[x] != low or label[y] != low:
                label[x] = label[y] = low
                moved = True
    return sorted((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, label))


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def near_copies(rng, n, words=90, changed=2):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changed + 1)):
            text[rng.randrange(words)] = str(rng.randrange(10**6))
        yield " ".join(text[: rng.choice([words, words - 1, words - 4])])


@pytest.mark.parametrize("block", [256, 3])
def test_equals_brute_force(spark, docs, monkeypatch, block):
    """Groups whose links run over several copies, some not through their centre; in small blocks too."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    texts = [t for n in (2, 3, 30, 60) for t in near_copies(rng, n)] + ["A few words", "a  few\twords", "few words a"] * 2
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert 8 < len({r[2] for r in want}) < len(want) - 40
    assert result(similar_sets(docs(rows).repartition(5))) == [tuple(r) for r in sorted(want, key=repr)]


def test_nulls_empty_repeated_and_long(spark, docs):
    long = " ".join(str(i) for i in range(40_000))
    rows = [(5, None), (4, ""), (6, " \n"), (9, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (7, "One"), (3, "one")]
    got = result(similar_sets(docs(rows, ["size", "key", "bands", "label"])))
    assert got == sorted([
        (5, 0, 5, True), (4, 0, 4, True), (6, 0, 6, True), (9, 39_996, 2, False), (2, 39_997, 2, True), (2, 39_997, 2, True),
        (None, 39_996, None, True), (None, 0, None, True), (7, 1, 3, False), (3, 1, 3, True),
    ], key=repr)


def test_the_link_is_exact_at_its_border(spark, docs):
    """17 of 20 shingles shared is 85 %; 16 of 19 is not."""
    words = [str(i) for i in range(100)]
    rows = [(1, " ".join(words[:22])), (2, " ".join([*words[:21], "x", "y"])), (3, " ".join(words[50:71])), (4, " ".join([*words[50:70], "x", "y"]))]
    want = brute(rows)
    assert result(similar_sets(docs(rows))) == [tuple(r) for r in sorted(want, key=repr)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    for size in (1, 2, 40, 1000):
        a, b = items[:size], items[size // 4 : size + size // 4]
        rows = sketch([a, b, a[::-1]], 160)
        assert (rows != 2**64 - 1).all() and (rows[0] == rows[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((rows[0] == rows[1]).mean() - true) < 0.17


def test_empty_table(spark, empty_docs):
    assert similar_sets(empty_docs).collect() == []
