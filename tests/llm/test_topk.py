import numpy as np
import pytest

from treatlens.llm import topk
from treatlens.llm.topk import block_top, top_k


def brute(vectors, queries, k):
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    out = set()
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks
        monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.2, 8).round(1).tolist()) for i in range(150)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in top_k(frame.filter("vec_id % 20 = 0"), frame, k=7).collect()}
    assert got == brute(vectors, range(0, 150, 20), 7)


def test_odd_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (5, [1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (20, [1e300, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(frame.filter("vec_id = 0"), frame, k=10).orderBy("rank").collect()]
    assert [r[2] for r in got] == [20, 7, 7, 5, 6]
    assert got[0][3] == 2**63 - 1 and got[1][3] == 64 * 64 + 128 * 128 and got[4][3] == 0
    empty = frame.filter("vec_id > 100")
    assert top_k(empty, frame).count() == 0 and top_k(frame.filter("vec_id = 0"), empty).count() == 0


def test_repeated_queries_have_a_list_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in top_k(frame.filter("vec_id = 0"), frame, k=2).collect())
    assert got == [(1, 1), (1, 2), (1, 2), (2, 3), (2, 3), (2, 3)]


def test_ties_in_a_block_go_to_the_smaller_id():
    q, c, s = block_top(np.array([9]), np.ones((1, 2)), np.array([5, 3, 9, 1]), np.ones((4, 2)), 2)
    assert c.tolist() == [1, 3] and s.tolist() == [2, 2]
