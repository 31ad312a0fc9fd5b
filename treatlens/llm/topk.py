"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Queries and candidates are dealt into blocks. A task holds one block of each:
the candidates as one posting array per dimension, the scores of a query as one
dense array that every non-zero query term adds its weighted postings to. The
best k of a block are cut out by partition selection; the blocks' lists merge in
a ranking window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows per block: a task holds two blocks and one score array. Every candidate is copied once per block of queries.
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 8192


def usable(vector: str, ident: str) -> Column:
    """Vectors and ids that take part: nothing null, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(ident).isNotNull() & F.col(vector).isNotNull() & finite


def _matrix(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers, rows padded with zeros to the longest."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest numbers that no score can leave."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.int32 if most < 2**31 else np.int64 if most < 2**62 else object


def block_top(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, candidate id and score of the best ``k`` of one block; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    kind = _exact_type(queries, candidates)
    whole = (lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)) if kind is object else (
        lambda m: m.astype(kind))
    postings, weights = np.ascontiguousarray(whole(candidates.T)), whole(queries)
    n = len(ids)
    scores, add = np.empty(n, kind), np.empty(n, kind)
    place = np.arange(n - 1, -1, -1, dtype=object if kind is object else np.int64)
    out_q, out_c, out_s = [], [], []
    for row, (q, terms) in enumerate(zip(query_ids, weights)):
        scores[:] = 0
        for d in np.flatnonzero(terms):
            np.multiply(postings[d], terms[d], out=add)
            np.add(scores, add, out=scores)
        # One number per candidate: the score, then the smaller id.
        wide = scores if kind is object else scores.astype(np.int64)
        keys = wide * n + place if kind is not np.int64 else wide.astype(object) * n + place
        mine = ids == q
        take = min(n, k + int(mine.sum()))
        best = np.argpartition(keys, n - take)[n - take :] if take < n else np.arange(n)
        best = best[np.argsort(-keys[best], kind="stable")]
        best = best[~mine[best]][:k]
        out_q += [row] * len(best)
        out_c += ids[best].tolist()
        out_s += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores[best]]
    return np.array(out_q, np.int64), np.array(out_c, np.int64), np.array(out_s, np.int64)


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, ident: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``ident`` and ``score`` of every query's best candidates.

    Components become floor(scale * x). Candidates with the query's own id are
    skipped; ties go to the smaller id. Rows with a null id, a null vector or a
    component that is null or not finite take no part. Missing trailing
    components count as zero. Repeated rows are candidates of their own, and
    queries of their own: each gives a list of ``k`` under its id. Scores
    beyond 64 bits are clamped. Other columns are not read; empty sides give an
    empty result.
    """
    queries = queries.select(F.col(ident).cast("long").alias("_id"), F.col(vector).alias("_v")).filter(usable("_v", "_id"))
    numbered = queries.withColumn("_n", F.monotonically_increasing_id())
    candidates = candidates.select(F.col(ident).cast("long").alias("_id"), F.col(vector).alias("_v")).filter(
        usable("_v", "_id")
    )
    q_blocks = -(-queries.count() // QUERY_BLOCK) or 1
    c_blocks = -(-candidates.count() // CANDIDATE_BLOCK) or 1

    def dealt(df: DataFrame, own: str, blocks: int, other: str, times: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("_id", F.lit(own)), F.lit(blocks)).cast("int").alias(own)
        return df.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    left = dealt(numbered, "_qb", q_blocks, "_cb", c_blocks)
    right = dealt(candidates, "_cb", c_blocks, "_qb", q_blocks)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        q = c = s = np.empty(0, np.int64)
        ids, numbers = a["_id"].to_numpy(), a["_n"].to_numpy()
        if a.num_rows and b.num_rows:
            q, c, s = block_top(
                ids, _matrix(a["_v"], scale), b["_id"].to_numpy(), _matrix(b["_v"], scale), k
            )
        return pa.table({"query_id": ids[q], "_n": numbers[q], ident: c, "score": s})

    found = left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(
        score, f"query_id long, _n long, {ident} long, score long"
    )
    order = Window.partitionBy("query_id", "_n").orderBy(F.desc("score"), ident)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", ident, "score")
