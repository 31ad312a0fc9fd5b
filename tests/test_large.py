"""What keeps large tables within the driver's and a task's memory."""

import tracemalloc
import types

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from treatlens import session
from treatlens.operators import ivgraph as I
from treatlens.operators import transport as T
from treatlens.operators.gram import BLOCK, matrix_from, moment_blocks
from treatlens.operators.layout import to_sparse
from treatlens.plans import queries_models, queries_qc, queries_tables, views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _profiles(spark, toy):
    feats = spark.createDataFrame([(g, i) for i, g in enumerate(toy["gene_ids"])], "gene_id string, idx int")
    return to_sparse(toy["expr"], feats, "z", toy["cells"].select("cell_id"))


def test_vectors_of_all_cells_are_not_broadcast(spark, toy):
    vec = toy["cells"].select("cell_id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    rows, _ = T.transport_pairs(_profiles(spark, toy), toy["cells"], 12, "identity", vec, vec)
    last = plan_of(rows).split("Scan")[0]
    assert last.count("SortMergeJoin") >= 2
    assert "BroadcastHashJoin" not in last.split("SortMergeJoin")[0]


def test_vectors_of_treatments_give_the_same_pairs(spark, toy):
    by_treatment = (
        toy["cells"].select("perturbation_id").distinct()
        .withColumn("v", F.array(F.length("perturbation_id").cast("double"), F.lit(1.0)))
    )
    by_cell = toy["cells"].join(by_treatment, "perturbation_id").select("cell_id", "v")
    sparse = _profiles(spark, toy)
    found = []
    for vectors in (by_cell, by_treatment):
        rows, source = T.transport_pairs(sparse, toy["cells"], 12, "control_mean", vectors)
        got = {r["cell_id"]: (r["w"], sorted(zip(r["idx"], r["val"]))) for r in rows.collect()}
        found.append((got, source))
    assert found[0] == found[1] and len(found[0][0]) == 90


def test_draw_weights_make_one_digest_each():
    text = str(I.draw_weights(F.col("cell_id"), 3, 7))
    assert text.count("md5") == 1
    assert "md5" not in text[: text.index("filter")] or text.index("md5") < text.index("filter")


def test_products_of_used_columns(spark):
    """Dense covariates over two tiles, keys out of order, an empty column and weights."""
    rng = np.random.default_rng(5)
    n, n_w, n_y, draws = 50, 70, 9, 2
    w = rng.normal(size=(n, n_w))
    w[:, 3] = 0.0
    y = rng.poisson(0.7, (n, n_y)).astype(float)
    y[:, 4] = 0.0
    weights, key = rng.integers(0, 3, (n, draws)).astype(float), rng.integers(0, 4, n).astype(str)
    frame = pd.DataFrame({
        "w": list(w), "idx": [np.flatnonzero(r).tolist() for r in y], "val": [r[r != 0].tolist() for r in y],
        "key": key, "weights": list(weights),
    })
    rows = spark.createDataFrame(frame, "w array<double>, idx array<int>, val array<double>, key string, weights array<double>")
    blocks = moment_blocks(rows, n_w, n_y, draws, by_key=True, aligned=True).toPandas()
    y_at = 2 * BLOCK
    x = np.zeros((n, y_at + n_y))
    x[:, 0], x[:, 1 : 1 + n_w], x[:, y_at:] = 1.0, w, y
    for d in range(draws + 1):
        own = weights[:, d - 1] if d else np.ones(n)
        got = matrix_from(blocks[blocks["draw"] == d], "G", y_at + n_y)
        np.testing.assert_allclose(got, x.T @ (x * own[:, None]), atol=1e-9)
        sums = blocks[(blocks["draw"] == d) & (blocks["kind"] == "S")]
        for k in np.unique(key):
            found = np.zeros(3 * BLOCK)
            for jb, vals in zip(sums[sums["key"] == k]["jb"], sums[sums["key"] == k]["vals"]):
                found[jb * BLOCK : (jb + 1) * BLOCK] = vals
            np.testing.assert_allclose(found[: y_at + n_y], (x * own[:, None])[key == k].sum(0), atol=1e-9)


def test_counts_are_dealt_by_rows_not_by_bytes(spark, monkeypatch):
    """Parts follow the number of lines, and grouping by cell needs no further shuffle."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    folder = "/root/testdata/sf0.001"
    lines = views.table(spark, folder, "lineitem").count()
    expr = views.expr(spark, folder)
    assert expr.rdd.getNumPartitions() >= lines // 500 > 4
    grouped = expr.groupBy("cell_id").agg(F.sum("count").alias("n"))
    assert plan_of(grouped).count("Exchange hashpartitioning") == 1
    assert grouped.count() == views.table(spark, folder, "lineitem").select("l_orderkey").distinct().count()


def test_fill_ids_deals_large_keys_to_more_files(spark, monkeypatch):
    monkeypatch.setattr(queries_tables, "FILE_KEYS", 20_000)
    made = []
    monkeypatch.setattr(queries_tables, "scratch_path", lambda s, n: made.append(session.scratch_path(s, n)) or made[-1])
    spark.range(100_001, 160_001).select(F.col("id").alias("o_orderkey"), F.col("id").cast("double").alias("o_totalprice")).createOrReplaceTempView("large_orders")
    monkeypatch.setattr(queries_tables.V, "table", lambda s, folder, name: s.table("large_orders"))
    rows = queries_tables.fill(spark, "").orderBy("cell_id").collect()
    assert [int(r["o_totalprice"]) for r in rows] == list(range(100_001, 160_001))
    sizes = spark.read.parquet(made[0]).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 20_000


def test_names_of_proxies_are_broadcast(spark, monkeypatch):
    """A column of many cells is never one task's, with few batches or with many."""
    opened = spark.range(300).select(F.col("id").alias("cell_id"), (F.col("id") % 30).cast("int").alias("i"), F.lit(1.0).alias("v"))
    names = spark.range(30).select(
        F.col("id").cast("int").alias("i"),
        F.when(F.col("id") < 3, F.concat(F.lit("protocol="), "id")).otherwise(F.concat(F.lit("batch="), "id")).alias("name"),
    )
    monkeypatch.setattr(queries_qc, "broadcast_if_small", lambda df: session.broadcast_if_small(df, 20))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = queries_qc.with_names(opened, names.where("i < 10"))
        many = queries_qc.with_names(opened, names)
        assert "SortMergeJoin" not in plan_of(few) and "BroadcastHashJoin" in plan_of(few)
        assert plan_of(many).count("BroadcastHashJoin") == 2
        assert few.count() == 100 and many.count() == 300
        found = {(r["i"], r["name"]) for r in many.collect()}
        assert found == {(r["i"], r["name"]) for r in names.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_rows_hold_every_cell_and_gene(spark, toy):
    data = types.SimpleNamespace(expr=toy["expr"].select("cell_id", "gene_id", "z"), cells=toy["cells"])
    preds = toy["cells"].select("perturbation_id").distinct().crossJoin(toy["genes"]).withColumn("p", F.lit(0.5))
    done = queries_models._dense(data, preds)
    got = {(r["cell_id"], r["gene_id"]): r["y"] for r in done.collect()}
    assert len(got) == 90 * 12
    for a, cell in enumerate(toy["ids"]):
        for b, gene in enumerate(toy["gene_ids"]):
            assert abs(got[cell, gene] - toy["z"][a, b]) < 1e-12


class Taken(Exception):
    """Carries the function that a frame was to be mapped with."""


class Rows:
    """A frame that hands out what a task would run, so that its memory can be read here."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        raise Taken(run)


def held(run, n):
    """Bytes at most of NumPy and of Arrow while a task runs over ``n`` batches of 2,000 rows."""
    rng, arrow, base = np.random.default_rng(1), [0], pa.total_allocated_bytes()

    def batches():
        for _ in range(n):
            lists = pa.array(np.arange(0, 8001, 4, dtype=np.int32))
            idx = pa.ListArray.from_arrays(lists, pa.array(rng.permuted(np.tile(np.arange(25, dtype=np.int32), (2000, 1)), axis=1)[:, :4].ravel()))
            val = pa.ListArray.from_arrays(lists, pa.array(rng.random(8000)))
            w = pa.ListArray.from_arrays(pa.array(np.arange(2001, dtype=np.int32)), pa.array(rng.random(2000)))
            yield pa.RecordBatch.from_arrays([w, idx, val], names=["w", "idx", "val"])
            arrow[0] = max(arrow[0], pa.total_allocated_bytes() - base)

    tracemalloc.start()
    for _ in run(batches()):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return np.array([peak, arrow[0]])


def test_python_of_products_and_scores_does_not_grow_with_the_rows():
    model = T.LinearTransport(np.ones((2, 25)), np.zeros(25), np.ones(25), 1)
    for made in (
        lambda: T.model_moments(Rows(), model, None),
        lambda: moment_blocks(Rows(), 1, 25, aligned=True, between=False),
        lambda: moment_blocks(Rows(), 0, 25),
    ):
        try:
            made()
        except Taken as taken:
            run = taken.args[0]
        held(run, 2)
        few, many = held(run, 40), held(run, 400)
        assert (many < 1.2 * few + 1_000_000).all(), (few, many)
