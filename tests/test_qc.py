import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treatlens.operators import layout, qc


def literal(spark):
    counts = [("a", "x", 2), ("a", "z", 1), ("b", "x", 1), ("b", "y", 1), ("c", "y", 3), ("c", "z", 1)]
    expr = spark.createDataFrame(counts, "cell_id string, gene_id string, count bigint")
    cells = spark.createDataFrame(
        [("a", "ntc", "control"), ("b", "p1", "perturbed"), ("c", "p1", "perturbed"), ("empty", "p1", "perturbed")],
        "cell_id string, perturbation_id string, condition string",
    )
    return cells, expr


def test_totals_and_filters(spark):
    cells, expr = literal(spark)
    assert {r[0]: r[1] for r in qc.library_size(expr, cells).collect()} == {"a": 3, "b": 2, "c": 4, "empty": 0}
    assert {r[0]: r[1] for r in qc.features_detected(expr, cells).collect()} == {"a": 2, "b": 2, "c": 2, "empty": 0}
    assert {r["cell_id"] for r in qc.qc_cells(cells, expr, 3, 2).collect()} == {"a", "c"}
    assert {r["cell_id"] for r in qc.qc_cells(cells, expr, 0, 0).collect()} == {"a", "b", "c", "empty"}
    assert {r["gene_id"]: r["n_cells"] for r in qc.qc_genes(expr, 2).collect()} == {"x": 2, "y": 2, "z": 2}


def test_normalise_and_variance(spark, toy):
    z = qc.normalise_log1p(toy["expr"].drop("z"))
    got = z.join(toy["expr"].select("cell_id", "gene_id", F.col("z").alias("w")), ["cell_id", "gene_id"])
    assert got.agg(F.max(F.abs(F.col("z") - F.col("w")))).first()[0] < 1e-12
    var = {r[0]: r[1] for r in qc.feature_variance(toy["expr"], 90).collect()}
    want = toy["z"].var(axis=0)
    for j, g in enumerate(toy["gene_ids"]):
        assert np.isclose(var.get(g, 0.0), want[j])


def test_top_features_break_ties_by_id(spark):
    var = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 5.0), ("d", 1.0)], "gene_id string, variance double")
    got = [(r["gene_id"], r["rank"]) for r in qc.select_top_features(var, 3).orderBy("rank").collect()]
    assert got == [("c", 1), ("a", 2), ("b", 3)]


def test_settings_are_checked():
    for bad in ({"target_sum": 0}, {"n_features": 10}, {"min_cells": 0}, {"min_counts": -1}, {"n_features_low": 9000}):
        with pytest.raises(ValueError):
            qc.QcSettings(**bad)


def test_preprocess_against_dense(spark, toy):
    cfg = qc.QcSettings(min_counts=8, min_genes=4, min_cells=10, n_features=6, n_features_low=1)
    done = qc.preprocess(toy["cells"], toy["expr"].drop("z"), cfg)
    c = toy["counts"]
    keep = (c.sum(1) >= 8) & ((c > 0).sum(1) >= 4)
    genes = np.flatnonzero((c[keep] > 0).sum(0) >= 10)
    d = c[keep][:, genes]
    z = np.log1p(d / np.maximum(d.sum(1, keepdims=True), 1) * 1e4)
    order = sorted(range(len(genes)), key=lambda k: (-z.var(0)[k], toy["gene_ids"][genes[k]]))[:6]
    got = [r["gene_id"] for r in done.features.orderBy("rank").collect()]
    assert got == [toy["gene_ids"][genes[k]] for k in order]
    lib = {r["cell_id"]: r["library_size"] for r in done.cells.collect()}
    want = dict(zip(np.array(toy["ids"])[keep], d[:, order].sum(1)))
    assert lib == {k: float(v) for k, v in want.items()}
    row = done.summary.first()
    assert (row["n_cells_after_qc"], row["removed_cells"], row["fallback_used"]) == (keep.sum(), 90 - keep.sum(), False)
    vec = {r["cell_id"]: r["v"] for r in done.vectors().collect()}
    assert np.allclose(np.array([vec[i] for i in np.array(toy["ids"])[keep]]), z[:, order])
    names = [r["name"] for r in done.proxy_names.orderBy("i").collect()]
    assert names[:2] == ["library_size_z", "knockdown_efficiency_proxy_z"]
    assert names[2:] == ["batch=b0", "batch=b1", "batch=b2", "protocol=p0", "protocol=p1"]


def test_preprocess_fallback_and_empty(spark, toy):
    cfg = qc.QcSettings(min_counts=1, min_genes=1, min_cells=1)
    row = qc.preprocess(toy["cells"], toy["expr"], cfg).summary.first()
    assert row["fallback_used"] and row["n_features_selected"] == 11
    with pytest.raises(ValueError):
        qc.preprocess(toy["cells"], toy["expr"], qc.QcSettings(min_counts=10**6))


def test_treatment_shift_against_dense(spark, toy):
    got = {(r[0], r[1]): r["shift"] for r in qc.treatment_shift(toy["expr"], toy["cells"]).collect()}
    pert, z = toy["pdf"]["perturbation_id"].to_numpy(), toy["z"]
    control = z[pert == "ntc"].mean(0)
    for p in set(pert):
        for j, g in enumerate(toy["gene_ids"]):
            if g != "g05":
                assert np.isclose(got[(p, g)], z[pert == p].mean(0)[j] - control[j])


def test_treatment_shift_needs_controls(toy):
    treated = toy["cells"].withColumn("perturbation_id", F.lit("p1")).drop("condition")
    with pytest.raises(Exception, match="no control cells"):
        qc.treatment_shift(toy["expr"], treated).collect()


def test_same_result_for_any_partitioning(spark, toy):
    def run(n):
        shifted = qc.treatment_shift(toy["expr"].repartition(n), toy["cells"].repartition(n))
        return sorted((r[0], r[1], round(r["shift"], 9)) for r in shifted.collect())

    assert run(2) == run(8)
    pick = lambda n: {r[0] for r in layout.sample_cap(toy["cells"].repartition(n), 20, 7).collect()}
    assert pick(2) == pick(8) and len(pick(3)) == 20


def test_large_samples_take_the_same_rows(toy, monkeypatch):
    small = {r[0] for r in layout.sample_cap(toy["cells"], 33, 7).collect()}
    monkeypatch.setattr(layout, "SMALL_SAMPLE", 5)
    assert {r[0] for r in layout.sample_cap(toy["cells"], 33, 7).collect()} == small


def test_domains_of_any_size_are_tables(spark, toy):
    assert [tuple(r) for r in qc.domain(toy["cells"], "batch").orderBy("code").collect()] == [("b0", 0), ("b1", 1), ("b2", 2)]
    wide = spark.range(6000).select(
        F.col("id").alias("cell_id"), F.col("id").cast("double").alias("library_size"), F.lit(0.5).alias("knockdown_efficiency_proxy"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.format_string("b%05d", "id")).alias("batch"), F.lit("p").alias("protocol"),
    )
    sparse, names = qc.sparse_proxies(wide)
    assert names.count() == names.select("name").distinct().count() == 2 + 5142 + 1 + 1
    first = sparse.where("cell_id = 1").first()
    named = {r["i"]: r["name"] for r in names.where(F.col("i").isin(first["widx"])).collect()}
    assert [named[i] for i in first["widx"]] == ["library_size_z", "knockdown_efficiency_proxy_z", "batch=b00001", "protocol=p"]
    assert first["wval"][2:] == [1.0, 1.0]
    dense, _ = qc.proxy_matrix(toy["cells"])
    row = dense.where("cell_id = 'c001'").first()
    assert row["proxies"][2:] == [0.0, 1.0, 0.0, 0.0, 1.0] and "widx" not in dense.columns


def test_caps_and_layers(spark, toy):
    assert layout.resolve_cap(None, None) == (None, False)
    assert layout.resolve_cap(9000, 5000) == (5000, True)
    assert layout.resolve_cap(None, 5000) == (5000, False)
    with pytest.raises(ValueError):
        layout.resolve_cap(0, None)
    with pytest.raises(ValueError):
        layout.pick_layer(toy["expr"], "missing")
    mask = toy["cells"].where("batch = 'nope'")
    with pytest.raises(ValueError):
        layout.restrict(toy["expr"], mask)


def test_wide_to_long_and_back(spark):
    wide = spark.createDataFrame(
        pd.DataFrame({"cell_id": ["a", "b"], "g.1": ["2", "x"], "g2": ["0", "3.5"]})
    )
    long = layout.to_long(wide, ["cell_id"], ["g.1", "g2"])
    assert sorted(tuple(r) for r in long.collect()) == [("a", "g.1", 2), ("b", "g2", 4)]
    vec = layout.to_vectors(long, ["g.1", "g2"], "count")
    assert {r[0]: r[1] for r in vec.collect()} == {"a": [2.0, 0.0], "b": [0.0, 4.0]}
