import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import baselines as B
from treatlens.operators import metrics as M


@pytest.fixture(scope="module")
def split(spark, toy):
    """Training without the rare treatment, evaluation over everything."""
    train = toy["cells"].where("perturbation_id <> 'rare_g3'")
    preds = B.expression_predictions(toy["expr"], train, toy["cells"], toy["genes"]).cache()
    pert, z = toy["pdf"]["perturbation_id"].to_numpy(), toy["z"]
    keep = pert != "rare_g3"
    names = sorted(set(pert[keep]))
    design = lambda p: np.column_stack([np.ones(len(p))] + [(p == k).astype(float) for k in names])
    coef = np.linalg.lstsq(design(pert[keep]), z[keep], rcond=None)[0]
    group = {k: z[pert == k].mean(0) for k in names}
    want = {
        "gene_level_mean": np.array([group.get(p, z[keep].mean(0)) for p in pert]),
        "control_mean": np.tile(z[pert == "ntc"].mean(0), (len(pert), 1)),
        "linear_regression": design(pert) @ coef,
    }
    return preds, want


def test_counts_that_carry_their_treatment_meet_no_cells(toy, split):
    """The same sums from tagged counts; ``cells`` without ids could not be joined."""
    own = toy["cells"].select("cell_id", "perturbation_id", "condition")
    tagged, names = toy["expr"].join(own, "cell_id").drop("cell_id"), B.EXPRESSION_BASELINES
    cells = own.drop("cell_id")
    preds = B.expression_predictions(
        tagged.where("perturbation_id <> 'rare_g3'"), cells.where("perturbation_id <> 'rare_g3'"), cells, toy["genes"]
    ).cache()

    def values(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    assert values(preds) == values(split[0])
    assert values(M.grouped_cells(tagged, cells, preds, names)) == values(M.grouped_cells(toy["expr"], toy["cells"], preds, names))
    got = [M.grouped_calibration_rows(e, c, preds, "gene_level_mean") for e, c in ((tagged, cells), (toy["expr"], toy["cells"]))]
    assert values(got[0]) == values(got[1])


def test_predictions_match_dense(toy, split):
    preds, want = split
    pert = toy["pdf"]["perturbation_id"].to_numpy()
    for r in preds.collect():
        i, j = np.flatnonzero(pert == r["perturbation_id"])[0], toy["gene_ids"].index(r["gene_id"])
        for name in B.EXPRESSION_BASELINES:
            assert np.isclose(r[name], want[name][i, j]), name
    row = B.unseen_summary(preds).first()
    assert (row["n_eval_treatments_seen"], row["n_eval_cells_unseen"]) == (3, 3)


def dense_scores(y, p):
    rs = [np.corrcoef(y[:, j], p[:, j])[0, 1] for j in range(y.shape[1]) if y[:, j].std() > 1e-8 and p[:, j].std() > 1e-8]
    return np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), np.mean(rs) if rs else 0.0


def test_scores_match_dense(toy, split):
    preds, want = split
    moments = M.grouped_moments(toy["expr"], toy["cells"], preds, B.EXPRESSION_BASELINES)
    for r in M.scores(moments).collect():
        got = (r["mae"], r["rmse"], r["pearson_mean_gene"])
        assert np.allclose(got, dense_scores(toy["z"], want[r["name"]])), r["name"]


def test_dense_path_gives_the_same_scores(spark, toy, split):
    preds, want = split
    n, g = toy["z"].shape
    p = want["linear_regression"]
    pairs = spark.createDataFrame(
        pd.DataFrame({"gene_id": np.tile(toy["gene_ids"], n), "y": toy["z"].ravel(), "p": p.ravel()})
    )
    moments = M.dense_moments(pairs).cache()
    r = M.scores(moments).first()
    assert np.allclose((r["mae"], r["rmse"], r["pearson_mean_gene"]), dense_scores(toy["z"], p))
    control = toy["z"][:40].mean(0)
    gap = np.abs(toy["z"].mean(0) - control)
    top = sorted(range(g), key=lambda j: (-gap[j], toy["gene_ids"][j]))[:4]
    ctl = spark.createDataFrame(pd.DataFrame({"gene_id": toy["gene_ids"], "control_mean": control}))
    got = M.pearson_top_degs(moments, ctl, 4).first()["pearson_top_1000_degs"]
    assert np.isclose(got, dense_scores(toy["z"][:, top], p[:, top])[2])


def dense_calibration(y, p, var, bins):
    e = np.abs(y - p).ravel()
    s = np.zeros_like(e) if var is None else np.sqrt(np.clip(var.ravel(), 1e-12, None))
    if bins <= 1:
        return np.abs(s - e).mean()
    edges = np.quantile(s, np.linspace(0, 1, bins + 1))
    if edges.max() - edges.min() <= 1e-12:
        return np.abs(s - e).mean()
    total = 0.0
    for k in range(bins):
        m = (s >= edges[k]) & ((s <= edges[k + 1]) if k == bins - 1 else (s < edges[k + 1]))
        if m.any():
            total += m.mean() * abs(s[m].mean() - e[m].mean())
    return total


@pytest.mark.parametrize("bins,kind", [(10, "varied"), (1, "varied"), (10, "flat"), (10, "none")])
def test_calibration(spark, bins, kind):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(60, 4))
    p = y + rng.normal(0, 0.3, y.shape)
    var = {"varied": rng.random(y.shape).round(1), "flat": np.full(y.shape, 0.04), "none": None}[kind]
    pdf = pd.DataFrame({"y": y.ravel(), "p": p.ravel()})
    pdf["var"] = np.nan if var is None else var.ravel()
    rows = M.calibration_rows(spark.createDataFrame(pdf))
    assert np.isclose(M.calibration_error(rows, bins).first()[0], dense_calibration(y, p, var, bins))


def test_grouped_calibration_equals_dense(toy, split):
    preds, want = split
    pert = toy["pdf"]["perturbation_id"].to_numpy()
    var = np.array([toy["z"][pert == p].var(0) if p != "rare_g3" else np.zeros(12) for p in pert])
    for bins in (10, 1):
        rows = M.grouped_calibration_rows(toy["expr"], toy["cells"], preds, "gene_level_mean")
        got = M.calibration_error(rows, bins).first()[0]
        assert np.isclose(got, dense_calibration(toy["z"], want["gene_level_mean"], var, bins))


def metric_row(spark, mae, pearson, calib):
    return spark.createDataFrame(
        [(mae, pearson, calib)], "mae double, pearson_top_1000_degs double, calibration_error double"
    )


def suite_rows(spark):
    rows = [("control_mean", "expression", "mae", 0.5), ("control_mean", "expression", "pearson_mean_gene", 0.0),
            ("gene_level_mean", "expression", "mae", 0.3), ("gene_level_mean", "expression", "pearson_mean_gene", 0.4),
            ("random_edge_grn", "grn", "edge_count_random", 9.0)]
    return spark.createDataFrame(rows, S.SUITE)


def test_comparison_rules_and_deltas(spark):
    model = metric_row(spark, 0.4, 0.5, 0.1)
    comparison = M.baseline_comparison(suite_rows(spark), model).cache()
    rows = comparison.collect()
    assert [(r["baseline_name"], r["model_beats_baseline_mae"]) for r in rows] == [("gene_level_mean", False), ("control_mean", True)]
    codes = [r["code"] for r in M.failure_modes(model, comparison).collect()]
    assert codes == ["baseline_underperformance"]
    worst = [(r["code"], r["severity"]) for r in M.failure_modes(metric_row(spark, 1.5, 0.0, 0.9), comparison).collect()]
    assert [c for c, _ in worst] == ["high_mae", "low_deg_pearson", "poor_calibration", "baseline_underperformance"]
    assert worst[0][1] == "critical"
    good = M.baseline_comparison(suite_rows(spark), metric_row(spark, 0.1, 0.5, 0.1))
    assert [r["code"] for r in M.failure_modes(metric_row(spark, 0.1, 0.5, 0.1), good).collect()] == ["no_failure_modes_detected"]
    d = M.report_deltas(comparison).first()
    assert np.isclose(d["delta_mae_vs_control_mean"], -0.1) and d["beats_control_mean"]
    assert d["delta_mae_vs_linear_regression"] is None and not d["beats_linear_regression"]


def test_gates(spark):
    wins = spark.createDataFrame(
        [("s1", "control_mean", True), ("s1", "gene_level_mean", True), ("s2", "control_mean", True), ("s2", "gene_level_mean", False)],
        "stage string, baseline_name string, won boolean",
    )
    recovery = spark.createDataFrame([(0.9, 0.4)], "auc double, f1 double")
    passed = lambda *a: {r["gate"]: r["passed"] for r in M.quality_gates(*a).collect()}
    assert passed(wins, recovery, ["s1"]) == {"baseline_dominance": True, "graph_recovery": True, "all": True}
    assert passed(wins, recovery, ["s1", "s2"]) == {"baseline_dominance": False, "graph_recovery": True, "all": False}
    assert passed(wins, None, ["s1"])["graph_recovery"] is False
    assert passed(wins, recovery, ["s3"])["baseline_dominance"] is False


def test_baseline_gate_names_the_missing(spark):
    missing = B.require_baselines(suite_rows(spark), S.BASELINE_NAMES)
    assert [r[0] for r in missing.collect()] == ["linear_regression"]


def test_nll(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.25), (2.0, 2.0, 1.0)], "y double, p double, var double")
    r = M.gaussian_nll(df).first()
    assert np.isclose(r["nll"], 0.5 * np.mean([1.0 + np.log(0.25), 0.0])) and np.isclose(r["mse"], 0.125)


def test_no_control_falls_back_to_all(spark, toy):
    cells = toy["cells"].withColumn("condition", F.lit("x")).withColumn("perturbation_id", F.concat(F.lit("q_"), "perturbation_id"))
    preds = B.expression_predictions(toy["expr"], cells, cells, toy["genes"])
    got = {r["gene_id"]: r["control_mean"] for r in preds.collect()}
    assert np.allclose([got[g] for g in toy["gene_ids"]], toy["z"].mean(0))
