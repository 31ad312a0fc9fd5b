"""Scores of predictions against sparse truth, calibration, comparison and rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treatlens.operators.ordering import weighted_quantiles
from treatlens.operators.qc import with_treatments
from treatlens.session import cut_lineage

FLAT = 1e-8

# Severity, metric and message of each failure code.
FAILURE_TEXTS = {
    "high_mae": ("critical", "mae", "Model MAE exceeds configured failure threshold."),
    "low_deg_pearson": (
        "warning",
        "pearson_top_1000_degs",
        "DEG-focused Pearson is below configured threshold.",
    ),
    "poor_calibration": (
        "warning",
        "calibration_error",
        "Calibration error exceeds configured threshold.",
    ),
    "baseline_underperformance": (
        "warning",
        "delta_mae_model_minus_baseline",
        "Model does not beat one or more baseline MAE values. Non-improved baselines: ",
    ),
    "no_failure_modes_detected": ("info", "n_failures", "No configured failure mode was triggered."),
}


def grouped_cells(
    expr: DataFrame, cells: DataFrame, predictions: DataFrame, names: Sequence[str], value: str = "z"
) -> DataFrame:
    """Truth moments and absolute error of each (treatment, gene), zeros included.

    ``predictions`` has one row per (perturbation_id, gene_id) with ``n_eval``
    and one column per name. A cell without an entry for a gene has the value
    0 there, so it adds ``abs(prediction)``; no dense table is built.
    """
    rows = with_treatments(expr, cells).select("perturbation_id", "gene_id", F.col(value).cast("double").alias("_y"))
    preds = predictions.select("perturbation_id", "gene_id", *names)
    errors = [F.sum(F.abs(F.col("_y") - F.col(n))).alias(f"_abs_{n}") for n in names]
    present = (
        rows.join(preds, ["perturbation_id", "gene_id"])
        .groupBy("perturbation_id", "gene_id")
        .agg(F.count("_y").alias("_n"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v"), *errors)
    )
    full = predictions.join(present, ["perturbation_id", "gene_id"], "left").na.fill(
        0, ["_n", "_m", "_v", *[f"_abs_{n}" for n in names]]
    )
    size, n = F.col("n_eval").cast("double"), F.col("_n")
    missing = size - n
    return full.select(
        "perturbation_id",
        "gene_id",
        size.alias("n_eval"),
        (n * F.col("_m") / size).alias("y_mean"),
        # Sum of squares around the mean of all n_eval values.
        (n * F.col("_v") + F.col("_m") * F.col("_m") * n * missing / size).alias("y_m2"),
        *[F.col(name) for name in names],
        *[(F.col(f"_abs_{name}") + missing * F.abs(F.col(name))).alias(f"abs_{name}") for name in names],
    )


def grouped_moments(
    expr: DataFrame, cells: DataFrame, predictions: DataFrame, names: Sequence[str], value: str = "z"
) -> DataFrame:
    """Per (name, gene) sums needed by every score; see :func:`moments_of`."""
    dense = cut_lineage(grouped_cells(expr, cells, predictions, names, value), "eval-groups")
    return moments_of(dense, names)


def moments_of(dense: DataFrame, names: Sequence[str]) -> DataFrame:
    """Collapse (treatment, gene) rows to one row per (name, gene).

    Squares are summed around the mean, so a constant column has spread
    exactly 0 and the flatness rule stays reliable.
    """
    long = dense.select(
        "gene_id",
        "n_eval",
        "y_mean",
        "y_m2",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("name"), F.col(n).alias("p"), F.col(f"abs_{n}").alias("abs")
                    )
                    for n in names
                ]
            )
        ).alias("_b"),
    ).select("gene_id", "n_eval", "y_mean", "y_m2", "_b.name", "_b.p", "_b.abs")
    # One row per treatment in each window group.
    gene = Window.partitionBy("name", "gene_id")
    total = F.sum("n_eval").over(gene)
    centred = long.select(
        "*",
        (F.sum(F.col("n_eval") * F.col("y_mean")).over(gene) / total).alias("_my"),
        F.when(F.max("p").over(gene) == F.min("p").over(gene), F.max("p").over(gene))
        .otherwise(F.sum(F.col("n_eval") * F.col("p")).over(gene) / total)
        .alias("_mp"),
    )
    n, dy, dp = F.col("n_eval"), F.col("y_mean") - F.col("_my"), F.col("p") - F.col("_mp")
    return centred.groupBy("name", "gene_id").agg(
        F.sum(n).alias("n"),
        F.first("_my").alias("mean_y"),
        F.sum(F.col("y_m2") + n * dy * dy).alias("m2_y"),
        F.sum(n * dp * dp).alias("m2_p"),
        F.sum(n * dy * dp).alias("c_yp"),
        F.sum("abs").alias("abs_sum"),
        F.sum(F.col("y_m2") + n * (F.col("y_mean") - F.col("p")) * (F.col("y_mean") - F.col("p"))).alias("sq_sum"),
    )


def dense_moments(pairs: DataFrame, name: str = "model") -> DataFrame:
    """The same per-gene sums from rows (gene_id, y, p), one per cell and gene."""
    e = F.col("y") - F.col("p")
    agg = pairs.groupBy("gene_id").agg(
        F.count("y").cast("double").alias("n"),
        F.avg("y").alias("mean_y"),
        F.var_pop("y").alias("vy"),
        F.var_pop("p").alias("vp"),
        F.covar_pop("y", "p").alias("cyp"),
        F.sum(F.abs(e)).alias("abs_sum"),
        F.sum(e * e).alias("sq_sum"),
    )
    return agg.select(
        F.lit(name).alias("name"),
        "gene_id",
        "n",
        "mean_y",
        (F.col("vy") * F.col("n")).alias("m2_y"),
        (F.col("vp") * F.col("n")).alias("m2_p"),
        (F.col("cyp") * F.col("n")).alias("c_yp"),
        "abs_sum",
        "sq_sum",
    )


def gene_pearson(moments: DataFrame) -> DataFrame:
    """Correlation per (name, gene); genes flat on either side are left out."""
    sd_y, sd_p = F.sqrt(F.col("m2_y") / F.col("n")), F.sqrt(F.col("m2_p") / F.col("n"))
    return moments.where((sd_y > FLAT) & (sd_p > FLAT)).select(
        "name", "gene_id", (F.col("c_yp") / F.sqrt(F.col("m2_y") * F.col("m2_p"))).alias("pearson")
    )


def scores(moments: DataFrame) -> DataFrame:
    """(name, mae, rmse, pearson_mean_gene)."""
    sd_y, sd_p = F.sqrt(F.col("m2_y") / F.col("n")), F.sqrt(F.col("m2_p") / F.col("n"))
    usable = (sd_y > FLAT) & (sd_p > FLAT)
    pearson = F.when(usable, F.try_divide(F.col("c_yp"), F.sqrt(F.col("m2_y") * F.col("m2_p"))))
    return moments.groupBy("name").agg(
        (F.sum("abs_sum") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("sq_sum") / F.sum("n")).alias("rmse"),
        F.coalesce(F.avg(pearson), F.lit(0.0)).alias("pearson_mean_gene"),
    )


def suite_rows(moments: DataFrame) -> DataFrame:
    """Scores as rows (baseline, task, metric, value)."""
    return scores(moments).unpivot(
        [F.col("name")], ["mae", "rmse", "pearson_mean_gene"], "metric", "value"
    ).select(F.col("name").alias("baseline"), F.lit("expression").alias("task"), "metric", "value")


def top_degs(mean_true: DataFrame, control: DataFrame, k: int = 1000) -> DataFrame:
    """Genes whose evaluated mean is furthest from the control mean, ties by id.

    ``mean_true`` is (gene_id, mean_y), ``control`` is (gene_id, control_mean);
    a gene without a control entry has control mean 0.
    """
    return (
        mean_true.join(control, "gene_id", "left")
        .select(
            "gene_id", F.abs(F.col("mean_y") - F.coalesce("control_mean", F.lit(0.0))).alias("score")
        )
        .orderBy(F.desc("score"), F.asc("gene_id"))
        .limit(k)
    )


def pearson_top_degs(moments: DataFrame, control: DataFrame, k: int = 1000) -> DataFrame:
    """(name, pearson_top_1000_degs): mean correlation over the top genes, 0 if none is usable."""
    truth = moments.groupBy("gene_id").agg(F.first("mean_y").alias("mean_y"))
    top = top_degs(truth, control, k).select("gene_id")
    per_gene = gene_pearson(moments.join(top, "gene_id", "left_semi"))
    means = per_gene.groupBy("name").agg(F.avg("pearson").alias("p"))
    return moments.select("name").distinct().join(means, "name", "left").select(
        "name", F.coalesce("p", F.lit(0.0)).alias("pearson_top_1000_degs")
    )


def predicted_std(var: Column) -> Column:
    """Spread that goes with a predicted variance; 0 when none was predicted."""
    return F.when(var.isNull() | F.isnan(var), F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(1e-12))))


def calibration_rows(pairs: DataFrame) -> DataFrame:
    """Rows (y, p, var) combined by their spread: (std, weight, abs_sum, gap_sum)."""
    e = F.abs(F.col("y") - F.col("p"))
    tagged = pairs.select(predicted_std(F.col("var").cast("double")).alias("std"), e.alias("e"))
    return tagged.groupBy("std").agg(
        F.count(F.lit(1)).alias("weight"),
        F.sum("e").alias("abs_sum"),
        F.sum(F.abs(F.col("std") - F.col("e"))).alias("gap_sum"),
    )


def grouped_calibration_rows(
    expr: DataFrame, cells: DataFrame, predictions: DataFrame, name: str, value: str = "z"
) -> DataFrame:
    """The same rows for a prediction that is constant per (treatment, gene).

    ``predictions`` carries ``n_eval``, ``var`` and the named prediction. Cells
    without an entry have the true value 0 and are added by count.
    """
    std = predicted_std(F.col("var").cast("double"))
    preds = predictions.select(
        "perturbation_id", "gene_id", F.col("n_eval").cast("double").alias("n_eval"), F.col(name).alias("p"),
        std.alias("std"),
    )
    e = F.abs(F.col("_y") - F.col("p"))
    present = (
        with_treatments(expr, cells)
        .select("perturbation_id", "gene_id", F.col(value).cast("double").alias("_y"))
        .join(preds, ["perturbation_id", "gene_id"])
        .groupBy("perturbation_id", "gene_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(e).alias("_a"),
            F.sum(F.abs(F.col("std") - e)).alias("_g"),
        )
    )
    full = preds.join(present, ["perturbation_id", "gene_id"], "left").na.fill(0, ["_n", "_a", "_g"])
    missing = F.col("n_eval") - F.col("_n")
    return full.groupBy("std").agg(
        F.sum("n_eval").cast("bigint").alias("weight"),
        F.sum(F.col("_a") + missing * F.abs("p")).alias("abs_sum"),
        F.sum(F.col("_g") + missing * F.abs(F.col("std") - F.abs("p"))).alias("gap_sum"),
    )


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``calibration_error`` from the rows of :func:`calibration_rows`.

    Quantile bins of the predicted spread, half open except the last; the gap
    of each bin is weighted by its share. With one bin, or when all spreads are
    equal, it is the mean gap of the single predictions.
    """
    saved = cut_lineage(rows, "calibration")
    edges: list[float] = []
    if bins > 1:
        edges = weighted_quantiles(saved, "std", "weight", [i / bins for i in range(bins + 1)])
    if not edges or max(edges) - min(edges) <= 1e-12:
        return saved.agg(
            F.coalesce(F.sum("gap_sum") / F.sum("weight"), F.lit(0.0)).alias("calibration_error")
        )
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    per_bin = (
        saved.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("std"))))
        .groupBy("bin")
        .agg(
            F.sum("weight").alias("n"),
            F.sum(F.col("std") * F.col("weight")).alias("s"),
            F.sum("abs_sum").alias("a"),
        )
    )
    return per_bin.agg(
        F.coalesce(F.sum(F.abs(F.col("s") - F.col("a"))) / F.sum("n"), F.lit(0.0)).alias("calibration_error")
    )


def gaussian_nll(pairs: DataFrame) -> DataFrame:
    """One row with ``nll`` and ``mse`` from rows (y, p, var)."""
    e = F.col("y") - F.col("p")
    return pairs.agg(
        (0.5 * F.avg(e * e / F.col("var") + F.log(F.col("var")))).alias("nll"),
        F.avg(e * e).alias("mse"),
    )


def baseline_comparison(suite: DataFrame, model: DataFrame) -> DataFrame:
    """Model against each expression baseline, best baseline first.

    ``model`` is one row with mae and pearson_top_1000_degs, read as a scalar.
    """
    scored = (
        suite.where(F.col("task") == "expression")
        .groupBy(F.col("baseline").alias("baseline_name"))
        .agg(
            F.max(F.when(F.col("metric") == "mae", F.col("value"))).alias("baseline_mae"),
            F.max(F.when(F.col("metric") == "pearson_mean_gene", F.col("value"))).alias(
                "baseline_pearson_mean_gene"
            ),
        )
    )
    both = model.select(F.struct("mae", "pearson_top_1000_degs").alias("m")).scalar()
    finite = F.col("baseline_mae").isNotNull() & ~F.isnan("baseline_mae") & (
        F.abs("baseline_mae") != float("inf")
    )
    return (
        scored.withColumn("_m", both)
        .select(
            "baseline_name",
            "baseline_mae",
            F.col("_m.mae").alias("model_mae"),
            (F.col("_m.mae") - F.col("baseline_mae")).alias("delta_mae_model_minus_baseline"),
            (finite & (F.col("_m.mae") < F.col("baseline_mae"))).alias("model_beats_baseline_mae"),
            "baseline_pearson_mean_gene",
            F.col("_m.pearson_top_1000_degs").alias("model_pearson_top_1000_degs"),
            (F.col("_m.pearson_top_1000_degs") - F.col("baseline_pearson_mean_gene")).alias(
                "delta_pearson_model_minus_baseline"
            ),
        )
        .orderBy("baseline_mae", "baseline_name")
    )


@dataclass(frozen=True)
class FailureLimits:
    """Levels at which a report names a failure."""

    mae: float = 1.00
    pearson: float = 0.10
    calibration: float = 0.75


def failure_modes(
    metrics: DataFrame, comparison: DataFrame, limits: FailureLimits | None = None
) -> DataFrame:
    """Triggered rules as rows; one ``info`` row when none is triggered.

    ``metrics`` is one row with mae, pearson_top_1000_degs, calibration_error.
    """
    limits = limits or FailureLimits()
    lost = comparison.agg(F.count_if(~F.col("model_beats_baseline_mae")).alias("n")).scalar()

    n_lost = F.col("_lost")

    def rule(code: str, hit: Column, value: Column, threshold: float, suffix: Column | None = None) -> Column:
        severity, metric, message = FAILURE_TEXTS[code]
        row = F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            (F.lit(message) if suffix is None else F.concat(F.lit(message), suffix)).alias("message"),
        )
        return F.when(hit, row)

    mae, pearson, calibration = (F.col(c) for c in ("mae", "pearson_top_1000_degs", "calibration_error"))
    rules = [
        rule("high_mae", mae > limits.mae, mae, limits.mae),
        rule("low_deg_pearson", pearson < limits.pearson, pearson, limits.pearson),
        rule("poor_calibration", calibration > limits.calibration, calibration, limits.calibration),
        rule("baseline_underperformance", n_lost > 0, n_lost, 0, F.concat(n_lost.cast("string"), F.lit("."))),
    ]
    none = rule("no_failure_modes_detected", F.lit(True), F.lit(0), 0)
    hits = F.filter(F.array(*rules), lambda r: r.isNotNull())
    rows = F.when(F.size(hits) > 0, hits).otherwise(F.array(none))
    return metrics.withColumn("_lost", lost).select(F.explode(rows).alias("r")).select("r.*")


def report_deltas(
    comparison: DataFrame, names: Sequence[str] = ("control_mean", "gene_level_mean", "linear_regression")
) -> DataFrame:
    """One row with the MAE delta and the win flag of each named baseline (absent: no win)."""
    cols: list[Column] = []
    for name in names:
        here = F.col("baseline_name") == name
        cols.append(
            F.max(F.when(here, F.col("delta_mae_model_minus_baseline"))).alias(f"delta_mae_vs_{name}")
        )
        cols.append(
            F.coalesce(F.bool_or(F.when(here, F.col("model_beats_baseline_mae"))), F.lit(False)).alias(
                f"beats_{name}"
            )
        )
    return comparison.agg(*cols)


def quality_gates(
    stage_wins: DataFrame,
    recovery: DataFrame | None,
    stages: Sequence[str],
    wins: Sequence[str] = ("control_mean", "gene_level_mean"),
    min_auc: float = 0.55,
    min_f1: float = 0.05,
) -> DataFrame:
    """Rows (gate, passed, details), the last one being the conjunction.

    ``stage_wins`` is (stage, baseline_name, won); ``recovery`` is one row with
    auc and f1, or None when no truth was available.
    """
    spark = stage_wins.sparkSession
    needed = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage")
    ).select("stage", F.explode(F.array(*[F.lit(w) for w in wins])).alias("baseline_name"))
    present = stage_wins.groupBy("stage", "baseline_name").agg(F.bool_or("won").alias("won"))
    lost = needed.join(present.where("won"), ["stage", "baseline_name"], "left_anti")
    lost_names = lost.agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "stage", "baseline_name"))), ", ").alias("x")
    ).scalar()
    one = spark.range(1).withColumn("_lost", F.coalesce(lost_names, F.lit("")))
    base_ok = F.col("_lost") == ""
    if recovery is None:
        one = one.withColumn("_auc", F.lit(None).cast("double")).withColumn("_f1", F.lit(None).cast("double"))
    else:
        pair = recovery.select(F.struct("auc", "f1").alias("r")).scalar()
        one = one.withColumn("_r", pair).withColumn("_auc", F.col("_r.auc")).withColumn("_f1", F.col("_r.f1"))
    graph_ok = F.coalesce((F.col("_auc") >= min_auc) & (F.col("_f1") >= min_f1), F.lit(False))
    gates = F.array(
        F.struct(
            F.lit("baseline_dominance").alias("gate"),
            base_ok.alias("passed"),
            F.when(base_ok, F.lit("all required baselines are beaten"))
            .otherwise(F.concat(F.lit("missing wins: "), F.col("_lost")))
            .alias("details"),
        ),
        F.struct(
            F.lit("graph_recovery").alias("gate"),
            graph_ok.alias("passed"),
            F.when(F.col("_auc").isNull(), F.lit("no recovery scores"))
            .otherwise(
                F.format_string("auc=%.4f (min %.4f), f1=%.4f (min %.4f)", F.col("_auc"), F.lit(min_auc),
                                F.col("_f1"), F.lit(min_f1))
            )
            .alias("details"),
        ),
        F.struct(
            F.lit("all").alias("gate"), (base_ok & graph_ok).alias("passed"), F.lit("every gate").alias("details")
        ),
    )
    return one.select(F.explode(gates).alias("g")).select("g.*")
