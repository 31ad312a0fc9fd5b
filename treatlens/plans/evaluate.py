"""Evaluation of predictions: scores, baseline comparison, failure rules, report row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import metrics as M
from treatlens.session import cut_lineage


@dataclass(frozen=True)
class EvaluationSettings:
    """Parameters of an evaluation."""

    top_k: int = 1000
    bins: int = 10
    limits: M.FailureLimits = M.FailureLimits()
    model_name: str = "transport_model"
    model_version: str = "unknown"
    layer: str = "normalized_log1p"


@dataclass
class Evaluation:
    """Parts of an evaluation; all small."""

    metrics: DataFrame
    comparison: DataFrame
    failures: DataFrame
    report: DataFrame


def check_shapes(pairs: DataFrame, n_cells: int, n_features: int) -> None:
    """Error unless there is one finite prediction per evaluated cell and feature."""
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").isNull() | F.isnan("p")).alias("bad")
    ).first()
    if row["n"] != n_cells * n_features or row["bad"]:
        raise ValueError(
            f"expected {n_cells} x {n_features} predictions, got {row['n']} of which {row['bad']} are missing"
        )


def model_metrics(
    moments: DataFrame, calibration: DataFrame, control: DataFrame, cfg: EvaluationSettings
) -> DataFrame:
    """One row: mae, pearson_top_1000_degs, calibration_error, n_genes, n_eval_cells.

    ``moments`` has one row per gene and ``calibration`` one per predicted
    spread; ``control`` is (gene_id, control_mean) over the whole table. They
    come from dense predictions (:func:`from_pairs`), from group-constant ones
    or directly from a model.
    """
    saved = cut_lineage(moments, "moments")
    error = M.calibration_error(calibration, cfg.bins)
    return cut_lineage(
        M.scores(saved).select(
            "mae",
            M.pearson_top_degs(saved, control, cfg.top_k)
            .select("pearson_top_1000_degs")
            .scalar()
            .alias("pearson_top_1000_degs"),
            error.scalar().alias("calibration_error"),
            saved.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_genes"),
            saved.agg(F.max("n").cast("bigint").alias("n")).scalar().alias("n_eval_cells"),
        ),
        "metrics",
    )


def from_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments and calibration rows of (gene_id, y, p, var), one row per cell and gene."""
    return M.dense_moments(pairs), M.calibration_rows(pairs)


def evaluate_masks(
    pairs: DataFrame, assignment: DataFrame, control: DataFrame, cfg: EvaluationSettings | None = None
) -> DataFrame:
    """Scores per shift type and part: mae, rmse, pearson_mean_gene, pearson_top_1000_degs, n_genes, n_eval_cells.

    ``pairs`` is (cell_id, gene_id, y, p), one row per cell and gene;
    ``assignment`` is (cell_id, shift_type, part), one part per cell and shift
    type. A cell's masks are a short list that rides on its rows, so all splits
    come from one pass whose sums are combined before the shuffle. Reading the
    result is an error if a mask lacks a prediction of a cell and gene, or if one
    is missing.
    """
    cfg = cfg or EvaluationSettings()
    mask = F.struct("shift_type", "part")
    masks = assignment.groupBy("cell_id").agg(F.collect_set(mask).alias("masks"))
    e = F.col("y") - F.col("p")
    sums = cut_lineage(
        pairs.select("cell_id", "gene_id", "y", "p").join(masks, "cell_id")
        .select("gene_id", "y", "p", F.explode("masks").alias("name"))
        .groupBy("name", "gene_id")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("mean_y"), F.var_pop("y").alias("vy"),
            F.var_pop("p").alias("vp"), F.covar_pop("y", "p").alias("cyp"), F.sum(F.abs(e)).alias("abs_sum"),
            F.sum(e * e).alias("sq_sum"), F.count_if(F.col("p").isNull() | F.isnan("p")).alias("bad"),
        ),
        "mask-sums",
    )
    n = F.col("n")
    moments = sums.select(
        "name", "gene_id", "n", "mean_y", (F.col("vy") * n).alias("m2_y"), (F.col("vp") * n).alias("m2_p"),
        (F.col("cyp") * n).alias("c_yp"), "abs_sum", "sq_sum",
    )
    # A window group holds the genes of one mask.
    far = F.abs(F.col("mean_y") - F.coalesce("control_mean", F.lit(0.0)))
    ranked = moments.join(control, "gene_id", "left").withColumn(
        "_r", F.row_number().over(Window.partitionBy("name").orderBy(far.desc(), F.asc("gene_id")))
    )
    top = M.gene_pearson(ranked.where(F.col("_r") <= cfg.top_k)).groupBy("name").agg(F.avg("pearson").alias("top"))
    sizes = assignment.groupBy(mask.alias("name")).agg(F.count(F.lit(1)).alias("cells"))
    shape = sums.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_genes"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("bad").alias("bad")
    ).join(sizes, "name", "right")
    wrong = F.col("low").isNull() | (F.col("low") != F.col("cells")) | (F.col("high") != F.col("cells")) | (F.col("bad") > 0)
    text = F.format_string(
        "mask %s, %s: expected one prediction of %d cells for every gene, got %s to %s, %s missing",
        "name.shift_type", "name.part", "cells", F.col("low").cast("string"), F.col("high").cast("string"), F.col("bad").cast("string"),
    )
    checked = shape.withColumn("cells", F.when(wrong, F.raise_error(text).cast("bigint")).otherwise(F.col("cells")))
    return (
        checked.join(M.scores(moments), "name", "left").join(top, "name", "left")
        .select(
            "name.shift_type", "name.part", "mae", "rmse", "pearson_mean_gene",
            F.coalesce("top", F.lit(0.0)).alias("pearson_top_1000_degs"), "n_genes", F.col("cells").alias("n_eval_cells"),
        )
    )


def evaluate(
    moments: DataFrame,
    calibration: DataFrame,
    control: DataFrame,
    suite: DataFrame,
    cfg: EvaluationSettings | None = None,
) -> Evaluation:
    """Scores of a model, compared with the baselines of ``suite``, as a report."""
    cfg = cfg or EvaluationSettings()
    row = model_metrics(moments, calibration, control, cfg)
    comparison = cut_lineage(M.baseline_comparison(suite, row), "comparison")
    failures = cut_lineage(M.failure_modes(row, comparison, cfg.limits), "failures")
    # Comparison and failures have one row per baseline or rule.
    rows = comparison.agg(
        F.sort_array(F.collect_list(F.struct("baseline_mae", *[c for c in comparison.columns if c != "baseline_mae"])))
    ).scalar()
    found = failures.agg(F.collect_list(F.struct(*failures.columns))).scalar()
    report = row.select(
        F.lit(S.CARD_VERSION).alias("schema_version"),
        F.lit(S.REPORT_VERSION).alias("evaluation_schema_version"),
        F.current_timestamp().alias("generated_at"),
        F.struct("mae", "pearson_top_1000_degs", "calibration_error").alias("metrics"),
        rows.alias("baseline_comparison"),
        found.alias("failure_modes"),
        F.struct(
            F.lit(cfg.model_name).alias("model_name"),
            F.lit(cfg.model_version).alias("model_version"),
            F.lit(cfg.layer).alias("expression_layer"),
            F.lit(S.SUITE_VERSION).alias("baseline_suite_schema_version"),
            "n_eval_cells",
            "n_genes",
        ).alias("metadata"),
    )
    return Evaluation(row, comparison, failures, report)
