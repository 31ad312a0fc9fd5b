"""Simple reference predictors and their scores.

Every predictor here is constant within a treatment group, so a prediction is
one number per (treatment, gene) and never one per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.operators.metrics import grouped_moments, suite_rows
from treatlens.operators.qc import group_profiles
from treatlens.session import cut_lineage

EXPRESSION_BASELINES = ("gene_level_mean", "control_mean", "linear_regression")


def _eval_groups(eval_cells: DataFrame) -> Column:
    return (
        eval_cells.groupBy("perturbation_id")
        .agg(F.count(F.lit(1)).alias("n_eval"))
        .agg(F.collect_list(F.struct("perturbation_id", "n_eval")).alias("g"))
        .scalar()
    )


def expression_predictions(
    train_expr: DataFrame,
    train_cells: DataFrame,
    eval_cells: DataFrame,
    genes: DataFrame,
    value: str = "z",
) -> DataFrame:
    """Prediction of each baseline for every evaluated treatment and every gene.

    Columns: perturbation_id, gene_id, n_eval, seen, var (training variance of
    the group), and one column per baseline.

    A treatment absent from training gets the global mean (group mean
    baseline) or the minimum-norm least-squares intercept, which for an
    intercept plus one indicator per group is the sum of the group means over
    the number of groups plus one. Treatments seen in training get their mean
    from both.
    """
    profiles = cut_lineage(group_profiles(train_expr, train_cells, genes, value), "train-profiles")
    per_gene = profiles.groupBy("gene_id").agg(
        F.first("global_mean").alias("global_mean"),
        F.first("control_mean").alias("control_mean"),
        F.first("sum_of_means").alias("sum_of_means"),
        F.first("n_groups").alias("n_groups"),
    )
    grid = per_gene.withColumn("_g", F.explode(_eval_groups(eval_cells))).select(
        "gene_id",
        "global_mean",
        "control_mean",
        "sum_of_means",
        "n_groups",
        F.col("_g.perturbation_id").alias("perturbation_id"),
        F.col("_g.n_eval").alias("n_eval"),
    )
    own = profiles.select("perturbation_id", "gene_id", "mean", "var")
    joined = grid.join(own, ["gene_id", "perturbation_id"], "left")
    intercept = F.col("sum_of_means") / (F.col("n_groups") + 1)
    return joined.select(
        "perturbation_id",
        "gene_id",
        "n_eval",
        F.col("mean").isNotNull().alias("seen"),
        F.coalesce("var", F.lit(0.0)).alias("var"),
        F.coalesce("mean", "global_mean").alias("gene_level_mean"),
        F.coalesce("control_mean", "global_mean").alias("control_mean"),
        F.coalesce("mean", intercept).alias("linear_regression"),
    )


def group_mean_baseline(predictions: DataFrame) -> DataFrame:
    """Mean profile of the treatment, global mean when unseen."""
    return _one(predictions, "gene_level_mean")


def control_mean_baseline(predictions: DataFrame) -> DataFrame:
    """Mean profile of the control cells, of all cells when there are none."""
    return _one(predictions, "control_mean")


def onehot_regression_baseline(predictions: DataFrame) -> DataFrame:
    """Least squares on an intercept and one indicator per treatment."""
    return _one(predictions, "linear_regression")


def _one(predictions: DataFrame, name: str) -> DataFrame:
    return predictions.select(
        "perturbation_id", "gene_id", "seen", F.col(name).alias("prediction")
    )


def unseen_summary(predictions: DataFrame) -> DataFrame:
    """Evaluated cells whose treatment was not in training, as one row."""
    per_group = predictions.select("perturbation_id", "n_eval", "seen").distinct()
    return per_group.agg(
        F.count_if("seen").alias("n_eval_treatments_seen"),
        F.coalesce(F.sum(F.when(~F.col("seen"), F.col("n_eval"))), F.lit(0)).alias("n_eval_cells_unseen"),
    )


def baseline_suite(
    train_expr: DataFrame,
    train_cells: DataFrame,
    eval_expr: DataFrame,
    eval_cells: DataFrame,
    genes: DataFrame,
    graph_rows: DataFrame | None = None,
    value: str = "z",
) -> DataFrame:
    """All baselines as rows (baseline, task, metric, value).

    ``graph_rows`` are the scores of the rewired graph, as
    :func:`treatlens.operators.graph.graph_metrics` gives them.
    """
    predictions = expression_predictions(train_expr, train_cells, eval_cells, genes, value)
    moments = grouped_moments(eval_expr, eval_cells, predictions, EXPRESSION_BASELINES, value)
    rows = suite_rows(moments)
    if graph_rows is not None:
        graph = graph_rows.select(
            F.lit("random_edge_grn").alias("baseline"), F.lit("grn").alias("task"), "metric", "value"
        )
        rows = rows.unionByName(graph)
    return rows


def require_baselines(suite: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Names of required baselines that the suite lacks (empty when ready)."""
    spark = suite.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in required])).alias("baseline"))
    return wanted.join(suite.select("baseline").distinct(), "baseline", "left_anti")
