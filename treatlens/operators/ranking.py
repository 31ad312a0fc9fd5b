"""Ranking scores of edge lists against a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.operators.ordering import running_totals
from treatlens.session import cut_lineage


def _by_score(scored: DataFrame, descending: bool) -> DataFrame:
    """Distinct scores with positives, rows, and their running totals."""
    tagged = scored.select(
        "score", F.col("label").cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("n")
    )
    return cut_lineage(running_totals(tagged, "score", ["pos", "n"], descending), "ranking")


def auroc(scored: DataFrame) -> DataFrame:
    """One row ``auc`` from rows (score, label boolean): rank sum with average ranks.

    0.5 when only one class is present.
    """
    totals = _by_score(scored, descending=False)
    average_rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    row = totals.agg(
        F.sum(average_rank * F.col("pos")).alias("r"),
        F.coalesce(F.sum("pos"), F.lit(0)).cast("double").alias("p"),
        F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).cast("double").alias("q"),
    )
    value = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return row.select(
        F.when((F.col("p") == 0) | (F.col("q") == 0), F.lit(0.5)).otherwise(bounded).alias("auc")
    )


def best_f1(scored: DataFrame) -> DataFrame:
    """One row ``f1``: best F1 over all thresholds ``score >= t``, 0 without positives."""
    totals = _by_score(scored, descending=True)
    positives = totals.agg(F.sum("pos").alias("p")).scalar()
    f1 = F.try_divide(2.0 * F.col("cum_pos"), (F.col("cum_n") + positives).cast("double"))
    return totals.agg(F.coalesce(F.max(F.when(positives > 0, f1)), F.lit(0.0)).alias("f1"))


def aligned_edges(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """(score, label) of every edge row, matched with the truth by its two ids.

    A pair the truth does not list counts as no edge.
    """
    t = truth.select("source_gene_id", "target_gene_id", F.col("weight").alias("_t"))
    return (
        edges.where(F.col("source_gene_id") != F.col("target_gene_id"))
        .join(t, ["source_gene_id", "target_gene_id"], "left")
        .select(
            F.abs("weight").alias("score"),
            (F.abs(F.coalesce("_t", F.lit(0.0))) > 1e-12).alias("label"),
        )
    )


def graph_recovery(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """One row with ``auc`` and ``f1`` of an estimated graph."""
    scored = aligned_edges(edges, truth)
    return auroc(scored).select("auc", best_f1(scored).scalar().alias("f1"))


def truth_correlation(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``abs_corr``: Pearson of absolute weights, 0 when either side is flat."""
    t = truth.select("source_gene_id", "target_gene_id", F.abs("weight").alias("t"))
    both = (
        edges.where(F.col("source_gene_id") != F.col("target_gene_id"))
        .join(t, ["source_gene_id", "target_gene_id"], "left")
        .select(F.abs("weight").alias("x"), F.coalesce("t", F.lit(0.0)).alias("t"))
    )
    m = both.agg(
        F.stddev_pop("x").alias("sx"), F.stddev_pop("t").alias("st"), F.covar_pop("x", "t").alias("c")
    )
    flat = (F.coalesce("sx", F.lit(0.0)) <= 1e-12) | (F.coalesce("st", F.lit(0.0)) <= 1e-12)
    return m.select(
        F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("c"), F.col("sx") * F.col("st"))).alias("abs_corr")
    )
