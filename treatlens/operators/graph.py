"""Correlation graph, degree-preserving rewiring and graph comparison.

Edges are rows (src, dst, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treatlens.operators.gram import gram, saved_blocks
from treatlens.operators.layout import to_sparse
from treatlens.session import cut_lineage


def indexed_features(features: DataFrame) -> DataFrame:
    """(gene_id, idx) with a zero-based position in gene id order.

    The feature list is at most as long as the gene list, one row per gene.
    """
    ids = features.select("gene_id").distinct()
    return ids.select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).alias("idx"))


def correlation(expr: DataFrame, cells: DataFrame, features: DataFrame, value: str = "z") -> DataFrame:
    """(src, dst, weight): Pearson correlation of all ordered gene pairs, 0 for flat genes.

    ``features`` is (gene_id, idx). All products come from one pass over the
    cells; pairs of entries within a cell are never emitted as rows.
    """
    n_y = features.count()
    rows = to_sparse(expr, features, value, cells.select("cell_id"))
    entries = saved_blocks(gram(rows, 0, n_y))
    # Column 0 of X is the intercept: its products are counts and sums.
    sums = entries.where((F.col("i") == 0) & (F.col("j") > 0)).select("j", F.col("value").alias("s"))
    n_cells = entries.where((F.col("i") == 0) & (F.col("j") == 0)).select("value").scalar()
    diag = entries.where((F.col("i") == F.col("j")) & (F.col("i") > 0)).select(
        F.col("j"), F.col("value").alias("ss")
    )
    spread = F.col("ss") - F.col("s") * F.col("s") / n_cells
    stats = (
        sums.join(diag, "j")
        .select("j", "s", F.when(spread > 1e-12 * F.col("ss"), spread).otherwise(F.lit(0.0)).alias("m2"))
        .join(features.select((F.col("idx") + 1).alias("j"), "gene_id"), "j")
    )
    left = stats.select(F.col("j").alias("i"), F.col("s").alias("si"), F.col("m2").alias("mi"),
                        F.col("gene_id").alias("src"))
    right = stats.select("j", F.col("s").alias("sj"), F.col("m2").alias("mj"), F.col("gene_id").alias("dst"))
    pairs = entries.where((F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") != F.col("j")))
    flat = (F.col("mi") <= 0) | (F.col("mj") <= 0)
    r = (F.col("value") - F.col("si") * F.col("sj") / n_cells) / F.sqrt(F.col("mi") * F.col("mj"))
    return pairs.join(left, "i").join(right, "j").select(
        "src", "dst", F.when(flat, F.lit(0.0)).otherwise(r).alias("weight")
    )


def correlation_graph(
    expr: DataFrame, cells: DataFrame, features: DataFrame, k: int = 2, value: str = "z"
) -> DataFrame:
    """The ``k`` strongest correlations of every gene, by absolute value, ties by id."""
    pairs = correlation(expr, cells, features, value)
    strongest = Window.partitionBy("src").orderBy(F.desc(F.abs("weight")), F.asc("dst"))
    return (
        pairs.withColumn("_r", F.row_number().over(strongest))
        .where((F.col("_r") <= k) & (F.col("weight") != 0))
        .drop("_r")
    )


def reference_graph(graph: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """The given graph without self edges, or the derived one."""
    return (fallback if graph is None else graph).where(F.col("src") != F.col("dst"))


def rewire(edges: DataFrame, seed: int = 42, rounds: int = 20) -> DataFrame:
    """Random graph with the same in and out degrees; a weight stays with its source.

    Each round pairs edges inside small hash buckets, swaps the targets of a
    pair, and takes back every swap that makes a self edge, repeats an existing
    edge or collides with another swap. Rounds are written to the shared folder,
    so the plan does not grow and a lost executor repeats one round only.
    """
    current = cut_lineage(
        edges.where(F.col("weight") != 0).select(
            F.xxhash64("src", "dst").alias("edge"), "src", "dst", "weight"
        ),
        "edges",
    )
    n_edges = current.count()
    if n_edges < 2:
        return current.drop("edge")
    n_buckets = max(1, n_edges // 16)
    for number in range(rounds):
        order = F.xxhash64("edge", F.lit(seed), F.lit(number))
        hashed = current.withColumn("_h", order).withColumn("_b", F.pmod("_h", F.lit(n_buckets)))
        in_bucket = Window.partitionBy("_b").orderBy("_h", "edge")
        placed = hashed.withColumn("_p", F.row_number().over(in_bucket) - 1)
        pair = placed.withColumn("_pair", F.floor(F.col("_p") / 2)).withColumn("_side", F.col("_p") % 2)
        mates = Window.partitionBy("_b", "_pair")
        proposed = (
            pair.withColumn("_n", F.count(F.lit(1)).over(mates))
            .withColumn("_ends", F.collect_list(F.struct("_side", "src", "dst")).over(mates))
            .withColumn("_mate", F.get(F.filter("_ends", lambda e: e["_side"] != F.col("_side")), F.lit(0)))
            .withColumn("_new", F.when(F.col("_n") == 2, F.col("_mate.dst")))
            .withColumn(
                "_distinct",
                F.size(F.array_distinct(F.array("src", "dst", "_mate.src", "_mate.dst"))) == 4,
            )
        )
        wanted = proposed.where((F.col("_n") == 2) & F.col("_distinct")).select(
            "edge", "src", F.col("_new").alias("dst"), "_b", "_pair"
        )
        # A proposal is free when no present edge and no other proposal has its ends.
        taken = wanted.join(current.select("src", "dst"), ["src", "dst"], "left_semi").select("_b", "_pair")
        doubled = (
            wanted.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("src", "dst")))
            .where(F.col("_c") > 1)
            .select("_b", "_pair")
        )
        ok = wanted.join(taken.union(doubled).distinct(), ["_b", "_pair"], "left_anti").select(
            "edge", F.col("dst").alias("_dst")
        )
        current = cut_lineage(
            current.join(ok, "edge", "left").select(
                "edge", "src", F.coalesce("_dst", "dst").alias("dst"), "weight"
            ),
            "edges",
        )
    return current.drop("edge")


def graph_metrics(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (metric, value): edge counts, degree differences, share of common edges."""
    ref = reference.where(F.col("weight") != 0).select("src", "dst").distinct()
    rnd = other.where(F.col("weight") != 0).select("src", "dst").distinct()
    both = ref.withColumn("a", F.lit(1)).join(rnd.withColumn("b", F.lit(1)), ["src", "dst"], "full_outer")
    merged = both.na.fill(0, ["a", "b"])

    def degree_gap(end: str) -> DataFrame:
        return merged.groupBy(end).agg(F.abs(F.sum("a") - F.sum("b")).alias("d")).agg(
            F.coalesce(F.sum("d"), F.lit(0)).cast("double").alias("d")
        )

    totals = merged.agg(
        F.coalesce(F.sum("a"), F.lit(0)).cast("double").alias("edge_count_reference"),
        F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("edge_count_random"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("double").alias("_common"),
    )
    row = totals.select(
        "edge_count_reference",
        "edge_count_random",
        degree_gap("src").scalar().alias("out_degree_l1_diff"),
        degree_gap("dst").scalar().alias("in_degree_l1_diff"),
        F.when(F.col("edge_count_reference") > 0, F.col("_common") / F.col("edge_count_reference"))
        .otherwise(F.lit(0.0))
        .alias("edge_overlap_fraction"),
    )
    return row.unpivot([], row.columns, "metric", "value")
