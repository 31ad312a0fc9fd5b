"""Quality control, normalisation and feature selection on long sparse tables.

``expr`` holds one row per non-zero (cell, gene). Zeros are absent rows, so
means and variances divide by group sizes rather than by row counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treatlens.functions import is_control, log1p_scaled, zscore
from treatlens.operators.layout import to_vectors
from treatlens.operators.ordering import global_rank
from treatlens.session import broadcast_if_small, cut_lineage


@dataclass(frozen=True)
class QcSettings:
    """Thresholds of the preprocessing chain."""

    target_sum: float = 1e4
    n_features: int = 2000
    n_features_low: int = 2000
    n_features_high: int = 5000
    min_counts: int = 50
    min_genes: int = 10
    min_cells: int = 3
    proxies: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        checks = [
            (self.target_sum > 0, "target_sum must be positive"),
            (0 < self.n_features_low <= self.n_features_high, "feature bounds must be positive and ordered"),
            (
                self.n_features_low <= self.n_features <= self.n_features_high,
                "n_features must lie within its bounds",
            ),
            (self.min_counts >= 0, "min_counts must not be negative"),
            (self.min_genes >= 0, "min_genes must not be negative"),
            (self.min_cells >= 1, "min_cells must be at least 1"),
        ]
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


def cell_totals(expr: DataFrame) -> DataFrame:
    """Library size and number of detected genes per cell, in one aggregation."""
    return expr.groupBy("cell_id").agg(
        F.sum("count").cast("bigint").alias("library_size"),
        F.count_if(F.col("count") > 0).alias("n_genes"),
    )


def library_size(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of counts for every cell; cells without entries get 0."""
    return cells.select("cell_id").join(cell_totals(expr), "cell_id", "left").select(
        "cell_id", F.coalesce("library_size", F.lit(0).cast("bigint")).alias("library_size")
    )


def features_detected(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Number of genes above zero for every cell; cells without entries get 0."""
    return cells.select("cell_id").join(cell_totals(expr), "cell_id", "left").select(
        "cell_id", F.coalesce("n_genes", F.lit(0).cast("bigint")).alias("n_genes")
    )


def qc_cells(cells: DataFrame, expr: DataFrame, min_counts: int = 50, min_genes: int = 10) -> DataFrame:
    """Cells that meet both thresholds, with their totals."""
    totals = cells.select("cell_id").join(cell_totals(expr), "cell_id", "left").na.fill(
        0, ["library_size", "n_genes"]
    )
    return totals.where((F.col("library_size") >= min_counts) & (F.col("n_genes") >= min_genes))


def qc_genes(expr: DataFrame, min_cells: int = 3) -> DataFrame:
    """Genes seen in at least ``min_cells`` cells, with the number of those cells."""
    return (
        expr.groupBy("gene_id")
        .agg(F.count_if(F.col("count") > 0).alias("n_cells"))
        .where(F.col("n_cells") >= min_cells)
    )


def normalise_log1p(expr: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """Add ``z``: counts scaled to a common library size, then log1p.

    The per-cell sum is aggregated before it is joined back, so one very large
    cell never has to sit in a single window task.
    """
    library = expr.groupBy("cell_id").agg(F.sum("count").alias("_lib"))
    return expr.join(library, "cell_id").withColumn(
        "z", log1p_scaled(F.col("count"), F.col("_lib"), target_sum)
    ).drop("_lib")


def _with_zeros(n: Column, mean: Column, var: Column, size: Column) -> Column:
    """Population variance over ``size`` values of which ``n`` are listed and the rest are 0."""
    size_d = size.cast("double")
    return (n * var + mean * mean * n * (size_d - n) / size_d) / size_d


def feature_variance(expr: DataFrame, n_cells: int | Column, value: str = "z") -> DataFrame:
    """Population variance per gene over all cells, absent zeros included."""
    size = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    stats = expr.groupBy("gene_id").agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    return stats.select(
        "gene_id", _with_zeros(F.col("n"), F.col("m"), F.col("v"), size).alias("variance")
    )


def select_top_features(variance: DataFrame, k: int) -> DataFrame:
    """The ``k`` most variable genes with their rank, ties by gene id.

    ``limit`` keeps ``k`` rows per task, so the ranking window sees at most k rows.
    """
    top = variance.orderBy(F.desc("variance"), F.asc("gene_id")).limit(k)
    by_rank = Window.orderBy(F.desc("variance"), F.asc("gene_id"))
    return top.select("gene_id", "variance", F.row_number().over(by_rank).alias("rank"))


def refresh_library(expr: DataFrame, selected: DataFrame, cells: DataFrame) -> DataFrame:
    """Library size again, over the selected genes only."""
    kept = expr.join(selected.select("gene_id"), "gene_id", "left_semi")
    return library_size(kept, cells)


def domain(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct values of a category column, numbered from 0 in order; null counts as ``None``."""
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit("None")).alias("value")).distinct()
    return global_rank(values, [F.asc("value")], "code")


def one_hot(col: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column per given category."""
    return [(F.col(col) == v).cast("double") for v in values]


def sparse_proxies(
    cells: DataFrame,
    tiny: float = 1e-8,
    blank_as: str | None = None,
    categories: Sequence[str] = ("batch", "protocol"),
) -> tuple[DataFrame, DataFrame]:
    """Confounder proxies of each cell as ``widx`` and ``wval``, and the table ``(i, name)`` of their columns.

    A category is one number per cell, an index among all columns, so a domain
    may have any size: its values are a table that is joined and never collected.
    """
    present = [c for c in categories if c in cells.columns]
    base = cells
    for name in ("library_size", "knockdown_efficiency_proxy"):
        if name not in cells.columns:
            base = base.withColumn(name, F.lit(0.0))
    for name in present:
        text = F.coalesce(F.col(name).cast("string"), F.lit("None"))
        if blank_as is not None:
            trimmed = F.trim(F.col(name).cast("string"))
            text = F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(blank_as)).otherwise(trimmed)
        base = base.withColumn(name, text)
    scaled = zscore(base, "library_size", "_lib_z", tiny)
    scaled = zscore(scaled, "knockdown_efficiency_proxy", "_kd_z", tiny)
    spark = cells.sparkSession
    names = spark.createDataFrame([(0, "library_size_z"), (1, "knockdown_efficiency_proxy_z")], "i int, name string")
    index: list[Column] = [F.lit(0), F.lit(1)]
    first = 2
    for k, name in enumerate(present):
        codes = cut_lineage(domain(base, name), "domain").select("value", (F.col("code") + first).cast("int").alias(f"_code{k}"))
        scaled = scaled.join(broadcast_if_small(codes), scaled[name] == codes["value"]).drop("value")
        index.append(F.col(f"_code{k}"))
        names = names.unionByName(codes.select(F.col(f"_code{k}").alias("i"), F.concat(F.lit(f"{name}="), "value").alias("name")))
        first += codes.count()
    values = F.array(F.col("_lib_z"), F.col("_kd_z"), *[F.lit(1.0) for _ in present])
    done = scaled.withColumn("widx", F.array(*index)).withColumn("wval", values)
    return done.drop("_lib_z", "_kd_z", *[f"_code{k}" for k in range(len(present))]), names


def proxy_matrix(
    cells: DataFrame,
    tiny: float = 1e-8,
    blank_as: str | None = None,
    categories: Sequence[str] = ("batch", "protocol"),
) -> tuple[DataFrame, DataFrame]:
    """Confounder proxies as one dense array per cell, and the table ``(i, name)`` of its entries.

    As wide as the categories have values; ``sparse_proxies`` is the form that
    later steps use.
    """
    sparse, names = sparse_proxies(cells, tiny, blank_as, categories)
    width = names.agg(F.max("i").alias("_last"))
    # The place of a column among a cell's few non-zeros; 0 if it has none there.
    dense = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda i: F.coalesce(F.try_element_at("wval", F.nullif(F.array_position("widx", i).cast("int"), F.lit(0))), F.lit(0.0)),
    )
    one_row = sparse.withColumn("_last", width.scalar())
    return one_row.withColumn("proxies", dense).drop("widx", "wval", "_last"), names


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def control_flag(cells: DataFrame) -> Column:
    """Control test on the columns the cell table has."""
    condition = F.col("condition") if "condition" in cells.columns else None
    return is_control(F.col("perturbation_id"), condition)


def with_treatments(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """``expr`` with ``perturbation_id`` and ``_ctl`` of its cells.

    Counts that carry ``perturbation_id`` and ``condition`` already, of these cells
    alone, are not joined to them again.
    """
    if "perturbation_id" in expr.columns:
        return expr.withColumn("_ctl", control_flag(expr))
    return expr.join(cells.select("cell_id", "perturbation_id", control_flag(cells).alias("_ctl")).hint("merge"), "cell_id")


def group_profiles(
    expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None, value: str = "z"
) -> DataFrame:
    """Mean and variance of every gene in every treatment group, zeros included.

    Columns: perturbation_id, gene_id, n_cells, n_present, mean, var, and per
    gene global_mean, control_mean (NULL without control cells),
    sum_of_means, n_groups, n_total, n_control.

    One pass over ``expr``, combined on the map side to (treatment, gene); that
    small table is written once and completed to all treatments of all genes.
    """
    tagged = cells.select("perturbation_id", control_flag(cells).alias("_ctl"))
    present = cut_lineage(
        with_treatments(expr, cells)
        .select("perturbation_id", "gene_id", "_ctl", F.col(value).alias("_v"))
        .groupBy("perturbation_id", "gene_id")
        .agg(
            F.count("_v").alias("n_present"),
            F.avg("_v").alias("_m"),
            F.var_pop("_v").alias("_v2"),
            F.sum(F.when(F.col("_ctl"), F.col("_v"))).alias("_cs"),
        ),
        "group-sums",
    )
    # One array entry per treatment; read once, as a scalar subquery.
    sizes = (
        tagged.groupBy("perturbation_id")
        .agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("_ctl").alias("_nc"))
        .agg(
            F.struct(
                F.collect_list(F.struct("perturbation_id", "n_cells")).alias("groups"),
                F.sum("n_cells").alias("n_total"),
                F.sum("_nc").alias("n_control"),
                F.count(F.lit(1)).alias("n_groups"),
            ).alias("sizes")
        )
        .scalar()
    )
    gene_ids = (present if genes is None else genes).select("gene_id").distinct()
    grid = (
        gene_ids.withColumn("_s", sizes)
        .select("gene_id", "_s.n_total", "_s.n_control", "_s.n_groups", F.explode("_s.groups").alias("_g"))
        .select("gene_id", "n_total", "n_control", "n_groups", "_g.perturbation_id", "_g.n_cells")
    )
    n, m, v = F.col("n_present"), F.col("_m"), F.col("_v2")
    full = grid.join(present, ["gene_id", "perturbation_id"], "left").na.fill(
        0, ["n_present", "_m", "_v2", "_cs"]
    )
    # A window group holds one row per treatment of one gene.
    gene = Window.partitionBy("gene_id")
    return full.select(
        "perturbation_id",
        "gene_id",
        "n_cells",
        "n_present",
        (n * m / F.col("n_cells")).alias("mean"),
        _with_zeros(n, m, v, F.col("n_cells")).alias("var"),
        (F.sum(n * m).over(gene) / F.col("n_total")).alias("global_mean"),
        F.when(F.col("n_control") > 0, F.sum("_cs").over(gene) / F.col("n_control")).alias("control_mean"),
        F.sum(n * m / F.col("n_cells")).over(gene).alias("sum_of_means"),
        "n_groups",
        "n_total",
        "n_control",
    )


def treatment_shift(expr: DataFrame, cells: DataFrame, value: str = "z") -> DataFrame:
    """Mean profile of each treatment minus the mean profile of the control cells.

    Reading the result is an error when no control cell exists; the test rides
    on the control count that the profiles carry anyway.
    """
    missing = F.raise_error(F.lit("no control cells: a treatment shift needs a control group")).cast("double")
    profiles = group_profiles(expr, cells, value=value).withColumn(
        "control_mean", F.when(F.col("n_control") > 0, F.col("control_mean")).otherwise(missing)
    )
    return profiles.select(
        "perturbation_id",
        "gene_id",
        F.col("mean").alias("group_mean"),
        "control_mean",
        (F.col("mean") - F.col("control_mean")).alias("shift"),
    )


@dataclass
class Preprocessed:
    """Lazy results of :func:`preprocess`."""

    cells: DataFrame
    expr: DataFrame
    features: DataFrame
    summary: DataFrame
    proxy_names: DataFrame | None

    def vectors(self, value: str = "z") -> DataFrame:
        order = [r["gene_id"] for r in self.features.orderBy("rank").collect()]
        return to_vectors(self.expr, order, value, cells=self.cells)


def preprocess(cells: DataFrame, expr: DataFrame, cfg: QcSettings | None = None) -> Preprocessed:
    """Cell filter, gene filter, normalisation, feature choice, proxies, summary.

    The counts are read once. Two intermediate tables are written: the counts
    of the kept cells, and their normalised values over the kept genes. Both
    windows are keyed by cell and (cell, gene) is unique, so a window group is
    never larger than the gene list.
    """
    cfg = cfg or QcSettings()
    per_cell = Window.partitionBy("cell_id")
    kept = cut_lineage(
        expr.select(
            "cell_id",
            "gene_id",
            "count",
            F.sum("count").over(per_cell).alias("_lib"),
            F.sum((F.col("count") > 0).cast("bigint")).over(per_cell).alias("_n"),
            # Marks one row per cell, so cells are counted without a distinct.
            (F.col("gene_id") == F.min("gene_id").over(per_cell)).alias("first"),
        )
        .where((F.col("_lib") >= cfg.min_counts) & (F.col("_n") >= cfg.min_genes))
        .select("cell_id", "gene_id", "count", "first"),
        "kept-counts",
    )
    genes_ok = cut_lineage(qc_genes(kept, cfg.min_cells), "kept-genes")
    if genes_ok.isEmpty():
        raise ValueError("quality control removed every cell or gene; adjust the thresholds")
    normal = cut_lineage(
        kept.join(broadcast_if_small(genes_ok.select("gene_id")), "gene_id", "left_semi").select(
            "cell_id",
            "gene_id",
            "count",
            log1p_scaled(F.col("count"), F.sum("count").over(per_cell), cfg.target_sum).alias("z"),
        ),
        "normal",
    )
    keep_empty = cfg.min_counts <= 0 and cfg.min_genes <= 0
    n_kept = (
        cells.agg(F.count(F.lit(1)).alias("n")) if keep_empty else kept.agg(F.count_if("first").alias("n"))
    ).scalar()
    # At most n_features rows by construction of the limit.
    features = cut_lineage(select_top_features(feature_variance(normal, n_kept), cfg.n_features), "features")
    chosen = F.broadcast(features.select("gene_id", F.lit(True).alias("_sel")))
    selected = normal.join(chosen, "gene_id", "left_semi")
    totals = (
        kept.join(chosen, "gene_id", "left")
        .groupBy("cell_id")
        .agg(F.coalesce(F.sum(F.when(F.col("_sel"), F.col("count"))), F.lit(0)).cast("double").alias("library_size"))
    )
    final_cells = cells.drop("library_size").join(totals, "cell_id", "left" if keep_empty else "inner")
    final_cells = final_cells.na.fill(0.0, ["library_size"])
    final_cells = cut_lineage(final_cells, "kept-cells")
    names = None
    if cfg.proxies:
        final_cells, names = proxy_matrix(final_cells)
    summary = qc_summary(cells, expr, n_kept, genes_ok, cfg)
    return Preprocessed(final_cells, selected, features, summary, names)


def qc_summary(
    cells: DataFrame, expr: DataFrame, n_kept: Column, kept_genes: DataFrame, cfg: QcSettings
) -> DataFrame:
    """One row with counts before and after, the fallback flag and the thresholds."""

    def count_of(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    spark = cells.sparkSession
    genes_in = expr.select("gene_id").distinct()
    one = spark.range(1).select(
        count_of(cells).alias("n_cells_input"),
        count_of(genes_in).alias("n_genes_input"),
        n_kept.alias("n_cells_after_qc"),
        count_of(kept_genes).alias("n_genes_qc"),
    )
    picked = F.least(F.col("n_genes_qc"), F.lit(cfg.n_features).cast("bigint"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in asdict(cfg).items()])
    return one.select(
        "n_cells_input",
        "n_genes_input",
        "n_cells_after_qc",
        picked.alias("n_genes_after_qc"),
        picked.alias("n_features_selected"),
        (picked != cfg.n_features).alias("fallback_used"),
        (F.col("n_cells_input") - F.col("n_cells_after_qc")).alias("removed_cells"),
        (F.col("n_genes_input") - picked).alias("removed_genes"),
        settings.alias("settings"),
    )
