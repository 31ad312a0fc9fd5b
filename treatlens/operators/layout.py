"""Projections between matrix layouts, layer choice, masks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.functions import as_double, clean_text, coerce_counts, is_control, seeded_hash
from treatlens.operators.ordering import hash_rank
from treatlens.schema import PERTURBATION_FIELDS

SMALL_SAMPLE = 100_000


def to_long(wide: DataFrame, id_cols: Sequence[str], feature_cols: Sequence[str]) -> DataFrame:
    """One row per non-zero count from one column per feature."""
    counted = wide.select(*id_cols, *[coerce_counts(F.col(f"`{c}`")).alias(c) for c in feature_cols])
    return counted.unpivot(
        list(id_cols), [F.col(f"`{c}`") for c in feature_cols], "gene_id", "count"
    ).where(F.col("count") != 0)


def to_vectors(
    expr: DataFrame,
    feature_order: Sequence[str],
    value: str = "z",
    cells: DataFrame | None = None,
    out: str = "v",
) -> DataFrame:
    """One ``ARRAY<DOUBLE>`` per cell in the given feature order, zeros filled in.

    A pivot over the known feature list places each value by hash lookup, so
    the cost per cell follows its non-zeros. With ``cells`` given, cells
    without any entry get a zero vector.
    """
    wide = (
        expr.where(F.col("gene_id").isin(*feature_order))
        .groupBy("cell_id")
        .pivot("gene_id", list(feature_order))
        .agg(F.sum(F.col(value).cast("double")))
    )
    if cells is not None:
        wide = cells.select("cell_id").join(wide, "cell_id", "left")
    filled = [F.coalesce(F.col(f"`{g}`"), F.lit(0.0)) for g in feature_order]
    return wide.select("cell_id", F.array(*filled).alias(out))


def to_sparse(
    expr: DataFrame, features: DataFrame, value: str = "z", cells: DataFrame | None = None
) -> DataFrame:
    """Non-zeros of each cell as index and value arrays.

    ``features`` maps gene_id to a zero-based ``idx``. A cell has at most one
    entry per feature. With ``cells`` given, empty cells get empty arrays.
    """
    packed = (
        expr.join(features.select("gene_id", F.col("idx").cast("int").alias("idx")), "gene_id")
        .groupBy("cell_id")
        .agg(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("x"))).alias("_e"))
    )
    if cells is not None:
        packed = cells.join(packed, "cell_id", "left")
    others = [c for c in packed.columns if c != "_e"]
    return packed.select(
        *others,
        F.coalesce(F.col("_e.idx"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.col("_e.x"), F.array().cast("array<double>")).alias("val"),
    )


def pick_layer(expr: DataFrame, layer: str) -> DataFrame:
    """``value`` from the raw counts (``X``) or from a stored layer column."""
    if layer == "X":
        source = "count"
    elif layer == "normalized_log1p" and "z" in expr.columns:
        source = "z"
    elif layer in expr.columns and layer not in ("cell_id", "gene_id"):
        source = layer
    else:
        raise ValueError(f"layer '{layer}' is neither 'X' nor a stored layer")
    return expr.select("cell_id", "gene_id", F.col(source).cast("double").alias("value"))


def restrict(df: DataFrame, mask_ids: DataFrame | None) -> DataFrame:
    """Rows of the cells listed in ``mask_ids``; everything when there is no mask."""
    if mask_ids is None:
        return df
    if mask_ids.isEmpty():
        raise ValueError("the mask selects zero cells")
    return df.join(mask_ids.select("cell_id").distinct(), "cell_id", "left_semi")


def resolve_cap(requested: int | None, hard_cap: int | None) -> tuple[int | None, bool]:
    """The row cap in force, and whether the request had to be lowered."""
    if requested is not None and requested <= 0:
        raise ValueError("the requested cap must be positive")
    if hard_cap is None:
        return requested, False
    if requested is None:
        return hard_cap, False
    return min(requested, hard_cap), requested > hard_cap


def sample_cap(df: DataFrame, n: int, seed: int, key: str = "cell_id") -> DataFrame:
    """Uniform sample of ``n`` rows without replacement, the same on any cluster.

    Rows are ordered by a hash of seed and key. For a small sample every task
    keeps only its own ``n`` smallest before the final merge; a large one is
    taken by exact hash rank, so it never meets in one task.
    """
    if n <= SMALL_SAMPLE:
        return df.orderBy(seeded_hash(seed, F.col(key)), F.col(key)).limit(n)
    ranked = hash_rank(df.withColumn("_h", seeded_hash(seed, F.col(key))), "_h", key, "_r")
    return ranked.where(F.col("_r") <= n).select(*df.columns)


def text_or(df: DataFrame, name: str, default: Column) -> Column:
    """The column as text when present, else the default."""
    return F.col(name).cast("string") if name in df.columns else default


def harmonise_cells(table: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Eight-column cell table from a raw one.

    ``spec`` names the default ``cell_type``, ``protocol`` and ``batch_prefix``.
    The raw table must carry ``computed_library`` (the sum of its counts), used
    when no usable ``library_size`` is given.
    """
    control = is_control(F.col("perturbation_id").cast("string"))
    library = F.col("computed_library").cast("double")
    if "library_size" in table.columns:
        library = F.coalesce(as_double(F.col("library_size")), library)
    if "knockdown_efficiency_proxy" in table.columns:
        knockdown = F.coalesce(as_double(F.col("knockdown_efficiency_proxy")), F.lit(0.0))
    else:
        knockdown = F.when(control, F.lit(0.0)).otherwise(F.lit(1.0))
    return table.select(
        F.col("cell_id").cast("string").alias("cell_id"),
        text_or(table, "cell_type", F.lit(spec["cell_type"])).alias("cell_type"),
        text_or(table, "batch", F.lit(f"{spec['batch_prefix']}_0")).alias("batch"),
        text_or(
            table, "condition", F.when(control, F.lit("control")).otherwise(F.lit("perturbed"))
        ).alias("condition"),
        text_or(table, "protocol", F.lit(spec["protocol"])).alias("protocol"),
        library.alias("library_size"),
        F.col("perturbation_id").cast("string").alias("perturbation_id"),
        knockdown.alias("knockdown_efficiency_proxy"),
    )


def harmonise_genes(genes: DataFrame) -> DataFrame:
    """Five-column gene table from bare gene ids."""
    return genes.select(
        F.col("gene_id"),
        F.upper("gene_id").alias("gene_symbol"),
        F.lit("unknown").alias("chrom"),
        F.lit(".").alias("strand"),
        F.lit(-1).cast("bigint").alias("tss"),
    )


def default_perturbations(cells: DataFrame) -> DataFrame:
    """One metadata row per distinct treatment id."""
    pid = F.col("perturbation_id")
    control = is_control(pid)
    return cells.select(pid.cast("string").alias("perturbation_id")).distinct().select(
        pid,
        F.when(control, F.lit("NTC")).otherwise(F.upper(F.split_part(pid, F.lit("_"), F.lit(1)))).alias(
            "target_gene"
        ),
        F.lit("unknown").alias("chrom"),
        F.lit(-1).cast("bigint").alias("start"),
        F.lit(-1).cast("bigint").alias("end"),
        F.lit(".").alias("strand"),
        F.when(control, F.lit("control")).otherwise(F.lit("crispri")).alias("modality"),
        F.when(control, F.lit(0.0)).otherwise(F.lit(1.0)).alias("dose"),
        pid.alias("gRNA_id"),
    )


def perturbations_from_map(df: DataFrame, map_col: str) -> DataFrame:
    """Perturbation rows from a map of id to record; the key is the default id."""
    rows = df.select(F.explode(map_col).alias("_key", "_rec"))
    record_type = df.schema[map_col].dataType.valueType
    given = F.col("_rec.perturbation_id") if "perturbation_id" in record_type.fieldNames() else F.lit(None)
    present = [f for f in PERTURBATION_FIELDS if f in record_type.fieldNames()]
    return rows.select(
        clean_text(F.coalesce(given, F.col("_key"))).alias("perturbation_id"),
        *[F.col(f"_rec.{f}").alias(f) for f in present],
    )
