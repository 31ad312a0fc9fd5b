"""Contract checks and repairs.

Every check is one row ``(check, field, n_bad, message, repaired)``; ``n_bad``
is 0 when the check holds. Checks of one table share one aggregation. NULL text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.functions import as_double, clean_text
from treatlens.operators.qc import library_size, normalise_log1p

MODES = ("strict", "repair")


class ContractError(ValueError):
    """Raised with the list of violated checks."""

    def __init__(self, errors: list[str]) -> None:
        self.errors = errors
        super().__init__("table contract violated:\n- " + "\n- ".join(errors))


@dataclass(frozen=True)
class Rule:
    """One aggregate check: ``bad`` is an aggregate giving the number of bad rows."""

    check: str
    field: str
    bad: Column
    message: str
    repaired: bool = False


def _mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown validation mode: {mode}")
    return mode


def _report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules of one table from a single aggregation."""
    counted = df.agg(*[r.bad.cast("bigint").alias(f"b{i}") for i, r in enumerate(rules)])
    rows = [
        F.struct(
            F.lit(r.check).alias("check"),
            F.lit(r.field).alias("field"),
            F.coalesce(F.col(f"b{i}"), F.lit(0).cast("bigint")).alias("n_bad"),
            F.lit(r.message).alias("message"),
            F.lit(r.repaired).alias("repaired"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _absent(check: str, name: str, repaired: bool) -> Rule:
    # Aggregates to the number of rows that lack the column, at least 1.
    return Rule(check, name, F.greatest(F.count(F.lit(1)), F.lit(1)), f"missing column '{name}'", repaired)


def _blank(name: str) -> Column:
    return F.count_if(F.coalesce(clean_text(F.col(name)), F.lit("")) == "")


def check_counts(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """At least one cell and gene; counts not negative and whole up to rounding noise."""
    x = F.col("count").cast("double")
    near = F.abs(x - F.bround(x)) <= 1e-8 + 1e-5 * F.abs(F.bround(x))
    sizes = _report(
        cells.select(F.lit(1)), [Rule("counts", "cells", (F.count(F.lit(1)) == 0).cast("int"), "no cell")]
    ).unionByName(
        _report(genes.select(F.lit(1)), [Rule("counts", "genes", (F.count(F.lit(1)) == 0).cast("int"), "no gene")])
    )
    values = _report(
        expr,
        [
            Rule("counts", "non_negative", F.count_if(x < 0), "counts must not be negative"),
            Rule("counts", "integer_like", F.count_if(~near | x.isNull()), "counts must be whole numbers"),
        ],
    )
    return sizes.unionByName(values)


def check_cells(cells: DataFrame, mode: str = "strict") -> DataFrame:
    """Required columns, numeric library size and knockdown, no empty text."""
    fix = _mode(mode) == "repair"
    rules = [_absent("cells", c, fix) for c in S.CELL_COLUMNS if c not in cells.columns]
    if "library_size" in cells.columns:
        lib = as_double(F.col("library_size"))
        rules.append(Rule("cells", "library_size.numeric", F.count_if(lib.isNull()), "library size must be numeric", fix))
        rules.append(Rule("cells", "library_size.non_negative", F.count_if(lib < 0), "library size must not be negative"))
    if "knockdown_efficiency_proxy" in cells.columns:
        kd = as_double(F.col("knockdown_efficiency_proxy"))
        all_bad = (F.count(F.lit(1)) > 0) & (F.count_if(kd.isNotNull()) == 0)
        rules.append(
            Rule("cells", "knockdown_efficiency_proxy.numeric", F.when(all_bad, F.count(F.lit(1))).otherwise(0),
                 "knockdown must hold a number in at least one row", fix)
        )
    rules.extend(
        Rule("cells", f"{c}.text", _blank(c), f"'{c}' holds empty values")
        for c in S.CELL_TEXT_COLUMNS
        if c in cells.columns
    )
    return _report(cells, rules)


def repair_cells(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Fill missing columns and unusable numbers with the contract's defaults."""
    out = cells
    for name, default in (
        ("cell_type", "unknown"),
        ("batch", "unknown"),
        ("condition", "unknown"),
        ("protocol", "unknown"),
        ("perturbation_id", "unassigned"),
    ):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
    kd = F.col("knockdown_efficiency_proxy") if "knockdown_efficiency_proxy" in out.columns else F.lit(None)
    out = out.withColumn("knockdown_efficiency_proxy", F.coalesce(as_double(kd), F.lit(0.0)))
    totals = library_size(expr, out).select("cell_id", F.col("library_size").alias("_lib"))
    given = as_double(F.col("library_size")) if "library_size" in out.columns else F.lit(None).cast("double")
    out = out.join(totals, "cell_id", "left").withColumn(
        "library_size", F.coalesce(given, F.col("_lib").cast("double"))
    )
    return out.select(
        *[
            clean_text(F.col(c)).alias(c) if c in S.CELL_TEXT_COLUMNS and c != "cell_id" else F.col(c)
            for c in S.CELL_COLUMNS
        ]
    )


def check_genes(genes: DataFrame, mode: str = "strict") -> DataFrame:
    """Required columns, numeric start site, no empty text."""
    fix = _mode(mode) == "repair"
    rules = [_absent("genes", c, fix) for c in S.GENE_COLUMNS if c not in genes.columns]
    if "tss" in genes.columns:
        rules.append(
            Rule("genes", "tss.numeric", F.count_if(as_double(F.col("tss")).isNull()), "tss must be numeric", fix)
        )
    rules.extend(
        Rule("genes", f"{c}.text", _blank(c), f"'{c}' holds empty values")
        for c in S.GENE_TEXT_COLUMNS
        if c in genes.columns
    )
    return _report(genes, rules)


def repair_genes(genes: DataFrame) -> DataFrame:
    """Fill missing columns and unusable start sites."""
    out = genes
    for name, default in (("gene_symbol", F.col("gene_id")), ("chrom", F.lit("unknown")), ("strand", F.lit("."))):
        if name not in out.columns:
            out = out.withColumn(name, default)
    site = as_double(F.col("tss")) if "tss" in out.columns else F.lit(None).cast("double")
    out = out.withColumn("tss", F.coalesce(site.try_cast("bigint"), F.lit(-1).cast("bigint")))
    return out.select(*[clean_text(F.col(c)).alias(c) if c != "tss" else F.col(c) for c in S.GENE_COLUMNS])


def check_layer(expr: DataFrame, mode: str = "strict") -> DataFrame:
    """The normalised value is there for every entry and not negative."""
    fix = _mode(mode) == "repair"
    if "z" not in expr.columns:
        return _report(expr, [_absent("layer", "z", fix)])
    return _report(
        expr,
        [
            Rule("layer", "z.shape", F.count_if(F.col("z").isNull()), "every entry needs a normalised value"),
            Rule("layer", "z.non_negative", F.count_if(F.col("z") < 0), "normalised values must not be negative"),
        ],
    )


def repair_layer(expr: DataFrame) -> DataFrame:
    """Add the normalised value when the column is missing."""
    return expr if "z" in expr.columns else normalise_log1p(expr)


def check_embeddings(
    vectors: DataFrame | None, cells: DataFrame, col: str, dim: int | None = None, mode: str = "strict"
) -> DataFrame:
    """One vector per cell, all of one positive length (``dim`` when given)."""
    fix = _mode(mode) == "repair"
    if vectors is None or col not in vectors.columns:
        return _report(cells, [_absent("embeddings", col, fix)])
    # Ids of all cells: by the size of their file, or of equal vectors, the planner would broadcast them through the driver.
    ids = cells.select("cell_id").hint("merge")
    have = vectors.where(F.col(col).isNotNull()).select("cell_id").hint("merge")
    missing = _report(
        ids.join(have, "cell_id", "left_anti"),
        [Rule("embeddings", f"{col}.rows", F.count(F.lit(1)), "cells without a vector")],
    )
    extra = _report(
        have.join(ids, "cell_id", "left_anti"),
        [Rule("embeddings", f"{col}.extra", F.count(F.lit(1)), "vectors of unknown cells")],
    )
    size = F.size(col)
    if dim is None:
        uneven = F.when(
            (F.min(size) != F.max(size)) | (F.min(size) <= 0), F.count_if(size.isNotNull())
        ).otherwise(0)
    else:
        uneven = F.count_if((size != dim) | (size <= 0))
    shape = _report(vectors, [Rule("embeddings", f"{col}.dim", uneven, "vectors need one positive length")])
    return missing.unionByName(extra).unionByName(shape)


def repair_embeddings(vectors: DataFrame | None, cells: DataFrame, col: str) -> DataFrame:
    """A one-wide zero vector per cell when the slot is missing."""
    zero = F.array(F.lit(0.0).cast("float")).alias(col)
    if vectors is None:
        return cells.select("cell_id", zero)
    return vectors if col in vectors.columns else vectors.withColumn(col, zero)


def last_record(perturbations: DataFrame, order_col: str | None = None) -> DataFrame:
    """One record per trimmed id; the one with the largest ``order_col`` wins.

    A plain aggregate: partial results are merged on the map side, so an id
    repeated in a third of the rows does not fill one task.
    """
    tagged = perturbations.withColumn("perturbation_id", clean_text(F.col("perturbation_id")))
    others = [c for c in tagged.columns if c not in ("perturbation_id", order_col)]
    record = F.struct(*[F.col(c) for c in others])
    order = F.col(order_col) if order_col else record
    return (
        tagged.where(F.coalesce("perturbation_id", F.lit("")) != "")
        .groupBy("perturbation_id")
        .agg(F.max_by(record, order).alias("r"))
        .select("perturbation_id", "r.*")
    )


def check_perturbations(
    perturbations: DataFrame, cells: DataFrame, mode: str = "strict", order_col: str | None = None
) -> DataFrame:
    """Ids, fields, intervals, doses, and that every id used by a cell is described."""
    fix = _mode(mode) == "repair"
    rules = [Rule("perturbations", "perturbation_id.text", _blank("perturbation_id"), "records need an id")]
    rules += [_absent("perturbations", c, fix) for c in S.PERTURBATION_FIELDS if c not in perturbations.columns]
    ids = _report(perturbations, rules)

    records = last_record(perturbations, order_col)
    used = cells.select(clean_text(F.col("perturbation_id")).alias("perturbation_id")).distinct()
    dangling = _report(
        used.join(records.select("perturbation_id"), "perturbation_id", "left_anti"),
        [Rule("perturbations", "described", F.count(F.lit(1)), "ids used by cells but not described", fix)],
    )
    have = set(records.columns)
    rules = []
    start = as_double(F.col("start")) if "start" in have else None
    end = as_double(F.col("end")) if "end" in have else None
    if start is not None:
        rules.append(Rule("perturbations", "start.numeric", F.count_if(start.isNull()), "start must be numeric"))
    if end is not None:
        rules.append(Rule("perturbations", "end.numeric", F.count_if(end.isNull()), "end must be numeric"))
    if start is not None and end is not None:
        wrong = (start >= 0) & (end >= 0) & (start > end)
        rules.append(Rule("perturbations", "interval", F.count_if(wrong), "start must not be after end"))
    if "dose" in have:
        raw = clean_text(F.col("dose"))
        bad = raw.isNotNull() & (F.lower(raw) != "nan") & as_double(F.col("dose")).isNull()
        rules.append(Rule("perturbations", "dose.numeric", F.count_if(bad), "dose must be numeric or missing"))
    rules += [
        Rule("perturbations", f"{c}.text", _blank(c), f"'{c}' holds empty values")
        for c in S.PERTURBATION_TEXT_FIELDS
        if c in have
    ]
    return ids.unionByName(dangling).unionByName(_report(records, rules)) if rules else ids.unionByName(dangling)


def repair_perturbations(
    perturbations: DataFrame | None, cells: DataFrame, order_col: str | None = None
) -> DataFrame:
    """Last record per id with defaults for missing fields and undescribed ids."""
    used = cells.select(clean_text(F.col("perturbation_id")).alias("perturbation_id")).distinct()
    defaults: dict[str, Column] = {
        "target_gene": F.lit("unknown"),
        "chrom": F.lit("unknown"),
        "start": F.lit(-1).cast("bigint"),
        "end": F.lit(-1).cast("bigint"),
        "strand": F.lit("."),
        "modality": F.lit("unknown"),
        "dose": F.lit(None).cast("double"),
        "gRNA_id": F.col("perturbation_id"),
    }
    if perturbations is None:
        return used.select("perturbation_id", *[v.alias(k) for k, v in defaults.items()])
    records = last_record(perturbations, order_col).withColumn("_described", F.lit(True))
    joined = records.join(used, "perturbation_id", "full_outer")
    cols: list[Column] = []
    for name, default in defaults.items():
        if name in records.columns:
            kind = records.schema[name].dataType
            cols.append(
                F.when(F.col("_described"), F.col(name)).otherwise(default.cast(kind)).alias(name)
            )
        else:
            cols.append(default.alias(name))
    return joined.select("perturbation_id", *cols)


def check_version(spark_df: DataFrame, version: str | None, mode: str = "strict") -> DataFrame:
    """The tables carry the supported contract version."""
    fix = _mode(mode) == "repair"
    one = spark_df.sparkSession.range(1)
    if version is None:
        return _report(one, [Rule("version", "schema_version", F.count(F.lit(1)), "missing version marker", fix)])
    bad = 0 if version == S.TABLE_SCHEMA_VERSION else 1
    return _report(one, [Rule("version", "schema_version", F.lit(bad), f"unsupported version '{version}'")])


def validate(
    tables: Mapping[str, DataFrame | str | None], mode: str = "strict"
) -> tuple[dict[str, DataFrame | str | None], DataFrame]:
    """All checks over all tables; in repair mode also the repaired tables.

    ``tables`` may hold cells, genes, expr, perturbations, vectors and version.
    """
    _mode(mode)
    cells, genes, expr = tables["cells"], tables["genes"], tables["expr"]
    perts, vectors = tables.get("perturbations"), tables.get("vectors")
    fix = mode == "repair"
    report = check_counts(expr, cells, genes)
    report = report.unionByName(check_cells(cells, mode)).unionByName(check_genes(genes, mode))
    report = report.unionByName(check_layer(expr, mode))
    for col in ("sequence_embedding", "cell_state_embedding"):
        report = report.unionByName(check_embeddings(vectors, cells, col, mode=mode))
    if perts is None:
        report = report.unionByName(
            _report(cells, [_absent("perturbations", "table", fix)])
        )
    else:
        report = report.unionByName(check_perturbations(perts, cells, mode))
    report = report.unionByName(check_version(cells, tables.get("version"), mode))
    out = dict(tables)
    if fix:
        out["cells"] = repair_cells(cells, expr)
        out["genes"] = repair_genes(genes)
        out["expr"] = repair_layer(expr)
        for col in ("sequence_embedding", "cell_state_embedding"):
            vectors = repair_embeddings(vectors, cells, col)
        out["vectors"] = vectors
        out["perturbations"] = repair_perturbations(perts, cells)
        out["version"] = tables.get("version") or S.TABLE_SCHEMA_VERSION
    return out, report


def violations(report: DataFrame) -> DataFrame:
    """Checks that failed and were not repaired."""
    return report.where((F.col("n_bad") > 0) & ~F.col("repaired"))


def require_valid(report: DataFrame) -> None:
    """Raise :class:`ContractError` naming every failed check (one row per check)."""
    failed = violations(report).orderBy("check", "field").collect()
    if failed:
        raise ContractError([f"{r['check']}.{r['field']}: {r['message']} ({r['n_bad']})" for r in failed])
