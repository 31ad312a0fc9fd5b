"""Wide count tables: one row per cell, reserved columns plus one column per gene."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.functions import as_int
from treatlens.operators.layout import (
    default_perturbations,
    harmonise_cells,
    harmonise_genes,
    resolve_cap,
    sample_cap,
    to_long,
)
from treatlens.operators.qc import cell_totals, normalise_log1p
from treatlens.session import cut_lineage
from treatlens.sources.numbering import row_numbers

# The known sources and their defaults.
SPECS: dict[str, dict[str, object]] = {
    "adamson": {
        "cell_type": "K562",
        "protocol": "perturbseq_adamson_2016",
        "batch_prefix": "adamson_batch",
        "hard_cap": None,
        "seed": 42,
    },
    "replogle_sample": {
        "cell_type": "K562",
        "protocol": "perturbseq_replogle_2022",
        "batch_prefix": "replogle_batch",
        "hard_cap": None,
        "seed": 42,
    },
}


def fill_ids(df: DataFrame, dataset: str) -> DataFrame:
    """Add the id columns a raw table lacks: numbered cells, ``unassigned`` treatments."""
    out = df
    if "cell_id" not in df.columns:
        numbered = row_numbers(df, "_row")
        text = F.col("_row").cast("string")
        padded = F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0"))
        out = numbered.withColumn("cell_id", F.concat(F.lit(f"{dataset}_cell_"), padded)).drop("_row")
    if "perturbation_id" not in df.columns:
        out = out.withColumn("perturbation_id", F.lit("unassigned"))
    return out


def gene_columns(columns: list[str]) -> list[str]:
    """Every column outside the reserved cell columns."""
    return [c for c in columns if c not in S.CELL_COLUMNS]


def load_entity_table(
    spark: SparkSession,
    uri: str,
    dataset: str,
    spec: Mapping[str, object] | None = None,
    max_entities: int | None = None,
) -> dict[str, DataFrame | str | None]:
    """Cells, genes, counts with normalised values and treatments of a wide CSV file.

    A cap below the number of rows takes a uniform sample by hash of seed and
    cell id. Zeros are dropped from the count table.
    """
    spec = dict(spec or SPECS[dataset])
    cap, lowered = resolve_cap(max_entities, spec.get("hard_cap"))
    if lowered:
        warnings.warn(f"the requested cap {max_entities} exceeds the cap of '{dataset}'; using {cap}", stacklevel=2)
    raw = spark.read.csv(uri, header=True, inferSchema=False)
    genes = gene_columns(raw.columns)
    if not genes:
        raise ValueError(f"the table of '{dataset}' has no gene count column")
    if raw.isEmpty():
        raise ValueError(f"the table of '{dataset}' is empty")
    table = fill_ids(raw, dataset)
    if cap is not None:
        table = sample_cap(table, int(cap), int(spec.get("seed", 42)))
    reserved = [c for c in table.columns if c in S.CELL_COLUMNS]
    counts = cut_lineage(to_long(table, ["cell_id"], genes), "counts")
    totals = cell_totals(counts).select("cell_id", F.col("library_size").alias("computed_library"))
    base = table.select(*reserved).join(totals, "cell_id", "left").na.fill(0, ["computed_library"])
    cells = harmonise_cells(base, {k: str(v) for k, v in spec.items()})
    gene_rows = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in genes])).alias("gene_id"))
    return {
        "cells": cells,
        "genes": harmonise_genes(gene_rows),
        "expr": normalise_log1p(counts),
        "perturbations": default_perturbations(cells),
        "vectors": cells.select(
            "cell_id",
            F.array(F.lit(0.0).cast("float")).alias("sequence_embedding"),
            F.array(F.lit(0.0).cast("float")).alias("cell_state_embedding"),
        ),
        "version": S.TABLE_SCHEMA_VERSION,
    }


def load_metadata(tables: Mapping[str, DataFrame | str | None], cap: int | None) -> DataFrame:
    """One row about a loaded table: sizes and the cap in force."""
    cells, genes = tables["cells"], tables["genes"]
    return cells.agg(F.count(F.lit(1)).alias("n_obs")).select(
        F.col("n_obs").alias("n_rows_raw"),
        "n_obs",
        genes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_vars"),
        as_int(F.lit(cap)).alias("max_cells_applied"),
    )
