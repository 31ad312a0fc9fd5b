"""Column contracts of the tables and version markers of the written artifacts."""

from __future__ import annotations

from pyspark.sql import types as T

# Required columns of each table.
CELL_COLUMNS = (
    "cell_id",
    "cell_type",
    "batch",
    "condition",
    "protocol",
    "library_size",
    "perturbation_id",
    "knockdown_efficiency_proxy",
)
CELL_TEXT_COLUMNS = ("cell_id", "cell_type", "batch", "condition", "protocol", "perturbation_id")
GENE_COLUMNS = ("gene_id", "gene_symbol", "chrom", "strand", "tss")
GENE_TEXT_COLUMNS = ("gene_id", "gene_symbol", "chrom", "strand")
PERTURBATION_FIELDS = (
    "target_gene",
    "chrom",
    "start",
    "end",
    "strand",
    "modality",
    "dose",
    "gRNA_id",
)
PERTURBATION_TEXT_FIELDS = ("target_gene", "chrom", "strand", "modality", "gRNA_id")
PROXY_SOURCE_COLUMNS = ("batch", "library_size", "knockdown_efficiency_proxy", "protocol")
BASELINE_NAMES = ("gene_level_mean", "control_mean", "linear_regression", "random_edge_grn")
SHIFT_TYPES = ("cell_type", "locus", "dose_strength", "protocol")
SPLIT_PARTS = ("train", "val", "test")
STAGES = ("ingest", "preprocess", "embed", "train", "causal", "evaluate", "card")
REPORT_METRICS = ("mae", "pearson_top_1000_degs", "calibration_error")

# Version markers.
TABLE_SCHEMA_VERSION = "anndata_v1"
HARMONISATION_VERSION = "phase5_v1"
SUITE_VERSION = "baseline_suite_v1"
GRAPH_VERSION = "causal_graph_v1"
SPLIT_VERSION = "shift_split_manifest_v1"
REPORT_VERSION = "evaluation_report_v1"
CARD_VERSION = "model_card_v1"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


CELLS = _struct(
    cell_id=T.StringType(),
    cell_type=T.StringType(),
    batch=T.StringType(),
    condition=T.StringType(),
    protocol=T.StringType(),
    library_size=T.DoubleType(),
    perturbation_id=T.StringType(),
    knockdown_efficiency_proxy=T.DoubleType(),
)
GENES = _struct(
    gene_id=T.StringType(),
    gene_symbol=T.StringType(),
    chrom=T.StringType(),
    strand=T.StringType(),
    tss=T.LongType(),
)
EXPR = _struct(
    cell_id=T.StringType(), gene_id=T.StringType(), count=T.LongType(), z=T.DoubleType()
)
PERTURBATIONS = _struct(
    perturbation_id=T.StringType(),
    target_gene=T.StringType(),
    chrom=T.StringType(),
    start=T.LongType(),
    end=T.LongType(),
    strand=T.StringType(),
    modality=T.StringType(),
    dose=T.DoubleType(),
    gRNA_id=T.StringType(),
)
CONTIGS = _struct(
    chrom=T.StringType(), chunk_no=T.IntegerType(), chunk_start=T.LongType(), seq=T.StringType()
)
ASSIGNMENT = _struct(
    cell_id=T.StringType(), shift_type=T.StringType(), part=T.StringType(), group=T.StringType()
)
EDGES = _struct(
    source_gene_id=T.StringType(),
    target_gene_id=T.StringType(),
    weight=T.DoubleType(),
    standard_error=T.DoubleType(),
    ci_lower=T.DoubleType(),
    ci_upper=T.DoubleType(),
)
SUITE = _struct(
    baseline=T.StringType(), task=T.StringType(), metric=T.StringType(), value=T.DoubleType()
)
CHECK = _struct(
    check=T.StringType(),
    field=T.StringType(),
    n_bad=T.LongType(),
    message=T.StringType(),
    repaired=T.BooleanType(),
)
