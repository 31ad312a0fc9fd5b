"""Queries that write a result in its stored form, read it back and compare what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import ivgraph, metrics, splits
from treatlens.operators import windows as W
from treatlens.plans import evaluate as EV
from treatlens.plans import queries_splits, queries_windows
from treatlens.plans import views as V
from treatlens.plans.queries_baselines import NAMES, Inputs, _control
from treatlens.plans.queries_baselines import SQL as SQL_BASE
from treatlens.plans.queries_qc import rounded, with_names
from treatlens.plans.registry import query
from treatlens.session import cut_lineage, scratch_path
from treatlens.sources import stages


@query(
    "stage_table",
    V.with_sql(V.SQL_TREATMENTS) + "SELECT cell_id, perturbation_id, condition FROM cells",
)
def stage_table(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stage")
    stages.write_stage(V.treatments(spark, folder), path)
    return stages.read_stage(spark, path)


@query(
    "edge_list",
    V.with_sql(queries_splits.SQL_EDGES)
    + """SELECT source_gene_id, target_gene_id, round(weight, 3) + 0.0 AS weight, 0.0::DOUBLE AS standard_error,
    0.0::DOUBLE AS ci_lower, 0.0::DOUBLE AS ci_upper FROM est""",
)
def edge_list(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "edges")
    edges, _ = queries_splits._edge_pair(spark, folder)
    zero = {c: F.lit(0.0) for c in ("standard_error", "ci_lower", "ci_upper")}
    stages.write_edges(edges.withColumns(zero), path)
    return stages.read_edges(spark, path).withColumn("weight", rounded("weight", 3))


@query(
    "split_manifest",
    queries_splits.SQL
    + """SELECT CAST(cell_id AS VARCHAR) AS cell_id, l.shift_type, part, l.grp AS "group" FROM labels4 l
    JOIN parts p ON l.shift_type = p.shift_type AND l.grp = p.grp""",
)
def split_manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "split")
    cells = cut_lineage(V.cells(spark, folder), "cells")
    every = splits.split_all(cells, V.treatment_loci(spark, folder), queries_splits.CFG)
    counts = every.groupBy("shift_type", "part").agg(F.count(F.lit(1)).alias("n"))
    stages.write_split(every.withColumn("cell_id", F.col("cell_id").cast("string")), counts, path)
    return stages.read_split(spark, path).select(*S.ASSIGNMENT.fieldNames())


@query(
    "window_records",
    queries_windows.SQL
    + """SELECT COUNT(*) AS n_total, COUNT(*) FILTER (status = 'ok') AS n_ok, COUNT(*) FILTER (status = 'fallback') AS n_fallback,
    CAST(SUM(length(sequence)) AS BIGINT) AS letters FROM win""",
)
def window_records(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "windows")
    records = W.extract_windows(
        V.loci(spark, folder), queries_windows._saved_contigs(spark, folder), queries_windows.CFG
    )
    records = cut_lineage(records, "windows")
    stages.write_windows(records, W.window_summary(records), path)
    letters = stages.read_stage(spark, f"{path}/windows").agg(F.sum(F.length("sequence")).alias("l")).scalar()
    return spark.read.json(f"{path}/summary").select(
        "n_total", "n_ok", "n_fallback", letters.alias("letters")
    )


@query(
    "report",
    SQL_BASE
    + """SELECT 'model_card_v1' AS schema_version, round(mae, 6) + 0.0 AS mae, round(pearson_top_1000_degs, 6) + 0.0 AS pearson_top_1000_degs,
    round(calibration_error, 6) + 0.0 AS calibration_error, (SELECT COUNT(*) FROM cmp) AS n_compared,
    (SELECT string_agg(baseline_name, ',' ORDER BY baseline_mae) FROM cmp) AS compared FROM model""",
)
def report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation of the group mean, written as a report and read back."""
    path = scratch_path(spark, "report")
    data = Inputs(spark, folder)
    predictions = cut_lineage(data.predictions(), "predictions")
    moments = cut_lineage(metrics.grouped_moments(data.expr, data.cells, predictions, NAMES), "moments")
    model = moments.where(F.col("name") == "gene_level_mean")
    suite = metrics.suite_rows(moments.where(F.col("name") != "gene_level_mean"))
    rows = metrics.grouped_calibration_rows(data.expr, data.cells, predictions, "gene_level_mean")
    done = EV.evaluate(model, rows, _control(data), suite, EV.EvaluationSettings(top_k=10))
    stages.write_report(done.report, path)
    read = spark.read.json(path)
    return read.select(
        "schema_version",
        *[rounded(F.col(f"metrics.{m}")).alias(m) for m in S.REPORT_METRICS],
        F.size("baseline_comparison").cast("bigint").alias("n_compared"),
        F.array_join(F.col("baseline_comparison.baseline_name"), ",").alias("compared"),
    )


@query(
    "iv_proxies",
    V.with_sql(
        V.SQL_CELLS,
        """stats AS (SELECT AVG(library_size) AS lm, STDDEV_POP(library_size) AS ls,
    AVG(knockdown_efficiency_proxy) AS km, STDDEV_POP(knockdown_efficiency_proxy) AS ks FROM cells),
b AS (SELECT *, CASE WHEN batch = 'P' THEN 'unknown' ELSE batch END AS bt FROM cells)""",
    )
    + """SELECT cell_id, 'library_size_z' AS name, round((library_size - lm) / ls, 6) + 0.0 AS value FROM b, stats
  UNION ALL SELECT cell_id, 'knockdown_efficiency_proxy_z', round((knockdown_efficiency_proxy - km) / ks, 6) + 0.0 FROM b, stats
  UNION ALL SELECT cell_id, 'batch=' || bt, 1.0 FROM b
  UNION ALL SELECT cell_id, 'protocol=' || protocol, 1.0 FROM b""",
)
def iv_proxies(spark: SparkSession, folder: str) -> DataFrame:
    """Proxies of the two-stage fit; one batch is blank and becomes a category of its own."""
    cells = cut_lineage(V.cells(spark, folder), "cells")
    blank = F.when(F.col("batch") == "P", "  ").otherwise(F.col("batch"))
    packed, names = ivgraph.proxies(cells.withColumn("batch", blank))
    opened = packed.select("cell_id", F.explode(F.arrays_zip("widx", "wval")).alias("e"))
    named = with_names(opened.select("cell_id", F.col("e.widx").alias("i"), F.col("e.wval").alias("v")), names)
    return named.select("cell_id", "name", rounded("v").alias("value"))
