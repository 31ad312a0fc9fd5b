"""Stage tables, cached builds, and the written forms of splits, windows, edges and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens import schema as S

HASHED_WHOLE = 1 << 30


def write_stage(df: DataFrame, path: str) -> None:
    """Save a stage table, replacing an earlier one."""
    df.write.mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A stage table saved earlier."""
    return spark.read.parquet(path)


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    """sha256 of one file of any size, from any store that Spark reads, in constant memory."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """sha256 of a source; of the joined file hashes when it has several files.

    Files of every size are identified by their content. Those of 1 GB or more do
    not fit one row; their bytes pass through the driver's JVM one after the
    other, with the same result. The length filter reaches the file source.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") < HASHED_WHOLE).select("path", F.sha2("content", 256).alias("h"))
    large = [
        (r["path"], _streamed_sha256(spark, r["path"]))
        for r in files.where(F.col("length") >= HASHED_WHOLE).select("path").toLocalIterator()
    ]
    hashes = small.unionByName(spark.createDataFrame(large, "path string, h string")) if large else small
    row = hashes.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("h").alias("one"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|"), 256).alias("many"),
    ).first()
    if row["n"] == 0:
        raise ValueError(f"no source file at {path}")
    return row["one"] if row["n"] == 1 else row["many"]


def cache_key(checksum: str, cap: int | None) -> str:
    """Name of a processed table: head of the checksum and the cap."""
    return f"{checksum[:16]}_" + ("capall" if cap is None else f"cap{cap}")


def reuse_or_build(
    spark: SparkSession,
    cache_dir: str,
    source: str,
    cap: int | None,
    build: Callable[[], dict[str, DataFrame]],
    version: str = S.HARMONISATION_VERSION,
    refresh: bool = False,
) -> tuple[dict[str, DataFrame], bool]:
    """Tables of a processed source, read back when checksum, cap and version match.

    Returns the tables and whether they came from the cache. The manifest is
    written last, so an interrupted build is not taken for a finished one.
    """
    checksum = source_fingerprint(spark, source)
    root = f"{cache_dir}/{cache_key(checksum, cap)}"
    manifest_path = f"{root}/manifest"
    if not refresh:
        try:
            schema = "checksum_sha256 string, max_cells bigint, harmonization_version string, names array<string>"
            found = spark.read.schema(schema).json(manifest_path).first()
        except AnalysisException:
            found = None
        if (
            found is not None
            and found["checksum_sha256"] == checksum
            and found["harmonization_version"] == version
            and found["max_cells"] == cap
        ):
            return {n: read_stage(spark, f"{root}/{n}") for n in found["names"]}, True
    tables = build()
    for name, df in tables.items():
        write_stage(df, f"{root}/{name}")
    manifest = spark.range(1).select(
        F.lit(checksum).alias("checksum_sha256"),
        F.lit(cap).cast("bigint").alias("max_cells"),
        F.lit(version).alias("harmonization_version"),
        F.array(*[F.lit(n) for n in tables]).alias("names"),
        F.lit(source).alias("raw_path"),
    )
    manifest.write.mode("overwrite").json(manifest_path)
    return {n: read_stage(spark, f"{root}/{n}") for n in tables}, False


def write_edges(edges: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Edge list as CSV with a header, and its metadata row as JSON."""
    edges.write.mode("overwrite").csv(f"{path}/edges", header=True)
    if metadata is not None:
        tagged = metadata.withColumn("schema_version", F.lit(S.GRAPH_VERSION))
        tagged.write.mode("overwrite").json(f"{path}/metadata")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge list written by :func:`write_edges`."""
    return spark.read.schema(S.EDGES).csv(f"{path}/edges", header=True)


def write_split(assignment: DataFrame, provenance: DataFrame, path: str) -> None:
    """Assignment rows and the provenance row as JSON, one folder per shift type."""
    assignment.write.mode("overwrite").partitionBy("shift_type").json(f"{path}/assignment")
    provenance.write.mode("overwrite").json(f"{path}/provenance")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Assignment rows with their types restored; an unknown shift type or part is an error."""
    rows = spark.read.schema(S.ASSIGNMENT).json(f"{path}/assignment")
    bad = rows.where(~F.col("shift_type").isin(*S.SHIFT_TYPES) | ~F.col("part").isin(*S.SPLIT_PARTS))
    if not bad.isEmpty():
        raise ValueError("the split names an unknown shift type or part")
    return rows


def write_windows(windows: DataFrame, summary: DataFrame, path: str) -> None:
    """Window records as parquet and their summary row as JSON."""
    write_stage(windows, f"{path}/windows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON, after its completeness check."""
    missing = report_errors(report).first()["errors"]
    if missing:
        raise ValueError("the report is incomplete:\n- " + "\n- ".join(missing))
    report.write.mode("overwrite").json(path)


def report_errors(report: DataFrame) -> DataFrame:
    """One row with the list of what a report lacks: version, sections, metrics, rows."""
    cols = set(report.columns)
    rules = []
    if "schema_version" not in cols:
        rules.append(F.lit("unsupported schema version"))
    else:
        rules.append(
            F.when(F.coalesce(F.col("schema_version"), F.lit("")) != S.CARD_VERSION, "unsupported schema version")
        )
    for section in ("metrics", "baseline_comparison", "failure_modes", "metadata"):
        if section not in cols:
            rules.append(F.lit(f"missing section {section}"))
    if "metrics" in cols:
        have = report.schema["metrics"].dataType.fieldNames()
        for metric in S.REPORT_METRICS:
            if metric not in have:
                rules.append(F.lit(f"missing metric {metric}"))
            else:
                bad = F.col(f"metrics.{metric}").try_cast("double").isNull()
                rules.append(F.when(bad, f"metric {metric} is not numeric"))
    for section in ("baseline_comparison", "failure_modes"):
        if section in cols:
            rules.append(F.when(F.coalesce(F.size(section), F.lit(0)) <= 0, f"section {section} is empty"))
    return report.select(F.filter(F.array(*rules), lambda e: e.isNotNull()).alias("errors"))
