"""FASTA files as chunked contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treatlens.functions import clean_text, contig_name
from treatlens.operators.windows import CHUNK
from treatlens.session import broadcast_if_small, clustered, cut_lineage
from treatlens.sources.numbering import scan_positions

#: Lines that are sorted together.
RUN_LINES = 16_384


def _before(parts: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """``value`` taken over all earlier runs of lines of the same keys."""
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_run", value.over(earlier).alias(out))


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk_no, chunk_start, seq) from plain or gzip FASTA text.

    The header of a line is the last one above it. Lines are taken in runs of
    ``RUN_LINES``, and runs are dealt out evenly, so the memory of a task follows
    neither the file nor its splits. The header is found within a run and, for the
    lines before a run's first header, from the runs before it, so a contig may
    span any number of runs and is never held as one value. A repeated header
    continues its contig. A gzip file cannot be split and is read by one task.
    """
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), clean_text(F.col("value")).alias("line")
    )
    rows = scan_positions(lines.where(F.col("line") != ""))
    header = F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S+)", 1))
    # Splits are numbered in the order of files, so runs are in the order of the lines.
    run = F.shiftleft("_part", 32) + F.floor(F.col("_pos") / RUN_LINES)
    tagged = rows.select("file", run.alias("_run"), "_pos", "line", header.alias("_h"))
    n_lines = rows.count()

    within = Window.partitionBy("_run").orderBy("_pos")
    # One row per run.
    last = tagged.groupBy("_run").agg(F.first("file").alias("file"), F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("_pos"))).alias("_l"))
    carried = broadcast_if_small(_before(last, ["file"], F.last("_l", ignorenulls=True), "_c").drop("file"))
    named = clustered(tagged.drop("file"), "_run", n_lines).join(carried, "_run").select(
        "_run",
        "_pos",
        "line",
        F.col("_h").isNotNull().alias("_is_header"),
        F.coalesce(F.last("_h", ignorenulls=True).over(within), "_c").alias("_name"),
    )
    saved = cut_lineage(named, "fasta")
    facts = saved.agg(
        F.count_if("_is_header").alias("headers"),
        F.count_if(~F.col("_is_header") & F.col("_name").isNull()).alias("orphans"),
    ).first()
    if facts["orphans"]:
        raise ValueError(f"sequence text before the first header in {path}")
    if not facts["headers"]:
        raise ValueError(f"no contig in {path}")

    body = saved.where(~F.col("_is_header")).select(
        contig_name(F.col("_name")).alias("chrom"), "_run", "_pos", F.upper("line").alias("line")
    )
    # Offset of each line within its contig: earlier lines of this run
    # plus the totals of the runs before it.
    per_run = body.groupBy("chrom", "_run").agg(F.sum(F.length("line")).alias("_n"))
    offsets = _before(per_run, ["chrom"], F.sum("_n"), "_o").select("chrom", "_run", F.coalesce("_o", F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_run", "chrom").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        clustered(body, "_run", n_lines)
        .withColumn("_in", F.coalesce(F.sum(F.length("line")).over(inside), F.lit(0)))
        .join(broadcast_if_small(offsets), ["chrom", "_run"])
        .withColumn("_at", F.col("_o") + F.col("_in"))
    )
    span = F.sequence(
        F.floor(F.col("_at") / chunk).cast("int"),
        F.floor((F.col("_at") + F.length("line") - 1) / chunk).cast("int"),
    )
    pieces = placed.select("chrom", "_at", "line", F.explode(span).alias("chunk_no"))
    first = F.greatest(F.col("chunk_no").cast("bigint") * chunk - F.col("_at"), F.lit(0))
    stop = F.least((F.col("chunk_no").cast("bigint") + 1) * chunk - F.col("_at"), F.length("line").cast("bigint"))
    cut = pieces.select(
        "chrom", "chunk_no", F.col("_at"), F.substring("line", (first + 1).cast("int"), (stop - first).cast("int")).alias("piece")
    )
    return cut.groupBy("chrom", "chunk_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_at", "piece")))["piece"], "").alias("seq")
    ).select("chrom", "chunk_no", (F.col("chunk_no").cast("bigint") * chunk + 1).alias("chunk_start"), "seq")
