"""Queries for contigs, sites and sequence windows, over whole documents and all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.functions import contig_name, placeholder_sequence, reverse_complement
from treatlens.operators import windows as W
from treatlens.plans import views as V
from treatlens.plans.registry import query
from treatlens.session import cut_lineage

SIZE = 1000
CFG = W.WindowSettings(size=SIZE)

SQL_SITES = f"""lens AS (SELECT chrom, length(seq) AS length FROM contigs WHERE length(seq) > 0),
sites AS (
  SELECT l.*, length,
    CASE WHEN lower(l.chrom) = 'unknown' THEN 'missing_or_unknown_chromosome'
      WHEN "start" < 1 OR "end" < 1 THEN 'missing_or_invalid_coordinates'
      WHEN "end" < "start" THEN 'invalid_interval_end_before_start'
      WHEN length IS NULL THEN 'chromosome_not_found_in_reference' ELSE 'ok' END AS reason
  FROM (SELECT *, upper(regexp_replace(chrom, '^chr', '', 'i')) AS chrom_n FROM loci) l
  LEFT JOIN lens c ON c.chrom = l.chrom_n),
keyed AS (SELECT *, CASE WHEN reason = 'ok' THEN left(sha256(chrom_n || ':' || "start" || ':' || "end" || ':' || strand || ':{SIZE}'), 20)
    ELSE '' END AS cache_key FROM sites),
placed AS (SELECT *, CASE WHEN reason = 'ok' THEN ("start" + "end") // 2 ELSE -1 END AS center FROM keyed),
bounds AS (SELECT *,
    CASE WHEN reason <> 'ok' THEN -1 WHEN length <= {SIZE} THEN 1
      ELSE greatest(1, least(center - {(SIZE - 1) // 2}, length - {SIZE - 1})) END AS ws FROM placed),
final AS (SELECT *, CASE WHEN reason <> 'ok' THEN -1 WHEN length <= {SIZE} THEN length ELSE ws + {SIZE - 1} END AS we
          FROM bounds),
win AS (SELECT perturbation_id, CASE WHEN reason = 'ok' THEN 'ok' ELSE 'fallback' END AS status, reason,
    chrom_n AS chrom, strand, CASE WHEN "start" = 0 THEN -1 ELSE "start" END AS locus_start,
    CASE WHEN "end" = 0 THEN -1 ELSE "end" END AS locus_end, center, ws AS window_start, we AS window_end,
    {SIZE} AS window_size_requested, cache_key,
    CASE WHEN reason <> 'ok' THEN '' WHEN strand = '-'
      THEN reverse(translate(substr(seq, ws, we - ws + 1), 'ACGTNacgtn', 'TGCANtgcan'))
      ELSE substr(seq, ws, we - ws + 1) END AS sequence,
    reason = 'ok' AND row_number() OVER (PARTITION BY cache_key ORDER BY perturbation_id) > 1 AS from_cache
  FROM final LEFT JOIN contigs c ON c.chrom = final.chrom_n)"""
SQL = V.with_sql(V.SQL_LOCI, V.SQL_CONTIGS, SQL_SITES)


def _contigs(spark: SparkSession, folder: str) -> DataFrame:
    return W.chunk_contigs(V.contig_texts(spark, folder))


def _saved_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written once: lengths and windows both read them."""
    return cut_lineage(_contigs(spark, folder), "contigs")


@query("contig_lengths", SQL + "SELECT chrom, length FROM lens")
def contig_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return W.contig_lengths(_contigs(spark, folder))


@query("available_contigs", SQL + "SELECT chrom FROM lens")
def available_contigs(spark: SparkSession, folder: str) -> DataFrame:
    return W.available_contigs(_contigs(spark, folder))


@query(
    "contig_name",
    """SELECT source, COUNT(*) AS n, upper(regexp_replace(trim(' chr' || source), '^chr', '', 'i')) AS name
    FROM documents GROUP BY source""",
)
def contig_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = V.table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return docs.withColumn("name", contig_name(F.concat(F.lit(" chr"), F.col("source"))))


@query(
    "reverse_complement",
    SQL + "SELECT chrom, sha256(reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))) AS digest FROM contigs",
)
def reverse_complements(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the opposite strand of every whole contig."""
    texts = V.contig_texts(spark, folder)
    return texts.select("chrom", F.sha2(reverse_complement(F.col("seq")), 256).alias("digest"))


@query(
    "chunk_contigs",
    SQL + f"""SELECT chrom, CAST(k AS INT) AS chunk_no, k * {W.CHUNK} + 1 AS chunk_start,
    sha256(substr(seq, k * {W.CHUNK} + 1, {W.CHUNK})) AS digest
    FROM (SELECT chrom, seq, unnest(range((length(seq) - 1) // {W.CHUNK} + 1)) AS k FROM contigs WHERE length(seq) > 0)""",
)
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _contigs(spark, folder).select(
        "chrom", "chunk_no", "chunk_start", F.sha2("seq", 256).alias("digest")
    )


@query("classify_locus", SQL + "SELECT perturbation_id, reason, cache_key FROM keyed")
def classify_locus(spark: SparkSession, folder: str) -> DataFrame:
    lengths = W.contig_lengths(_contigs(spark, folder))
    done = W.classify_locus(V.loci(spark, folder), lengths, SIZE)
    return done.select("perturbation_id", "reason", "cache_key")


@query(
    "dedup_loci",
    SQL + "SELECT cache_key, MIN(perturbation_id) AS first_id FROM keyed WHERE reason = 'ok' GROUP BY 1",
)
def dedup_loci(spark: SparkSession, folder: str) -> DataFrame:
    lengths = W.contig_lengths(_contigs(spark, folder))
    return W.dedup_loci(W.classify_locus(V.loci(spark, folder), lengths, SIZE)).select("cache_key", "first_id")


@query(
    "window_bounds",
    SQL + "SELECT perturbation_id, center, window_start, window_end FROM win WHERE status = 'ok'",
)
def window_bounds(spark: SparkSession, folder: str) -> DataFrame:
    lengths = W.contig_lengths(_contigs(spark, folder))
    ok = W.classify_locus(V.loci(spark, folder), lengths, SIZE).where(F.col("reason") == "ok")
    placed = ok.withColumn("center", F.floor((F.col("start") + F.col("end")) / 2).cast("bigint"))
    first, last = W.window_bounds(F.col("center"), F.col("length"), SIZE)
    return placed.select("perturbation_id", "center", first.alias("window_start"), last.alias("window_end"))


@query(
    "extract_windows",
    SQL
    + """SELECT perturbation_id, status, reason, chrom, strand, locus_start, locus_end, center, window_start,
    window_end, CAST(window_size_requested AS BIGINT) AS window_size_requested,
    length(sequence) AS window_size_observed, sequence, cache_key, from_cache FROM win""",
)
def extract_windows(spark: SparkSession, folder: str) -> DataFrame:
    return W.extract_windows(V.loci(spark, folder), _saved_contigs(spark, folder), CFG)


@query(
    "window_summary",
    SQL
    + """SELECT COUNT(*) AS n_total, COUNT(*) FILTER (status = 'ok') AS n_ok,
    COUNT(*) FILTER (status = 'fallback') AS n_fallback, COUNT(*) FILTER (status = 'ok' AND from_cache) AS cache_hits,
    COUNT(*) FILTER (status = 'ok' AND NOT from_cache) AS cache_misses FROM win""",
)
def window_summary(spark: SparkSession, folder: str) -> DataFrame:
    return W.window_summary(W.extract_windows(V.loci(spark, folder), _saved_contigs(spark, folder), CFG))


@query(
    "placeholder_sequence",
    """SELECT o_orderkey AS perturbation_id,
    translate(sha256(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence FROM orders""",
)
def placeholder(spark: SparkSession, folder: str) -> DataFrame:
    return V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("perturbation_id"), placeholder_sequence(F.col("o_orderkey")).alias("sequence")
    )
