"""Sequence windows around treatment sites, cut from chunked contigs.

Contigs are stored as fixed-size chunks ``(chrom, chunk_no, chunk_start, seq)``.
A window touches few chunks, so the range join becomes an equi-join on
``(chrom, chunk_no)`` and no contig is ever broadcast or held whole by a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.functions import as_int, clean_text, contig_name, locus_key, reverse_complement
from treatlens.session import cut_lineage

CHUNK = 4096

# Why a treatment has no window, in the order the rules apply.
UNKNOWN_CONTIG = "missing_or_unknown_chromosome"
BAD_COORDINATES = "missing_or_invalid_coordinates"
REVERSED_SITE = "invalid_interval_end_before_start"
ABSENT_CONTIG = "chromosome_not_found_in_reference"
EMPTY_WINDOW = "empty_window_after_bounds"


@dataclass(frozen=True)
class WindowSettings:
    """Window length and its bounds."""

    size: int = 2000
    low: int = 1000
    high: int = 2000
    include_sequence: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.low <= self.high:
            raise ValueError("window bounds must be positive and ordered")
        if not self.low <= self.size <= self.high:
            raise ValueError(f"window size must lie within [{self.low}, {self.high}]")


def chunk_contigs(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of whole contig texts (chrom, seq); names are normalised, letters upper-cased."""
    # One pattern match cuts a text in a single pass; a substring per chunk
    # would count letters from the start of the contig every time.
    cut = F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return texts.select(contig_name(F.col("chrom")).alias("chrom"), F.posexplode(cut).alias("chunk_no", "seq")).select(
        "chrom", "chunk_no", (F.col("chunk_no").cast("bigint") * chunk + 1).alias("chunk_start"), "seq"
    )


def contig_lengths(contigs: DataFrame) -> DataFrame:
    """(chrom, length)."""
    return contigs.groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))


def available_contigs(contigs: DataFrame) -> DataFrame:
    """Sorted contig names."""
    return contigs.select("chrom").distinct().orderBy("chrom")


def classify_locus(perts: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """Parsed site of each treatment with ``reason`` (``ok`` or the first failing rule).

    Columns: perturbation_id, chrom_raw, strand, start, end, length, reason, cache_key.
    """
    chrom = clean_text(F.col("chrom"))
    strand = clean_text(F.col("strand"))
    parsed = perts.select(
        F.when(F.coalesce(clean_text(F.col("perturbation_id")), F.lit("")) == "", "unknown")
        .otherwise(clean_text(F.col("perturbation_id")))
        .alias("perturbation_id"),
        F.coalesce(chrom, F.lit("")).alias("chrom_raw"),
        F.when(F.coalesce(strand, F.lit("")) == "", "+").otherwise(strand).alias("strand"),
        as_int(F.col("start")).alias("start"),
        as_int(F.col("end")).alias("end"),
    )
    # A blank or unknown contig meets no reference name, so it needs no partner.
    known = lengths.select(F.col("chrom").alias("_name"), "length")
    joined = parsed.withColumn("_name", contig_name(F.col("chrom_raw"))).join(known, "_name", "left")
    reason = (
        F.when((F.col("chrom_raw") == "") | (F.lower("chrom_raw") == "unknown"), UNKNOWN_CONTIG)
        .when(
            F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 1) | (F.col("end") < 1),
            BAD_COORDINATES,
        )
        .when(F.col("end") < F.col("start"), REVERSED_SITE)
        .when(F.col("length").isNull(), ABSENT_CONTIG)
        .when(F.col("length") <= 0, EMPTY_WINDOW)
        .otherwise("ok")
    )
    key = locus_key(F.col("chrom_raw"), F.col("start"), F.col("end"), F.col("strand"), size)
    return joined.withColumn("reason", reason).select(
        "perturbation_id",
        "chrom_raw",
        "strand",
        "start",
        "end",
        "length",
        "reason",
        F.when(F.col("reason") == "ok", key).otherwise("").alias("cache_key"),
    )


def window_bounds(center: Column, length: Column, size: int) -> tuple[Column, Column]:
    """First and last position (1-based, inclusive) of the window around ``center``.

    Short contigs are taken whole; a window over either end is shifted inside.
    """
    left = (size - 1) // 2
    latest = length - (size - 1)
    first = F.greatest(F.lit(1), F.least(center - left, latest))
    return (
        F.when(length <= size, F.lit(1)).otherwise(first).cast("bigint"),
        F.when(length <= size, length).otherwise(first + (size - 1)).cast("bigint"),
    )


def dedup_loci(loci: DataFrame) -> DataFrame:
    """One row per distinct usable site, with the smallest id that asked for it.

    A plain aggregate: a site shared by a third of the treatments is combined
    on the map side.
    """
    return (
        loci.where(F.col("reason") == "ok")
        .groupBy("cache_key")
        .agg(
            F.first("chrom_raw").alias("chrom_raw"),
            F.first("strand").alias("strand"),
            F.first("start").alias("start"),
            F.first("end").alias("end"),
            F.first("length").alias("length"),
            F.min("perturbation_id").alias("first_id"),
        )
    )


def _cut(distinct: DataFrame, contigs: DataFrame, size: int, chunk: int) -> DataFrame:
    center = F.floor((F.col("start") + F.col("end")) / 2).cast("bigint")
    placed = distinct.withColumn("center", center)
    first, last = window_bounds(F.col("center"), F.col("length"), size)
    placed = placed.withColumn("window_start", first).withColumn("window_end", last)
    span = F.sequence(
        F.floor((F.col("window_start") - 1) / chunk).cast("int"),
        F.floor((F.col("window_end") - 1) / chunk).cast("int"),
    )
    touched = placed.select(
        "cache_key",
        contig_name(F.col("chrom_raw")).alias("chrom"),
        "window_start",
        "window_end",
        F.explode(span).alias("chunk_no"),
    )
    # Only the letters inside the window leave the join.
    offset = F.greatest(F.col("window_start") - F.col("chunk_start"), F.lit(0)) + 1
    stop = F.least(F.col("window_end") - F.col("chunk_start") + 1, F.length("seq"))
    pieces = touched.join(contigs, ["chrom", "chunk_no"]).select(
        "cache_key",
        "chunk_no",
        F.substring("seq", offset.cast("int"), (stop - offset + 1).cast("int")).alias("piece"),
    )
    text = pieces.groupBy("cache_key").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk_no", "piece")))["piece"], "").alias("window")
    )
    oriented = F.when(F.col("strand") == "-", reverse_complement(F.col("window"))).otherwise(F.col("window"))
    return placed.join(text, "cache_key").select(
        "cache_key", "first_id", "center", "window_start", "window_end", oriented.alias("sequence")
    )


def extract_windows(
    perts: DataFrame, contigs: DataFrame, cfg: WindowSettings | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One window record per treatment, cut once per distinct site.

    ``perturbation_id`` must be unique, as the contract asks; ``from_cache`` is
    true for every id but the smallest that shares a site. ``chunk`` is the
    chunk size of ``contigs``.
    """
    cfg = cfg or WindowSettings()
    loci = cut_lineage(classify_locus(perts, contig_lengths(contigs), cfg.size), "loci")
    cut = _cut(dedup_loci(loci), contigs, cfg.size, chunk)
    ok = F.col("reason") == "ok"
    # Fallback loci share one empty key, so they pass by the join.
    joined = loci.where(ok).join(cut, "cache_key", "left").unionByName(loci.where(~ok), allowMissingColumns=True)

    def or_missing(col: str) -> Column:
        value = F.col(col)
        return F.when(value.isNull() | (value == 0), F.lit(-1)).otherwise(value).cast("bigint")

    return joined.select(
        "perturbation_id",
        F.when(ok, "ok").otherwise("fallback").alias("status"),
        "reason",
        F.when(F.col("chrom_raw") == "", "UNKNOWN").otherwise(contig_name(F.col("chrom_raw"))).alias("chrom"),
        "strand",
        or_missing("start").alias("locus_start"),
        or_missing("end").alias("locus_end"),
        F.coalesce("center", F.lit(-1).cast("bigint")).alias("center"),
        F.coalesce("window_start", F.lit(-1).cast("bigint")).alias("window_start"),
        F.coalesce("window_end", F.lit(-1).cast("bigint")).alias("window_end"),
        F.lit(cfg.size).cast("bigint").alias("window_size_requested"),
        F.coalesce(F.length("sequence"), F.lit(0)).cast("bigint").alias("window_size_observed"),
        (F.coalesce("sequence", F.lit("")) if cfg.include_sequence else F.lit("")).alias("sequence"),
        "cache_key",
        (ok & (F.col("perturbation_id") != F.coalesce("first_id", F.col("perturbation_id")))).alias("from_cache"),
    )


def window_summary(windows: DataFrame) -> DataFrame:
    """One row: totals by status, and how many sites were shared or cut anew."""
    ok = F.col("status") == "ok"
    return windows.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col("status") == "fallback").alias("n_fallback"),
        F.count_if(ok & F.col("from_cache")).alias("cache_hits"),
        F.count_if(ok & ~F.col("from_cache")).alias("cache_misses"),
    )
