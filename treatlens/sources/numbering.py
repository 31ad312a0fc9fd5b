"""Row numbers in scan order."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treatlens.session import cut_lineage


def _place(df: DataFrame) -> tuple[Column, Column] | None:
    """File and offset of the split a row was read from; None if the rows do not come straight from files."""
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["file_path"])  # analysis only
    except (AnalysisException, PySparkException):
        return None
    return meta["file_path"], meta["file_block_start"]


def scan_positions(df: DataFrame) -> DataFrame:
    """Add ``_part`` and ``_pos``: the number of the split a row comes from, and the place within it.

    Splits count in the order of files by path and of offsets within a file,
    however the scan packs them into tasks; the rows of a split stay together.
    Rows that do not come straight from files count by partition. The result is
    written once, so a repeated task cannot number rows anew.
    """
    place = _place(df)
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    if place is None:
        part, pos = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(2**33 - 1)
        return cut_lineage(tagged.select(*df.columns, part.alias("_part"), pos.alias("_pos")), "scan")
    file, start = place
    written = cut_lineage(df.select(*df.columns, file.alias("_file"), start.alias("_start"), F.monotonically_increasing_id().alias("_mid")), "scan")
    first = written.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"))
    # One row per split.
    numbered = first.select("*", (F.row_number().over(Window.orderBy("_file", "_start")) - 1).cast("long").alias("_part"))
    return written.join(F.broadcast(numbered), ["_file", "_start"]).select(*df.columns, "_part", (F.col("_mid") - F.col("_first")).alias("_pos"))


def row_numbers(df: DataFrame, out: str) -> DataFrame:
    """Zero-based row number in the order of files and of rows within them.

    Only one count per split is brought together, so the numbering needs
    no sort and no single task over the rows.
    """
    placed = scan_positions(df)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")))
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + F.col("_pos")).cast("bigint").alias(out)
    )
