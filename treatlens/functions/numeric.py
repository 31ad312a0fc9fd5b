"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.functions.text import clean_text

# Text accepted as a number must end in a digit or a point, or spell infinity;
# the JVM parser alone would also accept suffixes such as "1d".
_NUMBER_END = r"(?i)([0-9.]|^[+-]?inf(inity)?)$"


def as_double(col: Column) -> Column:
    """Lenient parse: NULL for anything that is not a number, and for NaN."""
    text = clean_text(col)
    value = F.when(text.rlike(_NUMBER_END), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def as_int(col: Column) -> Column:
    """Lenient integer: parse as a double, cut the fraction."""
    return as_double(col).try_cast("bigint")


def coerce_counts(col: Column) -> Column:
    """Count from text: bad and negative values give 0, halves go to the even side."""
    value = F.greatest(F.coalesce(as_double(col), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.bround(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def log1p_scaled(count: Column, library: Column, target_sum: float) -> Column:
    """``log1p(count / max(library, 1) * target_sum)``."""
    return F.log1p(count / F.greatest(library.cast("double"), F.lit(1.0)) * F.lit(float(target_sum)))


def zscore(df: DataFrame, col: str, out: str, tiny: float = 1e-8) -> DataFrame:
    """Population z-score of one column; all zeros when its spread is ``tiny`` or less.

    Mean and spread come from one aggregate whose single row is read as a
    scalar subquery, so no row of ``df`` is shuffled for it.
    """
    value = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    moments = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).alias("ms"))
    ms = moments.scalar()
    flat = F.coalesce(ms.getField("s"), F.lit(0.0)) <= tiny
    return df.withColumn(
        out, F.when(flat, F.lit(0.0)).otherwise((value - ms.getField("m")) / ms.getField("s"))
    )
