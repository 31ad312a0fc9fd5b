"""Ranks, running totals and quantiles over a whole table without one big task.

A window without a partition key would move every row into one task. These
helpers sort by range partitions instead, count each partition, and shift local
positions by the totals of the partitions before it. The range-sorted frame is
written once to the checkpoint folder, so both passes see the same partitions
even when executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treatlens.session import cut_lineage

_PART = "_part"
_POS = "_pos"


def _range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = placed.withColumn("_mid", F.monotonically_increasing_id())
    return cut_lineage(
        tagged.select(
            *df.columns,
            F.shiftright("_mid", 33).alias(_PART),
            F.col("_mid").bitwiseAND(2**33 - 1).alias(_POS),
        )
    )


def _totals_before(parts: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Sum of each column over all earlier partitions; one row per partition."""
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        _PART, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums]
    )


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Zero-based position in the total order; ``order`` must end in a unique key.

    The unique key also takes part in the range bounds, so a value shared by a
    third of the rows is spread over many partitions.
    """
    placed = _range_sorted(df, order)
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    # One row per range partition: its size is the partition count, not the data.
    offsets = F.broadcast(_totals_before(sizes, ["n"]))
    return placed.join(offsets, _PART).select(
        *df.columns, (F.col("_before_n") + F.col(_POS)).cast("bigint").alias(out)
    )


def running_totals(df: DataFrame, key: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Inclusive running sums by ``key``; rows of one key are added up first.

    Adds ``cum_<column>`` for every column in ``sums``. The first aggregation
    combines on the map side, so a heavily repeated key costs one row per task.
    """
    per_key = df.groupBy(key).agg(*[F.sum(s).alias(s) for s in sums])
    order = F.col(key).desc() if descending else F.col(key).asc()
    placed = _range_sorted(per_key, [order])
    parts = placed.groupBy(_PART).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = F.broadcast(_totals_before(parts, sums))
    local = (
        Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.select(
        key, _PART, *sums, *[F.sum(s).over(local).alias(f"_local_{s}") for s in sums]
    )
    return summed.join(offsets, _PART).select(
        key, *sums, *[(F.col(f"_local_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums]
    )


def weighted_quantiles(
    df: DataFrame, value: str, weight: str, probs: Sequence[float]
) -> list[float]:
    """Exact linear-interpolation quantiles where each row stands for ``weight`` equal values.

    Only the few rows around each wanted rank reach the driver.
    """
    totals = cut_lineage(running_totals(df.where(F.col(weight) > 0), value, [weight]))
    size = totals.agg(F.sum(weight)).first()[0]
    if size is None:
        return []
    spots = [p * (int(size) - 1) for p in probs]
    wanted = sorted({int(s) for s in spots} | {min(int(s) + 1, int(size) - 1) for s in spots})
    first = F.col(f"cum_{weight}") - F.col(weight)
    ranks = F.array(*[F.lit(w).cast("bigint") for w in wanted])
    hits = totals.select(
        value,
        F.explode(
            F.filter(ranks, lambda r: (r >= first) & (r < F.col(f"cum_{weight}")))
        ).alias("rank"),
    )
    found = {int(row["rank"]): float(row[value]) for row in hits.collect()}
    out = []
    for spot in spots:
        low = int(spot)
        high = min(low + 1, int(size) - 1)
        out.append(found[low] + (found[high] - found[low]) * (spot - low))
    return out


def hash_rank(
    df: DataFrame, hash_col: str, unique: str, out: str, within: Sequence[str] = ()
) -> DataFrame:
    """One-based position in the order of a hexadecimal hash column, per ``within`` keys.

    Hash prefixes are evenly spread, so the 4,096 prefix buckets give balanced
    local sorts and an offset table of fixed size; nothing is sampled or written.
    """
    bucketed = df.withColumn("_prefix", F.substring(hash_col, 1, 3))
    keys = [*within, "_prefix"]
    sizes = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*within).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    if not within:
        offsets = F.broadcast(offsets)
    local = Window.partitionBy(*keys).orderBy(hash_col, unique)
    return (
        bucketed.withColumn("_pos", F.row_number().over(local))
        .join(offsets, keys)
        .select(*df.columns, (F.col("_before") + F.col("_pos")).cast("bigint").alias(out))
    )
