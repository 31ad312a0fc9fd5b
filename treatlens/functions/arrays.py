"""Expressions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _mean(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(v) > 0, total / F.size(v)).otherwise(F.lit(0.0))


def row_standardise(v: Column) -> Column:
    """Vector minus its mean, divided by its population spread (1 when flat)."""
    wide = v.cast("array<double>")

    def scale(centred: Column) -> Column:
        spread = F.sqrt(_mean(F.transform(centred, lambda x: x * x)))
        safe = F.when(spread <= 1e-8, F.lit(1.0)).otherwise(spread)
        return _let(safe, lambda s: F.transform(centred, lambda x: x / s))

    return _let(_mean(wide), lambda m: _let(F.transform(wide, lambda x: x - m), scale))


def _uniform(*keys: Column) -> Column:
    """Value in (0, 1) from a hash of the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double")
    return (bits + 0.5) / F.lit(float(2**53))


def gaussian_from_hash(seed: int, *keys: Column) -> Column:
    """Standard normal value that depends on seed and keys only."""
    first = _uniform(F.lit(seed), F.lit("radius"), *keys)
    second = _uniform(F.lit(seed), F.lit("angle"), *keys)
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * second)
