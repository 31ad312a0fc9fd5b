"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are summed to a table of cells (one per combination of axis
values), raked to the target marginals, and every document is kept with the
probability of its cell. Values without a target are pooled, so the number of
cells is bounded by the targets that the caller names, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens.llm.tables import WORD, packed

#: Axis (column) -> value -> share of all tokens.
Targets = Mapping[str, Mapping[str, float]]
OTHER = "(other)"
#: Most cells one mix may have; they are raked in one row and broadcast.
MAX_CELLS = 20_000


def pooled(column: Column, values: Mapping[str, float]) -> Column:
    """The value itself if it has a target, else ``(other)``; null counts as ``(other)``."""
    return F.when(column.isin(*values), column).otherwise(F.lit(OTHER))


def _shares(values: Mapping[str, float]) -> list[float]:
    return [float(v) for v in values.values()] + [max(0.0, 1.0 - sum(values.values()))]


def cell_probabilities(cells: DataFrame, targets: Targets, rounds: int = 25, rate: float | None = None) -> DataFrame:
    """Raked weight and sampling probability of every cell (axis columns, ``tokens``).

    One round scales the cells of each axis in turn to its marginals. A target
    no cell can serve leaves the others in proportion. Without tokens there is
    nothing to weigh: no cell, no row.

    With a ``rate``, the share of all tokens that is asked for, a cell is asked
    for ``wanted`` tokens and kept with ``min(1, wanted / tokens)``; what a cell
    taken whole cannot give is its ``shortfall``. Without one the probability is
    the cell's factor divided by the largest factor: the expected mix is exactly
    the raked one, and the scarcest cell sets how much of the corpus is kept.
    """
    if rate is not None and not 0 < rate < float("inf"):
        raise ValueError("the rate must be a positive number")
    axes = list(targets)
    if any(v < 0 for t in targets.values() for v in t.values()):
        raise ValueError("target shares must not be negative")
    size = 1
    for axis in axes:
        size *= len(targets[axis]) + 1
    if size > MAX_CELLS:
        raise ValueError(f"the targets span {size} cells; {MAX_CELLS} are the limit")
    numbers = []
    for axis in axes:
        values = [*targets[axis], OTHER]
        where = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(axis)).cast("int")
        numbers.append(where.alias(f"_{axis}"))
    one = cells.filter("tokens > 0").agg(
        F.array_sort(F.collect_list(F.struct(*numbers, F.col("tokens").cast("double").alias("w")))).alias("_start")
    )
    step = "s"
    for axis in axes:
        fields = ", ".join(f"'_{a}', x._{a}" for a in axes)
        shares = "array(" + ", ".join(f"{v!r}D" for v in _shares(targets[axis])) + ")"
        total = f"aggregate(filter(y_all, y -> y._{axis} = x._{axis}), 0D, (m, y) -> m + y.w)"
        # The inner transform names the state, so that it is computed once per axis.
        step = (
            f"element_at(transform(array({step}), y_all -> transform(y_all, x -> named_struct({fields}, 'w', "
            f"coalesce(try_divide(x.w * element_at({shares}, x._{axis}), {total}), 0D)))), 1)"
        )
    raked = one.select(
        "_start", F.expr(f"aggregate(sequence(1, {int(rounds)}), _start, (s, i) -> {step})").alias("_end")
    )
    factors = raked.select(
        "_start", "_end", F.zip_with("_start", "_end", lambda a, b: b["w"] / a["w"]).alias("_factor")
    ).select(
        "_start", "_end", "_factor", F.array_max("_factor").alias("_top"),
        F.expr("aggregate(_start, 0D, (m, x) -> m + x.w)").alias("_tokens"),
        F.expr("aggregate(_end, 0D, (m, x) -> m + x.w)").alias("_raked"),
    )
    flat = factors.select(F.explode(F.arrays_zip("_start", "_end", "_factor")).alias("c"), "_top", "_tokens", "_raked")
    names = [
        F.element_at(F.array(*[F.lit(v) for v in [*targets[a], OTHER]]), F.col(f"c._start._{a}")).alias(a)
        for a in axes
    ]
    tokens, end, factor = F.col("c._start.w"), F.col("c._end.w"), F.col("c._factor")
    if rate is None:
        chance = F.coalesce(F.try_divide(factor, F.col("_top")), F.lit(0.0))
        wanted = chance * tokens
    else:
        wanted = F.coalesce(F.try_divide(end, F.col("_raked")), F.lit(0.0)) * F.col("_tokens") * F.lit(float(rate))
        chance = F.least(F.lit(1.0), wanted / tokens)
    return flat.select(
        *names,
        tokens.alias("tokens"),
        end.alias("raked"),
        chance.alias("probability"),
        wanted.alias("wanted"),
        F.greatest(F.lit(0.0), wanted - tokens).alias("shortfall"),
    )


def uniform(id_col: str) -> Column:
    """A number in [0, 1) from the id alone, the same on any partitioning; null ids share one."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_cells(
    docs: DataFrame, targets: Targets, tokens: Column | None = None, rounds: int = 25,
    values: Mapping[str, Column] | None = None, rate: float | None = None,
) -> DataFrame:
    """The report of a mix: per cell its tokens, what was wanted of it, its probability and its shortfall."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    own = values or {}
    keys = [pooled(own.get(a, F.col(f"`{a}`")), targets[a]).alias(f"_mix_{a}") for a in targets]
    cells = docs.select(*keys, tokens.alias("tokens")).groupBy(*[f"_mix_{a}" for a in targets]).agg(
        F.sum("tokens").alias("tokens")
    )
    return cell_probabilities(cells.select(*[F.col(f"_mix_{a}").alias(a) for a in targets], "tokens"), targets, rounds, rate)


def mix(
    docs: DataFrame, targets: Targets, tokens: Column | None = None, id_col: str = "doc_id", rounds: int = 25,
    values: Mapping[str, Column] | None = None, rate: float | None = None,
) -> DataFrame:
    """``_row`` (the columns of ``docs`` in one struct), ``_tokens``, ``_probability`` and ``_sampled``.

    Every row comes back, whatever its columns are called. ``targets`` names
    columns of ``docs``, or axes that ``values`` computes. Null texts have no
    tokens and weigh nothing, but are sampled like others of their cell; a cell
    without any token has probability 0. Repeated rows share their decision.
    ``rate`` is explained at ``cell_probabilities``.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    axes, own = list(targets), values or {}
    keys = [pooled(own.get(a, F.col(f"`{a}`")), targets[a]).alias(f"_mix_{a}") for a in axes]
    chance = mix_cells(docs, targets, tokens, rounds, values, rate).select(
        *[F.col(a).alias(f"_mix_{a}") for a in axes], F.col("probability").alias("_probability")
    )
    # At most MAX_CELLS rows: the axes were pooled to the values that have targets.
    joined = packed(docs, *keys, tokens.alias("_tokens"), uniform(id_col).alias("_chance")).join(
        F.broadcast(chance), [f"_mix_{a}" for a in axes], "left"
    )
    probability = F.coalesce(F.col("_probability"), F.lit(0.0))
    return joined.select(
        "_row", "_tokens", probability.alias("_probability"), (F.col("_chance") < probability).alias("_sampled"),
    )
