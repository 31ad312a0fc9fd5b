"""Products ``X'X`` over all rows, the only thing the linear fits need from the data.

Rows arrive as Arrow batches: covariates as a dense array ``w`` or sparse as
``widx`` / ``wval``, and the sparse selected features ``idx`` / ``val``. A task
takes a slice of rows at a time and multiplies it tile by tile; every tile leaves
the task at once and is summed by a normal aggregation, first within the task.
No task holds the square of the columns, and the result is as large as that
square whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.session import cut_lineage

BLOCK = 64
#: Rows and bytes that a task multiplies at once, and key sums likewise.
SLICE_ROWS, SLICE_BYTES, KEY_ROWS = 16_384, 16 << 20, 1024
_ROWS_SCHEMA = "draw int, kind string, key string, i int, jb int, vals array<double>"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def design_block(batch: pa.RecordBatch, n_w: int, n_y: int) -> np.ndarray:
    """Dense rows ``[1, w, y]`` of one batch."""
    n = batch.num_rows
    out = np.zeros((n, 1 + n_w + n_y))
    out[:, 0] = 1.0
    if n_w:
        out[:, 1 : 1 + n_w] = _column(batch, "w").flatten().to_numpy(zero_copy_only=False).reshape(n, n_w)
    if n_y:
        idx = _column(batch, "idx")
        lengths = pc.list_value_length(idx).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), lengths)
        cols = idx.flatten().to_numpy(zero_copy_only=False)
        out[rows, 1 + n_w + cols] = _column(batch, "val").flatten().to_numpy(zero_copy_only=False)
    return out


def _to_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []

    def pack() -> pa.RecordBatch:
        draw, kind, key, i, jb, vals = zip(*buffer)
        flat = pa.array(np.concatenate(vals))
        offsets = pa.array(np.arange(len(vals) + 1, dtype=np.int32) * BLOCK)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(draw, pa.int32()),
                pa.array(kind, pa.string()),
                pa.array(key, pa.string()),
                pa.array(i, pa.int32()),
                pa.array(jb, pa.int32()),
                pa.ListArray.from_arrays(offsets, flat),
            ],
            names=["draw", "kind", "key", "i", "jb", "vals"],
        )

    for row in rows:
        buffer.append(row)
        if len(buffer) >= 10_000:
            yield pack()
            buffer.clear()
    if buffer:
        yield pack()


def _sum_blocks(partials: DataFrame) -> DataFrame:
    sums = [F.sum(F.col("vals")[k]).alias(f"v{k}") for k in range(BLOCK)]
    added = partials.groupBy("draw", "kind", "key", "i", "jb").agg(*sums)
    return added.select(
        "draw", "kind", "key", "i", "jb", F.array(*[F.col(f"v{k}") for k in range(BLOCK)]).alias("vals")
    )


def first_feature(n_w: int, aligned: bool) -> int:
    """Column of the first feature: after intercept and covariates, or at the next block if ``aligned``."""
    return -(-(1 + n_w) // BLOCK) * BLOCK if aligned else 1 + n_w


def _slices(
    batches: Iterator[pa.RecordBatch], n_w: int, y_at: int
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Runs of rows with their non-zeros (row, column, value), by column, and their dense covariates; bounded in rows and bytes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def done() -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        rows, cols, vals = [np.arange(n)], [np.zeros(n, np.int64)], [np.ones(n)]

        def add(idx: str, val: str, offset: int) -> None:
            lists = table[idx].combine_chunks()
            rows.append(np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            cols.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + offset)
            vals.append(table[val].combine_chunks().flatten().to_numpy(zero_copy_only=False))

        wide = None
        if "widx" in table.column_names:
            add("widx", "wval", 1)
        elif n_w:
            wide = table["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, n_w)
        add("idx", "val", y_at)
        r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        order = np.argsort(c, kind="stable")
        return table, r[order], c[order], v[order], wide

    for whole in batches:
        for start in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(start, SLICE_ROWS)
            if held and (size + batch.nbytes > SLICE_BYTES or sum(b.num_rows for b in held) + batch.num_rows > SLICE_ROWS):
                yield done()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
    if held:
        yield done()


def moment_blocks(
    rows: DataFrame, n_w: int, n_y: int, draws: int = 0, by_key: bool = False, aligned: bool = False, between: bool = True
) -> DataFrame:
    """Summed blocks of ``X'X`` (kind ``G``) for ``X = [1, w, y]``, and with
    ``by_key`` the column sums of every key (kind ``S``), for each draw.

    ``rows`` has ``w`` array<double> (or ``widx`` array<int>, ``wval``
    array<double>), ``idx`` array<int>, ``val`` array<double>, plus ``key``
    string with ``by_key`` and ``weights`` array<double>, one per draw, with
    ``draws``; draw 0 weighs every row once. All draws are computed in the same
    pass over the rows. ``aligned`` lets the features begin at a block of their own;
    then, without ``between``, products of features with features are left out.
    """
    y_at = first_feature(n_w, aligned)
    tiles = -(-(y_at + n_y) // BLOCK)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table, row, col, val, wide in _slices(batches, n_w, y_at):
            n = table.num_rows
            weights = np.ones((n, draws + 1))
            if draws:
                weights[:, 1:] = table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, draws)
            if by_key:
                # Rows in the order of their keys, so that a key's rows are one run.
                codes = table["key"].combine_chunks().dictionary_encode()
                names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                starts = np.searchsorted(code[order], np.arange(len(names)))
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                row, weights, wide = place[row], weights[order], None if wide is None else wide[order]
            edge = np.searchsorted(col, np.arange(tiles + 1) * BLOCK)

            def used(t: int) -> tuple[np.ndarray, np.ndarray]:
                """The columns of a tile that are not empty here, by number and as values."""
                part, lo = slice(edge[t], edge[t + 1]), t * BLOCK
                out = np.zeros((n, BLOCK))
                out[row[part], col[part] - lo] = val[part]
                first, last = max(lo, 1), min(lo + BLOCK, 1 + n_w)
                if wide is not None and first < last:
                    out[:, first - lo : last - lo] = wide[:, first - 1 : last - 1]
                full = np.flatnonzero(out.any(axis=0))
                return full, out[:, full]

            for ib in range(tiles):
                at, left = used(ib)
                if by_key:
                    for d in range(draws + 1):
                        sums = np.zeros((len(names), BLOCK))
                        sums[:, at] = np.add.reduceat(left if d == 0 else left * weights[:, d : d + 1], starts, axis=0)
                        yield from ((d, "S", k, 0, ib, v) for k, v in zip(names, sums) if v.any())
                if not between and ib * BLOCK >= y_at:
                    continue
                for jb in range(ib, tiles):
                    over, right = (at, left) if jb == ib else used(jb)
                    for d in range(draws + 1):
                        tile = np.zeros((BLOCK, BLOCK))
                        tile[np.ix_(at, over)] = left.T @ (right if d == 0 else right * weights[:, d : d + 1])
                        yield from _tile_rows(d, "G", ib, jb, tile, y_at + n_y)

    return _sum_blocks(rows.mapInArrow(lambda batches: _to_batches(multiply(batches)), _ROWS_SCHEMA))


def _tile_rows(draw: int, kind: str, ib: int, jb: int, tile: np.ndarray, q: int) -> Iterator[tuple]:
    for k in range(min(BLOCK, q - ib * BLOCK)):
        yield draw, kind, None, ib * BLOCK + k, jb, tile[k]


def weighted_key_products(blocks: DataFrame, q: int, alpha: float, skip_key: str) -> DataFrame:
    """``sum_k s_k s_k' / (n_k + a)`` (kind ``H``) and ``sum_k n_k s_k s_k' / (n_k + a)^2`` (kind ``H2``).

    ``s_k`` are the key sums, whose first entry is the key's weight ``n_k``.
    This is what remains of a ridge fit on one indicator per key once those
    indicators are eliminated, for any number of keys. A key's tiles travel
    together, as one row of ``q`` numbers at most.
    """
    vectors = (
        blocks.where((F.col("kind") == "S") & (F.col("key") != skip_key))
        .groupBy("draw", "key")
        .agg(F.sort_array(F.collect_list(F.struct("jb", "vals"))).alias("b"))
        .select("draw", F.col("b.jb").alias("jb"), F.flatten(F.col("b.vals")).alias("s"))
    )
    tiles = -(-q // BLOCK)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, KEY_ROWS):
                batch = whole.slice(at, KEY_ROWS)
                draw = _column(batch, "draw").to_numpy(zero_copy_only=False)
                jb = _column(batch, "jb")
                owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(jb).to_numpy(zero_copy_only=False))
                place = jb.flatten().to_numpy(zero_copy_only=False)
                s = _column(batch, "s").flatten().to_numpy(zero_copy_only=False).reshape(-1, BLOCK)
                n = np.zeros(batch.num_rows)
                n[owner[place == 0]] = s[place == 0, 0]

                def dense(t: int) -> np.ndarray:
                    out = np.zeros((batch.num_rows, BLOCK))
                    out[owner[place == t]] = s[place == t]
                    return out

                with np.errstate(divide="ignore", invalid="ignore"):
                    one, two = np.where(n + alpha > 0, 1 / (n + alpha), 0.0), np.where(n + alpha > 0, n / (n + alpha) ** 2, 0.0)
                for ib in range(tiles):
                    left = dense(ib)
                    for t in range(ib, tiles):
                        right = left if t == ib else dense(t)
                        for d in np.unique(draw).tolist():
                            own = draw == d
                            for kind, w in (("H", one), ("H2", two)):
                                yield from _tile_rows(d, kind, ib, t, left[own].T @ (right[own] * w[own, None]), q)

    return _sum_blocks(vectors.mapInArrow(lambda batches: _to_batches(multiply(batches)), _ROWS_SCHEMA))


def matrix_from(pdf: pd.DataFrame, kind: str, q: int) -> np.ndarray:
    """Square matrix from its block rows, lower half mirrored."""
    out = np.zeros((q, -(-q // BLOCK) * BLOCK))
    part = pdf[pdf["kind"] == kind]
    for i, jb, vals in zip(part["i"], part["jb"], part["vals"]):
        out[i, jb * BLOCK : (jb + 1) * BLOCK] = vals
    out = out[:, :q]
    upper = np.triu(out)
    return upper + np.triu(out, 1).T


def gram_entries(blocks: DataFrame, q: int) -> DataFrame:
    """(draw, i, j, value) for all pairs of the kind ``G`` blocks, both halves."""
    upper = (
        blocks.where(F.col("kind") == "G")
        .select("draw", "i", "jb", F.posexplode("vals").alias("k", "value"))
        .select("draw", "i", (F.col("jb") * BLOCK + F.col("k")).alias("j"), "value")
        .where((F.col("j") < q) & (F.col("j") >= F.col("i")))
    )
    mirrored = upper.withColumn(
        "p",
        F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
            F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        ),
    )
    return mirrored.select("draw", F.explode("p").alias("p"), "value").select("draw", "p.i", "p.j", "value")


def gram(rows: DataFrame, n_w: int, n_y: int) -> DataFrame:
    """(i, j, value) of ``X'X`` over columns ``[1, w, y]``."""
    return gram_entries(moment_blocks(rows, n_w, n_y), 1 + n_w + n_y).drop("draw")


def saved_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks written once: the fits that follow read them several times."""
    return cut_lineage(blocks, "moments")


def ridge_solve(lhs: np.ndarray, rhs: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Solve ``(lhs + diag(penalty)) b = rhs``, by pseudo-inverse when singular."""
    system = lhs + np.diag(penalty)
    try:
        return np.linalg.solve(system, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(system) @ rhs
