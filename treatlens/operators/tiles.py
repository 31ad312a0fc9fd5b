"""Square matrices as tables of tiles, one matrix per draw.

A row ``(draw, ib, jb, t)`` is the tile of block row ``ib`` and block column
``jb``: ``TILE * TILE`` doubles, row by row. Sums, products and inverses are
joins and groups over such rows, so a task holds a few tiles whatever the size of
the matrix, and all draws go through the same steps at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.session import cut_lineage

TILE = 64
SCHEMA = "draw int, ib int, jb int, t array<double>"
_KEY = ["draw", "ib", "jb"]


def _arrays(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Tiles of a column as one array (rows, TILE, TILE)."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, TILE, TILE)


def _list(tiles: np.ndarray) -> pa.Array:
    offsets = np.arange(len(tiles) + 1, dtype=np.int32) * (TILE * TILE)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(tiles).ravel()))


def _one(key: tuple, tile: np.ndarray) -> pa.Table:
    numbers = [pa.array([k.as_py()], pa.int32()) for k in key]
    return pa.Table.from_arrays([*numbers, _list(tile[None])], names=[*_KEY, "t"])


def from_block_rows(rows: DataFrame) -> DataFrame:
    """Tiles of symmetric matrices from rows ``(draw, i, jb, vals)`` of their upper block triangle."""

    def stack(key: tuple, part: pa.Table) -> pa.Table:
        tile = np.zeros((TILE, TILE))
        vals = part["vals"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, TILE)
        np.add.at(tile, part["i"].to_numpy() % TILE, vals)
        return _one(key, tile)

    upper = rows.select("draw", F.expr(f"i div {TILE}").cast("int").alias("ib"), "jb", "i", "vals").groupBy(*_KEY).applyInArrow(stack, SCHEMA)
    upper = cut_lineage(upper, "tiles")
    return upper.unionByName(transposed(upper.where("ib <> jb")))


def transposed(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), _list(_arrays(b.column(3)).swapaxes(1, 2))], names=[*_KEY, "t"])

    return tiles.select(*_KEY, "t").mapInArrow(run, SCHEMA)


def combined(*terms: tuple[float, DataFrame]) -> DataFrame:
    """Sum of matrices times numbers; absent tiles are zero."""
    rows = None
    for factor, tiles in terms:
        part = tiles.select(*_KEY, "t", F.lit(float(factor)).alias("factor"))
        rows = part if rows is None else rows.unionByName(part)

    def add(key: tuple, part: pa.Table) -> pa.Table:
        return _one(key, np.tensordot(part["factor"].to_numpy(), _arrays(part["t"]), 1))

    return rows.groupBy(*_KEY).applyInArrow(add, SCHEMA)


def product(a: DataFrame, b: DataFrame, turned: bool = False) -> DataFrame:
    """``a b``, or ``a' b`` if ``turned``; a group holds one block row of tile pairs."""
    row, inner = ("jb", "ib") if turned else ("ib", "jb")
    left = a.select("draw", F.col(row).alias("ib"), F.col(inner).alias("k"), F.col("t").alias("x"))
    right = b.select("draw", F.col("ib").alias("k"), "jb", F.col("t").alias("y"))

    def multiply(key: tuple, part: pa.Table) -> pa.Table:
        x = _arrays(part["x"])
        return _one(key, np.matmul(x.swapaxes(1, 2) if turned else x, _arrays(part["y"])).sum(axis=0))

    return left.join(right, ["draw", "k"]).groupBy(*_KEY).applyInArrow(multiply, SCHEMA)


def with_diagonal(tiles: DataFrame, extra: np.ndarray) -> DataFrame:
    """Adds ``extra`` (one number per column of the padded matrix) to the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, ib = _arrays(b.column(3)).copy(), b.column(1).to_numpy()
            at = np.arange(TILE)
            for n in np.flatnonzero(ib == b.column(2).to_numpy()):
                t[n, at, at] += extra[ib[n] * TILE : (ib[n] + 1) * TILE]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _list(t)], names=[*_KEY, "t"])

    return tiles.select(*_KEY, "t").mapInArrow(run, SCHEMA)


def _solve(pivot: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system, by a generalised inverse if it is singular.

    A solve rather than a product with the inverse: for nearly dependent columns
    the latter has errors in every direction, not only in those that cancel later.
    """
    try:
        return np.linalg.solve(pivot, right)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(pivot, hermitian=True) @ right


def swept(tiles: DataFrame, n: int) -> DataFrame:
    """Inverse of symmetric positive matrices of ``n`` block rows, by block Gauss-Jordan.

    Further block columns, ``n`` and up, are right sides and become solutions.
    Step k joins every tile with the two tiles of block row and column k that it
    meets and with the pivot. Each of the ``n`` steps is written, so that the
    plan of the next one starts from files.
    """
    state = tiles
    for k in range(n):
        row = state.where(F.col("ib") == k).select("draw", "jb", F.col("t").alias("row"))
        column = state.where(F.col("jb") == k).select("draw", "ib", F.col("t").alias("col"))
        pivot = state.where((F.col("ib") == k) & (F.col("jb") == k)).select("draw", F.col("t").alias("pivot"))
        joined = state.join(row, ["draw", "jb"]).join(column, ["draw", "ib"]).join(pivot, "draw")

        def step(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ib, jb = b.column(1).to_numpy(), b.column(2).to_numpy()
                t, row, col, pivot = (_arrays(b.column(c)) for c in range(3, 7))
                out = np.empty_like(t)
                for n in range(len(t)):
                    if ib[n] == k:
                        out[n] = _solve(pivot[n], np.eye(TILE) if jb[n] == k else t[n])
                    elif jb[n] == k:
                        out[n] = -_solve(pivot[n].T, t[n].T).T
                    else:
                        out[n] = t[n] - col[n] @ _solve(pivot[n], row[n])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _list(out)], names=[*_KEY, "t"])

        state = cut_lineage(joined.select(*_KEY, "t", "row", "col", "pivot").mapInArrow(step, SCHEMA), "swept")
    return state


def entries(tiles: DataFrame, name: str = "value") -> DataFrame:
    """``(draw, i, j, value)`` of every entry."""
    opened = tiles.select(*_KEY, F.posexplode("t").alias("p", name))
    i = (F.col("ib") * TILE + F.expr(f"p div {TILE}")).cast("int")
    return opened.select("draw", i.alias("i"), (F.col("jb") * TILE + F.col("p") % TILE).cast("int").alias("j"), name)
