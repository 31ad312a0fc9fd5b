"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract here: runs of characters other than space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(texts: Iterable[bytes], limit: int) -> Iterator[list[int]]:
    """Row numbers in runs of about ``limit`` bytes; one longer text is a run of its own."""
    run: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(text)
    if run:
        yield run


def packed(df: DataFrame, *needed: str | Column) -> DataFrame:
    """``needed`` beside all of ``df`` in one struct ``_row``, so that no name of a caller's column can clash."""
    return df.select(*needed, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: Iterable[str], **new: Column) -> DataFrame:
    """The columns of the packed rows again, in order; those in ``new`` replaced."""
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``fn`` for ``mapInArrow``; after a task, freed memory goes back to the system.

    A Python worker serves many tasks, and would otherwise keep what its largest
    one took beside the next stage's needs.
    """

    @wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
