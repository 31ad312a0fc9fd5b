"""Sequence and cell-state vectors from exchangeable providers.

A provider is any picklable object with ``name``, ``version``, ``dim`` and
``batch(values) -> array of shape (n, dim)``; it runs on Arrow batches inside
tasks. A provider of sequence vectors may instead have ``frame(sequences)``, which
returns ``(sequence, vector)`` by built-in expressions. The defaults are
deterministic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treatlens.functions import placeholder_sequence
from treatlens.operators.gram import design_block


class Provider(Protocol):
    """Interface of an embedding provider."""

    name: str
    version: str
    dim: int

    def batch(self, values: object) -> np.ndarray:
        """Vectors for one batch, one row per input."""


class KmerSpectrum:
    """Signed hashed counts of a sequence's k-mers, scaled to length one.

    Case and outer white space do not matter. A sequence shorter than ``k`` is
    one k-mer of its own. Column and sign of a k-mer come from an MD5 of it and
    the seed; counts that all cancel leave a one in the first k-mer's column.
    Built-in expressions only: one row per k-mer, summed before the shuffle.
    """

    name = "kmer_spectrum"
    version = "2"

    def __init__(self, dim: int = 256, seed: int = 42, k: int = 6) -> None:
        if dim <= 0 or k <= 0:
            raise ValueError("dim and k must be positive")
        self.dim, self.seed, self.k = dim, seed, k

    def frame(self, sequences: DataFrame) -> DataFrame:
        """(sequence, vector) of distinct sequences."""
        clean = F.upper(F.regexp_replace("sequence", r"^\s+|\s+$", ""))
        starts = F.sequence(F.lit(1), F.greatest(F.length("_s") - self.k + 1, F.lit(1)))
        kmers = sequences.select("sequence", clean.alias("_s")).select("sequence", "_s", F.explode(starts).alias("at"))
        code = F.md5(F.concat_ws(":", F.substring(F.col("_s"), F.col("at"), F.lit(self.k)), F.lit(str(self.seed))))
        spread = kmers.select("sequence", "at", code.alias("code")).select(
            "sequence", "at", (F.conv(F.substring("code", 1, 8), 16, 10).cast("long") % self.dim).cast("int").alias("column"),
            F.when(F.substring("code", 9, 1) >= "8", 1).otherwise(-1).alias("sign"),
        )
        sums = spread.groupBy("sequence", "column").agg(F.sum("sign").cast("double").alias("n"), F.min("at").alias("at"))
        whole = sums.groupBy("sequence").agg(
            F.sum(F.col("n") * F.col("n")).alias("square"), F.min_by("column", "at").alias("first"),
            F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("counts"),
        )
        value = lambda c: F.when(
            F.col("square") > 0, F.coalesce(F.try_element_at("counts", c), F.lit(0.0)) / F.sqrt("square")
        ).otherwise((c == F.col("first")).cast("double"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda c: value(c).cast("float"))
        return whole.select("sequence", vector.alias("vector"))


class SignProjection:
    """Row-standardised profiles times a matrix of hashed signs, scaled by the number of features."""

    name = "sign_projection"
    version = "2"

    def __init__(self, dim: int = 256, seed: int = 42) -> None:
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.seed = dim, seed
        self._made: tuple[int, np.ndarray] | None = None

    def matrix(self, n_features: int) -> np.ndarray:
        """Signs of features and columns; made once per task.

        Columns 128 b to 128 b + 127 of feature j are the bits, from the highest,
        of the MD5 of ``j:b:seed``.
        """
        if self._made is None or self._made[0] != n_features:
            words = -(-self.dim // 128)
            digest = b"".join(
                hashlib.md5(f"{j}:{b}:{self.seed}".encode()).digest() for j in range(n_features) for b in range(words)
            )
            bits = np.unpackbits(np.frombuffer(digest, np.uint8)).reshape(n_features, 128 * words)[:, : self.dim]
            self._made = n_features, (bits * 2.0 - 1.0) / np.sqrt(max(1, n_features))
        return self._made[1]

    def batch(self, values: object) -> np.ndarray:
        profiles = np.array(values, dtype=np.float64)
        profiles -= profiles.mean(axis=1, keepdims=True)
        spread = np.sqrt((profiles**2).mean(axis=1, keepdims=True))
        profiles /= np.where(spread > 1e-8, spread, 1.0)
        return (profiles @ self.matrix(profiles.shape[1])).astype(np.float32)


def _checked(out: np.ndarray, n: int, provider: Provider) -> np.ndarray:
    if out.ndim != 2 or out.shape != (n, provider.dim):
        raise ValueError(f"{provider.name} returned shape {out.shape}, expected ({n}, {provider.dim})")
    return np.ascontiguousarray(out, dtype=np.float32)


def _as_lists(out: np.ndarray) -> pa.ListArray:
    n, dim = out.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))


def sequence_source(
    cells: DataFrame,
    override: DataFrame | None = None,
    windows: DataFrame | None = None,
    perturbations: DataFrame | None = None,
) -> tuple[DataFrame, str]:
    """(perturbation_id, sequence) from the first source that is there, and its name.

    The chosen source is used whole; missing ids are not looked up elsewhere.
    """
    pid = F.col("perturbation_id").cast("string").alias("perturbation_id")
    if override is not None:
        return override.select(pid, F.col("sequence").cast("string").alias("sequence")), "override_map"
    if windows is not None:
        return windows.select(pid, "sequence"), "sequence_windows"
    named, source = (
        (perturbations, "perturbations_placeholder")
        if perturbations is not None
        else (cells, "fallback_placeholder")
    )
    ids = named.select(pid).distinct()
    return ids.select("perturbation_id", placeholder_sequence(F.col("perturbation_id")).alias("sequence")), source


def embed_distinct(sequences: DataFrame, provider: Provider) -> DataFrame:
    """(sequence, vector): every distinct non-blank sequence is embedded once."""
    distinct = sequences.select("sequence").where(F.trim("sequence") != "").distinct()
    if hasattr(provider, "frame"):
        return provider.frame(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column(0).to_pylist()
            out = _checked(provider.batch(texts), len(texts), provider)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), _as_lists(out)], names=["sequence", "vector"]
            )

    return distinct.mapInArrow(run, "sequence string, vector array<float>")


def treatment_vectors(cells: DataFrame, sequences: DataFrame, provider: Provider) -> DataFrame:
    """(perturbation_id, vector, found) for every treatment the cells use; zeros when missing."""
    used = cells.select(F.col("perturbation_id").cast("string").alias("perturbation_id")).distinct()
    named = sequences.join(embed_distinct(sequences, provider), "sequence").select("perturbation_id", "vector")
    zero = F.array_repeat(F.lit(0.0).cast("float"), provider.dim)
    return used.join(named, "perturbation_id", "left").select(
        "perturbation_id", F.coalesce("vector", zero).alias("vector"), F.col("vector").isNotNull().alias("found")
    )


def embed_sequences(
    cells: DataFrame, vectors: DataFrame, out: str = "sequence_embedding"
) -> DataFrame:
    """(cell_id, vector): the vector of each cell's treatment.

    ``vectors`` comes from :func:`treatment_vectors`, one row per treatment.
    """
    keyed = cells.select("cell_id", F.col("perturbation_id").cast("string").alias("perturbation_id"))
    lookup = vectors.select("perturbation_id", F.col("vector").alias(out))
    return keyed.join(lookup, "perturbation_id", "left").select("cell_id", out)


def sequence_metadata(cells: DataFrame, vectors: DataFrame, provider: Provider, source: str) -> DataFrame:
    """One row about a sequence embedding run."""
    n_cells = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vectors.agg(
        F.count(F.lit(1)).alias("n_unique_perturbations"),
        F.count_if("found").alias("n_sequences_embedded"),
        F.count_if(~F.col("found")).alias("n_missing_sequences_fallback"),
    ).select(
        F.lit(provider.name).alias("provider_name"),
        F.lit(provider.version).alias("provider_version"),
        F.lit(provider.dim).alias("embedding_dim"),
        F.lit(source).alias("source"),
        n_cells.alias("n_cells"),
        "*",
    )


def embed_cells(
    sparse: DataFrame, n_features: int, provider: Provider, out: str = "cell_state_embedding"
) -> DataFrame:
    """(cell_id, vector) from sparse profiles (cell_id, idx, val), one matrix product per batch."""
    kind = T.StructType(
        [T.StructField("cell_id", sparse.schema["cell_id"].dataType), T.StructField(out, T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            dense = design_block(batch, 0, n_features)[:, 1:]
            vectors = _checked(provider.batch(dense), batch.num_rows, provider)
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_lists(vectors)], names=["cell_id", out])

    return sparse.select("cell_id", "idx", "val").mapInArrow(run, kind)


def project(sparse: DataFrame, n_features: int, dim: int = 256, seed: int = 42) -> DataFrame:
    """Random projection of row-standardised profiles."""
    return embed_cells(sparse, n_features, SignProjection(dim, seed))
