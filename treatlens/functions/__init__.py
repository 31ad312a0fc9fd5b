"""Column expressions shared by the operators; all stay inside the JVM."""

from treatlens.functions.arrays import gaussian_from_hash, row_standardise
from treatlens.functions.numeric import as_double, as_int, coerce_counts, log1p_scaled, zscore
from treatlens.functions.text import (
    CONTROL_IDS,
    clean_text,
    contig_name,
    is_control,
    locus_key,
    placeholder_sequence,
    reverse_complement,
    seeded_hash,
)

__all__ = [
    "CONTROL_IDS",
    "as_double",
    "as_int",
    "clean_text",
    "coerce_counts",
    "contig_name",
    "gaussian_from_hash",
    "is_control",
    "locus_key",
    "log1p_scaled",
    "placeholder_sequence",
    "reverse_complement",
    "row_standardise",
    "seeded_hash",
    "zscore",
]
