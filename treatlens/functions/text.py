"""Text and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Treatment ids that mean "control", compared in lower case.
CONTROL_IDS = ("ntc", "ctrl", "control", "p000")

_BLANKS = " \t\n\r\f\v"


def clean_text(col: Column) -> Column:
    """Cast to text and drop blanks at both ends."""
    return F.trim(col.cast("string"), F.lit(_BLANKS))


def is_control(perturbation_id: Column, condition: Column | None = None) -> Column:
    """True for a control row, by its condition or by a reserved treatment id."""
    by_id = F.coalesce(F.lower(perturbation_id).isin(*CONTROL_IDS), F.lit(False))
    if condition is None:
        return by_id
    return F.coalesce(F.lower(condition) == "control", F.lit(False)) | by_id


def contig_name(col: Column) -> Column:
    """Contig label without a leading ``chr``, upper case."""
    return F.upper(F.regexp_replace(clean_text(col), "(?i)^chr", ""))


def reverse_complement(col: Column) -> Column:
    """Opposite strand; letters outside A, C, G, T, N stay as they are."""
    return F.reverse(F.translate(col, "ACGTNacgtn", "TGCANtgcan"))


def locus_key(
    chrom: Column, start: Column, end: Column, strand: Column, window_size: int | Column
) -> Column:
    """20 hex digits that identify one locus at one window size."""
    size = window_size if isinstance(window_size, Column) else F.lit(window_size)
    text = F.concat_ws(
        ":", contig_name(chrom), start.cast("string"), end.cast("string"), strand, size.cast("string")
    )
    return F.substring(F.sha2(text, 256), 1, 20)


def placeholder_sequence(col: Column) -> Column:
    """64 letters derived from the id, one per hex digit of its sha256."""
    return F.translate(F.sha2(col.cast("string"), 256), "0123456789abcdef", "ACGT" * 4)


def seeded_hash(seed: int | str, *cols: Column) -> Column:
    """Order key that depends on seed and values only, never on partitioning."""
    return F.sha2(F.concat_ws("~", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)
