"""Imports every query module, so that the registry is complete."""

from treatlens.plans import (  # noqa: F401
    queries_baselines,
    queries_extra,
    queries_models,
    queries_qc,
    queries_splits,
    queries_tables,
    queries_windows,
    queries_written,
)
from treatlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
