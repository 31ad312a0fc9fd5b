"""Imports the query modules of this subpackage, so that its registry is complete."""

from treatlens.llm import queries_groups, queries_mix, queries_pages, queries_text, queries_trie  # noqa: F401
from treatlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
