"""Queries of the operators that compare documents with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.llm.minhash import similar_sets
from treatlens.llm.phrase_dedup import remove_repeats
from treatlens.llm.registry import query
from treatlens.llm.simhash import as_hex, near_duplicates
from treatlens.llm.tables import table


@query("op10_simhash")
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), radius=4)
    return groups.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op12_minhash")
def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85 on 5-word shingles."""
    return similar_sets(table(spark, folder, "documents").select("doc_id", "text"), percent=85, width=5)
