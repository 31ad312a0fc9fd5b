"""Queries of the operators on single texts and vectors: quality, top-k, BPE, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.llm.bpe import digests
from treatlens.llm.quality_rules import STATS, base_failed, fit_rules, with_statistics
from treatlens.llm.registry import query
from treatlens.llm.tables import table
from treatlens.llm.token_alignment import alignment_summary
from treatlens.llm.topk import top_k
from treatlens.llm.toxicity import score, train
from treatlens.session import cut_lineage


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # Statistics are read twice: to learn and to apply; the texts once.
    stats = cut_lineage(with_statistics(docs).drop("text"), "quality")
    rules = fit_rules(stats, table(spark, folder, "labels"))
    failed, rule = base_failed(), rules.rejecting_rule()
    return stats.select(
        "doc_id", *[F.col("_q_" + s).alias(s) for s in STATS], failed.alias("base_failed"),
        F.when(~failed, rule).alias("rule"), (~failed & rule.isNull()).alias("kept"),
    )


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op4_exact_topk", TOPK_SQL)
def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20, scale=64.0)


@query("op6_bpe")
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A chain of two categories: junk first, then toxic."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return score(docs, train(docs, labels, ["junk", "toxic"]))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE against pieces: what their tokens share in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment_summary(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))[0]
