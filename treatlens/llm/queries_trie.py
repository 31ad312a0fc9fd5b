"""Query of the conversation prefix trie, with its reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.llm.prefix_trie import prefix_trie, sequences
from treatlens.llm.registry import query
from treatlens.llm.tables import table
from treatlens.session import cut_lineage

#: Conversations are rebuilt in families of this many, from this many first turns at most.
FAMILY, HEAD = 5, 9

TRIE_SQL = f"""
WITH ids AS (
  SELECT DISTINCT conv_id AS c,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)),
             lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT) % {HEAD} AS h
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT i.c, t.k, role, txt FROM ids AS i JOIN t ON t.c = i.c - i.c % {FAMILY} AND t.k <= h
  UNION ALL
  SELECT i.c, t.k, role, txt FROM ids AS i JOIN t ON t.c = i.c AND t.k > h),
p AS (
  SELECT c, row_number() OVER w AS d, strlen(txt) AS size,
         sha256(string_agg(strlen(role) || ':' || strlen(txt) || ':' || role || txt, '') OVER w) AS path
  FROM r WINDOW w AS (PARTITION BY c ORDER BY k)),
m AS (SELECT c, d, size, path FROM p UNION ALL SELECT c, 0, 0, '' FROM ids),
e AS (SELECT c, max(d) AS len FROM m GROUP BY c),
n AS (
  SELECT path, d, min(m.c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE d = len), '') AS ends
  FROM m JOIN e USING (c) GROUP BY path, d),
b AS (SELECT DISTINCT x.path AS path, y.path AS below, y.d - x.d AS steps FROM m AS x JOIN m AS y ON x.c = y.c AND y.d >= x.d),
kids AS (SELECT path, count(*) AS n_children FROM b WHERE steps = 1 GROUP BY path),
sub AS (
  SELECT b.path, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved
  FROM b JOIN n ON n.path = b.below LEFT JOIN kids ON kids.path = b.below GROUP BY b.path)
SELECT n.conv_id, n.d::BIGINT AS depth, (SELECT max(q.conv_id) FROM b JOIN n AS q ON q.path = b.path WHERE b.below = n.path AND b.steps = 1) AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM n JOIN sub USING (path) LEFT JOIN kids USING (path)
"""  # noqa: E501


def grafted(own: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Conversations whose first turns are replaced by those of the first of their family.

    Conversation c takes the first h turns of conversation c - c % ``family``
    (all if fewer, none if there is none) before its own turns after its first
    h; h is crc32 of the decimal id, modulo ``head``. ``own`` is what
    ``sequences`` returns.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("int")
    heads = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_of"), F.slice("turns", 1, head - 1).alias("_head")
    )
    joined = own.withColumn("_of", F.col("conv_id") - F.col("conv_id") % family).join(heads, "_of", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    first = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return joined.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(grafted(cut_lineage(sequences(turns), "sequences"))).drop("digest")
