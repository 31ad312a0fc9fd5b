"""Queries of source mixing, URL filtering and chat formatting, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.llm.mixing import OTHER, Targets, mix
from treatlens.llm.registry import query
from treatlens.llm.tables import table
from treatlens.llm.tool_calls import REPLY_SCHEMA, calls_of_turns, link_tool_calls
from treatlens.llm.url_filter import ALLOW, BLOCK, Rule, filter_urls

#: Production mix: the large source is held to a fifth of the tokens.
TARGETS: Targets = {
    "source": {"src0": 0.2, **{f"src{i}": 0.04 for i in range(1, 20)}},
    "lang": {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.8, "numeric": 0.15, "contact": 0.05},
}
ROUNDS = 25


def topic_of(text: Column) -> Column:
    """The tables have no topic, so it is read off the text."""
    return (
        F.when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("[0-9]"), "numeric")
        .otherwise("prose")
    )


def _values(values: dict[str, float]) -> str:
    shares = {**values, OTHER: max(0.0, 1.0 - sum(values.values()))}
    return "VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in shares.items())


def _pool(axis: str) -> str:
    names = ", ".join(f"'{v}'" for v in TARGETS[axis])
    return f"CASE WHEN {axis} IN ({names}) THEN {axis} ELSE '{OTHER}' END"


MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang,
         CASE WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '[0-9]') THEN 'numeric'
              ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
  FROM documents),
k AS (SELECT *, {_pool("source")} AS ks, {_pool("lang")} AS kl, {_pool("topic")} AS kt FROM d),
ts(v, share) AS ({_values(TARGETS["source"])}),
tl(v, share) AS ({_values(TARGETS["lang"])}),
tt(v, share) AS ({_values(TARGETS["topic"])}),
c AS (SELECT ks, kl, kt, sum(n_tokens)::DOUBLE AS w0 FROM k GROUP BY ALL HAVING sum(n_tokens) > 0),
r(it, ks, kl, kt, w0, w) AS (
  SELECT 0, ks, kl, kt, w0, w0 FROM c
  UNION ALL
  SELECT it + 1, ks, kl, kt, w0, coalesce(w * tt.share / nullif(sum(w) OVER (PARTITION BY kt), 0), 0)
  FROM (SELECT it, ks, kl, kt, w0, coalesce(w * tl.share / nullif(sum(w) OVER (PARTITION BY kl), 0), 0) AS w
        FROM (SELECT it, ks, kl, kt, w0, coalesce(w * ts.share / nullif(sum(w) OVER (PARTITION BY ks), 0), 0) AS w
              FROM r JOIN ts ON ks = ts.v WHERE it < {ROUNDS}) JOIN tl ON kl = tl.v) JOIN tt ON kt = tt.v),
f AS (SELECT ks, kl, kt, w / w0 AS factor FROM r WHERE it = {ROUNDS}),
p AS (SELECT ks, kl, kt, factor / (SELECT max(factor) FROM f) AS probability FROM f)
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens,
       round(coalesce(probability, 0), 6) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(probability, 0) AS sampled
FROM k LEFT JOIN p USING (ks, kl, kt)
"""


@query("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its calibrated probability and whether it is sampled."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    mixed = mix(docs.withColumn("topic", topic_of(F.col("text"))), TARGETS, rounds=ROUNDS)
    return mixed.select(
        "_row.doc_id", "_row.source", "_row.lang", "_row.topic", F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

URL_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
r(h, p, v) AS (VALUES %s),
m AS (
  SELECT p.*, (SELECT arg_max(r.h || r.p, length(r.h || r.p)) FROM r
               WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS rule
  FROM p)
SELECT page_id, host, path, rule, coalesce((SELECT max(v) FROM r WHERE r.h || r.p = m.rule), 'allow') AS verdict
FROM m
""" % ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)  # fmt: skip


@query("op8_url_filter", URL_SQL)
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), RULES)


CHAT_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text NULLS FIRST) AS nr FROM t WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS parent_id, text
      FROM n WHERE role = 'user' AND nr = 1),
a AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM n WHERE role = 'assistant' AND nr = 1),
lv AS (
  SELECT c.conv_id, c.call_id, 0 AS depth FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c AS q WHERE q.conv_id = c.conv_id AND q.call_id = c.parent_id)
  UNION ALL
  SELECT c.conv_id, c.call_id, lv.depth + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.parent_id = lv.call_id),
j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id,
         coalesce(c.turn, a.turn) AS position, c.parent_id, c.text AS prompt, a.text AS content,
         c.conv_id IS NOT NULL AS is_call, a.conv_id IS NOT NULL AS answered
  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id),
s AS (
  SELECT j.*, lv.depth::BIGINT AS depth,
         CASE WHEN NOT is_call THEN 'orphan' WHEN prompt IS NULL THEN 'invalid'
              WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status, CASE WHEN is_call THEN 'reply' END AS name
  FROM j LEFT JOIN lv ON lv.conv_id = j.conv_id AND lv.call_id = j.call_id
  UNION ALL
  SELECT conv_id, conv_id || ':' || turn, turn, conv_id || ':' || (turn - 2), text, NULL, TRUE, FALSE, NULL, 'duplicate', 'reply' FROM n WHERE role = 'user' AND nr > 1
  UNION ALL
  SELECT conv_id, conv_id || ':' || (turn - 1), turn, NULL, NULL, text, FALSE, FALSE, NULL, 'duplicate', NULL FROM n WHERE role = 'assistant' AND nr > 1
  UNION ALL
  SELECT conv_id, NULL, turn, NULL, NULL, text, FALSE, FALSE, NULL, 'message', role FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, call_id, position, depth, status,
       '{"arguments":' ||
       CASE WHEN is_call THEN '{"chars":' || length(prompt) || ',"prompt":' || to_json(prompt) || '}' ELSE 'null' END ||
       ',"call_id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"conv_id":' || conv_id || ',"depth":' || coalesce(depth::VARCHAR, 'null') ||
       ',"errors":[],"name":' || coalesce(to_json(name)::VARCHAR, 'null') ||
       ',"parent_id":' || coalesce(to_json(parent_id)::VARCHAR, 'null') ||
       ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') ||
       ',"status":"' || status || '"}' AS line
FROM s
"""


@query("op9_chat_format", CHAT_SQL)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn: user turns as calls linked to their answers, answers without one as orphans, other roles as messages."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    calls, results, messages = calls_of_turns(turns)
    return link_tool_calls(calls, results, REPLY_SCHEMA, messages)
