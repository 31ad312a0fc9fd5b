"""Queries for context-shift groups, splits, leakage audits, and ranking scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.operators import ranking, splits
from treatlens.plans import views as V
from treatlens.plans.queries_qc import rounded
from treatlens.plans.registry import query
from treatlens.session import cut_lineage

CFG = splits.SplitSettings()

SQL_BINS = """strength AS (
  SELECT cell_id, greatest(COALESCE(dose, 0), 0) * greatest(knockdown_efficiency_proxy, 0) AS s
  FROM cells LEFT JOIN perts USING (perturbation_id)),
bins AS (SELECT cell_id, 'strength_bin_' || CAST(((row_number() OVER (ORDER BY s, cell_id) - 1) * 4)
    // (SELECT COUNT(*) FROM strength) AS VARCHAR) AS grp FROM strength),
site AS (SELECT perturbation_id,
    CASE WHEN lower(chrom) = 'unknown' OR "start" < 1 OR "end" < 1 THEN 'perturbation:' || perturbation_id
      ELSE 'chr' || regexp_replace(chrom, '^chr', '', 'i') || ':' || "start" || '-' || "end" || ':' || strand END AS grp
  FROM perts),
labels4 AS (
  SELECT cell_id, 'cell_type' AS shift_type, cell_type AS grp FROM cells
  UNION ALL SELECT cell_id, 'protocol', protocol FROM cells
  UNION ALL SELECT cell_id, 'locus', grp FROM cells JOIN site USING (perturbation_id)
  UNION ALL SELECT cell_id, 'dose_strength', grp FROM bins),
sizes AS (SELECT shift_type, grp, COUNT(*) AS n FROM labels4 GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY shift_type
      ORDER BY sha256('42|' || shift_type || '~' || grp), grp) AS r,
    COUNT(*) OVER (PARTITION BY shift_type) AS g FROM sizes),
counts AS (SELECT *, greatest(1, round_even(0.15 * g, 0)) AS nv, greatest(1, round_even(0.15 * g, 0)) AS nt FROM ordered),
parts AS (SELECT shift_type, grp, n, CASE WHEN g = 1 THEN 'train' WHEN g = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'test' END
      WHEN r <= g - nv - nt THEN 'train' WHEN r <= g - nt THEN 'val' ELSE 'test' END AS part FROM counts)"""
SQL = V.with_sql(V.SQL_CELLS, V.SQL_TREATMENT_LOCI, SQL_BINS)


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(V.cells(spark, folder), "cells")


@query("group_by_column", SQL + "SELECT cell_id, grp AS \"group\" FROM labels4 WHERE shift_type = 'cell_type'")
def group_by_column(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_by_column(V.cells(spark, folder), "cell_type")


@query("group_by_locus", SQL + "SELECT cell_id, grp AS \"group\" FROM labels4 WHERE shift_type = 'locus'")
def group_by_locus(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_by_locus(V.treatments(spark, folder), V.treatment_loci(spark, folder))


@query("dose_strength", SQL + "SELECT cell_id, round(s, 6) + 0.0 AS strength FROM strength")
def dose_strength(spark: SparkSession, folder: str) -> DataFrame:
    done = splits.dose_strength(V.cells(spark, folder), V.treatment_loci(spark, folder))
    return done.withColumn("strength", rounded("strength"))


@query(
    "rank_bins",
    """SELECT event_id AS cell_id, 'strength_bin_' || CAST(((row_number() OVER (ORDER BY value, event_id) - 1) * 4)
    // (SELECT COUNT(*) FROM events) AS VARCHAR) AS "group" FROM events""",
)
def rank_bins(spark: SparkSession, folder: str) -> DataFrame:
    values = V.table(spark, folder, "events").select(
        F.col("event_id").alias("cell_id"), F.col("value").alias("strength")
    )
    return splits.rank_bins(values)


@query(
    "assign_groups",
    SQL + "SELECT grp AS \"group\", n AS n_cells, part FROM parts WHERE shift_type = 'cell_type'",
)
def assign_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = splits.group_by_column(V.cells(spark, folder), "cell_type")
    return splits.assign_groups(splits.group_counts(groups), "cell_type", CFG).drop("shift_type")


@query(
    "assign_many_groups",
    """WITH sizes AS (SELECT CAST(o_custkey AS VARCHAR) AS grp, COUNT(*) AS n FROM orders GROUP BY 1),
    ordered AS (SELECT *, row_number() OVER (ORDER BY sha256('42|protocol~' || grp), grp) AS r, COUNT(*) OVER () AS g FROM sizes)
    SELECT grp AS "group", n AS n_cells, CASE WHEN r <= g - 2 * round_even(0.15 * g, 0) THEN 'train'
      WHEN r <= g - round_even(0.15 * g, 0) THEN 'val' ELSE 'test' END AS part FROM ordered""",
)
def assign_many_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as contexts: as many groups as the data has."""
    groups = V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").cast("string").alias("group")
    )
    return splits.assign_groups(splits.group_counts(groups), "protocol", CFG).drop("shift_type")


@query(
    "undersized_fallback",
    SQL
    + """, p AS (SELECT grp, n, part FROM parts WHERE shift_type = 'protocol'),
    t AS (SELECT COALESCE(SUM(n) FILTER (part = 'train'), 0) AS tr, COALESCE(SUM(n) FILTER (part = 'val'), 0) AS va,
      COALESCE(SUM(n) FILTER (part = 'test'), 0) AS te, SUM(n) AS alln FROM p),
    q AS (SELECT grp, n, part, alln, alln // 4 AS low, tr, va, te,
      (tr > 0 AND tr < alln // 4) OR (va > 0 AND va < alln // 4) OR (te > 0 AND te < alln // 4) AS small,
      te > 0 AND te < alln // 4 AS retest, row_number() OVER (ORDER BY n DESC, grp) AS sz FROM p, t),
    r AS (SELECT *, CASE WHEN small AND retest THEN CASE WHEN sz = 2 THEN 'test' ELSE 'train' END
      WHEN small AND part = 'val' THEN 'train' ELSE part END AS p2 FROM q),
    u AS (SELECT *, SUM(n) FILTER (p2 = 'train') OVER () AS tr2 FROM r)
    SELECT grp AS "group", n AS n_cells, CASE WHEN small AND tr2 < low THEN 'train' ELSE p2 END AS part, small AS fallback,
      CASE WHEN small AND tr2 < low THEN 'dataset_too_small_for_holdout_all_assigned_to_train'
        WHEN small THEN 'undersized_partition_fallback_applied' END AS reason FROM u""",
)
def undersized_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Parts must hold a quarter of all cells, so one protocol per part is too small."""
    groups = splits.group_by_column(V.cells(spark, folder), "protocol")
    sizes = cut_lineage(splits.group_counts(groups), "sizes")
    quarter = sizes.agg(F.sum("n_cells")).first()[0] // 4
    cfg = splits.SplitSettings(min_cells=int(quarter))
    return splits.undersized_fallback(splits.assign_groups(sizes, "protocol", cfg), cfg).drop("shift_type")


@query(
    "split_cells",
    SQL + """SELECT cell_id, l.shift_type, part, l.grp AS "group" FROM labels4 l
    JOIN parts p ON l.shift_type = p.shift_type AND l.grp = p.grp WHERE l.shift_type = 'protocol'""",
)
def split_cells(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split(V.cells(spark, folder), None, "protocol", CFG)[0]


@query(
    "split_all",
    SQL + """SELECT cell_id, l.shift_type, part, l.grp AS "group" FROM labels4 l
    JOIN parts p ON l.shift_type = p.shift_type AND l.grp = p.grp""",
)
def split_all(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_all(_cells(spark, folder), V.treatment_loci(spark, folder), CFG)


_SQL_AUDIT = SQL + """, asg AS (
  SELECT cell_id, part FROM labels4 l JOIN parts p ON l.shift_type = p.shift_type AND l.grp = p.grp
  WHERE l.shift_type = 'protocol'),
bad AS (SELECT cell_id, part FROM asg WHERE cell_id % 7 <> 0
  UNION ALL SELECT cell_id, 'test' FROM asg WHERE cell_id % 5 = 0
  UNION ALL SELECT cell_id, 'val' FROM asg WHERE cell_id % 11 = 0
  UNION ALL SELECT -cell_id - 1, 'train' FROM asg WHERE cell_id % 13 = 0),
pc AS (SELECT cell_id, bool_or(part = 'train') AS tr, bool_or(part = 'val') AS va, bool_or(part = 'test') AS te,
    COUNT(*) FILTER (part = 'train') AS ntr, COUNT(*) FILTER (part = 'val') AS nva, COUNT(*) FILTER (part = 'test') AS nte
  FROM bad GROUP BY 1),
j AS (SELECT c.cell_id IS NOT NULL AS known, protocol AS grp, COALESCE(tr, FALSE) AS tr, COALESCE(va, FALSE) AS va,
    COALESCE(te, FALSE) AS te, COALESCE(ntr, 0) AS ntr, COALESCE(nva, 0) AS nva, COALESCE(nte, 0) AS nte
  FROM pc FULL JOIN cells c ON pc.cell_id = c.cell_id),
g AS (SELECT grp, bool_or(tr) AS tr, bool_or(va) AS va, bool_or(te) AS te FROM j WHERE known GROUP BY 1)
SELECT CAST(SUM(greatest(ntr - 1, 0)) AS BIGINT) AS duplicates_train, CAST(SUM(greatest(nva - 1, 0)) AS BIGINT) AS duplicates_val,
  CAST(SUM(greatest(nte - 1, 0)) AS BIGINT) AS duplicates_test,
  CAST(SUM(CASE WHEN known THEN 0 ELSE ntr END) AS BIGINT) AS unknown_train,
  CAST(SUM(CASE WHEN known THEN 0 ELSE nva END) AS BIGINT) AS unknown_val,
  CAST(SUM(CASE WHEN known THEN 0 ELSE nte END) AS BIGINT) AS unknown_test,
  CAST(SUM(CASE WHEN known THEN ntr ELSE 0 END) AS BIGINT) AS cells_train,
  CAST(SUM(CASE WHEN known THEN nva ELSE 0 END) AS BIGINT) AS cells_val,
  CAST(SUM(CASE WHEN known THEN nte ELSE 0 END) AS BIGINT) AS cells_test,
  COUNT(*) FILTER (tr AND va) AS cell_overlap_train_val, COUNT(*) FILTER (tr AND te) AS cell_overlap_train_test,
  COUNT(*) FILTER (va AND te) AS cell_overlap_val_test,
  COUNT(*) FILTER (known) AS n_cells, COUNT(*) FILTER (tr OR va OR te) AS n_assigned,
  COUNT(*) FILTER (known AND NOT (tr OR va OR te)) AS n_missing,
  (SELECT COUNT(*) FROM g WHERE tr) AS groups_train, (SELECT COUNT(*) FROM g WHERE va) AS groups_val,
  (SELECT COUNT(*) FROM g WHERE te) AS groups_test,
  (SELECT COUNT(*) FROM g WHERE tr AND va) AS group_overlap_train_val,
  (SELECT COUNT(*) FROM g WHERE tr AND te) AS group_overlap_train_test,
  (SELECT COUNT(*) FROM g WHERE va AND te) AS group_overlap_val_test,
  COUNT(*) FILTER ((tr AND va) OR (tr AND te) OR (va AND te)) > 0 AS leakage_detected, FALSE AS is_valid FROM j"""


@query("leakage_report", _SQL_AUDIT)
def leakage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a damaged split: some cells dropped, repeated, moved or made up."""
    cells = _cells(spark, folder)
    good = cut_lineage(splits.split(cells, None, "protocol", CFG)[0].select("cell_id", "part"), "assignment")
    key = F.col("cell_id")
    bad = (
        good.where(key % 7 != 0)
        .unionByName(good.where(key % 5 == 0).withColumn("part", F.lit("test")))
        .unionByName(good.where(key % 11 == 0).withColumn("part", F.lit("val")))
        .unionByName(good.where(key % 13 == 0).select((-key - 1).alias("cell_id"), F.lit("train").alias("part")))
    )
    return splits.leakage_report(bad, cells, splits.group_by_column(cells, "protocol")).drop("errors")


@query("leakage_clean", "SELECT COUNT(*) AS n_cells, COUNT(*) AS n_assigned, 0 AS n_missing, FALSE AS leakage_detected, TRUE AS is_valid FROM orders")
def leakage_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of an untouched split."""
    cells = _cells(spark, folder)
    assignment = splits.split(cells, None, "protocol", CFG)[0]
    report = splits.leakage_report(assignment, cells, splits.group_by_column(cells, "protocol"))
    return report.select(
        "n_cells", "n_assigned", F.col("n_missing").cast("int").alias("n_missing"), "leakage_detected", "is_valid"
    )


@query(
    "split_provenance",
    SQL
    + """, p AS (SELECT grp, n, part FROM parts WHERE shift_type = 'protocol')
    SELECT 'shift_split_manifest_v1' AS schema_version, 'anndata_v1' AS table_schema_version, 'protocol' AS shift_type,
      'orders' AS dataset_name, 42 AS seed, 0.15::DOUBLE AS val_fraction, 0.15::DOUBLE AS test_fraction, 32 AS min_cells_per_split,
      COUNT(*) AS group_count, CAST(SUM(n) AS BIGINT) AS n_cells, string_agg(grp, '|' ORDER BY grp) FILTER (part = 'train') AS train_groups,
      string_agg(grp, '|' ORDER BY grp) FILTER (part = 'val') AS val_groups,
      string_agg(grp, '|' ORDER BY grp) FILTER (part = 'test') AS test_groups, FALSE AS fallback_applied,
      CAST(NULL AS VARCHAR) AS fallback_reason, 64 AS fingerprint_digits FROM p""",
)
def split_provenance(spark: SparkSession, folder: str) -> DataFrame:
    cells = _cells(spark, folder)
    _, parts = splits.split(cells, None, "protocol", CFG)
    mark = splits.fingerprint(cells, splits.group_by_column(cells, "protocol"), 25)
    row = splits.split_provenance(parts, "protocol", CFG, mark, "orders")
    joined = {f"{p}_groups": F.array_join(f"{p}_groups", "|") for p in ("train", "val", "test")}
    return row.withColumns(joined).withColumn("fingerprint_digits", F.length("fingerprint")).drop(
        "group_cell_counts", "fingerprint"
    )


SQL_SCORED = """scored AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS label
  FROM labels JOIN documents USING (doc_id))"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = V.table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    marks = V.table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    return marks.join(docs, "doc_id").select("score", "label")


@query(
    "auroc",
    V.with_sql(SQL_SCORED)
    + """, r AS (SELECT label, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score)
        + COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)
    SELECT round((SUM(rk) FILTER (label) - COUNT(*) FILTER (label) * (COUNT(*) FILTER (label) + 1) / 2.0)
      / (COUNT(*) FILTER (label) * COUNT(*) FILTER (NOT label)), 6) + 0.0 AS auc FROM r""",
)
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.auroc(_scored(spark, folder)).select(rounded("auc").alias("auc"))


@query(
    "best_f1",
    V.with_sql(SQL_SCORED)
    + """, t AS (SELECT score, SUM(SUM(label::INT)) OVER (ORDER BY score DESC) AS tp, SUM(COUNT(*)) OVER (ORDER BY score DESC) AS pp
        FROM scored GROUP BY score)
    SELECT round(MAX(2.0 * tp / (pp + (SELECT COUNT(*) FROM scored WHERE label))), 6) + 0.0 AS f1 FROM t""",
)
def best_f1(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.best_f1(_scored(spark, folder)).select(rounded("f1").alias("f1"))


SQL_EDGES = """est AS (SELECT p_brand AS source_gene_id, s_name AS target_gene_id, SUM(l_quantity * (1 - 10 * l_discount)) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
tru AS (SELECT p_brand AS source_gene_id, s_name AS target_gene_id, SUM(l_extendedprice) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R' GROUP BY 1, 2),
both_sides AS (SELECT abs(e.weight) AS score, abs(COALESCE(t.weight, 0)) AS t FROM est e
  LEFT JOIN tru t USING (source_gene_id, target_gene_id))"""


def _edge_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Brand-to-supplier weights of all lines, and of the returned lines as the truth."""
    lines = V.table(spark, folder, "lineitem")
    parts = V.table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("source_gene_id"))
    suppliers = V.table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("target_gene_id"))
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    pair = named.groupBy("source_gene_id", "target_gene_id").agg(
        F.sum(F.col("l_quantity") * (1 - 10 * F.col("l_discount"))).alias("est"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("tru"),
    )
    pair = cut_lineage(pair, "edge-pairs")
    ids = ["source_gene_id", "target_gene_id"]
    return (
        pair.select(*ids, F.col("est").alias("weight")),
        pair.where(F.col("tru").isNotNull()).select(*ids, F.col("tru").alias("weight")),
    )


@query(
    "truth_correlation",
    V.with_sql(SQL_EDGES)
    + "SELECT round(covar_pop(score, t) / (stddev_pop(score) * stddev_pop(t)), 6) + 0.0 AS abs_corr FROM both_sides",
)
def truth_correlation(spark: SparkSession, folder: str) -> DataFrame:
    edges, truth = _edge_pair(spark, folder)
    return ranking.truth_correlation(edges, truth).select(rounded("abs_corr").alias("abs_corr"))


@query(
    "graph_recovery",
    V.with_sql(SQL_EDGES)
    + """, sc AS (SELECT round(score, 4) AS score, t > 1e-12 AS label FROM both_sides),
    r AS (SELECT label, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc),
    a AS (SELECT CASE WHEN COUNT(*) FILTER (label) = 0 OR COUNT(*) FILTER (NOT label) = 0 THEN 0.5 ELSE
        (SUM(rk) FILTER (label) - COUNT(*) FILTER (label) * (COUNT(*) FILTER (label) + 1) / 2.0)
        / (COUNT(*) FILTER (label) * COUNT(*) FILTER (NOT label)) END AS auc FROM r),
    t AS (SELECT score, SUM(SUM(label::INT)) OVER (ORDER BY score DESC) AS tp, SUM(COUNT(*)) OVER (ORDER BY score DESC) AS pp
        FROM sc GROUP BY score)
    SELECT round(auc, 6) + 0.0 AS auc, (SELECT round(MAX(2.0 * tp / (pp + (SELECT COUNT(*) FROM sc WHERE label))), 6) + 0.0
      FROM t) AS f1 FROM a""",
)
def graph_recovery(spark: SparkSession, folder: str) -> DataFrame:
    edges, truth = _edge_pair(spark, folder)
    # Summation order must not split ties, so weights are compared at 4 digits.
    done = ranking.graph_recovery(edges.withColumn("weight", F.round("weight", 4)), truth)
    return done.select(rounded("auc").alias("auc"), rounded("f1").alias("f1"))
