"""Queries for quality control, normalisation, feature choice and treatment shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.operators import qc
from treatlens.operators.layout import sample_cap
from treatlens.plans import views as V
from treatlens.plans.registry import query
from treatlens.session import broadcast_if_small, cut_lineage

MIN_COUNTS, MIN_GENES, MIN_CELLS, TOP_K = 50, 2, 3, 15

SQL_QC = f"""totals AS (
  SELECT o_orderkey AS cell_id, COALESCE(SUM(count), 0) AS lib, COUNT(count) AS n_genes
  FROM orders LEFT JOIN expr ON cell_id = o_orderkey GROUP BY 1),
kept AS (SELECT * FROM totals WHERE lib >= {MIN_COUNTS} AND n_genes >= {MIN_GENES}),
expr_qc AS (SELECT e.* FROM expr e SEMI JOIN kept k ON e.cell_id = k.cell_id),
genes_qc AS (SELECT gene_id, COUNT(*) AS n_cells FROM expr_qc GROUP BY 1 HAVING COUNT(*) >= {MIN_CELLS}),
counts_qc AS (SELECT e.* FROM expr_qc e SEMI JOIN genes_qc g ON e.gene_id = g.gene_id),
lib_qc AS (SELECT cell_id, SUM(count) AS lib FROM counts_qc GROUP BY 1),
normal AS (SELECT c.cell_id, gene_id, count, ln(1 + count / greatest(lib, 1.0) * 10000.0) AS z
           FROM counts_qc c JOIN lib_qc USING (cell_id)),
var_raw AS (SELECT gene_id, COUNT(*) AS n, AVG(z) AS m, VAR_POP(z) AS v, (SELECT COUNT(*) FROM kept) AS nn
            FROM normal GROUP BY 1),
variances AS (SELECT gene_id, (n * v + m * m * n * (nn - n) / nn) / nn AS variance FROM var_raw),
top AS (SELECT gene_id, variance, row_number() OVER (ORDER BY variance DESC, gene_id) AS rnk
        FROM variances QUALIFY rnk <= {TOP_K})"""


def rounded(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def settings(**changes: object) -> qc.QcSettings:
    base = dict(min_counts=MIN_COUNTS, min_genes=MIN_GENES, min_cells=MIN_CELLS, n_features=TOP_K,
                n_features_low=1, n_features_high=5000)
    return qc.QcSettings(**{**base, **changes})


@query(
    "library_size",
    V.with_sql(V.SQL_EXPR)
    + """SELECT o_orderkey AS cell_id, CAST(COALESCE(SUM(count), 0) AS BIGINT) AS library_size
    FROM orders LEFT JOIN expr ON cell_id = o_orderkey GROUP BY 1""",
)
def library_size(spark: SparkSession, folder: str) -> DataFrame:
    return qc.library_size(V.expr(spark, folder), V.treatments(spark, folder))


@query(
    "features_detected",
    V.with_sql(V.SQL_EXPR)
    + """SELECT o_orderkey AS cell_id, COUNT(count) AS n_genes
    FROM orders LEFT JOIN expr ON cell_id = o_orderkey GROUP BY 1""",
)
def features_detected(spark: SparkSession, folder: str) -> DataFrame:
    return qc.features_detected(V.expr(spark, folder), V.treatments(spark, folder))


@query(
    "qc_cells",
    V.with_sql(V.SQL_EXPR, SQL_QC)
    + "SELECT cell_id, CAST(lib AS BIGINT) AS library_size, n_genes FROM kept",
)
def qc_cells(spark: SparkSession, folder: str) -> DataFrame:
    return qc.qc_cells(V.treatments(spark, folder), V.expr(spark, folder), MIN_COUNTS, MIN_GENES)


@query("qc_genes", V.with_sql(V.SQL_EXPR, SQL_QC) + "SELECT gene_id, n_cells FROM genes_qc")
def qc_genes(spark: SparkSession, folder: str) -> DataFrame:
    expr = V.expr(spark, folder)
    kept = qc.qc_cells(V.treatments(spark, folder), expr, MIN_COUNTS, MIN_GENES)
    return qc.qc_genes(expr.join(kept.select("cell_id"), "cell_id", "left_semi"), MIN_CELLS)


@query(
    "normalise_log1p",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + "SELECT cell_id, gene_id, count, round(z, 6) + 0.0 AS z FROM normal",
)
def normalise_log1p(spark: SparkSession, folder: str) -> DataFrame:
    return qc.normalise_log1p(V.expr(spark, folder)).withColumn("z", rounded("z"))


@query(
    "feature_variance",
    V.with_sql(V.SQL_EXPR, SQL_QC) + "SELECT gene_id, round(variance, 6) + 0.0 AS variance FROM variances",
)
def feature_variance(spark: SparkSession, folder: str) -> DataFrame:
    expr = V.expr(spark, folder)
    kept = qc.qc_cells(V.treatments(spark, folder), expr, MIN_COUNTS, MIN_GENES)
    counts = expr.join(kept.select("cell_id"), "cell_id", "left_semi")
    genes = qc.qc_genes(counts, MIN_CELLS)
    normal = qc.normalise_log1p(counts.join(genes.select("gene_id"), "gene_id", "left_semi"))
    n_cells = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return qc.feature_variance(normal, n_cells).withColumn("variance", rounded("variance"))


@query(
    "top_variance_features",
    V.with_sql(V.SQL_EXPR, SQL_QC)
    + "SELECT gene_id, round(variance, 6) + 0.0 AS variance, rnk AS rank FROM top",
)
def top_variance_features(spark: SparkSession, folder: str) -> DataFrame:
    done = qc.preprocess(V.treatments(spark, folder), V.expr(spark, folder), settings(proxies=False))
    return done.features.select(
        "gene_id", rounded("variance").alias("variance"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "refresh_library",
    V.with_sql(V.SQL_EXPR, SQL_QC)
    + """SELECT k.cell_id, CAST(COALESCE(SUM(c.count), 0) AS BIGINT) AS library_size
    FROM kept k LEFT JOIN (SELECT c.* FROM counts_qc c SEMI JOIN top t ON c.gene_id = t.gene_id) c
      ON c.cell_id = k.cell_id GROUP BY 1""",
)
def refresh_library(spark: SparkSession, folder: str) -> DataFrame:
    done = qc.preprocess(V.treatments(spark, folder), V.expr(spark, folder), settings(proxies=False))
    return done.cells.select("cell_id", F.col("library_size").cast("bigint").alias("library_size"))


@query(
    "preprocess",
    V.with_sql(V.SQL_EXPR, SQL_QC)
    + """SELECT n.cell_id, n.gene_id, n.count, round(z, 6) + 0.0 AS z
    FROM normal n SEMI JOIN top t ON n.gene_id = t.gene_id""",
)
def preprocess(spark: SparkSession, folder: str) -> DataFrame:
    done = qc.preprocess(V.treatments(spark, folder), V.expr(spark, folder), settings(proxies=False))
    return done.expr.select("cell_id", "gene_id", "count", rounded("z").alias("z"))


@query(
    "qc_summary",
    V.with_sql(V.SQL_EXPR, SQL_QC)
    + f"""SELECT (SELECT COUNT(*) FROM orders) AS n_cells_input,
      (SELECT COUNT(DISTINCT gene_id) FROM expr) AS n_genes_input,
      (SELECT COUNT(*) FROM kept) AS n_cells_after_qc,
      least((SELECT COUNT(*) FROM genes_qc), {TOP_K}) AS n_genes_after_qc,
      least((SELECT COUNT(*) FROM genes_qc), {TOP_K}) AS n_features_selected,
      (SELECT COUNT(*) FROM genes_qc) < {TOP_K} AS fallback_used,
      (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM kept) AS removed_cells,
      (SELECT COUNT(DISTINCT gene_id) FROM expr) - least((SELECT COUNT(*) FROM genes_qc), {TOP_K})
        AS removed_genes""",
)
def qc_summary(spark: SparkSession, folder: str) -> DataFrame:
    done = qc.preprocess(V.treatments(spark, folder), V.expr(spark, folder), settings(proxies=False))
    return done.summary.drop("settings")


@query(
    "zscore",
    V.with_sql(V.SQL_CELLS)
    + """SELECT cell_id, CASE WHEN s <= 1e-8 THEN 0.0 ELSE round((library_size - m) / s, 6) + 0.0 END AS z
    FROM cells, (SELECT AVG(library_size) AS m, STDDEV_POP(library_size) AS s FROM cells)""",
)
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    base = cut_lineage(V.cells(spark, folder).select("cell_id", "library_size"), "cells")
    return qc.zscore(base, "library_size", "z").select("cell_id", rounded("z").alias("z"))


_SQL_PROXIES = """stats AS (
  SELECT AVG(library_size) AS lm, STDDEV_POP(library_size) AS ls,
    AVG(knockdown_efficiency_proxy) AS km, STDDEV_POP(knockdown_efficiency_proxy) AS ks FROM cells),
proxy AS (
  SELECT cell_id, 'library_size_z' AS name, (library_size - lm) / ls AS v FROM cells, stats
  UNION ALL SELECT cell_id, 'knockdown_efficiency_proxy_z', (knockdown_efficiency_proxy - km) / ks FROM cells, stats
  UNION ALL SELECT cell_id, 'batch=' || b, CASE WHEN batch = b THEN 1.0 ELSE 0.0 END
    FROM cells, (SELECT DISTINCT batch AS b FROM cells)
  UNION ALL SELECT cell_id, 'protocol=' || p, CASE WHEN protocol = p THEN 1.0 ELSE 0.0 END
    FROM cells, (SELECT DISTINCT protocol AS p FROM cells))"""


@query(
    "proxy_matrix",
    V.with_sql(V.SQL_CELLS, _SQL_PROXIES) + "SELECT cell_id, name, round(v, 6) + 0.0 AS value FROM proxy",
)
def proxy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    packed, names = qc.proxy_matrix(cut_lineage(V.cells(spark, folder), "cells"))
    opened = packed.select("cell_id", F.posexplode("proxies").alias("i", "v"))
    return with_names(opened, names).select("cell_id", "name", rounded("v").alias("value"))


def with_names(opened: DataFrame, names: DataFrame) -> DataFrame:
    """Rows ``(cell_id, i, v)`` with the names of their columns.

    A column outside the batches belongs to many cells, so a join by ``i`` would
    bring each to one task; those names are few and are broadcast. The batches
    are too, unless there are too many of them.
    """
    many = F.col("name").startswith("batch=")
    common = broadcast_if_small(names.where(~many))
    batches = names.where(many)
    small = broadcast_if_small(batches)
    if small is not batches:
        return opened.join(F.broadcast(names), "i")
    rest = opened.join(common.select("i"), "i", "left_anti").join(batches, "i")
    return opened.join(common, "i").unionByName(rest)


@query(
    "wide_proxies",
    V.with_sql(
        V.SQL_CELLS,
        """stats AS (SELECT AVG(library_size) AS lm, STDDEV_POP(library_size) AS ls,
    AVG(knockdown_efficiency_proxy) AS km, STDDEV_POP(knockdown_efficiency_proxy) AS ks FROM cells)""",
    )
    + """SELECT cell_id, 'library_size_z' AS name, round((library_size - lm) / ls, 6) + 0.0 AS value FROM cells, stats
  UNION ALL SELECT cell_id, 'knockdown_efficiency_proxy_z', round((knockdown_efficiency_proxy - km) / ks, 6) + 0.0 FROM cells, stats
  UNION ALL SELECT cell_id, 'batch=' || CAST(cell_id // 3 AS VARCHAR), 1.0 FROM cells
  UNION ALL SELECT cell_id, 'protocol=' || protocol, 1.0 FROM cells""",
)
def wide_proxies(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse proxies with three cells to a batch: thousands of categories, four numbers a cell."""
    cells = V.cells(spark, folder).withColumn("batch", F.expr("cell_id div 3"))
    sparse, names = qc.sparse_proxies(cut_lineage(cells, "cells"))
    opened = sparse.select("cell_id", F.explode(F.arrays_zip("widx", "wval")).alias("e"))
    named = with_names(opened.select("cell_id", F.col("e.widx").alias("i"), F.col("e.wval").alias("v")), names)
    return named.select("cell_id", "name", rounded("v").alias("value"))


@query(
    "one_hot",
    V.with_sql(V.SQL_CELLS)
    + """SELECT cell_id, CAST(batch = 'F' AS DOUBLE) AS "batch=F", CAST(batch = 'O' AS DOUBLE) AS "batch=O",
      CAST(batch = 'P' AS DOUBLE) AS "batch=P" FROM cells""",
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    base = V.cells(spark, folder).select("cell_id", "batch")
    values = [r["value"] for r in qc.domain(base, "batch").orderBy("code").collect()]
    columns = [c.alias(f"batch={v}") for c, v in zip(qc.one_hot("batch", values), values)]
    return base.select("cell_id", *columns)


@query(
    "group_sizes",
    "SELECT o_orderpriority AS perturbation_id, COUNT(*) AS n FROM orders GROUP BY 1",
)
def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return qc.group_sizes(V.treatments(spark, folder), "perturbation_id")


@query(
    "treatment_shift",
    V.with_sql(V.SQL_EXPR, V.SQL_TREATMENTS, SQL_QC)
    + """, kept_cells AS (SELECT c.* FROM cells c SEMI JOIN kept k ON c.cell_id = k.cell_id),
    sel AS (SELECT n.*, perturbation_id, condition FROM normal n SEMI JOIN top t ON n.gene_id = t.gene_id
            JOIN kept_cells USING (cell_id)),
    grid AS (SELECT perturbation_id, gene_id, n FROM
      (SELECT perturbation_id, COUNT(*) AS n FROM kept_cells GROUP BY 1), (SELECT DISTINCT gene_id FROM sel)),
    grp AS (SELECT perturbation_id, gene_id, SUM(z) AS s FROM sel GROUP BY 1, 2),
    ctl AS (SELECT gene_id, SUM(z) / (SELECT COUNT(*) FROM kept_cells WHERE condition = 'control') AS m
            FROM sel WHERE condition = 'control' GROUP BY 1)
    SELECT perturbation_id, gene_id, round(COALESCE(s, 0) / n, 6) + 0.0 AS group_mean,
      round(COALESCE(m, 0), 6) + 0.0 AS control_mean,
      round(COALESCE(s, 0) / n - COALESCE(m, 0), 6) + 0.0 AS shift
    FROM grid LEFT JOIN grp USING (perturbation_id, gene_id) LEFT JOIN ctl USING (gene_id)""",
)
def treatment_shift(spark: SparkSession, folder: str) -> DataFrame:
    done = qc.preprocess(V.treatments(spark, folder), V.expr(spark, folder), settings(proxies=False))
    shifts = qc.treatment_shift(done.expr, done.cells)
    return shifts.select(
        "perturbation_id", "gene_id", *[rounded(c).alias(c) for c in ("group_mean", "control_mean", "shift")]
    )


@query(
    "sample_cap",
    """SELECT o_orderkey AS cell_id, o_orderpriority AS perturbation_id FROM orders
    ORDER BY sha256('42~' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""",
)
def sample(spark: SparkSession, folder: str) -> DataFrame:
    # The limit is the operator itself: a uniform sample of 500 cells.
    return sample_cap(V.treatments(spark, folder).drop("condition"), 500, 42)
