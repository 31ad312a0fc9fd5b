"""Queries for embeddings, the two-stage graph, transport, evaluation and the staged job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treatlens.operators import embeddings, graph, ivgraph, layout, metrics, qc, transport
from treatlens.operators.gram import BLOCK, moment_blocks
from treatlens.plans import evaluate as EV
from treatlens.plans import stage_chain
from treatlens.plans import views as V
from treatlens.plans.graph_sql import DIAGNOSTICS_SQL, NAIVE_SQL, edges_sql
from treatlens.plans.queries_baselines import SQL as SQL_BASE
from treatlens.plans.queries_baselines import Inputs, _model_row
from treatlens.plans.queries_qc import rounded
from treatlens.plans.registry import query
from treatlens.session import broadcast_if_small, cut_lineage, scratch_path

DIM = 256
#: Width in the staged job, whose every stage is written and read again.
CHAIN_DIM = 16
#: Vectors whose digests are made at once.
DIGEST_ROWS = 2000


@query(
    "treatment_vectors",
    """SELECT DISTINCT o_orderpriority AS perturbation_id, 256 AS dim, TRUE AS found FROM orders""",
)
def treatment_vectors(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.treatments(spark, folder)
    sequences, _ = embeddings.sequence_source(cells)
    done = embeddings.treatment_vectors(cells, sequences, embeddings.KmerSpectrum(DIM))
    return done.select("perturbation_id", F.size("vector").alias("dim"), "found")


@query(
    "sequence_metadata",
    """SELECT COUNT(*) AS n_cells, COUNT(DISTINCT o_orderpriority) AS n_unique_perturbations,
    COUNT(DISTINCT o_orderpriority) FILTER (o_orderpriority <> '5-LOW') AS n_sequences_embedded,
    COUNT(DISTINCT o_orderpriority) FILTER (o_orderpriority = '5-LOW') AS n_missing_sequences_fallback FROM orders""",
)
def sequence_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The control treatment has a blank sequence and falls back to zeros."""
    cells = V.treatments(spark, folder)
    known, source = embeddings.sequence_source(cells)
    blank = F.when(F.col("perturbation_id") == V.CONTROL_PRIORITY, " ").otherwise(F.col("sequence"))
    provider = embeddings.KmerSpectrum(DIM)
    vectors = embeddings.treatment_vectors(cells, known.withColumn("sequence", blank), provider)
    row = embeddings.sequence_metadata(cells, vectors, provider, source)
    return row.select(
        "n_cells", "n_unique_perturbations", "n_sequences_embedded", "n_missing_sequences_fallback"
    )


def whole_vector(col: str, digits: int) -> Column:
    """A vector as the MD5 of its rounded values, so that all of them are compared."""
    scaled = F.transform(col, lambda x: F.round(x.cast("double") * 10**digits).cast("bigint").cast("string"))
    return F.md5(F.array_join(scaled, ","))


def vector_digests(vectors: DataFrame, col: str, digits: int) -> DataFrame:
    """(cell_id, vector): :func:`whole_vector` of one vector per cell, by Arrow batches for tables of many cells.

    Halves are rounded away from zero: the part behind the point of a double is exact.
    """
    scale = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DIGEST_ROWS):
                batch = whole.slice(at, DIGEST_ROWS)
                lists = batch.column(1)
                scaled = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
                size = np.abs(scaled)
                down = np.floor(size)
                numbers = np.where(scaled < 0, -1.0, 1.0) * (down + (size - down >= 0.5))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
                texts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers.astype(np.int64)).cast(pa.string()))
                codes = [hashlib.md5(t).hexdigest() for t in pc.binary_join(texts, ",").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], names=["cell_id", "vector"])

    kind = T.StructType([vectors.schema["cell_id"], T.StructField("vector", T.StringType())])
    return vectors.select("cell_id", col).mapInArrow(run, kind)


SQL_KMERS = f"""seqs AS (SELECT DISTINCT o_orderpriority AS pid, translate(sha256(o_orderpriority), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM orders),
km AS (SELECT pid, md5(substr(s, k, 6) || ':42') AS code FROM (SELECT pid, s, unnest(range(1, length(s) - 4)) AS k FROM seqs)),
sp AS (SELECT pid, ('0x' || substr(code, 1, 8))::BIGINT % {DIM} AS c, sum(CASE WHEN substr(code, 9, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS n FROM km GROUP BY 1, 2),
vec AS (SELECT pid, d.c, (coalesce(n, 0) / sqrt((SELECT sum(n * n) FROM sp q WHERE q.pid = p.pid)))::REAL::DOUBLE AS v
  FROM (SELECT DISTINCT pid FROM seqs) p CROSS JOIN (SELECT range AS c FROM range({DIM})) d LEFT JOIN sp USING (pid, c))"""


@query(
    "embed_sequences",
    "WITH " + SQL_KMERS + """, h AS (SELECT pid, md5(string_agg(round(v * 1000000)::BIGINT::VARCHAR, ',' ORDER BY c)) AS h FROM vec GROUP BY 1)
    SELECT o_orderkey AS cell_id, h AS vector FROM orders JOIN h ON pid = o_orderpriority""",
)
def embed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.treatments(spark, folder)
    sequences, _ = embeddings.sequence_source(cells, perturbations=V.treatment_loci(spark, folder))
    vectors = embeddings.treatment_vectors(cells, sequences, embeddings.KmerSpectrum(DIM))
    # Cells of a treatment share its vector, so the digest is made once per treatment, as in the SQL.
    digests = cut_lineage(vectors.select("perturbation_id", whole_vector("vector", 6).alias("vector")), "digests")
    return embeddings.embed_sequences(cells, digests, "vector")


def _sparse(data: Inputs, *more: str) -> tuple[DataFrame, DataFrame, int]:
    feats = cut_lineage(graph.indexed_features(data.genes), "features")
    return layout.to_sparse(data.expr, feats, "z", data.cells.select("cell_id", *more)), feats, feats.count()


@query(
    "to_sparse",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + """, feat AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS idx FROM (SELECT DISTINCT p_brand AS gene_id FROM part))
    SELECT cell_id, idx, round(z, 6) + 0.0 AS value FROM normal JOIN feat USING (gene_id)""",
)
def to_sparse(spark: SparkSession, folder: str) -> DataFrame:
    sparse, _, _ = _sparse(Inputs(spark, folder))
    opened = sparse.select("cell_id", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return opened.select(
        "cell_id", F.col("e.idx").cast("bigint").alias("idx"), rounded(F.col("e.val")).alias("value")
    )


@query(
    "embed_cells",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + f""", feat AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS j FROM (SELECT DISTINCT p_brand AS gene_id FROM part)),
    p AS (SELECT o_orderkey AS cell_id, j, coalesce(z, 0) AS z FROM orders CROSS JOIN feat LEFT JOIN normal n ON n.cell_id = o_orderkey AND n.gene_id = feat.gene_id),
    st AS (SELECT cell_id, avg(z) AS m, stddev_pop(z) AS s FROM p GROUP BY 1),
    bits AS (SELECT j, d, CASE WHEN ('0x' || substr(md5(j || ':' || d // 128 || ':42'), d % 128 // 4 + 1, 1))::INT & (8 >> (d % 4)) > 0 THEN 1.0 ELSE -1.0 END AS s
      FROM feat CROSS JOIN (SELECT range AS d FROM range({DIM}))),
    v AS (SELECT cell_id, d, (sum(CASE WHEN st.s > 1e-8 THEN (z - m) / st.s ELSE z - m END * bits.s) / sqrt((SELECT count(*) FROM feat)))::REAL::DOUBLE AS v
      FROM p JOIN st USING (cell_id) JOIN bits USING (j) GROUP BY 1, 2)
    SELECT cell_id, md5(string_agg(round(v * 1000)::BIGINT::VARCHAR, ',' ORDER BY d)) AS vector FROM v GROUP BY 1""",
)
def embed_cells(spark: SparkSession, folder: str) -> DataFrame:
    sparse, _, n = _sparse(Inputs(spark, folder))
    return vector_digests(embeddings.project(sparse, n, DIM), "cell_state_embedding", 3)


@query(
    "select_graph_features",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + """, v AS (SELECT gene_id, SUM(z * z) / (SELECT COUNT(*) FROM orders) - pow(SUM(z) / (SELECT COUNT(*) FROM orders), 2) AS var
      FROM normal GROUP BY 1)
    SELECT gene_id, row_number() OVER (ORDER BY var DESC, gene_id) - 1 AS idx FROM v QUALIFY idx < 10""",
)
def select_graph_features(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    done = ivgraph.select_graph_features(data.genes, data.expr, data.cells.count(), 10)
    return done.select("gene_id", F.col("idx").cast("bigint").alias("idx"))


@query(
    "instruments",
    """SELECT o_orderkey AS cell_id, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'unassigned' ELSE o_orderpriority END AS key,
    '5-LOW' AS reference FROM orders""",
)
def instruments(spark: SparkSession, folder: str) -> DataFrame:
    """One treatment is blank and becomes a category of its own."""
    cells = V.treatments(spark, folder)
    blank = F.when(F.col("perturbation_id") == "3-MEDIUM", "  ").otherwise(F.col("perturbation_id"))
    keyed, reference = ivgraph.instruments(cells.withColumn("perturbation_id", blank))
    return keyed.select("cell_id", "key", F.lit(reference).alias("reference"))


def _graph_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = cut_lineage(V.cells(spark, folder), "cells")
    expr = cut_lineage(qc.normalise_log1p(V.expr(spark, folder)), "normal")
    genes = V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id")).distinct()
    return cells, expr, genes


def _edges(fit: ivgraph.GraphFit) -> DataFrame:
    numbers = ("weight", "standard_error", "ci_lower", "ci_upper")
    return fit.edges.select("source_gene_id", "target_gene_id", *[rounded(c, 4).alias(c) for c in numbers])


@query("iv_graph", edges_sql(0))
def iv_graph(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(ivgraph.iv_graph(*_graph_inputs(spark, folder), ivgraph.GraphSettings(draws=0, naive=False)))


@query("bootstrap_intervals", edges_sql(24))
def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(ivgraph.iv_graph(*_graph_inputs(spark, folder), ivgraph.GraphSettings(draws=24, naive=False)))


@query("naive_graph", NAIVE_SQL)
def naive_graph(spark: SparkSession, folder: str) -> DataFrame:
    naive = ivgraph.iv_graph(*_graph_inputs(spark, folder), ivgraph.GraphSettings(draws=0)).naive
    return naive.select("source_gene_id", "target_gene_id", rounded("weight", 4).alias("weight"))


@query("fit_diagnostics", DIAGNOSTICS_SQL)
def fit_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    row = ivgraph.iv_graph(*_graph_inputs(spark, folder), ivgraph.GraphSettings(draws=0)).diagnostics
    l1 = ("iv_offdiag_l1_mean", "naive_offdiag_l1_mean", "iv_minus_naive_offdiag_l1_mean")
    return row.select(rounded("stage1_r2_mean").alias("stage1_r2_mean"), *[rounded(c, 5).alias(c) for c in l1])


@query(
    "stage1_group_sums",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, V.SQL_TREATMENTS)
    + """SELECT perturbation_id AS key, gene_id, round(SUM(z), 4) + 0.0 AS total
    FROM normal JOIN cells USING (cell_id) GROUP BY 1, 2""",
)
def stage1_group_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per treatment from the same pass of products that feeds the two-stage fit."""
    data = Inputs(spark, folder)
    feats = cut_lineage(graph.indexed_features(data.genes), "features")
    keyed, _ = ivgraph.instruments(data.cells)
    slim = keyed.select("cell_id", "key", F.array().cast("array<double>").alias("w"))
    rows = layout.to_sparse(data.expr, feats, "z", slim)
    sums = moment_blocks(rows, 0, feats.count(), by_key=True).where(F.col("kind") == "S")
    opened = sums.select("key", "jb", F.posexplode("vals").alias("k", "total"))
    position = opened.select("key", (F.col("jb") * BLOCK + F.col("k") - 1).alias("idx"), "total")
    return position.join(feats, "idx").select("key", "gene_id", rounded("total", 4).alias("total"))


@query(
    "edge_intervals",
    V.with_sql(V.SQL_EXPR, V.SQL_TREATMENTS)
    + """SELECT gene_id AS source, perturbation_id AS target, round(COALESCE(stddev_samp(count), 0), 6) + 0.0 AS standard_error,
    round(quantile_cont(count::DOUBLE, 0.025), 6) + 0.0 AS ci_lower, round(quantile_cont(count::DOUBLE, 0.975), 6) + 0.0 AS ci_upper
    FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2""",
)
def edge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a (gene, treatment) pair taken as the draws of one edge."""
    draws = V.expr(spark, folder).join(V.treatments(spark, folder), "cell_id").select(
        F.col("gene_id").alias("source"), F.col("perturbation_id").alias("target"), F.col("count").alias("weight")
    )
    done = ivgraph.edge_intervals(draws)
    return done.select("source", "target", *[rounded(c).alias(c) for c in ("standard_error", "ci_lower", "ci_upper")])


@query(
    "edge_table",
    """WITH g AS (SELECT DISTINCT p_brand AS gene_id FROM part)
    SELECT a.gene_id AS source_gene_id, b.gene_id AS target_gene_id FROM g a CROSS JOIN g b WHERE a.gene_id <> b.gene_id""",
)
def edge_table(spark: SparkSession, folder: str) -> DataFrame:
    fit = ivgraph.iv_graph(*_graph_inputs(spark, folder), ivgraph.GraphSettings(draws=0))
    return fit.edges.select("source_gene_id", "target_gene_id")


@query(
    "transport_pairs",
    SQL_BASE
    + """SELECT 'target' AS part, cell_id, gene_id, round(z, 6) + 0.0 AS value FROM normal JOIN genes USING (gene_id)
    UNION ALL SELECT 'source', NULL, gene_id, round(COALESCE(cm, 0), 6) + 0.0 FROM genes LEFT JOIN ctl USING (gene_id)""",
)
def transport_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The non-zero targets of every cell, and the common source profile once."""
    data = Inputs(spark, folder)
    sparse, feats, n = _sparse(data)
    rows, source = transport.transport_pairs(sparse, data.cells, n)
    targets = rows.select("cell_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        F.lit("target").alias("part"), "cell_id", F.col("e.idx").alias("idx"), F.col("e.val").alias("value")
    )
    profile = spark.createDataFrame(list(enumerate(source)), "idx int, value double").select(
        F.lit("source").alias("part"), F.lit(None).cast(data.cells.schema["cell_id"].dataType).alias("cell_id"), "idx", "value"
    )
    both = targets.unionByName(profile).join(feats, "idx")
    return both.select("part", "cell_id", "gene_id", rounded(F.col("value")).alias("value"))


def _fitted(spark: SparkSession, folder: str) -> tuple[transport.LinearTransport, DataFrame, DataFrame, DataFrame, Inputs]:
    data = Inputs(spark, folder)
    sparse, feats, n = _sparse(data, "perturbation_id")
    sparse = cut_lineage(sparse, "sparse")
    sequences, _ = embeddings.sequence_source(data.cells)
    vectors = embeddings.treatment_vectors(data.cells, sequences, embeddings.KmerSpectrum(DIM))
    vectors = cut_lineage(vectors.select("perturbation_id", "vector"), "vectors")
    rows, source = transport.transport_pairs(sparse, data.cells, n, "control_mean", vectors)
    shared = cut_lineage(transport.treatment_rows(sparse, vectors), "treatments")
    return transport.fit_linear_transport(shared, source, DIM, n), rows, sparse, feats, data


#: The ridge fit from sums per treatment, whose cells share their covariates: Gauss-Jordan over one row of lists.
SQL_TRANSPORT = (
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, V.SQL_TREATMENTS, SQL_KMERS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
genes AS (SELECT p_brand AS gene_id, row_number() OVER (ORDER BY p_brand) AS g FROM (SELECT DISTINCT p_brand FROM part)),
np AS (SELECT perturbation_id AS pid, count(*) AS n, count(*) FILTER (condition = 'control') AS nc FROM cells GROUP BY 1),
zs AS (SELECT perturbation_id AS pid, gene_id, sum(z) AS s, sum(z * z) AS q FROM normal JOIN cells USING (cell_id) GROUP BY 1, 2),
src AS (SELECT g, gene_id, coalesce((SELECT sum(s) FROM zs JOIN np USING (pid) WHERE nc > 0 AND zs.gene_id = genes.gene_id), 0)
  / (SELECT sum(nc) FROM np) AS source FROM genes),
tg AS (SELECT pid, g, gene_id, source, n, coalesce(s, 0) - n * source AS st, coalesce(q, 0) - 2 * source * coalesce(s, 0) + n * source * source AS sq
  FROM np CROSS JOIN src LEFT JOIN zs USING (pid, gene_id)),
xs AS (SELECT pid, 0 AS j, 1.0::DOUBLE AS v FROM np UNION ALL SELECT pid, c + 1, v FROM vec),
lhs AS (SELECT a.j AS i, list(v ORDER BY b.j) AS r FROM (SELECT a.j, b.j AS k, sum(n * a.v * b.v) + CASE WHEN a.j = b.j AND a.j > 0 THEN 0.001 ELSE 0 END AS v
    FROM xs AS a JOIN xs AS b USING (pid) JOIN np USING (pid) GROUP BY a.j, b.j) AS a JOIN (SELECT DISTINCT j FROM xs) AS b ON b.j = a.k GROUP BY a.j),
rhs AS (SELECT j AS i, list(v ORDER BY g) AS r FROM (SELECT j, g, sum(xs.v * st) AS v FROM xs JOIN tg USING (pid) GROUP BY 1, 2) GROUP BY 1),
gj(k, m) AS (
  SELECT 0, list(lhs.r || rhs.r ORDER BY i) FROM lhs JOIN rhs USING (i) UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    WHEN r[k + 1] = 0 THEN r ELSE list_transform(r, lambda x, j: x - r[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END) FROM gj WHERE k < len(m)),
coef AS (SELECT j, g, m[j + 1][{DIM} + 1 + g] AS b FROM gj, (SELECT DISTINCT j FROM xs), genes WHERE k = len(m)),
fit AS (SELECT pid, g, sum(v * b) AS p FROM xs JOIN coef USING (j) GROUP BY 1, 2),
model AS (SELECT g, gene_id, source, greatest(sum(sq - 2 * p * st + n * p * p) / sum(n), 0) + 0.0001 AS variance FROM tg JOIN fit USING (pid, g) GROUP BY ALL)
"""
)


@query(
    "fit_linear_transport",
    SQL_TRANSPORT
    + """SELECT g - 1 AS idx, gene_id, round(source, 6) + 0.0 AS source, round(variance, 6) + 0.0 AS variance,
    (SELECT md5(string_agg(round(b * 10000)::BIGINT::VARCHAR, ',' ORDER BY j)) FROM coef WHERE coef.g = model.g) AS coef FROM model""",
)
def linear_transport(spark: SparkSession, folder: str) -> DataFrame:
    model, rows, _, feats, _ = _fitted(spark, folder)
    ids = [r["gene_id"] for r in feats.orderBy("idx").collect()]
    done = transport.model_rows(model, rows, ids)
    numbers = [rounded(c).alias(c) for c in ("source", "variance")]
    return done.select(F.col("idx").cast("bigint").alias("idx"), "gene_id", *numbers, whole_vector("coef", 4).alias("coef"))


@query(
    "predict_distribution",
    SQL_TRANSPORT
    + """SELECT c.cell_id, m.gene_id, round(coalesce(z, 0), 6) + 0.0 AS y, round(source + p, 6) + 0.0 AS p, round(variance, 6) + 0.0 AS var
    FROM cells AS c JOIN fit ON fit.pid = c.perturbation_id JOIN model AS m USING (g) LEFT JOIN normal AS z ON z.cell_id = c.cell_id AND z.gene_id = m.gene_id""",
)
def predict(spark: SparkSession, folder: str) -> DataFrame:
    model, rows, _, feats, _ = _fitted(spark, folder)
    ids = [r["gene_id"] for r in feats.orderBy("idx").collect()]
    done = transport.prediction_pairs(rows, model, ids)
    return done.select("cell_id", "gene_id", *[rounded(c).alias(c) for c in ("y", "p", "var")])


@query("sample_distribution")
def sample(spark: SparkSession, folder: str) -> DataFrame:
    model, rows, _, _, _ = _fitted(spark, folder)
    return transport.sample_distribution(transport.predict_distribution(rows, model), model, 2)


@query(
    "evaluate",
    SQL_BASE
    + """SELECT round(mae, 6) + 0.0 AS mae, round(pearson_top_1000_degs, 6) + 0.0 AS pearson_top_1000_degs,
    round(calibration_error, 6) + 0.0 AS calibration_error, (SELECT COUNT(*) FROM genes) AS n_genes,
    (SELECT COUNT(*) FROM cells) AS n_eval_cells FROM model""",
)
def evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """Group means as per-cell predictions through the dense evaluation path."""
    data = Inputs(spark, folder)
    preds = cut_lineage(data.predictions(), "predictions")
    own = preds.select("perturbation_id", "gene_id", F.col("gene_level_mean").alias("p"), "var")
    # Dense rows are made in the task that holds the cell and are not shuffled.
    pairs = cut_lineage(_dense(data, own).drop("cell_id", "perturbation_id"), "pairs")
    control = qc.group_profiles(data.expr, data.cells, data.genes).groupBy("gene_id").agg(
        F.first("control_mean").alias("control_mean")
    )
    row = EV.model_metrics(*EV.from_pairs(pairs), control, EV.EvaluationSettings(top_k=10))
    return row.select(
        *[rounded(c).alias(c) for c in ("mae", "pearson_top_1000_degs", "calibration_error")], "n_genes", "n_eval_cells"
    )


def _dense(data: Inputs, preds: DataFrame) -> DataFrame:
    """(cell_id, gene_id, y, ...) for every cell and every gene with a prediction of its treatment.

    A cell's non-zeros meet it as one map before its rows are made, so the
    dense rows stay in the task that holds the cell.
    """
    listed = data.expr.where(F.col("gene_id").isNotNull()).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "z"))).alias("zs"))
    whole = data.cells.select("cell_id", "perturbation_id").join(listed, "cell_id", "left")
    return whole.join(broadcast_if_small(preds), "perturbation_id").select(
        "cell_id", "gene_id", F.coalesce(F.try_element_at("zs", F.col("gene_id")), F.lit(0.0)).alias("y"),
        *[c for c in preds.columns if c not in ("perturbation_id", "gene_id")],
    )


@query(
    "evaluate_masks",
    SQL_BASE
    + """, mk AS (SELECT o_orderkey AS cell_id, 'batch' AS shift_type, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS part FROM orders
      UNION ALL SELECT o_orderkey, 'week', CASE WHEN weekofyear(o_orderdate) % 5 < 3 THEN 'train' WHEN weekofyear(o_orderdate) % 5 = 3 THEN 'val' ELSE 'test' END FROM orders),
    gmask AS (SELECT perturbation_id, gene_id, gene_level_mean AS p FROM pred),
    pr AS (SELECT shift_type, part, cell_id, gene_id, coalesce(z, 0) AS y, p FROM mk JOIN cells USING (cell_id) JOIN gmask USING (perturbation_id)
      LEFT JOIN normal USING (cell_id, gene_id)),
    pg AS (SELECT shift_type, part, gene_id, count(*) AS n, sum(abs(y - p)) AS a, sum((y - p) * (y - p)) AS q,
        CASE WHEN stddev_pop(y) > 1e-8 AND stddev_pop(p) > 1e-8 THEN corr(y, p) END AS r,
        row_number() OVER (PARTITION BY shift_type, part ORDER BY abs(avg(y) - coalesce(any_value(cm), 0)) DESC, gene_id) AS rk
      FROM pr LEFT JOIN ctl USING (gene_id) GROUP BY 1, 2, 3)
    SELECT shift_type, part, round(sum(a) / sum(n), 6) + 0.0 AS mae, round(sqrt(sum(q) / sum(n)), 6) + 0.0 AS rmse,
      round(coalesce(avg(r), 0), 6) + 0.0 AS pearson_mean_gene, round(coalesce(avg(r) FILTER (rk <= 10), 0), 6) + 0.0 AS pearson_top_1000_degs,
      count(*) AS n_genes, max(n) AS n_eval_cells FROM pg GROUP BY 1, 2""",
)
def evaluate_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Group means as predictions, scored on every part of two splits at once."""
    data = Inputs(spark, folder)
    orders = V.table(spark, folder, "orders")
    week = F.weekofyear("o_orderdate") % 5
    status = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    splits = F.array(
        F.struct(F.lit("batch").alias("shift_type"), status.alias("part")),
        F.struct(F.lit("week").alias("shift_type"), F.when(week < 3, "train").when(week == 3, "val").otherwise("test").alias("part")),
    )
    assignment = orders.select(F.col("o_orderkey").alias("cell_id"), F.explode(splits).alias("s")).select("cell_id", "s.*")
    preds = cut_lineage(data.predictions(), "predictions").select("perturbation_id", "gene_id", F.col("gene_level_mean").alias("p"))
    pairs = _dense(data, preds)
    control = qc.group_profiles(data.expr, data.cells, data.genes).groupBy("gene_id").agg(F.first("control_mean").alias("control_mean"))
    done = EV.evaluate_masks(pairs, assignment, control, EV.EvaluationSettings(top_k=10))
    numbers = ("mae", "rmse", "pearson_mean_gene", "pearson_top_1000_degs")
    return done.select("shift_type", "part", *[rounded(c).alias(c) for c in numbers], "n_genes", "n_eval_cells")


@query(
    "quality_gates",
    SQL_BASE
    + """, won AS (SELECT baseline_name FROM cmp WHERE model_beats_baseline_mae),
    miss AS (SELECT string_agg('orders:' || b, ', ' ORDER BY b) AS x FROM (VALUES ('control_mean'), ('linear_regression')) w(b)
      WHERE b NOT IN (SELECT baseline_name FROM won))
    SELECT 'baseline_dominance' AS gate, x IS NULL AS passed, CASE WHEN x IS NULL THEN 'all required baselines are beaten'
      ELSE 'missing wins: ' || x END AS details FROM miss
    UNION ALL SELECT 'graph_recovery', FALSE, 'no recovery scores' UNION ALL SELECT 'all', FALSE, 'every gate'""",
)
def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    model, rest = _model_row(Inputs(spark, folder, tagged=True))
    wins = metrics.baseline_comparison(rest, model).select(
        F.lit("orders").alias("stage"), "baseline_name", F.col("model_beats_baseline_mae").alias("won")
    )
    return metrics.quality_gates(wins, None, ["orders"], ["control_mean", "linear_regression"])


@query("run_stages")
def run_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain over all orders; returns the metrics of its report."""
    root = scratch_path(spark, "run")
    tables = {
        "cells": cut_lineage(V.cells(spark, folder), "cells"),
        "genes": layout.harmonise_genes(V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id")).distinct()),
        "expr": cut_lineage(V.expr(spark, folder), "expr"),
        "perturbations": V.treatment_loci(spark, folder),
        "vectors": None,
        "version": None,
    }
    cfg = stage_chain.ChainSettings(embedding_dim=CHAIN_DIM)
    stage_chain.run_stages(spark, tables, root, "catalogue", cfg)
    return spark.read.json(f"{root}/card").select("metrics.*")
