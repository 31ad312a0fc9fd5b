"""Further queries with reference SQL for the model operators.

They drive the operators with inputs whose results SQL can state: a one-column
covariate for the ridge fit, countable providers for the embeddings, unrolled
iterations for the transport cost, and the invariants of rewiring.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.operators import embeddings, graph, layout, transport
from treatlens.operators import metrics as M
from treatlens.plans import views as V
from treatlens.plans.queries_baselines import Inputs, _graph
from treatlens.plans.queries_qc import rounded
from treatlens.plans.registry import query
from treatlens.session import cut_lineage

ALPHA = 0.5
SINKHORN_STEPS = 30
SINKHORN_EPS = 0.1


class LetterCounts:
    """Provider that counts the letters A, C, G and T of a sequence."""

    name, version, dim = "letter_counts", "v1", 4

    def batch(self, values: object) -> np.ndarray:
        return np.array([[s.count(c) for c in "ACGT"] for s in values], dtype=np.float32).reshape(-1, 4)


class SumAndMax:
    """Provider that gives the sum and the largest entry of a profile."""

    name, version, dim = "sum_and_max", "v1", 2

    def batch(self, values: object) -> np.ndarray:
        x = np.asarray(values)
        return np.stack([x.sum(1), x.max(1)], axis=1)


@query(
    "embed_sequences_provider",
    """WITH p AS (SELECT DISTINCT o_orderpriority AS pid,
      translate(sha256(o_orderpriority), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM orders),
    c AS (SELECT pid, letter, length(s) - length(replace(s, letter, '')) AS n
          FROM p CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) l(letter))
    SELECT o_orderkey AS cell_id, letter, CAST(n AS BIGINT) AS n FROM orders JOIN c ON pid = o_orderpriority""",
)
def embed_sequences_provider(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.treatments(spark, folder)
    sequences, _ = embeddings.sequence_source(cells)
    vectors = embeddings.treatment_vectors(cells, sequences, LetterCounts())
    letters = F.array(*[F.lit(c) for c in "ACGT"])
    return (
        embeddings.embed_sequences(cells, vectors, "e")
        .select("cell_id", F.posexplode("e").alias("i", "n"))
        .select("cell_id", letters[F.col("i")].alias("letter"), F.col("n").cast("bigint").alias("n"))
    )


@query(
    "embed_cells_provider",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + """SELECT o_orderkey AS cell_id, round(COALESCE(SUM(z), 0)::REAL::DOUBLE, 3) + 0.0 AS total,
      round(COALESCE(MAX(z), 0)::REAL::DOUBLE, 3) + 0.0 AS top
    FROM orders LEFT JOIN normal ON cell_id = o_orderkey GROUP BY 1""",
)
def embed_cells_provider(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    feats = cut_lineage(graph.indexed_features(data.genes), "features")
    sparse = layout.to_sparse(data.expr, feats, "z", data.cells.select("cell_id"))
    done = embeddings.embed_cells(sparse, feats.count(), SumAndMax(), "e")
    return done.select(
        "cell_id",
        rounded(F.col("e")[0].cast("double"), 3).alias("total"),
        rounded(F.col("e")[1].cast("double"), 3).alias("top"),
    )


_SQL_RIDGE = f"""genes AS (SELECT DISTINCT p_brand AS gene_id FROM part),
src AS (SELECT g.gene_id, COALESCE(SUM(z), 0) / (SELECT COUNT(*) FROM cells WHERE condition = 'control') AS source
  FROM genes g LEFT JOIN (SELECT * FROM normal SEMI JOIN (SELECT cell_id AS c FROM cells WHERE condition = 'control') k ON cell_id = c) n
    ON n.gene_id = g.gene_id GROUP BY 1),
rowsd AS (SELECT c.cell_id, g.gene_id, c.knockdown_efficiency_proxy AS k, COALESCE(z, 0) AS y, COALESCE(z, 0) - source AS t, source
  FROM cells c CROSS JOIN genes g JOIN src s ON s.gene_id = g.gene_id
  LEFT JOIN normal n ON n.cell_id = c.cell_id AND n.gene_id = g.gene_id),
fit AS (SELECT gene_id, any_value(source) AS source, covar_pop(k, t) * COUNT(*) / (var_pop(k) * COUNT(*) + {ALPHA}) AS slope,
    AVG(t) AS mt, AVG(k) AS mk FROM rowsd GROUP BY 1),
model AS (SELECT f.gene_id, f.source, slope, mt - slope * mk AS intercept,
    (SELECT AVG((t - (mt - slope * mk) - slope * k) * (t - (mt - slope * mk) - slope * k)) FROM rowsd r WHERE r.gene_id = f.gene_id)
      + 0.0001 AS variance FROM fit f)"""
_SQL_FIT = V.with_sql(V.SQL_EXPR, V.SQL_CELLS, V.SQL_NORMAL, _SQL_RIDGE)


def _one_column_fit(
    spark: SparkSession, folder: str
) -> tuple[transport.LinearTransport, DataFrame, DataFrame, list[str]]:
    cells = cut_lineage(V.cells(spark, folder), "cells")
    data = Inputs(spark, folder)
    feats = cut_lineage(graph.indexed_features(data.genes), "features")
    sparse = layout.to_sparse(data.expr, feats, "z", cells.select("cell_id"))
    covariate = cells.select("cell_id", F.array("knockdown_efficiency_proxy").alias("k"))
    n = feats.count()
    rows, source = transport.transport_pairs(cut_lineage(sparse, "sparse"), cells, n, "control_mean", covariate)
    rows = cut_lineage(rows, "rows")
    ids = [r["gene_id"] for r in feats.orderBy("idx").collect()]
    return transport.fit_linear_transport(rows, source, 1, n, ALPHA), rows, feats, ids


@query(
    "linear_transport_one_covariate",
    _SQL_FIT
    + """SELECT gene_id, round(source, 6) + 0.0 AS source, round(intercept, 6) + 0.0 AS intercept, round(slope, 5) + 0.0 AS slope,
    round(variance, 6) + 0.0 AS variance FROM model""",
)
def linear_transport_one_covariate(spark: SparkSession, folder: str) -> DataFrame:
    model, rows, _, ids = _one_column_fit(spark, folder)
    table = transport.model_rows(model, rows, ids)
    return table.select(
        "gene_id",
        rounded("source").alias("source"),
        rounded(F.col("coef")[0]).alias("intercept"),
        rounded(F.col("coef")[1], 5).alias("slope"),
        rounded("variance").alias("variance"),
    )


@query(
    "predict_distribution_one_covariate",
    _SQL_FIT
    + """SELECT cell_id, gene_id, round(y, 5) + 0.0 AS y, round(m.source + intercept + slope * k, 5) + 0.0 AS p,
    round(variance, 5) + 0.0 AS var FROM rowsd JOIN model m USING (gene_id)""",
)
def predict_one_covariate(spark: SparkSession, folder: str) -> DataFrame:
    model, rows, _, ids = _one_column_fit(spark, folder)
    pairs = transport.prediction_pairs(rows, model, ids)
    return pairs.select("cell_id", "gene_id", *[rounded(c, 5).alias(c) for c in ("y", "p", "var")])


@query(
    "model_moments",
    _SQL_FIT
    + """, e AS (SELECT gene_id, y, m.source + intercept + slope * k AS p, variance FROM rowsd JOIN model m USING (gene_id))
    SELECT gene_id, CAST(COUNT(*) AS DOUBLE) AS n, round(AVG(abs(y - p)), 6) + 0.0 AS mae, round(AVG((y - p) * (y - p)), 6) + 0.0 AS mse,
    round(AVG(y), 6) + 0.0 AS mean_y, round(corr(y, p), 5) + 0.0 AS pearson,
    round(AVG(abs(sqrt(variance) - abs(y - p))), 6) + 0.0 AS gap FROM e GROUP BY 1""",
)
def model_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Per-gene scores of the fitted model without any dense row."""
    model, rows, feats, _ = _one_column_fit(spark, folder)
    moments = cut_lineage(transport.model_moments(rows, model, feats), "moments")
    n = F.col("n")
    return moments.join(M.gene_pearson(moments).drop("name"), "gene_id").select(
        "gene_id",
        "n",
        rounded(F.col("abs_sum") / n).alias("mae"),
        rounded(F.col("sq_sum") / n).alias("mse"),
        rounded("mean_y").alias("mean_y"),
        rounded("pearson", 5).alias("pearson"),
        rounded(F.col("gap_sum") / n).alias("gap"),
    )


def _sinkhorn_sql() -> str:
    parts = [
        "x AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS grp, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 0)",
        "y AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0)",
        """cost AS MATERIALIZED (SELECT grp, x.id AS xi, y.id AS yi,
          list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS c FROM x CROSS JOIN y)""",
        "nx AS MATERIALIZED (SELECT grp, COUNT(*) AS nx, (SELECT COUNT(*) FROM y) AS ny FROM x GROUP BY 1)",
        "g0 AS MATERIALIZED (SELECT DISTINCT grp, yi, 0.0::DOUBLE AS pot FROM cost)",
    ]
    for k in range(1, SINKHORN_STEPS + 1):
        for new, old, own, other, size in ((f"f{k}", f"g{k - 1}", "xi", "yi", "nx"), (f"g{k}", f"f{k}", "yi", "xi", "ny")):
            parts.append(
                f"""{new} AS MATERIALIZED (SELECT grp, {own}, -ln(any_value({size})) - (any_value(m) + ln(SUM(exp(e - m)))) AS pot
          FROM (SELECT grp, {own}, e, MAX(e) OVER (PARTITION BY grp, {own}) AS m FROM
            (SELECT cost.grp, cost.{own}, pot - c / {SINKHORN_EPS} AS e FROM cost JOIN {old} p ON p.grp = cost.grp AND p.{other} = cost.{other}))
          JOIN nx USING (grp) GROUP BY grp, {own})"""
            )
    last = SINKHORN_STEPS
    return V.with_sql(*parts) + f"""SELECT grp, any_value(nx) AS n_x, any_value(ny) AS n_y,
      round(SUM(exp(f.pot + g.pot - c / {SINKHORN_EPS}) * c), 4) + 0.0 AS sinkhorn
    FROM cost JOIN f{last} f USING (grp, xi) JOIN g{last} g USING (grp, yi) JOIN nx USING (grp) GROUP BY grp"""


@query("sinkhorn_distance", _sinkhorn_sql())
def sinkhorn(spark: SparkSession, folder: str) -> DataFrame:
    """Every label's vectors against those of label 0, all vectors."""
    vectors = V.table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("grp"),
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    control = vectors.where(F.col("grp") == "0").select("id", "v")
    done = transport.sinkhorn_distance(
        vectors.where(F.col("grp") != "0"), control, SINKHORN_EPS, SINKHORN_STEPS
    )
    return done.select("grp", "n_x", F.col("n_y").cast("bigint").alias("n_y"), rounded("sinkhorn", 4).alias("sinkhorn"))


@query(
    "rewire_invariants",
    """WITH n AS (SELECT 2.0 * COUNT(DISTINCT p_brand) AS n FROM part)
    SELECT unnest(['edge_count_reference', 'edge_count_random', 'out_degree_l1_diff', 'in_degree_l1_diff', 'self_edges', 'repeated_edges']) AS metric,
      unnest([n, n, 0.0, 0.0, 0.0, 0.0])::DOUBLE AS value FROM n""",
)
def rewire_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rewiring keeps edge count and degrees and makes no self or repeated edge."""
    base = cut_lineage(_graph(Inputs(spark, folder)), "graph")
    done = cut_lineage(graph.rewire(base, seed=42), "rewired")
    scores = graph.graph_metrics(base, done).where(F.col("metric") != "edge_overlap_fraction")
    extra = done.agg(
        F.count_if(F.col("src") == F.col("dst")).cast("double").alias("self_edges"),
        (F.count(F.lit(1)) - F.count_distinct("src", "dst")).cast("double").alias("repeated_edges"),
    )
    return scores.unionByName(extra.unpivot([], extra.columns, "metric", "value"))
