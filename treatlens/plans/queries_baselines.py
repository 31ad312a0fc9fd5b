"""Queries for baselines, scores, calibration, comparison, rules and graph baselines.

Training leaves one whole treatment out (a context-shift holdout), evaluation
covers every cell, so the unseen-treatment rules take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treatlens.operators import baselines, graph, metrics, qc
from treatlens.operators.gram import gram
from treatlens.operators.layout import restrict, to_sparse
from treatlens.plans import views as V
from treatlens.plans.queries_qc import rounded
from treatlens.plans.registry import query
from treatlens.schema import BASELINE_NAMES
from treatlens.session import clustered

HELD_OUT = "3-MEDIUM"
NAMES = baselines.EXPRESSION_BASELINES


class Inputs:
    """Normalised counts, cells and the train side of the holdout; if ``tagged``, counts carry the treatment of their cell."""

    def __init__(self, spark: SparkSession, folder: str, tagged: bool = False) -> None:
        # A stage table: several passes follow, each over one or two columns.
        normal = qc.normalise_log1p(V.expr(spark, folder)).select("cell_id", "gene_id", "z")
        self.cells = V.treatments(spark, folder)
        if tagged:
            # Both sides are dealt by cell into as many parts, so the counts are not shuffled for it.
            own = clustered(self.cells, "cell_id", V.table(spark, folder, "lineitem").count())
            normal = normal.join(own, "cell_id").select("gene_id", "z", "perturbation_id", "condition")
        self.expr = metrics.cut_lineage(normal, "normal")
        self.train_cells = self.cells.where(F.col("perturbation_id") != HELD_OUT)
        # The fit joins the counts to the training cells, which drops the rest.
        self.train_expr = self.expr.where(F.col("perturbation_id") != HELD_OUT) if tagged else self.expr
        self.genes = V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id")).distinct()

    def predictions(self) -> DataFrame:
        return baselines.expression_predictions(self.train_expr, self.train_cells, self.cells, self.genes)


SQL_PRED = f"""genes AS (SELECT DISTINCT p_brand AS gene_id FROM part),
train AS (SELECT * FROM cells WHERE perturbation_id <> '{HELD_OUT}'),
tz AS (SELECT n.*, perturbation_id, condition FROM normal n JOIN train USING (cell_id)),
k_train AS (SELECT perturbation_id, COUNT(*) AS n FROM train GROUP BY 1),
k_eval AS (SELECT perturbation_id, COUNT(*) AS n_eval FROM cells GROUP BY 1),
gm AS (SELECT perturbation_id, gene_id, COALESCE(SUM(z), 0) / any_value(k.n) AS mean,
         COALESCE(SUM(z * z), 0) / any_value(k.n) - pow(COALESCE(SUM(z), 0) / any_value(k.n), 2) AS var
       FROM k_train k CROSS JOIN genes g LEFT JOIN tz USING (perturbation_id, gene_id) GROUP BY 1, 2),
gavg AS (SELECT g.gene_id, COALESCE(SUM(z), 0) / (SELECT COUNT(*) FROM train) AS gmean,
           COALESCE(SUM(z) FILTER (condition = 'control'), 0)
             / (SELECT COUNT(*) FROM train WHERE condition = 'control') AS cmean
         FROM genes g LEFT JOIN tz USING (gene_id) GROUP BY 1),
inter AS (SELECT gene_id, SUM(mean) / (COUNT(*) + 1) AS b0 FROM gm GROUP BY 1),
pred AS (SELECT perturbation_id, gene_id, n_eval, mean IS NOT NULL AS seen, COALESCE(var, 0) AS var,
           COALESCE(mean, gmean) AS gene_level_mean, cmean AS control_mean,
           COALESCE(mean, b0) AS linear_regression
         FROM k_eval CROSS JOIN genes LEFT JOIN gm USING (perturbation_id, gene_id)
         JOIN gavg USING (gene_id) JOIN inter USING (gene_id)),
dense AS (SELECT c.cell_id, p.perturbation_id, p.gene_id, COALESCE(z, 0) AS y, var,
            gene_level_mean, control_mean, linear_regression
          FROM cells c JOIN pred p USING (perturbation_id) LEFT JOIN normal n USING (cell_id, gene_id)),
longp AS (SELECT 'gene_level_mean' AS name, gene_id, y, gene_level_mean AS p, var FROM dense
  UNION ALL SELECT 'control_mean', gene_id, y, control_mean, var FROM dense
  UNION ALL SELECT 'linear_regression', gene_id, y, linear_regression, var FROM dense),
per_gene AS (SELECT name, gene_id, COUNT(*) AS n, SUM(abs(y - p)) AS a, SUM((y - p) * (y - p)) AS s,
    STDDEV_POP(y) AS sy, CASE WHEN max(p) = min(p) THEN 0.0 ELSE STDDEV_POP(p) END AS sp,
    COVAR_POP(y, p) AS c, AVG(y) AS my FROM longp GROUP BY 1, 2),
pear AS (SELECT name, gene_id, c / (sy * sp) AS r FROM per_gene WHERE sy > 1e-8 AND sp > 1e-8),
score AS (SELECT name, SUM(a) / SUM(n) AS mae, sqrt(SUM(s) / SUM(n)) AS rmse,
    COALESCE(any_value(pr), 0) AS pearson_mean_gene
  FROM per_gene LEFT JOIN (SELECT name, AVG(r) AS pr FROM pear GROUP BY 1) USING (name) GROUP BY 1),
suite AS (SELECT name AS baseline, 'expression' AS task, 'mae' AS metric, mae AS value FROM score
  UNION ALL SELECT name, 'expression', 'rmse', rmse FROM score
  UNION ALL SELECT name, 'expression', 'pearson_mean_gene', pearson_mean_gene FROM score),
ctl AS (SELECT gene_id, SUM(z) FILTER (condition = 'control')
          / (SELECT COUNT(*) FROM cells WHERE condition = 'control') AS cm
        FROM normal JOIN cells USING (cell_id) GROUP BY 1),
degs AS (SELECT gene_id, abs(my - COALESCE(cm, 0)) AS score FROM per_gene LEFT JOIN ctl USING (gene_id)
         WHERE name = 'gene_level_mean' ORDER BY score DESC, gene_id LIMIT 10),
topp AS (SELECT name, COALESCE(AVG(r), 0) AS p FROM per_gene LEFT JOIN pear USING (name, gene_id)
         WHERE gene_id IN (SELECT gene_id FROM degs) GROUP BY 1),
std AS (SELECT sqrt(greatest(var, 1e-12)) AS std, abs(y - p) AS e FROM longp WHERE name = 'gene_level_mean'),
edges AS (SELECT quantile_cont(std, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM std),
bins AS (SELECT len(list_filter(q, lambda x: x <= std)) AS b, COUNT(*) AS n, AVG(std) AS s, AVG(e) AS a
         FROM std, edges GROUP BY 1),
calib AS (SELECT SUM(n * abs(s - a)) / SUM(n) AS calibration_error FROM bins),
model AS (SELECT mae, p AS pearson_top_1000_degs, calibration_error
          FROM score JOIN topp USING (name), calib WHERE name = 'gene_level_mean'),
cmp AS (SELECT b.name AS baseline_name, b.mae AS baseline_mae, m.mae AS model_mae,
    m.mae - b.mae AS delta_mae_model_minus_baseline, m.mae < b.mae AS model_beats_baseline_mae,
    b.pearson_mean_gene AS baseline_pearson_mean_gene, m.pearson_top_1000_degs AS model_pearson_top_1000_degs,
    m.pearson_top_1000_degs - b.pearson_mean_gene AS delta_pearson_model_minus_baseline
  FROM score b, model m WHERE b.name <> 'gene_level_mean')"""

SQL = V.with_sql(V.SQL_EXPR, V.SQL_TREATMENTS, V.SQL_NORMAL, SQL_PRED)


def _prediction_sql(name: str) -> str:
    return SQL + f"SELECT perturbation_id, gene_id, seen, round({name}, 6) + 0.0 AS prediction FROM pred"


@query("group_mean_baseline", _prediction_sql("gene_level_mean"))
def group_mean(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.group_mean_baseline(Inputs(spark, folder).predictions()).withColumn(
        "prediction", rounded("prediction")
    )


@query("control_mean_baseline", _prediction_sql("control_mean"))
def control_mean(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.control_mean_baseline(Inputs(spark, folder).predictions()).withColumn(
        "prediction", rounded("prediction")
    )


@query("onehot_regression_baseline", _prediction_sql("linear_regression"))
def onehot_regression(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.onehot_regression_baseline(Inputs(spark, folder).predictions()).withColumn(
        "prediction", rounded("prediction")
    )


@query(
    "unseen_summary",
    SQL
    + """SELECT COUNT(DISTINCT perturbation_id) FILTER (seen) AS n_eval_treatments_seen,
    CAST(COALESCE(SUM(n_eval) FILTER (NOT seen AND gene_id = (SELECT MIN(gene_id) FROM genes)), 0) AS BIGINT)
      AS n_eval_cells_unseen FROM pred""",
)
def unseen(spark: SparkSession, folder: str) -> DataFrame:
    return baselines.unseen_summary(Inputs(spark, folder).predictions())


def _moments(data: Inputs) -> DataFrame:
    return metrics.grouped_moments(data.expr, data.cells, data.predictions(), NAMES)


@query(
    "regression_metrics",
    SQL + "SELECT name, round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse FROM score",
)
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    done = metrics.scores(_moments(Inputs(spark, folder)))
    return done.select("name", rounded("mae").alias("mae"), rounded("rmse").alias("rmse"))


@query(
    "mean_feature_pearson",
    SQL + "SELECT name, gene_id, round(r, 6) + 0.0 AS pearson FROM pear",
)
def mean_feature_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.gene_pearson(_moments(Inputs(spark, folder))).withColumn("pearson", rounded("pearson"))


@query(
    "baseline_suite",
    SQL + "SELECT baseline, task, metric, round(value, 6) + 0.0 AS value FROM suite",
)
def suite(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    rows = baselines.baseline_suite(data.train_expr, data.train_cells, data.expr, data.cells, data.genes)
    return rows.withColumn("value", rounded("value"))


@query(
    "baseline_gate",
    SQL
    + """SELECT baseline FROM (VALUES ('gene_level_mean'), ('control_mean'), ('linear_regression'),
    ('random_edge_grn')) AS r(baseline) WHERE baseline NOT IN (SELECT baseline FROM suite)""",
)
def gate(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    rows = baselines.baseline_suite(data.train_expr, data.train_cells, data.expr, data.cells, data.genes)
    return baselines.require_baselines(rows, BASELINE_NAMES)


def _control(data: Inputs) -> DataFrame:
    return qc.group_profiles(data.expr, data.cells, data.genes).groupBy("gene_id").agg(
        F.first("control_mean").alias("control_mean")
    )


@query(
    "control_profile",
    SQL + "SELECT gene_id, round(COALESCE(cm, 0), 6) + 0.0 AS control_mean FROM genes LEFT JOIN ctl USING (gene_id)",
)
def control_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _control(Inputs(spark, folder)).withColumn("control_mean", rounded("control_mean"))


@query("top_degs", SQL + "SELECT gene_id, round(score, 6) + 0.0 AS score FROM degs")
def top_degs(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    profiles = qc.group_profiles(data.expr, data.cells, data.genes)
    per_gene = profiles.groupBy("gene_id").agg(
        F.first("global_mean").alias("mean_y"), F.first("control_mean").alias("control_mean")
    )
    top = metrics.top_degs(
        per_gene.select("gene_id", "mean_y"), per_gene.select("gene_id", "control_mean"), 10
    )
    return top.withColumn("score", rounded("score"))


@query(
    "pearson_top_degs",
    SQL + "SELECT name, round(p, 6) + 0.0 AS pearson_top_1000_degs FROM topp",
)
def pearson_top_degs(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    done = metrics.pearson_top_degs(_moments(data), _control(data), 10)
    return done.withColumn("pearson_top_1000_degs", rounded("pearson_top_1000_degs"))


def _calibration(data: Inputs, predictions: DataFrame | None = None) -> DataFrame:
    preds = data.predictions() if predictions is None else predictions
    rows = metrics.grouped_calibration_rows(data.expr, data.cells, preds, "gene_level_mean")
    return metrics.calibration_error(rows)


@query(
    "calibration_error",
    SQL + "SELECT round(calibration_error, 6) + 0.0 AS calibration_error FROM calib",
)
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return _calibration(Inputs(spark, folder)).withColumn("calibration_error", rounded("calibration_error"))


def _model_row(data: Inputs) -> tuple[DataFrame, DataFrame]:
    """Scores of the group mean taken as the model, and the suite of the other baselines."""
    preds = metrics.cut_lineage(data.predictions(), "predictions")
    moments = metrics.cut_lineage(metrics.grouped_moments(data.expr, data.cells, preds, NAMES), "moments")
    named = moments.where(F.col("name") == "gene_level_mean")
    model = metrics.scores(named).select("mae").withColumn(
        "pearson_top_1000_degs",
        metrics.pearson_top_degs(named, _control(data), 10).select("pearson_top_1000_degs").scalar(),
    ).withColumn("calibration_error", _calibration(data, preds).scalar())
    rest = metrics.suite_rows(moments.where(F.col("name") != "gene_level_mean"))
    return metrics.cut_lineage(model, "model"), rest


@query(
    "baseline_comparison",
    SQL
    + """SELECT baseline_name, model_beats_baseline_mae, round(baseline_mae, 6) + 0.0 AS baseline_mae,
    round(model_mae, 6) + 0.0 AS model_mae,
    round(delta_mae_model_minus_baseline, 6) + 0.0 AS delta_mae_model_minus_baseline,
    round(baseline_pearson_mean_gene, 6) + 0.0 AS baseline_pearson_mean_gene,
    round(model_pearson_top_1000_degs, 6) + 0.0 AS model_pearson_top_1000_degs,
    round(delta_pearson_model_minus_baseline, 6) + 0.0 AS delta_pearson_model_minus_baseline FROM cmp""",
)
def comparison(spark: SparkSession, folder: str) -> DataFrame:
    model, rest = _model_row(Inputs(spark, folder, tagged=True))
    done = metrics.baseline_comparison(rest, model)
    doubles = [c for c, kind in done.dtypes if kind == "double"]
    return done.select(
        "baseline_name", "model_beats_baseline_mae", *[rounded(c).alias(c) for c in doubles]
    )


@query(
    "failure_modes",
    SQL
    + """, lost AS (SELECT COUNT(*) FILTER (NOT model_beats_baseline_mae) AS n FROM cmp),
    hits AS (
      SELECT 'high_mae' AS code, 'critical' AS severity, 'mae' AS metric, mae AS value, 1.0 AS threshold FROM model WHERE mae > 1.0
      UNION ALL SELECT 'low_deg_pearson', 'warning', 'pearson_top_1000_degs', pearson_top_1000_degs, 0.1 FROM model
        WHERE pearson_top_1000_degs < 0.1
      UNION ALL SELECT 'poor_calibration', 'warning', 'calibration_error', calibration_error, 0.75 FROM model
        WHERE calibration_error > 0.75
      UNION ALL SELECT 'baseline_underperformance', 'warning', 'delta_mae_model_minus_baseline', n, 0 FROM lost WHERE n > 0)
    SELECT code, severity, metric, CAST(round(value, 6) + 0.0 AS DOUBLE) AS value,
      CAST(threshold AS DOUBLE) AS threshold FROM hits
    UNION ALL SELECT 'no_failure_modes_detected', 'info', 'n_failures', 0.0, 0.0
      WHERE (SELECT COUNT(*) FROM hits) = 0""",
)
def failures(spark: SparkSession, folder: str) -> DataFrame:
    model, rest = _model_row(Inputs(spark, folder, tagged=True))
    done = metrics.failure_modes(model, metrics.baseline_comparison(rest, model))
    return done.drop("message").withColumn("value", rounded("value"))


@query(
    "report_deltas",
    SQL
    + """SELECT round(MAX(delta_mae_model_minus_baseline) FILTER (baseline_name = 'control_mean'), 6) + 0.0
      AS delta_mae_vs_control_mean,
    COALESCE(bool_or(model_beats_baseline_mae) FILTER (baseline_name = 'control_mean'), FALSE) AS beats_control_mean,
    round(MAX(delta_mae_model_minus_baseline) FILTER (baseline_name = 'linear_regression'), 6) + 0.0
      AS delta_mae_vs_linear_regression,
    COALESCE(bool_or(model_beats_baseline_mae) FILTER (baseline_name = 'linear_regression'), FALSE)
      AS beats_linear_regression,
    CAST(NULL AS DOUBLE) AS delta_mae_vs_gene_level_mean, FALSE AS beats_gene_level_mean FROM cmp""",
)
def deltas(spark: SparkSession, folder: str) -> DataFrame:
    model, rest = _model_row(Inputs(spark, folder, tagged=True))
    done = metrics.report_deltas(metrics.baseline_comparison(rest, model))
    return done.select(
        *[rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in done.dtypes]
    )


@query(
    "gaussian_nll",
    SQL
    + """SELECT round(0.5 * AVG((y - p) * (y - p) / (var + 0.0001) + ln(var + 0.0001)), 6) + 0.0 AS nll,
    round(AVG((y - p) * (y - p)), 6) + 0.0 AS mse FROM longp WHERE name = 'gene_level_mean'""",
)
def nll(spark: SparkSession, folder: str) -> DataFrame:
    """Per-cell likelihood of the group mean; each cell meets the genes of its own treatment."""
    data = Inputs(spark, folder)
    preds = data.predictions().select("perturbation_id", "gene_id", "gene_level_mean", "var")
    grid = data.cells.select("cell_id", "perturbation_id").join(preds, "perturbation_id")
    pairs = grid.join(data.expr, ["cell_id", "gene_id"], "left").select(
        F.coalesce("z", F.lit(0.0)).alias("y"),
        F.col("gene_level_mean").alias("p"),
        (F.col("var") + 1e-4).alias("var"),
    )
    done = metrics.gaussian_nll(pairs)
    return done.select(rounded("nll").alias("nll"), rounded("mse").alias("mse"))


SQL_CORR = """feat AS (SELECT DISTINCT p_brand AS gene_id FROM part),
n AS (SELECT COUNT(*) AS n FROM orders),
s AS (SELECT gene_id, COALESCE(SUM(z), 0) AS s, COALESCE(SUM(z * z), 0) AS ss
      FROM feat LEFT JOIN normal USING (gene_id) GROUP BY 1),
xy AS (SELECT a.gene_id AS src, b.gene_id AS dst, SUM(a.z * b.z) AS xy
       FROM normal a JOIN normal b USING (cell_id) GROUP BY 1, 2),
pairs AS (SELECT a.gene_id AS src, b.gene_id AS dst, COALESCE(xy, 0) AS xy, a.s AS sa, b.s AS sb,
    a.ss AS ssa, b.ss AS ssb, n FROM s a CROSS JOIN s b CROSS JOIN n
    LEFT JOIN xy ON xy.src = a.gene_id AND xy.dst = b.gene_id),
corr AS (SELECT src, dst, (xy - sa * sb / n) / sqrt((ssa - sa * sa / n) * (ssb - sb * sb / n)) AS r
         FROM pairs WHERE src <> dst),
top2 AS (SELECT src, dst, r FROM corr
         QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(r) DESC, dst) <= 2)"""


@query(
    "gram",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, SQL_CORR)
    + "SELECT src, dst, round(xy, 3) + 0.0 AS value FROM pairs",
)
def gram_query(spark: SparkSession, folder: str) -> DataFrame:
    data = Inputs(spark, folder)
    feats = metrics.cut_lineage(graph.indexed_features(data.genes), "features")
    rows = to_sparse(data.expr, feats, "z", data.cells.select("cell_id"))
    entries = gram(rows, 0, feats.count()).where((F.col("i") > 0) & (F.col("j") > 0))
    a = feats.select((F.col("idx") + 1).alias("i"), F.col("gene_id").alias("src"))
    b = feats.select((F.col("idx") + 1).alias("j"), F.col("gene_id").alias("dst"))
    return entries.join(a, "i").join(b, "j").select("src", "dst", rounded("value", 3).alias("value"))


def _graph(data: Inputs) -> DataFrame:
    feats = metrics.cut_lineage(graph.indexed_features(data.genes), "features")
    return graph.correlation_graph(data.expr, data.cells, feats)


@query(
    "correlation_graph",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, SQL_CORR)
    + "SELECT src, dst, round(r, 6) + 0.0 AS weight FROM top2",
)
def correlation_graph(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(Inputs(spark, folder)).withColumn("weight", rounded("weight"))


@query(
    "graph_metrics",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, SQL_CORR)
    + """, top1 AS (SELECT src, dst FROM corr QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(r) DESC, dst) <= 1),
    m AS (SELECT COALESCE(a.src, b.src) AS src, COALESCE(a.dst, b.dst) AS dst,
            CAST(a.src IS NOT NULL AS INT) AS a, CAST(b.src IS NOT NULL AS INT) AS b
          FROM top2 a FULL JOIN top1 b ON a.src = b.src AND a.dst = b.dst)
    SELECT 'edge_count_reference' AS metric, CAST(SUM(a) AS DOUBLE) AS value FROM m
    UNION ALL SELECT 'edge_count_random', CAST(SUM(b) AS DOUBLE) FROM m
    UNION ALL SELECT 'out_degree_l1_diff', CAST(SUM(d) AS DOUBLE) FROM (SELECT abs(SUM(a) - SUM(b)) AS d FROM m GROUP BY src)
    UNION ALL SELECT 'in_degree_l1_diff', CAST(SUM(d) AS DOUBLE) FROM (SELECT abs(SUM(a) - SUM(b)) AS d FROM m GROUP BY dst)
    UNION ALL SELECT 'edge_overlap_fraction', round(CAST(SUM(a * b) AS DOUBLE) / SUM(a), 6) FROM m""",
)
def graph_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The two-edge graph against the one-edge graph of the same correlations."""
    two = metrics.cut_lineage(_graph(Inputs(spark, folder)), "graph")
    strongest = Window.partitionBy("src").orderBy(F.desc(F.abs("weight")), F.asc("dst"))
    one = two.withColumn("_r", F.row_number().over(strongest)).where("_r = 1").drop("_r")
    return graph.graph_metrics(two, one).withColumn("value", rounded("value"))


@query("rewire")
def rewire(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the rewired correlation graph: both degree differences are 0."""
    base = metrics.cut_lineage(_graph(Inputs(spark, folder)), "graph")
    return graph.graph_metrics(base, graph.rewire(base, seed=42))


@query(
    "restrict",
    V.with_sql(V.SQL_EXPR, V.SQL_TREATMENTS)
    + "SELECT e.* FROM expr e SEMI JOIN (SELECT * FROM cells WHERE condition = 'control') c ON e.cell_id = c.cell_id",
)
def restrict_query(spark: SparkSession, folder: str) -> DataFrame:
    mask = V.treatments(spark, folder).where(F.col("condition") == "control")
    return restrict(V.expr(spark, folder), mask)
