"""Reference SQL of the two-stage graph fit: explicit indicators, Gauss-Jordan in recursive queries."""

from __future__ import annotations

from treatlens.operators.ivgraph import GraphSettings, poisson_steps
from treatlens.plans import views as V

_CFG = GraphSettings()


def _sweep(tag: str, alpha: float) -> str:
    """``{tag}_w (draw, i, y, weight)`` from ``{tag}_e (draw, i, j, v)``, ``{tag}_r (draw, i, y, v)`` and ``{tag}_c (j, kind, pos)``."""
    step = (
        "list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1]) "
        "ELSE list_transform(r, lambda x, j: x - r[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END)"
    )
    return f""",
{tag}_n AS (SELECT count(*)::INT AS n FROM {tag}_c),
{tag}_left AS (
  SELECT draw, a.pos, list(v + CASE WHEN a.j = b.j AND a.kind > 0 THEN {alpha!r} ELSE 0 END ORDER BY b.pos) AS r
  FROM {tag}_e AS e JOIN {tag}_c AS a ON a.j = e.i JOIN {tag}_c AS b ON b.j = e.j GROUP BY draw, a.pos),
{tag}_right AS (SELECT draw, a.pos, list(v ORDER BY y) AS r FROM {tag}_r AS e JOIN {tag}_c AS a ON a.j = e.i GROUP BY draw, a.pos),
{tag}_m AS (
  SELECT l.draw, list(l.r || list_transform(range(1, n + 1), lambda p: (p = l.pos)::DOUBLE) || q.r ORDER BY l.pos) AS m
  FROM {tag}_left AS l JOIN {tag}_right AS q ON q.draw = l.draw AND q.pos = l.pos, {tag}_n GROUP BY l.draw),
{tag}_gj(draw, k, m) AS (SELECT draw, 0, m FROM {tag}_m UNION ALL SELECT draw, k + 1, {step} FROM {tag}_gj WHERE k < len(m)),
{tag}_s AS (
  SELECT draw, a.j AS i, b.j AS y, m[a.pos][n + b.pos] AS p, m[a.pos][2 * n + b.nr] AS u
  FROM {tag}_gj, {tag}_n, (SELECT * FROM {tag}_c WHERE kind = 3) AS a,
       (SELECT *, row_number() OVER (ORDER BY j) AS nr FROM {tag}_c WHERE kind = 3) AS b WHERE k = n),
{tag}_w AS (
  SELECT s.draw, s.i, s.y, s.u - s.p * (d.u / d.p) AS weight
  FROM {tag}_s AS s JOIN {tag}_s AS d ON d.draw = s.draw AND d.i = s.y AND d.y = s.y WHERE s.i <> s.y)"""


def graph_sql(draws: int = 0, control: str = V.CONTROL_PRIORITY) -> str:
    """``iv_w``, ``naive_w`` (draw, i, y, weight), ``r2`` and ``cols`` (j, kind, name) over all brands.

    Kinds of columns: 0 the intercept, 1 treatments, 2 proxies, 3 features.
    """
    steps = ", ".join(map(repr, poisson_steps()))
    u = f"('0x' || substr(md5(cell_id || ':' || draw || ':{_CFG.seed}'), 1, 13))::BIGINT / 4503599627370496.0"
    return V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, V.SQL_CELLS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
stats AS (SELECT avg(library_size) AS lm, stddev_pop(library_size) AS ls,
  avg(knockdown_efficiency_proxy) AS km, stddev_pop(knockdown_efficiency_proxy) AS ks FROM cells),
dr AS (SELECT range::INT AS draw FROM range({draws + 1})),
wt AS (SELECT cell_id, draw, CASE WHEN draw = 0 THEN 1.0 ELSE len(list_filter([{steps}], lambda s: s <= {u})) END::DOUBLE AS w FROM cells, dr),
xs AS (
  SELECT cell_id, 0 AS kind, '' AS name, 1.0::DOUBLE AS v FROM cells
  UNION ALL SELECT cell_id, 1, perturbation_id, 1.0 FROM cells WHERE perturbation_id <> '{control}'
  UNION ALL SELECT cell_id, 2, 'library', (library_size - lm) / ls FROM cells, stats
  UNION ALL SELECT cell_id, 2, 'knockdown', (knockdown_efficiency_proxy - km) / ks FROM cells, stats
  UNION ALL SELECT cell_id, 2, 'batch=' || batch, 1.0 FROM cells
  UNION ALL SELECT cell_id, 2, 'protocol=' || protocol, 1.0 FROM cells
  UNION ALL SELECT cell_id, 3, gene_id, z FROM normal),
cols AS (SELECT kind, name, row_number() OVER (ORDER BY kind, name) AS j FROM (SELECT DISTINCT kind, name FROM xs)),
x AS (SELECT cell_id, j, v FROM xs JOIN cols USING (kind, name)),
g0 AS (SELECT draw, a.j AS i, b.j AS j, sum(w * a.v * b.v) AS v FROM x AS a JOIN x AS b USING (cell_id) JOIN wt USING (cell_id) GROUP BY ALL),
g AS (
  SELECT dr.draw, a.j AS i, b.j AS j, a.kind AS ki, b.kind AS kj, coalesce(v, 0) AS v
  FROM dr, cols AS a, cols AS b LEFT JOIN g0 ON g0.draw = dr.draw AND g0.i = a.j AND g0.j = b.j),
one_m AS (
  SELECT draw, list(r ORDER BY i) AS m FROM (
    SELECT draw, i, list(v + CASE WHEN i = j AND ki > 0 THEN {_CFG.stage1_alpha!r} ELSE 0 END ORDER BY j) AS r FROM g WHERE ki < 3 GROUP BY draw, i) GROUP BY draw),
one_gj(draw, k, m) AS (
  SELECT draw, 0, m FROM one_m UNION ALL
  SELECT draw, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1])
    ELSE list_transform(r, lambda x, j: x - r[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END) FROM one_gj WHERE k < len(m)),
b AS (SELECT draw, a.j AS i, y.j AS y, m[a.j][y.j] AS v FROM one_gj, cols AS a, cols AS y WHERE k = len(m) AND a.kind < 3 AND y.kind = 3),
fx AS (SELECT b.draw, b.y, g.j, g.kj, sum(b.v * g.v) AS v FROM b JOIN g ON g.draw = b.draw AND g.i = b.i GROUP BY ALL),
ff AS (SELECT fx.draw, fx.y, b.y AS z, sum(fx.v * b.v) AS v FROM fx JOIN b ON b.draw = fx.draw AND b.i = fx.j GROUP BY ALL),
iv_c AS (SELECT j, kind, row_number() OVER (ORDER BY kind = 2, kind, j) AS pos FROM cols WHERE kind <> 1),
iv_e AS (
  SELECT draw, i, j, v FROM g WHERE ki IN (0, 2) AND kj IN (0, 2)
  UNION ALL SELECT draw, y, j, v FROM fx WHERE kj IN (0, 2) UNION ALL SELECT draw, j, y, v FROM fx WHERE kj IN (0, 2)
  UNION ALL SELECT draw, y, z, v FROM ff),
iv_r AS (SELECT draw, i, j AS y, v FROM g WHERE ki IN (0, 2) AND kj = 3 UNION ALL SELECT draw, y, j, v FROM fx WHERE kj = 3){_sweep("iv", _CFG.stage2_alpha)},
naive_c AS (SELECT j, kind, row_number() OVER (ORDER BY kind, j) AS pos FROM cols WHERE kind IN (0, 3)),
naive_e AS (SELECT draw, i, j, v FROM g WHERE draw = 0 AND ki IN (0, 3) AND kj IN (0, 3)),
naive_r AS (SELECT draw, i, j AS y, v FROM g WHERE draw = 0 AND ki IN (0, 3) AND kj = 3){_sweep("naive", _CFG.stage2_alpha)},
r2 AS (
  SELECT g.i AS y, 1 - (g.v - 2 * fx.v + ff.v) / greatest(g.v - t.v * t.v / n.v, 1e-12) AS v
  FROM g JOIN fx ON fx.draw = 0 AND fx.y = g.i AND fx.j = g.i JOIN ff ON ff.draw = 0 AND ff.y = g.i AND ff.z = g.i
  JOIN g AS t ON t.draw = 0 AND t.i = g.i AND t.kj = 0 JOIN g AS n ON n.draw = 0 AND n.ki = 0 AND n.kj = 0
  WHERE g.draw = 0 AND g.i = g.j AND g.ki = 3)
"""


def edges_sql(draws: int) -> str:
    """Point weights of all pairs with the spread over the draws."""
    spread = (
        """, q AS (SELECT i, y, stddev_samp(weight) AS se, quantile_cont(weight, 0.025) AS lo, quantile_cont(weight, 0.975) AS hi
  FROM iv_w WHERE draw > 0 GROUP BY i, y)"""
        if draws
        else ", q AS (SELECT i, y, 0::DOUBLE AS se, 0::DOUBLE AS lo, 0::DOUBLE AS hi FROM iv_w)"
    )
    return graph_sql(draws) + spread + """
SELECT a.name AS source_gene_id, t.name AS target_gene_id, round(weight, 4) + 0.0 AS weight, round(se, 4) + 0.0 AS standard_error,
       round(lo, 4) + 0.0 AS ci_lower, round(hi, 4) + 0.0 AS ci_upper
FROM iv_w AS w JOIN q USING (i, y) JOIN cols AS a ON a.j = i JOIN cols AS t ON t.j = y WHERE draw = 0"""


NAIVE_SQL = graph_sql() + """
SELECT a.name AS source_gene_id, t.name AS target_gene_id, round(weight, 4) + 0.0 AS weight
FROM naive_w AS w JOIN cols AS a ON a.j = i JOIN cols AS t ON t.j = y"""

DIAGNOSTICS_SQL = graph_sql() + """
SELECT round((SELECT avg(v) FROM r2), 6) + 0.0 AS stage1_r2_mean, round(iv, 5) + 0.0 AS iv_offdiag_l1_mean,
       round(nv, 5) + 0.0 AS naive_offdiag_l1_mean, round(iv - nv, 5) + 0.0 AS iv_minus_naive_offdiag_l1_mean
FROM (SELECT avg(abs(weight)) AS iv FROM iv_w WHERE draw = 0), (SELECT avg(abs(weight)) AS nv FROM naive_w)"""
