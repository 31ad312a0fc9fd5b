"""Two-stage instrumental-variable feature graph.

Stage 1 regresses every feature on treatment indicators and proxies; stage 2
regresses every feature on the fitted values of the others and the proxies.
Both stages, for the point estimate and for all bootstrap draws, follow from
one pass of products over the cells: treatment indicators are eliminated
algebraically (their block of the normal equations is diagonal), so any number
of treatments is fine, and fitted rows are never built. Batches and protocols
are sparse columns of the same products, any number of them.

The systems themselves are tables of tiles (``tiles``): a draw's inverse is one
factorisation in joins over its tiles, and its targets are solved tile by tile,
so neither a draw nor a matrix is ever the work of one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.functions import clean_text, is_control
from treatlens.operators import tiles as T
from treatlens.operators.gram import first_feature, moment_blocks, saved_blocks, weighted_key_products
from treatlens.operators.layout import to_sparse
from treatlens.operators.qc import feature_variance, sparse_proxies
from treatlens.session import cut_lineage


@dataclass(frozen=True)
class GraphSettings:
    """Parameters of the two-stage fit."""

    max_features: int | None = None
    stage1_alpha: float = 1e-3
    stage2_alpha: float = 1e-3
    draws: int = 24
    seed: int = 42
    level: float = 0.95
    naive: bool = True

    def __post_init__(self) -> None:
        if self.max_features is not None and self.max_features <= 1:
            raise ValueError("max_features must be greater than 1")
        if self.stage1_alpha < 0 or self.stage2_alpha < 0:
            raise ValueError("ridge penalties must not be negative")
        if self.draws < 0 or self.seed < 0:
            raise ValueError("draws and seed must not be negative")
        if not 0 < self.level < 1:
            raise ValueError("level must lie between 0 and 1")


def select_graph_features(
    genes: DataFrame, expr: DataFrame, n_cells: int, k: int | None = None, value: str = "z"
) -> DataFrame:
    """(gene_id, idx): flagged genes in id order when there are any, else genes by falling variance.

    Without ``k`` every such gene takes part. The numbering window holds one row
    per feature.
    """
    order = [F.asc("gene_id")]
    chosen: DataFrame | None = None
    if "highly_variable" in genes.columns:
        flagged = genes.where(F.col("highly_variable")).select("gene_id")
        if not flagged.isEmpty():
            chosen = flagged
    if chosen is None:
        order = [F.desc("variance"), F.asc("gene_id")]
        chosen = feature_variance(expr, n_cells, value)
    if k is not None:
        chosen = chosen.orderBy(*order).limit(k)
    chosen = chosen.select("gene_id", F.row_number().over(Window.orderBy(*order)).alias("r"))
    out = cut_lineage(chosen.select("gene_id", (F.col("r") - 1).cast("int").alias("idx")), "graph-features")
    if out.count() < 2:
        raise ValueError("the graph needs at least 2 features")
    return out


def instruments(cells: DataFrame) -> tuple[DataFrame, str]:
    """Cells with ``key`` (treatment, blank as ``unassigned``) and the reference treatment.

    The reference is the smallest control id, or the smallest id without controls.
    """
    text = clean_text(F.col("perturbation_id"))
    key = F.when(F.coalesce(text, F.lit("")) == "", "unassigned").otherwise(text)
    condition = F.col("condition") if "condition" in cells.columns else None
    tagged = cells.withColumn("key", key)
    facts = tagged.agg(
        F.min("key").alias("lo"),
        F.max("key").alias("hi"),
        F.min(F.when(is_control(F.col("key"), condition), F.col("key"))).alias("ctl"),
    ).first()
    if facts["lo"] is None or facts["lo"] == facts["hi"]:
        raise ValueError("instruments need at least two treatments")
    return tagged, facts["ctl"] if facts["ctl"] is not None else facts["lo"]


def proxies(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with ``widx`` and ``wval`` (z library, z knockdown, batch and protocol indicators), and the columns' names."""
    missing = [c for c in S.PROXY_SOURCE_COLUMNS if c not in cells.columns]
    if missing:
        raise ValueError(f"the two-stage fit needs the proxy columns {', '.join(missing)}")
    return sparse_proxies(cells, tiny=1e-12, blank_as="unknown")


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ..., 19."""
    return np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(20)]).tolist()


def draw_weights(cell: Column, draws: int, seed: int) -> Column:
    """Resampling weights of a cell, Poisson(1), one per draw.

    A weight depends on the cell's id, the draw and the seed only (52 bits of an
    MD5), so a lost and recomputed task repeats it, and any engine can.
    """
    steps = F.array(*[F.lit(x) for x in poisson_steps()])

    def uniform(d: Column) -> Column:
        text = F.concat_ws(":", cell.cast("string"), d.cast("string"), F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))

    # Two steps: inside the filter the digest would be made anew for every step of the function.
    numbers = F.transform(F.sequence(F.lit(1), F.lit(draws)), uniform)
    return F.transform(numbers, lambda u: F.size(F.filter(steps, lambda s: s <= u)).cast("double"))


_FIT_SCHEMA = "draw int, kind string, source int, target int, weight double"


@dataclass
class GraphInputs:
    """What both the point fit and the bootstrap read."""

    features: DataFrame
    rows: DataFrame
    n_w: int
    n_y: int
    reference: str
    proxy_names: DataFrame


def graph_inputs(
    cells: DataFrame, expr: DataFrame, features: DataFrame, value: str = "z", cfg: GraphSettings | None = None
) -> GraphInputs:
    """One row per cell: proxies, selected features, treatment and, with draws, its weight in each."""
    cfg = cfg or GraphSettings()
    with_proxies, names = proxies(cells)
    keyed, reference = instruments(with_proxies)
    weights = draw_weights(F.col("cell_id"), cfg.draws, cfg.seed) if cfg.draws else F.array().cast("array<double>")
    slim = keyed.select("cell_id", "widx", "wval", "key")
    # Made after the join, so that the weights are not shuffled.
    rows = to_sparse(expr, features, value, slim).withColumn("weights", weights)
    return GraphInputs(features, rows, names.count(), features.count(), reference, names)


def _penalty(n_v: int, y_at: int, n_y: int, alpha: float, keep_v: int) -> np.ndarray:
    """Numbers for the diagonal: 0 for the intercept, ``alpha`` for columns in use, 1 for those left empty."""
    out = np.ones(-(-(y_at + n_y) // T.TILE) * T.TILE)
    out[0] = 0.0
    out[1 : min(n_v, keep_v)] = alpha
    out[y_at : y_at + n_y] = alpha
    return out


def _solved(lhs: DataFrame, response: DataFrame, first_y: int, blocks: int, y_at: int, n_y: int, kind: str) -> DataFrame:
    """Weights of one regression per target, each without its own source.

    ``lhs`` is D'D with its penalty, ``response`` is D'Y. One inverse serves all
    targets: leaving out entry k of a system with inverse P and full solution u
    changes the solution by ``-P[:, k] u[k] / P[k, k]``.
    """
    right = response.select("draw", "ib", (F.col("jb") - first_y + blocks).alias("jb"), "t")
    own = T.swept(lhs.unionByName(right), blocks).where(F.col("ib") >= first_y)
    solution = own.where(F.col("jb") >= blocks).select("draw", "ib", (F.col("jb") - blocks + first_y).alias("jb"), "t")
    full = T.entries(solution, "u")
    p = T.entries(own.where((F.col("jb") >= first_y) & (F.col("jb") < blocks)), "held")
    both = full.join(p, ["draw", "i", "j"]).select("draw", (F.col("i") - y_at).alias("source"), (F.col("j") - y_at).alias("target"), "u", "held")
    both = cut_lineage(both.where(f"source < {n_y} AND target < {n_y}"), "solved")
    diagonal = both.where("source = target").select("draw", "target", (F.col("u") / F.col("held")).alias("share"))
    return both.where("source <> target").join(diagonal, ["draw", "target"]).select(
        "draw", F.lit(kind).alias("kind"), "source", "target", (F.col("u") - F.col("held") * F.col("share")).alias("weight")
    )


def _explained(g: DataFrame, fitted_y: DataFrame, fitted2: DataFrame, first_y: int, y_at: int, n_y: int) -> DataFrame:
    """Share of each feature's variance that stage 1 explains, from the diagonals of draw 0."""

    def at(tiles: DataFrame, name: str) -> DataFrame:
        return T.entries(tiles.where("draw = 0 AND ib = jb"), name).where("i = j").select(F.col("i").alias("column"), name)

    first = T.entries(g.where(f"draw = 0 AND ib = 0 AND jb >= {first_y}"), "total").where("i = 0")
    n = g.where("draw = 0 AND ib = 0 AND jb = 0").select(F.col("t")[0].alias("n")).scalar()
    rows = at(g, "yy").join(at(fitted_y, "fy"), "column").join(at(fitted2, "ff"), "column").join(first.select(F.col("j").alias("column"), "total"), "column")
    left, spread = F.col("yy") - 2 * F.col("fy") + F.col("ff"), F.col("yy") - F.col("total") * F.col("total") / n
    source = (F.col("column") - y_at).alias("source")
    r2 = 1 - left / F.when(spread <= 1e-12, 1.0).otherwise(spread)
    return rows.where(f"column >= {y_at} AND column < {y_at + n_y}").select(
        F.lit(0).alias("draw"), F.lit("r2").alias("kind"), source, F.lit(-1).alias("target"), r2.alias("weight")
    )


def fit_draws(inputs: GraphInputs, cfg: GraphSettings) -> DataFrame:
    """(draw, kind, source, target, weight) for draw 0 and all bootstrap draws.

    Kinds: ``iv`` edges of every draw; of draw 0 also ``naive`` edges (if asked
    for) and ``r2`` per source. X = [V, Y] with V = [1, proxies]; G is X'X, H and
    H2 are the treatment-weighted products. Features begin at a tile of their own.
    """
    n_v, y_at, n_y = 1 + inputs.n_w, first_feature(inputs.n_w, True), inputs.n_y
    first_y, blocks = y_at // T.TILE, -(-(y_at + n_y) // T.TILE)
    moments = saved_blocks(moment_blocks(inputs.rows, inputs.n_w, n_y, cfg.draws, by_key=True, aligned=True))
    weighted = weighted_key_products(moments, y_at + n_y, cfg.stage1_alpha, inputs.reference)

    def matrix(rows: DataFrame, kind: str) -> DataFrame:
        return T.from_block_rows(rows.where(F.col("kind") == kind))

    def part(m: DataFrame, rows: str, columns: str) -> DataFrame:
        test = {"v": f"< {first_y}", "y": f">= {first_y}"}
        return m.where(f"ib {test[rows]} AND jb {test[columns]}")

    weighted = cut_lineage(weighted, "weighted")
    g, h, h2 = matrix(moments, "G"), matrix(weighted, "H"), matrix(weighted, "H2")
    e_v = cut_lineage(T.combined((1, g.where(f"ib < {first_y}")), (-1, h.where(f"ib < {first_y}"))), "within")
    pen1 = _penalty(n_v, y_at, n_y, cfg.stage1_alpha, n_v)
    a = T.with_diagonal(part(e_v, "v", "v"), pen1)
    b = T.swept(a.unionByName(part(e_v, "v", "y")), first_y).where(f"jb >= {first_y}")
    # Products of the fitted values with everything, and with themselves.
    fitted_x = cut_lineage(T.combined((1, h.where(f"ib >= {first_y}")), (1, T.product(b, e_v, turned=True))), "fitted")
    middle = T.combined((1, part(h2, "v", "v")), (1, part(g, "v", "v")), (-2, part(h, "v", "v")))
    across = cut_lineage(
        T.product(b, T.combined((1, part(h, "v", "y")), (-1, part(h2, "v", "y"))), turned=True), "across"
    )
    fitted2 = cut_lineage(
        T.combined((1, part(h2, "y", "y")), (1, across), (1, T.transposed(across)), (1, T.product(b, T.product(middle, b), turned=True))),
        "fitted2",
    )
    crossed, fitted_y = part(fitted_x, "y", "v"), part(fitted_x, "y", "y")
    lhs = part(g, "v", "v").unionByName(crossed).unionByName(T.transposed(crossed)).unionByName(fitted2)
    pen2 = _penalty(n_v, y_at, n_y, cfg.stage2_alpha, n_v)
    response = part(g, "v", "y").unionByName(fitted_y)
    fits = _solved(T.with_diagonal(lhs, pen2), response, first_y, blocks, y_at, n_y, "iv")
    fits = fits.unionByName(_explained(g, fitted_y, fitted2, first_y, y_at, n_y))
    if cfg.naive:
        plain = _only_intercept(g.where("draw = 0"), first_y)
        pen = _penalty(n_v, y_at, n_y, cfg.stage2_alpha, 1)
        right = plain.where(f"jb >= {first_y}")
        fits = fits.unionByName(_solved(T.with_diagonal(plain, pen), right, first_y, blocks, y_at, n_y, "naive"))
    return fits


def _only_intercept(g: DataFrame, first_y: int) -> DataFrame:
    """Products without the proxies: of the leading tiles only row and column 0 of the matrix stay."""
    size = T.TILE
    kept = (
        f"transform(t, (x, p) -> CASE WHEN (ib >= {first_y} OR (ib = 0 AND p < {size})) "
        f"AND (jb >= {first_y} OR (jb = 0 AND p % {size} = 0)) THEN x ELSE 0D END)"
    )
    return g.select("draw", "ib", "jb", F.expr(kept).alias("t"))


def edge_intervals(
    draws: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ("source", "target")
) -> DataFrame:
    """Sample deviation (0 for one draw) and central quantile interval per edge."""
    alpha = 1.0 - level
    bounds = F.percentile("weight", F.array(F.lit(alpha / 2.0), F.lit(1.0 - alpha / 2.0)))
    return (
        draws.groupBy(*keys)
        .agg(F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("standard_error"), bounds.alias("_q"))
        .select(*keys, "standard_error", F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))
    )


def edge_table(fits: DataFrame, features: DataFrame, cfg: GraphSettings) -> DataFrame:
    """All ordered pairs of features with weight, deviation and interval.

    The fit of draw 0 lists every ordered pair already, so none has to be made up.
    """
    point = fits.where((F.col("draw") == 0) & (F.col("kind") == "iv")).select("source", "target", "weight")
    if cfg.draws > 0:
        spread = edge_intervals(fits.where((F.col("draw") > 0) & (F.col("kind") == "iv")), cfg.level)
        joined = point.join(spread, ["source", "target"], "left")
    else:
        zero = F.lit(0.0)
        joined = point.select("*", zero.alias("standard_error"), zero.alias("ci_lower"), zero.alias("ci_upper"))
    return (
        joined.join(features.select(F.col("idx").alias("source"), F.col("gene_id").alias("source_gene_id")), "source")
        .join(features.select(F.col("idx").alias("target"), F.col("gene_id").alias("target_gene_id")), "target")
        .select("source_gene_id", "target_gene_id", "weight", "standard_error", "ci_lower", "ci_upper")
    )


def naive_edges(fits: DataFrame, features: DataFrame) -> DataFrame:
    """(source_gene_id, target_gene_id, weight) of the regression without instruments and proxies."""
    return (
        fits.where((F.col("draw") == 0) & (F.col("kind") == "naive"))
        .join(features.select(F.col("idx").alias("source"), F.col("gene_id").alias("source_gene_id")), "source")
        .join(features.select(F.col("idx").alias("target"), F.col("gene_id").alias("target_gene_id")), "target")
        .select("source_gene_id", "target_gene_id", "weight")
    )


def fit_diagnostics(fits: DataFrame) -> DataFrame:
    """One row: mean stage-1 R2, mean absolute weight of both graphs and their difference."""
    at0 = fits.where(F.col("draw") == 0)
    mean = lambda kind, x: F.avg(F.when(F.col("kind") == kind, x))
    row = at0.agg(
        mean("r2", F.col("weight")).alias("stage1_r2_mean"),
        mean("iv", F.abs("weight")).alias("iv_offdiag_l1_mean"),
        mean("naive", F.abs("weight")).alias("naive_offdiag_l1_mean"),
    )
    return row.withColumn(
        "iv_minus_naive_offdiag_l1_mean", F.col("iv_offdiag_l1_mean") - F.col("naive_offdiag_l1_mean")
    )


@dataclass
class GraphFit:
    """Results of :func:`iv_graph`."""

    edges: DataFrame
    naive: DataFrame
    diagnostics: DataFrame
    features: DataFrame
    proxy_names: DataFrame
    reference: str


def iv_graph(
    cells: DataFrame,
    expr: DataFrame,
    genes: DataFrame,
    cfg: GraphSettings | None = None,
    value: str = "z",
) -> GraphFit:
    """Feature choice, one pass of products, both stages, intervals, diagnostics."""
    cfg = cfg or GraphSettings()
    features = select_graph_features(genes, expr, cells.count(), cfg.max_features, value)
    inputs = graph_inputs(cells, expr, features, value, cfg)
    fits = cut_lineage(fit_draws(inputs, cfg), "fits")
    return GraphFit(
        edge_table(fits, features, cfg),
        naive_edges(fits, features),
        fit_diagnostics(fits),
        features,
        inputs.proxy_names,
        inputs.reference,
    )
