import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from treatlens.operators import ordering, ranking


def test_global_rank_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.where(np.arange(900) % 3 == 0, 0.5, rng.random(900).round(2))
    pdf = pd.DataFrame({"id": np.arange(900), "v": v})
    df = spark.createDataFrame(pdf).repartition(7)
    got = ordering.global_rank(df, [F.col("v"), F.col("id")]).toPandas().sort_values("id")["rank"].to_numpy()
    want = np.empty(900, dtype=int)
    want[np.lexsort((pdf["id"], pdf["v"]))] = np.arange(900)
    assert (got == want).all()


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 200, 1000).astype(float), "n": rng.integers(1, 5, 1000)})
    for down in (False, True):
        got = ordering.running_totals(spark.createDataFrame(pdf), "k", ["n"], down).toPandas()
        got = got.sort_values("k", ascending=not down)
        assert (got["cum_n"].to_numpy() == np.cumsum(got["n"].to_numpy())).all()
        assert got["n"].sum() == pdf["n"].sum()


def test_weighted_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    v, w = rng.random(300).round(2), rng.integers(0, 6, 300)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    assert np.allclose(ordering.weighted_quantiles(df, "v", "w", probs), np.quantile(np.repeat(v, w), probs))


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = ordering.hash_rank(df, "h", "id", "r").toPandas().sort_values("h")
    assert got["r"].tolist() == list(range(1, 501))


def brute_auc(score, label):
    pos, neg = score[label], score[~label]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_f1(score, label):
    best = 0.0
    for t in np.unique(score):
        hit = score >= t
        best = max(best, 2 * (hit & label).sum() / (hit.sum() + label.sum()))
    return best


def test_auroc_and_f1(spark):
    rng = np.random.default_rng(4)
    score, label = rng.random(150).round(1), rng.random(150) < 0.3
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    assert np.isclose(ranking.auroc(df).first()[0], brute_auc(score, label))
    assert np.isclose(ranking.best_f1(df).first()[0], brute_f1(score, label))
    none = df.withColumn("label", F.lit(False))
    assert ranking.auroc(none).first()[0] == 0.5
    assert ranking.best_f1(none).first()[0] == 0.0


def test_recovery_by_gene_id(spark):
    ids = [f"g{i}" for i in range(6)]
    strong = {("g0", "g1"): 0.95, ("g2", "g3"): 0.90, ("g4", "g5"): 0.92}
    pairs = [(a, b, strong.get((a, b), 0.01)) for a in ids for b in ids if a != b]
    edges = spark.createDataFrame(pairs, "source_gene_id string, target_gene_id string, weight double")
    truth = spark.createDataFrame(
        [(b, a, -1.0 if a == "g1" else 1.0) for b, a in strong], "source_gene_id string, target_gene_id string, weight double"
    )
    row = ranking.graph_recovery(edges, truth).first()
    assert row["auc"] == 1.0 and row["f1"] == 1.0
    assert ranking.truth_correlation(edges, truth).first()[0] > 0.99
    flat = edges.withColumn("weight", F.lit(1.0))
    assert ranking.truth_correlation(flat, truth).first()[0] == 0.0
