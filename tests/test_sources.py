import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import validation as C
from treatlens.plans.evaluate import EvaluationSettings, check_shapes, evaluate, evaluate_masks, from_pairs
from treatlens.plans.stage_chain import ChainSettings, read_manifest, run_stages
from treatlens.session import scratch_path
from treatlens.sources import stages as IO
from treatlens.sources.numbering import row_numbers
from treatlens.sources.wide_table import fill_ids, load_entity_table


def wide(tmp_path, n, genes=6, name="w.csv", **extra):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({f"gene_{j:03d}": rng.poisson(2, n) for j in range(genes)})
    for k, v in extra.items():
        pdf[k] = v
    pdf.to_csv(tmp_path / name, index=False)
    return pdf, str(tmp_path / name)


def test_minimal_table(spark, tmp_path):
    pert = ["ntc" if i % 8 == 0 else "tp53_guidex" for i in range(320)]
    pdf, path = wide(tmp_path, 320, perturbation_id=pert, cell_id=[f"c{i}" for i in range(320)])
    t = load_entity_table(spark, path, "adamson")
    _, report = C.validate(t)
    C.require_valid(report)
    rows = t["cells"].toPandas().set_index("cell_id")
    assert len(rows) == 320 and set(rows["cell_type"]) == {"K562"} and set(rows["batch"]) == {"adamson_batch_0"}
    assert (rows["condition"] == "control").sum() == 40
    want = pdf.filter(like="gene_").sum(axis=1)
    assert rows.loc[pdf["cell_id"], "library_size"].tolist() == want.astype(float).tolist()
    perts = {r["perturbation_id"]: r for r in t["perturbations"].collect()}
    assert perts["ntc"]["target_gene"] == "NTC" and perts["tp53_guidex"]["target_gene"] == "TP53"
    assert {r["gene_symbol"] for r in t["genes"].collect()} == {f"GENE_{j:03d}" for j in range(6)}


def test_cap_and_missing_ids(spark, tmp_path):
    _, path = wide(tmp_path, 6200)
    every = load_entity_table(spark, path, "replogle_sample")
    assert every["cells"].count() == 6200
    spec = {"cell_type": "K562", "protocol": "p", "batch_prefix": "b", "hard_cap": 500, "seed": 42}
    with pytest.warns(UserWarning, match="exceeds the cap"):
        t = load_entity_table(spark, path, "replogle_sample", spec=spec, max_entities=9000)
    assert t["cells"].count() == 500 and t["cells"].select("cell_id").distinct().count() == 500
    assert {r[0] for r in t["cells"].select("perturbation_id").distinct().collect()} == {"unassigned"}


def test_bad_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("cell_id,batch\na,b\n")
    with pytest.raises(ValueError, match="gene"):
        load_entity_table(spark, str(tmp_path / "n.csv"), "adamson")
    (tmp_path / "e.csv").write_text("cell_id,g1\n")
    with pytest.raises(ValueError, match="empty"):
        load_entity_table(spark, str(tmp_path / "e.csv"), "adamson")


def test_row_numbers_follow_the_scan(spark):
    df = spark.range(0, 1000, 1, 7)
    got = row_numbers(df, "n").toPandas()
    assert (got["id"] == got["n"]).all()
    path = scratch_path(spark, "numbers")
    for k, n in enumerate((5, 4000, 1, 900)):  # the scan would read the largest file first
        spark.range(k * 10_000, k * 10_000 + n).repartition(1).sortWithinPartitions("id").write.mode("append").parquet(f"{path}/k={k}")
    rows = row_numbers(spark.read.parquet(path).select("id"), "n").orderBy("id").toPandas()
    assert rows["n"].tolist() == list(range(4906))
    named = row_numbers(spark.read.parquet(path).select(F.col("id").alias("_metadata")), "n").orderBy("_metadata").toPandas()
    assert named["n"].tolist() == list(range(4906))
    ids = [r["cell_id"] for r in fill_ids(spark.range(3).select(F.lit(1).alias("x")), "d").collect()]
    assert sorted(ids) == ["d_cell_000000", "d_cell_000001", "d_cell_000002"]


def test_cache(spark, tmp_path):
    _, path = wide(tmp_path, 20)
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.read.csv(path, header=True)}

    cache = str(tmp_path / "cache")
    assert IO.reuse_or_build(spark, cache, path, 10, build)[1] is False
    tables, hit = IO.reuse_or_build(spark, cache, path, 10, build)
    assert hit and tables["t"].count() == 20 and len(calls) == 1
    assert not IO.reuse_or_build(spark, cache, path, 11, build)[1]
    assert not IO.reuse_or_build(spark, cache, path, 10, build, version="next")[1]
    wide(tmp_path, 21)
    assert not IO.reuse_or_build(spark, cache, path, 10, build)[1]
    import hashlib

    assert IO.source_fingerprint(spark, path) == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert IO.cache_key("ab" * 32, None) == "ab" * 8 + "_capall"


def test_written_forms(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.5, 0.1, 0.3, 0.7)], S.EDGES)
    IO.write_edges(edges, str(tmp_path / "e"), spark.createDataFrame([(3,)], "n int"))
    assert IO.read_edges(spark, str(tmp_path / "e")).collect() == edges.collect()
    assert spark.read.json(str(tmp_path / "e" / "metadata")).first()["schema_version"] == "causal_graph_v1"
    rows = spark.createDataFrame([("c1", "locus", "train", "g"), ("c2", "protocol", "test", "h")], S.ASSIGNMENT)
    IO.write_split(rows, rows.limit(1), str(tmp_path / "s"))
    back = IO.read_split(spark, str(tmp_path / "s")).select(*S.ASSIGNMENT.fieldNames())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    bad = rows.withColumn("shift_type", F.lit("weather"))
    IO.write_split(bad, rows.limit(1), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        IO.read_split(spark, str(tmp_path / "b"))
    IO.write_windows(rows, rows.limit(1), str(tmp_path / "w"))
    assert IO.read_stage(spark, str(tmp_path / "w" / "windows")).count() == 2


def test_report(spark, tmp_path):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(50, 5))
    genes = [f"g{j}" for j in range(5)]
    pairs = spark.createDataFrame(
        pd.DataFrame({"gene_id": genes * 50, "y": y.ravel(), "p": (y + rng.normal(0, 0.03, y.shape)).ravel(), "var": 0.04})
    )
    check_shapes(pairs, 50, 5)
    with pytest.raises(ValueError):
        check_shapes(pairs, 51, 5)
    control = spark.createDataFrame([(g, 0.0) for g in genes], "gene_id string, control_mean double")
    suite = spark.createDataFrame([("control_mean", "expression", "mae", 0.8), ("control_mean", "expression", "pearson_mean_gene", 0.0)], S.SUITE)
    done = evaluate(*from_pairs(pairs), control, suite)
    row = done.report.first()
    assert row["metrics"]["mae"] < 0.05 and row["metrics"]["pearson_top_1000_degs"] > 0.99
    assert [f["code"] for f in row["failure_modes"]] == ["no_failure_modes_detected"]
    assert row["baseline_comparison"][0]["model_beats_baseline_mae"] and row["metadata"]["n_eval_cells"] == 50
    IO.write_report(done.report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["schema_version"] == "model_card_v1"
    for broken, text in (
        (done.report.drop("failure_modes"), "missing section failure_modes"),
        (done.report.withColumn("schema_version", F.lit("x")), "schema version"),
        (done.report.withColumn("metrics", F.struct(F.lit(1.0).alias("mae"))), "calibration_error"),
        (done.report.withColumn("baseline_comparison", F.slice("baseline_comparison", 1, 0)), "is empty"),
    ):
        with pytest.raises(ValueError, match=text):
            IO.write_report(broken, str(tmp_path / "x"))


def test_chain_stops_resumes_and_completes(spark, tmp_path, toy):
    tables = {"cells": toy["cells"], "genes": toy["genes"], "expr": toy["expr"].drop("z"), "perturbations": None, "vectors": None, "version": None}
    cfg = ChainSettings(embedding_dim=4, use_cell_state=False)
    root = str(tmp_path / "run")
    first = run_stages(spark, tables, root, "r1", cfg, stop_after="embed")
    assert [r["stage"] for r in first.collect()] == ["ingest", "preprocess", "embed"]
    with pytest.raises(ValueError, match="another id"):
        run_stages(spark, tables, root, "r2", cfg, resume=True)
    with pytest.raises(ValueError, match="nothing to resume"):
        run_stages(spark, tables, str(tmp_path / "none"), "r1", cfg, resume=True)
    rest = {r["stage"]: r["skipped"] for r in run_stages(spark, tables, root, "r1", cfg, resume=True).collect()}
    assert [s for s, skipped in rest.items() if skipped] == ["ingest", "preprocess", "embed"] and len(rest) == 7
    assert read_manifest(spark, root).count() == 7
    card = spark.read.json(f"{root}/card").first()
    assert card["metadata"]["n_genes"] == 11 and len(card["baseline_comparison"]) == 3
    suite = IO.read_stage(spark, f"{root}/baseline_suite")
    gap = suite.where("metric in ('in_degree_l1_diff', 'out_degree_l1_diff')").agg(F.sum("value")).first()[0]
    assert gap == 0.0 and set(S.BASELINE_NAMES) == {r[0] for r in suite.select("baseline").distinct().collect()}


def test_large_files_are_identified_by_content(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    monkeypatch.setattr(IO, "HASHED_WHOLE", 8)
    path, copy = tmp_path / "a b.bin", tmp_path / "copy.bin"
    path.write_bytes(b"one content")
    copy.write_bytes(b"one content")
    os.utime(path, (1_000_000, 1_000_000))
    first = IO.source_fingerprint(spark, str(path))
    assert first == IO.source_fingerprint(spark, str(copy)) == hashlib.sha256(b"one content").hexdigest()
    path.write_bytes(b"two content")
    os.utime(path, (1_000_000, 1_000_000))
    assert IO.source_fingerprint(spark, str(path)) == hashlib.sha256(b"two content").hexdigest()


def test_masks_are_scored_in_one_pass_and_checked(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    rows = [(f"c{i:02d}", f"g{j}", float(y[i, j]), float(p[i, j])) for i in range(30) for j in range(4)]
    pairs = spark.createDataFrame(rows, "cell_id string, gene_id string, y double, p double")
    part = lambda kind, i: ("train", "val", "test")[i % 3] if kind == "a" else ("train" if i < 25 else "test")
    masks = spark.createDataFrame([(f"c{i:02d}", k, part(k, i)) for k in "ab" for i in range(30)], "cell_id string, shift_type string, part string")
    control = spark.createDataFrame([(f"g{j}", 0.0) for j in range(4)], "gene_id string, control_mean double")
    got = {(r.shift_type, r.part): r for r in evaluate_masks(pairs, masks, control, EvaluationSettings(top_k=2)).collect()}
    assert len(got) == 5
    for (kind, name), r in got.items():
        own = [i for i in range(30) if part(kind, i) == name]
        a, b = y[own], p[own]
        corr = np.array([np.corrcoef(a[:, j], b[:, j])[0, 1] for j in range(4)])
        top = np.argsort(-np.abs(a.mean(0)), kind="stable")[:2]
        assert np.allclose([r.mae, r.rmse, r.pearson_mean_gene, r.pearson_top_1000_degs], [
            np.abs(a - b).mean(), np.sqrt(((a - b) ** 2).mean()), corr.mean(), corr[top].mean()])
        assert (r.n_genes, r.n_eval_cells) == (4, len(own))
    with pytest.raises(Exception, match="expected one prediction"):
        evaluate_masks(pairs.where("NOT (cell_id = 'c07' AND gene_id = 'g1')"), masks, control).collect()
