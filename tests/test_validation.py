import pandas as pd
import pytest
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import validation as C


def tables(spark, **changes):
    cells = spark.createDataFrame(
        [("a", "k", "b", "control", "p", 3.0, "ntc", 0.0), ("b", "k", "b", "perturbed", "p", 2.0, "x1", 0.7),
         ("c", "k", "b", "perturbed", "p", 4.0, "x1", 0.8)], S.CELLS)
    genes = spark.createDataFrame([(g, g.upper(), "chr1", "+", 10) for g in "xyz"], S.GENES)
    expr = spark.createDataFrame(
        [("a", "x", 2, 1.0), ("a", "z", 1, 0.5), ("b", "x", 1, 1.0), ("b", "y", 1, 1.0), ("c", "y", 3, 1.0), ("c", "z", 1, 1.0)],
        S.EXPR)
    perts = spark.createDataFrame(
        [("ntc", "NTC", "unknown", -1, -1, ".", "control", None, "ntc"), ("x1", "X", "chr1", 5, 9, "+", "crispri", 1.0, "g1")],
        S.PERTURBATIONS)
    vec = cells.select("cell_id", F.array(F.lit(1.0).cast("float")).alias("sequence_embedding"),
                       F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("cell_state_embedding"))
    out = dict(cells=cells, genes=genes, expr=expr, perturbations=perts, vectors=vec, version=S.TABLE_SCHEMA_VERSION)
    out.update(changes)
    return out


def failed(spark, mode="strict", **changes):
    _, report = C.validate(tables(spark, **changes), mode)
    return {(r["check"], r["field"]): r["n_bad"] for r in C.violations(report).collect()}


def test_valid_tables_pass(spark):
    assert failed(spark) == {}
    _, report = C.validate(tables(spark))
    C.require_valid(report)


def test_each_violation_is_named(spark):
    t = tables(spark)
    bad_cells = t["cells"].withColumn("batch", F.lit(" ")).withColumn("library_size", F.lit(-1.0))
    bad_expr = t["expr"].withColumn("count", F.col("count") + F.lit(0.5)).withColumn("z", -F.col("z"))
    bad_perts = t["perturbations"].where("perturbation_id = 'x1'").withColumn("start", F.lit(20)).withColumn("dose", F.lit("much"))
    got = failed(spark, cells=bad_cells, expr=bad_expr, perturbations=bad_perts, vectors=None, version="other")
    assert got == {
        ("cells", "batch.text"): 3,
        ("cells", "library_size.non_negative"): 3,
        ("counts", "integer_like"): 6,
        ("layer", "z.non_negative"): 6,
        ("embeddings", "sequence_embedding"): 3,
        ("embeddings", "cell_state_embedding"): 3,
        ("perturbations", "described"): 1,
        ("perturbations", "interval"): 1,
        ("perturbations", "dose.numeric"): 1,
        ("version", "schema_version"): 1,
    }


def test_repair_makes_strict_pass(spark):
    t = tables(spark)
    poor = tables(
        spark,
        cells=t["cells"].select("cell_id", "perturbation_id", F.lit("many").alias("library_size")),
        genes=t["genes"].select("gene_id", F.lit("far").alias("tss")),
        expr=t["expr"].drop("z"),
        perturbations=t["perturbations"].where("perturbation_id = 'x1'").drop("dose", "modality"),
        vectors=None,
        version=None,
    )
    repaired, report = C.validate(poor, "repair")
    assert C.violations(report).count() == 0
    _, again = C.validate(repaired, "strict")
    C.require_valid(again)
    lib = {r["cell_id"]: r["library_size"] for r in repaired["cells"].collect()}
    assert lib == {"a": 3.0, "b": 2.0, "c": 4.0}
    assert {r["tss"] for r in repaired["genes"].collect()} == {-1}


def test_error_lists_every_check(spark):
    _, report = C.validate(tables(spark, version=None))
    with pytest.raises(C.ContractError, match="schema_version"):
        C.require_valid(report)
    with pytest.raises(ValueError):
        C.validate(tables(spark), "loose")


def test_knockdown_only_fails_when_all_missing(spark):
    t = tables(spark)
    none = t["cells"].withColumn("knockdown_efficiency_proxy", F.lit(None).cast("double"))
    assert ("cells", "knockdown_efficiency_proxy.numeric") in failed(spark, cells=none)
    some = t["cells"].withColumn("knockdown_efficiency_proxy", F.expr("if(cell_id = 'a', 0.1, null)"))
    assert failed(spark, cells=some) == {}


def test_last_record_wins(spark):
    rows = spark.createDataFrame(pd.DataFrame({"perturbation_id": ["p ", " p", "q"], "chrom": ["1", "2", "3"], "n": [1, 2, 1]}))
    assert {r[0]: r["chrom"] for r in C.last_record(rows, "n").collect()} == {"p": "2", "q": "3"}


def test_embedding_shape(spark):
    t = tables(spark)
    vec = t["vectors"].where("cell_id <> 'a'")
    got = {r["field"]: r["n_bad"] for r in C.check_embeddings(vec, t["cells"], "cell_state_embedding", 3).collect()}
    assert got == {"cell_state_embedding.rows": 1, "cell_state_embedding.extra": 0, "cell_state_embedding.dim": 2}


def test_ids_of_cells_are_not_broadcast(spark, capsys, tmp_path):
    """Equal vectors and bare ids make small files, whose tables may hold all cells."""
    made = {}
    for name in ("vectors", "cells"):
        tables(spark)[name].write.parquet(str(tmp_path / name))
        made[name] = spark.read.parquet(str(tmp_path / name))
    C.check_embeddings(made["vectors"], made["cells"], "sequence_embedding").explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
