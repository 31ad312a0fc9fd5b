import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treatlens.operators import splits as P


def groups_of(spark, sizes):
    rows = [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "cell_id string, group string")


def parts_of(spark, sizes, **cfg):
    c = P.SplitSettings(**cfg)
    groups = groups_of(spark, sizes)
    out = P.undersized_fallback(P.assign_groups(P.group_counts(groups), "cell_type", c), c)
    return {r["group"]: r.asDict() for r in out.collect()}


def test_three_or_more_groups(spark):
    got = parts_of(spark, {k: 40 for k in "abcdefgh"})
    counts = pd.Series([r["part"] for r in got.values()]).value_counts()
    assert counts.to_dict() == {"train": 6, "val": 1, "test": 1}
    assert not any(r["fallback"] for r in got.values())
    assert got == parts_of(spark, {k: 40 for k in "hgfedcba"})
    moved = parts_of(spark, {k: 40 for k in "abcdefgh"}, seed=5)
    assert {k: v["part"] for k, v in moved.items()} != {k: v["part"] for k, v in got.items()}


def test_fractions_shrink_until_training_is_left(spark):
    got = parts_of(spark, {k: 40 for k in "abc"}, val_fraction=0.45, test_fraction=0.5)
    assert sorted(r["part"] for r in got.values()) == ["test", "train", "val"]
    got = parts_of(spark, {k: 40 for k in "abcde"}, val_fraction=0.49, test_fraction=0.5)
    n_val, n_test, g = max(1, round(0.49 * 5)), max(1, round(0.5 * 5)), 5
    while n_val + n_test >= g:
        if n_val > 1:
            n_val -= 1
        elif n_test > 1:
            n_test -= 1
        else:
            break
    seen = pd.Series([r["part"] for r in got.values()]).value_counts()
    assert (seen["val"], seen["test"]) == (n_val, n_test)


def test_few_groups(spark):
    two = parts_of(spark, {"a": 40, "b": 50})
    assert sorted(r["part"] for r in two.values()) == ["test", "train"]
    assert {r["reason"] for r in two.values()} == {"insufficient_shift_groups_for_three_way_split"}
    one = parts_of(spark, {"a": 40})
    assert one["a"]["part"] == "train" and one["a"]["reason"] == "single_shift_group_only_train_split_possible"


def test_undersized_parts(spark):
    tiny = parts_of(spark, {"a": 3, "b": 2, "c": 4})
    assert {r["part"] for r in tiny.values()} == {"train"}
    assert {r["reason"] for r in tiny.values()} == {"dataset_too_small_for_holdout_all_assigned_to_train"}
    # The second largest group becomes the test part when the drawn one is too small.
    for seed in range(6):
        got = parts_of(spark, {"a": 500, "b": 200, "c": 5, "d": 6, "e": 7}, seed=seed)
        assert {r["reason"] for r in got.values()} == {"undersized_partition_fallback_applied"}
        assert "val" not in {r["part"] for r in got.values()}
        test = [g for g, r in got.items() if r["part"] == "test"]
        assert sum(got[g]["n_cells"] for g in test) >= 32


def test_rank_bins(spark):
    rng = np.random.default_rng(0)
    v = np.where(np.arange(103) % 3 == 0, 0.0, rng.random(103).round(1))
    pdf = pd.DataFrame({"cell_id": [f"c{i:03d}" for i in range(103)], "strength": v})
    got = P.rank_bins(spark.createDataFrame(pdf).repartition(5)).toPandas().sort_values("cell_id")["group"]
    order = np.argsort(v, kind="mergesort")
    want = np.empty(103, dtype=int)
    want[order] = (np.arange(103) * 4) // 103
    assert got.str[-1].astype(int).tolist() == want.tolist()
    flat = spark.createDataFrame(pdf.assign(strength=1.0))
    assert {r["group"] for r in P.rank_bins(flat).collect()} == {"strength_bin_0"}


def test_locus_and_dose(spark):
    perts = spark.createDataFrame(
        [("p1", "chrX", "10", "20", "-", "2"), ("p2", "unknown", "1", "2", "+", "x"), ("p3", "7", "0", "9", "+", None), ("p4", "chr7", "3.9", "9", " ", "-4")],
        "perturbation_id string, chrom string, start string, end string, strand string, dose string",
    )
    cells = spark.createDataFrame(
        [("a", "p1", 0.5), ("b", "p2", 1.0), ("c", "p3", 1.0), ("d", "p4", 1.0), ("e", "p9", 1.0), ("f", "p1", -1.0)],
        "cell_id string, perturbation_id string, knockdown_efficiency_proxy double",
    )
    got = {r["cell_id"]: r["group"] for r in P.group_by_locus(cells, perts).collect()}
    assert got == {"a": "chrX:10-20:-", "b": "perturbation:p2", "c": "perturbation:p3", "d": "chr7:3-9:.", "e": "perturbation:p9", "f": "chrX:10-20:-"}
    got = {r["cell_id"]: r["strength"] for r in P.dose_strength(cells, perts).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0, "f": 0.0}


def test_split_is_clean_and_damage_is_found(spark, toy):
    cells = toy["cells"]
    assignment, parts = P.split(cells, None, "cell_type", P.SplitSettings(min_cells=5))
    groups = P.group_by_column(cells, "cell_type")
    clean = P.leakage_report(assignment, cells, groups).first()
    assert clean["is_valid"] and not clean["leakage_detected"] and clean["n_missing"] == 0
    assert clean["cells_train"] + clean["cells_test"] == 90
    one = assignment.where("part = 'train'").limit(1).withColumn("part", F.lit("test"))
    bad = P.leakage_report(assignment.unionByName(one), cells, groups).first()
    assert bad["leakage_detected"] and bad["cell_overlap_train_test"] == 1 and bad["group_overlap_train_test"] == 1
    assert bad["errors"] == ["cells shared by train and test", "groups shared by train and test"]
    twice = assignment.unionByName(assignment.where("cell_id = 'c000'"))
    assert P.leakage_report(twice, cells, groups).first()["errors"][0].startswith("duplicate cells in")
    gone = P.leakage_report(assignment.where("cell_id <> 'c000'"), cells, groups).first()
    assert gone["errors"] == ["cells without a part"] and not gone["leakage_detected"]


def test_fingerprint_ignores_row_order(spark, toy):
    groups = P.group_by_column(toy["cells"], "protocol")
    a = P.fingerprint(toy["cells"], groups, 12).first()[0]
    b = P.fingerprint(toy["cells"].orderBy(F.desc("cell_id")).repartition(5), groups, 12).first()[0]
    c = P.fingerprint(toy["cells"].withColumn("protocol", F.lit("p9")), groups, 12).first()[0]
    assert a == b != c


def test_bad_requests(spark, toy):
    with pytest.raises(ValueError):
        P.group_by_column(toy["cells"], "nothing")
    with pytest.raises(ValueError):
        P.shift_groups(toy["cells"], None, "locus")
    with pytest.raises(ValueError):
        P.shift_groups(toy["cells"], None, "weather")
    with pytest.raises(ValueError):
        P.SplitSettings(val_fraction=0.6, test_fraction=0.5)
    with pytest.raises(ValueError):
        P.require_groups(P.group_by_column(toy["cells"].withColumn("protocol", F.lit(" ")), "protocol"))
