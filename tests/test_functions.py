import hashlib

import numpy as np
from pyspark.sql import functions as F

from treatlens import functions as X


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("o")).first()["o"]


def test_counts_from_text(spark):
    cases = {"3": 3, " 4 ": 4, "2.5": 2, "3.5": 4, "-7": 0, "abc": 0, "NaN": 0, "": 0, None: 0, "1e3": 1000, "1d": 0}
    for raw, want in cases.items():
        assert one(spark, X.coerce_counts, raw) == want, raw


def test_lenient_numbers(spark):
    assert one(spark, X.as_int, "12.9") == 12
    assert one(spark, X.as_int, "-12.9") == -12
    assert one(spark, X.as_int, "x") is None
    assert one(spark, X.as_double, "nan") is None
    assert one(spark, X.as_double, "7f") is None


def test_control_rule(spark):
    rows = spark.createDataFrame(
        [("NTC", "x"), ("p000", "x"), ("tp53", "Control"), ("ctrl_1", "x"), ("a", None)], "p string, c string"
    )
    got = [r[0] for r in rows.select(X.is_control(F.col("p"), F.col("c"))).collect()]
    assert got == [True, True, True, False, False]


def test_text_and_keys(spark):
    assert one(spark, X.clean_text, "\t a b \n") == "a b"
    assert one(spark, X.contig_name, " Chr22 ") == "22"
    assert one(spark, X.contig_name, "chrx") == "X"
    assert one(spark, X.reverse_complement, "ACGTNacgtnRY") == "YRnacgtNACGT"
    placeholder = one(spark, X.placeholder_sequence, "tp53")
    digest = hashlib.sha256(b"tp53").hexdigest()
    assert placeholder == "".join("ACGT"[int(c, 16) % 4] for c in digest)
    key = spark.range(1).select(
        X.locus_key(F.lit("chr7"), F.lit(5), F.lit(9), F.lit("-"), 1000).alias("k")
    ).first()["k"]
    assert key == hashlib.sha256(b"7:5:9:-:1000").hexdigest()[:20]


def test_row_standardise(spark):
    v = [1.0, 4.0, 2.0, 8.0]
    got = one(spark, X.row_standardise, v, "array<float>")
    assert np.allclose(got, (np.array(v) - np.mean(v)) / np.std(v))
    assert one(spark, X.row_standardise, [3.0, 3.0], "array<float>") == [0.0, 0.0]


def test_zscore_flat_and_spread(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "a double")
    got = sorted(r["z"] for r in X.zscore(df, "a", "z").collect())
    want = (np.array([1, 2, 6.0]) - 3) / np.std([1, 2, 6.0])
    assert np.allclose(got, want)
    flat = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert [r["z"] for r in X.zscore(flat, "a", "z").collect()] == [0.0, 0.0]


def test_hash_normal_moments(spark):
    df = spark.range(20000).select(X.gaussian_from_hash(7, F.col("id")).alias("g"))
    row = df.agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).first()
    assert abs(row["m"]) < 0.03 and abs(row["s"] - 1) < 0.03
