import gzip

import numpy as np
import pandas as pd
import pytest

from treatlens.operators import windows as W
from treatlens.sources import fasta
from treatlens.sources.fasta import read_fasta

SEQ = {"22": "ACGT" * 800, "1": "GATTACA" * 357 + "G"}
COLS = "perturbation_id string, chrom string, start string, end string, strand string"


def contigs(spark, chunk=256):
    rows = [(f"chr{k}", v.lower()) for k, v in SEQ.items()]
    return W.chunk_contigs(spark.createDataFrame(rows, "chrom string, seq string"), chunk)


def cut(spark, rows, size=1000, chunk=256):
    done = W.extract_windows(spark.createDataFrame(rows, COLS), contigs(spark, chunk), W.WindowSettings(size=size), chunk)
    return {r["perturbation_id"]: r for r in done.collect()}


def test_boundaries(spark):
    got = cut(spark, [("s", "chr22", "5", "5", "+"), ("e", "CHR22", "3195", "3195", "+"), ("m", "22", "1500", "1501", "+")])
    assert (got["s"]["window_start"], got["s"]["window_end"]) == (1, 1000)
    assert (got["e"]["window_start"], got["e"]["window_end"]) == (2201, 3200)
    assert got["m"]["center"] == 1500 and got["m"]["window_start"] == 1500 - 499
    assert got["m"]["sequence"] == SEQ["22"][1000:2000]


def test_minus_strand_is_the_other_strand(spark):
    got = cut(spark, [("p", "chr1", "800", "810", "+"), ("m", "chr1", "800", "810", "-")])
    flip = got["p"]["sequence"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got["m"]["sequence"] == flip


def test_reasons_and_summary(spark):
    rows = [
        ("a", "chr22", "-1", "-1", "+"), ("b", "chr99", "100", "120", "+"), ("c", "unknown", "1", "2", "+"), ("d", "", "1", "2", None),
        ("e", "chr22", "9", "5", "+"), ("f", "chr22", None, "5", "+"), ("g", "chr22", "0", "5", "+"), ("h", "chr22", "7", "9", "-"),
    ]
    got = cut(spark, rows)
    reasons = {k: r["reason"] for k, r in got.items()}
    assert reasons == {
        "a": "missing_or_invalid_coordinates", "b": "chromosome_not_found_in_reference", "c": "missing_or_unknown_chromosome",
        "d": "missing_or_unknown_chromosome", "e": "invalid_interval_end_before_start", "f": "missing_or_invalid_coordinates",
        "g": "missing_or_invalid_coordinates", "h": "ok",
    }
    assert got["g"]["locus_start"] == -1 and got["d"]["chrom"] == "UNKNOWN" and got["d"]["strand"] == "+"
    assert got["a"]["sequence"] == "" and got["a"]["window_size_observed"] == 0
    done = W.extract_windows(spark.createDataFrame(rows, COLS), contigs(spark), W.WindowSettings(size=1000), 256)
    s = W.window_summary(done).first()
    assert (s["n_total"], s["n_ok"], s["n_fallback"], s["cache_hits"], s["cache_misses"]) == (8, 1, 7, 0, 1)


def test_shared_sites_are_cut_once(spark):
    got = cut(spark, [("pB", "chr22", "1500", "1500", "+"), ("pA", "22", "1500", "1500", "+"), ("pC", "22", "1500", "1500", "-")])
    assert [got[k]["from_cache"] for k in ("pA", "pB", "pC")] == [False, True, False]
    assert got["pA"]["sequence"] == got["pB"]["sequence"] and got["pA"]["cache_key"] == got["pB"]["cache_key"]


@pytest.mark.parametrize("chunk", [64, 1000, 4096])
def test_random_sites_equal_slicing(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for i in range(120):
        c = rng.choice(list(SEQ))
        a = int(rng.integers(1, 3600))
        rows.append((f"p{i}", f"chr{c}", str(a), str(a + 7), "+"))
        n, size = len(SEQ[c]), 1001
        mid = (a + a + 7) // 2
        lo = max(1, min(mid - 500, n - size + 1))
        want[f"p{i}"] = SEQ[c][lo - 1 : lo - 1 + size]
    got = cut(spark, rows, 1001, chunk)
    assert {k: r["sequence"] for k, r in got.items()} == want


def test_sizes_are_checked():
    for kw in ({"size": 10}, {"size": 5000}, {"low": 0}):
        with pytest.raises(ValueError):
            W.WindowSettings(**kw)


def joined(df):
    pdf = df.toPandas().sort_values(["chrom", "chunk_no"])
    return {c: "".join(g["seq"]) for c, g in pdf.groupby("chrom")}


def fasta_text(width=17):
    out = []
    for k, v in SEQ.items():
        out.append(f">chr{k} some text > more")
        out += [v[i : i + width].lower() for i in range(0, len(v), width)] + ["", "  "]
    return "\n".join(out + [">chr22 again", "TTTT", ""])


def test_fasta_plain_and_gzip(spark, tmp_path):
    want = {"22": SEQ["22"] + "TTTT", "1": SEQ["1"]}
    (tmp_path / "a.fa").write_text(fasta_text())
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(fasta_text())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name in ("a.fa", "b.fa.gz"):
        assert joined(read_fasta(spark, str(tmp_path / name), 100)) == want
    try:
        # Contigs now span many scan partitions.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert joined(read_fasta(spark, str(tmp_path / "a.fa"), 100)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    chunks = read_fasta(spark, str(tmp_path / "a.fa"), 100)
    assert {r["length"] for r in W.contig_lengths(chunks).collect()} == {3204, len(SEQ["1"])}
    assert [r[0] for r in W.available_contigs(chunks).collect()] == ["1", "22"]


def test_fasta_runs_of_lines(spark, tmp_path, monkeypatch):
    """A split is cut into runs of lines; headers and offsets are carried over runs and end with their file."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(fasta_text())
    (tmp_path / "in" / "b.fa").write_text(">chr1 more\nAC\n\nGT\n")
    saved, cut = [], fasta.cut_lineage

    def kept(df, name="cut"):
        saved.append(cut(df, name))
        return saved[-1]

    monkeypatch.setattr(fasta, "cut_lineage", kept)
    monkeypatch.setattr(fasta, "RUN_LINES", 7)
    assert joined(read_fasta(spark, str(tmp_path / "in"), 100)) == {"22": SEQ["22"] + "TTTT", "1": SEQ["1"] + "ACGT"}
    assert saved[0].groupBy("_run").count().agg({"count": "max"}).first()[0] <= 7
    (tmp_path / "in" / "b.fa").write_text("AC\n>chr1 more\nGT\n")
    with pytest.raises(ValueError, match="before the first header"):
        read_fasta(spark, str(tmp_path / "in"))


def test_fasta_errors(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ACGT\n>a\nA\n")
    with pytest.raises(ValueError, match="before the first header"):
        read_fasta(spark, str(tmp_path / "x.fa"))
    (tmp_path / "y.fa").write_text("\n\n")
    with pytest.raises(ValueError, match="no contig"):
        read_fasta(spark, str(tmp_path / "y.fa"))
