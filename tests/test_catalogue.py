"""Every query of the catalogue against its reference SQL, on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def lines(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    cur = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(frame.columns)
    assert lines([tuple(r) for r in frame.collect()], frame.columns) == lines(cur.fetchall(), names)


def test_entry(spark):
    assert catalogue.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["rewire", "rewire_invariants"])
def test_rewiring_queries_run_all_rounds(spark, monkeypatch, name):
    import inspect

    from treatlens.operators import graph

    real, asked = graph.rewire, []

    def noted(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments["rounds"])
        return bound.arguments["edges"].select("src", "dst", "weight")

    monkeypatch.setattr(graph, "rewire", noted)
    catalogue.queries()[name](spark, FOLDER)
    assert asked == [20]
