import pytest

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs; the other columns follow from them."""

    def make(rows, extra=None):
        data = [(i, t, "en" if (i or 0) % 2 else "de", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
        frame = spark.createDataFrame(data, DOCS)
        for name in extra or []:
            frame = frame.withColumn(name, frame["n_chars"])
        return frame

    return make


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
