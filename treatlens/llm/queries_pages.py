"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.llm.html_wrappers import extract_pages
from treatlens.llm.registry import query
from treatlens.llm.tables import table


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
