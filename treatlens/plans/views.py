"""The test tables seen as cells, genes, counts, treatments, contigs and vectors.

Orders are cells, part brands are genes, summed quantities are counts and order
priorities are treatments with ``5-LOW`` as the control. Ids keep their native
type: operators only compare and hash them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens.session import clustered

CONTROL_PRIORITY = "5-LOW"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def expr(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, gene_id, count) with one row per non-zero."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), "l_quantity"
    )
    # The rows of a file are counted from its footer.
    return (
        clustered(named, "cell_id", lines.count())
        .groupBy("cell_id", "gene_id")
        .agg(F.sum("l_quantity").cast("bigint").alias("count"))
    )


def treatments(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, perturbation_id, condition) from orders alone."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("o_orderpriority").alias("perturbation_id"),
        F.when(F.col("o_orderpriority") == CONTROL_PRIORITY, "control")
        .otherwise("perturbed")
        .alias("condition"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """All eight cell columns; the dimension joins are left to the optimizer, what is per order is dealt by order."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, folder, "region").select("r_regionkey", "r_name")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    n_lines = lines.count()
    lines = (
        clustered(lines, "l_orderkey", n_lines)
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("qty"),
            # Discounts are whole hundredths: adding them as integers makes the mean
            # the same for any order of the rows, so equal values stay equal in ranks.
            (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (F.count(F.lit(1)) * 10)).alias("disc10"),
        )
    )
    control = F.col("o_orderpriority") == CONTROL_PRIORITY
    placed = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        clustered(placed, "o_orderkey", n_lines)
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("cell_id"),
            F.col("r_name").alias("cell_type"),
            F.col("o_orderstatus").alias("batch"),
            F.when(control, "control").otherwise("perturbed").alias("condition"),
            F.col("c_mktsegment").alias("protocol"),
            F.coalesce("qty", F.lit(0.0)).alias("library_size"),
            F.col("o_orderpriority").alias("perturbation_id"),
            F.when(control, 0.0)
            .otherwise(F.coalesce("disc10", F.lit(0.0)))
            .alias("knockdown_efficiency_proxy"),
        )
    )


def loci(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a treatment with a site on one document; some sites fall outside."""
    n_docs = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    start = F.floor("value").cast("bigint") * 10 + 1
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("perturbation_id"),
        F.when(F.col("event_type") == "error", F.lit("unknown"))
        .otherwise(F.concat(F.lit("chr"), (F.col("event_id") % (n_docs + 3)).cast("string")))
        .alias("chrom"),
        start.alias("start"),
        F.when(F.col("user_id") % 11 == 0, start - 5).otherwise(start + 20).alias("end"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def contig_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one contig over the letters A, C, G, T, N (whole text)."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("chrom"),
        F.upper(F.regexp_replace("text", "[^ACGTacgt]", "N")).alias("seq"),
    )


def treatment_loci(spark: SparkSession, folder: str) -> DataFrame:
    """Site and dose per treatment id, derived from the orders that carry it."""
    pid = F.col("o_orderpriority")
    return (
        table(spark, folder, "orders")
        .groupBy(pid.alias("perturbation_id"))
        .agg(F.min("o_orderkey").alias("first_key"))
        .select(
            "perturbation_id",
            F.upper(F.split_part("perturbation_id", F.lit("-"), F.lit(2))).alias("target_gene"),
            F.when(F.col("perturbation_id").startswith("4"), F.lit("unknown"))
            .otherwise(F.concat(F.lit("chr"), F.split_part("perturbation_id", F.lit("-"), F.lit(1))))
            .alias("chrom"),
            F.when(F.col("perturbation_id").startswith("3"), F.lit(0))
            .otherwise(F.col("first_key") + 100)
            .cast("bigint")
            .alias("start"),
            (F.col("first_key") + 120).cast("bigint").alias("end"),
            F.lit("+").alias("strand"),
            F.when(F.col("perturbation_id") == CONTROL_PRIORITY, "control")
            .otherwise("crispri")
            .alias("modality"),
            F.when(F.col("perturbation_id").startswith("2"), F.lit(None).cast("double"))
            .otherwise(F.split_part("perturbation_id", F.lit("-"), F.lit(1)).cast("double") / 2)
            .alias("dose"),
            F.col("perturbation_id").alias("gRNA_id"),
        )
    )


# The same views as SQL text, for the reference queries.
SQL_EXPR = """expr AS (
  SELECT l_orderkey AS cell_id, p_brand AS gene_id, CAST(SUM(l_quantity) AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SQL_TREATMENTS = """cells AS (
  SELECT o_orderkey AS cell_id, o_orderpriority AS perturbation_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'control' ELSE 'perturbed' END AS condition
  FROM orders)"""

SQL_CELLS = """cells AS (
  SELECT o_orderkey AS cell_id, r_name AS cell_type, o_orderstatus AS batch,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'control' ELSE 'perturbed' END AS condition,
    c_mktsegment AS protocol, COALESCE(qty, 0.0) AS library_size,
    o_orderpriority AS perturbation_id,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE COALESCE(disc10, 0.0) END
      AS knockdown_efficiency_proxy
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 10) AS disc10
             FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

SQL_NORMAL = """lib AS (SELECT cell_id, SUM(count) AS lib FROM expr GROUP BY 1),
normal AS (
  SELECT e.cell_id, gene_id, count, ln(1 + count / greatest(lib, 1.0) * 10000.0) AS z
  FROM expr e JOIN lib USING (cell_id))"""

SQL_LOCI = """loci AS (
  SELECT CAST(event_id AS VARCHAR) AS perturbation_id,
    CASE WHEN event_type = 'error' THEN 'unknown'
      ELSE 'chr' || CAST(event_id % ((SELECT COUNT(*) FROM documents) + 3) AS VARCHAR) END AS chrom,
    CAST(floor(value) AS BIGINT) * 10 + 1 AS "start",
    CASE WHEN user_id % 11 = 0 THEN CAST(floor(value) AS BIGINT) * 10 - 4
      ELSE CAST(floor(value) AS BIGINT) * 10 + 21 END AS "end",
    CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM events)"""

SQL_CONTIGS = """contigs AS (
  SELECT CAST(doc_id AS VARCHAR) AS chrom,
    upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM documents)"""

SQL_TREATMENT_LOCI = """perts AS (
  SELECT pid AS perturbation_id, upper(split_part(pid, '-', 2)) AS target_gene,
    CASE WHEN pid LIKE '4%' THEN 'unknown' ELSE 'chr' || split_part(pid, '-', 1) END AS chrom,
    CASE WHEN pid LIKE '3%' THEN 0 ELSE first_key + 100 END AS "start", first_key + 120 AS "end",
    '+' AS strand, CASE WHEN pid = '5-LOW' THEN 'control' ELSE 'crispri' END AS modality,
    CASE WHEN pid LIKE '2%' THEN NULL ELSE CAST(split_part(pid, '-', 1) AS DOUBLE) / 2 END AS dose,
    pid AS "gRNA_id"
  FROM (SELECT o_orderpriority AS pid, MIN(o_orderkey) AS first_key FROM orders GROUP BY 1))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
