"""Queries for coercions, layouts, ingest, contract checks and repairs.

Bad values are derived from the test tables themselves (by line number, key or
status), so every query still reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens import functions as X
from treatlens.operators import layout, validation
from treatlens.operators.qc import library_size, normalise_log1p
from treatlens.plans import views as V
from treatlens.plans.queries_qc import rounded
from treatlens.plans.registry import query
from treatlens.session import cut_lineage, scratch_path
from treatlens.sources import stages
from treatlens.sources.fasta import read_fasta
from treatlens.sources.wide_table import fill_ids, load_entity_table

#: Keys of a file in ``fill_ids``.
FILE_KEYS = 1_000_000

SQL_DIRTY = """dirty AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber
    WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
    WHEN 3 THEN 'n/a' WHEN 4 THEN 'NaN' WHEN 5 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5 '
    WHEN 6 THEN '' ELSE NULL END AS raw, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint").cast("string")
    n = F.col("l_linenumber")
    raw = (
        F.when(n == 1, q)
        .when(n == 2, F.concat(F.lit("-"), q))
        .when(n == 3, "n/a")
        .when(n == 4, "NaN")
        .when(n == 5, F.concat(F.lit(" "), q, F.lit(".5 ")))
        .when(n == 6, "")
    )
    return V.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))


@query(
    "coerce_counts",
    V.with_sql(SQL_DIRTY)
    + """SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 1 THEN q
    WHEN 5 THEN CASE WHEN q % 2 = 0 THEN q ELSE q + 1 END ELSE 0 END AS BIGINT) AS count FROM dirty""",
)
def coerce_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _dirty(spark, folder).select(
        "l_orderkey", "l_linenumber", X.coerce_counts(F.col("raw")).alias("count")
    )


@query(
    "lenient_numbers",
    V.with_sql(SQL_DIRTY)
    + """SELECT l_orderkey, l_linenumber,
    CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN -q WHEN 5 THEN q + 0.5 END::DOUBLE AS as_double,
    CAST(CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN -q WHEN 5 THEN q END AS BIGINT) AS as_int FROM dirty""",
)
def lenient_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _dirty(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        X.as_double(F.col("raw")).alias("as_double"),
        X.as_int(F.col("raw")).alias("as_int"),
    )


@query(
    "clean_text",
    r"""SELECT event_id, trim(chr(9) || ' ' || event_type || ' ' || chr(10), chr(9) || chr(10) || ' ') AS cleaned,
    trim(props, chr(9) || chr(10) || ' ') AS props FROM events""",
)
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("event_type"), F.lit(" \n"))
    return V.table(spark, folder, "events").select(
        "event_id", X.clean_text(padded).alias("cleaned"), X.clean_text(F.col("props")).alias("props")
    )


@query(
    "is_control",
    """SELECT o_orderkey, lower(pid) IN ('ntc', 'ctrl', 'control', 'p000') OR lower(cond) = 'control' AS control FROM (
      SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'NTC' WHEN '2-HIGH' THEN 'p000'
        WHEN '3-MEDIUM' THEN 'ctrl_7' ELSE o_orderpriority END AS pid,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'Control' ELSE o_orderstatus END AS cond FROM orders)""",
)
def is_control(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    pid = F.when(p == "1-URGENT", "NTC").when(p == "2-HIGH", "p000").when(p == "3-MEDIUM", "ctrl_7").otherwise(p)
    cond = F.when(p == "5-LOW", "Control").otherwise(F.col("o_orderstatus"))
    return V.table(spark, folder, "orders").select("o_orderkey", X.is_control(pid, cond).alias("control"))


@query(
    "harmonise_cells",
    """SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, 'K562' AS cell_type, 'b_0' AS batch,
    CASE WHEN pid IN ('NTC') THEN 'control' ELSE 'perturbed' END AS condition, c_mktsegment AS protocol,
    CASE WHEN o_orderstatus = 'P' THEN lib ELSE o_totalprice END AS library_size, pid AS perturbation_id,
    CASE WHEN pid = 'NTC' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS knockdown_efficiency_proxy
    FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 'NTC' ELSE o_orderpriority END AS pid FROM orders)
    JOIN customer ON o_custkey = c_custkey
    JOIN (SELECT o_orderkey AS k, CAST(COALESCE(SUM(l_quantity), 0) AS DOUBLE) AS lib FROM orders
          LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = o_orderkey""",
)
def harmonise_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a raw table without cell type, batch, condition or knockdown, and with bad library sizes."""
    orders = V.table(spark, folder, "orders").join(
        V.table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    totals = library_size(V.expr(spark, folder), V.treatments(spark, folder))
    raw = orders.select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("c_mktsegment").alias("protocol"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_totalprice").cast("string")).alias("library_size"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NTC").otherwise(F.col("o_orderpriority")).alias("perturbation_id"),
    ).join(totals.select("cell_id", F.col("library_size").alias("computed_library")), "cell_id")
    return layout.harmonise_cells(raw, {"cell_type": "K562", "protocol": "x", "batch_prefix": "b"})


@query(
    "harmonise_genes",
    """SELECT DISTINCT p_brand AS gene_id, upper(p_brand) AS gene_symbol, 'unknown' AS chrom, '.' AS strand,
    CAST(-1 AS BIGINT) AS tss FROM part""",
)
def harmonise_genes(spark: SparkSession, folder: str) -> DataFrame:
    return layout.harmonise_genes(V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id")).distinct())


@query(
    "default_perturbations",
    """SELECT DISTINCT pid AS perturbation_id, CASE WHEN pid = 'ctrl' THEN 'NTC' ELSE upper(split_part(pid, '_', 1)) END AS target_gene,
    'unknown' AS chrom, CAST(-1 AS BIGINT) AS "start", CAST(-1 AS BIGINT) AS "end", '.' AS strand,
    CASE WHEN pid = 'ctrl' THEN 'control' ELSE 'crispri' END AS modality, CASE WHEN pid = 'ctrl' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS dose,
    pid AS "gRNA_id" FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'ctrl' ELSE lower(o_orderstatus) || 'gene_' || o_orderpriority END AS pid FROM orders)""",
)
def default_perturbations(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    pid = F.when(p == "5-LOW", "ctrl").otherwise(F.concat(F.lower("o_orderstatus"), F.lit("gene_"), p))
    return layout.default_perturbations(V.table(spark, folder, "orders").select(pid.alias("perturbation_id")))


@query(
    "perturbations_from_map",
    V.with_sql(V.SQL_TREATMENT_LOCI)
    + "SELECT perturbation_id, target_gene, chrom, \"start\", \"end\", strand, modality, dose, \"gRNA_id\" FROM perts",
)
def perturbations_from_map(spark: SparkSession, folder: str) -> DataFrame:
    """Treatments packed into maps of id to record, one map per modality, and opened again."""
    rows = V.treatment_loci(spark, folder)
    record = F.struct("target_gene", "chrom", "start", "end", "strand", "modality", "dose", "gRNA_id")
    packed = rows.groupBy("modality").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("perturbation_id"), record.alias("r")))).alias("records")
    )
    return layout.perturbations_from_map(packed, "records")


@query(
    "pick_layer",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL)
    + """SELECT cell_id, gene_id, CAST(count AS DOUBLE) AS raw, round(z, 6) + 0.0 AS normal FROM normal""",
)
def pick_layer(spark: SparkSession, folder: str) -> DataFrame:
    expr = normalise_log1p(V.expr(spark, folder))
    raw = layout.pick_layer(expr, "X").withColumnRenamed("value", "raw")
    normal = layout.pick_layer(expr, "normalized_log1p").withColumn("normal", rounded("value")).drop("value")
    return raw.join(normal, ["cell_id", "gene_id"])


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with one text column per brand, as a wide raw table."""
    brands = [r[0] for r in V.table(spark, folder, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    wide = V.expr(spark, folder).groupBy("cell_id").pivot("gene_id", brands).agg(F.sum("count"))
    cells = V.treatments(spark, folder)
    return cells.join(wide, "cell_id", "left").na.fill(0, brands)


@query(
    "to_long",
    V.with_sql(V.SQL_EXPR) + "SELECT cell_id, gene_id, count FROM expr",
)
def to_long(spark: SparkSession, folder: str) -> DataFrame:
    wide = _wide(spark, folder)
    genes = [c for c in wide.columns if c not in ("cell_id", "perturbation_id", "condition")]
    return layout.to_long(wide, ["cell_id"], genes)


@query(
    "to_vectors",
    V.with_sql(V.SQL_EXPR)
    + """SELECT o_orderkey AS cell_id, g.gene_id, COALESCE(count, 0)::DOUBLE AS value FROM orders
    CROSS JOIN (SELECT DISTINCT p_brand AS gene_id FROM part) g LEFT JOIN expr e ON e.cell_id = o_orderkey AND e.gene_id = g.gene_id""",
)
def to_vectors(spark: SparkSession, folder: str) -> DataFrame:
    brands = [r[0] for r in V.table(spark, folder, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    packed = layout.to_vectors(V.expr(spark, folder), brands, "count", V.treatments(spark, folder))
    names = F.array(*[F.lit(b) for b in brands])
    return packed.select("cell_id", F.posexplode("v").alias("i", "value")).select(
        "cell_id", names[F.col("i")].alias("gene_id"), "value"
    )


@query(
    "load_entity_table",
    V.with_sql(V.SQL_EXPR, V.SQL_NORMAL, V.SQL_TREATMENTS)
    + """SELECT CAST(cell_id AS VARCHAR) AS cell_id, gene_id, count, round(z, 6) + 0.0 AS z, perturbation_id, condition,
    'K562' AS cell_type, 'adamson_batch_0' AS batch, CAST(lib AS DOUBLE) AS library_size
    FROM normal JOIN cells USING (cell_id) JOIN lib USING (cell_id)""",
)
def load_table(spark: SparkSession, folder: str) -> DataFrame:
    """Write the wide table as CSV, load it, and show counts next to the harmonised cells."""
    path = scratch_path(spark, "wide")
    _wide(spark, folder).write.csv(path, header=True)
    tables = load_entity_table(spark, path, "adamson")
    cells = tables["cells"].select("cell_id", "perturbation_id", "condition", "cell_type", "batch", "library_size")
    return tables["expr"].withColumn("z", rounded("z")).join(cells, "cell_id")


@query(
    "fill_ids",
    """SELECT 'raw_cell_' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0')
      AS cell_id, 'unassigned' AS perturbation_id, o_totalprice FROM orders""",
)
def fill(spark: SparkSession, folder: str) -> DataFrame:
    """Number the orders over several files: one of the first keys, then each about ten times larger than the last."""
    path = scratch_path(spark, "raw")
    orders = V.table(spark, folder, "orders")
    # From the sixth on a file holds a fixed range of keys, so that no task sorts most of a large table.
    key = F.col("o_orderkey")
    small = F.floor(F.log10(key + 1)).cast("int")
    file = F.when(small < 5, small).otherwise(F.expr(f"5 + o_orderkey div {FILE_KEYS}").cast("int"))
    last = orders.agg(F.max("o_orderkey").alias("k")).first()["k"] or 0
    dealt = orders.repartitionById(6 + last // FILE_KEYS, file).sortWithinPartitions("o_orderkey")
    dealt.select("o_totalprice").write.parquet(path)
    return fill_ids(spark.read.parquet(path), "raw")


SQL_BAD_CELLS = """bad AS (SELECT cell_id, cell_type, CASE WHEN cell_id % 17 = 0 THEN '  ' ELSE batch END AS batch, condition,
    protocol, CASE WHEN cell_id % 5 = 0 THEN 'lots' WHEN cell_id % 7 = 0 THEN '-3' ELSE CAST(library_size AS VARCHAR) END AS library_size,
    perturbation_id FROM cells)"""


def _bad_cells(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("cell_id")
    lib = F.when(key % 5 == 0, "lots").when(key % 7 == 0, "-3").otherwise(F.col("library_size").cast("string"))
    return V.cells(spark, folder).select(
        "cell_id",
        "cell_type",
        F.when(key % 17 == 0, "  ").otherwise(F.col("batch")).alias("batch"),
        "condition",
        "protocol",
        lib.alias("library_size"),
        "perturbation_id",
    )


@query(
    "check_cells",
    V.with_sql(V.SQL_CELLS, SQL_BAD_CELLS)
    + """SELECT 'knockdown_efficiency_proxy' AS field, COUNT(*) AS n_bad, FALSE AS repaired FROM bad
    UNION ALL SELECT 'library_size.numeric', COUNT(*) FILTER (library_size = 'lots'), FALSE FROM bad
    UNION ALL SELECT 'library_size.non_negative', COUNT(*) FILTER (library_size = '-3'), FALSE FROM bad
    UNION ALL SELECT 'batch.text', COUNT(*) FILTER (trim(batch) = ''), FALSE FROM bad
    UNION ALL SELECT unnest(['cell_id.text', 'cell_type.text', 'condition.text', 'protocol.text', 'perturbation_id.text']), 0, FALSE""",
)
def check_cells(spark: SparkSession, folder: str) -> DataFrame:
    return validation.check_cells(_bad_cells(spark, folder)).select("field", "n_bad", "repaired")


@query(
    "repair_cells",
    V.with_sql(V.SQL_EXPR, V.SQL_CELLS, SQL_BAD_CELLS)
    + """, l AS (SELECT cell_id, SUM(count) AS lib FROM expr GROUP BY 1)
    SELECT b.cell_id, cell_type, trim(batch) AS batch, condition, protocol,
    CAST(COALESCE(TRY_CAST(library_size AS DOUBLE), COALESCE(lib, 0)) AS DOUBLE) AS library_size, perturbation_id,
    CAST(0.0 AS DOUBLE) AS knockdown_efficiency_proxy FROM bad b LEFT JOIN l USING (cell_id)""",
)
def repair_cells(spark: SparkSession, folder: str) -> DataFrame:
    return validation.repair_cells(_bad_cells(spark, folder), V.expr(spark, folder))


@query(
    "check_counts",
    """SELECT 'cells' AS field, 0 AS n_bad UNION ALL SELECT 'genes', 0
    UNION ALL SELECT 'non_negative', COUNT(*) FILTER (l_quantity - 10 < 0) FROM lineitem
    UNION ALL SELECT 'integer_like', COUNT(*) FILTER (l_linenumber = 3) FROM lineitem""",
)
def check_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities shifted below zero, the third line of an order moved off the whole numbers."""
    value = F.col("l_quantity") - 10 + F.when(F.col("l_linenumber") == 3, 0.25).otherwise(0.0)
    expr = V.table(spark, folder, "lineitem").select(value.alias("count"))
    genes = V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id"))
    return validation.check_counts(expr, V.treatments(spark, folder), genes).select("field", "n_bad")


@query(
    "check_genes",
    """SELECT 'strand' AS field, COUNT(*) AS n_bad, TRUE AS repaired FROM part
    UNION ALL SELECT 'tss.numeric', COUNT(*) FILTER (p_size < 10), TRUE FROM part
    UNION ALL SELECT 'gene_id.text', 0, FALSE UNION ALL SELECT 'gene_symbol.text', 0, FALSE
    UNION ALL SELECT 'chrom.text', COUNT(*) FILTER (p_type = 'SMALL'), FALSE FROM part""",
)
def check_genes(spark: SparkSession, folder: str) -> DataFrame:
    genes = V.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("gene_id"),
        F.col("p_name").alias("gene_symbol"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")).alias("chrom"),
        F.when(F.col("p_size") < 10, "?").otherwise(F.col("p_size").cast("string")).alias("tss"),
    )
    return validation.check_genes(genes, "repair").select("field", "n_bad", "repaired")


@query(
    "check_layer",
    """SELECT 'z.shape' AS field, COUNT(*) FILTER (l_linenumber = 2) AS n_bad FROM lineitem
    UNION ALL SELECT 'z.non_negative', COUNT(*) FILTER (l_linenumber <> 2 AND l_discount < 0.03) FROM lineitem""",
)
def check_layer(spark: SparkSession, folder: str) -> DataFrame:
    z = F.when(F.col("l_linenumber") != 2, F.col("l_discount") - 0.03)
    return validation.check_layer(V.table(spark, folder, "lineitem").select(z.alias("z"))).select("field", "n_bad")


@query(
    "check_embeddings",
    """SELECT 'embedding.rows' AS field, (SELECT COUNT(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_bad
    UNION ALL SELECT 'embedding.extra', (SELECT COUNT(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'embedding.dim', COUNT(*) FILTER (label = 3) FROM embeddings""",
)
def check_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Document vectors, those of one label cut short."""
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    vectors = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("cell_id"), cut.alias("embedding"))
    docs = V.table(spark, folder, "documents").select(F.col("doc_id").alias("cell_id"))
    return validation.check_embeddings(vectors, docs, "embedding", 64).select("field", "n_bad")


SQL_EVENT_PERTS = """ep AS (SELECT CASE WHEN event_id % 19 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS perturbation_id, event_id,
    event_type AS target_gene, CASE WHEN event_type = 'view' THEN '' ELSE 'chr1' END AS chrom,
    CAST(floor(value) AS BIGINT) AS s, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) - 2 ELSE CAST(floor(value) AS BIGINT) + 2 END AS e,
    CASE WHEN event_type = 'click' THEN 'high' WHEN event_type = 'signup' THEN NULL ELSE '1.5' END AS dose FROM events),
last AS (SELECT * FROM ep WHERE trim(perturbation_id) <> ''
    QUALIFY row_number() OVER (PARTITION BY perturbation_id ORDER BY event_id DESC) = 1)"""


def _event_perts(spark: SparkSession, folder: str) -> DataFrame:
    base = F.floor("value").cast("bigint")
    kind = F.col("event_type")
    return V.table(spark, folder, "events").select(
        F.when(F.col("event_id") % 19 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("perturbation_id"),
        "event_id",
        kind.alias("target_gene"),
        F.when(kind == "view", "").otherwise("chr1").alias("chrom"),
        base.alias("start"),
        F.when(F.col("event_id") % 3 == 0, base - 2).otherwise(base + 2).alias("end"),
        F.lit("+").alias("strand"),
        F.lit("crispri").alias("modality"),
        F.when(kind == "click", "high").when(kind == "signup", F.lit(None)).otherwise("1.5").alias("dose"),
    )


@query(
    "check_perturbations",
    V.with_sql(SQL_EVENT_PERTS)
    + """SELECT 'perturbation_id.text' AS field, COUNT(*) FILTER (trim(perturbation_id) = '') AS n_bad, FALSE AS repaired FROM ep
    UNION ALL SELECT 'gRNA_id', COUNT(*), FALSE FROM ep
    UNION ALL SELECT 'described', (SELECT COUNT(*) FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT perturbation_id FROM last)), FALSE
    UNION ALL SELECT 'start.numeric', 0, FALSE UNION ALL SELECT 'end.numeric', 0, FALSE
    UNION ALL SELECT 'interval', COUNT(*) FILTER (s >= 0 AND e >= 0 AND s > e), FALSE FROM last
    UNION ALL SELECT 'dose.numeric', COUNT(*) FILTER (dose = 'high'), FALSE FROM last
    UNION ALL SELECT 'chrom.text', COUNT(*) FILTER (chrom = ''), FALSE FROM last
    UNION ALL SELECT unnest(['target_gene.text', 'strand.text', 'modality.text']), 0, FALSE""",
)
def check_perturbations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as treatment records of their users; customers are the cells."""
    cells = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("perturbation_id"))
    done = validation.check_perturbations(_event_perts(spark, folder), cells, order_col="event_id")
    return done.select("field", "n_bad", "repaired")


@query(
    "repair_perturbations",
    V.with_sql(SQL_EVENT_PERTS)
    + """SELECT COALESCE(perturbation_id, u) AS perturbation_id, CASE WHEN perturbation_id IS NULL THEN 'unknown' ELSE target_gene END AS target_gene,
    CASE WHEN perturbation_id IS NULL THEN 'unknown' ELSE chrom END AS chrom, CASE WHEN perturbation_id IS NULL THEN -1 ELSE s END AS "start",
    CASE WHEN perturbation_id IS NULL THEN -1 ELSE e END AS "end", CASE WHEN perturbation_id IS NULL THEN '.' ELSE '+' END AS strand,
    CASE WHEN perturbation_id IS NULL THEN 'unknown' ELSE 'crispri' END AS modality, dose, COALESCE(perturbation_id, u) AS "gRNA_id"
    FROM last FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS u FROM customer) ON u = perturbation_id""",
)
def repair_perturbations(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("perturbation_id"))
    return validation.repair_perturbations(_event_perts(spark, folder), cells, order_col="event_id")


@query(
    "validate",
    V.with_sql(V.SQL_EXPR)
    + """SELECT 'cells' AS "check", 'knockdown_efficiency_proxy' AS field, COUNT(*) AS n_bad FROM orders
    UNION ALL SELECT 'cells', 'batch.text', COUNT(*) FILTER (o_orderkey % 17 = 0) FROM orders
    UNION ALL SELECT 'cells', 'library_size.numeric', COUNT(*) FILTER (o_orderkey % 5 = 0) FROM orders
    UNION ALL SELECT 'cells', 'library_size.non_negative', COUNT(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) FROM orders
    UNION ALL SELECT 'layer', 'z', COUNT(*) FROM expr
    UNION ALL SELECT 'embeddings', 'sequence_embedding', COUNT(*) FROM orders
    UNION ALL SELECT 'embeddings', 'cell_state_embedding', COUNT(*) FROM orders
    UNION ALL SELECT 'perturbations', 'dose.numeric', 0 WHERE FALSE
    UNION ALL SELECT 'perturbations', 'described', COUNT(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'version', 'schema_version', 1""",
)
def validate(spark: SparkSession, folder: str) -> DataFrame:
    """Strict violations over damaged tables; treatments described under other names."""
    perts = V.treatment_loci(spark, folder).withColumn(
        "perturbation_id", F.concat(F.lit("other_"), F.col("perturbation_id"))
    )
    genes = layout.harmonise_genes(V.table(spark, folder, "part").select(F.col("p_brand").alias("gene_id")).distinct())
    tables = {
        "cells": cut_lineage(_bad_cells(spark, folder), "cells"),
        "genes": genes,
        "expr": V.expr(spark, folder),
        "perturbations": perts,
        "vectors": None,
        "version": None,
    }
    _, report = validation.validate(tables, "strict")
    return validation.violations(report).select("check", "field", "n_bad")


@query(
    "row_standardise",
    """SELECT vec_id, i - 1 AS pos, round((x - m) / CASE WHEN s <= 1e-8 THEN 1 ELSE s END, 5) + 0.0 AS value FROM (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i,
        list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s FROM embeddings)""",
)
def row_standardise(spark: SparkSession, folder: str) -> DataFrame:
    vectors = V.table(spark, folder, "embeddings")
    return vectors.select("vec_id", F.posexplode(X.row_standardise(F.col("embedding"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), rounded("value", 5).alias("value")
    )


@query(
    "read_fasta",
    V.with_sql(V.SQL_CONTIGS)
    + f"""SELECT chrom, CAST(k AS INT) AS chunk_no, k * 4096 + 1 AS chunk_start, sha256(substr(seq, k * 4096 + 1, 4096)) AS digest
    FROM (SELECT chrom, seq, unnest(range((length(seq) - 1) // 4096 + 1)) AS k FROM contigs WHERE length(seq) > 0)""",
)
def fasta(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as FASTA text in lines of 60 letters, then read back."""
    path = scratch_path(spark, "fasta")
    texts = V.contig_texts(spark, folder).where(F.length("seq") > 0)
    last = F.floor((F.length("seq") - 1) / 60).cast("int")
    lines = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("seq", k * 60 + 1, F.lit(60)))
    texts.select(
        F.concat_ws("\n", F.concat(F.lit(">chr"), F.col("chrom"), F.lit(" a document")), F.array_join(lines, "\n"))
    ).write.text(path)
    return read_fasta(spark, path).select("chrom", "chunk_no", "chunk_start", F.sha2("seq", 256).alias("digest"))


@query(
    "reuse_or_build",
    """SELECT o_orderpriority AS perturbation_id, COUNT(*) AS n, FALSE AS first_from_cache, TRUE AS second_from_cache
    FROM orders GROUP BY 1""",
)
def reuse_or_build(spark: SparkSession, folder: str) -> DataFrame:
    """The orders processed twice: built first, then read back by checksum."""
    cache = scratch_path(spark, "cache")
    source = f"{folder}/orders.parquet"

    def build() -> dict[str, DataFrame]:
        return {"cells": V.treatments(spark, folder)}

    _, first = stages.reuse_or_build(spark, cache, source, None, build)
    tables, second = stages.reuse_or_build(spark, cache, source, None, build)
    return tables["cells"].groupBy("perturbation_id").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"first_from_cache": F.lit(first), "second_from_cache": F.lit(second)}
    )
