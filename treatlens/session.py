"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 200_000
#: Rows of one task after ``clustered``; tables too small for that are spread over the cores by this many.
TASK_ROWS, SPREAD_ROWS = 500_000, 20_000


def local_session(app: str = "treatlens", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TREATLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """The reliable folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own, because there every task sees it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.master.startswith("local") and (named.startswith("file:") or named.startswith("/tmp/")):
        raise RuntimeError(f"spark.checkpoint.dir is '{named}', a folder of one machine; a cluster needs a shared one")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table another step reads back."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as parquet below the shared folder and continue from the files.

    Parquet rather than an RDD checkpoint: later passes read only the columns
    they need and the planner knows the real size when it picks a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting at most ``row_limit + 1`` rows.

    Above the limit the frame comes back without a hint and the join shuffles.
    Use it for lookup tables of known narrow rows.
    """
    if df.limit(row_limit + 1).count() <= row_limit:
        return F.broadcast(df)
    return df


def clustered(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by hash of ``key`` into parts of about ``TASK_ROWS`` rows.

    Groups and joins by the key follow without another shuffle. Their number of
    tasks follows the table, so the memory of one does not; partitions that
    adaptive execution merges by their size would each hold more of a larger table.
    """
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS))
    return df.repartition(max(1, few, -(-rows // TASK_ROWS)), key)


def partial_tasks(spark: SparkSession) -> int:
    """How many tasks may each emit one partial result (a few waves over the cores)."""
    return max(1, 4 * spark.sparkContext.defaultParallelism)
