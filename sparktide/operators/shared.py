"""Lineage cuts and ordered ids."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sparktide-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: lineage is cut, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with numbers 1, 2, ... in an order of expressions without ties.

    Rows are range-partitioned and numbered within partitions; one count per partition is gathered, so no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = checkpointed(s.withColumn("__m", F.monotonically_increasing_id()))
    s = s.withColumn("__p", F.shiftright("__m", 33))
    before = s.groupBy("__p").count().select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))
    return s.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p", "__before")


def ordered_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a column with ids 0, 1, ... in their order.

    Values are range-partitioned and numbered within partitions; only one count per partition is
    gathered, so no task sees all values. The checkpoint keeps both passes on the same ranges.
    """
    return ranked(df.select(column).distinct(), [F.col(column)], out).select(column, (F.col(out) - 1).cast("int").alias(out))


def top_n(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in an order, numbered from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("int")).where(F.col(rank) <= n)
