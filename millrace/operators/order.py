"""Positions in an order of the whole table, without gathering it in one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder of its session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_position(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """``df`` with its rows' positions from 0 in ``order``, which should end in a unique key.

    Rows are range-partitioned and sorted; each adds the sizes of the ranges before its own. One count a partition is
    broadcast. After ``limit`` prefer ``rank_few``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialized(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("__part", before.alias("__before")))
    placed = held.join(shift, part == F.col("__part"))
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(2**33 - 1)).drop("__at", "__part", "__before")


def before(df: DataFrame, position: str, amount: str, n: int, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows at smaller ``position``, a whole number below ``n`` that no two rows share.

    Stretches of positions are summed apart, a few a partition; one sum a stretch is broadcast.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialized(df.withColumn("__part", F.floor(F.col(position) / -(-max(n, 1) // parts))))
    sums = held.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    shift = F.broadcast(sums.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("__part").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn(name, own).join(shift, F.col("__part") == F.col("__of")).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__of", "__before")


def rank_few(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Positions from 0 of a table that a limit has bounded, by one window."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
