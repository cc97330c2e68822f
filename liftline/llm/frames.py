"""Helpers for frames: reliable checkpoints, column names that clash with nothing, tables of a folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline import workers

workers.ship()

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, one below the
    session's warehouse, which must not be a driver's own folder on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(warehouse, "_checkpoints")


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again: later readers scan the columns that they need."""
    path = os.path.join(shared_folder(frame.sparkSession), f"table-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage, in the folder that the session names.

    Where none is named (tests), a folder below the session's warehouse is set. The shuffle files that led to the frame
    are dropped with its lineage, not whenever the driver collects its garbage.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return frame.select("*").checkpoint()  # a new frame, which is planned under the setting
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def numbered(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """frame with `pos`: each row's place among those of equal keys, from 0. A key with very many rows is sorted and counted
    in pieces, so no task holds it whole."""
    ranged = checkpointed(frame.repartitionByRange(*keys, *order).withColumn("piece", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(*keys, "piece").agg(F.count("*").alias("n")).select(*keys, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "piece").orderBy(*order))
    placed = ranged.withColumn("inside", inside).join(pieces, [*keys, "piece"])
    return placed.select(*frame.columns, (F.col("before") + F.col("inside") - 1).alias("pos"))


def free_name(frame: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to differ from every column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(frame: DataFrame, name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. lower() does that for texts of ASCII only, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
