"""Writers for result frames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: the session's checkpoint folder.

    Where the session names none, as in tests, it is a new folder below its warehouse; on a cluster a warehouse that is
    a local folder is an error, as executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(warehouse, f"liftline-{uuid.uuid4().hex}")


def shared(df: DataFrame) -> DataFrame:
    """Compute a frame once for several branches of a job.

    Written to the shared checkpoint folder, so it outlives the executors that
    made it. Under adaptive execution the partitioning is not remembered: the next
    operator by key shuffles the (weekly, already reduced) rows once more.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def keyed(df: DataFrame, keys: Iterable[str], buckets: int | None = None) -> DataFrame:
    """The frame, written once as a table bucketed by its keys, in the shared folder.

    Windows, aggregations and joins on these keys read it without a shuffle, in every
    plan that uses it. The number of buckets is by default the session's number of
    shuffle partitions.
    """
    spark, keys = df.sparkSession, list(keys)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"liftline_{uuid.uuid4().hex}"
    # dealt out first, so that each bucket is one file
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
     .option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name))
    return spark.table(name)


def write_frame(df: DataFrame, path: str, partition_by: Iterable[str] = ("dept", "scorecard_wk"),
                file_format: str = "parquet") -> None:
    """Overwrite the partitions present in the frame, parquet by default.

    The rebalance hint lets adaptive execution split a large partition over
    several files and merge small ones. A frame without rows
    leaves a partitioned target without files: `read_frame` reads it all the same.
    """
    keys = [c for c in partition_by if c in df.columns]
    rows = df.hint("rebalance", *keys) if keys else df
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if file_format == "csv":
        writer = writer.option("header", True)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.format(file_format).save(path)


def read_frame(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet") -> DataFrame:
    """A written frame under its own schema: also where no row was written, and with partition columns typed."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path).select(*schema.fieldNames())


def write_frames(frames: dict[str, DataFrame], root: str,
                 partition_by: Iterable[str] = ("dept", "scorecard_wk"),
                 file_format: str = "parquet") -> dict[str, int]:
    """Write each frame to its own folder below `root`; the rows of each, counted by the run that writes it."""
    rows = {}
    for name, df in frames.items():
        seen = Observation(f"{name}_{uuid.uuid4().hex}")
        write_frame(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{root.rstrip('/')}/{name}", partition_by, file_format)
        rows[name] = seen.get["rows"]
    return rows


def truncate_target(spark: SparkSession, like: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Replace whatever lies at the path by an empty frame of the same schema."""
    spark.createDataFrame([], like.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").format(file_format).save(path)
