"""Session facts that operators size themselves by."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir). Where that is unset, a folder of this machine, but only
    if all executors are on it; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/tidelog-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


@atexit.register
def release() -> None:
    """Delete all tables that this process has put into the shared folder; frames that read them can't be used after it."""
    import pyarrow.fs as pafs

    while _made:
        try:
            fs, path = pafs.FileSystem.from_uri(_made.pop())
            if fs.get_file_info(path).type == pafs.FileType.Directory:
                fs.delete_dir(path)
        except (OSError, ValueError):  # what can't be deleted here is left to the folder's owner
            pass


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20, blow_up: float = 1.0) -> int:
    """Partitions that hold about bytes_each by the optimizer's size estimate, at least the session's shuffle partitions."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = size if size < 1 << 60 else 0  # unknown
    return max(least, math.ceil(size * blow_up / bytes_each))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is read in fewer parts than there are cores (a small table in one file); else df as it is.

    Only for rows that are costly to work on: large inputs have more parts than cores, and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it runs once, here, and losing an executor later loses nothing of it."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ordered_parts(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """df as a table in the shared folder with `_part`: parts are ranges of the keys, in order, so that an order over all rows is one
    inside parts and one over the parts (see before_parts). No part is a single task's whole table; equal keys stay together."""
    return written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), what)


def before_parts(df: DataFrame, **of_part) -> DataFrame:
    """One row a part: _part, and each aggregate of a part (a Column) taken over all parts before it: sums, or maxima where the name begins with max_."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are parts
    d = df.groupBy("_part").agg(*[c.alias(n) for n, c in of_part.items()])
    return d.select("_part", *[(F.max(n).over(w) if n.startswith("max_") else F.coalesce(F.sum(n).over(w), F.lit(0))).alias(n) for n in of_part])
