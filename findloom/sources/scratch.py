"""Tables that operators write on their way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders named so far and not yet released.
_NAMED: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file:///tmp/checkpoints"
    _NAMED.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def release(spark: SparkSession) -> int:
    """Delete the folders that operators have named so far, and return their number.

    Results are lazy and may read them, so it is the caller who knows when they
    have been written or are not wanted any more.
    """
    gone = list(_NAMED)
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _NAMED.remove(path)
    return len(gone)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, written once and read by the steps that follow.
    It survives lost executors, and large partitions of joins with it can be split."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
