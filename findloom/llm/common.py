"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, where driver and executors are one process, may go
    without that setting; it then gets a folder under /tmp.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


#: Folders that this process has written and not yet released.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> list[str]:
    return list(_WRITTEN)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Delete the tables that operators have written on the way, and return their number.

    Results are lazy and may read such tables until they are written
    themselves, so it is the caller who knows when they can go; ``keep`` names
    folders to stay.
    """
    gone = [path for path in _WRITTEN if path not in keep]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.remove(path)
    return len(gone)


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table stays until ``release``. This cuts the lineage and survives lost executors. Joins against the table
    are also plain scan-to-shuffle joins, whose skewed partitions adaptive
    execution can split; an aggregate below a join would prevent that.
    ``files`` bounds the number of files of a table whose rows are counted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if files is not None:
        df = df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(key, parts: int):
    """crc32 of the key as text, modulo ``parts``."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(parts))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def own_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A 64-bit key of each row's id and text, equal for equal rows alone.

    Rows that share a 64-bit hash with a row of another id or text, which a
    second hash tells, get a key made of both. At 10^10 rows about three hashes
    are shared; it is they that are gathered, not the rows.
    """
    first, second = _hashes(F.col(id_col), F.col(text_col))
    pairs = docs.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    shared = [row[0] for row in pairs.filter("least <> most").select("a").collect()]
    return F.when(first.isin(shared), F.xxhash64(first, second)).otherwise(first) if shared else first


def _hashes(row_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(row_id, text), F.xxhash64(F.lit("second"), text, row_id)
