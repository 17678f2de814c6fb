"""The scan ledger as a stream: an extension beyond the batch queries.

Attempts arrive as files. Job states are kept up to date from them, findings
are passed on once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import JOB
from ..schemas import ATTEMPT, FINDING


def read_attempts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of attempt rows from JSON lines that appear in a folder."""
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_findings(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FINDING).option("maxFilesPerTrigger", files_per_trigger).json(path)


def job_states(attempts: DataFrame, timeout_limit: int = 2) -> DataFrame:
    """Running job states: last status, attempts and timeouts. The state is one row for each job."""
    return attempts.groupBy(*JOB).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("status") == "TIMEOUT").alias("timeouts"), F.max_by("status", "attempt").alias("status")
    ).withColumn("spent", F.col("timeouts") >= timeout_limit)


def statuses_by_window(attempts: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Attempts by status in windows of their end; later ones than ``lateness`` are left out."""
    timed = attempts.withColumn("ended", F.try_to_timestamp("ended_at")).withWatermark("ended", lateness)
    return timed.groupBy(F.window("ended", length), "status").agg(F.count("*").alias("n")).select("window.start", "window.end", "status", "n")


def first_seen(findings: DataFrame, time_col: str, lateness: str = "1 day") -> DataFrame:
    """Each finding id once, as long as its repeats come within ``lateness``."""
    return findings.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["finding_id"])


def keep_table(states: DataFrame, path: str, checkpoint: str):
    """Write each batch of changed states to a folder of its own; the last one of a job counts.

    A batch that is repeated after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job that ``keep_table`` has written."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*JOB).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in JOB]), "batch").alias("s"))
    return newest.select(*JOB, "s.*").drop("batch")
