"""The scan ledger: numbered attempts and the pointers to the last of them, as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATUS = (
    "scan_id string, attempt int, repo_url string, commit string, scanner struct<name:string,observed_version:string>, ruleset_commit string, "
    "status string, exit_code int, error struct<type:string,message:string>, started_at string, ended_at string, duration_seconds double, "
    "outputs map<string,string>, checksums map<string,string>"
)
_POINTER = "schema_version int, scan_id string, repo_url string, commit string, scanner string, status string, attempt int, attempt_status string"


def read_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Attempt rows of ``root/*/*/*/attempts/NNNN/status.json`` with the number of their folder."""
    rows = spark.read.schema(_STATUS).option("multiLine", True).json(f"{root}/*/*/*/attempts/*/status.json").withColumn("file", F.col("_metadata.file_path"))
    number = F.regexp_extract("file", r"/attempts/([0-9]+)/status\.json$", 1).try_cast("int")
    return rows.withColumns({"folder_number": number, "scanner_version": F.col("scanner.observed_version"), "scanner": F.col("scanner.name")})


def read_pointers(spark: SparkSession, root: str) -> DataFrame:
    """Pointer rows of ``root/*/*/*/status.json``."""
    return spark.read.schema(_POINTER).option("multiLine", True).json(f"{root}/*/*/*/status.json").withColumn("file", F.col("_metadata.file_path"))


def violations(attempts: DataFrame, pointers: DataFrame) -> DataFrame:
    """Rows (rule_id, key, detail): folders and files that disagree, pointers without their attempt, jobs with two pointers."""
    numbers = attempts.filter(~F.coalesce(F.col("attempt") == F.col("folder_number"), F.lit(False))).select(
        F.lit("ATTEMPT_NUMBER").alias("rule_id"), F.col("file").alias("key"), F.coalesce(F.col("attempt").cast("string"), F.lit("")).alias("detail")
    )
    job = ["repo_url", "commit", "scanner"]
    a = attempts.select(*job, "attempt", F.col("scan_id").alias("a_scan"), F.col("status").alias("a_status"), F.lit(True).alias("there"))
    j = pointers.join(a, [*job, "attempt"], "left")
    tests = {
        "POINTER_WITHOUT_ATTEMPT": F.col("there").isNull(),
        "SCAN_ID_DIFFERS": F.col("there") & ~F.col("scan_id").eqNullSafe(F.col("a_scan")),
        "STATUS_DIFFERS": F.col("there") & ~F.col("status").eqNullSafe(F.col("a_status")),
        "PATH_OUTSIDE": F.coalesce(F.col("attempt_status").rlike(r"(?:^|[\\/])\.\.(?:[\\/]|$)|^[\\/]"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    wrong = j.select(F.explode(found).alias("rule_id"), F.col("file").alias("key"), F.coalesce("attempt_status", F.lit("")).alias("detail"))
    twice = pointers.groupBy(*job).agg(F.count("*").alias("n")).filter("n > 1")
    twice = twice.select(F.lit("REPEATED_JOB").alias("rule_id"), F.concat_ws(" ", *job).alias("key"), F.col("n").cast("string").alias("detail"))
    return numbers.unionByName(wrong).unionByName(twice)
