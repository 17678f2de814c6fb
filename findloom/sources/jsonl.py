"""JSON lines and JSON documents, read with explicit schemas; canonical writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line that is not blank. A line that is no JSON object
    has its text in ``_corrupt_record`` and nulls elsewhere."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file that holds one JSON object, with the file's path as ``source_file``."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


@dataclass(frozen=True)
class Limits:
    """What an input may hold: bytes of a file and of a line, rows of a file."""

    file_bytes: int = 1 << 30
    line_bytes: int = 32 << 20
    rows: int = 10_000


def line_violations(spark: SparkSession, path: str, max_bytes: int = 32 << 20, max_rows: int = 10_000, limits: Limits | None = None) -> DataFrame:
    """Rows (rule_id, key, detail): lines over ``max_bytes``, in bad UTF-8 or
    without an object, files with no row or over ``max_rows`` rows, and files
    beyond the ``limits`` of a profile, which stand for the two if given."""
    limits = limits or Limits(line_bytes=max_bytes, rows=max_rows)
    max_bytes, max_rows = limits.line_bytes, limits.rows
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"), F.trim("value") != "")
    lines = lines.toDF("file", "value", "filled").filter("filled")
    shape = F.schema_of_variant(F.try_parse_json("value"))
    checks = {
        "LINE_TOO_LONG": F.octet_length("value") > max_bytes,
        "INVALID_UTF8": ~F.is_valid_utf8("value"),
        "NOT_AN_OBJECT": ~F.coalesce(shape.startswith("OBJECT"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    by_line = lines.select(F.explode(found).alias("rule_id"), F.col("file").alias("key"), F.left(F.make_valid_utf8("value"), F.lit(80)).alias("detail"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    large = files.filter(F.col("length") > limits.file_bytes).select(F.lit("FILE_TOO_LARGE").alias("rule_id"), F.col("file").alias("key"), F.col("length").cast("string").alias("detail"))
    sizes = files.join(lines.groupBy("file").count(), "file", "left")
    n = F.coalesce("count", F.lit(0))
    by_file = sizes.select(
        F.when(n == 0, "NO_ROWS").when(n > max_rows, "TOO_MANY_ROWS").alias("rule_id"), F.col("file").alias("key"), n.cast("string").alias("detail")
    ).filter("rule_id is not null")
    return by_line.unionByName(by_file).unionByName(large)


def canonical_rows(df: DataFrame) -> DataFrame:
    """Each row as one line of canonical JSON, nulls included."""
    return df.select(canonical(F.struct(*df.columns), df.schema).alias("value"))


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """Canonical JSON lines, sorted by ``order``. Spark commits a folder's files
    when all are written, so no reader sees half of them."""
    rows = df.orderBy(*order) if order else df
    canonical_rows(rows).write.text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sha256, bytes, records): what a folder of JSON lines holds, file by file."""
    files = spark.read.format("binaryFile").load(path)
    newlines = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), newlines.cast("long").alias("records"))


def write_document(df: DataFrame, path: str) -> None:
    """One row as one canonical JSON document in a folder of its own, which Spark
    commits whole or not at all; more rows or none are an error."""
    if df.limit(2).count() != 1:
        raise ValueError("a document has one row")
    canonical_rows(df).coalesce(1).write.text(path)
