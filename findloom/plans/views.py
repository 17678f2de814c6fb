"""Findings-shaped views of the driver's tables, made with integer and string arithmetic only.

Each view is a list of (name, expression) that both Spark and DuckDB read the
same way, so that an oracle starts from equal rows. ``{sha(x)}`` stands for
SHA-256, the one function that the two name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINDING

_REPO = "'https://github.com/acme/r' || CAST({r} AS VARCHAR(20))"
_COMMIT = "substr({{sha('r' || CAST({r} AS VARCHAR(20)))}}, 1, 40)"


def _digits(x: str) -> str:
    return f"CAST({x} AS VARCHAR(20))"


#: One observation for each row of lineitem. Files and repositories grow with the data.
FINDINGS = ("lineitem", {
    "ref": f"'raw/' || {_digits('l_orderkey')} || '-' || {_digits('l_partkey')} || '-' || {_digits('l_suppkey')} || '-' || {_digits('l_linenumber')} || '-' || {_digits('CAST(l_quantity AS BIGINT)')}",
    "repo": "'https://github.com/acme/r' || " + _digits("l_suppkey - l_suppkey % 5"),
    "repo_suffix": "CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.git' ELSE '/' END",
    "commit_sha": "substr({sha('r' || " + _digits("l_suppkey - l_suppkey % 5") + ")}, 1, 40)",
    "upper_commit": "l_orderkey % 7 = 0",
    "scanner": "CASE WHEN l_linenumber % 2 = 0 THEN 'semgrep' ELSE 'opengrep' END",
    "version": "'1.0.0'",
    "rule_id": "CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag || '.' || l_linestatus ELSE lower(l_returnflag || '.' || l_linestatus) END",
    "ruleset": "'b0b0'",
    "cwe_no": "CASE l_partkey % 6 WHEN 0 THEN 78 WHEN 1 THEN 79 WHEN 2 THEN 89 WHEN 3 THEN 22 WHEN 4 THEN 918 ELSE NULL END",
    "category": "CASE l_partkey % 4 WHEN 0 THEN 'Command-Injection' WHEN 1 THEN 'xss; security' WHEN 2 THEN 'security' ELSE NULL END",
    "severity": "CASE l_partkey % 7 WHEN 0 THEN 'ERROR' WHEN 6 THEN NULL WHEN 1 THEN 'INFO' ELSE 'WARNING' END",
    "message": "'message ' || l_returnflag",
    "file": "'src/m' || " + _digits("l_partkey - l_partkey % 4") + " || '.py'",
    "file_form": "l_linenumber % 4",
    "start_line": "CAST(1 + l_orderkey % 40 AS INTEGER)",
    "end_line": "CAST(1 + l_orderkey % 40 + l_linenumber % 3 AS INTEGER)",
    "start_col": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(1 + l_partkey % 11 AS INTEGER) END",
    "end_col": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(3 + l_partkey % 11 AS INTEGER) END",
    "trace_file": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'src/t' || " + _digits("l_orderkey % 3") + " || '.py' END",
    "trace_line": "CAST(1 + l_orderkey % 10 AS INTEGER)",
    "trace_end": "CAST(1 + l_orderkey % 10 + l_orderkey % 2 AS INTEGER)",
    "snippet": "CASE l_partkey % 5 WHEN 0 THEN 'call  (x' || " + _digits("l_partkey % 3") + " || ')' WHEN 1 THEN 'call (x' || " + _digits("l_partkey % 3") + " || ') ' ELSE NULL END",
    "fingerprint": "CASE WHEN l_partkey % 10 = 2 THEN 'FP' || " + _digits("l_partkey % 9") + " WHEN l_partkey % 10 = 3 THEN 'requires login' ELSE NULL END",
})

#: Known vulnerabilities in the same repositories and files.
ENTRIES = ("orders", {
    "entry_id": "'entry-' || lpad(" + _digits("o_orderkey % 100000") + ", 5, '0')",
    "report_id": "'report-' || " + _digits("o_custkey"),
    "repo": "'https://github.com/acme/r' || " + _digits("CAST((o_custkey - o_custkey % 75) / 15 AS BIGINT)"),
    "commit_sha": "substr({sha('r' || " + _digits("CAST((o_custkey - o_custkey % 75) / 15 AS BIGINT)") + ")}, 1, 40)",
    "project": "'p' || " + _digits("o_custkey % 13"),
    "verify": "CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END",
    "l1": "CASE o_orderkey % 5 WHEN 0 THEN '命令注入' WHEN 1 THEN 'XSS' WHEN 2 THEN 'SQL injection (CWE-089)' WHEN 3 THEN '路径遍历' ELSE 'other' END",
    "l2": "CASE WHEN o_orderkey % 4 = 0 THEN 'cwe 918' ELSE NULL END",
    "file": "'src/m' || " + _digits("CAST((o_orderkey * 2 - (o_orderkey * 2) % 60) / 15 AS BIGINT)") + " || '.py'",
    "sink_start": "CAST(1 + o_orderkey % 40 AS INTEGER)",
    "sink_end": "CAST(1 + o_orderkey % 40 + o_orderkey % 2 AS INTEGER)",
    "source_file": "'src/t' || " + _digits("o_custkey % 3") + " || '.py'",
    "source_line": "CAST(1 + o_custkey % 10 AS INTEGER)",
})

#: Gold labels; toxic rows are undecided.
GOLD = ("labels", {
    "finding_id": "'finding-' || " + _digits("doc_id"),
    "label": "CASE WHEN toxic = 1 THEN 'UNCERTAIN' WHEN quality = 0 THEN 'FP_CONFIRMED' WHEN doc_id % 4 = 0 THEN 'TP_NOVEL' ELSE 'TP_KNOWN' END",
    "machine_label": "CASE WHEN toxic = 1 THEN 'MACHINE_UNCERTAIN' WHEN quality = 0 THEN 'MACHINE_FALSE_POSITIVE' ELSE 'MACHINE_TRUE_POSITIVE' END",
    "repository": "'r' || " + _digits("doc_id % 17"),
    "rule_id": "'rule-' || " + _digits("doc_id % 9"),
    "cwe_a": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'CWE-' || " + _digits("doc_id % 5") + " END",
    "cwe_b": "CASE WHEN doc_id % 6 = 1 THEN 'CWE-' || " + _digits("10 + doc_id % 2") + " ELSE NULL END",
    "language": "CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'unknown' END",
    "has_dataflow": "doc_id % 2 = 0",
})

#: Verdicts of two reviewers and a third; every eleventh document has none, every thirteenth does not count.
REVIEWS = ("documents", {
    "doc": "doc_id",
    "finding_id": "'finding-' || " + _digits("doc_id"),
    "verdict": "CASE doc_id % 5 WHEN 0 THEN 'TRUE_POSITIVE' WHEN 1 THEN 'ABSTAIN' WHEN 2 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END",
    "verdict_b": "CASE WHEN doc_id % 3 = 0 THEN 'FALSE_POSITIVE' ELSE CASE doc_id % 5 WHEN 0 THEN 'TRUE_POSITIVE' WHEN 1 THEN 'ABSTAIN' ELSE 'FALSE_POSITIVE' END END",
    "confidence": "CASE WHEN doc_id % 8 = 0 THEN 'LOW' ELSE 'HIGH' END",
    "confidence_b": "CASE WHEN doc_id % 9 = 0 THEN 'MEDIUM' ELSE 'HIGH' END",
    "valid": "doc_id % 10 <> 3",
    "valid_b": "doc_id % 14 <> 9",
    "eligible": "doc_id % 13 <> 0",
    "source": "source",
})

#: Attempts of scan jobs, numbered by time within a job.
ATTEMPTS = ("events", {
    "event_id": "event_id",
    "repo": "'https://github.com/acme/r' || " + _digits("user_id - user_id % 3"),
    "commit_sha": "substr({sha('u' || " + _digits("user_id") + ")}, 1, 40)",
    "scanner": "event_type",
    "status": "CASE event_id % 8 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SKIPPED' WHEN 4 THEN 'INTERRUPTED' ELSE 'SUCCESS' END",
    "error_type": "CASE WHEN event_id % 16 = 3 THEN 'NoApplicableRuleConfig' WHEN event_id % 8 IN (1, 3) THEN 'ScannerError' ELSE NULL END",
    "scan_id": "'scan-' || " + _digits("event_id % 2"),
    "props": "props",
    "value": "value",
})

VIEWS = {"findings": FINDINGS, "entries": ENTRIES, "gold": GOLD, "reviews": REVIEWS, "attempts": ATTEMPTS}

_SHA = re.compile(r"\{sha\(")


def _dialect(text: str, sha: str) -> str:
    """Replace ``{sha(x)}`` by a call."""
    while (m := _SHA.search(text)) is not None:
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        text = text[: m.start()] + sha.format(text[m.end() : at - 1]) + text[at + 1 :]
    return text


def sql_of(*names: str) -> str:
    """``WITH`` clauses of views for DuckDB."""
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{_dialect(x, 'sha256({})')} AS {c}" for c, x in columns.items()) + f" FROM {table})")
    return "WITH " + ", ".join(parts)


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's plain columns."""
    table, columns = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(min(cores, 64))  # a small table of one row group would keep one core busy
    return rows.selectExpr(*[f"{_dialect(x, 'sha2({}, 256)')} AS {c}" for c, x in columns.items()])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings view in the shape of the data model, with paths, urls and commits in several spellings."""
    f = flat(spark, sf_dir, "findings")
    c = F.col
    path = F.when(c("file_form") == 0, F.concat(F.lit("./"), "file")).when(c("file_form") == 1, F.replace("file", F.lit("/"), F.lit("//"))).when(c("file_form") == 2, F.replace("file", F.lit("/"), F.lit("\\"))).otherwise(c("file"))
    identity = F.concat_ws("|", "repo", "commit_sha", "scanner", F.lower("rule_id"), "file", "start_line", "end_line", F.coalesce(c("start_col").cast("string"), F.lit("-")))
    line = F.when(c("trace_line") == c("trace_end"), c("trace_line").cast("string")).otherwise(F.concat_ws("-", "trace_line", "trace_end"))
    node = F.struct(c("trace_file").alias("file"), line.alias("line"), F.lit("source").alias("description"), F.lit(None).cast("string").alias("code"))
    columns = {
        "schema_version": F.lit(1),
        "finding_id": F.concat(F.lit("finding-"), F.sha2(identity, 256)),
        "canonical_finding_id": F.lit(None),
        "repo_url": F.concat("repo", "repo_suffix"),
        "commit": F.when(c("upper_commit"), F.upper("commit_sha")).otherwise(c("commit_sha")),
        "scanner": F.struct(c("scanner").alias("name"), c("version").alias("version")),
        "rule": F.struct(
            c("rule_id").alias("id"), c("ruleset").alias("ruleset_commit"),
            F.when(c("cwe_no").isNull(), F.array()).otherwise(F.array(F.concat(F.lit("CWE-"), c("cwe_no").cast("string")))).alias("cwe"),
            c("category").alias("category"), c("severity").alias("severity"),
        ),
        "message": c("message"),
        "location": F.struct(path.alias("file"), "start_line", "end_line", "start_col", "end_col"),
        "dataflow_trace": F.when(c("trace_file").isNull(), F.array()).otherwise(F.array(node)),
        "snippet": c("snippet"),
        "fingerprint": c("fingerprint"),
        "provenance": F.struct(
            c("ref").alias("raw_result_ref"), F.array("ref").alias("evidence_refs"), F.lit("scan").alias("scan_id"),
            F.array(F.struct(c("scanner").alias("scanner"), c("rule_id").alias("rule_id"))).alias("observed_by"),
        ),
    }
    return f.select(*[columns[x.split()[0]].cast(_type(x.split()[0])).alias(x.split()[0]) for x in _fields()])


def _fields() -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(FINDING)]


def _type(name: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(FINDING)[name].dataType


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat(spark, sf_dir, "entries")
    line = F.when(F.col("sink_start") == F.col("sink_end"), F.col("sink_start").cast("string")).otherwise(F.concat_ws("-", "sink_start", "sink_end"))
    node = lambda file, at: F.struct(F.col(file).alias("file"), at.alias("line"), F.lit("code").alias("code"))
    source = node("source_file", F.col("source_line").cast("string"))
    return e.select(
        "entry_id", "report_id", F.col("repo").alias("repo_url"), F.col("commit_sha").alias("commit"), "project", F.col("verify").cast("int").alias("verify"),
        F.col("l1").alias("vuln_category_l1"), F.col("l2").alias("vuln_category_l2"),
        source.alias("entry_point"), node("file", line).alias("critical_operation"), F.array(source).alias("trace"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the entries; every seventeenth states one entry too many, every nineteenth is absent."""
    g = entries(spark, sf_dir).groupBy("report_id").agg(F.array_sort(F.collect_list("entry_id")).alias("entry_ids"))
    n = F.regexp_extract("report_id", r"(\d+)$", 1).cast("long")
    return g.filter(n % 19 != 0).withColumn("num_entries", (F.size("entry_ids") + F.when(n % 17 == 0, 1).otherwise(0)).cast("int"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "gold").select("finding_id", "label")


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = F.struct("repository", "rule_id", F.array_compact(F.array("cwe_a", "cwe_b")).alias("cwes"), "language", "has_dataflow")
    return flat(spark, sf_dir, "gold").select("finding_id", F.col("machine_label").alias("label"), features.alias("features"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "reviews").filter("doc % 11 <> 0").select("finding_id", "verdict", F.col("eligible").alias("evaluation_eligible"))


def reviewer(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    r = flat(spark, sf_dir, "reviews")
    s = "_b" if second else ""
    no = F.col("doc")
    code = F.when(F.col(f"verdict{s}") == "FALSE_POSITIVE", F.array(F.lit("CONSTANT_VALUE") if not second else F.when(no % 2 == 0, "CONSTANT_VALUE").otherwise("SAFE_API_USAGE"))).otherwise(F.array())
    node = F.struct(F.lit("src/a.py").alias("file"), (no % 9 + 1).cast("string").alias("line"), F.lit("step").alias("description"), F.lit(None).cast("string").alias("code"))
    return r.select(
        "finding_id", F.col(f"verdict{s}").alias("verdict"), F.col(f"confidence{s}").alias("confidence"), code.cast("array<string>").alias("reason_codes"),
        F.concat(F.lit("b" if second else "a"), no.cast("string")).alias("reasoning"), F.array(node).alias("evidence"), F.col(f"valid{s}").alias("evidence_valid"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    a = flat(spark, sf_dir, "attempts")
    number = F.row_number().over(W.partitionBy("repo", "commit_sha", "scanner").orderBy("event_id"))
    return a.select(
        "scan_id", number.alias("attempt"), F.col("repo").alias("repo_url"), F.col("commit_sha").alias("commit"), "scanner", "status",
        F.struct(F.col("error_type").alias("type"), F.lit(None).cast("string").alias("message")).alias("error"), "event_id", "props",
        F.col("value").alias("duration_seconds"),
    )
