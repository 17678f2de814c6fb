"""Findings: well-formedness, statistics, category filter and evidence of a second report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SNAPSHOT = ("repo_n", "commit_n")


def keyed(findings: DataFrame) -> DataFrame:
    """The findings with the normal forms that joins and groups compare."""
    location = F.col("location")
    return findings.withColumns(
        {
            "repo_n": T.normalize_repo(F.col("repo_url")),
            "commit_n": T.normalize_commit(F.col("commit")),
            "scanner_n": F.coalesce(T.fold(F.trim("scanner.name")), F.lit("")),
            "version_n": F.coalesce(F.trim("scanner.version"), F.lit("")),
            "rule_n": F.coalesce(T.fold(F.trim("rule.id")), F.lit("")),
            "ruleset_n": F.coalesce(T.fold(F.trim("rule.ruleset_commit")), F.lit("")),
            "path_n": T.normalize_path(location["file"]),
            "start_line": location["start_line"],
            "end_line": location["end_line"],
            "start_col": location["start_col"],
            "end_col": location["end_col"],
        }
    )


#: Identity of one observation, before any clustering over scanners.
EXACT_KEY = (*SNAPSHOT, "scanner_n", "version_n", "rule_n", "ruleset_n", "path_n", "start_line", "end_line", "start_col", "end_col")


def sort_key(ref: str = "provenance.raw_result_ref") -> Column:
    """The order of findings. A missing column number comes before all others."""
    return F.struct(
        "repo_n", "commit_n", "path_n", "start_line", "end_line",
        F.coalesce("start_col", F.lit(-1)).alias("start_col"), F.coalesce("end_col", F.lit(-1)).alias("end_col"),
        "scanner_n", "version_n", "rule_n", "finding_id", F.col(ref).alias("ref"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in their order, by Spark's range-partitioned sort."""
    columns = findings.columns
    return keyed(findings).withColumn("k", sort_key()).orderBy("k").select(*columns)


def violations(findings: DataFrame) -> DataFrame:
    """Rows (rule_id, key, detail): malformed findings, and ids that name two identities."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    f = keyed(findings)
    checks = {
        "FINDING_ID": blank(F.col("finding_id")),
        "REPO_URL": F.col("repo_n") == "",
        "COMMIT": F.col("commit_n") == "",
        "SCANNER": F.col("scanner_n") == "",
        "RULE": F.col("rule_n") == "",
        "PATH": F.col("path_n") == "",
        "LINES": ~F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False)),
        "RAW_REF": blank(F.col("provenance.raw_result_ref")),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    malformed = f.select(F.explode(broken).alias("rule_id"), F.col("finding_id").alias("key"), F.coalesce("provenance.raw_result_ref", F.lit("")).alias("detail"))
    n = F.count_distinct(F.struct(*EXACT_KEY))
    shared = f.filter(~blank(F.col("finding_id"))).groupBy("finding_id").agg(n.alias("n")).filter("n > 1")
    return malformed.unionByName(shared.select(F.lit("CONFLICTING_IDENTITY").alias("rule_id"), F.col("finding_id").alias("key"), F.col("n").cast("string").alias("detail")))


def statistics(findings: DataFrame) -> DataFrame:
    """One row of totals."""
    steps = F.coalesce(F.size("dataflow_trace"), F.lit(0))
    return findings.agg(
        F.count("*").alias("findings"),
        F.count_distinct("rule.id").alias("unique_rules"),
        F.count_distinct("location.file").alias("unique_files"),
        F.sum(steps).cast("long").alias("trace_nodes"),
        F.max(steps).cast("long").alias("max_trace_nodes"),
        F.count_if(steps > 0).alias("with_trace"),
    )


def by_job(findings: DataFrame) -> DataFrame:
    """Rows (repo_url, commit, scanner, ...): the totals of each scan job's findings."""
    return findings.groupBy("repo_url", "commit", F.col("scanner.name").alias("scanner")).agg(
        F.count("*").alias("findings"),
        F.count_distinct("rule.id").alias("unique_rules"),
        F.count_distinct("location.file").alias("unique_files"),
        F.count_if(F.size("dataflow_trace") > 0).alias("with_trace"),
    )


def counts(findings: DataFrame) -> DataFrame:
    """Rows (dimension, value, n) by scanner, severity and category; a missing value counts as ``None``."""
    sides = {"scanner": "scanner.name", "severity": "rule.severity", "category": "rule.category"}
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(v, F.lit("None")).alias("value")) for k, v in sides.items()])
    return findings.select(F.explode(each).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def of_categories(findings: DataFrame, *categories: str) -> DataFrame:
    """Findings whose category is one of those named, compared without case."""
    return findings.filter(T.fold(F.trim(F.coalesce("rule.category", F.lit("")))).isin([c.strip().casefold() for c in categories]))


def with_second_report(findings: DataFrame, other: DataFrame) -> DataFrame:
    """Findings with the evidence that another report of the same scan adds.

    The other report's finding has the same rule, file and lines, and no other
    start column or message. Only a finding with exactly one such partner gets
    its trace, and its snippet, fingerprint and category where it has none;
    CWEs are united. Identity does not change.
    """
    columns = findings.columns
    alike = ["rule.id", "location.file", "location.start_line", "location.end_line"]
    own = [*[F.col(c).alias(f"k{i}") for i, c in enumerate(alike)], F.coalesce("location.start_col", F.lit(-1)).alias("k4"), F.coalesce("message", F.lit("")).alias("k5")]
    f = findings.select(*own).distinct()
    keys = f.columns
    o = other.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(alike)],
        F.col("location.start_col").alias("o_col"),
        F.col("message").alias("o_message"),
        F.struct("dataflow_trace", "snippet", "fingerprint", "rule", "provenance").alias("o"),
    )
    open_ = lambda a, b, none: F.coalesce((F.col(a) == none) | (F.col(b) == none) | (F.col(a) == F.col(b)), F.lit(True))
    partners = f.join(o, keys[: len(alike)]).filter(open_("k4", "o_col", -1) & open_("k5", "o_message", ""))
    single = partners.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("o", F.col("o.provenance.raw_result_ref")).alias("o")).filter("n = 1").select(*keys, "o")
    j = findings.select("*", *own).join(single, keys, "left")
    traced = F.coalesce(F.size("o.dataflow_trace") > 0, F.lit(False))
    filled = lambda own, theirs: F.when(F.coalesce(F.col(own), F.lit("")) != "", F.col(own)).otherwise(F.coalesce(F.when(F.col(theirs) != "", F.col(theirs)), F.col(own)))
    cwe = F.array_sort(F.array_union(F.coalesce("rule.cwe", F.array()), F.coalesce("o.rule.cwe", F.array())))
    refs = F.array_sort(F.array_union(F.coalesce("provenance.evidence_refs", F.array()), F.coalesce("o.provenance.evidence_refs", F.array())))
    got = F.col("o").isNotNull()
    return j.select(
        *[
            {
                "dataflow_trace": F.when(traced, F.col("o.dataflow_trace")).otherwise(F.col("dataflow_trace")),
                "snippet": filled("snippet", "o.snippet"),
                "fingerprint": filled("fingerprint", "o.fingerprint"),
                "rule": F.when(got, F.col("rule").withField("cwe", cwe).withField("category", filled("rule.category", "o.rule.category"))).otherwise(F.col("rule")),
                "provenance": F.when(traced, F.col("provenance").withField("evidence_refs", refs)).otherwise(F.col("provenance")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in columns
        ]
    )


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last by ``order``."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
