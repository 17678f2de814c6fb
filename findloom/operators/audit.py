"""The ground truth itself: keys, references, shapes, snapshots and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import span


def _bad_node(node: Column) -> Column:
    file = F.coalesce(F.trim(node["file"]), F.lit(""))
    return (file == "") | span(node["line"]).isNull() | node["code"].isNull()


def violations(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (rule_id, key, detail) for everything that is wrong with entries and reports."""
    tests = {
        "ENTRY_ID": ~F.coalesce(F.col("entry_id").rlike(r"^entry-\d{5}$"), F.lit(False)),
        "VERIFY": ~F.coalesce(F.col("verify").isin(0, 1), F.lit(False)),
        "COMMIT": ~F.coalesce(F.col("commit").rlike("^[0-9a-f]{40}$"), F.lit(False)),
        "REPO_URL": ~F.coalesce(F.col("repo_url").startswith("https://github.com/"), F.lit(False)),
        "ENTRY_POINT": F.coalesce(_bad_node(F.col("entry_point")), F.lit(True)),
        "CRITICAL_OPERATION": F.coalesce(_bad_node(F.col("critical_operation")), F.lit(True)),
        "TRACE": F.coalesce(F.exists("trace", _bad_node), F.lit(True)),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    rows = entries.select(F.explode(found).alias("rule_id"), F.col("entry_id").alias("key"), F.lit("").alias("detail"))
    lone = entries.join(reports, "report_id", "left_anti").select(F.lit("UNKNOWN_REPORT").alias("rule_id"), F.col("entry_id").alias("key"), F.col("report_id").alias("detail"))
    repeated = [
        df.groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule_id"), F.col(k).alias("key"), F.col("n").cast("string").alias("detail"))
        for df, k, rule in ((entries, "entry_id", "REPEATED_ENTRY"), (reports, "report_id", "REPEATED_REPORT"))
    ]
    own = entries.groupBy("report_id").agg(F.array_sort(F.collect_list("entry_id")).alias("ids"))
    j = reports.join(own, "report_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    wrong = F.array_compact(
        F.array(
            F.when(~F.col("entry_ids").eqNullSafe(F.col("ids")), F.lit("REPORT_ENTRIES")),
            F.when(~F.col("num_entries").eqNullSafe(F.size("ids")), F.lit("REPORT_COUNT")),
        )
    )
    back = j.select(F.explode(wrong).alias("rule_id"), F.col("report_id").alias("key"), F.size("ids").cast("string").alias("detail"))
    return rows.unionByName(lone).unionByName(repeated[0]).unionByName(repeated[1]).unionByName(back)


def snapshots(entries: DataFrame) -> DataFrame:
    """One row for each (repo_url, commit): projects, reports and entries, and their numbers."""
    g = entries.groupBy("repo_url", "commit").agg(
        F.array_sort(F.collect_set("project")).alias("projects"),
        F.array_sort(F.collect_set("report_id")).alias("report_ids"),
        F.array_sort(F.collect_list("entry_id")).alias("entry_ids"),
    )
    return g.withColumns({"num_reports": F.size("report_ids"), "num_entries": F.size("entry_ids")})


def statistics(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of totals."""
    ranged = F.contains("entry_point.line", F.lit("-")) | F.contains("critical_operation.line", F.lit("-"))
    e = entries.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("verify") == 1).alias("verified_entries"),
        F.count_if(F.col("verify") == 0).alias("unverified_entries"),
        F.count_distinct("repo_url").alias("distinct_repositories"),
        F.count_distinct("project").alias("distinct_projects"),
        F.count_distinct("repo_url", "commit").alias("distinct_snapshots"),
        F.count_if(ranged).alias("entries_with_line_ranges"),
    )
    return reports.agg(F.count("*").alias("reports")).crossJoin(e)  # one row each


def by_repository(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo_url").agg(F.count("*").alias("entries"))


def by_category(entries: DataFrame) -> DataFrame:
    """Distinct reports of each first-level category."""
    return entries.groupBy("vuln_category_l1").agg(F.count_distinct("report_id").alias("reports"))
