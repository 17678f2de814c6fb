"""Scan jobs: last attempts, retry states, coverage, errors and what other scanners made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import NO_RULES
from .findings import latest_by

JOB = ["repo_url", "commit", "scanner"]


def latest(attempts: DataFrame) -> DataFrame:
    """Of each job the attempt with the highest number."""
    return latest_by(attempts, JOB, "attempt")


def reusable(status: Column, error_type: Column) -> Column:
    """Done for good: a success, or skipped as no rule applies."""
    return F.coalesce((status == "SUCCESS") | ((status == "SKIPPED") & (error_type == NO_RULES)), F.lit(False))


def job_states(attempts: DataFrame, timeout_limit: int = 2, live_scans: list[str] | None = None) -> DataFrame:
    """Rows (job, attempts, timeouts, status, error_type, state).

    ``state`` is the last status, but a RUNNING attempt of a scan that is not
    alive is INTERRUPTED, and a job that is not done and has used up its
    timeouts is QUARANTINED. Combines before the shuffle.
    """
    status = F.col("status")
    if live_scans is not None:
        status = F.when((status == "RUNNING") & ~F.col("scan_id").isin(live_scans), "INTERRUPTED").otherwise(status)
    j = attempts.withColumn("s", status).groupBy(*JOB).agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("s") == "TIMEOUT").alias("timeouts"),
        F.max_by(F.struct(F.col("s").alias("status"), F.col("error.type").alias("error_type"), "duration_seconds"), "attempt").alias("last"),
    )
    done = reusable(F.col("last.status"), F.col("last.error_type"))
    state = F.when(~done & (F.col("timeouts") >= timeout_limit), "QUARANTINED").otherwise(F.col("last.status"))
    return j.select(*JOB, "attempts", "timeouts", "last.status", "last.error_type", "last.duration_seconds", state.alias("state"))


def priorities(jobs: DataFrame, timeout_limit: int = 2, force: bool = False, retry_quarantined: bool = False) -> DataFrame:
    """Rows (job, priority) from 0 (first) to 4 (nothing to do); jobs without an attempt have null status."""
    done = reusable(F.col("status"), F.col("error_type"))
    spent = F.coalesce(F.col("timeouts") >= timeout_limit, F.lit(False))
    p = (
        F.when(F.col("status").isNull(), 0)
        .when(done, 1 if force else 4)
        .when(spent, 2 if retry_quarantined else 3)
        .when(F.col("status").isin("FAILED", "INTERRUPTED"), 1)
        .when(F.col("status") == "TIMEOUT", 2)
        .when(F.col("status") == "RUNNING", 3)
        .otherwise(1)
    )
    return jobs.select(*JOB, p.alias("priority"))


def select_snapshots(snapshots: DataFrame, repos: list[str] | None = None, commits: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Snapshots of the filters, in order, the first ``limit`` of them."""
    if repos:
        snapshots = snapshots.filter(T.normalize_repo(F.col("repo_url")).isin([r.strip().rstrip("/").removesuffix(".git") for r in repos]))
    if commits:
        snapshots = snapshots.filter(T.normalize_commit(F.col("commit")).isin([c.strip().lower() for c in commits]))
    out = snapshots.orderBy("repo_url", "commit")
    return out.limit(limit) if limit is not None else out


def unused_filters(snapshots: DataFrame, repos: list[str] | None = None, commits: list[str] | None = None) -> DataFrame:
    """Rows (rule_id, key, detail): filter values that no snapshot has."""
    spark = snapshots.sparkSession
    found = spark.createDataFrame([], "rule_id string, key string, detail string")
    for rule, column, values, form in (("UNUSED_REPOSITORY", "repo_url", repos, T.normalize_repo), ("UNUSED_COMMIT", "commit", commits, T.normalize_commit)):
        if values:
            wanted = spark.createDataFrame([(v,) for v in values], "value string").withColumn("v", form(F.col("value")))
            lone = wanted.join(snapshots.select(form(F.col(column)).alias("v")), "v", "left_anti")
            found = found.unionByName(lone.select(F.lit(rule).alias("rule_id"), F.col("value").alias("key"), F.lit("").alias("detail")))
    return found


def expected_jobs(snapshots: DataFrame, scanners: list[str]) -> DataFrame:
    """Every snapshot for every scanner; the scanners are few, so each row is repeated for them."""
    return snapshots.select("repo_url", "commit").distinct().withColumn("scanner", F.explode(F.array(*map(F.lit, scanners))))


def coverage_rows(jobs: DataFrame, snapshots: DataFrame, scanners: list[str]) -> DataFrame:
    """Rows (job, status, error_type, verdict, blocking): how each expected or found job counts.

    ``verdict`` is MISSING, UNEXPECTED, IGNORED (a scanner not asked for),
    BLOCKING or OK.
    """
    e = expected_jobs(snapshots, scanners).withColumn("expected", F.lit(True))
    j = jobs.select(*JOB, "status", "error_type", "state", F.lit(True).alias("found")).join(e, JOB, "full_outer")
    ok = reusable(F.col("status"), F.col("error_type"))
    verdict = (
        F.when(F.col("found").isNull(), "MISSING")
        .when(~F.col("scanner").isin(scanners), "IGNORED")
        .when(F.col("expected").isNull(), "UNEXPECTED")
        .when(ok, "OK")
        .otherwise("BLOCKING")
    )
    blocking = F.when(F.col("state") == "QUARANTINED", "QUARANTINED_TIMEOUT").otherwise(F.col("status"))
    return j.select(*JOB, "status", "error_type", verdict.alias("verdict"), F.when(verdict == "BLOCKING", blocking).alias("blocking"))


def coverage(rows: DataFrame) -> DataFrame:
    """One row of totals over ``coverage_rows``."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    t = rows.agg(
        F.count_if(F.col("verdict").isin("MISSING", "OK", "BLOCKING")).alias("jobs_expected"),
        F.count_if(F.col("verdict").isin("OK", "BLOCKING")).alias("jobs_accounted"),
        n("MISSING").alias("missing"),
        n("UNEXPECTED").alias("unexpected"),
        n("IGNORED").alias("ignored"),
        n("BLOCKING").alias("blocking"),
    )
    return t.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("blocking") == 0))


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows (kind, status, n): statuses of expected jobs, and of those that block."""
    each = F.array_compact(
        F.array(
            F.when(F.col("verdict").isin("OK", "BLOCKING"), F.struct(F.lit("status").alias("kind"), "status")),
            F.when(F.col("verdict") == "BLOCKING", F.struct(F.lit("blocking").alias("kind"), F.col("blocking").alias("status"))),
        )
    )
    return rows.select(F.explode(each).alias("e")).groupBy("e.kind", "e.status").agg(F.count("*").alias("n"))


def progress(jobs: DataFrame, expected: int) -> DataFrame:
    """One row: jobs by state, and the share that is done."""
    return jobs.agg(
        F.count("*").alias("jobs"),
        F.count_if(reusable(F.col("status"), F.col("error_type"))).alias("done"),
        F.count_if(F.col("state") == "QUARANTINED").alias("quarantined"),
        F.count_if(F.col("state").isin("FAILED", "INTERRUPTED")).alias("failed"),
        F.sum("attempts").alias("attempts"),
    ).withColumn("percent", F.try_divide(100.0 * F.col("done"), F.lit(expected)))


# --- errors inside reports -------------------------------------------------


def errors_of(reports: DataFrame) -> DataFrame:
    """Rows (job, error_index, error_type, level, path, message) from rows (job, errors as JSON texts).

    The type may be a text or a list, whose first counts; the path may be the
    error's own or its first span's.
    """
    e = reports.select(*JOB, F.posexplode("errors").alias("error_index", "raw"))
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    first = lambda v: F.when(v.startswith("["), F.get(F.from_json(v, "array<string>"), F.lit(0))).otherwise(v)
    kind = F.coalesce(F.nullif(first(get("type")), F.lit("")), F.nullif(first(get("error_type")), F.lit("")), F.nullif(get("level"), F.lit("")), F.lit("unknown"))
    path = F.coalesce(F.nullif(get("path"), F.lit("")), get("spans[0].file"), get("spans[0].path"), F.lit(""))
    return e.select(
        *JOB,
        "error_index",
        kind.alias("error_type"),
        F.coalesce(get("level"), F.lit("")).alias("level"),
        F.translate(path, "\\", "/").alias("path"),
        F.coalesce(F.nullif(get("message"), F.lit("")), get("long_msg"), F.when(~F.col("raw").startswith("{"), F.col("raw")), F.lit("")).alias("message"),
    )


def alternate_engines(errors: DataFrame, scanned: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows (job, error_index, other, file_status) for every partly parsed file and every other scanner of the ledger.

    ``scanned`` has (job, path), ``jobs`` (job, status). The other scanner's
    file is PARTIAL, FILE_ERROR:types, SCANNED_CLEAN or NOT_SCANNED; a job
    that did not succeed shows its status, a missing one MISSING. The scanners
    are the distinct names of the ledger, a handful.
    """
    snap, key = ["repo_url", "commit"], T.portable_path(F.col("path"))
    scanners = jobs.agg(F.array_sort(F.collect_set("scanner")).alias("scanners"))
    partial = errors.filter("error_type = 'PartialParsing'").select(*JOB, "error_index", "path", key.alias("file"))
    p = partial.crossJoin(F.broadcast(scanners)).withColumn("other", F.explode("scanners")).filter("other != scanner").drop("scanners")  # one row of names
    by_file = errors.filter(key != "").groupBy(*snap, F.col("scanner").alias("other"), key.alias("file")).agg(F.array_sort(F.collect_set("error_type")).alias("types"))
    clean = scanned.select(*snap, F.col("scanner").alias("other"), key.alias("file"), F.lit(True).alias("clean")).distinct()
    states = jobs.select(*snap, F.col("scanner").alias("other"), F.col("status").alias("other_status"))
    j = p.join(states, [*snap, "other"], "left").join(by_file, [*snap, "other", "file"], "left").join(clean, [*snap, "other", "file"], "left")
    status = (
        F.when(F.col("other_status").isNull(), "MISSING")
        .when(F.col("other_status") != "SUCCESS", F.col("other_status"))
        .when(F.array_contains("types", "PartialParsing"), "PARTIAL")
        .when(F.col("types").isNotNull(), F.concat(F.lit("FILE_ERROR:"), F.array_join("types", ",")))
        .when(F.col("clean"), "SCANNED_CLEAN")
        .otherwise("NOT_SCANNED")
    )
    return j.select(*JOB, "error_index", "path", "file", "other", status.alias("file_status"))


def error_summary(errors: DataFrame, alternates: DataFrame) -> DataFrame:
    """One row of totals over errors and the fate of partly parsed files."""
    partial = F.col("error_type") == "PartialParsing"
    e = errors.agg(
        F.count("*").alias("observations"),
        F.count_distinct(*JOB).alias("jobs_with_errors"),
        F.count_if(partial).alias("partial_parsing_observations"),
        F.count_distinct(F.when(partial, F.struct(*JOB, "path"))).alias("partial_parsing_engine_files"),
        F.count_distinct(F.when(partial, F.struct("repo_url", "commit", "path"))).alias("partial_parsing_files"),
    )
    # A file is unresolved if for one of its errors no other scanner read it cleanly.
    seen = alternates.groupBy(*JOB, "error_index").agg(F.bool_or(F.col("file_status") == "SCANNED_CLEAN").alias("clean"))
    p = errors.filter(partial).select(*JOB, "error_index", T.portable_path(F.col("path")).alias("file")).join(seen, [*JOB, "error_index"], "left")
    open_ = p.filter(~F.coalesce("clean", F.lit(False))).agg(F.count_distinct("repo_url", "commit", "file").alias("unresolved_partial_files"))
    return e.crossJoin(open_)  # one row each


def error_counts(errors: DataFrame) -> DataFrame:
    """Rows (dimension, value, n) by scanner and type."""
    sides = F.array(F.struct(F.lit("scanner").alias("dimension"), F.col("scanner").alias("value")), F.struct(F.lit("type").alias("dimension"), F.col("error_type").alias("value")))
    return errors.select(F.explode(sides).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def diagnostics(reports: DataFrame) -> DataFrame:
    """Rows (job, errors_total, partial_parsing_files, findings, scanned_paths) of raw reports."""
    e = errors_of(reports).groupBy(*JOB).agg(
        F.count("*").alias("errors_total"),
        F.array_sort(F.collect_set(F.when((F.col("error_type") == "PartialParsing") & (F.col("path") != ""), F.col("path")))).alias("partial_parsing_files"),
    )
    n = reports.groupBy(*JOB).agg(F.sum(F.size(F.coalesce("results", F.array()))).alias("findings"), F.sum(F.size(F.coalesce("paths.scanned", F.array()))).alias("scanned_paths"))
    return n.join(e, JOB, "left").select(
        *JOB,
        F.coalesce("errors_total", F.lit(0)).alias("errors_total"),
        F.coalesce("partial_parsing_files", F.array().cast("array<string>")).alias("partial_parsing_files"),
        F.col("findings").cast("long").alias("findings"),
        F.col("scanned_paths").cast("long").alias("scanned_paths"),
    )


def provenance_violations(attempts: DataFrame, *pins: str) -> DataFrame:
    """Rows (rule_id, key, detail): columns that one scan's attempts do not agree on."""
    wide = attempts.groupBy("scan_id", "scanner").agg(*[F.count_distinct(F.struct(p)).alias(f"n_{p}") for p in pins])
    found = F.filter(F.array(*[F.struct(F.lit(p).alias("pin"), F.col(f"n_{p}").alias("n")) for p in pins]), lambda x: x["n"] > 1)
    return wide.select(F.explode(found).alias("x"), F.concat_ws(" ", "scan_id", "scanner").alias("key")).select(
        F.lit("MIXED_PROVENANCE").alias("rule_id"), "key", F.concat_ws("=", "x.pin", F.col("x.n").cast("string")).alias("detail")
    )


def resume_conflicts(attempts: DataFrame, current: DataFrame, *inputs: str) -> DataFrame:
    """Rows (job, input) of successes that were made from other inputs than those of now."""
    old = latest(attempts).filter("status = 'SUCCESS'").select(*JOB, *[F.col(i).alias(f"old_{i}") for i in inputs])
    j = old.join(current.select(*JOB, *inputs), JOB)
    changed = F.array_compact(F.array(*[F.when(~F.col(i).eqNullSafe(F.col(f"old_{i}")), F.lit(i)) for i in inputs]))
    return j.select(*JOB, F.explode(changed).alias("input"))
