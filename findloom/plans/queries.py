"""Registered queries over the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families, json_schema, lines
from ..functions import text as T
from ..functions.canonical import canonical, case_key, digits_mod3, finding_id, stable_hash
from ..operators import audit, dataset, dedup, findings, gates, ledger, matching, metrics, packages, reviews, rules, sampling, usage
from ..sources import code, jsonl, reports, scratch
from ..sources import ledger as ledger_files
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _sql(name: str, views: tuple[str, ...], body: str, more: str = "") -> None:
    """Register SQL: the views, further ``more`` clauses, and the query's body."""
    head = V.sql_of(*views) if views else ""
    text = head + ((", " if head else "WITH ") + more if more else "") + "\n" + body
    _SQL[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if "FROM steps s JOIN" in more else text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of findings over all scanners."""
    return a3_clusters(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- findings ---------------------------------------------------------------

#: What the exact key compares, in SQL over the findings view.
_KEY = "repo, commit_sha, lower(scanner) AS scanner, version, lower(rule_id) AS rule_n, ruleset, file, start_line, end_line, start_col, end_col"
_KEYS = "repo, commit_sha, scanner, version, rule_n, ruleset, file, start_line, end_line, start_col, end_col"
_ID = "'finding-' || sha256(repo || '|' || commit_sha || '|' || scanner || '|' || lower(rule_id) || '|' || file || '|' || start_line || '|' || end_line || '|' || coalesce(CAST(start_col AS VARCHAR), '-'))"


@_query
def a1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of findings."""
    f = V.findings(spark, sf_dir)
    f = f.withColumn("location", F.col("location").withField("file", T.normalize_path(F.col("location.file"))))
    return findings.statistics(f)


_sql("a1_statistics", ("findings",), """
SELECT count(*) AS findings, count(DISTINCT rule_id) AS unique_rules, count(DISTINCT file) AS unique_files, CAST(count(trace_file) AS BIGINT) AS trace_nodes,
  CAST(max(CASE WHEN trace_file IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS max_trace_nodes, count(trace_file) AS with_trace FROM findings""")


@_query
def a1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by scanner, severity and category."""
    return findings.counts(V.findings(spark, sf_dir))


_sql("a1_counts", ("findings",), """
SELECT 'scanner' AS dimension, scanner AS value, count(*) AS n FROM findings GROUP BY 2
UNION ALL SELECT 'severity', coalesce(severity, 'None'), count(*) FROM findings GROUP BY 2
UNION ALL SELECT 'category', coalesce(category, 'None'), count(*) FROM findings GROUP BY 2""")


@_query
def p1_category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two categories, whatever their case."""
    return findings.of_categories(V.findings(spark, sf_dir), "SECURITY", "command-injection").select(
        F.col("provenance.raw_result_ref").alias("ref"), F.col("rule.category").alias("category")
    )


_sql("p1_category_filter", ("findings",), "SELECT ref, category FROM findings WHERE lower(category) IN ('security', 'command-injection')")


@_query
def x7_x8_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, urls and commits in their normal form, whatever their spelling."""
    f = findings.keyed(V.findings(spark, sf_dir))
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), "repo_n", "commit_n", "path_n")


_sql("x7_x8_normal_forms", ("findings",), "SELECT ref, repo AS repo_n, commit_sha AS commit_n, file AS path_n FROM findings")


@_query
def a2_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by exact identity."""
    g = dedup.exact_groups(V.findings(spark, sf_dir))
    return g.select(
        F.col("repo_n").alias("repo"), F.col("commit_n").alias("commit_sha"), F.col("scanner_n").alias("scanner"), "rule_n", F.col("path_n").alias("file"),
        "start_line", "end_line", "start_col", "end_col", "members", F.element_at("finding_ids", 1).alias("least_id"),
    )


_sql("a2_exact_groups", ("findings",), f"""
SELECT repo, commit_sha, scanner, rule_n, file, start_line, end_line, start_col, end_col, count(*) AS members, min(id) AS least_id
FROM (SELECT {_KEY}, {_ID} AS id FROM findings) GROUP BY {_KEYS}""")


#: Clusters over two scanners, in SQL. All members of a cluster are of different scanners, so it has two groups at
#: most, and complete-link merging takes the pairs of a file in order, each whose groups are both still free.
_CLUSTERS = """
ks AS (SELECT *, row_number() OVER (ORDER BY repo, file, start_line, end_line, coalesce(start_col, -1), coalesce(end_col, -1), scanner, rule_n) AS k FROM g),
ps AS (
  SELECT a.repo, a.file, a.k AS ka, b.k AS kb, row_number() OVER (PARTITION BY a.repo, a.file ORDER BY a.k, b.k) AS r
  FROM ks a JOIN ks b ON a.repo = b.repo AND a.commit_sha = b.commit_sha AND a.file = b.file AND a.scanner <> b.scanner AND a.k < b.k WHERE {compatible}),
steps AS (
  SELECT repo, file, 0::BIGINT AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS ka, CAST(NULL AS BIGINT) AS kb FROM ps WHERE r = 1
  UNION ALL SELECT p.repo, p.file, p.r, CASE WHEN free THEN used || [p.ka, p.kb] ELSE used END, CASE WHEN free THEN p.ka END, CASE WHEN free THEN p.kb END
  FROM (SELECT ps.*, s.used, NOT list_contains(s.used, ps.ka) AND NOT list_contains(s.used, ps.kb) AS free FROM steps s JOIN ps ON ps.repo = s.repo AND ps.file = s.file AND ps.r = s.r + 1) p),
of_group AS (SELECT kb AS k, ka AS c FROM steps WHERE ka IS NOT NULL),
rows_of AS (
  SELECT coalesce(o.c, ks.k) AS c, f.* FROM (SELECT """ + _KEY + ", rule_id, " + _ID + """ AS id FROM findings) f
  JOIN ks ON f.repo = ks.repo AND f.file = ks.file AND f.start_line = ks.start_line AND f.end_line = ks.end_line AND f.start_col IS NOT DISTINCT FROM ks.start_col
    AND f.end_col IS NOT DISTINCT FROM ks.end_col AND f.scanner = ks.scanner AND f.rule_n = ks.rule_n LEFT JOIN of_group o ON o.k = ks.k),
identities AS (
  SELECT DISTINCT c, id, '["' || concat_ws('","', id, repo, commit_sha, scanner, version, rule_n, ruleset, file) || '",' || concat_ws(',', start_line, end_line, coalesce('' || start_col, 'null'), coalesce('' || end_col, 'null')) || ']' AS j FROM rows_of),
ids AS (SELECT c, 'canonical-' || sha256('[' || string_agg(j, ',' ORDER BY id) || ']') AS canonical_id FROM identities GROUP BY c),
clusters AS (
  SELECT c, min(repo) AS repo_url, min(commit_sha) AS commit, min(file) AS file, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS member_count,
    CASE WHEN count(DISTINCT scanner) > 1 THEN 'CROSS_TOOL_SEMANTIC' WHEN count(*) > 1 THEN 'EXACT_DUPLICATE' ELSE 'SINGLETON' END AS cluster_type, string_agg(DISTINCT id, ',' ORDER BY id) AS finding_ids,
    string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS scanners, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids,
    string_agg(DISTINCT scanner || ':' || rule_id, ',' ORDER BY scanner || ':' || rule_id) AS observed_by, count(DISTINCT (scanner, rule_n, start_line, end_line, start_col, end_col)) AS groups
  FROM rows_of GROUP BY c)"""


@_query
def a3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters over all scanners, one row each."""
    s = dedup.cluster_summaries(V.findings(spark, sf_dir))
    return s.select(
        "canonical_finding_id", "repo_url", "commit", "file", "start_line", "end_line", "member_count", "cluster_type", F.array_join("finding_ids", ",").alias("finding_ids"),
        F.array_join("scanners", ",").alias("scanners"), F.array_join("rule_ids", ",").alias("rule_ids"),
        F.array_join(F.transform("observed_by", lambda o: F.concat_ws(":", o["scanner"], o["rule_id"])), ",").alias("observed_by"),
    )


@_query
def a5_dedup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of deduplication over all scanners."""
    return dedup.cluster_statistics(V.findings(spark, sf_dir))


@_query
def c1_canonical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster that every observation is in."""
    f = dedup.canonical(V.findings(spark, sf_dir))
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), "canonical_finding_id")


@_query
def a2_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of exact duplicates alone, without any merging over scanners."""
    s = dedup.cluster_summaries(V.findings(spark, sf_dir), cross_tool=False)
    return s.select(
        "repo_url", "commit", "file", "start_line", "end_line", "member_count", "cluster_type", F.array_join("finding_ids", ",").alias("finding_ids"),
        F.array_join("scanners", ",").alias("scanners"), F.array_join("rule_ids", ",").alias("rule_ids"),
        F.array_join(F.transform("observed_by", lambda o: F.concat_ws(":", o["scanner"], o["rule_id"])), ",").alias("observed_by"),
    )


_sql("a2_exact_clusters", ("findings",), f"""
SELECT repo AS repo_url, commit_sha AS commit, file, start_line, end_line, count(*) AS member_count,
  CASE WHEN count(*) > 1 THEN 'EXACT_DUPLICATE' ELSE 'SINGLETON' END AS cluster_type, string_agg(DISTINCT id, ',' ORDER BY id) AS finding_ids,
  scanner AS scanners, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids,
  string_agg(DISTINCT scanner || ':' || rule_id, ',' ORDER BY scanner || ':' || rule_id) AS observed_by
FROM (SELECT {_KEY}, rule_id, {_ID} AS id FROM findings) GROUP BY {_KEYS}""")


@_query
def j6_cross_tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of groups of different scanners that describe one place, by file."""
    p = dedup.pairs_of_findings(V.findings(spark, sf_dir))
    cols = lambda s: [F.col(f"k{s}.start_line").alias(f"start_{s}"), F.col(f"k{s}.scanner_n").alias(f"scanner_{s}"), F.col(f"k{s}.rule_n").alias(f"rule_{s}")]
    return p.select(F.col("repo_n").alias("repo"), F.col("path_n").alias("file"), *cols("a"), *cols("b"))


#: Exact groups with the different evidence of their observations, and whether two describe one place.
_GROUPS = f"""g AS (
  SELECT {_KEYS}, list(DISTINCT {{'cwe': cwe_no, 'snip': snip, 'ev': ev, 'cats': cats}}) AS sides FROM (
    SELECT {_KEY}, cwe_no, trim(regexp_replace(snippet, '\\s+', ' ', 'g')) AS snip,
      coalesce('s' || trim(regexp_replace(snippet, '\\s+', ' ', 'g')), 'f' || CASE WHEN lower(fingerprint) <> 'requires login' THEN lower(fingerprint) END) AS ev,
      coalesce(list_filter(list_transform(regexp_split_to_array(lower(category), '[,;|]'), lambda c: trim(c)), lambda c: c <> ''), CAST([] AS VARCHAR[])) AS cats
    FROM findings) GROUP BY {_KEYS})"""
_COMPATIBLE = """greatest(0, b.start_line - a.end_line, a.start_line - b.end_line) <= 5
    AND NOT coalesce(a.start_line = a.end_line AND b.start_line = b.end_line AND a.start_line = b.start_line AND (a.end_col < b.start_col OR b.end_col < a.start_col), false)
    AND len(list_filter(a.sides, lambda x: len(list_filter(b.sides, lambda y:
      (x.cwe IS NOT NULL AND y.cwe IS NOT NULL AND x.cwe <> y.cwe) OR (x.snip IS NOT NULL AND y.snip IS NOT NULL AND x.snip <> y.snip)
      OR NOT (a.rule_n = b.rule_n OR coalesce(x.cwe = y.cwe, false) OR coalesce(x.ev = y.ev, false) OR list_has_any(x.cats, y.cats)))) > 0)) = 0"""

_sql("j6_cross_tool_pairs", ("findings",), f"""
SELECT a.repo, a.file, a.start_line AS start_a, a.scanner AS scanner_a, a.rule_n AS rule_a, b.start_line AS start_b, b.scanner AS scanner_b, b.rule_n AS rule_b
FROM g a JOIN g b ON a.repo = b.repo AND a.commit_sha = b.commit_sha AND a.file = b.file AND a.scanner <> b.scanner
WHERE (a.start_line, a.end_line, coalesce(a.start_col, -1), coalesce(a.end_col, -1), a.scanner, a.rule_n) < (b.start_line, b.end_line, coalesce(b.start_col, -1), coalesce(b.end_col, -1), b.scanner, b.rule_n)
  AND {_COMPATIBLE}""", _GROUPS)

_IN_CLUSTERS = _GROUPS + "," + _CLUSTERS.format(compatible=_COMPATIBLE)
_sql("a3_clusters", ("findings",), """
SELECT canonical_id AS canonical_finding_id, repo_url, commit, file, start_line, end_line, member_count, cluster_type, finding_ids, scanners, rule_ids, observed_by FROM clusters JOIN ids USING (c)""", _IN_CLUSTERS)
_sql("c1_canonical_clusters", ("findings",), "SELECT x.ref, canonical_id AS canonical_finding_id FROM ids JOIN r USING (c) JOIN findings x ON x.ref = r.ref",
     _IN_CLUSTERS.replace(", rule_id, 'finding-'", ", ref, rule_id, 'finding-'") + ", r AS (SELECT DISTINCT c, ref FROM rows_of)")
_sql("a5_dedup_statistics", ("findings",), """
SELECT CAST(sum(member_count) AS BIGINT) AS input_findings, CAST(sum(member_count) AS BIGINT) AS output_findings, CAST(sum(groups) AS BIGINT) AS exact_groups,
  CAST(sum(member_count) - sum(groups) AS BIGINT) AS exact_duplicate_observations, count(*) AS canonical_clusters, CAST(sum(groups) - count(*) AS BIGINT) AS cross_tool_merges,
  count(*) FILTER (cluster_type LIKE 'CROSS%') AS cross_tool_clusters, count(*) FILTER (cluster_type LIKE 'EXACT%') AS exact_duplicate_clusters,
  count(*) FILTER (cluster_type = 'SINGLETON') AS singleton_clusters, CAST(sum(member_count) AS BIGINT) AS findings_with_canonical_id FROM clusters""", _IN_CLUSTERS)


@_query
def v1_v2_finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed findings, and ids that name two identities, of findings that are broken in every way."""
    f = V.findings(spark, sf_dir)
    n = F.col("location.start_line")
    f = f.withColumns({
        "finding_id": F.when(n == 1, " ").when(n == 2, F.concat(F.lit("shared-"), F.coalesce("rule.category", F.lit("none")))).otherwise(F.col("finding_id")), "repo_url": F.when(n == 3, " .git").otherwise(F.col("repo_url")),
        "commit": F.when(n != 4, F.col("commit")), "scanner": F.when(n != 5, F.col("scanner")), "rule": F.when(n == 6, F.col("rule").withField("id", F.lit(" "))).otherwise(F.col("rule")),
        "provenance": F.when(n == 7, F.col("provenance").withField("raw_result_ref", F.lit(""))).otherwise(F.col("provenance")),
        "location": F.when(n == 8, F.col("location").withField("file", F.lit(None))).when(n == 9, F.col("location").withField("end_line", F.lit(8))).when(n == 10, F.col("location").withField("start_line", F.lit(0))).otherwise(F.col("location")),
    })
    return findings.violations(f)


_sql("v1_v2_finding_gate", ("findings",), f"""
SELECT ['FINDING_ID', 'x', 'REPO_URL', 'COMMIT', 'SCANNER', 'RULE', 'RAW_REF', 'PATH', 'LINES', 'LINES'][start_line] AS rule_id, CASE WHEN start_line = 1 THEN ' ' ELSE id END AS key, CASE WHEN start_line = 7 THEN '' ELSE ref END AS detail
FROM (SELECT *, {_ID} AS id FROM findings) WHERE start_line <= 10 AND start_line <> 2
UNION ALL SELECT 'CONFLICTING_IDENTITY', 'shared-' || c, '' || count(*) FROM (SELECT DISTINCT coalesce(category, 'none') AS c, {_KEY} FROM findings WHERE start_line = 2) GROUP BY c HAVING count(*) > 1""")


@_query
def w2_latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each finding id the last observation."""
    f = V.findings(spark, sf_dir).select("finding_id", F.col("provenance.raw_result_ref").alias("ref"))
    return findings.latest_by(f, ["finding_id"], "ref")


_sql("w2_latest_observation", ("findings",), f"SELECT id AS finding_id, max(ref) AS ref FROM (SELECT {_ID} AS id, ref FROM findings) GROUP BY 1")


@_query
def j8_second_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the CWEs, snippets and traces that another report of the same places adds."""
    f = V.findings(spark, sf_dir)
    r = lambda scanner: f.filter(F.col("scanner.name") == scanner).withColumn("location", F.col("location").withField("file", T.normalize_path(F.col("location.file"))))
    j = findings.with_second_report(r("opengrep"), r("semgrep"))
    return j.select(
        F.col("provenance.raw_result_ref").alias("ref"), F.array_join("rule.cwe", ",").alias("cwe"), F.col("rule.category").alias("category"), "snippet", "fingerprint",
        F.array_join("provenance.evidence_refs", ",").alias("refs"), F.get("dataflow_trace", F.lit(0))["line"].alias("first_line"),
    )


_sql("j8_second_report", ("findings",), """
SELECT f.ref, coalesce(array_to_string(list_sort(list_distinct(list_filter(['CWE-' || f.cwe_no, 'CWE-' || o.cwe_no], lambda x: x IS NOT NULL))), ','), '') AS cwe,
  coalesce(f.category, o.category) AS category, coalesce(f.snippet, o.snippet) AS snippet, coalesce(f.fingerprint, o.fingerprint) AS fingerprint,
  CASE WHEN o.trace_file IS NOT NULL THEN least(f.ref, o.ref) || ',' || greatest(f.ref, o.ref) ELSE f.ref END AS refs,
  coalesce(CASE WHEN o.trace_file IS NOT NULL THEN o.at END, CASE WHEN f.trace_file IS NOT NULL THEN f.at END) AS first_line
FROM s f LEFT JOIN p ON p.ref = f.ref AND p.n = 1 LEFT JOIN s o ON o.ref = p.other WHERE f.scanner = 'opengrep'""", """s AS (
  SELECT *, CASE WHEN trace_line = trace_end THEN '' || trace_line ELSE trace_line || '-' || trace_end END AS at FROM findings),
p AS (SELECT a.ref, count(*) AS n, min(b.ref) AS other FROM s a JOIN s b ON a.rule_id = b.rule_id AND a.file = b.file AND a.start_line = b.start_line AND a.end_line = b.end_line
  AND coalesce(a.start_col = b.start_col, true) AND a.message = b.message WHERE a.scanner = 'opengrep' AND b.scanner = 'semgrep' GROUP BY a.ref)""")


# --- scalar functions -------------------------------------------------------


@_query
def x11_x12_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line values of several shapes as spans, and their distance from line 20."""
    k = F.col("l_orderkey")
    raw = (
        F.when(k % 7 == 0, (k % 50).cast("string"))
        .when(k % 7 == 1, F.concat((k % 50).cast("string"), F.lit("-"), (k % 50 + k % 9 - 2).cast("string")))
        .when(k % 7 == 2, F.concat(F.lit(" 0"), (k % 50).cast("string"), F.lit(" - "), (k % 50 + 1).cast("string"), F.lit(" ")))
        .when(k % 7 == 3, "x12")
        .when(k % 7 == 4, "")
        .otherwise((k % 40 + 1).cast("string"))
    )
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", raw.alias("line")).distinct().withColumn("s", lines.span(F.col("line")))
    strict = lines.strict_span(F.col("line")).isNotNull()
    gap = lines.distance(F.col("s.start"), F.col("s.end"), F.lit(20), F.lit(20))
    return rows.select("l_orderkey", "line", F.col("s.start").alias("start"), F.col("s.end").alias("end_line"), strict.alias("strict"), F.when(F.col("s").isNotNull(), gap).alias("gap"))


_sql("x11_x12_spans", (), """
SELECT l_orderkey, line, CASE WHEN ok THEN a END AS start, CASE WHEN ok THEN b END AS end_line,
  coalesce(ok AND regexp_full_match(line, '[1-9][0-9]*(-[1-9][0-9]*)?'), false) AS strict, CASE WHEN ok THEN greatest(0, 20 - b, a - 20) END AS gap
FROM (SELECT *, coalesce(a >= 1 AND b >= a, false) AS ok FROM (
  SELECT l_orderkey, line, TRY_CAST(regexp_extract(line, '^\\s*([0-9]+)(?:\\s*-\\s*([0-9]+))?\\s*$', 1) AS INTEGER) AS a,
    coalesce(TRY_CAST(regexp_extract(line, '^\\s*([0-9]+)\\s*-\\s*([0-9]+)\\s*$', 2) AS INTEGER), TRY_CAST(regexp_extract(line, '^\\s*([0-9]+)(?:\\s*-\\s*([0-9]+))?\\s*$', 1) AS INTEGER)) AS b
  FROM (SELECT DISTINCT l_orderkey, CASE l_orderkey % 7 WHEN 0 THEN '' || (l_orderkey % 50) WHEN 1 THEN (l_orderkey % 50) || '-' || (l_orderkey % 50 + l_orderkey % 9 - 2)
    WHEN 2 THEN ' 0' || (l_orderkey % 50) || ' - ' || (l_orderkey % 50 + 1) || ' ' WHEN 3 THEN 'x12' WHEN 4 THEN '' ELSE '' || (l_orderkey % 40 + 1) END AS line FROM lineitem)))""")


@_query
def x14_cwes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CWE ids that texts name in several spellings, sorted as strings."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit("cwe-0"), (k % 120).cast("string"), F.lit(" and CWE_"), (k % 7).cast("string"), F.lit(", Cwe/"), (k % 120).cast("string"), F.lit(" scwe "), (k % 3).cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.cwes(raw), ",").alias("cwes"))


_sql("x14_cwes", (), """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('cwe-0' || (p_partkey % 120) || ' and CWE_' || (p_partkey % 7) || ', Cwe/' || (p_partkey % 120) || ' scwe ' || (p_partkey % 3),
  '(?i)CWE[-_/ ]?(\\d+)', 1), lambda x: 'CWE-' || CAST(x AS INTEGER)))), ',') AS cwes FROM part""")


@_query
def x17_x24_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category tokens and keys, snippet hashes and evidence fingerprints."""
    f = V.flat(spark, sf_dir, "findings")
    return f.select(
        "ref", F.array_join(T.category_tokens(F.col("category")), "|").alias("tokens"), T.category_key(F.col("category")).alias("category_key"),
        T.snippet_hash(T.usable_snippet(F.col("snippet"))).alias("snippet_hash"), T.evidence_fingerprint(F.col("snippet"), F.col("fingerprint")).alias("evidence"),
    )


_sql("x17_x24_keys", ("findings",), """
SELECT ref, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(lower(category), '[,;|]'), lambda c: trim(c)), lambda c: c <> ''), '|'), '') AS tokens,
  coalesce(regexp_replace(lower(category), '[^\\p{L}\\p{N}]', '', 'g'), '') AS category_key, sha256(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))) AS snippet_hash,
  coalesce(sha256(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))), CASE WHEN lower(fingerprint) <> 'requires login' THEN lower(fingerprint) END) AS evidence FROM findings""")


def _families_sql(numbers: str, key: str) -> str:
    tests = []
    for name, (members, aliases) in families.FAMILIES.items():
        by_name = " OR ".join(f"contains({key}, '{families.key_of(a)}')" for a in aliases)
        tests.append(f"CASE WHEN list_has_any({numbers}, [{', '.join(map(str, members))}]) OR {by_name} THEN '{name}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


_ENTRY_CWES = "list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(l1, '') || ' ' || coalesce(l2, ''), '(?i)CWE[-_/ ]?(\\d+)', 1), lambda x: CAST(x AS INTEGER))))"
_CATEGORY_KEY = "coalesce(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


@_query
def x19_x20_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerability families of the known entries."""
    e = V.entries(spark, sf_dir)
    numbers, names = families.of_entry(F.col("vuln_category_l1"), F.col("vuln_category_l2"))
    return e.select("entry_id", F.array_join(numbers.cast("array<string>"), ",").alias("cwes"), F.array_join(names, ",").alias("families"))


_E_FAMILIES = f"list_sort(list_distinct(list_concat({_families_sql('cw', _CATEGORY_KEY.format('l1'))}, {_families_sql('cw', _CATEGORY_KEY.format('l2'))})))"
_sql("x19_x20_families", ("entries",), f"""
SELECT entry_id, coalesce(array_to_string(cw, ','), '') AS cwes, coalesce(array_to_string({_E_FAMILIES}, ','), '') AS families FROM (SELECT *, {_ENTRY_CWES} AS cw FROM entries)""")


@_query
def x34_x35_urls_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository slugs, safe paths and languages by suffix."""
    f = V.findings(spark, sf_dir)
    path = F.when(F.col("location.start_line") % 5 == 0, F.concat(F.lit("../"), F.col("location.file"))).when(F.col("location.start_line") % 5 == 1, F.lit("a/.GIT/x.TSX")).otherwise(F.col("location.file"))
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), T.repo_slug(F.col("repo_url")).alias("slug"), T.is_safe_path(path).alias("safe"), T.language(path).alias("language"))


_sql("x34_x35_urls_paths", ("findings",), """
SELECT ref, replace(substr(repo, 20), '/', '__') AS slug, start_line % 5 NOT IN (0, 1) AS safe, CASE WHEN start_line % 5 = 1 THEN 'typescript' ELSE 'python' END AS language FROM findings""")


#: Ends of texts with advisory ids and credentials of several shapes.
_SECRET_ENDS = [
    " and ENTRY-00012; Authorization: Bearer abc.def", " token={abcdefgh cookie: a{bcdefghij", " refresh-token = \"abcdefg, continuation_data:'12345' continuation=1234567}",
    " x eyJabcdefgh.ijklmnop_q.rstuvwxyz-0 eyJshort.ijklmnop.rstuvwxy", " BEARER  a~b+c/d== my_access_token_x=12345678;Cookie=abc", " opaque " + "Ab9_" * 24 + " and " + "Ab9_" * 23,
]


@_query
def x36_x37_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with credentials put at their ends, without advisory ids, entry names and credentials."""
    d = _table(spark, sf_dir, "documents")
    ends = F.get(F.array(*map(F.lit, _SECRET_ENDS)), (F.col("doc_id") % len(_SECRET_ENDS)).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" see CVE-2024-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 5, "0"), ends)
    return d.select("doc_id", T.redact_ids(text).alias("ids"), T.redact_secrets(text).alias("secrets"))


_ENDS_SQL = ", ".join("'" + end.replace("'", "''") + "'" for end in _SECRET_ENDS)
_sql("x36_x37_redaction", (), rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') || ' see CVE-2024-' || lpad('' || (doc_id % 10000), 5, '0') || ([{_ENDS_SQL}])[1 + doc_id % {len(_SECRET_ENDS)}] AS t FROM documents)
SELECT doc_id,
  regexp_replace(regexp_replace(t, '(?i)\b(CVE-[0-9]{{4}}-[0-9]{{4,}}|GHSA(-[23456789CFGHJMPQRVWX]{{4}}){{3}})\b', '[REDACTED]', 'g'), '(?i)\bentry-[0-9]{{5}}\b', '[REDACTED]', 'g') AS ids,
  right(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bbearer\s+[a-z0-9._~+/=-]+', '[REDACTED]', 'g'),
    '\beyJ[a-zA-Z0-9_-]{{8,}}\.[a-zA-Z0-9_-]{{8,}}\.[a-zA-Z0-9_-]{{8,}}\b', '[REDACTED]', 'g'),
    '(?i)((access[_-]?token|refresh[_-]?token|token|authorization|cookie|continuation([_-]?(token|data))?)\s*["'']?\s*[:=]\s*["'']?)[^\s"'',;}}{{]{{6,}}', '\1[REDACTED]', 'g'),
    '\b[A-Za-z0-9+/=_-]{{96,}}\b', '[REDACTED]', 'g'), 4000) AS secrets
FROM t""")


#: A schema with every keyword that records of reviews use, over orders as JSON.
_ORDER_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["key", "status", "lines", "at"],
    "properties": {
        "key": {"type": "integer", "minimum": 1},
        "status": {"enum": ["O", "F", "P"]},
        "version": {"const": 1},
        "at": {"type": "string", "format": "date-time"},
        "clerk": {"type": ["string", "null"], "minLength": 3, "maxLength": 15, "pattern": "^Clerk#"},
        "lines": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/line"}},
        "total": {"anyOf": [{"type": "number", "maximum": 10_000_000}, {"type": "null"}]},
    },
    "allOf": [{"if": {"properties": {"status": {"const": "P"}}, "required": ["status"]}, "then": {"required": ["clerk"]}}],
    "$defs": {"line": {"oneOf": [{"type": "integer", "minimum": 1}, {"type": "string", "pattern": "^[1-9][0-9]*-[1-9][0-9]*$"}]}},
}


@_query
def v23_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON, most of them broken in one way, held against a schema."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    way = k % 19
    piece = lambda name, broken, sound: F.when(way == name, broken).otherwise(sound)
    members = [
        F.concat(F.lit('"key":'), F.when(way == 0, F.lit("0")).when(way == 1, F.concat(k, F.lit(".5"))).when(way == 2, F.concat(k, F.lit(".0"))).otherwise(k.cast("string"))),
        F.concat(F.lit('"status":"'), F.when(way == 3, F.lit("X")).when(way == 4, F.lit("P")).otherwise(F.lit("O")), F.lit('"')),
        F.concat(F.lit('"version":'), piece(5, F.lit("true"), F.lit("1"))),
        F.when(way != 6, F.concat(F.lit('"at":"2024-02-'), piece(7, F.lit("30"), F.lit("28")), F.lit('T10:00:00Z"'))),
        F.when(way != 4, F.concat(F.lit('"clerk":'), F.when(way == 8, F.lit('"C"')).when(way == 9, F.lit("null")).when(way == 10, F.lit('"Clerk#\\u00e9\\u00e9-0123456789"')).otherwise(F.lit('"Clerk#01"')))),
        F.concat(F.lit('"lines":'), F.when(way == 11, F.lit("[]")).when(way == 12, F.lit('[1,2,"3-4",5]')).when(way == 13, F.lit('[1,"2-2",1]')).when(way == 14, F.lit('["0-1",2,0]')).otherwise(F.lit('[7,"1-2"]'))),
        F.concat(F.lit('"total":'), F.when(way == 15, F.lit("1e9")).when(way == 16, F.lit('"1"')).otherwise(F.lit("null"))),
        F.when(way == 17, F.lit('"odd \\"name":1')),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *members), piece(18, F.lit(""), F.lit("}")))
    found = o.select("o_orderkey", F.explode(json_schema.violations(text, _ORDER_SCHEMA)).alias("x"))
    return found.select("o_orderkey", "x.path", "x.keyword")


_sql("v23_schema_violations", (), """
WITH expected(way, path, keyword) AS (VALUES (0, '$.key', 'minimum'), (1, '$.key', 'type'), (3, '$.status', 'enum'), (4, '$.clerk', 'required'), (5, '$.version', 'const'), (6, '$.at', 'required'), (7, '$.at', 'format'),
  (8, '$.clerk', 'minLength'), (8, '$.clerk', 'pattern'), (10, '$.clerk', 'maxLength'), (11, '$.lines', 'minItems'), (12, '$.lines', 'maxItems'), (13, '$.lines', 'uniqueItems'),
  (14, '$.lines[0]', 'oneOf'), (14, '$.lines[2]', 'oneOf'), (15, '$.total', 'anyOf'), (16, '$.total', 'anyOf'), (17, '$.odd "name', 'additionalProperties'), (18, '$', 'json'))
SELECT o_orderkey, path, keyword FROM orders JOIN expected ON way = o_orderkey % 19""")


@_query
def x38_failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable codes of failure messages."""
    said = F.when(F.col("event_id") % 4 == 0, "HTTP 429 Too Many Requests").when(F.col("event_id") % 4 == 1, "please Sign in again").when(F.col("event_id") % 4 == 2, "Usage limit; rate limit").otherwise("other")
    return _table(spark, sf_dir, "events").select("event_id", T.failure_code(said).alias("code"))


_sql("x38_failure_codes", (), "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PROVIDER_RATE_LIMIT' WHEN 1 THEN 'PROVIDER_TOKEN_REVOKED' WHEN 2 THEN 'PROVIDER_USAGE_LIMIT' END AS code FROM events")


@_query
def x41_portable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as scanners' reports compare them; leading dots go too."""
    f = V.findings(spark, sf_dir)
    path = F.concat(F.lit("./.github/"), F.col("location.file"))
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), T.portable_path(path).alias("path"))


_sql("x41_portable_paths", ("findings",), """
SELECT ref, 'github/' || CASE file_form WHEN 0 THEN './' || file WHEN 1 THEN replace(file, '/', '//') ELSE file END AS path FROM findings""")


@_query
def x43_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which timestamps name their offset."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(ts, F.lit("Z"))).when(F.col("event_id") % 4 == 1, ts).when(F.col("event_id") % 4 == 2, F.concat(ts, F.lit("+07:00"))).otherwise("2024-13-01T00:00:00Z")
    return _table(spark, sf_dir, "events").select("event_id", T.is_zoned_time(said).alias("zoned"))


_sql("x43_timestamps", (), "SELECT event_id, event_id % 4 IN (0, 2) AS zoned FROM events")


@_query
def x44_hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories dealt to three parts by a stable hash."""
    e = V.entries(spark, sf_dir).select("repo_url").distinct()
    return e.select("repo_url", digits_mod3(stable_hash("seed", F.col("repo_url"))).alias("part"))


_sql("x44_hash_splits", ("entries",), """
SELECT repo AS repo_url, CAST(list_sum(list_transform(regexp_extract_all(sha256('seed' || chr(0) || repo), '[0-9a-f]'), lambda d: instr('0123456789abcdef', d) - 1)) % 3 AS INTEGER) AS part
FROM (SELECT DISTINCT repo FROM entries)""")


@_query
def x1_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of customers, its hash, and the key of a case."""
    c = _table(spark, sf_dir, "customer")
    named = c.select("c_custkey", "c_name", F.lit(None).cast("string").alias("none"), F.col("c_custkey").alias("key"))
    row = canonical(F.struct("none", "key", "c_name"), named.select("none", "key", "c_name").schema)
    return named.select("c_custkey", row.alias("json"), F.sha2(row, 256).alias("hash"), case_key(F.col("c_name")).alias("case_key"))


_sql("x1_canonical_json", (), """
SELECT c_custkey, j AS json, sha256(j) AS hash, substr(sha256(c_name), 1, 20) AS case_key FROM (SELECT *, '{"c_name":"' || c_name || '","key":' || c_custkey || ',"none":null}' AS j FROM customer)""")


# --- matching ---------------------------------------------------------------

_MATCH_SQL = f"""
fs AS (SELECT *, CASE WHEN cwe_no IS NULL THEN CAST([] AS INTEGER[]) ELSE [CAST(cwe_no AS INTEGER)] END AS fc FROM findings),
fk AS (SELECT *, {_families_sql('fc', _CATEGORY_KEY.format('category'))} AS ff FROM fs),
es AS (SELECT *, {_ENTRY_CWES} AS cw FROM entries WHERE verify = 1),
ek AS (SELECT *, {_E_FAMILIES} AS ef FROM es),
pairs AS (
  SELECT f.ref, e.entry_id, e.report_id, greatest(0, e.sink_start - f.end_line, f.start_line - e.sink_end) AS gap,
    CASE WHEN f.trace_file = e.source_file THEN greatest(0, e.source_line - f.trace_end, f.trace_line - e.source_line) END AS source_gap,
    list_has_any(f.fc, e.cw) OR list_has_any(f.ff, e.ef) AS agrees
  FROM fk f JOIN ek e ON f.repo = e.repo AND f.commit_sha = e.commit_sha AND f.file = e.file
  WHERE greatest(0, e.sink_start - f.end_line, f.start_line - e.sink_end) <= 5),
tiers AS (SELECT *, CASE WHEN gap = 0 AND coalesce(source_gap = 0, false) THEN 0 WHEN coalesce(source_gap <= 5, false) AND agrees THEN 1 ELSE 2 END AS tier FROM pairs),
best AS (SELECT *, min(tier) OVER (PARTITION BY ref) AS m FROM tiers)"""
_TIER = "CASE {} WHEN 0 THEN 'STRICT_SOURCE_SINK' WHEN 1 THEN 'STRONG_SOURCE_SINK' WHEN 2 THEN 'CANDIDATE_REVIEW' ELSE 'UNMATCHED' END"


@_query
def j1_tier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tier of each observation, with the entries that match at it."""
    m = matching.match_candidates(V.findings(spark, sf_dir), V.entries(spark, sf_dir))
    ids = F.transform("matches", lambda x: F.concat_ws("|", x["entry_id"], x["report_id"], x["source_supported_by_trace"].cast("string"), x["category_cwe_compatible"].cast("string")))
    return m.select("ref", "match_tier", F.array_join(ids, ",").alias("matches"))


_sql("j1_tier_match", ("findings", "entries"), f"""
SELECT f.ref, {_TIER.format('m')} AS match_tier, coalesce(ms, '') AS matches FROM findings f LEFT JOIN (
  SELECT ref, min(m) AS m, string_agg(entry_id || '|' || report_id || '|' || coalesce(source_gap <= 5, false) || '|' || agrees, ',' ORDER BY entry_id, report_id) AS ms
  FROM best WHERE tier = m GROUP BY ref) b ON b.ref = f.ref""", _MATCH_SQL)


@_query
def w1_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by best tier."""
    return matching.tier_counts(matching.match_candidates(V.findings(spark, sf_dir), V.entries(spark, sf_dir)))


_sql("w1_tier_counts", ("findings", "entries"), f"""
SELECT t AS match_tier, count(x) AS n FROM (SELECT unnest(['STRICT_SOURCE_SINK', 'STRONG_SOURCE_SINK', 'CANDIDATE_REVIEW', 'UNMATCHED']) AS t) LEFT JOIN (
  SELECT {_TIER.format('m')} AS x FROM findings f LEFT JOIN (SELECT ref, min(tier) AS m FROM tiers GROUP BY ref) b ON b.ref = f.ref) ON x = t GROUP BY t""", _MATCH_SQL)


@_query
def a6_canonical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best tiers and distinct matches of findings with one id."""
    m = matching.canonical_matches(matching.match_candidates(V.findings(spark, sf_dir), V.entries(spark, sf_dir)))
    ids = F.array_distinct(F.transform("matches", lambda x: x["entry_id"]))
    return m.select("canonical_finding_id", "match_tier", F.size("member_finding_ids").alias("members"), F.array_join(ids, ",").alias("entries"))


_sql("a6_canonical_matches", ("findings", "entries"), f"""
SELECT f.id AS canonical_finding_id, {_TIER.format('min(f.m)')} AS match_tier, 1 AS members, coalesce(string_agg(DISTINCT b.entry_id, ',' ORDER BY b.entry_id), '') AS entries
FROM (SELECT *, min(t) OVER (PARTITION BY id) AS m FROM ids) f LEFT JOIN best b ON b.ref = f.ref AND b.tier = b.m AND f.t = f.m AND b.tier = f.m GROUP BY f.id""",
     _MATCH_SQL + f", ids AS (SELECT x.ref, {_ID} AS id, coalesce(t.m, 3) AS t FROM findings x LEFT JOIN (SELECT ref, min(tier) AS m FROM tiers GROUP BY ref) t ON t.ref = x.ref)")


@_query
def j5_a11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and reports that findings cover."""
    f, e = V.findings(spark, sf_dir), V.entries(spark, sf_dir)
    return matching.coverage(e, f, matching.covering(matching.match_candidates(f, e, verified_only=False)))


_sql("j5_a11_coverage", ("findings", "entries"), """
SELECT e.entries, e.reports, m.me AS matched_entries, m.mr AS matched_reports, n.f - m.refs AS unmatched_findings, n.f AS findings, m.me / e.entries AS entry_recall, m.mr / e.reports AS report_recall
FROM (SELECT count(*) AS entries, count(DISTINCT report_id) AS reports FROM entries) e,
  (SELECT count(DISTINCT entry_id) AS me, count(DISTINCT report_id) AS mr, count(DISTINCT ref) AS refs FROM best WHERE tier = m AND tier < 2) m, (SELECT count(*) AS f FROM findings) n""",
     _MATCH_SQL.replace("WHERE verify = 1", ""))


@_query
def j4_two_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings given by two endpoints against the entries."""
    f = V.findings(spark, sf_dir)
    node = lambda file, line: F.struct(file.alias("file"), line.alias("line"), F.lit("").alias("code"))
    f = f.select(
        F.col("provenance.raw_result_ref").alias("finding_id"), "repo_url", "commit",
        node(F.col("location.file"), lines.line_text(F.col("location.start_line"), F.col("location.end_line"))).alias("critical_operation"),
        node(F.get("dataflow_trace", F.lit(0))["file"], F.get("dataflow_trace", F.lit(0))["line"]).alias("entry_point"),
    )
    return matching.two_endpoint_matches(f, V.entries(spark, sf_dir), 3)


_sql("j4_two_endpoints", ("findings", "entries"), """
SELECT f.ref AS finding_id, e.entry_id, e.report_id FROM findings f JOIN entries e ON f.repo = e.repo AND f.commit_sha = e.commit_sha AND f.file = e.file AND f.trace_file = e.source_file
WHERE greatest(0, e.sink_start - f.end_line, f.start_line - e.sink_end) <= 3 AND greatest(0, e.source_line - f.trace_end, f.trace_line - e.source_line) <= 3""")


# --- metrics ----------------------------------------------------------------

_COUNTERS = """count(*) FILTER (truth AND v = 'TRUE_POSITIVE') AS tp, count(*) FILTER (NOT truth AND v = 'TRUE_POSITIVE') AS fp,
  count(*) FILTER (NOT truth AND v = 'FALSE_POSITIVE') AS tn, count(*) FILTER (truth AND v = 'FALSE_POSITIVE') AS fn,
  count(*) FILTER (truth AND v = 'ABSTAIN') AS abstain_on_true, count(*) FILTER (NOT truth AND v = 'ABSTAIN') AS abstain_on_false,
  count(*) FILTER (truth AND v IS NULL) AS missing_on_true, count(*) FILTER (NOT truth AND v IS NULL) AS missing_on_false"""
_RATES = """tp, fp, tn, fn, abstain_on_true, abstain_on_false, missing_on_true, missing_on_false, tp + fp + tn + fn AS decided,
  tp + fp + tn + fn + abstain_on_true + abstain_on_false + missing_on_true + missing_on_false AS labeled_total,
  tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1,
  tn / nullif(tn + fp, 0) AS specificity, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy,
  tp / nullif(tp + fn + abstain_on_true + missing_on_true, 0) AS tp_retention, tn / nullif(tn + fp + abstain_on_false + missing_on_false, 0) AS fp_removal,
  (tp + fp + tn + fn) / nullif(tp + fp + tn + fn + abstain_on_true + abstain_on_false + missing_on_true + missing_on_false, 0) AS selective_coverage"""
_ERRORS = ", fp / nullif(fp + tn, 0) AS false_positive_rate, fn / nullif(fn + tp, 0) AS false_negative_rate"
_DECIDED = """p AS (SELECT finding_id, verdict, eligible FROM reviews WHERE doc % 11 <> 0),
d AS (SELECT g.*, p.verdict AS v, g.label IN ('TP_KNOWN', 'TP_NOVEL') AS truth FROM gold g LEFT JOIN p ON p.finding_id = g.finding_id
  WHERE g.label <> 'UNCERTAIN' AND coalesce(p.eligible, true))"""


@_query
def a7_a8_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against gold labels."""
    return metrics.classification(V.gold(spark, sf_dir), V.predictions(spark, sf_dir))


_sql("a7_a8_classification", ("gold", "reviews"), f"SELECT {_RATES} FROM (SELECT {_COUNTERS} FROM d)", _DECIDED)


@_query
def j9_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands outside the metrics, by kind."""
    return metrics.label_audit(V.gold(spark, sf_dir), V.predictions(spark, sf_dir))


_sql("j9_label_audit", ("gold", "reviews"), """
SELECT 'excluded_label' AS kind, label AS value, count(*) AS n FROM gold WHERE label = 'UNCERTAIN' GROUP BY 2
UNION ALL SELECT 'excluded_prediction', '', count(*) FROM p WHERE NOT eligible HAVING count(*) > 0
UNION ALL SELECT 'excluded_labeled_case', '', count(*) FROM p JOIN k USING (finding_id) WHERE NOT eligible HAVING count(*) > 0
UNION ALL SELECT 'missing_prediction', '', count(*) FROM k ANTI JOIN p USING (finding_id) HAVING count(*) > 0
UNION ALL SELECT 'extra_prediction', '', count(*) FROM p ANTI JOIN k USING (finding_id) WHERE eligible HAVING count(*) > 0""",
     "p AS (SELECT finding_id, eligible FROM reviews WHERE doc % 11 <> 0), k AS (SELECT finding_id FROM gold WHERE label <> 'UNCERTAIN')")


@_query
def a9_machine_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against machine labels, with error rates and the bounds of the true share."""
    return metrics.machine_reference(V.machine(spark, sf_dir), V.predictions(spark, sf_dir))


_sql("a9_machine_reference", ("gold", "reviews"), f"""
SELECT {_RATES}{_ERRORS}, records, t AS machine_true_positive, f AS machine_false_positive, u AS machine_uncertain, t / records AS tp_fraction_lower_bound, (t + u) / records AS tp_fraction_upper_bound
FROM (SELECT {_COUNTERS} FROM d), (SELECT count(*) AS records, count(*) FILTER (label LIKE 'TP%') AS t, count(*) FILTER (label = 'FP_CONFIRMED') AS f, count(*) FILTER (label = 'UNCERTAIN') AS u FROM gold)""", _DECIDED)


@_query
def a10_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rates by repository, rule, CWE, language and dataflow."""
    return metrics.by_dimension(V.machine(spark, sf_dir), V.predictions(spark, sf_dir))


_sql("a10_by_dimension", ("gold", "reviews"), f"SELECT dimension, key, {_RATES}{_ERRORS} FROM (SELECT dimension, key, {_COUNTERS} FROM x GROUP BY 1, 2)", _DECIDED + """,
x AS (SELECT 'repository' AS dimension, repository AS key, truth, v FROM d UNION ALL SELECT 'rule', rule_id, truth, v FROM d UNION ALL SELECT 'language', language, truth, v FROM d
  UNION ALL SELECT 'dataflow', CAST(has_dataflow AS VARCHAR), truth, v FROM d UNION ALL SELECT 'cwe', cwe_a, truth, v FROM d WHERE cwe_a IS NOT NULL
  UNION ALL SELECT 'cwe', cwe_b, truth, v FROM d WHERE cwe_b IS NOT NULL UNION ALL SELECT 'cwe', 'UNKNOWN', truth, v FROM d WHERE cwe_a IS NULL AND cwe_b IS NULL)""")


@_query
def a12_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two reviewers, rounded as sums may differ in their last digit."""
    a = metrics.agreement(V.reviewer(spark, sf_dir), V.reviewer(spark, sf_dir, True))
    return a.select("records", "agreements", *[F.round(c, 9).alias(c) for c in ("raw_agreement", "chance_expected_agreement", "cohen_kappa")])


_sql("a12_agreement", ("reviews",), """
SELECT n AS records, a AS agreements, round(a / n, 9) AS raw_agreement, round(e, 9) AS chance_expected_agreement, round((a / n - e) / (1 - e), 9) AS cohen_kappa FROM (
  SELECT count(*) AS n, count(*) FILTER (verdict = verdict_b) AS a,
    (count(*) FILTER (verdict = 'TRUE_POSITIVE') * count(*) FILTER (verdict_b = 'TRUE_POSITIVE') + count(*) FILTER (verdict = 'FALSE_POSITIVE') * count(*) FILTER (verdict_b = 'FALSE_POSITIVE')
     + count(*) FILTER (verdict = 'ABSTAIN') * count(*) FILTER (verdict_b = 'ABSTAIN')) / (count(*) * count(*)) AS e FROM reviews)""")


@_query
def a13_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by reviewer and by pair."""
    return metrics.verdict_counts(V.reviewer(spark, sf_dir), V.reviewer(spark, sf_dir, True))


_sql("a13_verdict_counts", ("reviews",), """
SELECT 'reviewer_a' AS side, verdict, count(*) AS n FROM reviews GROUP BY 2 UNION ALL SELECT 'reviewer_b', verdict_b, count(*) FROM reviews GROUP BY 2
UNION ALL SELECT 'pair', verdict || '|' || verdict_b, count(*) FROM reviews GROUP BY 2""")


# --- reviews ----------------------------------------------------------------

_SURE = "verdict = 'FALSE_POSITIVE' AND verdict_b = 'FALSE_POSITIVE' AND confidence = 'HIGH' AND confidence_b = 'HIGH' AND valid AND valid_b"
_ROUTED = f"""audited AS (
  SELECT finding_id FROM (SELECT finding_id, row_number() OVER (ORDER BY sha256('audit' || chr(0) || finding_id)) AS r, count(*) OVER () AS n FROM reviews WHERE {_SURE}) WHERE r <= greatest(1, ceil(n * 0.2))),
routed AS (SELECT *, array_to_string(list_filter([CASE WHEN verdict <> verdict_b THEN 'MODEL_DISAGREEMENT' END, CASE WHEN verdict = 'TRUE_POSITIVE' OR verdict_b = 'TRUE_POSITIVE' THEN 'ANY_TRUE_POSITIVE' END,
  CASE WHEN verdict = 'ABSTAIN' OR verdict_b = 'ABSTAIN' THEN 'ANY_ABSTAIN' END, CASE WHEN confidence <> 'HIGH' OR confidence_b <> 'HIGH' THEN 'ANY_NON_HIGH_CONFIDENCE' END,
  CASE WHEN NOT valid THEN 'REVIEWER_A_INVALID_EVIDENCE' END, CASE WHEN NOT valid_b THEN 'REVIEWER_B_INVALID_EVIDENCE' END,
  CASE WHEN finding_id IN (SELECT finding_id FROM audited) THEN 'DETERMINISTIC_CONSENSUS_FP_AUDIT' END], lambda x: x IS NOT NULL), ',') AS reasons FROM reviews)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.reconcile(V.reviewer(spark, sf_dir), V.reviewer(spark, sf_dir, True))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.flat(spark, sf_dir, "reviews")
    v = F.when(F.col("doc") % 7 == 0, "TRUE_POSITIVE").when(F.col("doc") % 7 == 1, "UNCERTAIN").otherwise("FALSE_POSITIVE")
    none = F.array().cast(reviews.EVIDENCE)
    return r.filter("doc % 23 <> 0").select(
        "finding_id", v.alias("verdict"), F.lit("MEDIUM").alias("confidence"), F.array().cast("array<string>").alias("reason_codes"),
        F.lit("c").alias("reasoning"), none.alias("evidence"), F.lit(None).cast("string").alias("uncertainty_reason"),
    )


@_query
def j11_c7_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which findings go to the adjudicator, and why."""
    return _reconciled(spark, sf_dir).select("finding_id", "routed", F.array_join("route_reasons", ",").alias("route_reasons"))


_sql("j11_c7_routing", ("reviews",), "SELECT finding_id, coalesce(reasons, '') <> '' AS routed, coalesce(reasons, '') AS route_reasons FROM routed", _ROUTED)


@_query
def a13_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by route reason."""
    return reviews.route_counts(_reconciled(spark, sf_dir))


_sql("a13_route_counts", ("reviews",), "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN coalesce(reasons, '') = '' THEN ['NOT_ROUTED'] ELSE string_split(reasons, ',') END) AS reason FROM routed) GROUP BY 1", _ROUTED)


@_query
def c8_machine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from decisions and consensus."""
    la = reviews.labels(_reconciled(spark, sf_dir), _decisions(spark, sf_dir), "2026-01-01T00:00:00Z")
    return la.select("finding_id", "label", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"), F.size("evidence").alias("evidence"), "reviewer_role", "blind_first")


_sql("c8_machine_labels", ("reviews",), """
SELECT finding_id, CASE WHEN NOT r THEN 'MACHINE_FALSE_POSITIVE' WHEN doc % 23 = 0 THEN NULL WHEN doc % 7 = 0 THEN 'MACHINE_TRUE_POSITIVE' WHEN doc % 7 = 1 THEN 'MACHINE_UNCERTAIN' ELSE 'MACHINE_FALSE_POSITIVE' END AS label,
  CASE WHEN NOT r THEN 'HIGH' WHEN doc % 23 = 0 THEN NULL ELSE 'MEDIUM' END AS confidence,
  CASE WHEN r AND doc % 23 = 0 THEN NULL WHEN r THEN '' WHEN doc % 2 = 0 THEN 'CONSTANT_VALUE' ELSE 'CONSTANT_VALUE,SAFE_API_USAGE' END AS reason_codes,
  CASE WHEN r AND doc % 23 = 0 THEN NULL WHEN r THEN 0 ELSE 1 END AS evidence, CASE WHEN r THEN 'ADJUDICATOR_C' ELSE 'CONSENSUS_A_B' END AS reviewer_role, r AS blind_first
FROM (SELECT *, coalesce(reasons, '') <> '' AS r FROM routed)""", _ROUTED)


@_query
def a14_audit_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many audited consensus findings were not confirmed."""
    r = _reconciled(spark, sf_dir)
    return reviews.audit_outcome(r, reviews.labels(r, _decisions(spark, sf_dir), "2026-01-01T00:00:00Z"))


_sql("a14_audit_outcome", ("reviews",), """
SELECT count(*) AS audited, count(*) FILTER (doc % 23 <> 0 AND doc % 7 < 2) AS not_confirmed, count(*) FILTER (doc % 23 <> 0 AND doc % 7 < 2) / count(*) AS not_confirmed_rate,
  count(*) FILTER (doc % 23 <> 0 AND doc % 7 < 2) / count(*) > 0.1 AS expand_audit FROM routed WHERE finding_id IN (SELECT finding_id FROM audited)""", _ROUTED)


@_query
def p9_j12_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicator's input: each routed case with its own finding, and opinions in an order that a hash decides."""
    r = _reconciled(spark, sf_dir)
    third = _decisions(spark, sf_dir).select("finding_id", "verdict", "confidence")
    number = F.regexp_extract("provenance.raw_result_ref", r"^raw/(\d+)-", 1)
    f = V.findings(spark, sf_dir).withColumns({"finding_id": F.concat(F.lit("finding-"), number), "ref": F.col("provenance.raw_result_ref")})
    q = reviews.adjudication_input(r, third, findings.latest_by(f, ["finding_id"], "ref").drop("ref"))
    return q.select(
        "finding_id", F.col("finding.provenance.raw_result_ref").alias("ref"), F.col("opinions")[0]["reasoning"].alias("first"), F.col("opinions")[1]["reasoning"].alias("second"),
        F.col("blind_opinion.verdict").alias("third"), F.size("opinions.evidence").alias("opinions"),
    )


_sql("p9_j12_adjudication", ("reviews", "findings"), """
SELECT finding_id, ref, CASE WHEN odd THEN 'b' ELSE 'a' END || doc AS first, CASE WHEN odd THEN 'a' ELSE 'b' END || doc AS second,
  CASE WHEN doc % 7 = 0 THEN 'TRUE_POSITIVE' WHEN doc % 7 = 1 THEN 'UNCERTAIN' ELSE 'FALSE_POSITIVE' END AS third, 2 AS opinions
FROM (SELECT *, instr('13579bdf', substr(sha256(finding_id), 2, 1)) > 0 AS odd FROM routed WHERE coalesce(reasons, '') <> '' AND doc % 23 <> 0)
JOIN (SELECT 'finding-' || regexp_extract(ref, '^raw/(\\d+)-', 1) AS finding_id, max(ref) AS ref FROM findings GROUP BY 1) USING (finding_id)""", _ROUTED)


@_query
def p5_blind_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as blind reviewers see them."""
    b = reviews.for_model(reviews.blind(V.findings(spark, sf_dir)), message=8, mark="..")
    return b.select(F.col("provenance.raw_result_ref").alias("ref"), F.col("scanner.name").alias("scanner"), "message", F.size("dataflow_trace").alias("nodes"), "omitted_trace_nodes")


_sql("p5_blind_projection", ("findings",), """
SELECT ref, CASE WHEN scanner = 'opengrep' THEN 'other' ELSE scanner END AS scanner, 'messag..' AS message, CASE WHEN trace_file IS NULL THEN 0 ELSE 1 END AS nodes, 0 AS omitted_trace_nodes FROM findings""")


@_query
def j18_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's verdicts with a retry's in the place of those it repeats, and no work left."""
    a, b = V.reviewer(spark, sf_dir).select("finding_id", "verdict"), V.reviewer(spark, sf_dir, True).select("finding_id", "verdict").filter("verdict <> 'ABSTAIN'")
    return reviews.overlay(a, b)


_sql("j18_overlay", ("reviews",), "SELECT finding_id, CASE WHEN verdict_b <> 'ABSTAIN' THEN verdict_b ELSE verdict END AS verdict FROM reviews")


@_query
def c6_composite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case the last run that finished it, reused or new."""
    r = V.flat(spark, sf_dir, "reviews")
    k = F.col("doc") % 10
    run = lambda name, rows, failed: (name, rows.select("finding_id", F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"), F.lit(name).alias("said")))
    c = reviews.composite([run("base", r, k < 4), run("supplement", r.filter(k < 5), k < 2), run("last", r.filter(k < 2), k == 0)])
    return c.select("finding_id", "run", "said", "reused")


_sql("c6_composite_run", ("reviews",), """
SELECT finding_id, CASE WHEN k = 1 THEN 'last' WHEN k < 5 THEN 'supplement' ELSE 'base' END AS run, CASE WHEN k = 1 THEN 'last' WHEN k < 5 THEN 'supplement' ELSE 'base' END AS said, k <> 1 AS reused
FROM (SELECT *, doc % 10 AS k FROM reviews) WHERE k > 0""")


@_query
def p19_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that no success covers yet."""
    r = V.flat(spark, sf_dir, "reviews")
    done = r.select("finding_id", F.when(F.col("doc") % 3 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return reviews.pending(r.select("finding_id"), done)


_sql("p19_pending", ("reviews",), "SELECT finding_id FROM reviews WHERE doc % 3 = 0")


# --- samples and orders -----------------------------------------------------


@_query
def o3_seeded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in a seeded order."""
    return sampling.with_position(V.flat(spark, sf_dir, "reviews").select("finding_id"), "seed")


_sql("o3_seeded_positions", ("reviews",), "SELECT finding_id, row_number() OVER (ORDER BY sha256('seed' || chr(0) || finding_id)) - 1 AS position FROM reviews")


@_query
def o4_bottom_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of a seeded order."""
    return sampling.bottom_share(V.flat(spark, sf_dir, "reviews").select("finding_id"), 0.1, "seed")


_sql("o4_bottom_share", ("reviews",), "SELECT finding_id FROM (SELECT finding_id, row_number() OVER (ORDER BY sha256('seed' || chr(0) || finding_id)) AS r, count(*) OVER () AS n FROM reviews) WHERE r <= greatest(1, ceil(n * 0.1))")


@_query
def o5_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents at equal steps of a seeded order, with their weight."""
    return sampling.systematic(V.flat(spark, sf_dir, "reviews").select("finding_id"), 60, "seed")


_sql("o5_systematic_sample", ("reviews",), """
SELECT finding_id, n / 60 AS sample_weight FROM (SELECT finding_id, row_number() OVER (ORDER BY sha256('seed' || chr(0) || finding_id)) - 1 AS p, count(*) OVER () AS n FROM reviews)
WHERE floor((p + 1) * 60 / n) > floor(p * 60 / n)""")


# --- ground truth -----------------------------------------------------------


@_query
def a15_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with their projects, reports and entries."""
    s = audit.snapshots(V.entries(spark, sf_dir))
    return s.select("repo_url", "commit", F.array_join("projects", ",").alias("projects"), F.array_join("report_ids", ",").alias("report_ids"), F.array_join("entry_ids", ",").alias("entry_ids"), "num_reports", "num_entries")


_sql("a15_snapshots", ("entries",), """
SELECT repo AS repo_url, commit_sha AS commit, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, string_agg(DISTINCT report_id, ',' ORDER BY report_id) AS report_ids,
  string_agg(entry_id, ',' ORDER BY entry_id) AS entry_ids, CAST(count(DISTINCT report_id) AS INTEGER) AS num_reports, CAST(count(*) AS INTEGER) AS num_entries FROM entries GROUP BY repo, commit_sha""")


@_query
def a16_benchmark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of entries and reports."""
    return audit.statistics(V.entries(spark, sf_dir), V.reports(spark, sf_dir))


_REPORTS = "rp AS (SELECT report_id, count(*) AS n, CAST(regexp_extract(report_id, '(\\d+)$', 1) AS BIGINT) AS k FROM entries GROUP BY report_id)"
_sql("a16_benchmark_statistics", ("entries",), """
SELECT (SELECT count(*) FROM rp WHERE k % 19 <> 0) AS reports, count(*) AS entries, count(*) FILTER (verify = 1) AS verified_entries, count(*) FILTER (verify = 0) AS unverified_entries,
  count(DISTINCT repo) AS distinct_repositories, count(DISTINCT project) AS distinct_projects, count(DISTINCT repo || commit_sha) AS distinct_snapshots,
  count(*) FILTER (sink_start <> sink_end) AS entries_with_line_ranges FROM entries""", _REPORTS)


@_query
def a16_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by category of their entries."""
    return audit.by_category(V.entries(spark, sf_dir))


_sql("a16_by_category", ("entries",), "SELECT l1 AS vuln_category_l1, count(DISTINCT report_id) AS reports FROM entries GROUP BY 1")


@_query
def a16_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by repository."""
    return audit.by_repository(V.entries(spark, sf_dir))


_sql("a16_by_repository", ("entries",), "SELECT repo AS repo_url, count(*) AS entries FROM entries GROUP BY 1")


@_query
def j16_v8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with entries and reports."""
    return audit.violations(V.entries(spark, sf_dir), V.reports(spark, sf_dir))


_sql("j16_v8_audit", ("entries",), """
SELECT 'UNKNOWN_REPORT' AS rule_id, entry_id AS key, report_id AS detail FROM entries JOIN rp USING (report_id) WHERE k % 19 = 0
UNION ALL SELECT 'REPORT_COUNT', report_id, '' || n FROM rp WHERE k % 19 <> 0 AND k % 17 = 0""", _REPORTS)


# --- scan ledger ------------------------------------------------------------

_JOBS = """att AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, scanner ORDER BY event_id) AS attempt FROM attempts),
jobs AS (SELECT repo AS repo_url, commit_sha AS commit, scanner, count(*) AS attempts, count(*) FILTER (status = 'TIMEOUT') AS timeouts,
  max_by(status, attempt) AS status, last(error_type ORDER BY attempt) AS error_type FROM att GROUP BY 1, 2, 3),
js AS (SELECT *, status = 'SUCCESS' OR (status = 'SKIPPED' AND coalesce(error_type = 'NoApplicableRuleConfig', false)) AS done FROM jobs)"""
_SCANNERS = ["click", "error", "view"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.job_states(V.attempts(spark, sf_dir))


@_query
def a22_d3_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last statuses, timeouts and quarantine of scan jobs."""
    return _jobs(spark, sf_dir).drop("duration_seconds")


_sql("a22_d3_job_states", ("attempts",), "SELECT repo_url, commit, scanner, attempts, timeouts, status, error_type, CASE WHEN NOT done AND timeouts >= 2 THEN 'QUARANTINED' ELSE status END AS state FROM js", _JOBS)


@_query
def d4_orphaned_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states when only one scan is still alive."""
    return ledger.job_states(V.attempts(spark, sf_dir), 3, ["scan-1"]).select("repo_url", "commit", "scanner", "status", "state")


_sql("d4_orphaned_attempts", ("attempts",), """
SELECT repo_url, commit, scanner, CASE WHEN o THEN 'INTERRUPTED' ELSE status END AS status, CASE WHEN NOT done AND timeouts >= 3 THEN 'QUARANTINED' WHEN o THEN 'INTERRUPTED' ELSE status END AS state
FROM (SELECT js.*, js.status = 'RUNNING' AND l.scan_id <> 'scan-1' AS o FROM js JOIN (SELECT repo, commit_sha, scanner, max_by(scan_id, attempt) AS scan_id FROM att GROUP BY 1, 2, 3) l
  ON l.repo = js.repo_url AND l.commit_sha = js.commit AND l.scanner = js.scanner)""", _JOBS)


@_query
def o6_job_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs come first."""
    return ledger.priorities(_jobs(spark, sf_dir))


_sql("o6_job_priorities", ("attempts",), """
SELECT repo_url, commit, scanner, CASE WHEN done THEN 4 WHEN timeouts >= 2 THEN 3 WHEN status IN ('FAILED', 'INTERRUPTED') THEN 1 WHEN status = 'TIMEOUT' THEN 2 WHEN status = 'RUNNING' THEN 3 ELSE 1 END AS priority FROM js""", _JOBS)


def _coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.attempts(spark, sf_dir)
    snapshots = a.select("repo_url", "commit").distinct().filter(F.col("commit") > "2")
    jobs = _jobs(spark, sf_dir).filter(~((F.col("scanner") == "view") & (F.col("commit") < "5")))
    return ledger.coverage_rows(jobs, snapshots, _SCANNERS)


_COVERAGE = _JOBS + """, sn AS (SELECT DISTINCT repo_url, commit FROM js WHERE commit > '2'),
ex AS (SELECT repo_url, commit, unnest(['click', 'error', 'view']) AS scanner FROM sn),
cov AS (SELECT coalesce(j.repo_url, ex.repo_url) AS repo_url, coalesce(j.commit, ex.commit) AS commit, coalesce(j.scanner, ex.scanner) AS scanner, j.status, j.error_type,
  CASE WHEN j.status IS NULL THEN 'MISSING' WHEN j.scanner NOT IN ('click', 'error', 'view') THEN 'IGNORED' WHEN ex.scanner IS NULL THEN 'UNEXPECTED' WHEN done THEN 'OK' ELSE 'BLOCKING' END AS verdict,
  CASE WHEN timeouts >= 2 THEN 'QUARANTINED_TIMEOUT' ELSE j.status END AS b
  FROM (SELECT * FROM js WHERE NOT (scanner = 'view' AND commit < '5')) j FULL JOIN ex ON j.repo_url = ex.repo_url AND j.commit = ex.commit AND j.scanner = ex.scanner)"""


@_query
def j14_coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each expected or found job counts."""
    return _coverage_rows(spark, sf_dir)


_sql("j14_coverage_rows", ("attempts",), "SELECT repo_url, commit, scanner, status, error_type, verdict, CASE WHEN verdict = 'BLOCKING' THEN b END AS blocking FROM cov", _COVERAGE)


@_query
def j14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the scan is complete."""
    return ledger.coverage(_coverage_rows(spark, sf_dir))


_sql("j14_coverage", ("attempts",), """
SELECT count(*) FILTER (verdict IN ('MISSING', 'OK', 'BLOCKING')) AS jobs_expected, count(*) FILTER (verdict IN ('OK', 'BLOCKING')) AS jobs_accounted, count(*) FILTER (verdict = 'MISSING') AS missing,
  count(*) FILTER (verdict = 'UNEXPECTED') AS unexpected, count(*) FILTER (verdict = 'IGNORED') AS ignored, count(*) FILTER (verdict = 'BLOCKING') AS blocking,
  count(*) FILTER (verdict IN ('MISSING', 'UNEXPECTED', 'BLOCKING')) = 0 AS complete FROM cov""", _COVERAGE)


@_query
def a19_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of expected and of blocking jobs."""
    return ledger.status_counts(_coverage_rows(spark, sf_dir))


_sql("a19_status_counts", ("attempts",), """
SELECT 'status' AS kind, status, count(*) AS n FROM cov WHERE verdict IN ('OK', 'BLOCKING') GROUP BY 2 UNION ALL SELECT 'blocking', b, count(*) FROM cov WHERE verdict = 'BLOCKING' GROUP BY 2""", _COVERAGE)


@_query
def a29_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's progress."""
    return ledger.progress(_jobs(spark, sf_dir), 1000)


_sql("a29_progress", ("attempts",), """
SELECT count(*) AS jobs, count(*) FILTER (done) AS done, count(*) FILTER (NOT done AND timeouts >= 2) AS quarantined, count(*) FILTER (status IN ('FAILED', 'INTERRUPTED') AND timeouts < 2) AS failed,
  CAST(sum(attempts) AS BIGINT) AS attempts, 100.0::DOUBLE * count(*) FILTER (done) / 1000 AS percent FROM js""", _JOBS)


def _reports_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw errors and scanned paths of successful jobs, made of their events in order.

    An error is known by its number in its report, which several steps make anew.
    """
    a = V.flat(spark, sf_dir, "attempts")
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_id") % 3 == 0, '["PartialParsing","x"]').otherwise('"Timeout"')
    error = F.concat(F.lit('{"type":'), kind, F.lit(',"path":"./src\\\\m'), k, F.lit('.py","level":"warn"}'))
    in_order = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("event_id", value.alias("value"))))), lambda x: x["value"])
    return a.groupBy(F.col("repo").alias("repo_url"), F.lit("c").alias("commit"), "scanner").agg(
        in_order(F.col("event_id") % 5 == 0, error).alias("errors"), in_order(F.col("event_id") % 5 != 0, F.concat(F.lit("src/M"), k, F.lit(".py"))).alias("scanned")
    )


_ERRS = """ev AS (SELECT repo AS repo_url, 'c' AS commit, scanner, event_id, 'src/m' || (props::JSON ->> '$.k') || '.py' AS file FROM attempts),
er AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'PartialParsing' ELSE 'Timeout' END AS t FROM ev WHERE event_id % 5 = 0),
jb AS (SELECT DISTINCT repo_url, scanner, (length(scanner) % 4 = 3) AS failed FROM ev)"""


def _error_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _reports_of_jobs(spark, sf_dir)
    errors = ledger.errors_of(r)
    scanned = r.select(*ledger.JOB, F.explode("scanned").alias("path"))
    jobs = r.select(*ledger.JOB, F.when(F.length("scanner") % 4 == 3, "FAILED").otherwise("SUCCESS").alias("status"))
    return errors, ledger.alternate_engines(errors, scanned, jobs)


_ALTERNATES = _ERRS + """, alt AS (SELECT er.repo_url, er.commit, er.scanner, er.event_id, er.file, o.scanner AS other,
  CASE WHEN j.repo_url IS NULL THEN 'MISSING' WHEN j.failed THEN 'FAILED' WHEN p.k > 0 THEN 'PARTIAL' WHEN p.k = 0 THEN 'FILE_ERROR:Timeout' WHEN s.file IS NOT NULL THEN 'SCANNED_CLEAN' ELSE 'NOT_SCANNED' END AS file_status
  FROM er JOIN (SELECT DISTINCT scanner FROM jb) o ON o.scanner <> er.scanner LEFT JOIN jb j ON j.repo_url = er.repo_url AND j.scanner = o.scanner
  LEFT JOIN (SELECT repo_url, scanner, file, count(*) FILTER (t = 'PartialParsing') AS k FROM er GROUP BY 1, 2, 3) p ON p.repo_url = er.repo_url AND p.scanner = o.scanner AND p.file = er.file
  LEFT JOIN (SELECT DISTINCT repo_url, scanner, file FROM ev WHERE event_id % 5 <> 0) s ON s.repo_url = er.repo_url AND s.scanner = o.scanner AND s.file = er.file WHERE er.t = 'PartialParsing')"""


@_query
def j15_alternate_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other scanners made of partly parsed files."""
    return _error_rows(spark, sf_dir)[1].drop("error_index", "path")


_sql("j15_alternate_engines", ("attempts",), "SELECT repo_url, commit, scanner, file, other, file_status FROM alt", _ALTERNATES)


@_query
def a20_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of errors inside reports."""
    return ledger.error_summary(*_error_rows(spark, sf_dir))


_sql("a20_error_summary", ("attempts",), """
SELECT count(*) AS observations, count(DISTINCT repo_url || scanner) AS jobs_with_errors, count(*) FILTER (t = 'PartialParsing') AS partial_parsing_observations,
  count(DISTINCT repo_url || scanner || file) FILTER (t = 'PartialParsing') AS partial_parsing_engine_files, count(DISTINCT repo_url || file) FILTER (t = 'PartialParsing') AS partial_parsing_files,
  (SELECT count(DISTINCT repo_url || file) FROM (SELECT event_id, repo_url, file FROM alt GROUP BY 1, 2, 3 HAVING count(*) FILTER (file_status = 'SCANNED_CLEAN') = 0)) AS unresolved_partial_files FROM er""", _ALTERNATES)


@_query
def a20_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by scanner and type."""
    return ledger.error_counts(_error_rows(spark, sf_dir)[0])


_sql("a20_error_counts", ("attempts",), "SELECT 'scanner' AS dimension, scanner AS value, count(*) AS n FROM er GROUP BY 2 UNION ALL SELECT 'type', t, count(*) FROM er GROUP BY 2", _ERRS)


@_query
def v18_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns on which one scan's attempts differ."""
    return ledger.provenance_violations(V.attempts(spark, sf_dir), "repo_url", "scan_id")


_sql("v18_provenance", ("attempts",), "SELECT 'MIXED_PROVENANCE' AS rule_id, scan_id || ' ' || scanner AS key, 'repo_url=' || count(DISTINCT repo) AS detail FROM attempts GROUP BY scan_id, scanner HAVING count(DISTINCT repo) > 1")


# --- usage ------------------------------------------------------------------


@_query
def a23_session_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last cumulative counters of sessions, summed by role."""
    c = _table(spark, sf_dir, "conversations")
    events = c.select(
        "role", F.concat(F.lit("file-"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").cast("int").alias("line"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("t"), (F.col("conv_id") % 50).cast("string"))).alias("thread_id"),
        F.create_map(F.lit("tokens"), F.length("text").cast("long"), F.lit("turns"), F.lit(1).cast("long")).alias("usage"),
    )
    return usage.totals(usage.by_session(events.filter("line is not null"), ["role"]), ["role"])


_sql("a23_session_usage", (), """
WITH e AS (SELECT role, 'file-' || conv_id AS file, CAST(turn AS INTEGER) AS line, CASE WHEN turn % 4 = 1 THEN 't' || (conv_id % 50) END AS th, length(text) AS n FROM conversations),
s AS (SELECT role, file, line, n, coalesce(last_value(th IGNORE NULLS) OVER (PARTITION BY role, file ORDER BY line), file) AS session FROM e),
l AS (SELECT role, session, max_by(n, (file, line)) AS n FROM s GROUP BY 1, 2)
SELECT role, 'tokens' AS counter, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1 UNION ALL SELECT role, 'turns', count(*) FROM l GROUP BY 1""")


@_query
def x46_usage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of several providers under common names."""
    k = F.col("doc_id")
    raw = F.when(k % 2 == 0, F.create_map(F.lit("prompt_tokens"), k, F.lit("completionTokens"), k, F.lit("totalTokenCount"), k + 2)).otherwise(
        F.create_map(F.lit("inputTokens"), k + 1, F.lit("output_tokens_details.reasoning_tokens"), k + 3, F.lit("candidatesTokenCount"), -k)
    )
    return usage.totals(_table(spark, sf_dir, "documents").select("doc_id", usage.normalized(raw).alias("usage")), ["doc_id"])


_sql("x46_usage_names", (), """
SELECT doc_id, 'input_tokens' AS counter, doc_id + doc_id % 2 AS n FROM documents UNION ALL SELECT doc_id, 'total_tokens', doc_id + 2 FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'reasoning_output_tokens', doc_id + 3 FROM documents WHERE doc_id % 2 = 1""")


@_query
def a25_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by status."""
    return usage.case_counts(V.flat(spark, sf_dir, "attempts"), 1_000_000)


_sql("a25_case_counts", ("attempts",), """
SELECT count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'INTERRUPTED') AS interrupted, count(*) FILTER (status = 'RUNNING') AS running,
  count(*) AS started, 1000000 - count(*) AS pending FROM attempts""")


@_query
def v28_event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns do not open, close and end."""
    c = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == 0, "thread.started").when(F.col("role") == "user", "turn.started").otherwise("turn.completed")
    return usage.event_violations(c.select("conv_id", F.col("turn").alias("line"), kind.alias("type")), ["conv_id"])


_sql("v28_event_logs", (), """
SELECT unnest(list_filter([CASE WHEN threads <> 1 THEN 'THREADS' END, CASE WHEN first <> 'thread.started' THEN 'FIRST_EVENT' END, CASE WHEN opened <> closed THEN 'OPEN_TURN' END,
    CASE WHEN last <> 'turn.completed' THEN 'LAST_EVENT' END], lambda x: x IS NOT NULL)) AS rule_id, '' || conv_id AS key, last AS detail
FROM (SELECT conv_id, count(*) FILTER (t = 'thread.started') AS threads, count(*) FILTER (t = 'turn.started') AS opened, count(*) FILTER (t = 'turn.completed') AS closed, arg_min(t, (turn, t)) AS first, arg_max(t, (turn, t)) AS last
  FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'thread.started' WHEN role = 'user' THEN 'turn.started' ELSE 'turn.completed' END AS t FROM conversations) GROUP BY conv_id)""")


# --- source text ------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.lines_of(_table(spark, sf_dir, "documents").filter("text is not null"), ["doc_id"])


@_query
def s20_line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 3 of each document, numbered."""
    wanted = _table(spark, sf_dir, "documents").select("doc_id", F.lit(2).alias("start"), F.lit(3).alias("end")).distinct()
    return code.slices(wanted, _lines(spark, sf_dir), ["doc_id"], numbered=True).select("doc_id", "slice")


_sql("s20_line_slices", (), """
WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM documents),
e AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM d)
SELECT doc_id, CASE WHEN len(a) >= 3 THEN '2: ' || a[2] || chr(10) || '3: ' || a[3] WHEN len(a) = 2 THEN '2: ' || a[2] END AS slice FROM e""")


@_query
def s27_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty lines that hold a word."""
    ls = _lines(spark, sf_dir).withColumnRenamed("doc_id", "file")
    return code.search(ls, "THE", case_sensitive=False).select("file", "n", "truncated")


_sql("s27_search", (), """
WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS n FROM documents),
h AS (SELECT doc_id AS file, CAST(n AS INTEGER) AS n FROM d WHERE contains(lower(t), 'the'))
SELECT file, n, (SELECT count(*) FROM h) > 40 AS truncated FROM h ORDER BY file, n LIMIT 40""")


@_query
def s28_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred names below a folder of pages."""
    p = _table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file"))
    hosts = p.select(F.concat(F.lit("root/"), F.regexp_extract("file", "^[^?#]*", 0)).alias("file"))
    return code.children(hosts, "root")


_sql("s28_children", (), """
WITH p AS (SELECT regexp_extract(regexp_replace(url, '^https?://', ''), '^[^?#]*') AS f FROM pages WHERE url IS NOT NULL)
SELECT DISTINCT string_split(f, '/')[1] AS name, contains(f, '/') AS is_folder FROM p ORDER BY lower(name), name LIMIT 100""")


@_query
def s18_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language, excluded folders left out."""
    f = V.findings(spark, sf_dir).select(F.regexp_replace("location.file", r"\.py$", F.when(F.col("location.start_line") % 2 == 0, ".go").otherwise(".py")).alias("file")).distinct()
    f = f.withColumn("file", T.normalize_path(F.col("file"))).distinct()
    found = code.detect_languages(f, {"python": [".py"], "go": [".go"]}, ["**/m4*"])
    return found.groupBy("language").agg(F.count_distinct("file").alias("files"))


_sql("s18_languages", ("findings",), """
SELECT CASE WHEN start_line % 2 = 0 THEN 'go' ELSE 'python' END AS language, count(DISTINCT file) AS files FROM findings WHERE NOT starts_with(file, 'src/m4') GROUP BY 1""")


def _rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML rule files made of parts: two rules each, some of them security."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    category = lambda n: F.when((k % 3 == 0) | ((k % 7 == 0) & (n > 0)), "Security").otherwise("style")
    rule = lambda n: F.concat(F.lit("  - id: 'rule-"), ((k + n) % 900).cast("string"), F.lit("'\n    metadata:\n      category: "), category(n), F.lit("\n"))
    name = F.concat(F.lit("lang"), (k % 5).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 50 == 7, ".test.yaml").otherwise(".yaml"))
    return p.select(name.alias("file"), F.concat(F.lit("rules:\n"), rule(0), rule(3)).alias("text"))


_RULES = "rf AS (SELECT p_partkey AS k, 'lang' || (p_partkey % 5) || '/f' || p_partkey || '.yaml' AS file FROM part WHERE p_partkey % 50 <> 7), ri AS (SELECT file, 2 AS line, 'rule-' || (k % 900) AS rule_id FROM rf UNION ALL SELECT file, 5, 'rule-' || ((k + 3) % 900) FROM rf)"


@_query
def s16_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ids of YAML files with their lines."""
    return code.rule_ids(_rule_files(spark, sf_dir))


_sql("s16_rule_ids", (), "SELECT file, line, rule_id FROM ri", _RULES)


@_query
def a17_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rules."""
    return rules.inventory(code.rule_ids(_rule_files(spark, sf_dir)))


_sql("a17_inventory", (), """
SELECT (SELECT count(DISTINCT file) FROM ri) AS config_files, CAST(sum(n) AS BIGINT) AS rule_id_occurrences, count(*) AS unique_rule_ids, count(*) FILTER (n > 1) AS duplicate_rule_ids
FROM (SELECT rule_id, count(*) AS n FROM ri GROUP BY 1)""", _RULES)


@_query
def a17_duplicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that stand in more than one place."""
    d = rules.duplicate_rules(code.rule_ids(_rule_files(spark, sf_dir)))
    return d.select("rule_id", F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["file"], o["line"].cast("string"))), ",").alias("places"))


_sql("a17_duplicate_rules", (), "SELECT rule_id, string_agg(file || ':' || line, ',' ORDER BY file, line) AS places FROM ri GROUP BY 1 HAVING count(*) > 1", _RULES)


@_query
def a18_security_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files whose rules are all security, by folder."""
    return rules.selection_counts(rules.security_files(code.rule_categories(_rule_files(spark, sf_dir))))


_sql("a18_security_rules", (), "SELECT 'lang' || (k % 5) AS folder, count(*) FILTER (k % 3 = 0) AS selected, count(*) FILTER (k % 3 <> 0 AND k % 7 <> 0) AS skipped, count(*) FILTER (k % 3 <> 0 AND k % 7 = 0) AS mixed FROM rf GROUP BY 1", _RULES)


def _rule_texts(k: Column) -> Column:
    """Rule files in seven styles by their number, the last two broken."""
    n = k.cast("string")
    text = lambda *parts: F.concat(*[n if p is None else F.lit(p) for p in parts])
    styles = [
        text("rules: [{id: r", None, ", metadata: {category: Security, tags: [a, {b: c}]}}, {id: s", None, "}]\n"),
        text("# head\n---\nrules:\n- id: \"r", None, "\"  # note\n  metadata: {'category': 'it''s: # one'}\n---\nrules:\n  -   metadata:\n        category: two\n      id: s", None, "\n...\n"),
        text("base: &base\n  category: security\n  level: 1\nrules:\n- id: r", None, "\n  metadata: *base\n- id: s", None, "\n  metadata:\n    <<: *base\n    category: own\n"),
        text("rules:\n- id: r", None, "\n  message: |\n    id: no\n    metadata:\n      category: no\n  metadata:\n    category: >-\n      two\n      lines\n- {id: s", None, ", metadata: [category, x]}\n"),
        text("rules:\n- metadata: {category: x}\n- id: s", None, "\n  metadata:\n    category: yes\n- words\n"),
        text("rules:\n- id: r", None, "\n  metadata: {category: x\n"),
        text("rules:\n  - id: r", None, "\n\tmetadata: x\n"),
    ]
    return F.element_at(F.array(*styles), (k % 7 + 1).cast("int"))


@_query
def s17_yaml_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and problems of YAML files with flow and block styles, anchors, merges and several documents."""
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("r/f"), F.col("p_partkey").cast("string"), F.lit(".yml")).alias("file"), _rule_texts(F.col("p_partkey")).alias("text"))
    r = code.read_rules(p)
    return r.select("file", "document", "position", "rule_id", "category", F.substring_index("problem", ":", 1).alias("problem"))


_sql("s17_yaml_rules", (), """
SELECT 'r/f' || p_partkey || '.yml' AS file, CAST(document AS INTEGER) AS document, CAST(position AS INTEGER) AS position, letter || p_partkey AS rule_id, category, problem
FROM part JOIN (VALUES (0, 0, 0, 'r', 'Security', NULL), (0, 0, 1, 's', NULL, NULL), (1, 0, 0, 'r', 'it''s: # one', NULL), (1, 1, 0, 's', 'two', NULL),
  (2, 0, 0, 'r', 'security', NULL), (2, 0, 1, 's', 'own', NULL), (3, 0, 0, 'r', 'two lines', NULL), (3, 0, 1, 's', NULL, NULL),
  (4, 0, 0, NULL, 'x', 'NO_RULE_ID'), (4, 0, 1, 's', 'True', NULL), (5, 0, 0, NULL, NULL, 'NOT_YAML'), (6, 0, 0, NULL, NULL, 'NOT_YAML')) v(style, document, position, letter, category, problem)
ON p_partkey % 7 = style""")


@_query
def j17_rule_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule folders for the languages of the documents' sources."""
    d = _table(spark, sf_dir, "documents").select("source", F.col("lang").alias("language")).distinct()
    configs = rules.routes(spark, {"en": ["generic", "english"], "de": ["generic"], "fr": ["generic", "french"], "es": ["generic"]})
    return rules.folders_for(d, configs)


_sql("j17_rule_routing", (), """
SELECT DISTINCT source, folder FROM documents JOIN (SELECT 'generic' AS folder, unnest(['en', 'de', 'fr', 'es']) AS l UNION ALL SELECT 'english', 'en' UNION ALL SELECT 'french', 'fr') c ON c.l = lang""")


# --- gates ------------------------------------------------------------------


@_query
def v10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind findings whose texts name an advisory or an entry."""
    b = reviews.blind(V.findings(spark, sf_dir)).withColumn("finding_id", F.col("provenance.raw_result_ref"))
    k = F.col("location.start_line")
    b = b.withColumn("message", F.when(k % 9 == 0, "see cve-2023-12345").when(k % 9 == 1, "like Entry-00017 there").otherwise(F.col("message")))
    return gates.leaks(b)


_sql("v10_leaks", ("findings",), """
SELECT CASE WHEN start_line % 9 = 0 THEN 'ADVISORY_ID' ELSE 'ENTRY_ID' END AS rule_id, ref AS key, '$.message' AS detail FROM findings WHERE start_line % 9 < 2""")


#: JSON that leaks in several ways, by event_id % 11; the others are events' own. No two ways share a key.
_LEAKING_JSON = {
    0: '{"k": {"Gold-Label": 1}}',
    1: '{"a": [{"Gold\\u002dLabel": {"see": "x CVE-2024-12345"}}]}',  # an escaped key
    2: '{"note": "\\"goldlabel\\": 1"}',  # a key's text inside a value leaks nothing
    3: '{"a": {"b": ["ok", "see entry-00012 there"]}}',
    4: "goldlabel: 1",
    5: '{"long": "' + "x" * 70 + '"}',
    6: "[" * 7 + "1" + "]" * 7,
    7: "[" + ",".join(["0"] * 30) + "]",
    8: None,
}


@_query
def v10_json_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys, ids and values past the limits in JSON of any shape, and keys that are not allowed."""
    way = F.col("event_id") % 11
    text = F.col("props")
    for number, leaking in _LEAKING_JSON.items():
        text = F.when(way == number, F.lit(leaking)).otherwise(text)
    e = _table(spark, sf_dir, "events").select("event_id", text.alias("props"))
    found = gates.json_leaks(e, "props", "event_id", max_depth=6, max_values=25, max_chars=64)
    return found.unionByName(gates.unknown_keys(e, "props", "event_id", ["a"]))


_sql("v10_json_leaks", (), """
WITH leaks(way, rule_id, detail) AS (VALUES (0, 'FORBIDDEN_KEY', '$.k.Gold-Label'), (1, 'FORBIDDEN_KEY', '$.a[0].Gold-Label'), (1, 'ADVISORY_ID', '$.a[0].Gold-Label.see'), (3, 'ENTRY_ID', '$.a.b[1]'),
  (4, 'NOT_JSON', '$'), (5, 'TOO_LONG', '$.long'), (6, 'TOO_DEEP', '$[0][0][0][0][0][0][0]'), (7, 'TOO_MANY_VALUES', '$'), (8, 'NOT_JSON', '$'),
  (0, 'UNKNOWN_KEY', 'k'), (2, 'UNKNOWN_KEY', 'note'), (5, 'UNKNOWN_KEY', 'long'))
SELECT rule_id, event_id AS key, detail FROM events JOIN leaks ON way = event_id % 11
UNION ALL SELECT 'UNKNOWN_KEY', event_id, 'k' FROM events WHERE event_id % 11 > 8""")


@_query
def u4_id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only labels or only predictions have."""
    return gates.different_ids(V.gold(spark, sf_dir), V.predictions(spark, sf_dir), names=("MISSING_PREDICTION", "MISSING_LABEL"))


_sql("u4_id_differences", ("gold", "reviews"), """
SELECT 'MISSING_PREDICTION' AS rule_id, finding_id AS key, '' AS detail FROM gold WHERE finding_id NOT IN (SELECT finding_id FROM reviews WHERE doc % 11 <> 0)
UNION ALL SELECT 'MISSING_LABEL', finding_id, '' FROM reviews WHERE doc % 11 <> 0 AND finding_id NOT IN (SELECT finding_id FROM gold)""")


@_query
def v14_prediction_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine predictions that break the contract of a development run, one in each way, of a run in another mode."""
    r = V.reviewer(spark, sf_dir).join(V.flat(spark, sf_dir, "reviews").select("finding_id", "doc"), "finding_id")
    k = F.col("doc") % 23
    put = lambda way, broken, sound: F.when(k == way, broken).otherwise(sound)
    one, two = F.array(F.lit("CONSTANT_VALUE")), F.array(F.lit("CONSTANT_VALUE"), F.lit("CONSTANT_VALUE"))
    false = F.col("verdict") == "FALSE_POSITIVE"
    codes = F.when(false & (k == 3), two).when(false & (k == 4), F.array(F.lit("NO_REASON"))).when(false == (k != 5), one).otherwise(F.array().cast("array<string>"))
    agent = F.struct(F.lit("p").alias("provider"), put(6, F.lit("2"), F.lit("1")).alias("provider_version"), F.lit("m").alias("model"))
    rows = r.select(
        "finding_id", put(0, F.lit(2), F.lit(1)).alias("schema_version"), "verdict", put(1, F.lit("SURE"), F.lit("HIGH")).alias("confidence"), (k == 2).alias("evaluation_eligible"),
        put(7, F.lit(None), F.lit(gates.NOT_ELIGIBLE)).alias("exclusion_reason"), codes.alias("reason_codes"), *[put(8 + n, F.lit(" "), F.lit("text")).alias(name) for n, name in enumerate(gates.STATED)], agent.alias("agent"),
    )
    run = {"evaluation_mode": "OFFICIAL", "provider": "p", "provider_version": "1", "model": "m"}
    return gates.prediction_core(rows, run, {"provider": "p", "model": "m"})


_sql("v14_prediction_core", ("reviews",), """
SELECT r AS rule_id, finding_id AS key, '' AS detail FROM reviews JOIN (VALUES (0, 'SCHEMA_VERSION'), (1, 'CONFIDENCE'), (2, 'ELIGIBLE'), (7, 'ELIGIBLE'), (5, 'REASONS_AND_VERDICT'), (6, 'AGENT'),
  (8, 'EMPTY_ATTACKER_CAPABILITY'), (9, 'EMPTY_ENTRY_POINT'), (10, 'EMPTY_SECURITY_EFFECT'), (11, 'EMPTY_CONTROLS'), (12, 'EMPTY_REASONING')) x(k, r) ON k = doc % 23
UNION ALL SELECT 'REASON_CODES', finding_id, '' FROM reviews WHERE doc % 23 IN (3, 4) AND verdict = 'FALSE_POSITIVE'
UNION ALL SELECT 'RUN', 'evaluation_mode', 'OFFICIAL'""")


@_query
def v30_current_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a run that its chain of proofs no longer bears out: a proof of manifests, which state the files of orders."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name, manifest = F.concat(F.lit("file-"), "k"), F.concat(F.lit("manifest-"), (F.col("k") % 50).cast("string"))
    sha = lambda c, more="": F.sha2(F.concat(c, F.lit(more)), 256)
    manifests = o.select(manifest.alias("name")).distinct()
    pins = o.select(manifest.alias("holder"), name.alias("name"), sha(name).alias("sha256")).unionByName(manifests.select(F.lit("proof").alias("holder"), "name", F.upper(sha(F.col("name"))).alias("sha256")))
    changed = F.when(F.col("k") % 17 == 0, sha(name, "x")).otherwise(sha(name))
    files = o.filter("k % 17 <> 1").select(name.alias("name"), changed.alias("sha256")).unionByName(o.filter("k % 17 = 2").select(F.concat(F.lit("extra-"), "k").alias("name"), F.lit("0").alias("sha256")))
    now = manifests.filter("name <> 'manifest-4'").select("name", F.when(F.col("name") == "manifest-3", "0").otherwise(sha(F.col("name"))).alias("sha256"))
    return packages.proof_chain(pins, files.unionByName(now), "proof")


_sql("v30_current_proofs", (), """
WITH f AS (SELECT 'file-' || o_orderkey AS name, o_orderkey % 17 AS k, 'manifest-' || (o_orderkey % 50) AS m, o_orderkey FROM orders)
SELECT CASE WHEN m IN ('manifest-3', 'manifest-4') THEN 'UNPROVEN' WHEN k = 0 THEN 'CHANGED' ELSE 'MISSING' END AS rule_id, name AS key, m AS detail FROM f WHERE m IN ('manifest-3', 'manifest-4') OR k IN (0, 1)
UNION ALL SELECT 'ADDED', 'extra-' || o_orderkey, '' FROM f WHERE k = 2
UNION ALL SELECT DISTINCT CASE m WHEN 'manifest-3' THEN 'CHANGED' ELSE 'MISSING' END, m, 'proof' FROM f WHERE m IN ('manifest-3', 'manifest-4')""")


@_query
def v30_row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the hash of their canonical JSON, by which later stages pin them."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.upper("p_name").alias("a"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("size"))
    return reviews.with_row_hash(p).select("key", "row_sha256")


_sql("v30_row_hashes", (), """
SELECT p_partkey AS key, sha256('{"a":"' || upper(p_name) || '","key":' || p_partkey || ',"size":' || CASE WHEN p_partkey % 3 > 0 THEN '' || p_size ELSE 'null' END || '}') AS row_sha256 FROM part""")


@_query
def s4_empty_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs without any row, among all languages' documents and one that none has."""
    d = _table(spark, sf_dir, "documents")
    kinds = {"any": d, "none": d.filter("lang = 'tlh'"), "long": d.filter("n_chars > 1000000000"), "short": d.filter("n_chars >= 0")}
    return gates.together(*[gates.empty(rows, name) for name, rows in kinds.items()])


_sql("s4_empty_inputs", (), """
SELECT 'EMPTY' AS rule_id, x AS key, '' AS detail FROM (
  SELECT 'any' AS x, count(*) AS n FROM documents UNION ALL SELECT 'none', count(*) FROM documents WHERE lang = 'tlh'
  UNION ALL SELECT 'long', count(*) FROM documents WHERE n_chars > 1000000000 UNION ALL SELECT 'short', count(*) FROM documents WHERE n_chars >= 0) WHERE n = 0""")


@_query
def s7_s8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents over several lines, a file each, some of which hold no object."""
    s = _table(spark, sf_dir, "supplier")
    path, k = scratch.folder(spark, "documents"), F.col("s_suppkey")
    sound = F.concat(F.lit('{\n "k": '), k, F.lit(',\n "name": "'), "s_name", F.lit('"}'))
    text = F.when(k % 7 == 3, "[1]").when(k % 7 == 4, F.concat(F.lit('{"k": '), k)).when(k % 7 == 5, '{"other": {"k": 1}}').otherwise(sound)
    s.select(k.alias("file"), text.alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = jsonl.read_document(spark, f"{path}/*/part-*", "k long, name string")
    return found.select(F.regexp_extract("source_file", r"/file=(\d+)/", 1).cast("long").alias("file"), "k", "name", F.col(jsonl.CORRUPT).isNotNull().alias("broken"))


_sql("s7_s8_documents", (), """
SELECT CAST(s_suppkey AS BIGINT) AS file, CASE WHEN s_suppkey % 7 NOT IN (3, 4, 5) THEN CAST(s_suppkey AS BIGINT) END AS k, CASE WHEN s_suppkey % 7 NOT IN (3, 4, 5) THEN s_name END AS name, s_suppkey % 7 IN (3, 4) AS broken FROM supplier""")


@_query
def p15_p16_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place and the trace of each match as nodes of file and line."""
    m = matching.match_candidates(V.findings(spark, sf_dir), V.entries(spark, sf_dir))
    node = lambda n: F.concat_ws(":", n["file"], n["line"])
    bare = lambda c: F.regexp_replace(F.translate(c, "\\", "/"), "^[.]/|/(?=/)", "")
    return m.select("ref", bare(node(F.col("location"))).alias("location"), F.array_join(F.transform("trace_nodes", node), ",").alias("trace"))


_sql("p15_p16_nodes", ("findings",), """
SELECT ref, file || ':' || start_line || CASE WHEN end_line <> start_line THEN '-' || end_line ELSE '' END AS location,
  CASE WHEN trace_file IS NULL THEN '' ELSE trace_file || ':' || trace_line || CASE WHEN trace_end <> trace_line THEN '-' || trace_end ELSE '' END END AS trace FROM findings""")


@_query
def x51_nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings of nested arrays in order, without nulls."""
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    inner = F.array(F.col("p_name"), F.when(k == 1, F.col("p_brand")))
    nested = F.when(k != 2, F.array(inner, F.when(k == 3, F.array(F.col("p_type"))))).alias("nested")
    p = p.select("p_partkey", nested, F.when(k > 0, F.col("p_brand")).alias("plain"))
    join = lambda c: F.array_join(T.strings_of(c, p.schema[c].dataType), "|").alias(c)
    return p.select("p_partkey", join("nested"), join("plain"))


_sql("x51_nested_strings", (), """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '|' || p_brand WHEN 3 THEN p_name || '|' || p_type ELSE '' END AS nested, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS plain FROM part""")


@_query
def v24_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finding ids of more than one observation."""
    return gates.repeated(V.findings(spark, sf_dir), "finding_id")


_sql("v24_repeated_ids", ("findings",), f"SELECT 'REPEATED_ID' AS rule_id, id AS key, '' || count(*) AS detail FROM (SELECT {_ID} AS id FROM findings) GROUP BY id HAVING count(*) > 1")


@_query
def v13_prediction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that break the contract of frozen predictions."""
    r = V.reviewer(spark, sf_dir).withColumn("abstain_reason", F.when(F.col("verdict") == "ABSTAIN", "unclear"))
    r = r.withColumn("evidence", F.when(F.col("verdict") != "ABSTAIN", F.col("evidence")).otherwise(F.array().cast(reviews.EVIDENCE)))
    r = r.withColumn("abstain_reason", F.when(F.length("reasoning") % 4 == 0, None).otherwise(F.col("abstain_reason")))
    return gates.predictions(r, V.gold(spark, sf_dir)).filter("rule_id <> 'EXTRA_PREDICTION'")


_sql("v13_prediction_gate", ("reviews", "gold"), """
SELECT 'ABSTAIN_FIELDS' AS rule_id, finding_id AS key, 'ABSTAIN' AS detail FROM reviews WHERE verdict = 'ABSTAIN' AND length('a' || doc) % 4 = 0
UNION ALL SELECT 'MISSING_PREDICTION', finding_id, '' FROM gold WHERE finding_id NOT IN (SELECT finding_id FROM reviews)""")


@_query
def v22_frozen_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a frozen package that recomputing changes."""
    g = V.gold(spark, sf_dir)
    kept = g.withColumn("label", F.when(F.substring("finding_id", -1, 1) == "5", "UNCERTAIN").otherwise(F.col("label")))
    return gates.frozen_copy(kept, g)


_sql("v22_frozen_copy", ("gold",), """
SELECT r AS rule_id, finding_id AS key, '' AS detail FROM gold, (SELECT unnest(['NOT_RECOMPUTED', 'NOT_FROZEN']) AS r) WHERE finding_id LIKE '%5' AND label <> 'UNCERTAIN'""")


# --- dataset ----------------------------------------------------------------


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with features in the shape of the enriched dataset."""
    m = V.machine(spark, sf_dir)
    return m.select("finding_id", F.struct("label").alias("machine_reference"), "features")


@_query
def p10_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of findings."""
    f = V.findings(spark, sf_dir).select(F.col("provenance.raw_result_ref").alias("ref"), dataset.features().alias("f"))
    return f.select("ref", "f.rule_id", F.array_join("f.cwes", ",").alias("cwes"), "f.language", "f.has_dataflow")


_sql("p10_features", ("findings",), "SELECT ref, rule_id, coalesce('CWE-' || cwe_no, '') AS cwes, 'python' AS language, trace_file IS NOT NULL AS has_dataflow FROM findings")


@_query
def j13_enriched_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with labels, and with links for the positive ones."""
    f = V.findings(spark, sf_dir).withColumn("finding_id", F.col("provenance.raw_result_ref"))
    label = F.when(F.col("location.start_line") % 4 == 0, "MACHINE_TRUE_POSITIVE").otherwise("MACHINE_FALSE_POSITIVE")
    labels = f.select("finding_id", label.alias("label"))
    m = matching.match_candidates(f, V.entries(spark, sf_dir))
    d = dataset.build(f, labels, m)
    p = F.col("post_freeze_linkage")
    return d.select("finding_id", p["status"].alias("status"), p["match_tier"].alias("match_tier"), F.array_join(p["linked_entry_ids"], ",").alias("linked"), F.size(p["candidate_matches"]).alias("candidates"))


_sql("j13_enriched_dataset", ("findings", "entries"), f"""
SELECT f.ref AS finding_id, CASE WHEN f.start_line % 4 <> 0 THEN 'NOT_APPLICABLE' WHEN coalesce(b.m, 3) < 2 THEN 'MACHINE_TP_LINKED' ELSE 'MACHINE_TP_UNLINKED' END AS status,
  CASE WHEN f.start_line % 4 = 0 THEN {_TIER.format('b.m')} END AS match_tier, CASE WHEN f.start_line % 4 = 0 AND b.m < 2 THEN b.es ELSE '' END AS linked,
  CAST(CASE WHEN f.start_line % 4 = 0 THEN coalesce(b.n, 0) ELSE 0 END AS INTEGER) AS candidates
FROM findings f LEFT JOIN (SELECT ref, min(m) AS m, count(*) AS n, string_agg(DISTINCT entry_id, ',' ORDER BY entry_id) AS es FROM best WHERE tier = m GROUP BY ref) b ON b.ref = f.ref""", _MATCH_SQL)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched dataset with fewer positives than negatives, as scans have them."""
    no = F.regexp_extract("finding_id", r"(\d+)$", 1).cast("long")
    label = F.when(F.col("machine_reference.label") == "MACHINE_UNCERTAIN", "MACHINE_UNCERTAIN").when(no % 9 == 0, "MACHINE_TRUE_POSITIVE").otherwise("MACHINE_FALSE_POSITIVE")
    return _enriched(spark, sf_dir).withColumn("machine_reference", F.struct(label.alias("label")))


_LABELLED = """e AS (
  SELECT finding_id, repository, rule_id, cwe_a, cwe_b, language, has_dataflow, ['train', 'validation', 'test'][CAST(substr(repository, 2) AS INTEGER) % 3 + 1] AS split,
    CASE WHEN label = 'UNCERTAIN' THEN 'MACHINE_UNCERTAIN' WHEN CAST(substr(finding_id, 9) AS BIGINT) % 9 = 0 THEN 'MACHINE_TRUE_POSITIVE' ELSE 'MACHINE_FALSE_POSITIVE' END AS lab FROM gold)"""


@_query
def c3_repository_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives of the splits that whole repositories are assigned to, against their targets."""
    rows = _labelled(spark, sf_dir)
    at = dataset.assign(rows, "seed")
    j = rows.join(at, F.col("features.repository") == F.col("repository"))
    counted = j.groupBy("split").agg(F.count_if(F.col("machine_reference.label") == "MACHINE_TRUE_POSITIVE").alias("positives"))
    return counted.select("split", "positives")


# All subsets of 17 repositories that train and validation may get, by their sums: the closest to the targets in all.
_sql("c3_repository_splits", ("gold",), """
SELECT unnest(['train', 'validation', 'test']) AS split, unnest([t, v, (SELECT sum(n) FROM c)::BIGINT - t - v]) AS positives FROM (
  SELECT t, v FROM steps s, goal WHERE s.i = (SELECT max(i) FROM c) ORDER BY abs(t - gt) + abs(v - gv) + abs(total - t - v - (total - gt - gv)), t LIMIT 1)""", _LABELLED + """,
c AS (SELECT row_number() OVER (ORDER BY repository) AS i, count(*) AS n FROM e WHERE lab = 'MACHINE_TRUE_POSITIVE' GROUP BY repository),
goal AS (SELECT total, total - 2 * (total * 2 // 7) AS gt, total * 2 // 7 AS gv FROM (SELECT sum(n)::BIGINT AS total FROM c)),
steps AS (SELECT 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS v UNION SELECT c.i, s.t + c.n * w.a, s.v + c.n * w.b FROM steps s JOIN c ON c.i = s.i + 1, (VALUES (0, 0), (0, 1), (1, 0)) w(a, b))""")


@_query
def c4_balanced_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matched negative for each positive of a split, repositories being dealt by their number."""
    rows = _labelled(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.substring("repository", 2, 9).cast("int") % 3 + 1)
    at = rows.select(F.col("features.repository").alias("repository")).distinct().withColumn("split", names)
    return dataset.balanced(rows, at, "seed")


_sql("c4_balanced_splits", ("gold",), """
SELECT split, finding_id, lab AS class FROM p UNION ALL SELECT split, chosen, 'MACHINE_FALSE_POSITIVE' FROM steps WHERE chosen IS NOT NULL""", _LABELLED + """,
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY finding_id) AS k, count(*) OVER (PARTITION BY split) AS want FROM e WHERE lab = 'MACHINE_TRUE_POSITIVE'),
near AS (
  SELECT p.split, p.k, n.finding_id AS n, row_number() OVER (PARTITION BY p.split, p.k ORDER BY 16 * (p.repository = n.repository)::INT + 8 * (p.rule_id = n.rule_id)::INT
    + 4 * coalesce(list_has_any([p.cwe_a, p.cwe_b], list_filter([n.cwe_a, n.cwe_b], lambda x: x IS NOT NULL)), false)::INT + 2 * (p.language = n.language)::INT + (p.has_dataflow = n.has_dataflow)::INT DESC,
    sha256(concat_ws(chr(0), 'seed', p.split, p.finding_id, n.finding_id)) DESC) AS r
  FROM p JOIN e n ON n.split = p.split AND n.lab = 'MACHINE_FALSE_POSITIVE' QUALIFY r <= any_value(p.want) OVER (PARTITION BY p.split, p.k)),
steps AS (
  SELECT DISTINCT split, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS chosen FROM p
  UNION ALL SELECT s.split, s.k + 1, s.taken || [arg_min(near.n, near.r)], arg_min(near.n, near.r) FROM steps s JOIN near ON near.split = s.split AND near.k = s.k + 1 AND NOT list_contains(s.taken, near.n)
  GROUP BY s.split, s.k, s.taken)""")


@_query
def u5_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and repositories that two splits share, where findings are dealt without regard to repositories."""
    rows = _labelled(spark, sf_dir)
    no = F.regexp_extract("finding_id", r"(\d+)$", 1).cast("long")
    dealt = rows.select("finding_id", F.when(no % 17 < 9, "train").when(no % 17 < 16, "validation").when(no % 5 == 0, "test").otherwise("train").alias("split"))
    again = rows.filter(no % 40 == 3).select("finding_id", F.lit("test").alias("split"))
    return dataset.split_leaks(dealt.unionByName(again), rows)


_sql("u5_split_leaks", ("gold",), """
SELECT 'FINDING_LEAK' AS rule_id, finding_id AS key, string_agg(DISTINCT s, ',' ORDER BY s) AS detail FROM d GROUP BY finding_id HAVING count(DISTINCT s) > 1
UNION ALL SELECT 'REPOSITORY_LEAK', repository, string_agg(DISTINCT s, ',' ORDER BY s) FROM d GROUP BY repository HAVING count(DISTINCT s) > 1""",
     """x AS (SELECT finding_id, repository, CAST(substr(finding_id, 9) AS BIGINT) AS no FROM gold),
d AS (SELECT *, CASE WHEN no % 17 < 9 THEN 'train' WHEN no % 17 < 16 THEN 'validation' WHEN no % 5 = 0 THEN 'test' ELSE 'train' END AS s FROM x UNION ALL SELECT *, 'test' FROM x WHERE no % 40 = 3)""")  # fmt: skip


@_query
def p12_accept_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of believing every finding."""
    m = V.machine(spark, sf_dir)
    return metrics.machine_reference(m, dataset.accept_all(m)).select("tp", "fp", "tn", "fn", "precision", "recall", "selective_coverage")


_sql("p12_accept_all", ("gold",), f"""
SELECT tp, fp, tn, fn, precision, recall, selective_coverage FROM (SELECT {_RATES} FROM (SELECT {_COUNTERS} FROM (SELECT label IN ('TP_KNOWN', 'TP_NOVEL') AS truth, 'TRUE_POSITIVE' AS v FROM gold WHERE label <> 'UNCERTAIN')))""")


@_query
def p13_import_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported verdicts that do not fit their split: too many, too few, unknown and repeated ones."""
    p = V.predictions(spark, sf_dir).withColumn("verdict", F.when(F.substring("finding_id", -1, 1) == "7", "MAYBE").otherwise(F.col("verdict")))
    return dataset.import_violations(p.unionByName(p.filter(F.substring("finding_id", -2, 2) == "08")), V.gold(spark, sf_dir))


_sql("p13_import_gate", ("gold", "reviews"), """
SELECT 'MISSING_PREDICTION' AS rule_id, finding_id AS key, '' AS detail FROM gold WHERE finding_id NOT IN (SELECT finding_id FROM p)
UNION ALL SELECT 'INVALID_VERDICT', finding_id, 'MAYBE' FROM p WHERE doc % 10 = 7
UNION ALL SELECT 'EXTRA_PREDICTION', finding_id, v FROM p WHERE finding_id NOT IN (SELECT finding_id FROM gold)
UNION ALL SELECT 'REPEATED_PREDICTION', finding_id, '' || count(*) FROM p GROUP BY finding_id HAVING count(*) > 1""",
     """one AS (SELECT *, CASE WHEN doc % 10 = 7 THEN 'MAYBE' ELSE verdict END AS v FROM reviews WHERE doc % 11 <> 0), p AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE finding_id LIKE '%08')""")  # fmt: skip


#: Results of one raw report that the queries write.
_PER_REPORT = 400
_PARTS = f"p AS (SELECT *, p_partkey // {_PER_REPORT} AS job, p_partkey % {_PER_REPORT} AS pos, p_partkey AS k FROM part)"


# --- packages of stages -----------------------------------------------------


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.flat(spark, sf_dir, "reviews")
    return r.select(F.col("doc").alias("position"), "finding_id", (F.col("doc") % 50).alias("k"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query
def s22_sample_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample package with another file, another id and another number than its manifest states."""
    f = _sample(spark, sf_dir)
    index = f.withColumn("finding_id", F.when(F.col("k") == 7, "other").otherwise(F.col("finding_id"))).filter("k != 9")
    manifest = _rows(spark, [(5, {"a": "aa", "b": "bb", "c": "cc"})], "sample_size long, outputs map<string,string>")
    return packages.sample_violations(manifest, _rows(spark, [("a", "AA"), ("b", "xx")], "name string, sha256 string"), f, index)


_sql("s22_sample_package", ("reviews",), """
SELECT 'SAMPLE_AND_INDEX' AS rule_id, '' || doc AS key, finding_id || CASE WHEN doc % 50 = 7 THEN ' other' ELSE ' -' END AS detail FROM reviews WHERE doc % 50 IN (7, 9)
UNION ALL SELECT 'CHECKSUM', 'b', 'bb' UNION ALL SELECT 'MISSING_FILE', 'c', 'cc' UNION ALL SELECT 'SAMPLE_SIZE', '' || count(*), '5' FROM reviews HAVING count(*) <> 5""")


@_query
def s23_evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence packets of other findings, of other snapshots, unverified ones, and one too few."""
    f = _sample(spark, sf_dir)
    k = F.col("k")
    p = f.filter("k != 11").select(
        "position", "finding_id", F.struct(F.when(k == 3, "x").otherwise(F.col("finding_id")).alias("finding_id"), F.lit("r").alias("repo_url"), F.lit("c").alias("commit")).alias("finding"),
        F.struct(F.lit("r").alias("repo_url"), F.when(k == 5, "d").otherwise("c").alias("commit"), F.when(k != 6, k != 4).alias("git_state_verified")).alias("snapshot"),
    )
    return packages.packet_violations(p, f)


_sql("s23_evidence_packets", ("reviews",), """
SELECT 'PACKETS_AND_SAMPLE' AS rule_id, '' || doc AS key, '- ' || finding_id AS detail FROM reviews WHERE doc % 50 = 11
UNION ALL SELECT CASE doc % 50 WHEN 3 THEN 'PACKET_FINDING' WHEN 5 THEN 'PACKET_SNAPSHOT' ELSE 'PACKET_NOT_VERIFIED' END, finding_id, '' FROM reviews WHERE doc % 50 IN (3, 4, 5, 6)""")


@_query
def s31_frozen_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has changed in a frozen triple of findings, packets and index."""
    f = V.findings(spark, sf_dir).withColumns({"finding_id": F.col("provenance.raw_result_ref"), "position": F.col("provenance.raw_result_ref")})
    n = F.col("location.start_line")
    shown = reviews.blind(f.withColumn("message", F.when(n == 13, "changed").otherwise(F.col("message"))), ("semgrep",))
    packets = shown.select(F.col("finding_id").alias("position"), "finding_id", F.when(n == 19, 2).otherwise(1).alias("schema_version"), F.when(n == 17, 0).otherwise(n).alias("review_order"), F.struct(*shown.columns).alias("finding"))
    return packages.frozen_violations(f, packets, f.filter(n != 23).select("position", "finding_id", n.alias("review_order")), "semgrep", "1.0.0")


_sql("s31_frozen_triple", ("findings",), """
SELECT 'SCANNER' AS rule_id, ref AS key, '' AS detail FROM findings WHERE scanner <> 'semgrep' AND start_line <> 23
UNION ALL SELECT CASE start_line WHEN 13 THEN 'BLIND_PROJECTION' WHEN 17 THEN 'REVIEW_ORDER' ELSE 'PACKET_SCHEMA' END, ref, '' FROM findings WHERE start_line IN (13, 17, 19)
UNION ALL SELECT 'INDEX_AND_SAMPLE', ref, '- ' || ref FROM findings WHERE start_line = 23""")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A run, its predictions and cases, what was expected, and the files: some of each is broken."""
    f = _sample(spark, sf_dir)
    k = F.col("k")
    predictions = f.select("position", F.when(k == 1, "odd").otherwise(F.col("finding_id")).alias("finding_id"), F.when(k < 3, "same").when(k < 40, F.concat(F.lit("resp"), "position")).alias("response_id"))
    used = F.create_map(F.lit("input_tokens"), F.col("position"), F.lit("output_tokens"), F.lit(2).cast("long"))
    cases = f.filter("k != 4").select(
        F.when(k == 5, F.concat("finding_id", F.lit("-"))).otherwise(F.col("finding_id")).alias("finding_id"), F.when(k == 6, "FAILED").otherwise("SUCCESS").alias("status"),
        F.concat(F.lit("case/"), "position").alias("name"), F.sha2(F.col("position").cast("string"), 256).alias("sha256"), used.alias("usage"),
    )
    files = f.filter("k != 7").select(F.concat(F.lit("case/"), "position").alias("name"), F.sha2(F.when(k == 8, "changed").otherwise(F.col("position").cast("string")), 256).alias("sha256"))
    run = _rows(spark, [("COMPLETE", True, 3, 3, 1, {"input_tokens": 7, "total_tokens": 9})], "status string, complete boolean, total long, success long, failed long, usage map<string,long>")
    return run, predictions, cases, f.select("position", "finding_id"), files


_RUN = "r AS (SELECT doc, finding_id, doc % 50 AS k FROM reviews)"
_RUN_SQL = """
SELECT 'RUN_TOTAL' AS rule_id, 'run' AS key, '' AS detail UNION ALL SELECT 'RUN_FAILED', 'run', '' UNION ALL SELECT 'PREDICTIONS', '' || doc, 'odd ' || finding_id FROM r WHERE k = 1
UNION ALL SELECT 'CASE_NOT_DONE', finding_id, '' FROM r WHERE k IN (4, 5, 6) UNION ALL SELECT 'UNEXPECTED_CASE', finding_id || '-', '' FROM r WHERE k = 5
UNION ALL SELECT CASE k WHEN 7 THEN 'MISSING_FILE' ELSE 'CHECKSUM' END, 'case/' || doc, sha256('' || doc) FROM r WHERE k IN (7, 8)
UNION ALL SELECT 'REPEATED_RESPONSE', 'same', '' || count(*) FROM r WHERE k < 3 HAVING count(*) > 1
UNION ALL SELECT 'USAGE', 'input_tokens', sum(doc) || ' 7' FROM r WHERE k <> 4 UNION ALL SELECT 'USAGE', 'output_tokens', 2 * count(*) || ' 0' FROM r WHERE k <> 4 UNION ALL SELECT 'USAGE', 'total_tokens', '0 9'"""


@_query
def s24_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a reviewer's run from being complete and proven."""
    return packages.run_violations(*_run(spark, sf_dir))


_sql("s24_completed_run", ("reviews",), _RUN_SQL, _RUN)


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Adjudicators' responses, and what was exposed to them."""
    r = V.flat(spark, sf_dir, "reviews").select("finding_id", (F.col("doc") % 50).alias("k"))
    k = F.col("k")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    node = lambda n: F.struct(F.lit("a.py").alias("file"), F.lit(n).alias("line"), F.lit("d").alias("description"), F.lit("c").alias("code"))
    verdict = F.when(k == 1, "MAYBE").when(k % 3 == 0, "TRUE_POSITIVE").when(k % 3 == 1, "FALSE_POSITIVE").otherwise("UNCERTAIN")
    given = r.select(
        "finding_id", verdict.alias("verdict"), F.when(k == 2, "SURE").otherwise("HIGH").alias("confidence"),
        F.when(k == 4, strings("CONSTANT_VALUE", "CONSTANT_VALUE")).when(k == 3, strings("CONSTANT_VALUE")).when((k % 3 == 1) & (k != 7), strings("CONSTANT_VALUE")).otherwise(strings()).alias("reason_codes"),
        F.when(k == 6, " ").when(k == 9, F.repeat(F.lit("x"), 16_001)).otherwise("why").alias("reasoning"),
        F.when(k == 12, F.array(node("9"))).when(k == 15, F.array(node("1"), node("1"))).when(k == 18, F.array().cast(reviews.EVIDENCE)).otherwise(F.array(node("1"))).alias("evidence"),
        F.when((k % 3 == 2) & (k != 5), "unclear").when(k == 10, "but").alias("uncertainty_reason"),
    )
    return given, r.select("finding_id", node("1").alias("node"))


_RESPONSES = "q AS (SELECT finding_id, doc % 50 AS k, CASE WHEN doc % 50 = 1 THEN 'MAYBE' WHEN doc % 50 % 3 = 0 THEN 'TRUE_POSITIVE' WHEN doc % 50 % 3 = 1 THEN 'FALSE_POSITIVE' ELSE 'UNCERTAIN' END AS v FROM reviews)"
_RESPONSES_SQL = """SELECT unnest(CASE k WHEN 1 THEN ['VERDICT'] WHEN 2 THEN ['CONFIDENCE'] WHEN 3 THEN ['TRUE_SEMANTICS'] WHEN 4 THEN ['REASON_CODES'] WHEN 5 THEN ['UNCERTAIN_SEMANTICS'] WHEN 6 THEN ['REASONING']
    WHEN 7 THEN ['FALSE_SEMANTICS'] WHEN 9 THEN ['REASONING'] WHEN 10 THEN ['FALSE_SEMANTICS'] WHEN 15 THEN ['REPEATED_EVIDENCE'] WHEN 18 THEN ['TRUE_SEMANTICS'] ELSE [] END) AS rule_id, finding_id AS key, v AS detail FROM q
UNION ALL SELECT 'NOT_EXPOSED', finding_id, 'a.py:9' FROM q WHERE k = 12"""


@_query
def v16_adjudicator_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with adjudicators' responses."""
    return packages.response_violations(*_responses(spark, sf_dir))


_sql("v16_adjudicator_responses", ("reviews",), _RESPONSES_SQL, _RESPONSES)


@_query
def v27_semantic_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifiers' responses whose fields do not go with their verdict, or whose evidence was not shown whole."""
    r = V.flat(spark, sf_dir, "reviews")
    k = F.col("doc") % 12
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    node = lambda line: F.array(F.struct(F.lit("a.py").alias("file"), F.lit(line).alias("line"), F.lit("d").alias("description"), F.lit("c").alias("code")))
    given = r.select(
        "finding_id", "verdict", F.when(k < 6, strings("CONSTANT_VALUE")).otherwise(strings()).alias("reason_codes"),
        F.when(k % 4 == 0, node("3-9")).when(k % 4 == 1, node("3-19")).when(k % 4 == 2, node("03")).otherwise(F.array().cast(reviews.EVIDENCE)).alias("evidence"), F.when(k % 3 == 0, "no way to tell").alias("abstain_reason"),
    )
    shown = r.select("finding_id", F.lit("a.py").alias("file"), F.lit(1).alias("start"), F.lit(10).alias("end"))
    return packages.semantic_defects(given, shown.unionByName(shown.withColumns({"start": F.lit(11), "end": F.lit(20)})))


_sql("v27_semantic_defects", ("reviews",), """
SELECT unnest(list_filter([CASE WHEN verdict = 'FALSE_POSITIVE' AND (k >= 6 OR k % 4 = 3 OR k % 3 = 0) THEN 'FALSE_SEMANTICS' END, CASE WHEN verdict = 'TRUE_POSITIVE' AND (k < 6 OR k % 4 = 3 OR k % 3 = 0) THEN 'TRUE_SEMANTICS' END,
    CASE WHEN verdict = 'ABSTAIN' AND (k < 6 OR k % 3 <> 0) THEN 'ABSTAIN_SEMANTICS' END], lambda x: x IS NOT NULL)) AS rule_id, finding_id AS key, verdict AS detail FROM q
UNION ALL SELECT 'EVIDENCE_LINE', finding_id, '03' FROM q WHERE k % 4 = 2 UNION ALL SELECT 'NOT_SHOWN', finding_id, 'a.py:3:19' FROM q WHERE k % 4 = 1""", "q AS (SELECT *, doc % 12 AS k FROM reviews)")


@_query
def v29_decision_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps final decisions from being proven."""
    run, predictions, cases, expected, files = _run(spark, sf_dir)
    given, exposed = _responses(spark, sf_dir)
    place = predictions.join(expected.withColumnRenamed("finding_id", "own"), "position").select("position", "response_id", F.col("finding_id").alias("told"), "own")
    decisions = given.withColumnRenamed("finding_id", "own").join(place, "own").withColumnRenamed("told", "finding_id").drop("own")
    decisions = decisions.withColumn("row_sha256", F.when(F.col("position") % 50 == 20, "x").otherwise("y"))
    return packages.decision_violations(run, decisions, cases.withColumn("decision_sha256", F.lit("y")), expected, files, exposed)


_sql("v29_decision_proofs", ("reviews",), _RUN_SQL + "\nUNION ALL SELECT rule_id, CASE WHEN k = 1 THEN 'odd' ELSE key END, detail FROM (" + _RESPONSES_SQL.replace("v AS detail FROM q", "v AS detail, k FROM q").replace("'a.py:9' FROM q", "'a.py:9', k FROM q") + """)
UNION ALL SELECT 'NOT_EXPOSED', 'odd', 'a.py:1' FROM q WHERE k = 1 UNION ALL SELECT 'DECISION_CHANGED', finding_id, 'x' FROM q WHERE k = 20""", _RUN + ", " + _RESPONSES)


@_query
def v19_quarantine_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers whose quarantine their attempts and their scan's policy do not prove."""
    a = V.attempts(spark, sf_dir)
    job = ["repo_url", "commit", "scanner"]
    last = ledger.latest(a).select("scan_id", *job, "status", "event_id")
    n = a.filter("status = 'TIMEOUT'").groupBy(*job).agg(F.count("*").alias("n"))
    p = last.join(n, job, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    k = F.col("event_id") % 10
    scheduling = F.struct(
        F.when(k == 1, "OPEN").otherwise("QUARANTINED").alias("state"), F.lit("timeout_budget_exhausted").alias("reason"), F.when(k == 2, F.col("n") + 1).otherwise(F.col("n")).alias("matching_timeout_attempts"),
        F.lit(1).alias("limit"), F.when(k == 3, "F" * 64).otherwise("f" * 64).alias("policy_sha256"), F.when(k == 4, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00Z").alias("decided_at"),
    )
    p = p.select("scan_id", *job, "status", F.when(k == 5, 3).when(k == 6, 1).otherwise(2).alias("schema_version"), F.when(k != 7, scheduling).alias("scheduling"))
    policies = _rows(spark, [("scan-0", 1, "bounded-timeout-retry", 1, "f" * 64)], "scan_id string, schema_version int, policy string, max_completed_timeout_attempts int, sha256 string")
    return packages.quarantine_violations(p, a, policies)


_sql("v19_quarantine_proof", ("attempts",), """
SELECT unnest(list_filter([CASE WHEN k = 5 THEN 'POINTER_SCHEMA' END, CASE WHEN k = 6 THEN 'SCHEDULING_IN_SCHEMA_1' END, CASE WHEN k = 7 THEN 'NO_SCHEDULING' END, CASE WHEN k = 1 THEN 'STATE' END,
    CASE WHEN two AND status NOT IN ('TIMEOUT', 'INTERRUPTED', 'FAILED') THEN 'STATUS' END, CASE WHEN two AND n + (k = 2)::INT < 1 THEN 'COUNT' END, CASE WHEN k = 2 THEN 'TIMEOUTS' END, CASE WHEN k = 4 THEN 'DECIDED_AT' END,
    CASE WHEN two AND scan_id <> 'scan-0' THEN 'NO_POLICY' END, CASE WHEN k = 3 AND scan_id = 'scan-0' THEN 'POLICY_SHA256' END], lambda x: x IS NOT NULL)) AS rule_id,
  repo || ' ' || commit_sha || ' ' || scanner AS key, status AS detail FROM (SELECT *, k NOT IN (5, 6, 7) AS two FROM j)""",
     """l AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY repo, commit_sha, scanner ORDER BY event_id DESC) = 1),
j AS (SELECT l.*, l.event_id % 10 AS k, coalesce(n, 0) AS n FROM l LEFT JOIN (SELECT repo, commit_sha, scanner, count(*) AS n FROM attempts WHERE status = 'TIMEOUT' GROUP BY 1, 2, 3) t USING (repo, commit_sha, scanner))""")  # fmt: skip


@_query
def v32_manifest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a manifest without a url or a commit."""
    n = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(n.alias("position"), F.when(n % 9 == 0, " ").otherwise("https://h/r").alias("repo_url"), F.when(n % 7 != 0, "c0").alias("commit"))
    return packages.snapshot_violations(c)


_sql("v32_manifest_snapshots", (), """
SELECT 'REPO_URL' AS rule_id, '' || c_custkey AS key, '' AS detail FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'COMMIT', '' || c_custkey, '' FROM customer WHERE c_custkey % 7 = 0""")


@_query
def v20_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attestation that another policy, a missing proof and a changed one keep from standing."""
    d = _table(spark, sf_dir, "supplier")
    proof = F.struct(F.concat(F.lit("p"), "s_suppkey").alias("path"), F.sha2("s_name", 256).alias("sha256"))
    proofs = d.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_name").alias("key"), proof.alias("value")))).alias("frozen_inputs"))
    policy = F.create_map(*[F.lit(x) for k, v in packages.POLICY.items() for x in (k, v or k == "human_gold")])
    a = proofs.select(F.lit(1).alias("schema_version"), F.lit(packages.APPROVED).alias("status"), policy.alias("policy"), F.lit(packages.VERIFICATION).alias("verification_method"), F.lit(True).alias("independent"), F.lit(None).cast("boolean").alias("repository_split"), "frozen_inputs")
    k = F.col("s_suppkey")
    files = d.filter(k % 5 != 0).select(F.concat(F.lit("p"), "s_suppkey").alias("name"), F.sha2(F.when(k % 7 == 1, "changed").otherwise(F.col("s_name")), 256).alias("sha256"))
    return packages.attestation_violations(a, files)


_sql("v20_attestation", (), """
SELECT 'POLICY' AS rule_id, 'attestation' AS key, '' AS detail UNION ALL SELECT 'REPOSITORY_SPLIT', 'attestation', ''
UNION ALL SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'MISSING_FILE' ELSE 'CHECKSUM' END, 'p' || s_suppkey, sha256(s_name) FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 1""")


@_query
def a28_folder_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rule folders, each over the lengths, paths and digests of its YAML files in order."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("a"), (k % 3).cast("string"), F.when(k % 2 == 0, "-x/").otherwise("/"), k.cast("string"), F.when(k % 4 == 0, ".txt").when(k % 4 == 1, ".YML").otherwise(".yaml"))
    return packages.folder_digests(_table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (k % 20).cast("string")).alias("folder"), path.alias("path"), F.sha2("p_name", 256).alias("sha256")))


_sql("a28_folder_digests", (), """
SELECT folder, sha256(from_hex(string_agg(printf('%016X', octet_length(encode(path))) || hex(encode(path)) || sha256(p_name), '' ORDER BY string_split(path, '/')))) AS sha256 FROM (
  SELECT 'f' || p_partkey % 20 AS folder, 'a' || p_partkey % 3 || CASE WHEN p_partkey % 2 = 0 THEN '-x/' ELSE '/' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.YML' ELSE '.yaml' END AS path, p_name, p_partkey FROM part)
WHERE p_partkey % 4 <> 0 GROUP BY folder""")


@_query
def a27_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of an ordered inventory of files."""
    n = _table(spark, sf_dir, "customer")
    path = F.concat(F.lit("d"), (F.col("c_custkey") % 4).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "/raw-response-").otherwise("/step-"), "c_custkey")
    return packages.inventory_digest(n.select(path.alias("path"), F.sha2("c_name", 256).alias("sha256")))


_sql("a27_inventory", (), """
SELECT count(*) AS files, count(*) FILTER (path LIKE '%raw-response%') AS raw_responses, sha256('[' || string_agg('{"path":"' || path || '","sha256":"' || sha256(c_name) || '"}', ',' ORDER BY path) || ']') AS inventory_sha256
FROM (SELECT 'd' || c_custkey % 4 || CASE WHEN c_custkey % 3 = 0 THEN '/raw-response-' ELSE '/step-' END || c_custkey AS path, c_name FROM customer)""")


@_query
def a30_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each stage of a review has come."""
    r = V.flat(spark, sf_dir, "reviews")
    k = F.col("doc") % 8
    stage = F.element_at(F.array(*map(F.lit, ("reviewer-a", "reviewer-b", "final"))), (F.col("doc") % 3 + 1).cast("int"))
    done = F.col("doc") % 3 == 0
    cases = r.filter((k != 7) | done).select(stage.alias("stage"), "finding_id", F.when(done, "SUCCESS").when(k == 0, "FAILED").when(k == 1, "RUNNING").otherwise("SUCCESS").alias("status"))
    return packages.review_status(cases, r.groupBy(stage.alias("stage")).agg(F.count("*").alias("expected")).unionByName(_rows(spark, [("publish", 2)], "stage string, expected long")))


_sql("a30_review_status", ("reviews",), """
SELECT ['reviewer-a', 'reviewer-b', 'final'][doc % 3 + 1] AS stage, count(*) AS expected, count(*) FILTER (doc % 3 = 0 OR doc % 8 BETWEEN 2 AND 6) AS success, count(*) FILTER (doc % 3 > 0 AND doc % 8 = 0) AS failed,
  count(*) FILTER (doc % 3 > 0 AND doc % 8 = 1) AS running, count(*) FILTER (doc % 3 > 0 AND doc % 8 = 7) AS pending, count(*) = count(*) FILTER (doc % 3 = 0 OR doc % 8 BETWEEN 2 AND 6) AS complete FROM reviews GROUP BY 1
UNION ALL SELECT 'publish', 2, 0, 0, 0, 2, false""")


@_query
def p4_selected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of wanted ids, and the ids that have none."""
    r = V.flat(spark, sf_dir, "reviews").select("finding_id")
    ids = r.filter(F.substring("finding_id", -1, 1) == "3").unionByName(_rows(spark, [("lost",), ("lost",)], "finding_id string"))
    return packages.selected(r, ids).select(F.lit("SELECTED").alias("rule_id"), F.col("finding_id").alias("key"), F.lit("").alias("detail")).unionByName(packages.missing(r, ids))


_sql("p4_selected_records", ("reviews",), "SELECT 'MISSING_RECORD' AS rule_id, 'lost' AS key, '' AS detail UNION ALL SELECT 'SELECTED', finding_id, '' FROM reviews WHERE finding_id LIKE '%3'")


@_query
def p6_bounded_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings cut to a budget of characters: first the trace, then the texts."""
    d = _table(spark, sf_dir, "documents").filter("text is not null")
    node = F.struct(F.lit("a.py").alias("file"), F.lit("1").alias("line"), F.lit("d").alias("description"), F.repeat(F.lit("c"), 20).alias("code"))
    f = d.select("doc_id", F.substring("text", 1, 600).alias("message"), F.array_repeat(node, (F.col("doc_id") % 9).cast("int")).alias("dataflow_trace"), F.repeat(F.lit("s"), (F.col("doc_id") % 400).cast("int")).alias("snippet"))
    b = packages.bounded(f, 500)
    return b.select("doc_id", F.size("dataflow_trace").alias("nodes"), F.length("message").alias("message_chars"), F.length("snippet").alias("snippet_chars"), "fits")


@_query
def x49_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs of nested directories as plain names."""
    k = F.col("p_partkey") % 4
    p = _table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit("**/"), "p_name", F.lit("/**"))).when(k == 1, F.concat(F.lit("**/a/"), "p_name", F.lit("/**"))).when(k == 2, "**/x*/**").otherwise(F.col("p_name")).alias("glob"))
    return p.select("p_partkey", T.plain_exclude(F.col("glob")).alias("glob"))


_sql("x49_excludes", (), """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '**/a/' || p_name || '/**' WHEN 2 THEN '**/x*/**' ELSE p_name END AS glob FROM part""")


@_query
def x50_consensus_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewer that two participants make together."""
    n = _table(spark, sf_dir, "customer")
    who = lambda x: F.struct(F.lit("p").alias("provider"), F.concat(F.lit(x), "c_custkey").alias("provider_version"), F.concat(F.lit(x), "c_name").alias("model"), F.lit(x).alias("model_version"))
    r = n.select("c_custkey", packages.consensus_reviewer(who("a"), who("b")).alias("r"))
    return r.select("c_custkey", "r.id", "r.role", "r.provider_version", "r.model", "r.model_version", F.size("r.participants").alias("participants"))


_sql("x50_consensus_reviewer", (), """
SELECT c_custkey, 'reviewer-a+reviewer-b' AS id, 'CONSENSUS_A_B' AS role, sha256('["a' || c_custkey || '","b' || c_custkey || '"]') AS provider_version, 'a' || c_name || '+b' || c_name AS model, 'a+b' AS model_version, 2 AS participants FROM customer""")


# --- files, orders and gates that break ---------------------------------------


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines made of customers, in three files: objects, a list, words, and blank lines."""
    k = F.col("c_custkey")
    line = F.when(k % 5 == 1, '[1]').when(k % 5 == 2, "no json").when(k % 5 == 3, " ").otherwise(F.concat(F.lit('{"n": '), k.cast("string"), F.lit(', "name": "'), "c_name", F.lit('"}')))
    path = scratch.folder(spark, "lines")
    _table(spark, sf_dir, "customer").select(line.alias("value"), (k % 3).alias("g")).repartition("g").write.partitionBy("g").text(path)
    return path


@_query
def s3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON as rows; those without an object keep their text."""
    return jsonl.read_jsonl(spark, _json_lines(spark, sf_dir), "n int, name string").select("n", "name", F.col(jsonl.CORRUPT).alias("corrupt"))


_sql("s3_json_lines", (), """
SELECT CASE WHEN c_custkey % 5 IN (0, 4) THEN CAST(c_custkey AS INTEGER) END AS n, CASE WHEN c_custkey % 5 IN (0, 4) THEN c_name END AS name,
  CASE c_custkey % 5 WHEN 1 THEN '[1]' WHEN 2 THEN 'no json' END AS corrupt FROM customer WHERE c_custkey % 5 <> 3""")


@_query
def s5_line_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps lines of JSON, and their files, from being read under a profile's limits."""
    v = jsonl.line_violations(spark, f"{_json_lines(spark, sf_dir)}/g=*/part-*", limits=jsonl.Limits(file_bytes=10, line_bytes=39, rows=3))
    return v.select("rule_id", F.when(F.col("rule_id") == "FILE_TOO_LARGE", "").otherwise(F.col("detail")).alias("detail"))


_sql("s5_line_gate", (), """
WITH l AS (SELECT CASE c_custkey % 5 WHEN 1 THEN '[1]' WHEN 2 THEN 'no json' WHEN 3 THEN ' ' ELSE '{"n": ' || c_custkey || ', "name": "' || c_name || '"}' END AS v, c_custkey % 5 AS k, c_custkey % 3 AS g FROM customer)
SELECT 'NOT_AN_OBJECT' AS rule_id, v AS detail FROM l WHERE k IN (1, 2) UNION ALL SELECT 'LINE_TOO_LONG', v FROM l WHERE octet_length(encode(v)) > 39
UNION ALL SELECT 'TOO_MANY_ROWS', '' || count(*) FROM l WHERE k <> 3 GROUP BY g UNION ALL SELECT 'FILE_TOO_LARGE', '' FROM l GROUP BY g""")


@_query
def k3_written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as canonical JSON lines, and one document, as their files hold them."""
    n = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("z"), F.col("c_custkey").alias("a"), F.lit(None).cast("string").alias("m"))
    lines, document = scratch.folder(spark, "written"), scratch.folder(spark, "document")
    jsonl.write_jsonl(n, lines, "a")
    jsonl.write_document(n.agg(F.count("*").alias("rows"), F.max("a").alias("last")), document)
    files = spark.read.text(f"{document}/part-*", wholetext=True)
    return spark.read.text(f"{lines}/part-*").select(F.lit("line").alias("kind"), "value").unionByName(files.select(F.lit("document").alias("kind"), F.regexp_replace("value", "\n$", "").alias("value")))


_sql("k3_written_lines", (), """
SELECT 'line' AS kind, '{"a":' || c_custkey || ',"m":null,"z":"' || c_name || '"}' AS value FROM customer
UNION ALL SELECT 'document', '{"last":' || max(c_custkey) || ',"rows":' || count(*) || '}' FROM customer""")


@_query
def x3_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, bytes and records of files, against what a manifest states of them."""
    k = F.floor(F.col("c_custkey") / 64)
    path = scratch.folder(spark, "files")
    texts = _table(spark, sf_dir, "customer").groupBy(k.alias("k")).agg(F.array_join(F.sort_array(F.collect_list("c_name")), "\n").alias("value"))
    texts.repartition("k").write.partitionBy("k").text(path)
    found = jsonl.manifest(spark, f"{path}/*/part-*")
    key = F.regexp_extract("path", r"/k=(\d+)/", 1)
    return found.select(key.alias("k"), "sha256", "bytes", "records")


_sql("x3_file_digests", (), """
SELECT '' || c_custkey // 64 AS k, sha256(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS sha256, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS bytes, count(*) AS records FROM customer GROUP BY c_custkey // 64""")


@_query
def v21_manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose digest or number of records is not what their manifest states, and a run that is no official corpus."""
    n = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stated = n.select(F.col("c_name").alias("path"), F.sha2("c_name", 256).alias("sha256"), k.alias("records"))
    found = n.filter(k % 6 != 0).select(F.col("c_name").alias("path"), F.sha2(F.when(k % 4 == 1, "x").otherwise(F.col("c_name")), 256).alias("sha256"), F.when(k % 7 == 1, 99).otherwise(k).alias("records"))
    run = _rows(spark, [("COMPLETE", None, "Customer#000000006", "0", 1)], "status string, complete boolean, path string, sha256 string, records long")
    return gates.manifest_differences(stated, found).unionByName(gates.corpus_violations(run, found, n))


_sql("v21_manifest_differences", (), """
SELECT unnest(CASE WHEN c_custkey % 6 = 0 THEN ['MISSING_FILE'] ELSE list_filter([CASE WHEN c_custkey % 4 = 1 THEN 'SHA256' END, CASE WHEN c_custkey % 7 = 1 AND c_custkey <> 99 THEN 'RECORDS' END], lambda x: x IS NOT NULL) END) AS rule_id,
  c_name AS key, '' AS detail FROM customer UNION ALL SELECT unnest(['NOT_COMPLETE', 'SHA256', 'RECORDS']), 'Customer#000000006', ''""")


@_query
def s14_ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and pointers of a scan ledger that disagree."""
    a = V.attempts(spark, sf_dir).withColumns({"folder_number": F.col("attempt") + (F.col("event_id") % 50 == 3).cast("int"), "file": F.concat(F.lit("a/"), "event_id")})
    k = F.col("event_id") % 50
    p = ledger.latest(a).select(
        F.when(k == 4, "scan-x").otherwise(F.col("scan_id")).alias("scan_id"), "repo_url", "commit", "scanner", F.when(k == 5, "LOST").otherwise(F.col("status")).alias("status"),
        F.when(k == 6, 99).otherwise(F.col("attempt")).alias("attempt"), F.when(k == 7, "../x").otherwise("attempts/0001/status.json").alias("attempt_status"), F.concat(F.lit("p/"), "event_id").alias("file"), k.alias("k"),
    )
    return ledger_files.violations(a, p.unionByName(p.filter("k = 8")))


_sql("s14_ledger_gate", ("attempts",), """
SELECT 'ATTEMPT_NUMBER' AS rule_id, 'a/' || event_id AS key, '' || n AS detail FROM x WHERE event_id % 50 = 3
UNION ALL SELECT CASE event_id % 50 WHEN 4 THEN 'SCAN_ID_DIFFERS' WHEN 5 THEN 'STATUS_DIFFERS' WHEN 6 THEN 'POINTER_WITHOUT_ATTEMPT' ELSE 'PATH_OUTSIDE' END, 'p/' || event_id,
  CASE WHEN event_id % 50 = 7 THEN '../x' ELSE 'attempts/0001/status.json' END FROM x WHERE n = last AND event_id % 50 IN (4, 5, 6, 7)
UNION ALL SELECT 'REPEATED_JOB', repo || ' ' || commit_sha || ' ' || scanner, '2' FROM x WHERE n = last AND event_id % 50 = 8""",
     """x AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, scanner ORDER BY event_id) AS n, count(*) OVER (PARTITION BY repo, commit_sha, scanner) AS last FROM attempts)""")  # fmt: skip


@_query
def v26_resume_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes that were made from other inputs than those of now."""
    a = V.attempts(spark, sf_dir).withColumns({"ruleset": F.lit("r1"), "profile": F.concat(F.lit("p"), F.col("event_id") % 3)})
    now = a.select("repo_url", "commit", "scanner").distinct().withColumns({"ruleset": F.when(F.col("scanner") == "click", "r2").otherwise("r1"), "profile": F.lit("p0")})
    return ledger.resume_conflicts(a, now, "ruleset", "profile")


_sql("v26_resume_conflicts", ("attempts",), """
SELECT repo AS repo_url, commit_sha AS commit, scanner, unnest(list_filter([CASE WHEN scanner = 'click' THEN 'ruleset' END, CASE WHEN event_id % 3 <> 0 THEN 'profile' END], lambda x: x IS NOT NULL)) AS input
FROM (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY repo, commit_sha, scanner ORDER BY event_id DESC) = 1) WHERE status = 'SUCCESS'""")


@_query
def p2_o7_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen snapshots in order, the first three, and filters that no snapshot has."""
    s = V.findings(spark, sf_dir).select(T.normalize_repo(F.col("repo_url")).alias("repo_url"), T.normalize_commit(F.col("commit")).alias("commit")).distinct()
    repos = [f"https://github.com/acme/r{n}.git/" for n in (0, 5, 10, 15, 20, 999_999)]
    chosen = ledger.select_snapshots(s, repos, None, 3)
    return chosen.select(F.lit("CHOSEN").alias("rule_id"), F.col("repo_url").alias("key"), F.col("commit").alias("detail")).unionByName(ledger.unused_filters(s, repos, ["0" * 40]))


_sql("p2_o7_snapshots", ("findings",), """
SELECT 'CHOSEN' AS rule_id, repo AS key, commit_sha AS detail FROM (SELECT DISTINCT repo, commit_sha FROM findings WHERE repo IN (SELECT 'https://github.com/acme/r' || n FROM (SELECT unnest([0, 5, 10, 15, 20]) AS n)) ORDER BY 1, 2 LIMIT 3)
UNION ALL SELECT 'UNUSED_REPOSITORY', 'https://github.com/acme/r' || n || '.git/', '' FROM (SELECT unnest([0, 5, 10, 15, 20, 999999]) AS n) WHERE 'https://github.com/acme/r' || n NOT IN (SELECT repo FROM findings)
UNION ALL SELECT 'UNUSED_COMMIT', '0000000000000000000000000000000000000000', ''""")


@_query
def o1_o2_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each finding in its file, by the order of findings."""
    from pyspark.sql import Window as W

    f = findings.keyed(findings.ordered(V.findings(spark, sf_dir))).withColumn("k", findings.sort_key())
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), F.row_number().over(W.partitionBy("repo_n", "path_n").orderBy("k")).alias("place"))


_sql("o1_o2_orders", ("findings",), f"""
SELECT ref, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY commit_sha, start_line, end_line, coalesce(start_col, -1), coalesce(end_col, -1), scanner, version, lower(rule_id), id, ref) AS INTEGER) AS place
FROM (SELECT *, {_ID} AS id FROM findings)""")


@_query
def o9_trace_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last nodes of long traces, and texts cut with a mark."""
    d = V.flat(spark, sf_dir, "reviews")
    node = lambda n: F.struct(F.lit("a.py").alias("file"), n.cast("string").alias("line"), F.lit("d").alias("description"), F.repeat(F.lit("c"), n).alias("code"))
    f = d.select("finding_id", F.lit("long message").alias("message"), F.lit("s").alias("snippet"), F.transform(F.sequence(F.lit(1), (F.col("doc") % 20 + 1).cast("int")), node).alias("dataflow_trace"))
    m = reviews.for_model(f, head=3, tail=2, message=7, code=6, mark="..")
    return m.select("finding_id", "message", "omitted_trace_nodes", F.array_join(F.transform("dataflow_trace", lambda n: F.concat_ws(":", n["line"], n["code"])), ",").alias("trace"))


_sql("o9_trace_ends", ("reviews",), """
SELECT finding_id, 'long ..' AS message, CAST(greatest(0, n - 5) AS INTEGER) AS omitted_trace_nodes,
  array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: n <= 5 OR i <= 3 OR i > n - 2), lambda i: i || ':' || CASE WHEN i > 6 THEN 'cccc..' ELSE repeat('c', i) END), ',') AS trace
FROM (SELECT finding_id, doc % 20 + 1 AS n FROM reviews)""")


@_query
def x4_finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of findings from their place, rule and snapshot alone."""
    f = findings.keyed(V.findings(spark, sf_dir))
    place = F.col("location").withField("file", F.col("path_n"))
    return f.select(F.col("provenance.raw_result_ref").alias("ref"), finding_id(F.col("repo_n"), F.col("commit_n"), F.col("scanner_n"), F.col("rule_n"), place, F.col("ruleset_n")).alias("id"))


_sql("x4_finding_ids", ("findings",), """
SELECT ref, 'finding-' || sha256('{"commit":"' || commit_sha || '","location":{"end_col":' || coalesce('' || end_col, 'null') || ',"end_line":' || end_line || ',"file":"' || file || '","start_col":' || coalesce('' || start_col, 'null')
  || ',"start_line":' || start_line || '},"repo_url":"' || repo || '","rule_id":"' || lower(rule_id) || '","ruleset_commit":"' || ruleset || '","scanner":"' || scanner || '"}') AS id FROM findings""")


@_query
def x28_x29_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uris and absolute paths relative to a root, whatever the root's case."""
    p = _table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("file:///C:/Work/a%20b/"), name)).when(k % 4 == 1, F.concat(F.lit("c:\\work\\"), name)).when(k % 4 == 2, F.concat(F.lit("file:///tmp/x+y/"), name)).otherwise(F.concat(F.lit("./src//"), name))
    return p.select("p_partkey", T.relative_path(raw, "C:\\Work\\").alias("path"))


_sql("x28_x29_paths", (), """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a b/' WHEN 1 THEN '' WHEN 2 THEN '/tmp/x+y/' ELSE 'src/' END || 'f' || p_partkey AS path FROM part""")


@_query
def x42_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each labelled finding is to the one of the next number."""
    m = V.machine(spark, sf_dir)
    n = F.regexp_extract("finding_id", r"(\d+)$", 1).cast("long")
    a, b = m.select("finding_id", "features", (n + 1).alias("n")), m.select(F.col("finding_id").alias("other"), F.col("features").alias("theirs"), n.alias("n"))
    return a.join(b, "n").select("finding_id", "other", dataset.similarity(F.col("features"), F.col("theirs")).alias("score"))


_sql("x42_similarity", ("gold",), """
SELECT a.finding_id, b.finding_id AS other, CAST(16 * (a.repository = b.repository)::INT + 8 * (a.rule_id = b.rule_id)::INT + 4 * coalesce(list_has_any(list_filter([a.cwe_a, a.cwe_b], lambda x: x IS NOT NULL), list_filter([b.cwe_a, b.cwe_b], lambda x: x IS NOT NULL)), false)::INT
  + 2 * (a.language = b.language)::INT + (a.has_dataflow = b.has_dataflow)::INT AS INTEGER) AS score
FROM gold a JOIN gold b ON CAST(substr(b.finding_id, 9) AS BIGINT) = CAST(substr(a.finding_id, 9) AS BIGINT) + 1""")


@_query
def x47_usage_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters under common names, details objects and negative numbers among them, and their sums."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    given = F.create_map(F.lit("promptTokenCount"), k % 7 - 1, F.lit("output_tokens"), k % 5, F.lit("input_tokens_details.cached_tokens"), k % 3, F.lit("other"), k)
    runs = e.select((k % 4).alias("run"), usage.normalized(given).alias("usage"))
    return usage.totals(runs, ["run"])


_sql("x47_usage_details", (), """
SELECT run, counter, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_id % 4 AS run, unnest(['input_tokens', 'output_tokens', 'cached_input_tokens']) AS counter, unnest([event_id % 7 - 1, event_id % 5, event_id % 3]) AS n FROM events) WHERE n >= 0 GROUP BY 1, 2""")


@_query
def a26_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each split against its target; one split has nothing."""
    rows = _labelled(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, ("train", "validation"))), F.substring("features.repository", 2, 9).cast("int") % 2 + 1)
    chosen = rows.select(names.alias("split"), "finding_id", F.col("machine_reference.label").alias("class"))
    return dataset.split_counts(chosen, {"train": 3, "validation": 2, "test": 0})


_sql("a26_split_counts", ("gold",), """
SELECT s AS split, count(lab) FILTER (lab = 'MACHINE_TRUE_POSITIVE') AS positives, count(lab) FILTER (lab = 'MACHINE_FALSE_POSITIVE') AS negatives,
  count(lab) FILTER (lab = 'MACHINE_TRUE_POSITIVE') = any_value(t) AND count(lab) FILTER (lab = 'MACHINE_FALSE_POSITIVE') = any_value(t) AS balanced
FROM (SELECT unnest(['train', 'validation', 'test']) AS s, unnest([3, 2, 0]) AS t) LEFT JOIN (SELECT lab, ['train', 'validation'][CAST(substr(repository, 2) AS INTEGER) % 2 + 1] AS s FROM e) USING (s) GROUP BY s""", _LABELLED)


@_query
def p14_agent_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind packets of the findings of a split."""
    r = V.flat(spark, sf_dir, "reviews")
    return dataset.agent_input(r.select("finding_id", "source"), V.gold(spark, sf_dir).filter("label = 'FP_CONFIRMED'"))


_sql("p14_agent_input", ("gold", "reviews"), "SELECT finding_id, source FROM reviews WHERE finding_id IN (SELECT finding_id FROM gold WHERE label = 'FP_CONFIRMED')")


@_query
def j22_j23_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the languages of all sources call for, and the folders that sources name for themselves."""
    d = _table(spark, sf_dir, "documents").select("source", "lang").distinct()
    configs = rules.routes(spark, {"en": ["f0", "f1"], "de": ["f2"], "fr": ["f1"]})
    k = F.col("p_partkey")
    files = _table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (k % 5).cast("string")).alias("folder"), F.concat(F.lit("x"), k.cast("string")).alias("file"), F.lit(1).alias("line"), F.concat(F.lit("rule-"), (k % 30).cast("string")).alias("rule_id"))
    found = rules.assembled_inventory(d.filter("lang <> 'es'").select(F.col("lang").alias("language")), configs, files)
    snapshots = d.select(F.col("source").alias("repo_url"), F.lit("c").alias("commit")).distinct().withColumn("languages", F.when(F.crc32("repo_url") < 0, F.array(F.lit("x"))).otherwise(F.when(F.length("repo_url") % 2 == 0, F.array(F.lit(" ENGLISH "), F.lit("de"))).otherwise(F.array().cast("array<string>"))))
    detected = d.select(F.col("source").alias("repo_url"), F.lit("c").alias("commit"), F.col("lang").alias("language"))
    routed = rules.snapshot_configs(snapshots, detected, configs, rules.routes(spark, {"en": ["own"], "de": ["own", "f2"]}), {"english": "en"})
    return found.select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), F.array_join("files", ",").alias("value")).unionByName(routed.select(F.lit("folder").alias("kind"), F.col("repo_url").alias("name"), F.col("folder").alias("value")))


_sql("j22_j23_inventory", (), """
SELECT 'rule' AS kind, 'rule-' || p_partkey % 30 AS name, string_agg('x' || p_partkey, ',' ORDER BY 'x' || p_partkey) AS value FROM part
WHERE p_partkey % 5 IN (SELECT f FROM (SELECT unnest(['en', 'en', 'de', 'fr']) AS l, unnest([0, 1, 2, 1]) AS f) WHERE l IN (SELECT lang FROM documents)) GROUP BY 2
UNION ALL SELECT DISTINCT 'folder', source, unnest(['own', 'f2']) FROM documents WHERE length(source) % 2 = 0
UNION ALL SELECT DISTINCT 'folder', source, f FROM documents JOIN (SELECT unnest(['en', 'en', 'de', 'fr']) AS l, unnest(['f0', 'f1', 'f2', 'f1']) AS f) ON l = lang WHERE length(source) % 2 = 1""")


@_query
def s29_s21_evidence_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of each document in ranges of 25 lines, with identifiers redacted, while they fit a case's budget."""
    ls = _lines(spark, sf_dir)
    wanted = ls.groupBy("doc_id").agg(F.max("n").alias("last")).select("doc_id", F.lit(1).alias("start"), F.least("last", F.lit(60)).cast("int").alias("end"))
    cut = reviews.in_ranges(wanted)
    read = code.slices(cut, ls, ["doc_id"], numbered=True).withColumn("slice", T.redact_ids(F.col("slice")))
    kept = code.within_budget(read, 4000, key="doc_id", order="start")
    return kept.select("doc_id", "start", "end", F.sha2("slice", 256).alias("sha256"))


_sql("s29_s21_evidence_reads", (), """
SELECT doc_id, s AS start, e AS "end", sha256(t) AS sha256 FROM (
  SELECT doc_id, s, e, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY s) AS used FROM (
    SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(max(n) AS INTEGER) AS e, string_agg(n || ': ' || x, chr(10) ORDER BY n) AS t FROM (
      SELECT doc_id, n, x, (n - 1) // 25 * 25 + 1 AS s FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS n FROM (
        SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL))) WHERE n <= 60) GROUP BY 1, 2))
WHERE used <= 4000""")


@_query
def v15_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose code is not the source text at its place."""
    ls = _lines(spark, sf_dir).select(F.lit("r").alias("repo_url"), F.lit("c").alias("commit"), F.col("doc_id").cast("string").alias("file"), "n", "text")
    first = ls.filter("n = 1")
    k = F.col("file").cast("long") % 4
    said = F.when(k == 1, F.col("text")).otherwise(F.concat(F.lit("1: "), "text"))
    node = F.struct("file", F.when(k == 2, "x").when(k == 3, "900000").otherwise("1").alias("line"), F.lit("d").alias("description"), T.redact_ids(said).alias("code"))
    cited = first.select(F.col("file").alias("finding_id"), "repo_url", "commit", F.lit(0).alias("position"), node.alias("node"), k.alias("k"))
    wrong = reviews.evidence_errors(cited.drop("k"), ls)
    return cited.select("finding_id", "k").join(wrong, "finding_id", "left").groupBy("k").agg(F.count("*").alias("cited"), F.count("position").alias("wrong"))


_sql("v15_evidence_gate", (), """
SELECT doc_id % 4 AS k, count(*) AS cited, count(*) FILTER (doc_id % 4 > 0) AS wrong FROM documents WHERE text <> '' GROUP BY 1""")


@_query
def a21_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, partly parsed files, findings and scanned paths of each job's raw reports."""
    p = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    error = F.when(k % 3 == 0, F.concat(F.lit('{"type":["PartialParsing",[]],"spans":[{"file":"f'), (k % 7).cast("string"), F.lit('.py"}]}'))).otherwise('{"type":"Timeout","path":"x.py"}')
    r = p.select(
        F.concat(F.lit("r"), "job").alias("repo_url"), F.lit("c").alias("commit"), F.lit("s").alias("scanner"), F.when(k % 5 == 0, F.array(error)).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.array_repeat(F.lit("{}"), (k % 4).cast("int")).alias("results"), F.struct(F.array_repeat(F.lit("p"), (k % 2).cast("int")).alias("scanned")).alias("paths"),
    )
    d = ledger.diagnostics(r)
    return d.select("repo_url", "errors_total", F.array_join("partial_parsing_files", ",").alias("partial"), "findings", "scanned_paths")


_sql("a21_diagnostics", (), """
SELECT 'r' || job AS repo_url, count(*) FILTER (k % 5 = 0) AS errors_total, coalesce(string_agg(DISTINCT 'f' || k % 7 || '.py', ',' ORDER BY 'f' || k % 7 || '.py') FILTER (k % 15 = 0), '') AS partial,
  CAST(sum(k % 4) AS BIGINT) AS findings, CAST(sum(k % 2) AS BIGINT) AS scanned_paths FROM p GROUP BY job""", _PARTS)


@_query
def v11_v12_blind_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with blind inputs: forbidden columns, malformed and repeated findings, leaks, too many rows."""
    f = reviews.blind(V.findings(spark, sf_dir)).withColumns({"finding_id": F.col("provenance.raw_result_ref"), "repo_url": T.normalize_repo(F.col("repo_url")), "commit": T.normalize_commit(F.col("commit"))})
    n = F.col("location.start_line")
    f = f.withColumns({
        "repo_url": F.when(n == 1, "http://x").otherwise(F.col("repo_url")), "commit": F.when(n == 2, "abc").otherwise(F.col("commit")), "message": F.when(n == 4, "see CVE-2020-1234").otherwise(F.col("message")),
        "location": F.when(n == 3, F.col("location").withField("file", F.lit("a/../b"))).otherwise(F.col("location")), "dataflow_trace": F.when(n == 5, F.transform("dataflow_trace", lambda x: x.withField("line", F.lit("0")))).otherwise(F.col("dataflow_trace")),
        "gold_label": F.lit("x"),
    })
    again = f.filter(n == 6).unionByName(f)
    return gates.blind_inputs(again, 100)


_sql("v11_v12_blind_gate", ("findings",), """
SELECT 'FORBIDDEN_KEY' AS rule_id, '$.gold_label' AS key, '' AS detail UNION ALL SELECT 'TOO_MANY_ROWS', '', '' || (count(*) + count(*) FILTER (start_line = 6)) FROM findings HAVING count(*) > 100
UNION ALL SELECT ['REPO_URL', 'COMMIT', 'PATH', 'ADVISORY_ID'][start_line], ref, CASE WHEN start_line = 4 THEN '$.message' ELSE '' END FROM findings WHERE start_line <= 4
UNION ALL SELECT 'TRACE', ref, '' FROM findings WHERE start_line = 5 AND trace_file IS NOT NULL UNION ALL SELECT 'REPEATED_ID', ref, '2' FROM findings WHERE start_line = 6""")


@_query
def v4_v7_machine_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps machine labels and predictions from a metric: fields, roles, independence, provenance and evidence."""
    g = V.flat(spark, sf_dir, "gold").select("finding_id", F.col("machine_label").alias("label"), (F.regexp_extract("finding_id", r"(\d+)$", 1).cast("long") % 40).alias("k"))
    k, false = F.col("k"), F.col("label") == "MACHINE_FALSE_POSITIVE"
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    node = lambda line: F.array(F.struct(F.lit("a.py").alias("file"), F.lit(line).alias("line"), F.lit("d").alias("description"), F.lit("c").alias("code")))
    both = k < 20
    labels = g.select(
        "finding_id", F.when(k == 1, "NONE").otherwise(F.col("label")).alias("label"), F.when(k == 2, "SURE").otherwise("HIGH").alias("confidence"),
        F.when(false & (k != 3), strings("CONSTANT_VALUE")).otherwise(strings()).alias("reason_codes"), F.when(k == 4, "").otherwise("why").alias("reasoning"), F.when(k == 5, node("0")).otherwise(node("1")).alias("evidence"),
        F.when(F.col("label") == "MACHINE_UNCERTAIN", "unclear").alias("uncertainty_reason"),
        F.struct(
            F.when(k == 6, "OTHER").when(both, "CONSENSUS_A_B").otherwise("ADJUDICATOR_C").alias("role"), F.when(both & (k != 7), strings("a", "b")).when(both, strings("a", "a")).otherwise(strings("c")).alias("ids"),
            F.when(both, strings("m", "n")).otherwise(strings("o")).alias("models"),
        ).alias("reviewer"),
        F.when(k == 8, "2026-01-01").otherwise("2026-01-01T00:00:00Z").alias("reviewed_at"),
        F.struct(
            (~both).alias("blind_first"), F.when(both, strings()).otherwise(strings("ANY")).alias("route_reasons"), F.when(~both, F.lit("a" * 64)).alias("blind_sha256"),
            F.when(~both, F.when(k == 21, "short").otherwise("b" * 64)).alias("final_sha256"),
        ).alias("provenance"),
        F.when(k == 9, strings("entry-1")).otherwise(strings()).alias("linked_entry_ids"),
    )
    p = V.flat(spark, sf_dir, "reviews").select("finding_id", F.col("verdict").alias("verdict"))
    return gates.machine_inputs(labels, p.join(g.filter("k != 10").select("finding_id"), "finding_id", "left_semi"))


_sql("v4_v7_machine_gate", ("gold",), """
SELECT unnest(list_filter([CASE WHEN k = 1 THEN 'LABEL' END, CASE WHEN k = 2 THEN 'CONFIDENCE' END, CASE WHEN k = 3 AND machine_label = 'MACHINE_FALSE_POSITIVE' THEN 'FALSE_FIELDS' END, CASE WHEN k = 4 THEN 'REASONING' END,
    CASE WHEN k = 5 THEN 'EVIDENCE_NODE' END, CASE WHEN k = 6 THEN 'ROLE' END, CASE WHEN k = 7 THEN 'CONSENSUS' END, CASE WHEN k = 8 THEN 'REVIEWED_AT' END, CASE WHEN k = 9 THEN 'LINKED_BEFORE_FREEZE' END, CASE WHEN k = 21 THEN 'ADJUDICATOR' END], lambda x: x IS NOT NULL)) AS rule_id,
  finding_id AS key, CASE WHEN k = 1 THEN 'NONE' ELSE machine_label END AS detail FROM g
UNION ALL SELECT 'MISSING_PREDICTION', finding_id, '' FROM g WHERE k = 10 OR finding_id NOT IN (SELECT 'finding-' || doc_id FROM documents)""",
     "g AS (SELECT finding_id, machine_label, CAST(substr(finding_id, 9) AS BIGINT) % 40 AS k FROM gold)")


# --- raw reports ------------------------------------------------------------




def _write_reports(parts: DataFrame, document: Column, name: str) -> tuple[str, DataFrame]:
    """Write one file of JSON for each group of parts; returns the files' glob and the table of their jobs."""
    spark = parts.sparkSession
    path = scratch.folder(spark, name)
    rows = parts.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))).alias("rs")).withColumn("rs", F.transform("rs", lambda x: x["r"]))
    rows.select("job", document.alias("value")).repartition("job").write.option("maxRecordsPerFile", 1).partitionBy("job").text(path)
    files = spark.read.schema("value string").text(f"{path}/*/*").select(F.col("_metadata.file_path").alias("source_file")).distinct()
    job = F.regexp_extract("source_file", r"/job=(\d+)/", 1).cast("int")
    jobs = files.withColumn("job", job).select(
        "source_file", F.concat(F.lit("https://github.com/acme/x"), "job", F.lit(".git/")).alias("repo_url"), F.left(F.sha2(F.col("job").cast("string"), 256), F.lit(40)).alias("commit"),
        F.lit("semgrep").alias("scanner"), F.lit("1.0.0").alias("version"), F.lit("b" * 40).alias("ruleset_commit"), F.concat(F.lit("scan-"), "job").alias("scan_id"),
        F.concat(F.lit("raw/"), "job", F.lit(".json")).alias("ref"), F.lit("C:\\work").alias("source_root"), F.lit("/home/rules").alias("ruleset_root"),
    )
    return f"{path}/*/*", jobs


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").withColumn("job", F.floor(F.col("p_partkey") / _PER_REPORT).cast("int"))


def _raw_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scanner's JSON reports made of parts, read from their files, and their jobs. Some results lack a rule or a place."""
    p = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    place = lambda line: F.struct(line.alias("line"), F.lit(3).alias("col"))
    at = lambda line: F.struct(F.lit("src/t.py").alias("path"), place(line).alias("start"), place(line + 1).alias("end"))
    text = lambda x: F.to_json(x)
    source = F.concat(F.lit('["CliLoc",['), text(at(k % 7 + 1)), F.lit(',"src()"]]'))
    between = F.when(k % 3 == 0, F.concat(F.lit("["), text(F.struct(at(k % 5).alias("location"), F.lit("v").alias("content"))), F.lit("]"))).otherwise("[]")
    sink = F.concat(F.lit('["CliCall",[['), text(at(k % 9 + 1)), F.lit(',"sink()"],[],[]]]'))
    trace = F.when(k % 2 == 0, F.concat(F.lit('{"taint_source":'), source, F.lit(',"intermediate_vars":'), between, F.lit(',"taint_sink":'), sink, F.lit("}"))).otherwise("null")
    result = F.to_json(
        F.struct(
            F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("home.rules.python."), "p_type")).alias("check_id"), F.concat(F.lit("C:\\work\\.\\src\\f"), k.cast("string"), F.lit(".py")).alias("path"),
            place(F.when(k % 19 == 0, 0).otherwise(k % 40 + 1)).alias("start"), place(k % 40 + k % 3).alias("end"),
            F.struct(
                F.col("p_name").alias("message"), F.lit("ERROR").alias("severity"), F.when(k % 2 == 0, "requires login").otherwise("x  =  1").alias("lines"),
                F.lit("FP").alias("fingerprint"), F.struct(F.array(F.lit("CWE-78: text"), F.lit("CWE-0022")).alias("cwe"), F.array(F.lit("b"), F.lit(" a ")).alias("category")).alias("metadata"),
                F.lit("@trace@").alias("dataflow_trace"),
            ).alias("extra"),
        )
    )
    whole = F.replace(result, F.lit('"@trace@"'), trace)
    version = F.when(F.col("job") % 3 == 2, "0.9").otherwise("1.0.0")
    document = F.concat(F.lit('{"version":"'), version, F.lit('","results":['), F.array_join("rs", ","), F.lit('],"errors":[],"paths":{"scanned":[]}}'))
    path, jobs = _write_reports(p.withColumn("r", whole), document, "reports")
    return reports.read_scanner_json(spark, path), jobs


_RAW_REF = "'raw/' || job || '.json#results/' || pos"
_SOUND = "k % 17 <> 0 AND k % 19 <> 0"


@_query
def s9_scanner_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of raw reports, each in the context of its own job."""
    f = reports.findings_of_json(*_raw_reports(spark, sf_dir))
    return f.select(
        F.col("provenance.raw_result_ref").alias("ref"), "repo_url", "commit", "provenance.scan_id", F.col("rule.id").alias("rule_id"), F.array_join("rule.cwe", ",").alias("cwe"),
        F.col("rule.category").alias("category"), "location.file", "location.start_line", "location.end_line", "location.start_col", "snippet", "fingerprint",
    )


_sql("s9_scanner_json", (), f"""
SELECT {_RAW_REF} AS ref, 'https://github.com/acme/x' || job AS repo_url, substr(sha256('' || job), 1, 40) AS commit, 'scan-' || job AS scan_id, 'python.' || p_type AS rule_id,
  'CWE-22,CWE-78' AS cwe, 'a, b' AS category, 'src/f' || k || '.py' AS file, CAST(k % 40 + 1 AS INTEGER) AS start_line, CAST(greatest(k % 40 + k % 3, k % 40 + 1) AS INTEGER) AS end_line, 3 AS start_col,
  CASE WHEN k % 2 = 1 THEN 'x  =  1' END AS snippet, CASE WHEN k % 2 = 1 THEN sha256('x = 1') ELSE 'FP' END AS fingerprint FROM p WHERE {_SOUND}""", _PARTS)


@_query
def s12_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace nodes of raw results, in order."""
    f = reports.findings_of_json(*_raw_reports(spark, sf_dir))
    n = f.select(F.col("provenance.raw_result_ref").alias("ref"), F.posexplode("dataflow_trace").alias("position", "n"))
    return n.select("ref", "position", "n.file", "n.line", "n.description", "n.code")


_sql("s12_traces", (), f"""
SELECT ref, CAST(row_number() OVER (PARTITION BY ref ORDER BY o) - 1 AS INTEGER) AS position, 'src/t.py' AS file, line || '-' || (line + 1) AS line, description, code FROM (
  SELECT {_RAW_REF} AS ref, 1 AS o, k % 7 + 1 AS line, 'source' AS description, 'CliLoc' AS code FROM p WHERE {_SOUND} AND k % 2 = 0
  UNION ALL SELECT {_RAW_REF}, 2, k % 5, 'intermediate', 'v' FROM p WHERE {_SOUND} AND k % 6 = 0 AND k % 5 > 0
  UNION ALL SELECT {_RAW_REF}, 3, k % 9 + 1, 'sink', 'CliCall' FROM p WHERE {_SOUND} AND k % 2 = 0)""", _PARTS)


@_query
def s30_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every job's findings, read together; the findings of two formats make one table."""
    own = reports.findings_of_json(*_raw_reports(spark, sf_dir)).unionByName(reports.findings_of_sarif(*_sarif_reports(spark, sf_dir)))
    return findings.by_job(own)


_sql("s30_fan_in", (), f"""
SELECT repo_url, commit, 'semgrep' AS scanner, count(*) AS findings, count(DISTINCT rule) AS unique_rules, count(DISTINCT file) AS unique_files, count(*) FILTER (traced) AS with_trace FROM (
  SELECT 'https://github.com/acme/x' || job AS repo_url, substr(sha256('' || job), 1, 40) AS commit, 'python.' || p_type AS rule, 'src/f' || k || '.py' AS file, k % 2 = 0 AS traced FROM p WHERE {_SOUND}
  UNION ALL SELECT 'https://github.com/acme/x' || job, substr(sha256('' || job), 1, 40), 'r' || k % 5, 'src/s' || k % 50 || '.py', k % 2 = 0 FROM p WHERE k % 11 <> 0) GROUP BY 1, 2""", _PARTS)


def _sarif_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """SARIF reports made of parts, read from their files, and their jobs. Some results have no place."""
    k = F.col("p_partkey")
    spot = lambda line: F.struct(
        F.struct(F.concat(F.lit("file:///C:/work/src/s"), (k % 50).cast("string"), F.lit(".py")).alias("uri")).alias("artifactLocation"),
        F.struct(line.alias("startLine"), F.lit(2).alias("startColumn"), F.struct(F.when(k % 2 == 0, " ").otherwise("y = 2").alias("text")).alias("snippet")).alias("region"),
    )
    physical = spot(F.when(k % 11 == 0, 0).otherwise(k % 30 + 1))
    step = lambda said, line: F.struct(F.struct(F.struct(F.lit(said).alias("text")).alias("message"), spot(line).alias("physicalLocation")).alias("location"))
    flow = F.array(F.struct(F.array(F.struct(F.array(step("source", k % 30 + 1), step("sink", k % 30 + 2), step("sink", k % 30 + 2)).alias("locations"))).alias("threadFlows")))
    result = F.to_json(
        F.struct(
            F.concat(F.lit("r"), (k % 5).cast("string")).alias("ruleId"), F.when(k % 4 == 0, "note").alias("level"), F.struct(F.col("p_name").alias("text")).alias("message"),
            F.array(F.struct(physical.alias("physicalLocation"))).alias("locations"), F.when(k % 2 == 0, flow).alias("codeFlows"),
        )
    )
    rules = ",".join(f'{{"id":"r{n}","properties":{{"tags":["external/cwe/cwe-0{n}7"]}},"defaultConfiguration":{{"level":"error"}}}}' for n in range(5))
    head = f'{{"runs":[{{"tool":{{"driver":{{"semanticVersion":"1.0.0","rules":[{rules}]}}}},"results":['
    path, jobs = _write_reports(_parts(spark, sf_dir).withColumn("r", result), F.concat(F.lit(head), F.array_join("rs", ","), F.lit("]}]}")), "sarif")
    return reports.read_sarif(spark, path), jobs


@_query
def s10_s11_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of SARIF reports, with the lines of their code flows."""
    f = reports.findings_of_sarif(*_sarif_reports(spark, sf_dir))
    return f.select(
        F.col("provenance.raw_result_ref").alias("ref"), "repo_url", F.col("rule.id").alias("rule_id"), F.array_join("rule.cwe", ",").alias("cwe"), F.col("rule.severity").alias("severity"),
        "location.file", "location.start_line", "location.end_line", "snippet", F.array_join(F.transform("dataflow_trace", lambda n: F.concat_ws(":", n["description"], n["line"])), ",").alias("trace"),
    )


_sql("s10_s11_sarif", (), """
SELECT 'raw/' || job || '.json#runs/0/results/' || pos AS ref, 'https://github.com/acme/x' || job AS repo_url, 'r' || k % 5 AS rule_id, 'CWE-' || (k % 5 * 10 + 7) AS cwe,
  CASE WHEN k % 4 = 0 THEN 'note' ELSE 'error' END AS severity, 'src/s' || k % 50 || '.py' AS file, CAST(k % 30 + 1 AS INTEGER) AS start_line, CAST(k % 30 + 1 AS INTEGER) AS end_line,
  CASE WHEN k % 2 = 1 THEN 'y = 2' END AS snippet, CASE WHEN k % 2 = 0 THEN 'source:' || (k % 30 + 1) || ',sink:' || (k % 30 + 2) ELSE '' END AS trace FROM p WHERE k % 11 <> 0""", _PARTS)


@_query
def v31_report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes raw reports unusable: the version of some, the rule or place of some results."""
    report, jobs = _raw_reports(spark, sf_dir)
    v = reports.report_violations(report, jobs)
    return v.select("rule_id", F.regexp_extract("key", r"(?:/job=|^raw/)(\d+(?:\.json#results/\d+)?)", 1).alias("key"), "detail")


_sql("v31_report_gate", (), """
SELECT DISTINCT 'VERSION_MISMATCH' AS rule_id, '' || job AS key, '0.9' AS detail FROM p WHERE job % 3 = 2
UNION ALL SELECT CASE WHEN k % 17 = 0 THEN 'NO_RULE' ELSE 'NO_PLACE' END, job || '.json#results/' || pos, 'C:\\work\\.\\src\\f' || k || '.py' FROM p WHERE k % 17 = 0 OR k % 19 = 0""", _PARTS)


@_query
def s30_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without a job, jobs without a report, and a report that two jobs name."""
    report, jobs = _raw_reports(spark, sf_dir)
    n = F.regexp_extract("ref", r"(\d+)", 1).cast("int")
    given = jobs.filter(n % 4 != 1).unionByName(jobs.filter(n % 4 == 2)).unionByName(jobs.filter(n == 0).withColumn("source_file", F.lit("file:///gone/job=0/x")))
    v = reports.unclaimed_files(report, given)
    return v.select("rule_id", F.regexp_extract("key", r"/job=(\d+)/", 1).alias("key"), "detail")


_sql("s30_unclaimed", (), """
SELECT DISTINCT 'NO_JOB' AS rule_id, '' || job AS key, '' AS detail FROM p WHERE job % 4 = 1 UNION ALL SELECT 'NO_REPORT', '0', ''
UNION ALL SELECT DISTINCT 'SEVERAL_JOBS', '' || job, '2' FROM p WHERE job % 4 = 2""", _PARTS)


@_query
def k1_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as canonical JSON lines."""
    return jsonl.canonical_rows(_table(spark, sf_dir, "customer").select("c_name", "c_custkey"))


_sql("k1_canonical_rows", (), """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS value FROM customer""")


# --- evidence and official gates --------------------------------------------


@_query
def j20_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that no range shown in their case holds whole."""
    r = V.flat(spark, sf_dir, "reviews")
    at = lambda lo, n: [F.col("finding_id"), F.lit("a.py").alias("file"), lo.cast("int").alias("start"), (lo + n).cast("int").alias("end")]
    shown = r.select(*at(F.col("doc") % 40, 10)).unionByName(r.select(*at(F.col("doc") % 25 + 30, 5)))
    return reviews.citations_outside(r.select(*at(F.col("doc") % 33 + 4, F.col("doc") % 5)), shown)


_sql("j20_citations", ("reviews",), """
SELECT finding_id, 'a.py' AS file, CAST(s AS INTEGER) AS start, CAST(s + doc % 5 AS INTEGER) AS end FROM (SELECT *, doc % 33 + 4 AS s FROM reviews)
WHERE NOT (doc % 40 <= s AND s + doc % 5 <= doc % 40 + 10) AND NOT (doc % 25 + 30 <= s AND s + doc % 5 <= doc % 25 + 35)""")


@_query
def c5_evidence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long citations in ranges of 25 lines."""
    r = V.flat(spark, sf_dir, "reviews")
    return reviews.in_ranges(r.select("finding_id", (F.col("doc") % 40 + 1).cast("int").alias("start"), (F.col("doc") % 40 + 1 + F.col("doc") % 90).cast("int").alias("end")))


_sql("c5_evidence_ranges", ("reviews",), """
SELECT finding_id, CAST(s AS INTEGER) AS start, CAST(least(e, s + 24) AS INTEGER) AS end
FROM (SELECT finding_id, doc % 40 + 1 + doc % 90 AS e, unnest(range(doc % 40 + 1, doc % 40 + 2 + doc % 90, 25)) AS s FROM reviews)""")


@_query
def j19_evidence_restoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence as the exposed node that it must mean."""
    r = V.flat(spark, sf_dir, "reviews")
    node = lambda file, line, said, text: F.struct(F.lit(file).alias("file"), line.alias("line"), said.alias("description"), text.alias("code"))
    n = (F.col("doc") % 9 + 10).cast("string")
    numbered = F.concat_ws("\n", *[F.concat((F.col("doc") % 9 + 10 + k).cast("string"), F.lit(f": t{k}")) for k in range(4)])
    part = F.concat((F.col("doc") % 9 + 11).cast("string"), F.lit(":t1\n"), (F.col("doc") % 9 + 12).cast("string"), F.lit(":  t2"))
    long, inner = F.concat_ws("-", n, (F.col("doc") % 9 + 13).cast("string")), F.concat_ws("-", (F.col("doc") % 9 + 11).cast("string"), (F.col("doc") % 9 + 12).cast("string"))
    exposed = r.select("finding_id", F.posexplode(F.array(node("a.py", n, F.lit("d"), F.lit("x")), node("b.py", long, F.lit("d"), numbered))).alias("position", "node"))
    k = F.col("doc") % 7
    cited = (
        F.when(k == 0, node("a.py", n, F.lit("d"), F.lit("x"))).when(k == 1, node("a.py", n, F.lit("d"), F.lit("y"))).when(k == 2, node("a.py", n, F.lit("e"), F.lit("y")))
        .when(k == 3, node("a.py", F.lit("1"), F.lit("e"), F.lit("x"))).when(k == 4, node("b.py", F.lit("1"), F.lit("e"), F.replace(numbered, F.lit(": "), F.lit(":"))))
        .when(k == 5, node("b.py", inner, F.lit("e"), part)).otherwise(node("c.py", n, F.lit("d"), F.lit("x")))
    )
    verdict = F.when(F.col("doc") % 2 == 0, "UNCERTAIN").otherwise("FALSE_POSITIVE")
    got = reviews.restored_evidence(r.select("finding_id", verdict.alias("verdict"), F.lit(0).alias("position"), cited.alias("node")), exposed)
    return got.select("finding_id", "operation", F.col("node.file").alias("file"), F.col("node.line").alias("line"))


_sql("j19_evidence_restoration", ("reviews",), """
SELECT finding_id, CASE doc % 7 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'FILE_LINE_DESCRIPTION' WHEN 2 THEN 'FILE_LINE_UNIQUE_CODE' WHEN 3 THEN 'FILE_CODE' WHEN 4 THEN 'FILE_NUMBERED_CODE'
    WHEN 5 THEN 'TIGHTEST_CONTAINING' ELSE CASE WHEN doc % 2 = 0 THEN 'CLEARED' ELSE 'REJECTED' END END AS operation,
  CASE WHEN doc % 7 < 4 THEN 'a.py' WHEN doc % 7 < 6 THEN 'b.py' END AS file,
  CASE WHEN doc % 7 < 4 THEN '' || (doc % 9 + 10) WHEN doc % 7 < 6 THEN (doc % 9 + 10) || '-' || (doc % 9 + 13) END AS line FROM reviews""")


@_query
def v3_gold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps gold labels and predictions from an official metric."""
    g = V.flat(spark, sf_dir, "gold").select("finding_id", "label", F.regexp_extract("finding_id", r"(\d+)$", 1).cast("long").alias("k"))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    false, known, k = F.col("label") == "FP_CONFIRMED", F.col("label") == "TP_KNOWN", F.col("k")
    labels = g.select(
        "finding_id", F.lit(1).alias("schema_version"), "label", F.when(k % 8 == 0, " ").otherwise("why").alias("reasoning"), strings("e").alias("evidence"),
        F.struct(F.lit("m").alias("id"), F.when(k % 2 == 0, "MODEL").otherwise("HUMAN").alias("kind")).alias("reviewer"),
        F.struct(F.lit("LLM_VERIFIED").alias("method"), F.lit(True).alias("blind"), (k % 6 != 0).alias("independent_from_candidate_generator")).alias("verification"),
        F.when(k % 9 == 0, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00Z").alias("reviewed_at"),
        F.when(false & (k % 5 != 0), strings("CONSTANT_VALUE")).otherwise(strings()).alias("reason_codes"),
        F.when(known, strings("entry-1")).otherwise(strings()).alias("linked_entry_ids"), F.when(known & (k % 11 != 0), strings("report-1")).otherwise(strings()).alias("linked_report_ids"),
    )
    p = V.flat(spark, sf_dir, "reviews").join(g.select("finding_id"), "finding_id", "left_semi")
    return gates.gold_inputs(labels, p.select("finding_id", "verdict", F.col("eligible").alias("evaluation_eligible")))


_sql("v3_gold_gate", ("gold", "reviews"), """
SELECT broken AS rule_id, finding_id AS key, label AS detail FROM (
  SELECT finding_id, label, unnest(list_filter([CASE WHEN k % 8 = 0 THEN 'REASONING' END, CASE WHEN k % 6 = 0 THEN 'MODEL_VERIFICATION' END, CASE WHEN k % 9 = 0 THEN 'REVIEWED_AT' END,
    CASE WHEN label = 'FP_CONFIRMED' AND k % 5 = 0 THEN 'FALSE_WITHOUT_REASON' END, CASE WHEN label = 'TP_KNOWN' AND k % 11 = 0 THEN 'KNOWN_WITHOUT_LINK' END], lambda x: x IS NOT NULL)) AS broken
  FROM (SELECT *, CAST(regexp_extract(finding_id, '(\\d+)$', 1) AS BIGINT) AS k FROM gold))
UNION ALL SELECT 'NOT_ELIGIBLE', finding_id, verdict FROM reviews WHERE NOT eligible AND finding_id IN (SELECT finding_id FROM gold)""")
