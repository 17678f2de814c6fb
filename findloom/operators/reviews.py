"""Independent reviews: blind inputs, routing, adjudication, evidence and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.canonical import json_hash
from ..functions.lines import strict_span
from ..schemas import ABSTAIN, FALSE, MACHINE_FALSE, MACHINE_TRUE, MACHINE_UNCERTAIN, TRUE
from .sampling import bottom_share

EVIDENCE = "array<struct<file:string,line:string,description:string,code:string>>"
MAX_EVIDENCE = 12

#: Columns that a blind reviewer may see.
BLIND_COLUMNS = (
    "schema_version", "finding_id", "repo_url", "commit", "scanner", "rule", "message", "location",
    "dataflow_trace", "snippet", "fingerprint", "provenance",
)


def blind(findings: DataFrame, hidden_scanners: tuple[str, ...] = ("opengrep",), shown: str = "other") -> DataFrame:
    """Findings without anything that could tell their label, scanners' names replaced."""
    name = F.col("scanner.name")
    scanner = F.col("scanner").withField("name", F.when(F.lower(name).isin(*hidden_scanners), shown).otherwise(name))
    return findings.select(*[scanner.alias(c) if c == "scanner" else c for c in BLIND_COLUMNS if c in findings.columns])


def for_model(findings: DataFrame, head: int = 6, tail: int = 6, message: int = 2000, code: int = 4000, mark: str = "...[truncated]") -> DataFrame:
    """Blind findings cut to a budget: first and last trace nodes, texts with a mark where they end early."""
    n = F.size("dataflow_trace")
    ends = F.concat(F.slice("dataflow_trace", 1, head), F.slice("dataflow_trace", F.greatest(F.lit(1), n - tail + 1), tail))
    trace = F.when(n > head + tail, ends).otherwise(F.col("dataflow_trace"))
    trace = F.transform(trace, lambda x: x.withField("code", T.truncated(x["code"], code, mark)))
    return findings.withColumns(
        {
            "message": T.truncated(F.col("message"), message, mark),
            "snippet": T.truncated(F.col("snippet"), code, mark),
            "dataflow_trace": trace,
            "omitted_trace_nodes": F.greatest(F.lit(0), n - head - tail),
        }
    )


def opinion(row: Column, valid: Column) -> Column:
    """A review without the evidence that could not be verified."""
    return row.withField("evidence", F.when(valid, row["evidence"]).otherwise(F.array().cast(EVIDENCE))).withField("evidence_valid", valid)


def reconcile(a: DataFrame, b: DataFrame, fraction: float = 0.20, seed: str = "audit") -> DataFrame:
    """Rows (finding_id, a, b, audited, route_reasons, routed) of findings that both reviewed.

    ``a`` and ``b`` hold finding_id, verdict, confidence, reason_codes,
    reasoning, evidence and evidence_valid. A finding goes to the adjudicator
    unless both reviewers call it false with high confidence and valid
    evidence; of those a seeded share goes there too.
    """
    fields = ["verdict", "confidence", "reason_codes", "reasoning", "evidence", "evidence_valid"]
    j = a.select("finding_id", F.struct(*fields).alias("a")).join(b.select("finding_id", F.struct(*fields).alias("b")), "finding_id")
    sure = F.lit(True)
    for s in ("a", "b"):
        sure = sure & (F.col(f"{s}.verdict") == FALSE) & (F.col(f"{s}.confidence") == "HIGH") & F.col(f"{s}.evidence_valid")
    audited = bottom_share(j.filter(sure).select("finding_id"), fraction, seed).withColumn("audited", F.lit(True))
    j = j.join(audited, "finding_id", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))
    either = lambda v: (F.col("a.verdict") == v) | (F.col("b.verdict") == v)
    reasons = {
        "MODEL_DISAGREEMENT": F.col("a.verdict") != F.col("b.verdict"),
        "ANY_TRUE_POSITIVE": either(TRUE),
        "ANY_ABSTAIN": either(ABSTAIN),
        "ANY_NON_HIGH_CONFIDENCE": (F.col("a.confidence") != "HIGH") | (F.col("b.confidence") != "HIGH"),
        "REVIEWER_A_INVALID_EVIDENCE": ~F.col("a.evidence_valid"),
        "REVIEWER_B_INVALID_EVIDENCE": ~F.col("b.evidence_valid"),
        "DETERMINISTIC_CONSENSUS_FP_AUDIT": F.col("audited"),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons.items()]))
    return j.withColumn("route_reasons", found).withColumn("routed", F.size("route_reasons") > 0)


def route_counts(reconciled: DataFrame) -> DataFrame:
    """Rows (reason, n), and how many findings no reason routes, as ``NOT_ROUTED``."""
    reasons = F.when(F.col("routed"), F.col("route_reasons")).otherwise(F.array(F.lit("NOT_ROUTED")))
    return reconciled.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def anonymous_pair(finding_id: Column, a: Column, b: Column) -> Column:
    """Both opinions as an array whose order a hash of the id decides."""
    odd = F.conv(F.substring(F.sha2(finding_id, 256), 1, 2), 16, 10).cast("int") % 2 == 1
    return F.when(odd, F.array(b, a)).otherwise(F.array(a, b))


def adjudication_input(reconciled: DataFrame, third: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (finding_id, finding, opinions, blind_opinion) of the routed findings,
    with the third reviewer's blind opinion, which is taken before the others are seen."""
    routed = reconciled.filter("routed")
    a, b = opinion(F.col("a"), F.col("a.evidence_valid")), opinion(F.col("b"), F.col("b.evidence_valid"))
    own = third.select("finding_id", F.struct(*[c for c in third.columns if c != "finding_id"]).alias("blind_opinion"))
    shown = blind(findings)
    return (
        routed.select("finding_id", anonymous_pair(F.col("finding_id"), a, b).alias("opinions"))
        .join(own, "finding_id")
        .join(shown.select("finding_id", F.struct(*shown.columns).alias("finding")), "finding_id")
    )


def labels(reconciled: DataFrame, decisions: DataFrame, reviewed_at: str) -> DataFrame:
    """Machine labels: the adjudicator's decision for routed findings, the consensus for the others.

    ``decisions`` holds finding_id, verdict (TRUE_POSITIVE, FALSE_POSITIVE or
    UNCERTAIN), confidence, reason_codes, reasoning, evidence and
    uncertainty_reason. A routed finding without a decision has a null label.
    """
    d = decisions.select("finding_id", F.struct(*[c for c in decisions.columns if c != "finding_id"]).alias("d"))
    j = reconciled.join(d, "finding_id", "left")
    decided = F.when(F.col("d.verdict") == TRUE, MACHINE_TRUE).when(F.col("d.verdict") == FALSE, MACHINE_FALSE).when(F.col("d.verdict").isNotNull(), MACHINE_UNCERTAIN)
    both = F.slice(F.array_distinct(F.concat("a.evidence", "b.evidence")), 1, MAX_EVIDENCE)
    codes = F.array_sort(F.array_union("a.reason_codes", "b.reason_codes"))
    said = F.concat(
        F.lit("Both reviewers call this a false positive with high confidence and verified evidence. Reviewer A: "),
        "a.reasoning", F.lit(" Reviewer B: "), "b.reasoning",
    )
    pick = lambda routed, consensus: F.when(F.col("routed"), routed).otherwise(consensus)
    return j.select(
        F.lit(1).alias("schema_version"),
        "finding_id",
        pick(decided, F.lit(MACHINE_FALSE)).alias("label"),
        pick(F.col("d.confidence"), F.lit("HIGH")).alias("confidence"),
        pick(F.col("d.reason_codes"), codes).alias("reason_codes"),
        pick(F.col("d.reasoning"), said).alias("reasoning"),
        pick(F.col("d.evidence"), both).alias("evidence"),
        pick(F.col("d.uncertainty_reason"), F.lit(None)).alias("uncertainty_reason"),
        pick(F.lit("ADJUDICATOR_C"), F.lit("CONSENSUS_A_B")).alias("reviewer_role"),
        F.lit(reviewed_at).alias("reviewed_at"),
        F.col("routed").alias("blind_first"),
        "route_reasons",
    )


def audit_outcome(reconciled: DataFrame, labelled: DataFrame, fraction: float = 0.20, threshold: float = 0.10) -> DataFrame:
    """One row: how many audited consensus findings the adjudicator did not confirm, and whether to audit more."""
    j = reconciled.filter("audited").join(labelled.select("finding_id", "label"), "finding_id")
    row = j.agg(F.count("*").alias("audited"), F.count_if(F.col("label") != MACHINE_FALSE).alias("not_confirmed"))
    rate = F.try_divide("not_confirmed", "audited")
    return row.select("*", rate.alias("not_confirmed_rate"), (F.lit(fraction < 1) & F.coalesce(rate > threshold, F.lit(False))).alias("expand_audit"))


# --- evidence ---------------------------------------------------------------


def numbered(code: Column) -> Column:
    """Lines ``n: text`` with consecutive numbers, as an array of (n, text); null for any other code."""
    lines = F.split(code, r"\r\n|\r|\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines)
    parsed = F.transform(
        lines, lambda x: F.struct(F.regexp_extract(x, r"^([1-9][0-9]*):(.*)$", 1).try_cast("int").alias("n"), F.trim(F.regexp_extract(x, r"^([1-9][0-9]*):(.*)$", 2)).alias("t"))
    )
    follows = F.forall(F.transform(parsed, lambda x, i: x["n"] == F.get(parsed, F.lit(0))["n"] + i), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when((F.size(parsed) > 0) & follows, parsed)


def restored_evidence(cited: DataFrame, exposed: DataFrame) -> DataFrame:
    """Rows (finding_id, position, node, operation): cited evidence as the exposed node that it must mean.

    ``cited`` has (finding_id, verdict, position, node), ``exposed`` (finding_id,
    position, node). An exact node stays. Else the first of these that names
    one node decides: file, line and description; file and line, if all such
    nodes have one code; file and code; file and numbered code; the tightest
    node around it whose numbered lines hold the cited ones. What nothing
    names is dropped for UNCERTAIN (``CLEARED``) and ``REJECTED`` otherwise.
    """
    e = exposed.groupBy("finding_id", "node").agg(F.min("position").alias("e_position"))
    held = e.select(
        F.col("finding_id").alias("e_finding"), F.col("node").alias("e"), "e_position", numbered(F.col("node.code")).alias("e_lines"), strict_span(F.col("node.line")).alias("e_at")
    )
    c = cited.withColumn("lines", numbered(F.col("node.code"))).withColumn("at", strict_span(F.col("node.line")))
    j = c.join(held, (F.col("finding_id") == F.col("e_finding")) & F.col("node.file").eqNullSafe(F.col("e.file")), "left")
    same = lambda k: F.col(f"node.{k}").eqNullSafe(F.col(f"e.{k}"))
    found = F.col("e").isNotNull()
    inside = F.filter("e_lines", lambda x: (x["n"] >= F.col("at.start")) & (x["n"] <= F.col("at.end")))
    whole = lambda lines, at: (F.get(F.col(lines), F.lit(0))["n"] == F.col(f"{at}.start")) & (F.element_at(F.col(lines), -1)["n"] == F.col(f"{at}.end"))
    around = (F.col("e_at.start") <= F.col("at.start")) & (F.col("e_at.end") >= F.col("at.end")) & whole("lines", "at") & whole("e_lines", "e_at") & (inside == F.col("lines"))
    width = F.col("e_at.end") - F.col("e_at.start")
    flags = {
        "EXACT": found & same("line") & same("description") & same("code"),
        "FILE_LINE_DESCRIPTION": found & same("line") & same("description"),
        "FILE_LINE_UNIQUE_CODE": found & same("line"),
        "FILE_CODE": found & same("code"),
        "FILE_NUMBERED_CODE": found & F.coalesce(F.col("lines") == F.col("e_lines"), F.lit(False)),
        "TIGHTEST_CONTAINING": found & F.coalesce(around, F.lit(False)),
    }
    j = j.withColumns({f"is_{k}": v for k, v in flags.items()}).withColumn("width", width)
    w = W.partitionBy("finding_id", "position")
    j = j.withColumn("least", F.min(F.when(F.col("is_TIGHTEST_CONTAINING"), F.col("width"))).over(w))
    hit = lambda k: (F.col(f"is_{k}") & (F.col("width") == F.col("least"))) if k == "TIGHTEST_CONTAINING" else F.col(f"is_{k}")
    aggregates = []
    for k in flags:
        n = F.count_distinct(F.when(hit(k), F.struct(F.coalesce("e.code", F.lit("\0")).alias("code")))) if k == "FILE_LINE_UNIQUE_CODE" else F.count_if(hit(k))
        aggregates += [n.alias(f"n_{k}"), F.min_by(F.when(hit(k), F.col("e")), F.when(hit(k), F.col("e_position"))).alias(f"e_{k}")]
    g = j.groupBy("finding_id", "position").agg(F.first("verdict").alias("verdict"), F.first("node").alias("cited"), *aggregates)
    node, operation = F.lit(None).cast(EVIDENCE.removeprefix("array<").removesuffix(">")), F.when(F.col("verdict") == "UNCERTAIN", "CLEARED").otherwise("REJECTED")
    for k in reversed(flags):
        one = F.col(f"n_{k}") == 1
        node, operation = F.when(one, F.col(f"e_{k}")).otherwise(node), F.when(one, F.lit(k)).otherwise(operation)
    return g.select("finding_id", "position", node.alias("node"), operation.alias("operation"))


def citations_outside(cited: DataFrame, shown: DataFrame) -> DataFrame:
    """Citations (finding_id, file, start, end) that no shown range of the same file holds whole."""
    c, s = cited.alias("c"), shown.alias("s")
    inside = (F.col("s.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("s.end"))
    return c.join(s, (F.col("c.finding_id") == F.col("s.finding_id")) & (F.col("c.file") == F.col("s.file")) & inside, "left_anti")


def in_ranges(cited: DataFrame, lines: int = 25) -> DataFrame:
    """Citations (…, start, end) cut into ranges of at most ``lines`` lines."""
    others = [c for c in cited.columns if c not in ("start", "end")]
    steps = cited.select(*others, "end", F.explode(F.sequence("start", "end", F.lit(lines))).alias("start"))
    return steps.select(*others, "start", F.least("end", F.col("start") + lines - 1).alias("end"))


def evidence_errors(cited: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (finding_id, position) of evidence whose code is not the pinned source text.

    ``cited`` has (finding_id, repo_url, commit, position, node); ``lines`` has
    (repo_url, commit, file, n, text). Code is compared as ``n: text`` lines.
    """
    at = strict_span(F.col("node.line"))
    c = cited.withColumn("at", at)
    each = c.filter("at is not null").select(
        "finding_id", "position", "repo_url", "commit", F.col("node.file").alias("file"), F.explode(F.sequence("at.start", "at.end")).alias("n")
    )
    read = each.join(lines, ["repo_url", "commit", "file", "n"]).groupBy("finding_id", "position").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"))
    source = F.array_join(F.transform("ls", lambda x: F.concat(x["n"].cast("string"), F.lit(": "), x["text"])), "\n")
    read = read.select("finding_id", "position", T.redact_ids(source).alias("source"))
    j = c.join(read, ["finding_id", "position"], "left")
    return j.filter(~F.coalesce(F.col("node.code") == F.col("source"), F.lit(False))).select("finding_id", "position")


def overlay(base: DataFrame, retry: DataFrame, key: str = "finding_id") -> DataFrame:
    """Rows of a run, those that a retry has replaced by the retry's."""
    return base.join(retry.select(key), key, "left_anti").unionByName(retry)


def composite(runs: list[tuple[str, DataFrame]], key: str = "finding_id") -> DataFrame:
    """Of each case the row of the last run in which it succeeded, with that
    run's name as ``run`` and whether it was reused from before the last one.

    ``runs`` are given in order, each with a ``status``; cases that no run
    finished have none (``pending`` names them).
    """
    done = [rows.filter("status = 'SUCCESS'").withColumns({"run": F.lit(name), "_order": F.lit(i)}) for i, (name, rows) in enumerate(runs)]
    w = W.partitionBy(key).orderBy(F.col("_order").desc())
    last = reduce(DataFrame.unionByName, done).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")
    return last.withColumn("reused", F.col("_order") < len(runs) - 1).drop("_rank", "_order")


def lineage(composed: DataFrame) -> DataFrame:
    """Rows (run, cases): from which run how many cases of a composite come."""
    return composed.groupBy("run").agg(F.count("*").alias("cases"))


def pending(expected: DataFrame, done: DataFrame, key: str = "finding_id") -> DataFrame:
    """Work that no successful case covers yet."""
    return expected.join(done.filter("status = 'SUCCESS'").select(key), key, "left_anti")


def with_row_hash(rows: DataFrame, name: str = "row_sha256") -> DataFrame:
    """Rows with the hash of their canonical JSON, by which later stages pin them."""
    return rows.withColumn(name, json_hash(F.struct(*rows.columns), rows.schema))
