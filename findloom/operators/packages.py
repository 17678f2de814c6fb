"""Packages of files that stages hand on: samples, evidence packets, runs, decisions and proofs.

Packages come as tables. A row's ``position`` is its place in its file. Every
check gives rows (rule_id, key, detail), none of them for a sound package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.canonical import json_hash, ordered_json, to_json
from ..functions.lines import strict_span
from ..schemas import ABSTAIN, CONFIDENCES, FALSE, FP_REASONS, TRUE
from ..sources.scratch import written
from .gates import broken, repeated, together
from .reviews import MAX_EVIDENCE, blind, citations_outside

# States and names as the files of the data spell them.
BLOCKING_STATES = ("TIMEOUT", "INTERRUPTED", "FAILED")
QUARANTINED, BUDGET_EXHAUSTED, RETRY_POLICY = "QUARANTINED", "timeout_budget_exhausted", "bounded-timeout-retry"
DECISIONS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "UNCERTAIN")
APPROVED, VERIFICATION = "PROJECT_APPROVED_MACHINE_REFERENCE", "DUAL_BLIND_LLM_PLUS_BLIND_FIRST_ADJUDICATOR"
POLICY = {
    "human_review_required": False, "human_gold": False, "publish_as_official_within_project": True, "universal_ground_truth_claim_allowed": False,
    "novel_vulnerability_claim_allowed": False, "uncertain_is_false_positive": False,
}
MAX_REASONING = 16_000

_SHA256 = r"^[0-9a-f]{64}$"


def _told(rows: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def order_violations(a: DataFrame, b: DataFrame, rule: str = "ORDER") -> DataFrame:
    """Positions at which two tables (position, finding_id) do not have the same id."""
    j = a.select("position", F.col("finding_id").alias("a")).join(b.select("position", F.col("finding_id").alias("b")), "position", "full_outer")
    return _told(j.filter(_differs(F.col("a"), F.col("b"))), rule, F.col("position"), F.concat_ws(" ", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-"))))


def checksum_violations(proofs: DataFrame, files: DataFrame) -> DataFrame:
    """Proofs (name, sha256, and records if given) that no file (name, sha256, records) bears out."""
    counted = "records" in proofs.columns
    j = proofs.select("name", F.col("sha256").alias("stated"), *([F.col("records").alias("stated_records")] if counted else [])).join(files, "name", "left")
    wrong = F.when(F.col("sha256").isNull(), "MISSING_FILE").when(_differs(F.lower("stated"), F.lower("sha256")), "CHECKSUM")
    if counted:
        wrong = wrong.when(_differs(F.col("stated_records"), F.col("records")), "RECORDS")
    return j.select(wrong.alias("rule_id"), F.col("name").alias("key"), F.coalesce("stated", F.lit("")).alias("detail")).filter("rule_id is not null")


def proof_chain(pins: DataFrame, files: DataFrame, root: str, max_depth: int = 16) -> DataFrame:
    """Rows (rule_id, key, detail): files that a chain of proofs no longer bears out.

    ``pins`` are rows (holder, name, sha256): what a proof, manifest or
    inventory states of other files; ``files`` are rows (name, sha256) as they
    are now; ``root`` is the proof that is trusted. CHANGED and MISSING files
    are told with the holder that names them. What a broken file states is
    UNPROVEN, told with the first broken link above it, and ADDED is what no
    pin reaches. Chains are followed link by link, a join each; one that is
    longer than ``max_depth`` is an error, as one that comes back to itself is.
    """
    found, level = [], pins.filter(F.col("holder") == root).withColumn("above", F.lit(None).cast("string"))
    for _ in range(max_depth):
        at = level.select("holder", "name", F.lower("sha256").alias("stated"), "above").join(files.select("name", F.lower("sha256").alias("now")), "name", "left")
        own = F.when(F.col("now").isNull(), "MISSING").when(F.col("stated").isNull() | (F.col("stated") != F.col("now")), "CHANGED")
        at = written(at.select("holder", "name", "above", own.alias("own")), "links")
        if at.isEmpty():
            break
        found.append(at)
        broken_at = F.coalesce("above", F.when(F.col("own").isNotNull(), F.col("name")))
        level = pins.join(at.select(F.col("name").alias("holder"), broken_at.alias("above")).distinct(), "holder").select("holder", "name", "sha256", "above")
    else:
        raise ValueError(f"a chain of proofs is longer than {max_depth}")
    none = pins.sparkSession.createDataFrame([], "holder string, name string, above string, own string")
    seen = reduce(DataFrame.unionByName, found, none)
    rule = F.when(F.col("above").isNotNull(), "UNPROVEN").otherwise(F.col("own"))
    added = files.join(seen.select("name"), "name", "left_anti").filter(F.col("name") != root)
    return together(
        _told(seen.withColumn("rule", rule).filter("rule = 'UNPROVEN'"), "UNPROVEN", F.col("name"), F.col("above")),
        *[_told(seen.withColumn("rule", rule).filter(F.col("rule") == r), r, F.col("name"), F.col("holder")) for r in ("CHANGED", "MISSING")],
        _told(added, "ADDED", F.col("name")),
    )


def sample_violations(manifest: DataFrame, files: DataFrame, findings: DataFrame, index: DataFrame) -> DataFrame:
    """What is wrong with a sample package: files against the manifest's
    checksums, findings against the index in ids and order, and their number.

    ``manifest`` is one row (sample_size, outputs map of name to sha256).
    """
    proofs = manifest.select(F.explode("outputs").alias("name", "sha256"))
    n = findings.agg(F.count("*").alias("n")).crossJoin(manifest.select("sample_size")).filter(_differs(F.col("n"), F.col("sample_size")))  # one row each
    return together(
        checksum_violations(proofs, files),
        order_violations(findings, index, "SAMPLE_AND_INDEX"),
        repeated(findings, "finding_id"),
        _told(n, "SAMPLE_SIZE", F.col("n"), F.col("sample_size")),
    )


def packet_violations(packets: DataFrame, sample: DataFrame) -> DataFrame:
    """Evidence packets (position, finding_id, finding, snapshot) that do not
    match the frozen sample one to one, or whose snapshot is not their finding's and verified."""
    c = F.col
    tests = {
        "PACKET_FINDING": _differs(c("finding.finding_id"), c("finding_id")),
        "PACKET_SNAPSHOT": _differs(c("snapshot.repo_url"), c("finding.repo_url")) | _differs(c("snapshot.commit"), c("finding.commit")),
        "PACKET_NOT_VERIFIED": ~F.coalesce(c("snapshot.git_state_verified"), F.lit(False)),
    }
    return together(order_violations(packets, sample, "PACKETS_AND_SAMPLE"), broken(packets, tests, "finding_id"))


def frozen_violations(findings: DataFrame, packets: DataFrame, index: DataFrame, scanner: str, version: str) -> DataFrame:
    """What has changed in the frozen triple of findings, packets and index: ids
    and order, the scanner, the review order, and the packet's blind finding,
    compared by a hash of its JSON."""
    shown = blind(findings, (scanner,))
    names = shown.columns
    told = packets.select("position", "schema_version", "review_order", F.struct(*[F.col(f"finding.{n}").alias(n) for n in names]).alias("told"))
    place = findings.select("finding_id", "position", F.col("scanner").alias("own_scanner"))
    own = shown.select("finding_id", json_hash(F.struct(*names), shown.schema).alias("own")).join(place, "finding_id")
    j = told.select("position", "schema_version", "review_order", json_hash(F.col("told"), told.schema["told"].dataType).alias("theirs")).join(own, "position").join(
        index.select("position", F.col("review_order").alias("index_order")), "position"
    )
    tests = {
        "SCANNER": _differs(F.lower("own_scanner.name"), F.lit(scanner)) | _differs(F.col("own_scanner.version"), F.lit(version)),
        "PACKET_SCHEMA": _differs(F.col("schema_version"), F.lit(1)),
        "REVIEW_ORDER": _differs(F.col("review_order"), F.col("index_order")),
        "BLIND_PROJECTION": _differs(F.col("theirs"), F.col("own")),
    }
    return together(order_violations(packets, findings, "PACKETS_AND_SAMPLE"), order_violations(index, findings, "INDEX_AND_SAMPLE"), broken(j, tests, "finding_id"))


# --- runs -------------------------------------------------------------------


def run_violations(run: DataFrame, predictions: DataFrame, cases: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """What keeps a reviewer's run from being a complete, proven one.

    ``run`` is one row (status, complete, total, success, failed, usage map),
    ``predictions`` (position, finding_id, response_id), ``cases`` (finding_id,
    status, name, sha256, usage map), ``expected`` (position, finding_id),
    ``files`` (name, sha256). Each case is proven by its file; token counters
    of the cases sum up to the run's; no provider's response serves two cases.
    """
    n = expected.agg(F.count("*").alias("expected"))
    r = run.crossJoin(n)  # one row each
    tests = {
        "RUN_STATUS": _differs(F.col("status"), F.lit("COMPLETE")) | ~F.coalesce("complete", F.lit(False)),
        "RUN_TOTAL": _differs(F.col("total"), F.col("expected")) | _differs(F.col("success"), F.col("expected")),
        "RUN_FAILED": _differs(F.col("failed"), F.lit(0)),
    }
    spent = cases.select(F.explode("usage").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("spent"))
    stated = run.select(F.explode("usage").alias("counter", "stated"))
    usage = spent.join(stated, "counter", "full_outer").filter(_differs(F.col("spent"), F.col("stated")))
    return together(
        broken(r.withColumn("key", F.lit("run")), tests, "key"),
        order_violations(predictions, expected, "PREDICTIONS"),
        _told(expected.join(cases.filter("status = 'SUCCESS'").select("finding_id"), "finding_id", "left_anti"), "CASE_NOT_DONE", F.col("finding_id")),
        _told(cases.join(expected.select("finding_id"), "finding_id", "left_anti"), "UNEXPECTED_CASE", F.col("finding_id")),
        checksum_violations(cases.select("name", "sha256"), files),
        repeated(predictions.filter("response_id is not null"), "response_id", "REPEATED_RESPONSE"),
        _told(usage, "USAGE", F.col("counter"), F.concat_ws(" ", F.coalesce("spent", F.lit(0)), F.coalesce("stated", F.lit(0)))),
    )


def response_violations(responses: DataFrame, exposed: DataFrame) -> DataFrame:
    """What is wrong with adjudicators' responses.

    ``responses``: finding_id, verdict, confidence, reason_codes, reasoning,
    evidence (array of nodes), uncertainty_reason, and ``keys``, the names that
    the response had, if known. ``exposed``: (finding_id, node), all that the
    reviewers were shown; only of that may evidence be cited.
    """
    c = F.col
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    is_ = lambda v: F.coalesce(c("verdict") == v, F.lit(False))
    codes, evidence, why = size(c("reason_codes")), size(c("evidence")), c("uncertainty_reason")
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    tests = {
        "VERDICT": ~F.coalesce(c("verdict").isin(*DECISIONS), F.lit(False)),
        "CONFIDENCE": ~F.coalesce(c("confidence").isin(*CONFIDENCES), F.lit(False)),
        "REASONING": blank(c("reasoning")) | (F.length("reasoning") > MAX_REASONING),
        "REASON_CODES": (F.size(F.array_distinct("reason_codes")) != F.size("reason_codes")) | ~F.forall("reason_codes", lambda x: x.isin(*FP_REASONS)),
        "TOO_MUCH_EVIDENCE": evidence > MAX_EVIDENCE,
        "REPEATED_EVIDENCE": F.size(F.array_distinct("evidence")) != F.size("evidence"),
        "FALSE_SEMANTICS": is_("FALSE_POSITIVE") & ((codes == 0) | (evidence == 0) | why.isNotNull()),
        "TRUE_SEMANTICS": is_("TRUE_POSITIVE") & ((codes > 0) | (evidence == 0) | why.isNotNull()),
        "UNCERTAIN_SEMANTICS": is_("UNCERTAIN") & ((codes > 0) | blank(why)),
    }
    if "keys" in responses.columns:
        names = ["finding_id", "verdict", "confidence", "reason_codes", "reasoning", "evidence", "uncertainty_reason"]
        tests["KEYS"] = F.array_sort("keys") != F.array(*map(F.lit, sorted(names)))
    cited = responses.select("finding_id", F.explode("evidence").alias("node"))
    outside = cited.join(exposed.select("finding_id", "node").distinct(), ["finding_id", "node"], "left_anti")
    return together(broken(responses, tests, "finding_id", c("verdict")), _told(outside, "NOT_EXPOSED", c("finding_id"), F.concat_ws(":", "node.file", "node.line")))


def semantic_defects(responses: DataFrame, shown: DataFrame) -> DataFrame:
    """What a verifier's response (finding_id, verdict, reason_codes, evidence,
    abstain_reason) lacks to mean something: fields that its verdict asks for or
    forbids, and evidence that stands whole in one range (finding_id, file,
    start, end) that was shown."""
    c = F.col
    codes, nodes = F.coalesce(F.size("reason_codes"), F.lit(0)), F.coalesce(F.size("evidence"), F.lit(0))
    why = ~F.coalesce(F.trim("abstain_reason") == "", F.lit(True))
    is_ = lambda v: F.coalesce(c("verdict") == v, F.lit(False))
    tests = {
        "FALSE_SEMANTICS": is_(FALSE) & ((codes == 0) | (nodes == 0) | why),
        "TRUE_SEMANTICS": is_(TRUE) & ((codes > 0) | (nodes == 0) | why),
        "ABSTAIN_SEMANTICS": is_(ABSTAIN) & ((codes > 0) | ~why),
    }
    cited = responses.select("finding_id", F.explode("evidence").alias("node")).withColumn("at", strict_span(F.col("node.line")))
    unread = cited.filter("at is null")
    ranges = cited.filter("at is not null").select("finding_id", F.col("node.file").alias("file"), F.col("at.start").alias("start"), F.col("at.end").alias("end"))
    outside = citations_outside(ranges, shown)
    return together(
        broken(responses, tests, "finding_id", c("verdict")),
        _told(unread, "EVIDENCE_LINE", c("finding_id"), c("node.line")),
        _told(outside, "NOT_SHOWN", c("finding_id"), F.concat_ws(":", "file", "start", "end")),
    )


def decision_violations(run: DataFrame, decisions: DataFrame, cases: DataFrame, expected: DataFrame, files: DataFrame, exposed: DataFrame) -> DataFrame:
    """What keeps final decisions from being proven: those of ``run_violations``
    and of ``response_violations``, and rows that differ from the file of their
    case, compared by ``row_sha256``."""
    pinned = cases.select("finding_id", F.col("decision_sha256").alias("pinned"))
    changed = decisions.join(pinned, "finding_id").filter(_differs(F.col("row_sha256"), F.col("pinned")))
    return together(
        run_violations(run, decisions, cases, expected, files),
        response_violations(decisions, exposed),
        _told(changed, "DECISION_CHANGED", F.col("finding_id"), F.col("row_sha256")),
    )


def consensus_reviewer(a: Column, b: Column) -> Column:
    """The reviewer that two participants (provider, provider_version, model,
    model_version) make together: models joined by +, versions hashed."""
    both = lambda k: F.concat_ws("+", a[k], b[k])
    return F.struct(
        F.lit("reviewer-a+reviewer-b").alias("id"), F.lit("MODEL").alias("kind"), F.lit("CONSENSUS_A_B").alias("role"), F.lit("MULTIPLE_MODELS").alias("provider"),
        F.sha2(ordered_json(F.array(a["provider_version"], b["provider_version"])), 256).alias("provider_version"), both("model").alias("model"), both("model_version").alias("model_version"),
        F.array(a, b).alias("participants"),
    )


def review_status(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (stage, expected, success, failed, running, pending, complete) over
    (stage, finding_id, status) and (stage, expected)."""
    n = lambda s: F.count_if(F.col("status") == s)
    have = cases.groupBy("stage").agg(n("SUCCESS").alias("success"), n("FAILED").alias("failed"), n("RUNNING").alias("running"), F.count_distinct("finding_id").alias("begun"))
    j = expected.join(have, "stage", "left").na.fill(0, ["success", "failed", "running", "begun"])
    return j.select("stage", "expected", "success", "failed", "running", (F.col("expected") - F.col("begun")).alias("pending"), (F.col("success") == F.col("expected")).alias("complete"))


# --- the scan ledger --------------------------------------------------------


def quarantine_violations(pointers: DataFrame, attempts: DataFrame, policies: DataFrame) -> DataFrame:
    """Pointers whose quarantine is not proven.

    ``pointers``: job columns, schema_version, scan_id, status, scheduling
    (state, reason, matching_timeout_attempts, limit, policy_sha256,
    decided_at). ``attempts``: job columns, status. ``policies``: scan_id,
    schema_version, policy, max_completed_timeout_attempts, sha256 of the
    policy's file. Schema 1 has no scheduling; schema 2 has one whose timeouts
    are those of the attempts, reach the limit, and follow the scan's policy.
    """
    job = ["repo_url", "commit", "scanner"]
    timeouts = attempts.filter("status = 'TIMEOUT'").groupBy(*job).agg(F.count("*").alias("observed"))
    p = policies.select("scan_id", F.struct(F.col("schema_version").alias("version"), "policy", F.col("max_completed_timeout_attempts").alias("limit"), "sha256").alias("p"))
    j = pointers.join(timeouts, job, "left").join(p, "scan_id", "left").withColumn("key", F.concat_ws(" ", *job))
    s = F.col("scheduling")
    two = F.coalesce(F.col("schema_version") == 2, F.lit(False)) & s.isNotNull()
    wrong = lambda test: two & F.coalesce(test, F.lit(True))
    tests = {
        "POINTER_SCHEMA": ~F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False)),
        "SCHEDULING_IN_SCHEMA_1": F.coalesce(F.col("schema_version") == 1, F.lit(False)) & s.isNotNull(),
        "NO_SCHEDULING": F.coalesce(F.col("schema_version") == 2, F.lit(False)) & s.isNull(),
        "STATE": wrong(s["state"] != QUARANTINED),
        "REASON": wrong(s["reason"] != BUDGET_EXHAUSTED),
        "STATUS": wrong(~F.col("status").isin(*BLOCKING_STATES)),
        "COUNT": wrong((s["matching_timeout_attempts"] < 1) | (s["limit"] < 1) | (s["matching_timeout_attempts"] < s["limit"])),
        "TIMEOUTS": wrong(s["matching_timeout_attempts"] != F.coalesce("observed", F.lit(0))),
        "DECIDED_AT": wrong(~T.is_zoned_time(s["decided_at"])),
        "NO_POLICY": two & F.col("p").isNull(),
        "POLICY": wrong((F.col("p.version") != 1) | (F.col("p.policy") != RETRY_POLICY) | (F.col("p.limit") < 1)) & F.col("p").isNotNull(),
        "POLICY_LIMIT": wrong(F.col("p.limit") != s["limit"]) & F.col("p").isNotNull(),
        "POLICY_SHA256": wrong(~s["policy_sha256"].rlike(_SHA256) | (F.col("p.sha256") != s["policy_sha256"])) & F.col("p").isNotNull(),
    }
    return broken(j, tests, "key", F.col("status"))


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """Snapshots (position, repo_url, commit) of a manifest without a url or a commit."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return broken(snapshots.withColumn("key", F.col("position").cast("string")), {"REPO_URL": blank("repo_url"), "COMMIT": blank("commit")}, "key")


# --- publication ------------------------------------------------------------


def attestation_violations(attestation: DataFrame, files: DataFrame) -> DataFrame:
    """What keeps an attestation from standing.

    One row (schema_version, status, policy map of booleans, claim,
    verification_method, independent, repository_split, frozen_inputs map of
    name to struct(path, sha256)); ``files`` has (name, sha256), the name being
    a proof's path.
    """
    given = F.map_from_entries(F.array_sort(F.map_entries("policy")))
    asked = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(POLICY.items())]))
    tests = {
        "SCHEMA_VERSION": _differs(F.col("schema_version"), F.lit(1)),
        "STATUS": _differs(F.col("status"), F.lit(APPROVED)),
        "POLICY": _differs(to_json(given), to_json(asked)),
        "METHOD": _differs(F.col("verification_method"), F.lit(VERIFICATION)),
        "INDEPENDENCE": ~F.coalesce("independent", F.lit(False)),
        "REPOSITORY_SPLIT": ~F.coalesce("repository_split", F.lit(False)),
        "NO_PROOFS": F.coalesce(F.size("frozen_inputs"), F.lit(0)) < 1,
    }
    proofs = attestation.select(F.explode("frozen_inputs").alias("proof", "x")).select(F.col("x.path").alias("name"), "x.sha256")
    return together(broken(attestation.withColumn("key", F.lit("attestation")), tests, "key"), checksum_violations(proofs, files))


def folder_digests(files: DataFrame) -> DataFrame:
    """Rows (folder, sha256) of rule folders, over (folder, path, sha256 of the file).

    The digest is that of, file by file in order of the paths' parts: the
    path's length in bytes as eight bytes, the path, the file's digest. Other
    than YAML files do not count.
    """
    yaml = files.filter(F.lower("path").rlike(r"\.ya?ml$"))
    name = F.encode("path", "UTF-8")
    piece = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("path")), 16, "0")), name, F.unhex("sha256"))
    listed = yaml.select("folder", F.struct(F.split("path", "/").alias("parts"), piece.alias("piece")).alias("x")).groupBy("folder").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    whole = F.aggregate("xs", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    return listed.select("folder", F.sha2(whole, 256).alias("sha256"))


def inventory_digest(files: DataFrame) -> DataFrame:
    """One row (files, raw_responses, inventory_sha256) over (path, sha256): the hash of the ordered list's canonical JSON."""
    listed = files.agg(F.count("*").alias("files"), F.count_if(F.substring_index("path", "/", -1).contains("raw-response")).alias("raw_responses"), F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("xs"))
    return listed.select("files", "raw_responses", json_hash(F.col("xs"), listed.schema["xs"].dataType).alias("inventory_sha256"))


# --- selection and budgets --------------------------------------------------


def selected(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids``; ``missing`` names ids that have none."""
    return records.join(ids.select("finding_id").distinct(), "finding_id", "left_semi")


def missing(records: DataFrame, ids: DataFrame) -> DataFrame:
    lone = ids.select("finding_id").distinct().join(records.select("finding_id"), "finding_id", "left_anti")
    return _told(lone, "MISSING_RECORD", F.col("finding_id"))


_LEAST_TEXT = 64


def bounded(findings: DataFrame, budget: int, texts: tuple[str, ...] = ("message", "snippet")) -> DataFrame:
    """Findings that fit into ``budget`` characters of JSON, with ``fits``.

    The last trace nodes go first, as many as must; where none is left, the
    texts are halved, down to ``_LEAST_TEXT`` characters, until all fits or no
    text can be shorter.
    """
    columns = findings.columns
    size = lambda: F.length(to_json(F.struct(*columns)))
    nodes = F.coalesce("dataflow_trace", F.array())
    rest = F.length(to_json(F.struct(*[F.slice(nodes, 1, 0).alias(c) if c == "dataflow_trace" else F.col(c) for c in columns])))
    each = F.transform(nodes, lambda n: F.length(to_json(n)) + 1)
    room = F.lit(budget + 1) - rest  # the first node has no comma before it
    sums = F.transform(each, lambda _, i: F.aggregate(F.slice(each, 1, i + 1), F.lit(0), lambda a, x: a + x))
    kept = F.size(F.filter(sums, lambda s: s <= room))
    rows = findings.withColumn("dataflow_trace", F.when(size() > budget, F.slice(nodes, 1, F.least(kept, F.size(nodes)))).otherwise(F.col("dataflow_trace")))
    half = lambda c: F.when(F.length(c) > _LEAST_TEXT, T.truncated_to(F.col(c), F.greatest(F.lit(_LEAST_TEXT), F.floor(F.length(c) / 2)))).otherwise(F.col(c))
    longest = findings.agg(F.greatest(*[F.coalesce(F.max(F.length(c)), F.lit(0)) for c in texts])).first()[0] or 0
    while longest > _LEAST_TEXT:
        # Over a generator Spark merges no projections, so each round computes its size once.
        rows = rows.select("*", F.explode(F.array(size())).alias("so far")).withColumns({c: F.when(F.col("so far") > budget, half(c)).otherwise(F.col(c)) for c in texts}).select(*columns)
        longest //= 2
    return rows.withColumn("fits", size() <= budget)
