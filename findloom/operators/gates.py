"""Rules that data must keep. Each returns rows (rule_id, key, detail) for what breaks one; none is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..functions.lines import strict_span
from ..schemas import (
    CONFIDENCES,
    FP_REASONS,
    GOLD_EXCLUDED,
    GOLD_FALSE,
    GOLD_TRUE,
    MACHINE_FALSE,
    MACHINE_TRUE,
    MACHINE_UNCERTAIN,
    VERDICTS,
)

# What no blind input may name, as letters and digits only.
FORBIDDEN_KEYS = (
    "adjudication", "candidateid", "cve", "cves", "exclusionreason", "fixedcommit", "goldlabel", "humanlabel", "label", "labels",
    "linkedentryids", "linkedreportids", "matchtier", "matches", "metrics", "nearbysemgrepfindings", "noveltyvssemgrep", "patch",
    "prediction", "reportid", "technicallabel", "verdict", "benchmarkentry", "benchmarkentries", "groundtruth", "humanreview",
    "isvulnerable", "knownvulnerability", "linkedreportid", "linkedentryid", "expectedverdict", "referencelabel", "truelabel",
)


class GateError(ValueError):
    """A gate found rows."""


def gate(violations: DataFrame, name: str, shown: int = 20) -> None:
    """Raise with the first few violations, if there are any."""
    rows = violations.limit(shown).collect()
    if rows:
        raise GateError(f"{name}: " + "; ".join(f"{r['rule_id']} {r['key']} {r['detail']}".strip() for r in rows))


def broken(rows: DataFrame, tests: dict[str, Column], key: str, detail: Column | None = None) -> DataFrame:
    """A violation for each test that holds (or is null) on a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in tests.items()]))
    return rows.select(F.explode(found).alias("rule_id"), F.col(key).alias("key"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"))


def repeated(rows: DataFrame, key: str, rule: str = "REPEATED_ID") -> DataFrame:
    """Keys that more than one row has."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return n.select(F.lit(rule).alias("rule_id"), F.col(key).alias("key"), F.col("n").cast("string").alias("detail"))


def different_ids(a: DataFrame, b: DataFrame, key: str = "finding_id", names: tuple[str, str] = ("ONLY_LEFT", "ONLY_RIGHT")) -> DataFrame:
    """Keys that only one side has."""
    j = a.select(key, F.lit(True).alias("l")).distinct().join(b.select(key, F.lit(True).alias("r")).distinct(), key, "full_outer")
    rule = F.when(F.col("r").isNull(), names[0]).when(F.col("l").isNull(), names[1])
    return j.select(rule.alias("rule_id"), F.col(key).alias("key"), F.lit("").alias("detail")).filter("rule_id is not null")


def empty(rows: DataFrame, name: str) -> DataFrame:
    """One violation if there is no row."""
    return rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("EMPTY").alias("rule_id"), F.lit(name).alias("key"), F.lit("").alias("detail"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


_blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
_empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))


def _own_strings(c: Column) -> Column:
    """Strings that are not blank and do not repeat."""
    return F.coalesce(F.forall(c, lambda x: F.trim(x) != "") & (F.size(F.array_distinct(c)) == F.size(c)), F.lit(True))


def gold_inputs(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """What keeps gold labels and predictions from an official metric.

    ``labels``: finding_id, schema_version, label, reasoning, evidence,
    reviewer(id, kind), verification(method, blind,
    independent_from_candidate_generator), reviewed_at, reason_codes,
    linked_entry_ids, linked_report_ids. ``predictions``: finding_id, verdict,
    evaluation_eligible.
    """
    c = F.col
    label, linked = c("label"), ~_empty(c("linked_entry_ids")) | ~_empty(c("linked_report_ids"))
    v = c("verification")
    proven = v["method"].isin("LLM_VERIFIED", "LLM_ADJUDICATED_MACHINE_REFERENCE") & v["blind"] & v["independent_from_candidate_generator"]
    false = F.coalesce(label == GOLD_FALSE, F.lit(False))
    known = F.coalesce(label == GOLD_TRUE[0], F.lit(False))
    tests = {
        "FINDING_ID": _blank(c("finding_id")),
        "SCHEMA_VERSION": ~c("schema_version").eqNullSafe(F.lit(1)),
        "LABEL": ~F.coalesce(label.isin(*GOLD_TRUE, GOLD_FALSE, *GOLD_EXCLUDED), F.lit(False)),
        "REASONING": _blank(c("reasoning")),
        "EVIDENCE": _empty(c("evidence")) | ~_own_strings(c("evidence")),
        "REVIEWER_KIND": ~F.coalesce(c("reviewer.kind").isin("HUMAN", "MODEL"), F.lit(False)),
        "REVIEWER_ID": _blank(c("reviewer.id")),
        "MODEL_VERIFICATION": F.coalesce(c("reviewer.kind") == "MODEL", F.lit(False)) & ~F.coalesce(proven, F.lit(False)),
        "REVIEWED_AT": ~T.is_zoned_time(c("reviewed_at")),
        "REASON_CODES": ~_own_strings(c("reason_codes")) | ~F.coalesce(F.forall("reason_codes", lambda x: x.isin(*FP_REASONS)), F.lit(True)),
        "FALSE_WITHOUT_REASON": false & _empty(c("reason_codes")),
        "REASON_WITHOUT_FALSE": ~false & ~_empty(c("reason_codes")),
        "KNOWN_WITHOUT_LINK": known & (_empty(c("linked_entry_ids")) | _empty(c("linked_report_ids"))),
        "LINK_WITHOUT_KNOWN": ~known & linked,
    }
    p_tests = {
        "PREDICTION_ID": _blank(c("finding_id")),
        "VERDICT": ~F.coalesce(c("verdict").isin(*VERDICTS), F.lit(False)),
        "NOT_ELIGIBLE": ~F.coalesce(c("evaluation_eligible"), F.lit(False)),
    }
    return together(
        empty(labels, "labels"),
        empty(predictions, "predictions"),
        broken(labels, tests, "finding_id", label),
        broken(predictions, p_tests, "finding_id", c("verdict")),
        repeated(labels, "finding_id", "REPEATED_LABEL"),
        repeated(predictions, "finding_id", "REPEATED_PREDICTION"),
        different_ids(labels, predictions, names=("MISSING_PREDICTION", "MISSING_LABEL")),
    )


def _bad_node(n: Column) -> Column:
    ok = ~_blank(n["file"]) & T.is_safe_path(n["file"]) & strict_span(n["line"]).isNotNull() & ~_blank(n["description"])
    return ~F.coalesce(ok, F.lit(False))


def machine_inputs(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """What keeps machine labels and predictions from a metric.

    ``labels``: finding_id, label, confidence, reason_codes, reasoning,
    evidence, uncertainty_reason, reviewer(role, ids, models), reviewed_at,
    provenance(blind_first, route_reasons, blind_sha256, final_sha256),
    linked_entry_ids.
    """
    c = F.col
    label = c("label")
    is_ = lambda x: F.coalesce(label == x, F.lit(False))
    codes, why, nodes = ~_empty(c("reason_codes")), ~_blank(c("uncertainty_reason")), ~_empty(c("evidence"))
    role, p = c("reviewer.role"), c("provenance")
    both = F.coalesce(role == "CONSENSUS_A_B", F.lit(False))
    third = F.coalesce(role == "ADJUDICATOR_C", F.lit(False))
    people = lambda n: (F.size("reviewer.ids") == n) & (F.size(F.array_distinct("reviewer.ids")) == n) & (F.size(F.array_distinct("reviewer.models")) == n)
    hashes = p["blind_sha256"].rlike("^[0-9a-f]{64}$") & p["final_sha256"].rlike("^[0-9a-f]{64}$")
    tests = {
        "FINDING_ID": _blank(c("finding_id")),
        "LABEL": ~F.coalesce(label.isin(MACHINE_TRUE, MACHINE_FALSE, MACHINE_UNCERTAIN), F.lit(False)),
        "CONFIDENCE": ~F.coalesce(c("confidence").isin(*CONFIDENCES), F.lit(False)),
        "REASONING": _blank(c("reasoning")),
        "REASON_CODES": ~_own_strings(c("reason_codes")) | ~F.coalesce(F.forall("reason_codes", lambda x: x.isin(*FP_REASONS)), F.lit(True)),
        "EVIDENCE_NODE": F.coalesce(F.exists("evidence", _bad_node), F.lit(False)),
        "FALSE_FIELDS": is_(MACHINE_FALSE) & ~(codes & nodes & ~why),
        "TRUE_FIELDS": is_(MACHINE_TRUE) & ~(~codes & nodes & ~why),
        "UNCERTAIN_FIELDS": is_(MACHINE_UNCERTAIN) & ~(~codes & why),
        "REVIEWED_AT": ~T.is_zoned_time(c("reviewed_at")),
        "ROLE": ~(both | third),
        "CONSENSUS": both & ~F.coalesce(people(2) & ~p["blind_first"] & _empty(p["route_reasons"]) & p["blind_sha256"].isNull() & p["final_sha256"].isNull(), F.lit(False)),
        "ADJUDICATOR": third & ~F.coalesce(people(1) & p["blind_first"] & ~_empty(p["route_reasons"]) & hashes, F.lit(False)),
        "LINKED_BEFORE_FREEZE": ~_empty(c("linked_entry_ids")),
    }
    p_tests = {"PREDICTION_ID": _blank(c("finding_id")), "VERDICT": ~F.coalesce(c("verdict").isin(*VERDICTS), F.lit(False))}
    return together(
        empty(labels, "labels"),
        empty(predictions, "predictions"),
        broken(labels, tests, "finding_id", label),
        broken(predictions, p_tests, "finding_id", c("verdict")),
        repeated(labels, "finding_id", "REPEATED_LABEL"),
        repeated(predictions, "finding_id", "REPEATED_PREDICTION"),
        different_ids(labels, predictions, names=("MISSING_PREDICTION", "MISSING_LABEL")),
    )


def predictions(rows: DataFrame, blind: DataFrame) -> DataFrame:
    """What is wrong with frozen predictions (finding_id, verdict, confidence, reason_codes, reasoning, evidence, abstain_reason)."""
    c = F.col
    is_ = lambda x: F.coalesce(c("verdict") == x, F.lit(False))
    true, false, abstain = VERDICTS
    codes, nodes, why = ~_empty(c("reason_codes")), ~_empty(c("evidence")), ~_blank(c("abstain_reason"))
    tests = {
        "VERDICT": ~F.coalesce(c("verdict").isin(*VERDICTS), F.lit(False)),
        "CONFIDENCE": ~F.coalesce(c("confidence").isin(*CONFIDENCES), F.lit(False)),
        "REASONING": _blank(c("reasoning")),
        "FALSE_FIELDS": is_(false) & ~(codes & nodes & ~why),
        "TRUE_FIELDS": is_(true) & ~(~codes & nodes & ~why),
        "ABSTAIN_FIELDS": is_(abstain) & ~(~codes & why),
        "EVIDENCE_NODE": F.coalesce(F.exists("evidence", _bad_node), F.lit(False)),
    }
    return together(broken(rows, tests, "finding_id", c("verdict")), repeated(rows, "finding_id"), different_ids(rows, blind, names=("EXTRA_PREDICTION", "MISSING_PREDICTION")))


# The mode in which machine reviewers run, and why their predictions stay out of evaluation.
DEVELOPMENT, NOT_ELIGIBLE = "DEVELOPMENT", "DEVELOPMENT_OR_PARTIAL_INPUT"
#: What a prediction has to say in words.
STATED = ("attacker_capability", "entry_point", "security_effect", "controls", "reasoning")


def prediction_core(rows: DataFrame, run: dict[str, str | None], config: dict[str, str]) -> DataFrame:
    """What keeps machine predictions from being those of a frozen development run.

    ``rows``: finding_id, schema_version, verdict, confidence,
    evaluation_eligible, exclusion_reason, reason_codes, the texts of
    ``STATED``, agent(provider, provider_version, model). ``run`` has
    evaluation_mode, provider, provider_version and model, ``config`` the
    frozen provider and model. A run at fault is told once, by its field.
    """
    c = F.col
    false = F.coalesce(c("verdict") == VERDICTS[1], F.lit(False))
    agent = {"provider": config["provider"], "provider_version": run.get("provider_version"), "model": config["model"]}
    tests = {
        "SCHEMA_VERSION": ~c("schema_version").eqNullSafe(F.lit(1)),
        "VERDICT": ~F.coalesce(c("verdict").isin(*VERDICTS), F.lit(False)),
        "CONFIDENCE": ~F.coalesce(c("confidence").isin(*CONFIDENCES), F.lit(False)),
        "ELIGIBLE": ~c("evaluation_eligible").eqNullSafe(F.lit(False)) | ~c("exclusion_reason").eqNullSafe(F.lit(NOT_ELIGIBLE)),
        "REASON_CODES": c("reason_codes").isNull() | ~_own_strings(c("reason_codes")) | ~F.coalesce(F.forall("reason_codes", lambda x: x.isin(*FP_REASONS)), F.lit(True)),
        "REASONS_AND_VERDICT": false == _empty(c("reason_codes")),
        **{f"EMPTY_{name.upper()}": _blank(c(name)) for name in STATED},
        "AGENT": reduce(Column.__or__, [~c(f"agent.{k}").eqNullSafe(F.lit(v)) for k, v in agent.items()]),
    }
    wanted = {"evaluation_mode": DEVELOPMENT, "provider": config["provider"], "model": config["model"], "provider_version": run.get("provider_version") or "a version"}
    faults = [("RUN", k, str(run.get(k))) for k, v in wanted.items() if run.get(k) != v]
    of_run = rows.sparkSession.createDataFrame(faults, "rule_id string, key string, detail string")
    return together(broken(rows, tests, "finding_id"), repeated(rows, "finding_id"), of_run)


# --- leaks ------------------------------------------------------------------


def _leaves(schema: ST.DataType, value: Column, path: str) -> list[tuple[str, Column]]:
    """All strings below a column as (path, array of strings)."""
    if isinstance(schema, ST.StringType):
        return [(path, F.array(value))]
    if isinstance(schema, ST.StructType):
        return [x for f in schema for x in _leaves(f.dataType, value[f.name], f"{path}.{f.name}")]
    if isinstance(schema, ST.ArrayType):
        inner = _inner(schema.elementType)
        return [(f"{path}[]{p}", F.flatten(F.transform(value, get))) for p, get in inner]
    if isinstance(schema, ST.MapType):
        return _leaves(ST.ArrayType(schema.keyType), F.map_keys(value), f"{path}.keys") + _leaves(ST.ArrayType(schema.valueType), F.map_values(value), f"{path}.values")
    return []


def _inner(schema: ST.DataType):
    """(path, function from an element to its strings) of all strings below an array's element."""
    if isinstance(schema, ST.StringType):
        return [("", lambda e: F.array(e))]
    if isinstance(schema, ST.StructType):
        return [(f".{f.name}{p}", _of_field(get, f.name)) for f in schema for p, get in _inner(f.dataType)]
    if isinstance(schema, ST.ArrayType):
        return [(f"[]{p}", _of_elements(get)) for p, get in _inner(schema.elementType)]
    return []


def _of_field(get, name: str):
    return lambda e: get(e[name])


def _of_elements(get):
    return lambda e: F.flatten(F.transform(e, get))


def _names(schema: ST.DataType, path: str):
    if isinstance(schema, ST.StructType):
        for f in schema:
            yield f"{path}.{f.name}", f.name
            yield from _names(f.dataType, f"{path}.{f.name}")
    elif isinstance(schema, ST.ArrayType):
        yield from _names(schema.elementType, path)
    elif isinstance(schema, ST.MapType):
        yield from _names(schema.valueType, path)


def forbidden_columns(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_KEYS) -> list[str]:
    """Paths of columns and fields that a blind input must not have, from the schema alone."""
    token = lambda name: "".join(c for c in name.casefold() if c.isascii() and c.isalnum())
    return [path for path, name in _names(rows.schema, "$") if token(name) in forbidden]


def leaks(rows: DataFrame, key: str = "finding_id", max_chars: int = 1_000_000) -> DataFrame:
    """Strings anywhere in a row that name an advisory or a known entry, or are too long.

    The schema is walked when the plan is made, so every string is one native
    test on the executors.
    """
    tests = {
        "ADVISORY_ID": lambda s: s.rlike(T.ADVISORY),
        "ENTRY_ID": lambda s: s.rlike(T.ENTRY_NAME),
        "TOO_LONG": lambda s: F.length(s) > max_chars,
    }
    leaves = [x for f in rows.schema if f.name != key for x in _leaves(f.dataType, F.col(f.name), f"$.{f.name}")]
    found = [
        F.when(F.coalesce(F.exists(strings, test), F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(path).alias("detail")))
        for path, strings in leaves
        for rule, test in tests.items()
    ]
    none = F.array().cast("array<struct<rule_id:string,detail:string>>")
    # Most rows have nothing to tell, and one look at all their strings says so.
    any_ = lambda s: s.rlike(f"{T.ADVISORY}|{T.ENTRY_NAME}") | (F.length(s) > max_chars)
    told = F.exists(F.concat(*[F.coalesce(strings, F.array().cast("array<string>")) for _, strings in leaves]), lambda s: F.coalesce(any_(s), F.lit(False))) if found else None
    each = F.when(told, F.array_compact(F.array(*found))).otherwise(none) if found else none
    return rows.select(F.col(key).alias("key"), F.explode(each).alias("x")).select("x.rule_id", "key", "x.detail")


_TOLD = "array<struct<rule_id:string,detail:string>>"
_LEVEL = "array<struct<path:string,name:string,value:variant>>"


def _members(node: Column) -> Column:
    """The members of an object or array, each with its path."""
    named = F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>"))
    listed = F.try_variant_get(node["value"], "$", "array<variant>")
    of_object = F.transform(named, lambda e: F.struct(F.concat(node["path"], F.lit("."), e["key"]).alias("path"), e["key"].alias("name"), e["value"].alias("value")))
    of_array = F.transform(listed, lambda x, i: F.struct(F.concat(node["path"], F.lit("["), i, F.lit("]")).alias("path"), F.lit(None).cast("string").alias("name"), x.alias("value")))
    return F.coalesce(F.when(F.schema_of_variant(node["value"]).startswith("OBJECT"), of_object), of_array, F.array().cast(_LEVEL))


def json_leaks(
    rows: DataFrame, json_col: str, key: str, forbidden: tuple[str, ...] = FORBIDDEN_KEYS, max_depth: int = 64, max_values: int = 100_000, max_chars: int = 1_000_000
) -> DataFrame:
    """Rows (rule_id, key, detail): what JSON of any shape must not hold, ``detail`` being its path.

    The value is walked level by level, down to the first level that is too
    deep: forbidden keys, advisory and entry ids in strings, strings that are
    too long, values that lie too deep or are too many. Text that is no JSON,
    or null, is told too. One fold of native functions; a level that is empty
    costs next to nothing.
    """
    found = {
        "FORBIDDEN_KEY": lambda x, text: F.regexp_replace(F.lower(x["name"]), "[^a-z0-9]", "").isin(*forbidden),
        "ADVISORY_ID": lambda x, text: text.rlike(T.ADVISORY),
        "ENTRY_ID": lambda x, text: text.rlike(T.ENTRY_NAME),
        "TOO_LONG": lambda x, text: F.length(text) > max_chars,
    }

    def told(x: Column) -> Column:
        text = F.when(F.schema_of_variant(x["value"]) == "STRING", F.try_variant_get(x["value"], "$", "string"))
        each = [F.when(F.coalesce(test(x, text), F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), x["path"].alias("detail"))) for rule, test in found.items()]
        return F.array_compact(F.array(*each))

    def step(state: Column, depth: Column) -> Column:
        deep = F.transform(state["level"], lambda x: F.struct(F.lit("TOO_DEEP").alias("rule_id"), x["path"].alias("detail")))
        more = F.when(depth > max_depth, deep).otherwise(F.flatten(F.transform(state["level"], told)))
        below = F.when(depth > max_depth, F.array().cast(_LEVEL)).otherwise(F.flatten(F.transform(state["level"], _members)))
        return F.struct(below.alias("level"), (state["n"] + F.size(state["level"])).alias("n"), F.concat(state["told"], more).alias("told"))

    root = F.array(F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col("v").alias("value"))).cast(_LEVEL)
    begin = F.struct(root.alias("level"), F.lit(0).alias("n"), F.array().cast(_TOLD).alias("told"))
    many = F.array(F.struct(F.lit("TOO_MANY_VALUES").alias("rule_id"), F.lit("$").alias("detail"))).cast(_TOLD)
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(max_depth + 1)), begin, step, lambda state: F.when(state["n"] > max_values, F.concat(state["told"], many)).otherwise(state["told"]))
    no_json = F.array(F.struct(F.lit("NOT_JSON").alias("rule_id"), F.lit("$").alias("detail"))).cast(_TOLD)
    parsed = rows.select(F.col(key).alias("key"), F.try_parse_json(json_col).alias("v"))
    return parsed.select("key", F.explode(F.when(F.col("v").isNull(), no_json).otherwise(walked)).alias("x")).select("x.rule_id", "key", "x.detail")


def unknown_keys(rows: DataFrame, json_col: str, key: str, allowed: list[str]) -> DataFrame:
    """Top-level keys of JSON objects that are not allowed."""
    extra = F.array_except(F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    return rows.select(F.lit("UNKNOWN_KEY").alias("rule_id"), F.col(key).alias("key"), F.explode(extra).alias("detail"))


def blind_inputs(rows: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """What is wrong with a blind input: forbidden columns, malformed or repeated findings, leaks, too many rows."""
    spark = rows.sparkSession
    columns = spark.createDataFrame([("FORBIDDEN_KEY", p, "") for p in forbidden_columns(rows)], "rule_id string, key string, detail string")
    c = F.col
    tests = {
        "FINDING_ID": _blank(c("finding_id")),
        "REPO_URL": ~F.coalesce(c("repo_url").startswith("https://"), F.lit(False)),
        "COMMIT": ~F.coalesce(c("commit").rlike("^[0-9a-f]{40}$"), F.lit(False)),
        "PATH": ~T.is_safe_path(c("location.file")),
        "LINES": ~F.coalesce((c("location.start_line") >= 1) & (c("location.end_line") >= c("location.start_line")), F.lit(False)),
        "TRACE": F.coalesce(F.exists("dataflow_trace", lambda n: ~T.is_safe_path(n["file"]) | strict_span(n["line"]).isNull()), F.lit(False)),
    }
    many = rows.agg(F.count("*").alias("n")).filter(F.col("n") > max_rows).select(F.lit("TOO_MANY_ROWS").alias("rule_id"), F.lit("").alias("key"), F.col("n").cast("string").alias("detail"))
    return together(columns, many, broken(rows, tests, "finding_id"), repeated(rows, "finding_id"), leaks(rows))


def frozen_copy(kept: DataFrame, recomputed: DataFrame, key: str = "finding_id") -> DataFrame:
    """Rows of a frozen package that recomputing does not give again, and the other way round."""
    columns = sorted(kept.columns)
    a, b = kept.select(columns), recomputed.select(columns)
    lost = a.exceptAll(b).select(F.lit("NOT_RECOMPUTED").alias("rule_id"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))
    new = b.exceptAll(a).select(F.lit("NOT_FROZEN").alias("rule_id"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))
    return lost.unionByName(new)


def manifest_differences(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path, sha256, records) whose content is not what a manifest states."""
    f = found.select("path", F.col("sha256").alias("f_sha"), F.col("records").alias("f_records"))
    j = stated.select("path", "sha256", "records").join(f, "path", "left")
    tests = {
        "MISSING_FILE": F.col("f_sha").isNull(),
        "SHA256": F.col("f_sha").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("f_sha")),
        "RECORDS": F.col("f_sha").isNotNull() & ~F.col("records").eqNullSafe(F.col("f_records")),
    }
    return broken(j, tests, "path")


def corpus_violations(run: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """What keeps an input from being the official corpus: its run (status,
    complete, path, sha256, records) is not complete, the file (path, sha256)
    is another, or it holds another number of records."""
    n = records.agg(F.count("*").alias("n"))
    j = run.join(files.select("path", F.col("sha256").alias("found")), "path", "left").crossJoin(n)  # one row each
    tests = {
        "NOT_COMPLETE": ~F.coalesce((F.col("status") == "COMPLETE") & F.col("complete"), F.lit(False)),
        "SHA256": ~F.col("sha256").eqNullSafe(F.col("found")),
        "RECORDS": ~F.col("records").eqNullSafe(F.col("n")),
    }
    return broken(j, tests, "path")
