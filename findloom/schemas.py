"""Explicit schemas and fixed vocabularies of the findings data model."""

from __future__ import annotations

TRACE_NODE = "struct<file:string,line:string,description:string,code:string>"
OBSERVATION = "struct<scanner:string,rule_id:string>"

FINDING = (
    "schema_version int, finding_id string, canonical_finding_id string, repo_url string, commit string, "
    "scanner struct<name:string,version:string>, "
    "rule struct<id:string,ruleset_commit:string,cwe:array<string>,category:string,severity:string>, "
    "message string, location struct<file:string,start_line:int,end_line:int,start_col:int,end_col:int>, "
    f"dataflow_trace array<{TRACE_NODE}>, snippet string, fingerprint string, "
    f"provenance struct<raw_result_ref:string,evidence_refs:array<string>,scan_id:string,observed_by:array<{OBSERVATION}>>"
)

_NODE = "struct<file:string,line:string,code:string>"
ENTRY = (
    "entry_id string, report_id string, repo_url string, commit string, project string, verify int, "
    f"vuln_category_l1 string, vuln_category_l2 string, entry_point {_NODE}, critical_operation {_NODE}, trace array<{_NODE}>"
)
REPORT = "report_id string, entry_ids array<string>, num_entries int"

PREDICTION = "finding_id string, verdict string, confidence string, evaluation_eligible boolean"

ATTEMPT = (
    "scan_id string, attempt int, repo_url string, commit string, scanner string, status string, "
    "error struct<type:string,message:string>, started_at string, ended_at string, duration_seconds double"
)

#: Reports of scanners. ``results`` keep their loosely typed parts as JSON text.
SCANNER_REPORT = "version string, results array<string>, errors array<string>, paths struct<scanned:array<string>>"
RESULT = (
    "check_id string, path string, start struct<line:string,col:string,column:string>, end struct<line:string,col:string,column:string>, "
    "extra struct<message:string,severity:string,fingerprint:string,lines:string,dataflow_trace:string,"
    "metadata:struct<cwe:string,category:string,subcategory:string>>"
)

# Verdicts, labels and codes as the data files spell them.
TRUE, FALSE, ABSTAIN = "TRUE_POSITIVE", "FALSE_POSITIVE", "ABSTAIN"
VERDICTS = (TRUE, FALSE, ABSTAIN)
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
GOLD_TRUE = ("TP_KNOWN", "TP_NOVEL")
GOLD_FALSE = "FP_CONFIRMED"
GOLD_EXCLUDED = ("UNCERTAIN", "DUPLICATE", "OUT_OF_SCOPE")
MACHINE_TRUE, MACHINE_FALSE, MACHINE_UNCERTAIN = "MACHINE_TRUE_POSITIVE", "MACHINE_FALSE_POSITIVE", "MACHINE_UNCERTAIN"
FP_REASONS = (
    "UNREACHABLE_CODE",
    "NO_ATTACKER_CONTROL",
    "SANITIZED_BEFORE_SINK",
    "CONSTANT_VALUE",
    "AUTHZ_PRECONDITION_BLOCKS_ATTACK",
    "SAFE_API_USAGE",
    "TYPE_OR_SCHEMA_CONSTRAINT",
    "TEST_OR_FIXTURE_ONLY",
    "DEAD_OR_UNUSED_PATH",
    "FRAMEWORK_GUARANTEE",
    "SCANNER_MODELING_ERROR",
    "OTHER_EXPLAINED",
)
TIERS = ("STRICT_SOURCE_SINK", "STRONG_SOURCE_SINK", "CANDIDATE_REVIEW", "UNMATCHED")
NO_RULES = "NoApplicableRuleConfig"
SPLITS = ("train", "validation", "test")
