"""Files in and out: JSON lines, raw reports, SARIF, ledgers, rule files, streams."""

import json

import pytest
from pyspark.sql import functions as F

from findloom.operators import findings, ledger, rules
from findloom.sources import code, jsonl, scratch
from findloom.sources import ledger as files
from findloom.sources import reports
from findloom.streaming import attempts

CONTEXT = reports.Context("https://github.com/example/project.git", "a" * 40, "semgrep", "1.22.0", "b" * 40, "scan", "raw.json")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return f"file://{path}"


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "x.jsonl", '{"a": 1}\n\n[1]\nnot json\n{"a": 3}\n')
    rows = jsonl.read_jsonl(spark, path, "a int").cache()
    assert sorted(r["a"] for r in rows.filter("a is not null").collect()) == [1, 3]
    assert rows.filter(f"{jsonl.CORRUPT} is not null").count() == 2
    got = {(r["rule_id"], r["detail"]) for r in jsonl.line_violations(spark, path, max_rows=3).collect()}
    assert got == {("NOT_AN_OBJECT", "[1]"), ("NOT_AN_OBJECT", "not json"), ("TOO_MANY_ROWS", "4")}
    assert {r["rule_id"] for r in jsonl.line_violations(spark, put(tmp_path / "e.jsonl", "\n"), 10).collect()} == {"NO_ROWS"}
    out = f"file://{tmp_path}/out"
    jsonl.write_jsonl(rows.filter("a is not null").select(F.lit(None).cast("string").alias("z"), "a"), out, "a")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":1,"z":null}', '{"a":3,"z":null}']
    assert jsonl.manifest(spark, f"{out}/part-*").agg(F.sum("records")).first()[0] == 2


def test_scanner_json(spark, tmp_path):
    place = lambda line, path=".\\src\\a.py": {"path": path, "start": {"line": line, "col": 2}, "end": {"line": line, "col": 5}}
    result = {
        "check_id": "py.exec", **place(9), "end": {"line": 3, "col": 9},
        "extra": {
            "message": "m", "severity": "ERROR", "lines": "requires login", "fingerprint": "requires login", "metadata": {"cwe": "CWE-078: x", "category": "security"},
            "dataflow_trace": {
                "taint_source": ["CliLoc", [{"path": "src/s.py", "start": {"line": 1}, "end": {"line": 2}}, "src()"]],
                "intermediate_vars": [{"location": place(4, "src/s.py"), "content": "v"}, {"location": place(4, "src/s.py"), "content": "again"}, {"location": place(0)}],
                "taint_sink": ["CliCall", [[{"path": "src/a.py", "start": {"line": 9}, "end": {"line": 9}}, "sink()"], [], []]],
            },
        },
    }
    raw = {"version": "1.22.0", "results": [result, {"check_id": " ", "path": "x"}, {"check_id": "r", "path": "x", "start": {"line": True}}], "errors": [{"type": ["PartialParsing", []], "spans": [{"file": "a.py"}]}], "paths": {"scanned": ["a.py"]}}
    report = reports.read_scanner_json(spark, put(tmp_path / "raw.json", json.dumps(raw, indent=1)))
    (f,) = reports.findings_of_json(report, CONTEXT).collect()
    assert (f["location"]["file"], f["location"]["start_line"], f["location"]["end_line"], f["snippet"], f["fingerprint"]) == ("src/a.py", 9, 9, None, None)
    assert f["rule"]["cwe"] == ["CWE-78"] and f["repo_url"] == "https://github.com/example/project"
    assert [(n["file"], n["line"], n["description"], n["code"]) for n in f["dataflow_trace"]] == [("src/s.py", "1-2", "source", "CliLoc"), ("src/s.py", "4", "intermediate", "v"), ("src/a.py", "9", "sink", "CliCall")]
    assert {(r["rule_id"], r["key"]) for r in reports.report_violations(report, CONTEXT).collect()} == {("NO_RULE", "raw.json#results/1"), ("NO_PLACE", "raw.json#results/2")}
    jobs = report.select(F.lit("r").alias("repo_url"), F.lit("c").alias("commit"), F.lit("s").alias("scanner"), "errors", "results", "paths")
    assert tuple(ledger.errors_of(jobs).first())[4:5] == ("PartialParsing",) and ledger.errors_of(jobs).first()["path"] == "a.py"
    d = ledger.diagnostics(jobs).first()
    assert (d["errors_total"], d["partial_parsing_files"], d["findings"], d["scanned_paths"]) == (1, ["a.py"], 3, 1)


def test_sarif_and_merging(spark, tmp_path):
    spot = lambda line, text=None: {"artifactLocation": {"uri": "src/a.py"}, "region": {"startLine": line, "startColumn": 2, **({"snippet": {"text": text}} if text else {})}}
    step = lambda line, message: {"location": {"message": {"text": message}, "physicalLocation": spot(line, f"l{line}")}}
    sarif = {
        "runs": [{
            "tool": {"driver": {"semanticVersion": "1.22.0", "rules": [{"id": "py.exec", "properties": {"tags": ["external/cwe/cwe-078"], "category": "injection"}, "defaultConfiguration": {"level": "error"}}]}},
            "results": [{
                "ruleId": "py.exec", "message": {"text": "m"}, "locations": [{"physicalLocation": spot(9, "sink()")}],
                "codeFlows": [{"threadFlows": [{"locations": [step(1, "source"), step(3, "sink"), step(3, "sink")]}]}], "partialFingerprints": {"k": "v"},
            }],
        }]
    }
    (s,) = reports.findings_of_sarif(reports.read_sarif(spark, put(tmp_path / "x.sarif", json.dumps(sarif))), CONTEXT).collect()
    assert [(n["line"], n["description"]) for n in s["dataflow_trace"]] == [("1", "source"), ("3", "sink")]
    assert s["rule"]["cwe"] == ["CWE-78"] and s["rule"]["severity"] == "error" and s["rule"]["category"] == "injection" and s["snippet"] == "sink()"
    raw = {"version": "1.22.0", "results": [{"check_id": "py.exec", "path": "src/a.py", "start": {"line": 9, "col": 2}, "end": {"line": 9}, "extra": {"message": "m", "metadata": {"cwe": ["CWE-79"]}}}]}
    own = reports.findings_of_json(reports.read_scanner_json(spark, put(tmp_path / "r.json", json.dumps(raw))), CONTEXT)
    other = reports.findings_of_sarif(reports.read_sarif(spark, f"file://{tmp_path}/x.sarif"), CONTEXT)
    (m,) = findings.with_second_report(own, other).collect()
    assert m["finding_id"] == own.first()["finding_id"] and len(m["dataflow_trace"]) == 2 and m["rule"]["cwe"] == ["CWE-78", "CWE-79"]
    assert m["snippet"] == "sink()" and m["rule"]["category"] == "injection" and len(m["provenance"]["evidence_refs"]) == 2
    (twice,) = findings.with_second_report(own, other.unionByName(other)).collect()
    assert twice["dataflow_trace"] == []


def test_contexts():
    assert CONTEXT.violations() == []
    assert reports.Context("http://x", "zz", "", "1", "b" * 40, "s", "r").violations() == ["commit", "repo_url", "scanner"]


def test_ledger_files(spark, tmp_path):
    for n, status in ((1, "TIMEOUT"), (2, "SUCCESS")):
        put(tmp_path / f"r/c/s/attempts/{n:04d}/status.json", json.dumps({"scan_id": "x", "attempt": n, "repo_url": "r", "commit": "c", "scanner": {"name": "s"}, "status": status}))
    put(tmp_path / "r/c/t/attempts/0001/status.json", json.dumps({"scan_id": "x", "attempt": 7, "repo_url": "r", "commit": "c", "scanner": {"name": "t"}, "status": "FAILED"}))
    put(tmp_path / "r/c/s/status.json", json.dumps({"scan_id": "x", "repo_url": "r", "commit": "c", "scanner": "s", "status": "SUCCESS", "attempt": 2, "attempt_status": "attempts/0002/status.json"}))
    put(tmp_path / "r/c/t/status.json", json.dumps({"scan_id": "x", "repo_url": "r", "commit": "c", "scanner": "t", "status": "FAILED", "attempt": 1, "attempt_status": "../x"}))
    a, p = files.read_attempts(spark, f"file://{tmp_path}"), files.read_pointers(spark, f"file://{tmp_path}")
    assert a.count() == 3 and p.count() == 2
    assert sorted(r["rule_id"] for r in files.violations(a, p).collect()) == ["ATTEMPT_NUMBER", "PATH_OUTSIDE", "POINTER_WITHOUT_ATTEMPT"]
    states = {r["scanner"]: (r["attempts"], r["timeouts"], r["state"]) for r in ledger.job_states(a, 1).collect()}
    assert states == {"s": (2, 1, "SUCCESS"), "t": (1, 0, "FAILED")}


def test_utf8_is_judged_by_bytes(spark, tmp_path):
    """A sound replacement character is no fault, broken bytes are one even where they stand in an object."""
    (tmp_path / "u.jsonl").write_bytes('{"a": "\ufffd é"}\n'.encode() + b'{"a": "\xff\xe9"}\n')
    got = [(r["rule_id"], r["detail"]) for r in jsonl.line_violations(spark, f"file://{tmp_path}/u.jsonl").collect()]
    assert ("INVALID_UTF8", '{"a": "\ufffd\ufffd"}') in got and {d for _, d in got} == {'{"a": "\ufffd\ufffd"}'}


def test_written_tables_are_released(spark):
    first = scratch.written(spark.range(3), "kept")
    assert first.count() == 3
    path = scratch._NAMED[-1]
    assert scratch.release(spark) >= 1 and scratch.release(spark) == 0
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_rule_files(spark, tmp_path):
    put(tmp_path / "tree/python/a.yaml", "rules:\n- id: one # c\n  metadata:\n    category: security\n- id: 'two'\n  metadata:\n    category: \"style\"\n")
    put(tmp_path / "tree/go/b.yml", "rules:\n  - id: one\n    metadata: {}\n")
    put(tmp_path / "tree/go/b.test.yml", "- id: ignored\n")
    tree = code.read_tree(spark, f"file://{tmp_path}/tree")
    ids = sorted((r["file"], r["line"], r["rule_id"]) for r in code.rule_ids(tree).collect())
    assert ids == [("go/b.yml", 2, "one"), ("python/a.yaml", 2, "one"), ("python/a.yaml", 5, "two")]
    verdicts = {r["file"]: r["verdict"] for r in rules.security_files(code.rule_categories(tree)).collect()}
    assert verdicts == {"python/a.yaml": "MIXED", "go/b.yml": "SKIPPED"}
    config = rules.routes(spark, {"go": ["go"], "python": ["python", "../x"]})
    langs = spark.createDataFrame([("go",), ("rust",)], "language string")
    assert {r["rule_id"] for r in rules.unrouted(langs, config).collect()} == {"NO_RULE_FOLDER", "UNSAFE_FOLDER"}
    snapshots = spark.createDataFrame([("r", "c", ["Golang"]), ("r", "d", [])], "repo_url string, commit string, languages array<string>")
    found = spark.createDataFrame([("r", "c", "python"), ("r", "d", "python")], "repo_url string, commit string, language string")
    got = sorted((r["commit"], r["folder"]) for r in rules.snapshot_configs(snapshots, found, config, aliases={"golang": "go"}).collect())
    assert got == [("c", "go"), ("d", "../x"), ("d", "python")]


def test_source_slices(spark):
    t = spark.createDataFrame([("a.py", "one\ntwo\r\nthree\n")], "file string, text string")
    ls = code.lines_of(t, ["file"])
    assert [r["text"] for r in ls.orderBy("n").collect()] == ["one", "two", "three"]
    wanted = spark.createDataFrame([("f", 0, "a.py", 2, 9), ("f", 1, "a.py", 1, 1), ("f", 2, "b.py", 1, 1)], "finding_id string, position int, file string, start int, end int")
    got = code.slices(wanted, ls, ["file"], numbered=True)
    assert {r["position"]: r["slice"] for r in got.collect()} == {0: "2: two\n3: three", 1: "1: one", 2: None}
    assert sorted(r["position"] for r in code.within_budget(got, 16).collect()) == [0]


@pytest.mark.parametrize("rows", [3])
def test_stream_of_attempts(spark, tmp_path, rows):
    source = tmp_path / "in"
    line = lambda n, status: json.dumps({"scan_id": "x", "attempt": n, "repo_url": "r", "commit": "c", "scanner": "s", "status": status, "ended_at": f"2026-01-01T0{n}:30:00Z"})
    put(source / "1.json", line(1, "TIMEOUT") + "\n")
    states = attempts.job_states(attempts.read_attempts(spark, f"file://{source}"))
    table, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    for n in range(2, rows + 1):
        q = attempts.keep_table(states, table, mark).trigger(availableNow=True).start()
        q.awaitTermination(120)
        put(source / f"{n}.json", line(n, "SUCCESS" if n == rows else "TIMEOUT") + "\n")
    q = attempts.keep_table(states, table, mark).trigger(availableNow=True).start()
    q.awaitTermination(120)
    (r,) = attempts.read_table(spark, table).collect()
    assert (r["attempts"], r["timeouts"], r["status"], r["spent"]) == (3, 2, "SUCCESS", True)
