"""Golden cases of deduplication, matching, metrics, evidence and splits."""

import hashlib
import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from findloom.functions import lines
from findloom.functions import text as T
from findloom.functions.canonical import canonical, canonical_json, is_native, json_hash, to_json
from findloom.operators import audit, dataset, dedup, findings, gates, ledger, matching, metrics, packages, reviews, sampling, usage
from findloom.schemas import ENTRY, FINDING


def finding(ref, scanner="semgrep", line=20, end=None, rule="python.command-injection", cwe=("CWE-78",), cols=(5, 20), snippet="os.system(user_input)", **more):
    row = {
        "schema_version": 1, "finding_id": more.get("id", f"finding-{ref}"), "canonical_finding_id": None, "repo_url": more.get("repo", "https://github.com/example/project"),
        "commit": more.get("commit", "a" * 40), "scanner": Row(name=scanner, version="1.0.0"),
        "rule": Row(id=rule, ruleset_commit="b" * 40, cwe=list(cwe), category=more.get("category"), severity="ERROR"), "message": "command injection",
        "location": Row(file=more.get("file", "src/handler.py"), start_line=line, end_line=end or line, start_col=cols[0], end_col=cols[1]),
        "dataflow_trace": more.get("trace", []), "snippet": snippet, "fingerprint": more.get("fingerprint"),
        "provenance": Row(raw_result_ref=f"raw/{scanner}.json#results/{ref}", evidence_refs=[f"e{ref}"], scan_id="s", observed_by=[Row(scanner=scanner, rule_id=rule)]),
    }
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def clusters(spark, rows, tolerance=5):
    got = dedup.summaries(dedup.canonical(frame(spark, rows), tolerance)).collect()
    spark.catalog.clearCache()
    return sorted((r["cluster_type"], r["member_count"], r["start_line"], r["end_line"]) for r in got)


def test_exact_duplicates_stay_and_share_an_id(spark):
    f = frame(spark, [finding("1", id="x"), finding("2", id="x")])
    rows = dedup.canonical(f).collect()
    assert len(rows) == 2 and len({r["canonical_finding_id"] for r in rows}) == 1
    assert dedup.summaries(dedup.canonical(f)).first()["cluster_type"] == "EXACT_DUPLICATE"


@pytest.mark.parametrize(
    "other,expected",
    [
        ({"line": 32}, 1),
        ({"line": 32, "rule": "z", "cwe": ()}, 1),  # the snippet is shared
        ({"line": 32, "rule": "z", "snippet": None}, 1),  # the CWE
        ({"line": 32, "rule": "z", "snippet": None, "cwe": ()}, 2),
        ({"line": 33}, 2),
        ({"line": 30, "cwe": ("CWE-79",)}, 2),
        ({"line": 30, "snippet": "else"}, 2),
        ({"line": 30, "cols": (30, 42)}, 2),
        ({"line": 30, "cols": (None, 42)}, 1),
        ({"line": 30, "scanner": "semgrep"}, 1),  # the very same observation
        ({"line": 30, "commit": "c" * 40}, 2),
        ({"line": 30, "file": "./src//handler.py"}, 1),
        ({"line": 30, "file": "src/b.py"}, 2),
    ],
)
def test_cross_tool_pairs(spark, other, expected):
    got = clusters(spark, [finding("1", line=30), finding("2", **({"scanner": "other"} | other))], 2)
    assert len(got) == expected


def test_places_do_not_chain_and_order_does_not_matter(spark):
    rows = [finding("1", line=10), finding("2", scanner="other", line=12), finding("3", scanner="third", line=14)]
    for order in itertools.permutations(rows):
        assert clusters(spark, list(order), 2) == [("CROSS_TOOL_SEMANTIC", 2, 10, 12), ("SINGLETON", 1, 14, 14)]


def test_finding_gate(spark):
    rows = [finding("1", id="x"), finding("2", id="x", line=40), finding("3", line=0), finding("4", rule=" ")]
    got = {(r["rule_id"], r["key"]) for r in findings.violations(frame(spark, rows)).collect()}
    assert got == {("CONFLICTING_IDENTITY", "x"), ("LINES", "finding-3"), ("RULE", "finding-4")}


def entry(no, line, source=1, l1="other", verify=1):
    node = lambda n: Row(file="src/handler.py", line=str(n), code="c")
    return (f"entry-{no:05d}", f"report-{no}", "https://github.com/example/project.git/", "A" * 40, "p", verify, l1, None, node(source), node(line), [node(source)])


def test_tiers(spark):
    node = lambda n: [Row(file="src\\handler.py", line=str(n), description="source", code=None)]
    rows = [finding("a", trace=node(1)), finding("b"), finding("c", line=30, trace=node(1)), finding("d", line=21, trace=node(2)), finding("e", line=21, trace=node(2), cwe=(), category="命令 注入")]
    f = frame(spark, [tuple(x) for x in rows])
    e = spark.createDataFrame([entry(1, 20, l1="命令注入")], ENTRY)
    fix = e.withColumn("repo_url", F.lit("https://github.com/example/project"))
    got = {r["finding_id"][-1]: r for r in matching.match_candidates(f, fix, 2).collect()}
    assert {k: r["match_tier"] for k, r in got.items()} == {"a": "STRICT_SOURCE_SINK", "b": "CANDIDATE_REVIEW", "c": "UNMATCHED", "d": "STRONG_SOURCE_SINK", "e": "STRONG_SOURCE_SINK"}
    assert got["d"]["matches"][0]["category_cwe_evidence"] == ["family:command_injection"]
    assert matching.match_candidates(f, fix.withColumn("verify", F.lit(0))).filter("match_tier <> 'UNMATCHED'").isEmpty()


def test_distances(spark):
    rows = spark.createDataFrame([("10-15", "14-20", 0), ("10-15", "18-20", 3), ("103", "100-102", 1), ("5-3", "1", None), ("true", "1", None), ("0", "1", None), (" 7 ", "8", 1)], "a string, b string, d int")
    a, b = lines.span(F.col("a")), lines.span(F.col("b"))
    got = rows.withColumn("x", a).withColumn("y", b).select("d", F.when(F.col("x").isNotNull(), lines.distance(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end"))).alias("g")).collect()
    assert [r["g"] for r in got] == [r["d"] for r in got]


def test_metrics(spark):
    labels = spark.createDataFrame([("a", "TP_KNOWN"), ("b", "FP_CONFIRMED"), ("c", "TP_NOVEL"), ("d", "UNCERTAIN")], "finding_id string, label string")
    p = spark.createDataFrame([("a", "TRUE_POSITIVE"), ("b", "FALSE_POSITIVE"), ("c", "ABSTAIN"), ("d", "TRUE_POSITIVE")], "finding_id string, verdict string")
    r = metrics.classification(labels, p).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["abstain_on_true"]) == (1, 1, 0, 0, 1) and r["precision"] == 1.0 and r["tp_retention"] == 0.5
    machine = spark.createDataFrame([("a", "MACHINE_TRUE_POSITIVE"), ("b", "MACHINE_TRUE_POSITIVE"), ("c", "MACHINE_FALSE_POSITIVE"), ("d", "MACHINE_FALSE_POSITIVE")], "finding_id string, label string")
    snippet = spark.createDataFrame([("a", "ABSTAIN"), ("b", "ABSTAIN"), ("c", "FALSE_POSITIVE"), ("d", "FALSE_POSITIVE")], "finding_id string, verdict string")
    r = metrics.machine_reference(machine, snippet).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["selective_coverage"], r["tp_retention"]) == (2, None, None, None, 0.5, 0.0)
    context = spark.createDataFrame([("a", "TRUE_POSITIVE"), ("b", "FALSE_POSITIVE"), ("c", "FALSE_POSITIVE"), ("d", "FALSE_POSITIVE")], "finding_id string, verdict string")
    r = metrics.machine_reference(machine, context).first()
    assert (r["precision"], r["recall"], round(r["f1"], 4), r["selective_coverage"]) == (1.0, 0.5, 0.6667, 1.0)
    same = spark.createDataFrame([("a", "TRUE_POSITIVE")], "finding_id string, verdict string")
    assert metrics.agreement(same, same).first()["cohen_kappa"] is None
    empty = metrics.classification(labels.limit(0), p).first()
    assert empty["tp"] == 0 and empty["precision"] is None


def test_evidence_restoration(spark):
    schema = "finding_id string, verdict string, position int, node struct<file:string,line:string,description:string,code:string>"
    node = lambda f, line, d, c: Row(file=f, line=line, description=d, code=c)
    code = "10: a\n11: b\n12: c\n13: d"
    exposed = [
        ("f", 0, node("a.py", "1", "d1", "x")), ("f", 1, node("a.py", "2", "d2", "y")), ("f", 2, node("a.py", "2", "d3", "y")), ("f", 3, node("b.py", "5", "e", "only")),
        ("f", 4, node("c.py", "10-13", "n", code)), ("f", 5, node("c.py", "9-13", "n", "9: z\n" + code)), ("f", 6, node("d.py", "3-4", "n", "3: p\n4:  q")),
    ]
    cited = [
        ("f", "FALSE_POSITIVE", 0, node("a.py", "1", "d1", "x")), ("f", "FALSE_POSITIVE", 1, node("a.py", "1", "d1", "changed")), ("f", "FALSE_POSITIVE", 2, node("a.py", "2", "else", "?")),
        ("f", "FALSE_POSITIVE", 3, node("b.py", "9", "else", "only")), ("f", "FALSE_POSITIVE", 4, node("d.py", "1", "w", "3: p\n4: q")), ("f", "FALSE_POSITIVE", 5, node("c.py", "11-12", "w", "11: b\n12: c")),
        ("f", "FALSE_POSITIVE", 6, node("zz.py", "1", "w", "w")), ("f", "UNCERTAIN", 7, node("zz.py", "1", "w", "w")),
    ]
    e = spark.createDataFrame(exposed, "finding_id string, position int, node struct<file:string,line:string,description:string,code:string>")
    got = {r["position"]: (r["operation"], r["node"] and r["node"]["line"]) for r in reviews.restored_evidence(spark.createDataFrame(cited, schema), e).collect()}
    assert got == {
        0: ("EXACT", "1"), 1: ("FILE_LINE_DESCRIPTION", "1"), 2: ("FILE_LINE_UNIQUE_CODE", "2"), 3: ("FILE_CODE", "5"), 4: ("FILE_NUMBERED_CODE", "3-4"),
        5: ("TIGHTEST_CONTAINING", "10-13"), 6: ("REJECTED", None), 7: ("CLEARED", None),
    }


def test_citations(spark):
    shown = spark.createDataFrame([("f", "a.py", 1, 10)], "finding_id string, file string, start int, end int")
    cited = spark.createDataFrame([("f", "a.py", 2, 10), ("f", "a.py", 5, 11), ("f", "b.py", 1, 1)], "finding_id string, file string, start int, end int")
    assert sorted((r["file"], r["start"]) for r in reviews.citations_outside(cited, shown).collect()) == [("a.py", 5), ("b.py", 1)]
    assert [(r["start"], r["end"]) for r in reviews.in_ranges(spark.createDataFrame([("f", 1, 60)], "finding_id string, start int, end int")).orderBy("start").collect()] == [(1, 25), (26, 50), (51, 60)]


def test_evidence_against_source(spark):
    ls = spark.createDataFrame([("r", "c", "a.py", 1, "x = 1"), ("r", "c", "a.py", 2, "see CVE-2020-12345")], "repo_url string, commit string, file string, n int, text string")
    node = lambda line, code: Row(file="a.py", line=line, description="", code=code)
    cited = spark.createDataFrame(
        [("f", "r", "c", 0, node("1", "1: x = 1")), ("f", "r", "c", 1, node("1-2", "1: x = 1\n2: see [REDACTED]")), ("f", "r", "c", 2, node("1", "1: x = 2")), ("f", "r", "c", 3, node("9", "9: "))],
        "finding_id string, repo_url string, commit string, position int, node struct<file:string,line:string,description:string,code:string>",
    )
    assert sorted(r["position"] for r in reviews.evidence_errors(cited, ls).collect()) == [2, 3]


def groups_of(spark, rows):
    """Groups of (line, end, start_col, end_col, scanner, rule, cwes), all in one file unless a file is given."""
    side = lambda cwes, n: [Row(cwes=cwes, categories=[], snippet_hash=None, evidence=None)]
    made = []
    for n, (line, end, lo, hi, scanner, rule, cwes, *file) in enumerate(rows):
        k = Row(repo_n="r", commit_n="c", path_n=file[0] if file else "f", start_line=line, end_line=end, start_col=-1 if lo is None else lo, end_col=-1 if hi is None else hi,
                scanner_n=scanner, version_n="", rule_n=rule, finding_id=f"{n:06d}", ref="")
        made.append((f"g{n:06d}", k, "r", "c", k.path_n, scanner, rule, line, end, lo, hi, side(cwes, n)))
    key = "struct<repo_n:string,commit_n:string,path_n:string,start_line:int,end_line:int,start_col:int,end_col:int,scanner_n:string,version_n:string,rule_n:string,finding_id:string,ref:string>"
    return spark.createDataFrame(made, f"group_key string, k {key}, repo_n string, commit_n string, path_n string, scanner_n string, rule_n string, start_line int, end_line int, start_col int, end_col int, "
                                 "sides array<struct<cwes:array<string>,categories:array<string>,snippet_hash:string,evidence:string>>")  # fmt: skip


def slow_pairs(rows, tolerance):
    found = []
    key = lambda n: (rows[n][7:], rows[n][0], rows[n][1], *(-1 if c is None else c for c in rows[n][2:4]), rows[n][4], rows[n][5], n)
    for a in range(len(rows)):
        for b in range(len(rows)):
            (la, ea, sa, ca, xa, ra, wa, *fa), (lb, eb, sb, cb, xb, rb, wb, *fb) = rows[a], rows[b]
            if key(a) >= key(b) or fa != fb or xa == xb or max(0, lb - ea, la - eb) > tolerance or (wa and wb and not set(wa) & set(wb)) or not (ra == rb != "" or set(wa) & set(wb)):
                continue
            if la == ea == lb == eb and None not in (sa, ca, sb, cb) and (ca < sb or cb < sa):
                continue
            found.append((key(a), key(b), f"g{a:06d}", f"g{b:06d}"))
    return [p[2:] for p in sorted(found)]


def random_groups(seed, n, lines, scanners="xyz", rules=3, cwes=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        line = rng.randint(1, lines)
        lo = rng.choice([None, rng.randint(1, 60)])
        rows.append((line, line + rng.choice([0, 0, 0, 1, 4, 40]), lo, None if lo is None or rng.random() < 0.1 else lo + rng.choice([0, 5, 300, -3]), rng.choice(scanners), rng.choice(["", *"rstuvw"[:rules]]),
                     rng.choice([[], [f"CWE-{rng.randint(1, cwes)}"]]), rng.choice("fg")))
    return rows


@pytest.mark.parametrize(("seed", "tolerance"), [(1, 5), (2, 0), (3, 2)])
def test_pairs_and_clusters_by_strips_are_those_of_one_pass(spark, monkeypatch, seed, tolerance):
    """Pairs against all pairs; clusters of strips of a few pairs against one merging in order, with three scanners."""
    rows = random_groups(seed, 220, 150)
    groups, want = groups_of(spark, rows), slow_pairs(rows, tolerance)
    assert sorted((r.a, r.b) for r in dedup.cross_tool_pairs(groups, tolerance).collect()) == sorted(want)
    whole = dedup._merge(want)
    assert len(set(whole.values())) < len(whole)
    for most in (100_000, 7):
        monkeypatch.setattr(dedup, "MOST_PAIRS", most)
        assert {r.group_key: r.cluster for r in dedup.clusters_of_groups(groups, tolerance).collect()} == whole


def test_strips_wait_for_what_comes_before():
    """A name whose pairs are not all known blocks what comes after it, and nothing else."""
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("c", "d")]
    assert dedup._merge(pairs, frozenset("a")) == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "d"}
    assert dedup._merge(pairs, frozenset("e"))["a"] == dedup._merge(pairs)["b"] == "a"


def test_splits(spark):
    feature = lambda repo, rule: Row(repository=repo, rule_id=rule, cwes=["CWE-1"], language="go", has_dataflow=False)
    rows = []
    for repo, tp, fp in [("a", 3, 1), ("b", 2, 2), ("c", 1, 0), ("d", 1, 0), ("e", 0, 4), ("f", 0, 4), ("g", 0, 5)]:
        rows += [(f"{repo}-t{k}", Row(label="MACHINE_TRUE_POSITIVE"), feature(repo, f"r{k}")) for k in range(tp)]
        rows += [(f"{repo}-f{k}", Row(label="MACHINE_FALSE_POSITIVE"), feature(repo, f"r{k}")) for k in range(fp)]
    df = spark.createDataFrame(rows, "finding_id string, machine_reference struct<label:string>, features struct<repository:string,rule_id:string,cwes:array<string>,language:string,has_dataflow:boolean>")
    a = dataset.assign(df, "seed")
    got = {r["repository"]: r["split"] for r in a.collect()}
    assert got["a"] == "train" and {got["b"], got["c"]} == {"validation", "test"} and got["c"] == got["d"]
    b = dataset.balanced(df, a, "seed").collect()
    per = {(r["split"], r["class"]): 0 for r in b}
    for r in b:
        per[r["split"], r["class"]] += 1
    assert per == {(s, c): n for s, n in dataset.TARGETS.items() for c in ("MACHINE_TRUE_POSITIVE", "MACHINE_FALSE_POSITIVE")}
    assert len({r["finding_id"] for r in b}) == len(b) and all(got[r["finding_id"][0]] == r["split"] for r in b)
    assert dataset.split_leaks(dataset.balanced(df, a, "seed"), df).isEmpty()
    with pytest.raises(ValueError):
        dataset.assign(df, "seed", {"train": 7, "validation": 7, "test": 7})


def test_assignment_by_table_is_as_close_as_all_ways():
    rng = random.Random(4)
    for _ in range(40):
        repos = [(f"r{k}", rng.randint(1, 9), rng.randint(0, 9)) for k in range(rng.randint(1, 7))]
        targets = dataset.targets_of(sum(r[1] for r in repos))
        off = lambda at: sum(abs(sum(r[1] for r in repos if at[r[0]] == s) - n) for s, n in targets.items())  # noqa: B023, E731
        by_table, best = dataset._by_table(repos, targets, "seed"), dataset._all_ways(repos, targets, "seed")
        assert by_table.keys() == best.keys() and off(by_table) == off(best)
    assert dataset.targets_of(7) == dataset.TARGETS


def test_assignment_by_halves_is_as_close_as_all_ways(monkeypatch):
    """Also where a table would need units of several positives, and with more repositories than halves hold."""
    rng = random.Random(8)
    off = lambda repos, targets, at: sum(abs(sum(r[1] for r in repos if at[r[0]] == s) - n) for s, n in targets.items())
    for k in range(40):
        repos = [(f"r{k}", rng.choice([rng.randint(1, 9), rng.randint(1, 10**6)]), rng.randint(0, 9)) for k in range(rng.randint(1, 7))]
        targets = dataset.targets_of(sum(r[1] for r in repos)) if k % 4 else {s: rng.randint(0, 10**6) for s in dataset.SPLITS}
        by_halves, best = dataset._by_halves(repos, targets, "seed"), dataset._all_ways(repos, targets, "seed")
        assert by_halves.keys() == best.keys() and off(repos, targets, by_halves) == off(repos, targets, best)
    for n in (17, 45):
        repos = [(f"r{k}", rng.randint(90, 150), rng.randint(0, 9)) for k in range(n)]
        targets = dataset.targets_of(sum(r[1] for r in repos))
        assert dataset._unit(repos) > 1
        assert off(repos, targets, dataset._closest(repos, targets, "seed")) == 0


def test_many_repositories_are_assigned(spark, monkeypatch):
    feature = lambda repo: Row(repository=repo, rule_id="r", cwes=[], language="go", has_dataflow=False)
    rows = [(f"{r}-{k}", Row(label=f"MACHINE_{'TRUE' if k < 1 + r % 3 else 'FALSE'}_POSITIVE"), feature(f"repo{r}")) for r in range(60) for k in range(6)]
    df = spark.createDataFrame(rows, "finding_id string, machine_reference struct<label:string>, features struct<repository:string,rule_id:string,cwes:array<string>,language:string,has_dataflow:boolean>")
    for tabled in (10_000, 5):
        monkeypatch.setattr(dataset, "MAX_TABLED", tabled)
        at = {r["repository"]: r["split"] for r in dataset.assign(df, "seed").collect()}
        have = Counter(at[f"repo{r}"] for r in range(60) for _ in range(1 + r % 3))
        assert len(at) == 60 and (dict(have) == dataset.targets_of(120) if tabled > 60 else set(have) == {"train", "validation", "test"})


def test_positives_look_further_where_their_best_are_taken(spark, monkeypatch):
    monkeypatch.setattr(dataset, "CANDIDATES", 1)
    feature = Row(repository="a", rule_id="r", cwes=[], language="go", has_dataflow=False)
    rows = [(f"p{k}", Row(label="MACHINE_TRUE_POSITIVE"), feature) for k in range(9)] + [(f"n{k}", Row(label="MACHINE_FALSE_POSITIVE"), feature) for k in range(12)]
    df = spark.createDataFrame(rows, "finding_id string, machine_reference struct<label:string>, features struct<repository:string,rule_id:string,cwes:array<string>,language:string,has_dataflow:boolean>")
    got = dataset.balanced(df, spark.createDataFrame([("a", "train")], "repository string, split string"), "seed").collect()
    tie = lambda p, n: hashlib.sha256("\0".join(["seed", "train", p, n]).encode()).hexdigest()
    free, want = {f"n{k}" for k in range(12)}, set()
    for p in sorted(f"p{k}" for k in range(9)):
        best = max(free, key=lambda n: tie(p, n))  # noqa: B023
        free.remove(best)
        want.add(best)
    assert {r["finding_id"] for r in got if r["class"] == "MACHINE_FALSE_POSITIVE"} == want and len(got) == 18


@pytest.mark.parametrize("alike", [False, True])
def test_rounds_end_where_turns_end(spark, monkeypatch, alike):
    """Of random candidates, and of ones that all positives rank alike."""
    rng = random.Random(5)
    rows, want = [], set()
    for split in ("train", "test"):
        taken = set()
        shared = rng.sample(range(40), 12)
        for p in sorted(f"p{rng.randrange(10**6):06d}" for _ in range(25 if alike else 60)):
            likes = shared if alike else rng.sample(range(70), rng.randint(0, 12))
            rows += [(split, p, f"{split}{n:02d}", rank) for rank, n in enumerate(likes)]  # no finding is in two splits
            free = [n for n in likes if n not in taken]
            if free:
                taken.add(free[0])
                want.add((split, p, f"{split}{free[0]:02d}"))
    near = spark.createDataFrame(rows, "split string, positive string, negative string, rank int")
    for most in (10**6, 0):
        monkeypatch.setattr(dataset, "MOST_TURNS", most)
        assert set(map(tuple, dataset._chosen(near).collect())) == want


def test_gates(spark):
    schema = (
        "finding_id string, schema_version int, label string, reasoning string, evidence array<string>, reviewer struct<id:string,kind:string>, "
        "verification struct<method:string,blind:boolean,independent_from_candidate_generator:boolean>, reviewed_at string, reason_codes array<string>, linked_entry_ids array<string>, linked_report_ids array<string>"
    )
    good = ("a", 1, "FP_CONFIRMED", "why", ["e"], ("m", "MODEL"), ("LLM_VERIFIED", True, True), "2026-01-01T00:00:00Z", ["CONSTANT_VALUE"], [], [])
    p = "finding_id string, verdict string, evaluation_eligible boolean"
    fine = gates.gold_inputs(spark.createDataFrame([good], schema), spark.createDataFrame([("a", "ABSTAIN", True)], p))
    assert fine.isEmpty()
    gates.gate(fine, "gold")
    bad = [
        ("b", 2, "TP_KNOWN", " ", [], ("m", "ROBOT"), None, "2026-01-01T00:00:00", ["NONE"], [], []),
        ("c", 1, "FP_CONFIRMED", "w", ["e", "e"], ("m", "MODEL"), None, None, [], ["x"], []),
        good, good,
    ]
    v = gates.gold_inputs(spark.createDataFrame(bad, schema), spark.createDataFrame([("a", "MAYBE", False)], p))
    got = {(r["rule_id"], r["key"]) for r in v.collect()}
    assert got == {
        ("SCHEMA_VERSION", "b"), ("REASONING", "b"), ("EVIDENCE", "b"), ("REVIEWER_KIND", "b"), ("REVIEWED_AT", "b"), ("REASON_CODES", "b"), ("REASON_WITHOUT_FALSE", "b"), ("KNOWN_WITHOUT_LINK", "b"),
        ("EVIDENCE", "c"), ("MODEL_VERIFICATION", "c"), ("REVIEWED_AT", "c"), ("FALSE_WITHOUT_REASON", "c"), ("LINK_WITHOUT_KNOWN", "c"),
        ("REPEATED_LABEL", "a"), ("VERDICT", "a"), ("NOT_ELIGIBLE", "a"), ("MISSING_PREDICTION", "b"), ("MISSING_PREDICTION", "c"),
    }
    with pytest.raises(gates.GateError):
        gates.gate(v, "gold")


def test_machine_gate(spark):
    schema = (
        "finding_id string, label string, confidence string, reason_codes array<string>, reasoning string, evidence array<struct<file:string,line:string,description:string,code:string>>, uncertainty_reason string, "
        "reviewer struct<role:string,ids:array<string>,models:array<string>>, reviewed_at string, provenance struct<blind_first:boolean,route_reasons:array<string>,blind_sha256:string,final_sha256:string>, linked_entry_ids array<string>"
    )
    node, t = ("a.py", "1", "d", None), "2026-01-01T00:00:00+02:00"
    both, third = ("CONSENSUS_A_B", ["a", "b"], ["m", "n"]), ("ADJUDICATOR_C", ["c"], ["o"])
    rows = [
        ("a", "MACHINE_FALSE_POSITIVE", "HIGH", ["CONSTANT_VALUE"], "r", [node], None, both, t, (False, [], None, None), []),
        ("b", "MACHINE_UNCERTAIN", "LOW", [], "r", [], "unclear", third, t, (True, ["ANY_ABSTAIN"], "a" * 64, "b" * 64), []),
        ("c", "MACHINE_TRUE_POSITIVE", "HIGH", ["X"], "r", [("../x", "0", "d", None)], None, both, t, (True, [], None, None), ["entry-1"]),
    ]
    p = spark.createDataFrame([(k, "ABSTAIN") for k in "abc"], "finding_id string, verdict string")
    got = {(r["rule_id"], r["key"]) for r in gates.machine_inputs(spark.createDataFrame(rows, schema), p).collect()}
    assert got == {("REASON_CODES", "c"), ("EVIDENCE_NODE", "c"), ("TRUE_FIELDS", "c"), ("CONSENSUS", "c"), ("LINKED_BEFORE_FREEZE", "c")}


def test_blind_gate(spark):
    f = frame(spark, [finding("1", commit="a" * 40), finding("2", file="../x", snippet="GHSA-2345-6789-cfgh")])
    got = {(r["rule_id"], r["key"]) for r in gates.blind_inputs(reviews.blind(f)).collect()}
    assert got == {("PATH", "finding-2"), ("ADVISORY_ID", "finding-2")}
    assert gates.forbidden_columns(f.withColumn("x", F.struct(F.lit(1).alias("Gold_Label")))) == ["$.x.Gold_Label"]


def test_audit(spark):
    bad = list(entry(2, 3, verify=5))
    bad[0], bad[3] = "entry-2", "zz"
    e = spark.createDataFrame([entry(1, 20), tuple(bad)], ENTRY).withColumn("commit", F.lower("commit"))
    r = spark.createDataFrame([("report-1", ["entry-00001"], 2), ("report-1", ["entry-00001"], 1)], "report_id string, entry_ids array<string>, num_entries int")
    got = {(x["rule_id"], x["key"]) for x in audit.violations(e, r).collect()}
    assert got == {("ENTRY_ID", "entry-2"), ("VERIFY", "entry-2"), ("COMMIT", "entry-2"), ("UNKNOWN_REPORT", "entry-2"), ("REPEATED_REPORT", "report-1"), ("REPORT_COUNT", "report-1")}


def test_samples(spark):
    rows = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("finding_id"))
    s = sampling.systematic(rows, 40, "s").collect()
    assert len(s) == 40 and s[0]["sample_weight"] == 25.0
    assert sorted(r["p"] for r in sampling.with_position(rows, "s", name="p").collect()) == list(range(1000))
    assert sampling.bottom_share(rows.limit(0), 0.5, "s").isEmpty()


def test_usage_of_resumed_sessions(spark):
    events = [("c", "f1", 1, None, {"t": 5}), ("c", "f1", 2, "s", {}), ("c", "f1", 3, None, {"t": 7}), ("c", "f2", 1, "s", {"t": 9}), ("c", "f2", 2, None, None)]
    df = spark.createDataFrame(events, "case string, file string, line int, thread_id string, usage map<string,long>")
    assert usage.totals(usage.by_session(df, ["case"]), ["case"]).first()["n"] == 14


def test_canonical_json_is_python_json(spark):
    value = {"b": None, "a": 'q"\u001f\u00e9\n', "n": 1}
    df = spark.createDataFrame([(None, value["a"], 1)], "b string, a string, n int")
    row = df.select(json_hash(F.struct("b", "a", "n"), df.schema).alias("h")).first()
    import hashlib

    assert row["h"] == hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


KIND = "z string, n long, b struct<y:array<struct<q:int,a:string>>,`é`:boolean,e:struct<v:int,u:string>>, m map<string,array<string>>, mm map<string,map<string,int>>, l array<array<string>>"


def test_native_canonical_json_is_python_json_at_any_depth(spark):
    """Fields and keys are sorted within structs, maps and arrays, nulls and controls kept, without Python in the plan."""
    odd = "".join(map(chr, range(0x20))) + '\\u001F\\\\\x1f\x1e"/\x7f\u2028é\U0001f600'
    rows = [
        (odd, -(1 << 63), ([(1, odd), (None, None), None], True, (None, "x")), {"b": ["2", None], "a": [], "é": None, "B": [odd], odd: [""]}, {"k": {"z": 1, "a": None}, "j": {}, "i": None}, [["b", "a"], None, []]),
        (None, None, None, None, None, None),
        ("", 0, (None, None, None), {}, {}, []),
    ]
    df = spark.createDataFrame(rows, KIND)
    out = df.select(canonical(F.struct(*df.columns), df.schema).alias("got"), canonical_json(to_json(F.struct(*df.columns))).alias("want"), canonical(F.col("m"), df.schema["m"].dataType).alias("m"), F.to_json("m").alias("m0"))
    for r in out.collect():
        assert r["got"] == r["want"] == json.dumps(json.loads(r["got"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (r["m"] is None) == (r["m0"] is None)
    plan = df.select(canonical(F.struct(*df.columns), df.schema))._jdf.queryExecution().toString()
    assert "canonical_json" not in plan and "ArrowEval" not in plan


def test_canonical_json_of_what_spark_writes_otherwise(spark):
    """Fractions, numbered keys and names that differ in case go the other way, with the same text as Python's."""
    df = spark.createDataFrame([(1e10, 0.1, {2: "b", 10: "a"})], "x double, d double, m map<int,string>")
    assert not any(is_native(f.dataType) for f in df.schema)
    assert df.select(canonical(F.struct("x", "d", "m"), df.schema)).first()[0] == '{"d":0.1,"m":{"10":"a","2":"b"},"x":10000000000.0}'
    assert not is_native(StructType.fromDDL("a string").add("A", "string")) and is_native(df.select(F.lit(1).alias("a")).schema)


def test_rule_ids_and_paths(spark):
    df = spark.createDataFrame([("home.rules.python.x", "file:///C:/Repo/a%20b+c.py"), ("old.place.home.rules.y", "/src/./x"), ("plain", None)], "r string, p string")
    got = df.select(T.rule_id(F.col("r"), "/home/rules").alias("r"), T.relative_path(F.col("p"), "c:/repo").alias("p")).collect()
    assert [tuple(r) for r in got] == [("python.x", "a b+c.py"), ("y", "/src/./x"), ("plain", "")]


def test_ledger_conflicts(spark):
    a = spark.createDataFrame([("s", 1, "r", "c", "x", "SUCCESS", "h1"), ("s", 2, "r", "c", "x", "SUCCESS", "h2")], "scan_id string, attempt int, repo_url string, commit string, scanner string, status string, sha string")
    now = spark.createDataFrame([("r", "c", "x", "h3")], "repo_url string, commit string, scanner string, sha string")
    assert [r["input"] for r in ledger.resume_conflicts(a, now, "sha").collect()] == ["sha"]
    assert ledger.latest(a).first()["sha"] == "h2"


def slow_bounded(row, budget):
    """As ``packages.bounded``, a step at a time."""
    size = lambda: len(json.dumps(row, ensure_ascii=False, separators=(",", ":")))
    while size() > budget and row["dataflow_trace"]:
        row["dataflow_trace"].pop()
    while size() > budget and any(row[c] and len(row[c]) > 64 for c in ("message", "snippet")):
        for c in ("message", "snippet"):
            if row[c] and len(row[c]) > 64:
                limit = max(64, len(row[c]) // 2)
                row[c] = row[c][: limit - 14] + "...[truncated]"
    return row, size() <= budget


def test_findings_shrink_to_a_budget(spark):
    rng = random.Random(5)
    node = lambda: {"file": "a.py", "line": str(rng.randint(1, 99)), "code": "c" * rng.randint(0, 60)}
    rows = []
    for _ in range(60):
        rows.append({"message": "m" * rng.randint(0, 900), "dataflow_trace": [node() for _ in range(rng.randint(0, 6))], "snippet": None if rng.random() < 0.2 else '"é\n' * rng.randint(0, 200)})
    df = spark.createDataFrame([Row(n=i, **r) for i, r in enumerate(rows)], "n int, message string, dataflow_trace array<struct<file:string,line:string,code:string>>, snippet string")
    for budget in (150, 400, 1000):
        got = {r["n"]: r for r in packages.bounded(df.select("message", "dataflow_trace", "snippet", "n"), budget).collect()}
        for i, row in enumerate(rows):
            want, fits = slow_bounded(json.loads(json.dumps({**row, "n": i})), budget)
            r = got[i]
            assert ([n.asDict() for n in r["dataflow_trace"]], r["message"], r["snippet"], r["fits"]) == (want["dataflow_trace"], want["message"], want["snippet"], fits)


def test_strings_of_any_depth(spark):
    df = spark.createDataFrame([("a", ["b", None], [["c"], None, ["d"]]), (None, None, None)], "x string, y array<string>, z array<array<string>>")
    kinds = {f.name: f.dataType for f in df.schema}
    got = df.select(*[T.strings_of(c, kinds[c]).alias(c) for c in kinds]).collect()
    assert [tuple(r) for r in got] == [(["a"], ["b"], ["c", "d"]), ([], [], [])]


def test_a_file_with_all_findings(spark):
    """One file of 20,000 findings and entries, half of them on one line."""
    own = [finding(f"r{i}", line=1 if i % 2 else i + 1, scanner=("semgrep", "other")[i % 2]) for i in range(20_000)]
    f = spark.createDataFrame(own, FINDING)
    e = f.filter("location.start_line % 10 = 1").select(
        F.concat(F.lit("e-"), F.col("provenance.raw_result_ref")).alias("entry_id"), F.lit("rep").alias("report_id"), "repo_url", "commit", F.lit("p").alias("project"), F.lit(1).alias("verify"),
        F.lit("x").alias("vuln_category_l1"), F.lit(None).cast("string").alias("vuln_category_l2"), F.struct(F.lit("a").alias("file"), F.lit("1").alias("line"), F.lit("").alias("code")).alias("entry_point"),
        F.struct(F.col("location.file").alias("file"), F.col("location.start_line").cast("string").alias("line"), F.lit("").alias("code")).alias("critical_operation"), F.array().cast("array<struct<file:string,line:string,code:string>>").alias("trace"),
    )
    lone = e.filter("cast(critical_operation.line as int) > 1")
    m = {r["ref"].rpartition("/")[2]: r["matches"] for r in matching.match_candidates(f, lone).select("ref", F.size("matches").alias("matches")).collect()}
    at = [i + 1 for i in range(0, 20_000, 2) if (i + 1) % 10 == 1 and i]
    want = {f"r{i}": 0 for i in range(20_000)}
    for line in at:
        for i in range(max(0, line - 7), min(20_000, line + 6)):
            if i % 2 == 0 and abs(i + 1 - line) <= 5:
                want[f"r{i}"] += 1
    assert m == want


def test_spans_of_any_length_share_a_strip(spark):
    rng = random.Random(6)
    spans = [(lo, lo + rng.choice([0, 1, 15, 16, 17, 200, 5000, 2**30])) for lo in (rng.randint(1, 20_000) for _ in range(120))]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, lo int, hi int")
    highest = lines.levels_of((df, F.col("lo"), F.col("hi")))
    side = lambda s: df.select(F.col("i").alias(f"i{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"), F.explode(lines.strips(F.col("lo"), F.col("hi"), highest)).alias("at")).select("*", "at.*").drop("at")
    once = lines.meets_first(F.col("level"), F.col("strip"), *[F.col(f"{c}{s}") for s in "ab" for c in ("lo", "hi")])
    got = sorted((r["ia"], r["ib"]) for r in side("a").join(side("b"), ["level", "strip"]).filter(once & (F.col("loa") <= F.col("hib")) & (F.col("lob") <= F.col("hia"))).collect())
    assert got == [(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if a[0] <= b[1] and b[0] <= a[1]]
    assert side("a").groupBy("ia").count().agg(F.max("count")).first()[0] <= 2 * (highest + 1)


def test_clusters_of_groups_alone_are_those_of_canonical_findings(spark):
    """Summaries and counters made of groups equal those made of findings with ids, also without any finding."""
    rows = [finding("1", line=10), finding("1", line=10), finding("2", scanner="other", line=12), finding("3", scanner="third", line=11), finding("4", line=90), finding("5", id=None, line=95)]
    plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for some in (rows, []):
        f = frame(spark, some)
        whole = dedup.canonical(f)
        assert plain(dedup.cluster_summaries(f)) == plain(dedup.summaries(whole))
        assert plain(dedup.cluster_statistics(f)) == plain(dedup.statistics(whole))


def test_findings_that_surely_meet_no_other_are_told_apart(spark):
    """They are not grouped; what may share a cluster goes whole, also without lines and over the edge of strips."""
    rows = [
        finding("1", line=10), finding("1b", line=10), finding("2", line=500), finding("3", scanner="other", line=504), finding("4", line=900),
        finding("5", scanner="other", line=15, file="src/b.py"), finding("6", line=20, file="src/b.py"), finding("7", line=600, rule="a", cwe=[]), finding("8", scanner="other", line=600, rule="b", cwe=[], snippet="x"),
        finding("9", line=None), finding("9b", line=None),
    ]
    meeting, alone = (sorted(r[0].split("/")[-1] for r in df.select("provenance.raw_result_ref").collect()) for df in dedup.meeting_and_alone(frame(spark, rows)))
    assert alone == ["4", "7", "8"]
    assert meeting == ["1", "1b", "2", "3", "5", "6", "9", "9b"]
    got = dedup.cluster_summaries(frame(spark, rows))
    assert sorted(x["member_count"] for x in got.collect()) == [1, 1, 1, 2, 2, 2, 2]
    exact = sorted(r[0].split("/")[-1] for r in dedup.meeting_and_alone(frame(spark, rows), cross_tool=False)[0].select("provenance.raw_result_ref").collect())
    assert exact == ["1", "1b", "9", "9b"]
