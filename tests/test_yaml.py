"""YAML texts of rule files, held against stated values and, where it is installed, against PyYAML."""

import pytest

from findloom.functions.yaml_text import NotYaml, documents
from findloom.sources import code

READ = {
    "": [],
    "a: &x\n  k: 1\n  z: [1,\n   2]\nb: *x\nc:\n  <<: *x\n  k: 2\n": [{"a": {"k": 1, "z": [1, 2]}, "b": {"k": 1, "z": [1, 2]}, "c": {"k": 2, "z": [1, 2]}}],
    "--- \na: 1\n---\nb: 2\n...\n# only comment\n": [{"a": 1}, {"b": 2}],
    "a: |\n  x: y\n   # no\n\n  z\nb: >-\n  one\n  two\n\n  three\nc: d": [{"a": "x: y\n # no\n\nz\n", "b": "one two\nthree", "c": "d"}],
    'a: "x\\n\\u00e9 \\\n   y"\nb: \'two\n  lines\'\nc: plain\n  more': [{"a": "x\né y", "b": "two lines", "c": "plain more"}],
    "{a: 1, b: [x: y], \"c\":3}": [{"a": 1, "b": [{"x": "y"}], "c": 3}],
    "a: http://x/y#z\nb: x:y # c\nd: yes\ne: ~\nf: 1.50": [{"a": "http://x/y#z", "b": "x:y", "d": True, "e": None, "f": 1.5}],
    "- - a\n  - b\n-\n  c: d\n- e: f\n  g:\n  - 1\n  - 2\n": [[["a", "b"], {"c": "d"}, {"e": "f", "g": [1, 2]}]],
    "a: !!str x\nb: !t {c: d}": [{"a": "x", "b": {"c": "d"}}],
}
REFUSED = ["a: [1, 2", "a: b: c", "a:\n\tb: 1", "a: *no", "- a\n b: 1", "a: 'x' y", 'a: "\\q"', "a: - b", "a: {b: ]}", "a: 'open", "? x\n: y", "[" * 10_000]


@pytest.mark.parametrize("text", READ)
def test_read(text):
    assert documents(text) == READ[text]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(NotYaml):
        documents(text)


def test_as_the_library_reads_it():
    yaml = pytest.importorskip("yaml")
    texts = [t for t in READ if t and "!t" not in t]
    rng = __import__("random").Random(17)
    pieces = ["a: ", "b: ", "- ", "\n", "\n  ", "\n    ", "x", "'y'", '"z"', "[1, ", "]", "{k: v", "}", " # c", "|\n    t", "&n ", "*n", "---\n", ": ", ","]
    texts += ["".join(rng.choices(pieces, k=rng.randint(2, 9))) for _ in range(3000)]
    read = 0
    for t in texts:
        try:
            want = list(yaml.safe_load_all(t))
        except (yaml.YAMLError, TypeError, ValueError):
            continue
        try:
            got = documents(t)
        except NotYaml:
            continue
        read += 1
        assert [x for x in got if x is not None] == [x for x in want if x is not None], t
    assert read > 300


def test_long_texts_are_read_in_proportion():
    rules = "\n".join(f"- id: r{k}\n  metadata: {{category: [a, 'b',\n    c]}}" for k in range(20_000))
    assert len(documents("rules:\n" + rules)[0]["rules"]) == 20_000
    assert len(documents("a: [" + "\n x,".join(map(str, range(5_000))) + "]")[0]["a"]) == 5_000


def test_rules_of_odd_files(spark):
    rows = [("a.yml", None), ("b.yaml", ""), ("c.test.yaml", "rules: [{id: x}]"), ("d.txt", "rules: [{id: x}]"), ("e.YML", "rules: [{id: 7}, {id: 7}, 3]\n---\nrules: no\n---\n- x\n")]
    got = code.read_rules(spark.createDataFrame(rows, "file string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("e.YML", 0, 0, "7", None, None), ("e.YML", 0, 1, "7", None, None)]
    assert code.rule_categories(spark.createDataFrame(rows, "file string, text string").limit(0)).isEmpty()
