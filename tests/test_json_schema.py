"""The schema compiler, keyword by keyword."""

import pytest
from pyspark.sql import functions as F

from findloom.functions import json_schema

CASES = [
    ({"type": "integer"}, {"1": [], "1.0": [], "1.5": ["$:type"], "true": ["$:type"], "null": ["$:type"], "1e400": ["$:type"]}),
    ({"type": ["number", "null"]}, {"1": [], "2.5": [], "null": [], '"1"': ["$:type"]}),
    ({"const": None}, {"null": [], "0": ["$:const"], "{}": ["$:const"]}),
    ({"const": {"b": [1], "a": "é"}}, {'{"a":"é","b":[1]}': [], '{"b":[1],"a":"e"}': ["$:const"]}),
    ({"enum": [1, "1", True, None]}, {"1": [], "1.0": [], '"1"': [], "true": [], "null": [], "false": ["$:enum"], "[1]": ["$:enum"]}),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, {'"ab"': [], '"a"': ["$:minLength"], '"aééé"': ["$:maxLength"], '"ba"': ["$:pattern"], "5": []}),
    ({"minimum": 1, "maximum": 9}, {"1": [], "9": [], "0.5": ["$:minimum"], "10": ["$:maximum"], '"0"': []}),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, {"1": ["$:exclusiveMinimum"], "2": [], "3": ["$:exclusiveMaximum"]}),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, {"[]": ["$:minItems"], "[1,2,3]": ["$:maxItems"], "[1,1]": ["$:uniqueItems"], '[{"a":1,"b":2},{"b":2,"a":1}]': ["$:uniqueItems"], '"x"': []}),
    ({"required": ["a", "b'c"]}, {'{"a":null,"b\'c":1}': [], "{}": ["$.a:required", "$.b'c:required"], "[]": []}),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "null"}}, {'{"a":"x","z":null}': [], '{"a":1,"z":2,"y":[]}': ["$.a:type", "$.y:type", "$.z:type"]}),
    ({"additionalProperties": False}, {"{}": [], '{"x y":1}': ["$.x y:additionalProperties"], "[1]": []}),
    ({"items": {"properties": {"n": {"minimum": 2}}}}, {'[{"n":2},{"n":1},3]': ["$[1].n:minimum"], "{}": []}),
    ({"allOf": [{"minimum": 2}, {"maximum": 1}]}, {"1.5": ["$:minimum", "$:maximum"]}),
    ({"anyOf": [{"type": "null"}, {"minimum": 2, "type": "number"}]}, {"null": [], "3": [], "1": ["$:anyOf"]}),
    ({"oneOf": [{"minimum": 2}, {"maximum": 4}]}, {"1": [], "3": ["$:oneOf"], "5": []}),
    ({"not": {"type": "string"}}, {"1": [], '"x"': ["$:not"]}),
    ({"if": {"minimum": 5}, "then": {"maximum": 6}, "else": {"const": 1}}, {"6": [], "7": ["$:maximum"], "1": [], "2": ["$:const"]}),
    ({"if": {"type": "null"}, "then": False}, {"1": [], "null": ["$:false"]}),
    ({"$ref": "#/$defs/x~1y", "$defs": {"x/y": {"type": "array", "items": {"$ref": "#/$defs/z"}}, "z": {"const": 1}}}, {"[1]": [], "[1,2]": ["$[1]:const"], "1": ["$:type"]}),
    ({"format": "date-time"}, {'"2024-02-29T10:00:00Z"': [], '"2023-02-29T10:00:00Z"': ["$:format"], '"now"': ["$:format"], "1": []}),
    ({"minProperties": 1, "maxProperties": 1}, {"{}": ["$:minProperties"], '{"a":1}': [], '{"a":1,"b":1}': ["$:maxProperties"]}),
    ({"type": "object", "title": "x", "default": {}}, {"{": ["$:json"], "": ["$:json"], None: ["$:json"], "{}": []}),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_keyword(spark, number):
    schema, cases = CASES[number]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, text string").repartition(1)
    got = {r.text: sorted(f"{x.path}:{x.keyword}" for x in r.found) for r in rows.select("text", json_schema.violations(F.col("text"), schema).alias("found")).collect()}
    assert got == {text: sorted(found) for text, found in cases.items()}


def test_schemas_that_cannot_be_compiled():
    for schema in ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "http://x/y"}, {"typo": 1}):
        with pytest.raises(ValueError):
            json_schema.violations(F.lit("1"), schema)
