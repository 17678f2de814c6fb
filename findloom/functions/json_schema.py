"""JSON Schema as a column: what a JSON value violates, and where."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_zoned_time

_FOUND = "array<struct<path:string,keyword:string>>"
#: Keywords that state nothing about a value.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "title", "description", "default", "examples"}
#: Keywords that are read together with another.
_WITH = {"then", "else"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, and in one expression whatever the schema's size."""
    return F.transform(F.array(value), body)[0]


def _get(v: Column, key: str) -> Column:
    """A member, or null where there is none; a path takes no quotes in names, a map does."""
    if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key):
        return F.try_variant_get(v, f"$.{key}", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def _kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number; a whole number is an integer, however written."""
    told = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean")
        .when(told == "VOID", "null")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


class _Value:
    """A JSON value in several readings, each null where the value is of another type."""

    def __init__(self, v: Column, kind: Column):
        self.v, self.kind = v, kind
        self.text = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        self.number = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
        self.items = F.when(kind == "array", F.try_variant_get(v, "$", "array<variant>"))
        self.keys = F.when(kind == "object", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))

    def equals(self, constant) -> Column:
        if constant is None:
            return self.kind == "null"
        if isinstance(constant, bool):
            return F.coalesce((self.kind == "boolean") & (F.try_variant_get(self.v, "$", "boolean") == constant), F.lit(False))
        if isinstance(constant, (int, float)):
            return F.coalesce(self.number == float(constant), F.lit(False))
        if isinstance(constant, str):
            return F.coalesce(self.text == constant, F.lit(False))
        # Objects come out with their keys in order.
        return F.to_json(self.v) == json.dumps(constant, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TESTS: dict[str, Callable[[_Value, object], Column]] = {
    "const": lambda x, s: ~x.equals(s),
    "enum": lambda x, s: ~F.array_contains(F.array(*[x.equals(one) for one in s]), True),
    "minLength": lambda x, s: F.length(x.text) < s,
    "maxLength": lambda x, s: F.length(x.text) > s,
    "pattern": lambda x, s: ~x.text.rlike(s),
    "minimum": lambda x, s: x.number < s,
    "maximum": lambda x, s: x.number > s,
    "exclusiveMinimum": lambda x, s: x.number <= s,
    "exclusiveMaximum": lambda x, s: x.number >= s,
    "minItems": lambda x, s: F.size(x.items) < s,
    "maxItems": lambda x, s: F.size(x.items) > s,
    "uniqueItems": lambda x, s: F.size(F.array_distinct(F.transform(x.items, lambda item: F.to_json(item)))) < F.size(x.items) if s else F.lit(False),
    "minProperties": lambda x, s: F.size(x.keys) < s,
    "maxProperties": lambda x, s: F.size(x.keys) > s,
}
#: Formats that are checked; others say nothing.
_FORMATS: dict[str, Callable[[Column], Column]] = {"date-time": lambda text: text.isNotNull() & ~is_zoned_time(text)}


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    where = schema["$ref"]
    if where in seen:
        raise ValueError(f"{where} refers to itself, and a column has a fixed depth")
    if not where.startswith("#/"):
        raise ValueError(f"{where} is outside of the schema")
    found = root
    for part in where[2:].split("/"):
        found = found[part.replace("~1", "/").replace("~0", "~")]
    return found, (*seen, where)


def _violations(v: Column, path: Column, schema: dict | bool, root: dict, seen: tuple[str, ...]) -> Column:
    none = F.array().cast(_FOUND)
    if isinstance(schema, bool):
        return none if schema else F.array(F.struct(path.alias("path"), F.lit("false").alias("keyword")))

    def one(keyword: str, bad: Column, at: Column = path) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("path"), F.lit(keyword).alias("keyword")))).otherwise(none)

    def within(kind: Column) -> Column:
        x = _Value(v, kind)
        parts: list[Column] = []
        fits = lambda sub: F.size(_violations(v, path, sub, root, seen)) == 0
        count = lambda subs: F.aggregate(F.array(*map(fits, subs)), F.lit(0), lambda n, ok: n + ok.cast("int"))
        properties = schema.get("properties", {})
        for keyword, said in schema.items():
            if keyword in ANNOTATIONS or keyword in _WITH:
                continue
            if keyword == "$ref":
                sub, deeper = _resolved(schema, root, seen)
                parts.append(_violations(v, path, sub, root, deeper))
            elif keyword == "type":
                wanted = [said] if isinstance(said, str) else list(said)
                if "number" in wanted:
                    wanted.append("integer")
                parts.append(one("type", ~kind.isin(*wanted)))
            elif keyword in _TESTS:
                parts.append(one(keyword, _TESTS[keyword](x, said)))
            elif keyword == "format":
                if said in _FORMATS:
                    parts.append(one("format", _FORMATS[said](x.text)))
            elif keyword == "required":
                parts += [one("required", (kind == "object") & _get(v, name).isNull(), F.concat(path, F.lit(f".{name}"))) for name in said]
            elif keyword == "properties":
                for name, sub in said.items():
                    inner = _violations(_get(v, name), F.concat(path, F.lit(f".{name}")), sub, root, seen)
                    parts.append(F.when((kind == "object") & _get(v, name).isNotNull(), inner).otherwise(none))
            elif keyword == "additionalProperties":
                extra = F.array_except(F.coalesce(x.keys, F.array().cast("array<string>")), F.array(*map(F.lit, properties)).cast("array<string>"))
                if said is False:
                    parts.append(F.transform(extra, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit(keyword).alias("keyword"))))
                elif said is not True:
                    members = F.try_variant_get(v, "$", "map<string,variant>")
                    parts.append(F.flatten(F.transform(extra, lambda k: _violations(F.element_at(members, k), F.concat(path, F.lit("."), k), said, root, seen))))  # noqa: B023
            elif keyword == "items":
                at = lambda item, i: _violations(item, F.concat(path, F.lit("["), i, F.lit("]")), said, root, seen)  # noqa: B023, E731
                parts.append(F.coalesce(F.flatten(F.transform(x.items, at)), none))
            elif keyword == "allOf":
                parts += [_violations(v, path, sub, root, seen) for sub in said]
            elif keyword == "anyOf":
                parts.append(one(keyword, count(said) == 0))
            elif keyword == "oneOf":
                parts.append(one(keyword, count(said) != 1))
            elif keyword == "not":
                parts.append(one(keyword, fits(said)))
            elif keyword == "if":
                then, other = (_violations(v, path, schema.get(k, True), root, seen) for k in ("then", "else"))
                parts.append(F.when(fits(said), then).otherwise(other))
            else:
                raise ValueError(f"{keyword} is not known")
        return F.concat(*parts) if parts else none

    return _let(_kind(v), within)


def violations(text: Column, schema: dict) -> Column:
    """Array of struct(path, keyword): where a JSON text breaks a schema, in the schema's order.

    The schema is compiled when the plan is made, into one expression of Spark's
    own functions. A text that is no JSON, or null, breaks ``json`` at ``$``. A
    missing member breaks ``required`` at its own path, an additional one
    ``additionalProperties`` at its own. A keyword that is not known, a
    reference out of the schema or to itself raises ValueError.
    """
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("keyword"))).cast(_FOUND)
    found = _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), broken).otherwise(_violations(v, F.lit("$"), schema, schema, ())))
    return F.coalesce(found, broken)
