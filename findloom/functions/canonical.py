"""Canonical JSON, stable hashes and the identifiers made of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType


@pandas_udf(StringType())
def canonical_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text with sorted keys, no blanks and plain UTF-8. Spark's own writer
    escapes control characters with other letters, so hashes would differ."""
    for texts in values:
        yield texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def to_json(value: Column) -> Column:
    """A struct, map or array as JSON, nulls included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


#: Control characters whose number has letters. Spark writes them in capitals, canonical JSON does not.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def _small_escapes(text: Column) -> Column:
    r"""JSON text with \u001f for \u001F; an escaped backslash before a u stays."""
    out = text
    for number in _LETTERED:
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u00" + number, "$1" + r"\\u00" + number.lower())
    return F.when(text.contains("\\u00"), out).otherwise(text)


def ordered_json(value: Column) -> Column:
    """Canonical JSON of a value whose fields and keys are in order and hold no
    floats: what ``canonical_json`` gives, without Python."""
    return _small_escapes(to_json(value))


#: What Spark and Python write alike. Numbers with fractions are not of them.
_ALIKE = (StringType, IntegralType, BooleanType, NullType, DateType, TimestampType, TimestampNTZType, BinaryType)


def is_native(kind: DataType) -> bool:
    """Whether Spark's functions alone can write values of this type canonically."""
    if isinstance(kind, StructType):
        names = [n.lower() for n in kind.names]
        return len(names) == len(set(names)) and all(is_native(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return is_native(kind.elementType)
    if isinstance(kind, MapType):
        return isinstance(kind.keyType, StringType) and is_native(kind.valueType)
    return isinstance(kind, _ALIKE)


def in_order(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order of their code points, at any depth."""
    if isinstance(kind, StructType) and kind.fields:
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[in_order(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        return F.transform(value, lambda x: in_order(x, kind.elementType))
    if isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: in_order(F.element_at(value, k), kind.valueType)))
    return value


def canonical(value: Column, kind: DataType) -> Column:
    """Canonical JSON of a struct, map or array of the given type.

    Written by Spark's functions, but for types with floats or decimals, with
    map keys other than strings, or with field names that differ in case alone:
    these go through ``canonical_json``. A null value has null text.
    """
    return ordered_json(in_order(value, kind)) if is_native(kind) else canonical_json(to_json(value))


def json_hash(value: Column, kind: DataType) -> Column:
    """SHA-256 of the canonical JSON of a struct, map or array of the given type."""
    return F.sha2(canonical(value, kind), 256)


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts with a zero byte between them; strings are literals."""
    return F.sha2(F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def digits_mod3(digest: Column) -> Column:
    """A hexadecimal number modulo 3. As 16 is 1 modulo 3, the digits' sum decides."""
    digits = F.transform(F.regexp_extract_all(digest, F.lit("[0-9a-f]"), 0), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return (F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 3).cast("int")


def finding_id(repo: Column, commit: Column, scanner: Column, rule: Column, location: Column, ruleset: Column) -> Column:
    """Identity of a finding: where it is and what found it, not what it says."""
    place = F.struct(*[location[k].alias(k) for k in ("end_col", "end_line", "file", "start_col", "start_line")])
    key = F.struct(
        commit.alias("commit"), place.alias("location"), repo.alias("repo_url"), rule.alias("rule_id"), ruleset.alias("ruleset_commit"), scanner.alias("scanner")
    )
    return F.concat(F.lit("finding-"), F.sha2(ordered_json(key), 256))


def case_key(finding: Column) -> Column:
    return F.left(F.sha2(finding, 256), F.lit(20))
