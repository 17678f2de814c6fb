"""Secret scans: fixed patterns, and strings that a Markov model of random ones explains better."""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter match of these two would lie in no longer one, so the bound may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST_VALUE = 8
_ANY = f"(?:{ASSIGN})|(?-i:{ACCESS})|(?-i:{HEX})"

#: Characters of the strings that the models judge, and the shortest string judged.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
LEAST_CHARS = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"
#: Shortest string that counts as a sample of an ordinary identifier.
LEAST_SAMPLE = 4
#: Rows of documents, about, that give samples; the draw is by hash of id and text.
SAMPLE_ROWS = 5_000
#: Log-likelihood ratio from which a string counts as random: ten thousand to one.
LEAST_RATIO = math.log(10_000)
#: Added to the count of each pair of characters.
SMOOTHING = 0.5
RANDOM, ORDINARY = "random", "ordinary"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_KINDS = ["assign", "access", "hex", RANDOM]
_START = "^"
#: Numbers that are summed one by one; see ``_running``.
_BLOCK = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def _running(numbers: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from a place to the sum of all numbers before it.

    Whole blocks are summed beforehand, so that a place adds up one block at
    most and a text with very many matches takes no quadratic time.
    """

    def upto(blocks: Column) -> Callable[[Column], Column]:
        def at(place: Column) -> Column:
            block = F.floor(place / _BLOCK).cast("int")
            return F.get(blocks, block) + _sum(F.slice(numbers, block * _BLOCK + 1, place - block * _BLOCK))

        return at

    n_blocks = F.ceil(F.size(numbers) / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: _sum(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(sums, lambda s: let(F.transform(s, lambda _, i: _sum(F.slice(s, F.lit(1), i))), lambda blocks: body(upto(blocks))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches of a text as structs (start, end,
    value, before): code points, end exclusive, the group's text, and the text
    between the match before and this one. A last struct, whose value is null,
    holds the rest of the text."""

    def placed(found: Column, values: Column, gaps: Column) -> Column:
        sizes = F.transform(gaps, lambda gap, i: F.length(gap) + F.coalesce(F.length(F.get(found, i)), F.lit(0)))

        def structs(numbers: Column, before: Callable[[Column], Column]) -> Column:
            return F.transform(
                gaps,
                lambda gap, i: let(
                    before(i),
                    lambda begin: F.struct(
                        (begin + F.length(gap)).alias("start"),
                        (begin + F.get(numbers, i)).alias("end"),
                        F.get(values, i).alias("value"),
                        gap.alias("before"),
                    ),
                ),
            )

        return let(sizes, lambda numbers: _running(numbers, lambda before: structs(numbers, before)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return let(found, lambda a: let(values, lambda b: let(F.split(text, pattern, -1), lambda gaps: placed(a, b, gaps))))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    kept = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _between(text: Column) -> Column:
    """The texts between all matches of the fixed patterns, as structs (at, gap)."""
    return F.transform(matches(text, _ANY), lambda m: F.struct((m["start"] - F.length(m["before"])).alias("at"), m["before"].alias("gap")))


def _characters(token: Column) -> Column:
    return F.split(token, r"(?<=[\s\S])(?=[\s\S])", -1)


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of random to ordinary, by the character before (last row: none) and the character."""

    ratios: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a string of the alphabet's characters."""
        # One literal for all numbers: it is folded once, before any row is read.
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        size = len(ALPHABET)
        codes = F.transform(_characters(token), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

        def total(c: Column) -> Column:
            steps = F.transform(c, lambda x, i: F.get(table, F.when(i == 0, F.lit(size)).otherwise(F.get(c, i - 1)) * size + x))
            return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

        return let(codes, total)


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label", smoothing: float = SMOOTHING) -> Markov:
    """The models of ``random`` and ``ordinary`` strings, as the ratios of their transitions.

    ``samples`` are strings of the alphabet with their label; null, empty and
    otherwise labelled ones teach nothing. Transitions are counted by Spark;
    only their counts, at most two for each pair of characters, reach the
    driver. Without samples of a label all its transitions are equally likely.
    """
    known = samples.filter(F.col(label_col).isin(RANDOM, ORDINARY) & (F.length(text_col) > 0))
    chars = known.select(F.col(label_col).alias("label"), F.concat(F.array(F.lit(_START)), _characters(F.col(text_col))).alias("chars"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("chars") - 2), lambda i: F.concat(F.get("chars", i), F.get("chars", i + 1)))
    counts = {(r[0], r[1]): r[2] for r in chars.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count().collect()}
    ratios = []
    for a in ALPHABET + _START:
        logs = []
        for label in (RANDOM, ORDINARY):
            row = [counts.get((label, a + b), 0) + smoothing for b in ALPHABET]
            logs.append([math.log(n / sum(row)) for n in row])
        ratios += [x - y for x, y in zip(*logs, strict=True)]
    return Markov(tuple(ratios))


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (text, label) from about ``rows`` documents, drawn by hash of id and text.

    Random: what the fixed patterns find, and for each document a digest
    written in one of four usual ways (hex in both cases, base64, base64 for
    urls). Ordinary: the strings of the alphabet between those finds, and the
    document's words put together as identifiers are: with underscores, hyphens,
    slashes or capitals. A null text gives a digest alone.
    """
    share = min(1.0, rows / max(1, docs.count()))
    drawn = F.xxhash64(F.col(id_col), F.col(text_col))
    digest = F.sha2(F.concat_ws(":", F.lit("sample"), F.col(id_col).cast("string"), F.col(text_col)), 256)
    some = docs.filter(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30))).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"), F.pmod(drawn, F.lit(4)).alias("way")
    )
    base64 = F.rtrim(F.base64(F.unhex("digest")), F.lit("="))
    # A digest has 64 digits; 40 of them are as long as the rest.
    written = (
        F.when(F.col("way") == 0, F.substring("digest", 1, 40))
        .when(F.col("way") == 1, F.upper(F.substring("digest", 1, 40)))
        .when(F.col("way") == 2, base64)
        .otherwise(F.translate(base64, "+/", "-_"))
    )
    found = F.concat(
        F.transform(F.filter(matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE), lambda m: F.replace(m["value"], F.lit("."))),
        F.regexp_extract_all(F.col("text"), F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(F.col("text"), F.lit(HEX), F.lit(0)),
    )
    random = some.select(F.explode(F.array_append(found, written)).alias("text"), F.lit(RANDOM).alias("label"))
    plain = F.flatten(F.transform(F.split("text", _ANY, -1), lambda gap: F.regexp_extract_all(gap, F.lit(CANDIDATE % LEAST_SAMPLE), F.lit(0))))
    words = F.transform(F.filter("plain", lambda w: ~w.rlike("[^A-Za-z]")), F.lower)
    capitals = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, F.length(w))))
    joined = F.when(F.col("way") == 0, F.array_join(words, "_")).when(F.col("way") == 1, F.array_join(words, "-"))
    joined = joined.when(F.col("way") == 2, F.array_join(words, "/")).otherwise(F.array_join(capitals, ""))
    ordinary = some.select("way", plain.alias("plain")).select(F.explode(F.array_append("plain", joined)).alias("text"))
    return random.unionByName(ordinary.select("text", F.lit(ORDINARY).alias("label")))


def scan(docs: DataFrame, model: Markov, least_ratio: float = LEAST_RATIO, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, spans), one for each input row; both columns are
    arrays of structs (start, kind, end) in order, ``kind`` counting assign,
    access, hex, random.

    Base spans are the matches of the fixed patterns; an assignment's value has
    8 characters at least. Random spans are strings of 20 characters or more of
    the alphabet that stand outside of all matches of those patterns and whose
    log-likelihood ratio is high enough. Null and empty texts have no spans;
    repeated rows have equal ones; other columns are left out. A text is
    searched whole, without a shuffle, by Spark's own expressions; only texts
    that hold what is looked for are taken apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(_spans(text, ASSIGN, 0, 2, LEAST_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    candidate = CANDIDATE % least_chars

    def judged(part: Column) -> Column:
        kept = F.filter(matches(part["gap"], candidate), lambda m: m["value"].isNotNull() & (model.score(m["value"]) >= least_ratio))
        return F.transform(kept, lambda m: F.struct((part["at"] + m["start"]).alias("start"), F.lit(3).alias("kind"), (part["at"] + m["end"]).alias("end")))

    more = F.flatten(F.transform(F.filter(_between(text), lambda part: part["gap"].rlike(candidate)), judged))
    more = F.when(text.rlike(candidate), more).otherwise(F.array().cast(_SPAN))
    found = rows.select("doc_id", F.array_sort(base).alias("base"), more.alias("more"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def _told(spans: str) -> Column:
    kinds = F.array(*map(F.lit, _KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, model: Markov, **options) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans): see ``scan``."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(_KINDS)]
    rows = scan(docs, model, **options)
    return rows.select("doc_id", *counts[:3], F.sha2(_told("base"), 256).alias("base_sha256"), counts[3], _told("spans").alias("spans"))
