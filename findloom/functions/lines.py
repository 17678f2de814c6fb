"""Line spans: ``7``, ``"7"`` and ``"7-9"`` as columns, and distances between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = r"^\s*([0-9]+)(?:\s*-\s*([0-9]+))?\s*$"
_STRICT_LINE = r"^([1-9][0-9]*)(?:-([1-9][0-9]*))?$"


def _span(line: Column, pattern: str) -> Column:
    text = line.cast("string")
    start = F.regexp_extract(text, pattern, 1).try_cast("int")
    stop = F.regexp_extract(text, pattern, 2)
    end = F.when(stop == "", start).otherwise(stop.try_cast("int"))
    return F.when((start >= 1) & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def span(line: Column) -> Column:
    """struct(start, end) of a line given as a number or ``a-b``; null where it is neither."""
    return _span(line, _LINE)


def strict_span(line: Column) -> Column:
    """As ``span``, but without blanks or leading zeros."""
    return _span(line, _STRICT_LINE)


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Lines between the edges of two spans, 0 where they overlap; neighbours are 1 apart."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def line_text(start: Column, end: Column) -> Column:
    """A span as a line value."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def positive_int(value: Column) -> Column:
    """The value as an int of at least 1, else null; booleans have none."""
    n = F.when(value.cast("string").rlike(r"^\s*[0-9]+\s*$"), F.trim(value.cast("string"))).try_cast("int")
    return F.when(n >= 1, n)


#: Lines of a strip of level 0, and by how much a level's strips are wider than those of the one below.
STRIP, GROWTH = 16, 8


def strip_level(lo: Column, hi: Column) -> Column:
    """The level at which a span of lines touches two strips at most."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(GROWTH), (hi - lo + 1) / F.lit(float(STRIP))))).cast("int")


def levels_of(*spans: tuple[DataFrame, Column, Column]) -> int:
    """The highest level that one of the spans (rows, lo, hi) needs; a maximum, whatever the number of rows."""
    return max((rows.agg(F.max(strip_level(lo, hi))).first()[0] or 0 for rows, lo, hi in spans), default=0)


def strips(lo: Column, hi: Column, highest: int) -> Column:
    """Array of struct(level, strip): the strips that a span touches at its own
    level and those above, up to ``highest``. Spans that overlap share a strip
    at the greater of their levels, so a join on (level, strip) finds them
    without comparing a whole file, and a span of any length has few strips."""
    own = strip_level(lo, hi)

    def touched(level: int) -> Column:
        width = STRIP * GROWTH**level
        found = F.transform(F.sequence(F.floor(lo / width), F.floor(hi / width)), lambda s: F.struct(F.lit(level).alias("level"), s.alias("strip")))
        return F.when(own <= level, found).otherwise(F.array().cast("array<struct<level:int,strip:bigint>>"))

    return F.concat(*map(touched, range(highest + 1)))


def meets_first(level: Column, strip: Column, a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two spans that share a strip meet there first: at the greater of
    their levels, where the later one begins. True of one strip for each pair that overlaps."""
    width = F.lit(STRIP) * F.pow(F.lit(float(GROWTH)), level)
    return (level == F.greatest(strip_level(a_lo, a_hi), strip_level(b_lo, b_hi))) & (strip == F.floor(F.greatest(a_lo, b_lo) / width))
