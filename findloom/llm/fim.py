"""Fill-in-the-middle: texts cut at the boundaries of a unit grammar and put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Unit grammars: pairs of character classes; a boundary falls wherever the
#: character before it is in the first and the one after it in the second.
GRAMMARS = {
    "character": [(r"[\s\S]", r"[\s\S]")],
    "word": [(r"\s", r"\S")],
    "line": [(r"\n", r"[\s\S]")],
    "sentence": [(r"[.!?]\s", r"\S")],
    "token": [(r"\p{L}", r"\P{L}"), (r"\P{L}", r"\p{L}"), (r"\s", r"\S"), (r"\S", r"\s")],
}
#: What announces prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are put in another order, and of those the percent whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundary(unit: str) -> str:
    """The zero-width expression that matches between two units, and nowhere at a text's ends."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[unit])


def pieces(text: Column, unit: str) -> Column:
    """The units of a text in order; joined they are the text. An empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def _any_of(marks: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{mark}\E" for mark in marks)


def _check(marks: tuple[str, ...]) -> None:
    """No mark may begin as one ends or hold one: only then is each found where it was put, whatever stands beside it."""
    for a in marks:
        for b in marks:
            if not a or "\\E" in a or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (a is not b and a in b):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for each other")


def transform(
    docs: DataFrame,
    unit: str = "character",
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    seed: str = "1",
    sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, text, n, form, prefix, middle, output), one for each input row.

    The numbers drawn for a row are the first four 8-digit groups of the
    SHA-256 of ``seed:id`` in hex: two for the cuts, which fall after 0 to n
    units, one for whether the text is changed, one for the order. A text that
    is empty or holds a mark stays plain, as does a null one, which counts as
    empty; of plain texts, prefix and middle are null. A null id is drawn for
    as the empty id; rows that repeat an id and text have equal results. Other
    columns are left out, so none can clash. Nothing is shuffled, and all is
    evaluated by Spark's own expressions; a row's units are held while it is
    cut, about 100 bytes a unit.
    """
    _check(sentinels)
    p, s, m = sentinels
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), drawn.alias("drawn"))
    rows = rows.withColumn("units", pieces(F.col("text"), unit)).withColumn("n", F.size("units"))
    h = [F.conv(F.substring("drawn", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    ends = [h[k] % (F.col("n") + 1) for k in range(2)]
    plain = (F.col("n") == 0) | F.col("text").rlike(_any_of(sentinels)) | (h[2] % 100 >= rate)
    form = F.when(plain, PLAIN).when(h[3] % 100 < suffix_first, SPM).otherwise(PSM)
    rows = rows.select("*", F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"), form.alias("form"))

    def part(begin: Column, end: Column) -> Column:
        return F.when(F.col("form") != PLAIN, F.array_join(F.slice("units", begin + 1, end - begin), ""))

    a, b, n = F.col("a"), F.col("b"), F.col("n")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b).alias("middle"), part(b, n).alias("suffix"))
    output = (
        F.when(F.col("form") == PSM, F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
        .when(F.col("form") == SPM, F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "text", F.col("n").cast("long").alias("n"), "form", "prefix", "middle", output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` made an output of."""
    def put(parts: Column, *order: int) -> Column:
        return F.concat(*(F.get(parts, F.lit(k)) for k in order))

    def in_order(parts: Column) -> Column:
        return F.when(form == PSM, put(parts, 1, 3, 2)).when(form == SPM, put(parts, 2, 3, 1)).otherwise(output)

    return let(F.split(output, _any_of(sentinels), -1), in_order)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): see ``transform``."""
    rows = transform(docs, id_col=id_col, text_col=text_col, **options)
    back = restore(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )
