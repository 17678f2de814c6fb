"""Source trees as tables: lines of files, and rules in YAML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.yaml_text import NotYaml, documents


def lines_of(files: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows (keys, n, text): the lines of each text, from 1. A line break at the end starts no line."""
    lines = F.split(F.col(text_col), r"\r\n|\r|\n")
    ended = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines)
    return files.select(*keys, F.posexplode(ended).alias("_p", "text")).select(*keys, (F.col("_p") + 1).alias("n"), "text")


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Rows (file, text) of the text files below a folder; paths relative to it."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return rows.select(name.alias("file"), F.col("value").alias("text"))


def slices(wanted: DataFrame, lines: DataFrame, keys: list[str], numbered: bool = False) -> DataFrame:
    """``wanted`` (…, keys, start, end) with the text of those lines as ``slice``.

    A range asks for each of its lines by an equi-join, so nothing is compared
    beyond the lines that are read. A range without lines has a null slice.
    """
    place = [*keys, "start", "end"]
    each = wanted.select(*place).distinct().select(*place, F.explode(F.sequence("start", "end")).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(": "), F.col("text")) if numbered else F.col("text")
    read = each.join(lines, [*keys, "n"]).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("ls"))
    read = read.select(*place, F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("slice"))
    columns = [*wanted.columns, "slice"]
    return wanted.join(read, place, "left").select(*columns)


def search(lines: DataFrame, needle: str, case_sensitive: bool = True, limit: int = 40) -> DataFrame:
    """The first ``limit`` lines (by file and number) that hold ``needle``, and whether there are more.

    The limit is the feature: a reader asks for a page of hits.
    """
    text = F.col("text") if case_sensitive else T.fold(F.col("text"))
    hits = lines.filter(F.contains(text, F.lit(needle if case_sensitive else needle.casefold())))
    page = hits.orderBy("file", "n").limit(limit + 1)
    return page.withColumn("truncated", F.lit(page.count() > limit)).limit(limit)


def children(files: DataFrame, folder: str = "", limit: int = 100) -> DataFrame:
    """Names in a folder, files and folders, in the order of their lower-case forms."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    below = files.filter(F.col("file").startswith(prefix)).select(F.substring("file", len(prefix) + 1, 1 << 30).alias("p"))
    names = below.select(F.substring_index("p", "/", 1).alias("name"), F.contains("p", F.lit("/")).alias("is_folder")).distinct()
    return names.orderBy(F.lower("name"), "name").limit(limit)


def within_budget(slices_: DataFrame, budget: int, key: str = "finding_id", order: str = "position", text: str = "slice") -> DataFrame:
    """Slices of a case in order, while their characters together stay within the budget."""
    from pyspark.sql import Window as W

    used = F.sum(F.coalesce(F.length(text), F.lit(0))).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return slices_.withColumn("_used", used).filter(F.col("_used") <= budget).drop("_used")


def suffix_language(path: Column, extensions: dict[str, list[str]]) -> Column:
    """The language that a path's suffix belongs to, or null."""
    by = {e.lower().lstrip("."): language for language, es in extensions.items() for e in es}
    known = F.create_map(*[F.lit(x) for pair in by.items() for x in pair]) if by else F.create_map().cast("map<string,string>")
    return F.try_element_at(known, T.suffix(path))


def detect_languages(files: DataFrame, extensions: dict[str, list[str]], exclude: list[str] | None = None) -> DataFrame:
    """Rows (file, language) of safe, not excluded files in a known language."""
    path = F.translate("file", "\\", "/")
    return (
        files.select(path.alias("file"))
        .filter(T.is_safe_path(F.col("file")) & ~T.matches_globs(F.col("file"), exclude or []))
        .withColumn("language", suffix_language(F.col("file"), extensions))
        .filter("language is not null")
    )


_RULE = r"^\s*-\s*id\s*:\s*(.+?)\s*(?:\s#.*)?$"


def rule_ids(files: DataFrame) -> DataFrame:
    """Rows (file, line, rule_id): the ``- id:`` lines of YAML rule files, quotes removed; test files have none."""
    yaml = files.filter(F.lower("file").rlike(r"\.ya?ml$") & ~F.lower("file").rlike(r"\.test\.ya?ml$"))
    found = lines_of(yaml, ["file"]).withColumn("v", F.trim(F.regexp_extract("text", _RULE, 1)))
    bare = F.trim(F.regexp_replace("v", r"""^(['"])(.*)\1$""", "$2"))
    return found.select("file", F.col("n").alias("line"), bare.alias("rule_id")).filter("rule_id != ''")


RULE = "file string, document int, position int, rule_id string, category string, problem string"


def _rules_of(text: str) -> Iterator[tuple[int, int, str | None, str | None, str | None]]:
    """Rows (document, position, rule_id, category, problem) of one rule file."""
    try:
        read = documents(text)
    except NotYaml as e:
        yield 0, 0, None, None, f"NOT_YAML: {e}"
        return
    for d, document in enumerate(read):
        found = document.get("rules") if isinstance(document, dict) else None
        for k, rule in enumerate(found if isinstance(found, list) else []):
            if not isinstance(rule, dict):
                continue
            name = str(rule.get("id") or "").strip()
            metadata = rule.get("metadata")
            category = metadata.get("category") if isinstance(metadata, dict) else None
            yield d, k, name or None, str(category).strip() if category else None, None if name else "NO_RULE_ID"


def read_rules(files: DataFrame) -> DataFrame:
    """Rows (file, document, position, rule_id, category, problem): the rules of YAML
    rule files, in all of their documents, in block or flow style, anchors and merges followed.

    A rule without a category has null. A text that is no YAML is one row with a
    problem, a rule without an id another; what is no mapping is passed over.
    Test files, null and empty texts have no rows. Files are read one by one
    where Spark holds them, as no function of Spark's reads YAML.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *r) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in _rules_of(t)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], RULE.replace(" string", "").replace(" int", "").split(", "))

    yaml = files.filter(F.lower("file").rlike(r"\.ya?ml$") & ~F.lower("file").rlike(r"\.test\.ya?ml$") & F.col("text").isNotNull())
    return yaml.select("file", "text").mapInArrow(run, RULE)


def rule_categories(files: DataFrame) -> DataFrame:
    """Rows (file, rule_id, category): each rule that ``read_rules`` can read, one that stands twice as two rows."""
    return read_rules(files).filter("problem is null").select("file", "rule_id", "category")
