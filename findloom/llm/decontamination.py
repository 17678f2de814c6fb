"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_key

WINDOW = 10
#: The characters that separate words, after A-Z became a-z; in original text A-Z belong to words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Seeds up to which the set goes with the plan, and windows up to which it is broadcast.
LITERAL_SEEDS, BROADCAST_WINDOWS = 50_000, 500_000


def words_of(text: Column) -> Column:
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATOR), ""), F.array())


def _held(df: DataFrame, name: str, value: Column, *columns: str) -> DataFrame:
    """``value`` as a column that later expressions read instead of computing it
    again: a generator is a border over which Spark merges no projections."""
    return df.select(*columns, F.explode(F.array(value)).alias(name))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (window, size, items): each distinct window with the items it occurs in.

    An item with fewer words than ``window`` is one window; without words, none.
    """
    words = _held(items.select(F.col(id_col).alias("item_id"), text_col), "words", words_of(F.col(text_col)), "item_id")
    sized = words.filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))
    return (
        sized.select("item_id", "size", "words", starts.alias("s"))
        .select("item_id", "size", F.array_join(F.slice("words", F.col("s"), F.col("size")), " ").alias("window"))
        .groupBy("window", "size")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _seed_size(size: int) -> tuple[int, int]:
    """Words of a seed and the step between the places where seeds are looked
    for: any window of ``size`` words then holds a seed at such a place."""
    seed = (size + 1) // 2
    return seed, size - seed + 1


def _seeds(windows: DataFrame, size: int) -> DataFrame:
    """Every seed that a window of ``size`` words may show at a looked-for place."""
    seed, step = _seed_size(size)
    words = windows.filter(F.col("size") == size).select(F.split("window", " ").alias("w"))
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(step)), lambda s: F.xxhash64(F.slice(F.col("w"), s, seed)))).alias("seed")).distinct()


def _all_seeds(windows: DataFrame, sizes: list[int]) -> tuple[DataFrame, dict[int, list[int]]]:
    """Rows (size, seed), and by size the seeds themselves where they are few enough to go with the plan."""
    each = [_seeds(windows, size).select(F.lit(size).alias("size"), "seed") for size in sizes]
    if not each:
        return windows.select("size", F.lit(0).cast("long").alias("seed")), {}
    seeds = materialize(reduce(DataFrame.unionByName, each), "seeds")
    counts = {r["size"]: r["count"] for r in seeds.groupBy("size").count().collect()}
    known: dict[int, list[int]] = {size: [] for size in sizes if counts.get(size, 0) <= LITERAL_SEEDS}
    for r in seeds.filter(F.col("size").isin(list(known))).collect():
        known[r["size"]].append(r["seed"])
    return seeds, known


def _places(size: int) -> Column:
    """The looked-for places of ``words``, counted from 0."""
    seed, step = _seed_size(size)
    return F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - seed, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _in_set(known: list[int], seed: int):
    return lambda p: F.xxhash64(F.slice(F.col("words"), p + 1, seed)).isin(known)


def _around(found: Column, size: int) -> Column:
    """The windows of ``words`` that hold a seed at one of the places ``found``."""
    seed, _ = _seed_size(size)
    starts = F.array_distinct(
        F.flatten(F.transform(found, lambda p: F.sequence(F.greatest(p - (size - seed), F.lit(0)), F.least(p, F.size("words") - size))))
    )
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(F.col("words"), s + 1, size), " ").alias("window")))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, items_text: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_words, places, items), one for each document row.

    ``places`` are the numbers of words inside an occurrence of a window,
    ``items`` the ids of the items with such windows; both may be empty. Null
    texts have no words. Rows that repeat a document each get their own row.

    A hash set of the items' seeds (half windows) goes to every task. Each
    document is tested at every sixth place only, since a window of ten words
    holds a seed of five at one of six neighbouring places; what the seeds hit
    is verified word by word against the windows. A set too large for that is
    joined by shuffle instead.
    """
    windows = materialize(item_windows(items, text_col=items_text, window=window), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    seeds, known = _all_seeds(windows, sizes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(known) < len(sizes):
        rows = materialize(rows, "rows")  # the rows are joined with what is found in them, so their numbers must stay
    words = _held(rows, "words", words_of(F.col("text")), "row", "doc_id")
    near = [F.array().cast("array<struct<start:int,size:int,window:string>>")]
    for size in sizes:
        seed, _ = _seed_size(size)
        if size in known:
            words = _held(words, f"found_{size}", F.filter(_places(size), _in_set(known[size], seed)), *words.columns)
        else:
            each = words.select("row", F.col("words"), F.explode(_places(size)).alias("p"))
            each = each.select("row", "p", F.xxhash64(F.slice(F.col("words"), F.col("p") + 1, seed)).alias("seed"))
            found = each.join(seeds.filter(F.col("size") == size), "seed", "left_semi").groupBy("row").agg(F.collect_list("p").alias(f"found_{size}"))
            words = words.join(found, "row", "left").withColumn(f"found_{size}", F.coalesce(f"found_{size}", F.array().cast("array<int>")))
        near.append(_around(F.col(f"found_{size}"), size))
    small = windows.count() <= BROADCAST_WINDOWS
    table = F.broadcast(windows) if small else windows
    exploded = _held(words, "near", F.concat(*near), "row", "doc_id", "words").select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer("near").alias("x")
    )
    matched = exploded.select("row", "doc_id", "n_words", "x.start", "x.size", "x.window").join(table.select("window", "size", "items"), ["window", "size"], "left")
    spans = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "size")))
    return (
        matched.groupBy("row", "doc_id", "n_words")
        .agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select(
            "row",
            "doc_id",
            "n_words",
            F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))).alias("places"),
            "items",
        )
    )


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits(docs, items, id_col, text_col, window).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
    )


def _boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (own, t, row_key): the other columns as a struct, so that none of their names can clash."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(own.alias("own"), F.col(text_col).alias("t"), own_key(docs, id_col, text_col).alias("row_key"))


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without the words that were hit, each with the separator before it.

    Other words and separators stay as they are, and so do all other columns
    and rows. Documents without a hit are not touched.
    """
    rows = _boxed(docs, id_col, text_col)
    found = (
        hits(rows, items, "row_key", "t", window)
        .filter(F.size("places") > 0)
        .select(F.col("doc_id").alias("row_key"), "places")
        .dropDuplicates(["row_key"])
    )
    joined = rows.join(found.hint("shuffle_hash"), "row_key", "left")
    hit = lambda value: F.when(F.col("places").isNotNull(), value)
    parts = _held(joined, "w", hit(F.array_remove(F.split("t", SEPARATOR_CASED), "")), "own", "t", "places")
    parts = _held(parts, "g", hit(F.split("t", WORD_CASED)), "own", "t", "w", "places")
    kept = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), F.col("places"))
    clean = F.concat(
        F.array_join(F.transform(kept, lambda i: F.concat(F.get(F.col("g"), i), F.get(F.col("w"), i))), ""), F.element_at("g", -1)
    )
    text = F.when(F.col("places").isNull(), F.col("t")).otherwise(clean)
    return parts.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    rows = _boxed(docs, id_col, text_col)
    found = hits(rows, items, "row_key", "t", window).filter(F.size("places") > 0).select(F.col("doc_id").alias("row_key"))
    left = rows.join(found, "row_key", "left_anti")
    return left.select(*[F.col("t").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
