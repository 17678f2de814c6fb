"""What near copies are: five-word shingle sets whose Jaccard similarity is 0.8 or more, told by the sets themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Ratio of the sizes of sets in one class.
SIZE_STEP = 1.05
#: Words of a shingle. Two sets are alike if ALIKE[0] * |union| <= ALIKE[1] * |intersection|.
SHINGLE, ALIKE = 5, (4, 5)
#: Fingerprints whose bits are compared before the sets are. Of their 256 bits a pair
#: at 0.8 differs in 39 at the mean with a deviation of 6, one without common shingles in 128.
SKETCH, SKETCH_BUDGET = 4, 76
#: Sets of as many shingles or fewer, whose bits tell less, are compared wherever they share a rare one.
SMALL = 8
#: Texts that a task holds as Python objects at once, words whose hashes it
#: remembers, and texts that are compared with one other in a task.
SLICE, WORDS, COMPARED = 64, 100_000, 256

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. A text of fewer words is one shingle; one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    hashes = Hashes() if hashes is None else hashes
    w = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
    m = len(w) - SHINGLE + 1
    h = w[:m].copy()
    for k in range(1, SHINGLE):
        h = h * STEP + w[k : m + k]
    return np.unique(mixed(h))


def same_text(text_col: str) -> Column:
    """Tells rows of one id with other texts apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def sketch_of(n: str, prints: str) -> Column:
    """What ``may_be_alike`` reads of a set: its size and first fingerprints."""
    return F.struct(F.col(n).alias("n"), *[F.get(prints, F.lit(k)).alias(f"s{k}") for k in range(SKETCH)])


def may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and fingerprints leave it open that two sets are alike."""
    sizes = ALIKE[0] * F.greatest(f"{a}.n", f"{b}.n") <= ALIKE[1] * F.least(f"{a}.n", f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in (f"s{k}" for k in range(SKETCH))), F.lit(0))
    return sizes & ((apart <= SKETCH_BUDGET) | (F.greatest(f"{a}.n", f"{b}.n") <= SMALL))


def _compared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, t) in order of a and part, the text of ``a`` itself first, with a null ``b``: the pairs that are alike."""
    hashes, own, whose = Hashes(), np.empty(0, np.uint64), None
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            found: list[tuple[int, int]] = []
            for a, part, b, t in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE).columns), strict=True):
                other = shingles(t, hashes)
                if b is None:
                    own, whose = other, (a, part)
                elif whose == (a, part):
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if ALIKE[0] * (len(own) + len(other) - common) <= ALIKE[1] * common:
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike, by the sets themselves.

    A text that is compared with many is sent to as many tasks as their number
    asks for; a task holds its set and one other at a time.
    """
    pairs = materialize(pairs, "pairs")
    counts = materialize(pairs.groupBy("a").agg(F.count("*").alias("others")), "counts")
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("others") / COMPARED)).alias("part"))
    dealt = materialize(dealt, "dealt")
    others = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "t")
    own = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "t")
    rows = others.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return materialize(rows.mapInArrow(_compared_rows, "a long, b long"), "alike")


def once_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, t) without those that repeat a node of this task."""
    seen: set[int] = set()
    for b in batches:
        fresh = []
        for node in b.column(0).to_pylist():
            fresh.append(node not in seen)
            seen.add(node)
        yield b.filter(pa.array(fresh, pa.bool_()))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, gram) of rows (node, t): the shingles of each text and their number."""
    hashes = Hashes()
    for b in batches:
        for lo in range(0, b.num_rows, SLICE):
            part = b.slice(lo, SLICE)
            sets = [shingles(t, hashes) for t in part.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
            grams = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(grams)], ["node", "n", "gram"])


def _overlap(a: Column, b: Column) -> Column:
    """The least number of common shingles of two alike sets of these sizes."""
    return F.ceil((a + b) * ALIKE[0] / (ALIKE[0] + ALIKE[1]))


def sharing_rare(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (node, of, c) that may be alike, of different ``c``.

    Of two alike sets, ordered from their rarest shingle on, so many must agree
    that the first few of both share one: all but the least overlap, and one
    more. The sets are joined on these alone. Members of a family that differ
    by words of their own begin with these words' shingles, which nothing
    shares, so a family whose members are not alike gives no pairs. The less a
    partner's size, the more shingles count; sizes are told by classes.
    """
    size_class = lambda n: F.floor(F.log(n) / np.log(SIZE_STEP)).cast("int")
    grams = materialize(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_gram_rows, "node long, n int, gram long"), "grams")
    shared = grams.groupBy("gram").agg(F.count("*").alias("sets")).filter("sets > 1")
    ordered = grams.join(shared, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("g"))
    lists = materialize(ordered.select("node", "n", F.transform("g", lambda x: x["gram"]).alias("g")).join(nodes, "node"), "lists")
    n = F.col("n")
    # The shingles of one set alone come before all others.
    begin = lambda overlap: F.greatest(F.lit(0), n - overlap + 1 - (n - F.size("g"))).cast("int")
    short = lists.select("node", "n", "of", "c", size_class(n).alias("k"), F.explode(F.slice("g", F.lit(1), begin(_overlap(n, n)))).alias("gram"))
    least = F.ceil(n * ALIKE[0] / ALIKE[1])
    partner = lists.withColumn("k", F.explode(F.sequence(size_class(least), size_class(n))))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("k"))))
    long = partner.select("node", "n", "of", "c", "k", F.explode(F.slice("g", F.lit(1), begin(_overlap(smallest, n)))).alias("gram"))
    x, y = [side.select("k", "gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "of", "c")]) for side, s in ((short, "x"), (long, "y"))]
    ordered = F.struct("n_x", "node_x") < F.struct("n_y", "node_y")
    pairs = x.join(y, ["k", "gram"]).filter(ordered & (F.col("c_x") != F.col("c_y")) & may_be_alike("of_x", "of_y"))
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
