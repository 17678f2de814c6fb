"""A trie of conversations: turns, their order, and the nodes of shared prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Names that one window of ``_dense`` counts, and ids that one piece of an ``ends`` list holds.
NAMES_A_BUCKET, IDS_A_PIECE = 50_000, 4_096
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a turn, in which null is empty; equal for equal turns alone, as far as any digest tells."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, d, key, size, upto): each turn's place from 1 on, its key,
    its text's UTF-8 bytes and those of all turns up to it.

    Turns are in order of ``turn``, null first; equal numbers are put in order
    of their keys, and repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation. Turns are dealt by ranges of
    (conv_id, turn, key) and counted range by range, so that a conversation of
    any length is spread over many tasks.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), size.alias("size")
    )
    dealt = turns.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")).withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.select("conv_id", "part", "key", "size", F.count("*").over(within).alias("d"), F.sum("size").over(within).alias("upto"))
    counted = materialize(counted, "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("conv_id", "part").agg(F.max("d").alias("n"), F.max("upto").alias("bytes"))
    starts = totals.select("conv_id", "part", F.sum("n").over(before).alias("n"), F.sum("bytes").over(before).alias("bytes")).filter("n > 0")
    # Of each range only its first conversation can have begun before it: a row a range at most, so it is broadcast.
    starts = F.broadcast(materialize(starts, "starts"))
    return counted.join(starts, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("d") + F.coalesce("n", F.lit(0))).alias("d"), "key", "size", (F.col("upto") + F.coalesce("bytes", F.lit(0))).alias("upto")
    )


def spliced(turns: DataFrame, heads: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: rows as of ``ordered_turns``, and all conv_ids.

    Conversation c gets the first h turns of conversation c - c % ``heads``
    (all if it has fewer, none if there is none), then its own turns after its
    first h; h is the unsigned crc32 of its decimal id, modulo ``most``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % heads
    cut = F.max(F.when(F.col("d") <= h, F.col("upto")))
    convs = turns.groupBy("conv_id").agg(F.coalesce(cut, F.lit(0)).alias("own")).select("conv_id", base.alias("base"), h.alias("h"), "own")
    convs = materialize(convs, "convs")
    first = turns.filter((base == F.col("conv_id")) & (F.col("d") < most)).withColumnRenamed("conv_id", "base")
    lent = convs.filter("base != conv_id").join(first, "base").filter("d <= h").select("conv_id", "d", "key", "size", "upto")
    lent = materialize(lent, "lent")
    got = lent.groupBy("conv_id").agg(F.count("*").alias("m"), F.max("upto").alias("bytes"))
    shift = convs.filter("base != conv_id").join(got, "conv_id", "left")
    moved_d = F.col("d") - F.col("h") + F.coalesce("m", F.lit(0))
    moved = F.col("upto") - F.col("own") + F.coalesce("bytes", F.lit(0))
    shift = materialize(shift, "shift")
    tails = turns.filter((base != F.col("conv_id")) & (F.col("d") > h)).join(shift, "conv_id")
    own = turns.filter(base == F.col("conv_id"))
    rows = own.unionByName(lent).unionByName(tails.select("conv_id", moved_d.alias("d"), "key", "size", moved.alias("upto")))
    return rows, convs.select("conv_id")


def _dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (\\*keys, name) for all keys that occur more than once, names being
    the numbers from 0 on. What occurs once is shared by nothing and needs no name."""
    known = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "keys")
    buckets = 1 + known.count() // NAMES_A_BUCKET
    dealt = known.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    # One row a bucket: a small table.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    numbered = dealt.withColumn("rank", rank).join(starts, "bucket")
    return numbered.select(*keys, (F.col("start") + F.col("rank") - 1).alias("name"))


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """For each power of two the named blocks of so many turns, as rows (conv_id, i, name): block i begins
    after i blocks of its size. Those of one turn have its ``size`` and ``upto`` too."""
    level = materialize(rows.join(_dense(rows, ["key"]), "key").select("conv_id", (F.col("d") - 1).alias("i"), "name", "size", "upto"), "blocks")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        half = F.col("i") % 2
        pairs = level.groupBy("conv_id", F.expr("i div 2").alias("i")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b")
        )
        pairs = materialize(pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()), "pairs")
        level = materialize(pairs.join(_dense(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", "i", "name"), "blocks")
    return levels


def _prefixes(levels: list[DataFrame]) -> DataFrame:
    """Rows (conv_id, d, name) of all prefixes that may be shared: equal d and name, equal turns.

    A prefix of d turns is the blocks of d's binary digits, largest first. Its
    name is made of the name without the last block, and that block: one join
    round for each block size, from the largest on.
    """
    done = None
    for k in reversed(range(len(levels))):
        block, width = levels[k], 1 << k
        firsts = block.filter("i = 0").select("conv_id", F.lit(width).cast("long").alias("d"), "name")
        if done is not None:
            later = block.filter("i > 0 AND i % 2 = 0").select("conv_id", (F.col("i") * width).alias("d"), F.col("name").alias("b"))
            pairs = materialize(later.join(done.withColumnRenamed("name", "a"), ["conv_id", "d"]), "pairs")
            named = pairs.join(_dense(pairs, ["d", "a", "b"]), ["d", "a", "b"])
            firsts = firsts.unionByName(named.select("conv_id", (F.col("d") + width).alias("d"), "name"))
        firsts = materialize(firsts, "prefixes")
        done = firsts if done is None else done.unionByName(firsts)
    return done


def _digests(ends: DataFrame) -> DataFrame:
    """Rows (conv_id, d, ends_sha256) of rows (conv_id, d, member).

    Ids are dealt by ranges and joined to pieces; a node's pieces then pass
    through one digest in order, as SHA-256 asks for, one at a time.
    """
    dealt = ends.repartitionByRange("conv_id", "d", "member").withColumn("part", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("conv_id", "d", "part").orderBy("member"))
    pieces = dealt.withColumn("piece", F.floor((rank - 1) / IDS_A_PIECE)).groupBy("conv_id", "d", "part", "piece")
    pieces = pieces.agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            out = []
            for conv, d, ids in zip(batch.conv_id, batch.d, batch.ids):
                if (conv, d) == node:
                    running.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (conv, d), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "d", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=["conv_id", "d", "ends_sha256"])

    ordered = pieces.repartition("conv_id", "d").sortWithinPartitions("conv_id", "d", "part", "piece")
    return ordered.select("conv_id", "d", "ids").mapInPandas(digest, "conv_id long, d long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations: see the contract of ``op11_prefix_trie``.

    ``turns`` has rows (conv_id, d, key, size, upto) as of ``ordered_turns``,
    ``convs`` all conv_ids, also those without turns. A node is told by its
    smallest member and its depth. No conversations, no rows.

    Blocks of 1, 2, 4, ... turns get names by joins, as long as any occurs
    twice; a prefix's name is composed from those of its blocks. A prefix that
    only one conversation begins with never gets that far. Of the shared ones,
    a conversation owns those whose smallest member it is, which are the
    deepest; so the depth to which it shares turns with a smaller one, and that
    one's id, give parents, children, leaves and bytes saved as sums over members.
    """
    spark = turns.sparkSession
    turns = materialize(turns.select("conv_id", "d", "key", "size", "upto"), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("n"))
    convs = materialize(convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "convs")
    least, longest = convs.agg(F.min("conv_id"), F.max("n")).first()
    if least is None:
        return spark.createDataFrame([], _NODES)
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), "n", F.lit(least).alias("owner"), F.lit(longest).alias("deepest"), *(F.lit(0).cast("long").alias(c) for c in ("size", "upto")))
    shared = root
    levels = _blocks(turns)
    if levels:
        # The last turn of a prefix that is named is named as well.
        sizes = levels[0].select("conv_id", (F.col("i") + 1).alias("d"), "size", "upto")
        found = materialize(_prefixes(levels).join(sizes, ["conv_id", "d"]).join(convs, "conv_id"), "found")
        nodes = found.groupBy("d", "name").agg(F.min("conv_id").alias("owner"), F.count("*").alias("members"), F.max("n").alias("deepest"))
        nodes = materialize(nodes.filter("members > 1").drop("members"), "nodes")
        shared = shared.unionByName(found.join(nodes, ["d", "name"]).select(*root.columns))
    shared = materialize(shared, "shared")

    lent = F.col("owner") != F.col("conv_id")
    at_end = F.col("d") == F.col("n")
    facts = shared.groupBy("conv_id").agg(
        F.max("n").alias("n"),
        F.max("d").alias("t"),
        F.coalesce(F.max(F.when(lent, F.col("d"))), F.lit(-1)).alias("o"),
        F.max_by("owner", F.when(lent, F.col("d"))).alias("above"),
        F.coalesce(F.max(F.when(lent, F.col("upto"))), F.lit(0)).alias("lent_bytes"),
        F.coalesce(F.bool_or(at_end & ((F.col("deepest") > F.col("n")) | lent)), F.lit(False)).alias("within"),
    )
    # ``within``: its last turn is another's node, or others go on from there.
    facts = materialize(facts.withColumn("leaf", (~F.col("within")).cast("long")).drop("within"), "facts")

    def parent(d: Column) -> Column:
        return F.when(d == 0, None).when(d - 1 > F.col("o"), F.col("conv_id")).otherwise(F.col("above"))

    d = F.col("d")
    of_members = shared.select("conv_id", "d", "owner", "size", "upto").join(facts, "conv_id")
    child = ((F.col("o") <= d) & (F.col("n") > d)).cast("long")
    saved = F.greatest(F.lit(0), F.col("lent_bytes") - F.col("upto") + F.col("size"))
    saved = F.when(d <= F.col("o"), saved).otherwise(0)
    sums = of_members.groupBy(F.col("owner").alias("conv_id"), "d").agg(
        F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )
    ends = _digests(shared.filter(at_end).select(F.col("owner").alias("conv_id"), "d", F.col("conv_id").alias("member")))
    nobody = F.sha2(F.lit(""), 256)
    columns = ["conv_id", d.alias("depth"), parent(d).alias("parent_conv_id")]
    several = sums.join(ends, ["conv_id", "d"], "left").join(facts.select("conv_id", "o", "above"), "conv_id")
    several = several.select(*columns, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
    alone = turns.select("conv_id", "d").join(facts.select("conv_id", "n", "t", "o", "above"), "conv_id").filter("d > t")
    last = d == F.col("n")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    digest = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nobody)
    alone = alone.select(*columns, one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), digest.alias("ends_sha256"))
    return several.unionByName(alone)
