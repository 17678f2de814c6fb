"""Substring dedup: seed and extend over winnowed anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_key
from .rolling import Words, buffers

#: Words of a repeat, and words of a seed.
REPEAT, SEED = 35, 8


def _argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` consecutive keys, the position of the (leftmost) least."""
    shift = np.uint64(max(20, int(len(keys)).bit_length()))
    packed = ((keys >> shift) << shift) | np.arange(len(keys), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    rest = width - step
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)


def anchors(w: Words, repeat: int = REPEAT, seed: int = SEED):
    """The winnowed anchors of a buffer: of each the first window that selects it,
    the number of consecutive windows that do, the seed's hash and the hash of
    all words that those windows reach (its context).

    Equal windows select equal seeds at equal places, as the choice depends on
    the window's words alone.
    """
    n = len(w.hash)
    m = n - repeat + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    seeds = w.windows(np.arange(n - seed + 1), seed)
    chosen = _argmin(seeds, repeat - seed + 1)
    inside = w.doc[:m] == w.doc[repeat - 1 :]
    turn = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1]) | (w.doc[1:m] != w.doc[: m - 1])))
    first = np.flatnonzero(turn)
    count = np.diff(np.concatenate((first, [m])))
    keep = inside[first]
    first, count = first[keep], count[keep]
    at = chosen[first]
    reach = w.windows(first, count + repeat - 1)
    context = reach + (at - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return first, count, seeds[at], context


def _anchor_rows(repeat: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in buffers(texts):
                w = Words(texts[lo:hi])
                first, count, anchor, context = anchors(w, repeat, seed)
                doc = w.doc[first] if len(first) else first
                cols = [keys[lo:hi][doc], first - w.begin[doc], count, anchor.view(np.int64), context.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(t)) for c, t in zip(cols, ("i8", "i4", "i4", "i8", "i8"), strict=True)],
                    ["row_key", "first", "count", "anchor", "context"],
                )

    return run


def _window_rows(repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            runs = batch.column(2)
            offsets = runs.offsets.to_numpy()
            flat = runs.values
            first, count, anchor, lone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for lo, hi in buffers(texts):
                w = Words(texts[lo:hi])
                part = slice(offsets[lo], offsets[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                size = count[part].astype(np.int64)
                which = np.repeat(np.arange(len(size)), size)
                step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                start = first[part].astype(np.int64)[which] + step
                h = w.windows(start + w.begin[doc[which]], repeat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[part][which]),
                        pa.array(h.view(np.int64)),
                        pa.array(keys[lo:hi][doc[which]]),
                        pa.array(start.astype(np.int32)),
                        pa.array(lone[part][which]),
                    ],
                    ["anchor", "window", "row_key", "start", "lone"],
                )

    return run


def maximal(start: np.ndarray, stop: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of repeats grown together: a repeat goes on as long as the next window of ``repeat`` words is repeated too."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    begins = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1] - repeat + 1)))
    return start[begins], reach[np.append(begins[1:], len(start)) - 1]


def _maximal_rows(repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1)
            offsets, flat = spans.offsets.to_numpy(), spans.values
            first, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            grown = [maximal(first[a:b], stop[a:b], repeat) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = np.cumsum([0, *(len(g[0]) for g in grown)]).astype(np.int32)
            columns = [np.concatenate([g[k] for g in grown]) if grown else np.empty(0, np.int32) for k in range(2)]
            values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["row_key", "spans"])

    return run


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT, seed: int = SEED, row_key: Column | None = None
) -> DataFrame:
    """Rows (row_key, spans): the word ranges that maximal repeats cover in a text.

    A repeat is a sequence of ``repeat`` or more words all of whose windows
    start at another place too, in the same document or another one; it is
    maximal, as the windows before and after it start nowhere else. ``spans``
    is an array of (start, stop), stop excluded; texts without a repeat give no
    row. Documents are told apart by ``row_key``, by default ``own_key``.

    1. Every window of ``repeat`` words selects the winnowed seed it holds; an
       anchor is a seed with the run of windows that select it.
    2. Documents are joined on anchors through a count of each anchor, never
       pair by pair. An anchor with one place has no repeat. If all places of
       an anchor also agree in its context, extension both ways succeeds for
       all of its windows, and they are repeats at once. So are those of a
       context that occurs twice.
    3. Where contexts differ, the match ends inside: each place is extended by
       every number of words to the left, and what is left of a window to the
       right, and extensions are compared by their hash beside the anchor's, 64
       bits each; equal ones are one window.
    4. Neighbouring windows that are repeated grow together into maximal repeats.
    """
    # Rows with equal id and text get one key, as they get one result.
    row_key = own_key(docs, id_col, text_col) if row_key is None else row_key
    keyed = docs.select(row_key.alias("row_key"), F.col(text_col).cast("binary").alias("t"))
    rows = materialize(
        keyed.mapInArrow(_anchor_rows(repeat, seed), "row_key long, first int, count int, anchor long, context long"), "anchors"
    )
    shared = materialize(
        rows.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most"))
        .filter("n > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("mixed")),
        "shared",
    )
    places = materialize(rows.join(shared, "anchor"), "places")
    mixed = places.filter("mixed")
    contexts = materialize(
        mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "first", "count")).alias("place")), "contexts"
    )
    # One place of each context is looked at more closely; it decides for itself
    # only where it is its context's one place.
    closer = contexts.select("place.row_key", F.struct("place.first", "place.count", "anchor", (F.col("n") == 1).alias("lone")).alias("run"))
    closer = closer.groupBy("row_key").agg(F.collect_list("run").alias("runs"))
    windows = materialize(
        keyed.join(closer.hint("shuffle_hash"), "row_key").mapInArrow(
            _window_rows(repeat), "anchor long, window long, row_key long, start int, lone boolean"
        ),
        "windows",
    )
    twice = materialize(
        windows.groupBy("anchor", "window")
        .agg(F.min(F.struct("row_key", "start")).alias("a"), F.max(F.struct("row_key", "start")).alias("b"))
        .filter("a != b")
        .select("anchor", "window"),
        "twice",
    )
    # Every place learns how often its context occurs: one row in, one row out.
    counted = places.join(contexts.select("anchor", "context", "n"), ["anchor", "context"], "left")
    repeats = (
        counted.filter("not mixed or n > 1")
        .select("row_key", "first", "count")
        .unionByName(
            windows.filter("lone")
            .join(twice, ["anchor", "window"], "left_semi")
            .select("row_key", F.col("start").alias("first"), F.lit(1).alias("count"))
        )
    )
    spans = repeats.groupBy("row_key").agg(
        F.collect_set(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("count") + (repeat - 1)).alias("stop"))).alias("spans")
    )
    return spans.mapInArrow(_maximal_rows(repeat), "row_key long, spans array<struct<start:int,stop:int>>")


def cut(text: bytes | None, starts, stops) -> tuple[int, int, bytes]:
    """Number of words, number of words inside the ranges, and the others joined by one space."""
    words = (text or b"").split()
    n = len(words)
    if not len(starts):
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    inside = np.cumsum(edge[:n]) > 0
    kept = [words[i] for i in np.flatnonzero(~inside).tolist()]
    return n, n - len(kept), b" ".join(kept)


def _cut_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            present = spans.is_valid().to_numpy(zero_copy_only=False)
            offsets, flat = spans.offsets.to_numpy(), spans.values
            first, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = []
            for i, t in enumerate(batch.column("t").to_pylist()):
                part = slice(offsets[i], offsets[i + 1]) if present[i] else slice(0, 0)
                n, removed, kept = cut(t, first[part], stop[part])
                if not with_text:
                    out.append((n, removed, hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((n, removed, kept.decode() if present[i] else None if t is None else t.decode()))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            cols = [batch.column(k) for k in batch.schema.names if k not in ("t", "spans")]
            names = [k for k in batch.schema.names if k not in ("t", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*names, "n_words", "n_removed", "kept"],
            )

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, repeat: int, seed: int) -> DataFrame:
    """Rows (own, t, spans): the other columns of a document as a struct, its
    text, and its spans or null. No name of ``docs`` can clash."""
    row_key = own_key(docs, id_col, text_col)
    spans = materialize(repeated_spans(docs, id_col, text_col, repeat, seed, row_key), "spans")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(own.alias("own"), F.col(text_col).alias("t"), row_key.alias("row_key"))
    return rows.join(spans.hint("shuffle_hash"), "row_key", "left")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each input row.

    Null and empty texts have no words. Rows that repeat a document remove each
    other's words wherever they hold ``repeat`` or more.
    """
    rows = _joined(docs.select(id_col, text_col), id_col, text_col, repeat, seed)
    rows = rows.select(F.col("own")[id_col].cast("long").alias("doc_id"), F.col("t").cast("binary").alias("t"), "spans")
    return rows.mapInArrow(_cut_rows(False), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT, seed: int = SEED) -> DataFrame:
    """The documents with repeated words removed from ``text_col``.

    Texts that lose nothing stay as they are; others become their kept words,
    joined by one space. All rows and columns stay.
    """
    rows = _joined(docs, id_col, text_col, repeat, seed)
    own = rows.schema["own"].dataType.simpleString()
    cut_ = rows.select("own", F.col("t").cast("binary").alias("t"), "spans").mapInArrow(
        _cut_rows(True), f"own {own}, n_words long, n_removed long, kept string"
    )
    return cut_.select(*[F.col("kept").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
