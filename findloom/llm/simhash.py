"""SimHash near-duplicates: fingerprints, binary trie self-join, components.

``near_duplicates`` links by one fingerprint alone. ``keep_one_of_each`` goes the
same way with more fingerprints and a wider budget, and then holds every link
against the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import materialize
from .graph import connected_components

BITS, BLOCK = 64, 16
#: Fingerprints that a subtrie holds before its node pairs go to tasks of their own.
SUBTRIE_ROWS = 50_000
#: Rows of one subtrie from which some of them are tried as leaders first, and their number.
HUB_ROWS, LEADERS = 1_000, 32
#: Node pairs that a task expands at once, and the pairs below which it compares leaves.
FRONTIER, LEAF_PAIRS = 100_000, 24
#: Texts that a task holds as Python objects at once.
SLICE = 512
#: Fingerprints of a text for near copies, and the bits at which a trie of theirs links.
#: Sets at a similarity of 0.8 differ in a bit with a chance of 0.152, so they agree in a
#: block and are linked below it with one of 0.0705; none of 34 * 4 blocks does with 0.00005.
PRINTS, NEAR_BUDGET = 34, 12
#: One in so many rows is looked at to tell which subtries are to be divided.
ONE_IN = 16

_RANDOM = np.random.default_rng(20_240_229)
_TIMES = _RANDOM.integers(0, 1 << 63, PRINTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, PRINTS, dtype=np.uint64) * np.uint64(2)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text; a text without words gives zero."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    m = n - shingle + 1
    for lo in range(0, m, 65_536):
        hi = min(m, lo + 65_536)
        pairs = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[s:e], seed) for s, e in pairs), np.uint64, hi - lo)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """PRINTS SimHashes, a row for each set of hashes, none of them empty. Each takes the hashes mixed in a way of its own."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    # A byte counts 255 hashes at most, so sets are summed in pieces.
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    low, out = np.uint64(0x0101010101010101), np.empty((len(sets), PRINTS), np.uint64)
    for j in range(PRINTS):
        h = (flat ^ _FLIP[j]) * _TIMES[j]
        h ^= h >> np.uint64(32)
        sums = np.stack([np.add.reduceat((h >> np.uint64(k)) & low, starts) for k in range(8)], axis=1)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8, 8), first, axis=0, dtype=np.int64)
        bits = (2 * ones > sizes[:, None, None]).transpose(0, 2, 1).reshape(-1, BITS)
        out[:, j] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                fps = np.fromiter((fingerprint(t or b"") for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- the trie self-join inside one task -------------------------------------


def _spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the components of ``label`` along the links (a, b); roots are minima."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _pairs_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs below the node pairs ``f`` (rows a0, a1, b0, b1, d)."""
    na, nb = f[1] - f[0], f[3] - f[2]
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return f[0][which] + k // nb[which], f[2][which] + k % nb[which]


def _lead(x: np.ndarray, budget: int) -> np.ndarray:
    """Component roots of the values ``x`` after linking all of them to a few that are still apart."""
    label = np.arange(len(x))
    left = label.copy()
    for _ in range(LEADERS):
        if len(left) < 2:
            break
        leader = left[len(left) // 2]
        near = np.flatnonzero(np.bitwise_count(x ^ x[leader]) <= budget)
        _spanning(near, np.full(len(near), leader), label)
        left = left[label[left] != label[leader]]
    return label


def _descend(x: np.ndarray, start: int, f: np.ndarray, budget: int, label: np.ndarray, run: np.ndarray | None = None) -> None:
    """Traverse the node pairs ``f`` of the trie over the sorted values ``x`` from bit ``start``.

    ``run`` numbers the runs of rows of one component; pairs within one component are passed over.
    """
    ones_at: dict[int, np.ndarray] = {}
    stack = [(start, f)]
    while stack:
        t, f = stack.pop()
        if run is not None:
            whole = (run[f[0]] == run[f[1] - 1]) & (run[f[2]] == run[f[3] - 1])
            f = f[:, ~(whole & (label[f[0]] == label[f[2]]))]
        if not f.shape[1]:
            continue
        small = ((f[1] - f[0]) * (f[3] - f[2]) <= LEAF_PAIRS) | (t >= BITS)
        if small.any():
            i, j = _pairs_of(f[:, small])
            keep = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            _spanning(i[keep], j[keep], label)
            f = f[:, ~small]
            if not f.shape[1]:
                continue
        if t not in ones_at:
            ones_at[t] = np.concatenate(([0], np.cumsum((x >> np.uint64(BITS - 1 - t)) & np.uint64(1), dtype=np.int32)))
        ones = ones_at[t]
        a0, a1, b0, b1, d = f
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        kids = [
            (a0, am, b0, bm, d),
            (am, a1, bm, b1, d),
            (a0, am, bm, b1, d + 1),
            (am[~own], a1[~own], b0[~own], bm[~own], d[~own] + 1),
        ]
        f = np.concatenate([np.stack(k) for k in kids], axis=1)
        f = f[:, (f[0] < f[1]) & (f[2] < f[3]) & (f[4] <= budget)]
        f = f[:, ~((f[0] == f[2]) & (f[1] - f[0] < 2))]
        for lo in range(0, f.shape[1], FRONTIER):
            stack.append((t + 1, f[:, lo : lo + FRONTIER]))


def trie_links(group: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, budget: int) -> np.ndarray:
    """Component roots after joining each group of sorted values with itself.

    ``group`` numbers the groups in row order. A group whose ``lo`` and ``hi``
    differ pairs two trie nodes, which ``s`` more bits set apart.
    """
    n = len(x)
    label = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.concatenate((first[1:], [n]))
    hubs = np.flatnonzero(last - first > HUB_ROWS)
    for k in hubs:
        label[first[k] : last[k]] = first[k] + _lead(x[first[k] : last[k]], budget)
    run = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if len(hubs) else None
    for bits in np.unique(s[first]):
        own = s[first] == bits
        a, b = first[own], last[own]
        zero = np.zeros(len(a), np.int64)
        same = lo[a] == hi[a]
        f = np.stack((a, b, a, b, zero))[:, same]
        if bits:
            node = (x >> np.uint64(BITS - BLOCK - int(bits))) & np.uint64((1 << int(bits)) - 1)
            upper = np.concatenate(([0], np.cumsum(node == hi.astype(np.uint64)))).astype(np.int64)
            a, b = a[~same], b[~same]
            mid = b - (upper[b] - upper[a])
            d = np.bitwise_count(lo[a] ^ hi[a]).astype(np.int64)
            cross = np.stack((a, mid, mid, b, d))
            f = np.concatenate((f, cross[:, (a < mid) & (mid < b)]), axis=1)
        _descend(x, BLOCK + int(bits), f, budget, label, run)
    return label


def _join_partition(budget: int, cells: bool = False):
    """Rows (a, b), the links of a spanning forest; or rows (cell, rep), the members of its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, x, rep = cols
            lo, hi, s = (key >> 12) & 4095, key & 4095, (key >> 24) & 15
            root = trie_links(key, x.view(np.uint64), lo, hi, s, budget)
            moved = root != np.arange(len(root))
            if not moved.any():
                return
            if cells:
                tree = near_copies.mixed(key.view(np.uint64) * near_copies.STEP + rep[root].view(np.uint64)).view(np.int64)
                moved[root[moved]] = True
                yield pa.RecordBatch.from_arrays([pa.array(tree[moved]), pa.array(rep[moved])], ["cell", "rep"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["a", "b"])

        buffered: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            buffered.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            count += batch.num_rows
            if count < 4 * SUBTRIE_ROWS:
                continue
            cols = [np.concatenate(k) for k in zip(*buffered, strict=True)]
            cut = int(np.searchsorted(cols[0] == cols[0][-1], True))
            if cut:
                yield from solve([k[:cut] for k in cols])
            buffered, count = [[k[cut:] for k in cols]], len(cols[0]) - cut
        if count:
            yield from solve([np.concatenate(k) for k in zip(*buffered, strict=True)])

    return run


def _rotations(fp: Column) -> list[Column]:
    """A fingerprint with each of its blocks in front."""
    turned = lambda r: F.shiftleft(fp, BLOCK * r).bitwiseOR(F.shiftrightunsigned(fp, BITS - BLOCK * r))
    return [fp, *[turned(r) for r in range(1, BITS // BLOCK)]]


def _dealt(copies: DataFrame, budget: int, one_in: int = 1) -> DataFrame:
    """Rows (key, x, rep) of rows (r, x, rep), in order within partitions: all of a key are one task's unit of work.

    A unit is the subtrie below one block value of rotation r. A subtrie with
    over ``SUBTRIE_ROWS`` rows is divided into the pairs of its nodes ``s`` bits
    further down that are still within the budget, each a unit of its own.
    Which are so large is told from one in ``one_in`` of the rows; the links do
    not depend on it.
    """
    copies = copies.withColumn("block", F.shiftrightunsigned("x", BITS - BLOCK))
    seen = copies.filter(F.pmod(F.xxhash64("rep"), F.lit(one_in)) == 0) if one_in > 1 else copies
    rows = F.col("count") * one_in
    # At most 65,536 keys a rotation exist, and few are large, which bounds this broadcast.
    large = (
        seen.groupBy("r", "block")
        .count()
        .filter(rows > SUBTRIE_ROWS)
        .select("r", "block", F.least(F.lit(12), F.ceil(F.log2(rows / SUBTRIE_ROWS)) + 1).cast("int").alias("s"))
    )
    units = copies.join(F.broadcast(large), ["r", "block"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    others = F.expr(f"filter(sequence(0, (1 << s) - 1), e -> bit_count(e) <= {budget})")
    units = units.withColumn("p", F.expr("shiftrightunsigned(x, 48 - s) & ((1L << s) - 1)")).withColumn(
        "e", F.explode(F.when(F.col("s") == 0, F.array(F.lit(0))).otherwise(others))
    )
    key = F.expr("shiftleft(CAST(r AS BIGINT), 44) | shiftleft(block, 28) | shiftleft(CAST(s AS BIGINT), 24) | shiftleft(least(p, p ^ e), 12) | greatest(p, p ^ e)")
    # Rows of a key share their first bit, so signed order is that of the trie.
    return units.select(key.alias("key"), "x", "rep").repartition("key").sortWithinPartitions("key", "x")


def trie_edges(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (a, b) between the ``rep`` ids of fingerprints at ``budget`` or fewer bits.

    ``fps`` holds distinct (fp, rep). Two such fingerprints agree in one of the
    four 16-bit blocks, so each of four tries starts with another block and
    walks only equal nodes through it. A task emits a spanning forest of the
    links that it finds, never all pairs.
    """
    if budget >= BITS // BLOCK:
        raise ValueError("four blocks prove a match only for three or fewer bits")
    copies = fps.select("rep", F.posexplode(F.array(*_rotations(F.col("fp")))).alias("r", "x"))
    return _dealt(copies, budget).mapInArrow(_join_partition(budget), "a long, b long")


def trie_cells(prints: DataFrame, budget: int = NEAR_BUDGET) -> DataFrame:
    """Rows (cell, rep): the members of each component that a trie has, if they are two or more.

    ``prints`` holds (prints, rep), an array of fingerprints each. Every
    fingerprint has its four tries; two that agree in a block and differ in
    ``budget`` or fewer bits are linked by the trie that starts with it. A
    large subtrie may be divided, and then has its components by node pairs.
    """
    turned = F.flatten(F.transform("prints", lambda fp: F.array(*_rotations(fp))))
    copies = prints.select("rep", F.posexplode(turned).alias("r", "x"))
    return _dealt(copies, budget, ONE_IN).mapInArrow(_join_partition(budget, cells=True), "cell long, rep long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each input row.

    ``component_id`` is the smallest doc_id that links of ``budget`` or fewer
    differing bits reach. Null and empty texts share fingerprint zero, which
    links like any other. Repeated rows stay repeated. A null doc_id gets its
    fingerprint's component, or null where the fingerprint has no other row,
    and links nothing by itself. Columns beside the two named are not read.
    """
    fps = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    components = connected_components(trie_edges(distinct.filter("rep is not null"), budget))
    known = materialize(
        distinct.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        ),
        "components",
    )
    return fps.join(known, "fp", "left").select("doc_id", "fp", "component_id")


_SET_SCHEMA = "doc_id long, same long, node long, second long, n int, prints array<long>"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SET_SCHEMA`` of rows (doc_id, same, t): of each text two hashes of its shingle set, the set's size and fingerprints."""
    hashes = near_copies.Hashes()
    for b in batches:
        for lo in range(0, b.num_rows, near_copies.SLICE):
            part = b.slice(lo, near_copies.SLICE)
            sets = [near_copies.shingles(t or b"", hashes) for t in part.column(2).to_pylist()]
            nodes = [np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64) for seed in (0, 1)]
            sizes = np.array([len(s) for s in sets], np.int32)
            prints = fingerprints([s for s in sets if len(s)]) if sizes.any() else np.empty(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum(PRINTS * (sizes > 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(prints.reshape(-1).view(np.int64)))
            columns = [part.column(0), part.column(1), *[pa.array(c) for c in nodes], pa.array(sizes), lists]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SET_SCHEMA.split(", ")])


def _still_apart(at: DataFrame) -> DataFrame:
    """Rows (node, c), each once, of rows (cell, node, c): the members of each component ``c`` that shares a cell with another.

    A text is in up to 136 cells, and most of a family is one component soon,
    so cells are held against each other by components and not by members.
    """
    met = materialize(at.select("cell", "c").distinct(), "met")
    mixed = met.groupBy("cell").agg(F.count("*").alias("components")).filter("components > 1").select("cell")
    apart = met.join(mixed, "cell", "left_semi").select("c").distinct()
    members = materialize(at.select("node", "c").distinct(), "members")
    return members.join(apart, "c", "left_semi").select("node", "c")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, same, rows) of the document of smallest id of each component
    of near copies, with the number of rows that repeat it.

    Texts are lowered and split into words at white space; two are linked if
    their shingle sets are alike, or if both have no words. Rows with a null id
    are not looked at. ``same`` is that of ``near_copies.same_text``.

    Candidates are the sets whose fingerprints ``trie_cells`` links; only sets
    of ``near_copies.SMALL`` size, whose bits tell less, are candidates by themselves. Each
    is compared with the one of its cell that meets most others, as the text
    does that a family's others are made of; this joins a large group by few
    pairs; then those of a cell that are still apart are compared where they
    share one of their rarest shingles. The texts of candidates alone are
    shuffled, once for all comparisons.
    """
    named = docs.filter(F.col(id_col).isNotNull())
    same = near_copies.same_text(text_col).alias("same")
    read = named.select(F.col(id_col).cast("long").alias("doc_id"), same, F.col(text_col).cast("binary").alias("t"))
    rows = materialize(read.mapInArrow(_set_rows, _SET_SCHEMA), "prints")
    told = [F.first("n").alias("n"), F.first("prints").alias("prints"), F.min("second").alias("least"), F.max("second").alias("most")]
    nodes_of = lambda rows: materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "same")).alias("first"), *told), "nodes")
    nodes = nodes_of(rows)
    # Different sets of one 64-bit hash, about three of 10^10, are told apart by a second one.
    shared = [row[0] for row in nodes.filter("least <> most").select("node").collect()]
    if shared:
        rows = materialize(rows.withColumn("node", F.when(F.col("node").isin(shared), F.xxhash64("node", "second")).otherwise(F.col("node"))), "prints")
        nodes = nodes_of(rows)
    cells = materialize(trie_cells(nodes.select("prints", F.col("node").alias("rep"))).withColumnRenamed("rep", "node"), "cells")
    # The text of a family that the others are made of meets more than they do.
    counts = cells.groupBy("cell").agg(F.count("*").alias("members"))
    met = materialize(cells.join(counts, "cell").groupBy("node").agg(F.sum("members").alias("met")), "met")
    ranked = materialize(cells.join(met, "node"), "ranked")
    centers = ranked.groupBy("cell").agg(F.max(F.struct("met", "node")).alias("most")).select("cell", F.col("most.node").alias("center"))
    others = materialize(ranked.join(centers, "cell").filter("node != center").select("cell", "node", "center"), "around")
    small = nodes.filter(F.col("n").between(1, near_copies.SMALL)).select("node")
    needed = met.select("node").union(small).distinct().join(nodes.select("node", "first"), "node").select("first.doc_id", "first.same", "node")
    held = read.join(needed.hint("shuffle_hash"), ["doc_id", "same"]).select("node", "t")
    texts = materialize(held.mapInArrow(near_copies.once_rows, "node long, t binary"), "texts")
    known = nodes.select("node", near_copies.sketch_of("n", "prints").alias("of"))
    pairs = others.select("center", "node").distinct().join(known, "node")
    pairs = pairs.join(known.select(F.col("node").alias("center"), F.col("of").alias("of_center")), "center")
    pairs = pairs.filter(near_copies.may_be_alike("of_center", "of")).select(F.col("center").alias("a"), F.col("node").alias("b"))
    links = near_copies.alike(pairs, texts)
    found = connected_components(links)
    found = found.select("node", F.col("component").alias("c"))
    at = materialize(others.select("cell", "node").join(found, "node", "left").select("cell", "node", F.coalesce("c", "node").alias("c")), "apart")
    left = _still_apart(at).union(small.join(found, "node", "left").select("node", F.coalesce("c", "node")))
    left = materialize(left.distinct().join(known, "node"), "left")
    more = near_copies.alike(near_copies.sharing_rare(left, texts), texts)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more)).select("node", F.col("component").alias("c"))
    whole = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("c", "node").alias("c")).agg(F.min("first").alias("first"))
    repeated = rows.groupBy("doc_id", "same").agg(F.count("*").alias("rows"))
    return materialize(whole.select("first.doc_id", "first.same").join(repeated, ["doc_id", "same"]), "kept")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays.

    Near copies are those of ``near_copies``: five-word shingle sets at a
    similarity of 0.8 or more. One fingerprint at three or fewer bits would miss
    most of them, so ``first_of_each`` finds them by many. All columns are kept. Rows that repeat a kept doc_id and its text
    leave one row; rows with a null doc_id, which name no document, stay.
    """
    kept = first_of_each(docs, id_col, text_col).select(F.col("doc_id").alias("kept doc_id"), F.col("same").alias("kept same"), "rows")
    repeated = not kept.filter("rows > 1").isEmpty()
    named = docs.withColumn("row same", near_copies.same_text(text_col))
    on = (F.col(id_col).cast("long") == F.col("kept doc_id")) & (F.col("row same") == F.col("kept same"))
    left = named.join(kept.hint("shuffle_hash"), on, "left_semi")
    if repeated:
        left = left.dropDuplicates([id_col, "row same"])
    return left.drop("row same").unionByName(docs.filter(F.col(id_col).isNull()))
