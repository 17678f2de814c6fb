"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket

#: The bound of the training sample: letters and spaces of a language, its texts, and
#: letters and spaces of all languages, which share them evenly, down to the last number for each.
TRAIN_SYMBOLS, TRAIN_TEXTS, ALL_SYMBOLS, LEAST_SYMBOLS = 30_000, 60, 6_000_000, 300
#: Symbols of a text that are parsed beside each other; the parsing goes on over their borders.
LANE = 512
UNKNOWN = "und"
SPACE, FIRST = 1, 2
#: Bits of a letter that a language's text does not show: those of a code point.
LITERAL = 20.0
#: Cells of all dense transition tables; automata that do not fit have their transitions as sorted pairs.
DENSE_CELLS = 48_000_000

_IS_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _IS_LETTER


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(text: str) -> np.ndarray:
    """The code points of the text in lower case; each run of other characters than letters is one space."""
    p = points(text)
    letter = _letters()[p]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return np.where(letter, p, 32)[keep]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """By state the transitions of the suffix automaton of ``s``; the root is state 0, to which none leads."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return follow


class Transitions:
    """The transitions of an automaton as arrays; 0 stands for none. Symbol 0 has none."""

    def __init__(self, follow: list[dict[int, int]], width: int, dense: bool):
        self.width = width
        self.keys = np.array([state * width + c for state, edges in enumerate(follow) for c in sorted(edges)], np.int64)
        self.to = np.array([edges[c] for edges in follow for c in sorted(edges)], np.int32)
        self.table = None
        if dense:
            self.table = np.zeros(len(follow) * width, np.uint16 if len(follow) < 1 << 16 else np.int32)
            self.table[self.keys] = self.to
            self.keys = self.to = np.zeros(0, np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state * self.width + c
        if self.table is not None:
            return self.table[key].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0).astype(np.int64)

    def count(self, s: np.ndarray) -> int:
        """The phrases of one text, symbol by symbol."""
        if self.table is not None:
            to_of = self.table.item
        else:
            known = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
            to_of = lambda key: known.get(key, 0)
        phrases, state = 0, 0
        for c in s.tolist():
            to = to_of(state * self.width + c)
            if not to:
                phrases += state != 0
                to = to_of(c)
                phrases += to == 0
            state = to
        return phrases + (state != 0)


def _by_text(told: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of each text's symbols are told."""
    return np.add.reduceat(np.append(told, False).astype(np.int64), offsets) * (size > 0) if len(size) else np.zeros(0, np.int64)


@dataclass
class Model:
    """By language an automaton and the symbols of its letters; ``cost`` is the bits of a phrase that points into its text.

    ``letters`` numbers the letters of all samples by code point, ``symbol``
    has a language's symbol of each; a letter that the language lacks is 0, and
    costs ``LITERAL`` bits beside its phrase.
    """

    languages: list[str]
    letters: np.ndarray
    symbol: list[np.ndarray]
    automata: list[Transitions]
    cost: list[float]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text and language the phrases of the greedy cross parsing and the
        symbols that the language lacks, and by text its symbols.

        A phrase is the longest piece of the language's text that goes on from
        the last one's end; a symbol that the language lacks is one by itself.
        Long texts are parsed as lanes, all of which take a step at once. Each
        lane is parsed as if a phrase began with it; then the phrase that really
        goes on over its border is followed until a phrase begins where one
        began before, from where on the two are the same. Where they do not
        meet within a lane, the text is parsed once more, symbol by symbol.
        """
        parsed = [self.letters[joined(t)] for t in texts]
        size = np.fromiter(map(len, parsed), np.int64, len(parsed))
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        length = np.minimum(LANE, size[owner] - part * LANE)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        start = (np.cumsum(size) - size)[owner] + part * LANE
        before = place[np.flatnonzero(part > 0) - 1]  # of each lane that is no text's first, the lane before it
        later = place[part > 0]
        by_length = np.argsort(-length[order][later], kind="stable")
        before, later = before[by_length], later[by_length]
        owner, length, start = owner[order], length[order], start[order]
        flat = np.concatenate(parsed) if parsed else np.zeros(0, np.int64)
        active = np.searchsorted(-length, -np.arange(1, LANE + 1), side="right")
        offsets = np.cumsum(size) - size
        final = start + length == (offsets + size)[owner]  # lanes that end with their text
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        lacking = np.zeros_like(counts)
        for j, automaton in enumerate(self.automata):
            s = self.symbol[j][flat]
            begins = np.zeros(len(flat) + 1, bool)  # where a phrase begins, as far as its lane knows
            begins[start] = True
            state = np.zeros(len(owner), np.int64)
            for k, n in enumerate(active.tolist()):
                if not n:
                    break
                at = start[:n] + k
                c = s[at]
                to = automaton.step(state[:n], c)
                miss = np.flatnonzero(to == 0)
                if len(miss):
                    begins[at[miss]] = True
                    again = automaton.step(np.zeros(len(miss), np.int64), c[miss])
                    begins[at[miss[again == 0]] + 1] = True
                    to[miss] = again
                state[:n] = to
            begins[offsets[1:]] = True  # a text's end marks its neighbour's first symbol, which begins a phrase anyway
            total = _by_text(begins[:-1], offsets, size)
            lacking[:, j] = _by_text(s == 0, offsets, size)
            apart = self._mend(automaton, s, begins, state[before], start[later], length[later], owner[later], final[later], total)
            for i in apart:
                total[i] = automaton.count(s[offsets[i] : offsets[i] + size[i]])
            counts[:, j] = total
        return counts, lacking, size

    @staticmethod
    def _mend(automaton: Transitions, s: np.ndarray, begins: np.ndarray, state: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, final: np.ndarray, total: np.ndarray) -> list[int]:
        """Follow the phrases that go over the lanes' borders, and put ``total`` right.

        Returns the texts with a lane, but for their last, in which the two
        parsings do not meet.
        """
        on = np.flatnonzero(state != 0)
        state = state[on]
        change = np.zeros(len(owner), np.int64)
        apart: set[int] = set()
        for k in range(LANE):
            over = length[on] <= k
            if over.any():
                apart.update(owner[on[over & ~final[on]]].tolist())
                on, state = on[~over], state[~over]
            if not len(on):
                break
            at = start[on] + k
            c = s[at]
            told = begins[at]
            to = automaton.step(state, c)
            fresh = (to == 0) | (state == 0)
            met = fresh & told
            change[on] += fresh.astype(np.int64) - told
            to[to == 0] = automaton.step(np.zeros(int((to == 0).sum()), np.int64), c[to == 0])
            on, state = on[~met], to[~met]
        apart.update(owner[on[~final[on]]].tolist())
        np.add.at(total, owner, change)
        return sorted(apart)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: one less the winner's bits over the runner-up's."""
        letters = _letters()
        known = [t if t and letters[points(t)].any() else "" for t in texts]
        counts, lacking, size = self.phrases(known)
        bits = counts * np.array(self.cost) + lacking * LITERAL
        names, scores = [], np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), scores
        best = bits.argmin(axis=1)
        two = np.partition(bits, 1, axis=1)[:, :2] if len(self.languages) > 1 else None
        for i, t in enumerate(known):
            names.append(self.languages[best[i]] if t else UNKNOWN)
        if two is not None:
            scores = np.where(size > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
        else:
            scores = np.where(size > 0, 1.0, 0.0)
        return names, np.where([bool(t) for t in known], scores, 0.0)


def build(samples: dict[str, list[str]], limit: int = TRAIN_SYMBOLS) -> Model:
    """A model of texts by language, ``limit`` symbols of each at most. Every letter of a sample has a symbol of its own."""
    languages = sorted(samples)
    train = []
    for name in languages:
        parts, n = [], 0
        for t in samples[name]:
            p = joined(t)[: limit - n]
            parts.append(p)
            n += len(p) + 1
            if n >= limit:
                break
        train.append(parts)
    seen = np.unique(np.concatenate([np.array([32], np.int64), *(p for parts in train for p in parts)]))
    letters = np.zeros(0x110000, np.int32 if len(seen) >= 1 << 16 else np.uint16)
    letters[seen] = np.arange(1, len(seen) + 1)
    symbol, automata, cost = [], [], []
    for parts in train:
        own = np.unique(np.concatenate([letters[np.array([32])], *(letters[p] for p in parts)]))
        table = np.zeros(len(seen) + 1, np.int64)
        table[own] = np.arange(SPACE, len(own) + SPACE)
        table[letters[32]] = SPACE
        table[own[own != letters[32]]] = np.arange(FIRST, len(own) + 1)
        s: list[int] = []
        for p in parts:
            s += [*table[letters[p]].tolist(), len(own) + 1]  # no text has the symbol between two texts
        follow = suffix_automaton(s)
        width = len(own) + 2
        automata.append(Transitions(follow, width, len(follow) * width * len(languages) <= DENSE_CELLS))
        symbol.append(table)
        cost.append(float(np.log2(max(2, len(s)))))
    return Model(languages, letters, symbol, automata, cost)


def symbols_each(languages: int, limit: int = TRAIN_SYMBOLS, total: int = ALL_SYMBOLS) -> int:
    """Symbols that each of so many languages is learnt from."""
    return max(min(limit, total // max(1, languages)), LEAST_SYMBOLS)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int, texts: int = TRAIN_TEXTS, limit: int = TRAIN_SYMBOLS, total: int = ALL_SYMBOLS) -> dict[str, list[str]]:
    """By language its different (id, text) of lowest hash: ``texts`` of them at
    most, and no more than have ``symbols_each`` letters and spaces.

    Every value of ``lang_col`` is learnt, however rare: more languages share
    ``total`` symbols. A language's count sets a threshold for its hashes that
    about twice as many texts pass, which are then ranked; so no language is
    sorted or gathered in one task, and what reaches the driver is bounded.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_bucket(F.col(id_col), folds) != held_out)).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("t")
    )
    counts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    limit = symbols_each(len(counts), limit, total)
    counted = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long")
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(F.broadcast(counted), "lang").filter(share < 2 * texts / F.col("n")).select("lang", "h", F.substring("t", 1, limit).alias("t"))
    order = W.partitionBy("lang").orderBy("h")
    symbols = F.length(F.regexp_replace("t", r"\P{L}+", " "))
    ranked = drawn.groupBy("lang", "h").agg(F.min("t").alias("t")).select(
        "*", F.row_number().over(order).alias("rank"), F.sum(symbols).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before")
    )
    wanted = ranked.filter((F.col("rank") <= texts) & (F.coalesce("before", F.lit(0)) < limit)).select("lang", "h", "t")
    out: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sorted(wanted.collect(), key=lambda r: r["h"]):
        out[r["lang"]].append(r["t"])
    letters = _letters()
    return {k: v for k, v in out.items() if any(letters[points(t)].any() for t in v)}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each input row.

    Learns from rows outside the held-out fold of crc32(doc_id as text), and
    predicts from whole texts alone. A text that is null or has no letter is
    ``und`` with score 0. Ties go to the first name. Without any text to learn
    from, every row is ``und``. A null doc_id is neither held out nor learnt from.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, id_col, text_col, lang_col, folds, held_out)
    model = spark.sparkContext.broadcast(build(sample, symbols_each(len(sample))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and chars < 2_000_000:
                    chars += len(texts[hi] or "")
                    hi += 1
                names, scores = model.value.predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
