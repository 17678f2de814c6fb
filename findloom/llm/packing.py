"""Packing into fixed windows by minimum bin slack."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 4096, 2
#: Tokens of document tails that a task gathers before it packs them.
POOL_TOKENS = 1 << 22
#: Words, and pieces of words, whose ids a Python worker remembers from task to task.
CACHE_WORDS, CACHE_PIECES = 150_000, 300_000


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of at most ``counts`` lengths whose sum comes closest below ``capacity``.

    Bit k of the set says that some multiset of the lengths so far sums to k.
    A count is split into powers of two, so each length costs a logarithm of
    its count; the set before each part is kept for the way back. It stops as
    soon as the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, parts = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            parts.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(parts):
        if not (before >> total) & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_slack_bins(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Bins of item numbers. Each takes the longest item left and, beside it,
    the multiset of the others that leaves the least slack."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n, []).append(i)
    counts = {n: len(x) for n, x in by.items()}
    bins = []
    while counts:
        most = max(counts)
        chosen = {most: 1}
        counts[most] -= 1
        if not counts[most]:
            del counts[most]
        for n, k in best_fill(counts, window - most).items():
            chosen[n] = chosen.get(n, 0) + k
            counts[n] -= k
            if not counts[n]:
                del counts[n]
        bins.append([by[n].pop() for n, k in chosen.items() for _ in range(k)])
    return bins


#: ASCII signs, of which a word's end makes one piece of its own.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# How a tokenizer prepares texts whose words can be encoded one by one.
BY_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
BY_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_word(config: dict) -> bool:
    """Whether a tokenizer's file says that it lower-cases, never merges across
    white space, cuts letters from signs and writes bytes as letters."""
    normalizers = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [(s.get("pattern") or {}).get("Regex") for s in steps if s.get("type") == "Split"]
    plain = [not s.get("add_prefix_space") and not s.get("use_regex") for s in steps if s.get("type") == "ByteLevel"]
    return normalizers == BY_WORD_NORMALIZERS and patterns == [BY_WORD_PATTERN] and plain == [True] and len(steps) == 2


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a printable byte as itself and the others,
    in order, as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts, word by word with a memory (the dict itself).

    A tokenizer that ``encodes_by_word`` never merges across ASCII white space,
    so a text's ids are the ids of its words in turn. It also cuts a word of
    letters from the signs after it, so the two are looked up apart. Any other
    word goes through the whole tokenizer, as do all texts with any other file.
    """

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = encodes_by_word(json.loads(Path(path).read_text(encoding="utf-8")))
        self.model = self.tokenizer.model
        self.end = np.array([end], "<u4").tobytes()
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
            self.pieces[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode().lower()
        core = text.rstrip(_SIGNS)
        # Latin letters below U+0250 are composed already and lower-case one by one.
        if core.isalpha() and max(core) < "\u0250":
            ids = self._piece(core)
            if len(core) < len(text):
                ids += self._piece(text[len(core) :])
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def _words(self, text: bytes) -> list[bytes]:
        # A-Z may become a-z beforehand, unless that could compose with a mark
        # (their UTF-8 begins with CC or CD) or make the name of a special token.
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return text.split()
        return text.lower().split()

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes() + self.end
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        return b"".join([self[w] for w in self._words(text)]) + self.end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


class _Packer:
    """Pieces of one task, with its own run of sequence numbers."""

    def __init__(self, task: int, window: int):
        self.next, self.window = task << 33, window
        self.rows: list[tuple] = []
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.pooled = 0

    def _piece(self, doc, start, ids, total, offset) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window
        for start in range(0, total - total % step, step):
            self._piece(doc, start, ids[4 * start : 4 * (start + step)], total, 0)
            self.next += 1
        start = total - total % step
        if start < total:
            self.pool.append((doc, start, ids[4 * start :], total))
            self.pooled += total - start

    def pack(self, last: bool) -> None:
        """Fill windows from the pool; those with slack wait for more, unless this is the end."""
        bins = minimum_slack_bins([len(p[2]) // 4 for p in self.pool], self.window)
        waiting = []
        for b in bins:
            used = sum(len(self.pool[i][2]) // 4 for i in b)
            if used < self.window:
                waiting += [self.pool[i] for i in b]
                continue
            offset = 0
            for i in b:
                doc, start, ids, total = self.pool[i]
                self._piece(doc, start, ids, total, offset)
                offset += len(ids) // 4
            self.next += 1
        self.pool = waiting
        self.pooled = sum(len(p[2]) // 4 for p in waiting)
        if last:
            self._finish()

    def _finish(self) -> None:
        """What no full window takes is laid end to end and cut into full
        windows and then into powers of two, which need no padding."""
        left = self.pooled
        room = offset = 0
        for doc, start, ids, total in self.pool:
            at = 0
            while at < len(ids) // 4:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                    offset = 0
                n = min(room, len(ids) // 4 - at)
                self._piece(doc, start + at, ids[4 * at : 4 * (at + n)], total, offset)
                at, offset, room = at + n, offset + n, room - n
                if not room:
                    self.next += 1
        self.pool, self.pooled = [], 0

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    A document's ids are those of its text (null: empty) and ``end``. Windows
    that one document fills alone are cut off first; the tails are packed
    whole, by minimum bin slack, within the task that read them, so nothing is
    shuffled. A task's windows that stay open are cut into powers of two at its
    end, so no sequence needs padding. ``sequence_id`` holds the task's number
    above bit 33. An empty table gives no rows; repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(tokenizer, end), _Packer(TaskContext.get().partitionId(), window)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc, text in zip(ids, texts, strict=True):
                packer.add(doc, encode(text))
                if packer.pooled >= POOL_TOKENS:
                    packer.pack(False)
                if len(packer.rows) >= 10_000:
                    yield packer.flush()
        packer.pack(True)
        yield packer.flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, _FIELDS)
