"""Vectorised word and word-window hashes over a buffer of several texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the two polynomial hashes, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that one buffer takes; a longer text is a buffer of its own.
BUFFER_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse, as many as asked for so far."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            for k, base in enumerate(self.bases):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                self.known[k] = np.cumprod(steps, dtype=np.uint64)
        return self.known[0][:n], self.known[1][:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


class Words:
    """The white-space separated words of a list of UTF-8 texts, with their hashes.

    ``doc`` is each word's text, ``begin[d]:begin[d + 1]`` the words of text d.
    """

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        self.data = data
        b = np.frombuffer(data, np.uint8)
        space = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        n = len(self.start)
        power, inverse = _BYTES.upto(len(b) + 1)
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=run[1:])
        h = (run[self.end] - run[self.start]) * inverse[self.start]
        self.hash = mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(48)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.begin = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        wp, self._inverse = _WORDS.upto(n + 1)
        self._run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * wp[:n], out=self._run[1:])

    def windows(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the word sequences ``start : start + length``."""
        h = (self._run[start + length] - self._run[start]) * self._inverse[start]
        return mix(h + np.asarray(length).astype(np.uint64))


def buffers(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together fill a buffer."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BUFFER_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
