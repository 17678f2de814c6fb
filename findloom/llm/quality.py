"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialize

#: The document statistics, each after its transformation. Shares are taken of a
#: count plus a constant, so that a few words prove little.
FEATURES = (
    "log_words",
    "symbols",
    "capitals",
    "stutter",
    "variety",
    "pair_variety",
    "compressed",
    "log_word_bytes",
    "repeated_lines",
    "marked_words",
    "lone_symbols",
)
#: Share of the diagonal in a class covariance, and the least variance of a statistic.
SHRINKAGE, FLOOR = 0.05, 1e-3
THRESHOLD = 0.3
#: Labelled rows that the pipeline's model is fit on at most, those of lowest hash.
FIT_ROWS = 20_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: ASCII signs other than those of running prose.
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN[list(b".,;:'\"-()")] = False
_SIGN_BYTES = bytes(np.flatnonzero(_SIGN).astype(np.uint8))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole UTF-8 text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = int(seen.sum())
    upper, lower, signs = int(seen[_UPPER].sum()), int(seen[_LOWER].sum()), int(seen[_SIGN].sum())
    lines = text.split(b"\n")
    follow = words[1:]
    pairs = len(set(zip(words, follow)))  # noqa: B905 - the last word has no follower
    marked = sum(1 for w in words if w[-1] in _SIGN_BYTES)
    signs_only = {w for w in set(words) if not w.strip(_SIGN_BYTES)}
    alone = sum(map(signs_only.__contains__, words)) if signs_only else 0
    return [
        np.log1p(n),
        (signs / (size + 100)) ** 0.5,
        (upper / (upper + lower + 100)) ** 0.5,
        (sum(map(eq, words, follow)) / (n + 20)) ** 0.5,
        np.log1p(len(set(words))) / np.log1p(n),
        np.log1p(pairs) / np.log1p(max(n - 1, 1)),
        min(1.2, len(zlib.compress(text, 1)) / (size + 100)),
        np.log(size / n),
        ((len(lines) - len(set(lines))) / (len(lines) + 5)) ** 0.5,
        (marked / (n + 20)) ** 0.5,
        (alone / (n + 20)) ** 0.5,
    ]


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts]).reshape(len(texts), len(FEATURES))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, one double for each of FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], ["doc_id", *FEATURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} double" for k in FEATURES))


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: a Mahalanobis log-density difference, squashed."""
        density = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame, label_col: str = "label", shrinkage: float = SHRINKAGE) -> Model:
    """Class moments of all labelled rows in one aggregation; two rows reach the driver.

    A class without rows gets the other's moments, so that scores stay at the
    prior; without any labelled row, every score is 0.5.
    """
    k = len(FEATURES)
    sums = [F.sum(f).alias(f"s_{f}") for f in FEATURES]
    squares = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q_{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = {r[label_col]: r for r in labelled.groupBy(label_col).agg(F.count("*").alias("n"), *sums, *squares).collect() if r[label_col] in (0, 1)}
    found = {}
    for c, r in rows.items():
        mean = np.array([r[f"s_{f}"] for f in FEATURES]) / r["n"]
        cov = np.empty((k, k))
        for i in range(k):
            for j in range(i, k):
                cov[i, j] = cov[j, i] = r[f"q_{i}_{j}"] / r["n"] - mean[i] * mean[j]
        found[c] = (r["n"], mean, cov)
    blank = (0, np.zeros(k), np.eye(k))
    both = [found.get(c) or (0, *(found.get(1 - c) or blank)[1:]) for c in (0, 1)]
    total = both[0][0] + both[1][0]
    means, whiten, constants = [], [], []
    for n, mean, cov in both:
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + FLOOR * np.eye(k)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log((n + 1) / (total + 2)) - np.log(np.diag(factor)).sum()))
    return Model(means, whiten, constants)


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """Rows (doc_id, label) to learn from: ids outside fold 0 (crc32 of the id as text), of several labels the greatest."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    return known.filter(crc_bucket(F.col("doc_id"), folds) != 0)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5) -> Model:
    """A model from all labelled rows outside fold 0."""
    return fit(stats.join(known_labels(labels, id_col, label_col, folds), "doc_id"))


def train_on_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, rows: int = FIT_ROWS) -> Model:
    """A model from at most ``rows`` labelled ids outside fold 0, those of lowest
    hash; statistics are computed of their documents alone. The ids are
    broadcast, which ``rows`` bounds."""
    known = known_labels(labels, id_col, label_col, folds).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    sample = own.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    return fit(with_statistics(sample, "doc_id", "t").join(F.broadcast(known), "doc_id"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row.

    Null and empty texts are scored by statistics of zero. A null doc_id is
    never held out and never learnt from. Repeated rows stay repeated.
    """
    stats = materialize(with_statistics(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col, folds=folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    The model learns from ``FIT_ROWS`` labelled documents at most; every
    document is scored by the statistics of its whole text, where it is read,
    so no text is shuffled. Null and empty texts are scored like any other;
    rows with a null id stay or go by their text.
    """
    model = train_on_sample(docs, labels, id_col, text_col, folds=folds)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            good = model.score(_matrix(texts)) >= threshold if texts else np.zeros(0, bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
