"""Quality scores by a regularised quadratic discriminant.

A document becomes a vector of transformed statistics of its whole text. Each class is a
Gaussian whose covariance is shrunk twice, towards the pooled covariance (ALPHA) and towards a
multiple of the identity (GAMMA). A score is the logistic function of the difference of the two
log densities plus the log prior ratio; a density needs a Mahalanobis distance, computed by a
forward substitution with the class's Cholesky factor, which is made once and kept in the model.

The fit needs only counts, sums and sums of products per class. They are exact: statistics are
rounded to 1/256, so the sums are sums of integers, Spark aggregates them over all labelled
rows in any order with the same result, and a single row reaches the driver for each class. No
sample is drawn.

Statistics use the text only, never language, source, key or a label. A null or empty text has
all statistics zero and is scored like any other. A label row without a quality or a document
isn't used; if a document has several label rows the largest quality counts once. With less than
two training rows of one of the classes every score is the prior. Statistics that don't vary at
all over the training rows get a variance of FLOOR standard scores, so a fit never fails. Repeated rows are separate rows;
empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.llm.arrow import slices, utf8
from posthorn.plans.scratch import materialise

FEATURES = (
    "log_words", "log_word_chars", "symbols", "upper", "digits", "punctuation", "pipes", "exclamations",
    "types", "repeated_next", "repeated_lines", "log_line_words", "top_word", "non_ascii",
)
SCALE = 256
ALPHA, GAMMA = 0.25, 0.005
#: The least variance, in statistics (1e-6 / SCALE**2) and in standard scores.
FLOOR = 1e-6
THRESHOLD = 0.3
#: One label row in FOLDS is held out.
FOLDS = 5

_D = len(FEATURES)


def statistics(text: bytes) -> list[float]:
    """FEATURES of one UTF-8 text; ratios are square roots, so that rare things spread out."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * _D
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(seen[:0x80].sum() + seen[0xC0:].sum())
    white = int(seen[0x20] + seen[0x09:0x0E].sum())
    solid = points - white
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    letters = int(seen[0x41:0x5B].sum() + seen[0x61:0x7B].sum())
    return [
        math.log1p(n),
        math.log(solid / n),
        root(int(seen[list(b"#*$%&<>")].sum()), solid),
        root(int(seen[0x41:0x5B].sum()), letters),
        root(int(seen[0x30:0x3A].sum()), solid),
        root(int(seen[list(b".,;:?'\"()-")].sum()), solid),
        root(int(seen[0x7C]), n),
        root(int(seen[0x21]), n),
        len(count) / n ** 0.8,
        root(sum(map(bytes.__eq__, words, words[1:])), n),
        root(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)),
        root(max(count.values()), n),
        root(int(seen[0xC0:].sum()), solid),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``x`` (array of integers, 1/SCALE each), written once: the only pass over the texts."""
    picked = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in utf8(batch.column(1))]).reshape(-1, _D)
            flat = np.rint(x * SCALE).astype(np.int64).ravel()
            ends = pa.array(np.arange(0, flat.size + 1, _D, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["key", "x"])

    kind = picked.schema["key"].dataType.simpleString()
    return materialise(picked.mapInArrow(run, f"key {kind}, x array<bigint>"), "quality-features")


def fold(key: Column) -> Column:
    """crc32 of a key as text, modulo FOLDS; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")), F.lit(FOLDS))


def _forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a lower triangular system for many right sides, row by row."""
    out = np.empty_like(right)
    for i in range(len(factor)):
        out[i] = (right[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors and log prior ratio of the two classes."""

    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    log_ratio: float

    @property
    def half_log_det(self) -> tuple[float, float]:
        return tuple(float(np.log(np.diag(f)).sum()) for f in self.factor)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for rows of integer statistics."""
        x = x / SCALE
        log_density = []
        for mean, factor, det in zip(self.mean, self.factor, self.half_log_det, strict=True):
            z = _forward(factor, (x - mean).T)
            log_density.append(-0.5 * (z * z).sum(axis=0) - det)
        gap = np.clip(log_density[1] - log_density[0] + self.log_ratio, -500, 500)
        return 1 / (1 + np.exp(-gap))


def moments(x: DataFrame, labels: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products for each class of ``labels`` (key, quality)."""
    best = labels.where("quality IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.max("quality").alias("quality"))
    pairs = [(i, j) for i in range(_D) for j in range(i, _D)]
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    v = [F.get("x", F.lit(i)) for i in range(_D)]
    rows = (
        x.join(best, "key").groupBy("quality")
        .agg(F.count("*").alias("n"), F.array(*(big(a) for a in v)).alias("s"), F.array(*(big(v[i] * v[j]) for i, j in pairs)).alias("p"))
        .where("quality IN (0, 1)").collect()
    )
    out = {}
    for r in rows:
        product = np.zeros((_D, _D))
        for (i, j), p in zip(pairs, r.p, strict=True):
            product[i, j] = product[j, i] = float(p)
        out[r.quality] = (r.n, np.array([float(a) for a in r.s]), product)
    return out


def _cholesky(c: np.ndarray) -> np.ndarray:
    """The factor of a covariance; rounding may leave one that is singular, so its diagonal is raised until it isn't."""
    more = 0.0
    while True:
        try:
            return np.linalg.cholesky(c + more * np.diag(np.diag(c)))
        except np.linalg.LinAlgError:
            more = max(10 * more, 1e-12)


def fit(found: dict[int, tuple[int, np.ndarray, np.ndarray]], alpha: float = ALPHA, gamma: float = GAMMA) -> Model:
    """The model of the moments of both classes."""
    n = [found.get(k, (0,))[0] for k in (0, 1)]
    ratio = math.log((n[1] + 1) / (n[0] + 1))
    if min(n) < 2:
        one = np.eye(_D)
        return Model((np.zeros(_D), np.zeros(_D)), (one, one), ratio)
    mean = [found[k][1] / n[k] for k in (0, 1)]
    scatter = [found[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / (sum(n) - 2)
    spread = np.sqrt(np.maximum(np.diag(pooled), FLOOR))  # shrinking to the identity is done on standard scores
    factors = []
    for k in (0, 1):
        c = (1 - alpha) * scatter[k] / (n[k] - 1) + alpha * pooled
        c = c / np.outer(spread, spread)
        c = (1 - gamma) * c + gamma * max(np.trace(c) / _D, FLOOR) * np.eye(_D)
        c = c * np.outer(spread, spread) / SCALE**2
        factors.append(_cholesky(c))
    return Model((mean[0] / SCALE, mean[1] / SCALE), tuple(factors), ratio)


def score(x: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for rows of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], ["key", "score"])

    kind = x.schema["key"].dataType.simpleString()
    scored = x.select("key", "x").mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Scores of all ``docs`` by a model of the label rows that are not held out."""
    x = features(docs, key, text)
    train = labels.select(labels[key].alias("key"), labels[quality].cast("int").alias("quality")).where(fold(F.col("key")) != 0)
    # A repeated document is one training row.
    return score(x, fit(moments(x.dropDuplicates(["key", "x"]), train)), key)
