"""Operator 1: document quality from preference pairs, by a Bradley-Terry model.

A document's worth is w.x for features x of its whole text.  That a document of label 1 is
preferred to one of label 0 has the probability sigmoid(w.(x1 - x0)); w is fitted to such pairs by
the logistic loss on the differences (with a ridge term, by Newton steps).  The threshold is the
quantile of the training scores at the share of label 0, and the score given out is
sigmoid(worth - threshold), so 0.5 stands at the threshold.

Features are counts of bytes, words, lines and repeats; they are made for a batch of texts at
once from the bytes.  Training reads at most `most_rows` labelled rows (a documented bound;
those of least hash), and collects their features only; scoring is one scan with no shuffle.

Defined cases: null and empty texts have all features 0 and are scored like any other; without
labels of both kinds every score is 0.5; rows with null label or doc_id train nothing; repeated
label rows count once; an empty table gives an empty result; other columns are
carried or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import small_batches

_ASCII = np.arange(32, 127)


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    w = W.Words(texts, W.SPACES)
    n = len(w.first) - 1
    size = np.diff(w.offsets).astype(np.float64)
    hist = np.zeros((n, 256))
    most = max(1, (1 << 22) // 256)
    for lo in range(0, n, most):
        hi = min(n, lo + most)
        part = w.raw[w.offsets[lo] : w.offsets[hi]]
        owner = np.repeat(np.arange(hi - lo), np.diff(w.offsets[lo : hi + 1]))
        hist[lo:hi] = np.bincount(owner * 256 + part, minlength=(hi - lo) * 256).reshape(-1, 256)
    safe = np.maximum(size, 1)
    share = hist / safe[:, None]
    count = w.counts.astype(np.float64)
    words = np.maximum(count, 1)
    length = (w.ends - w.starts).astype(np.float64)
    doc = w.doc
    per = lambda x: np.bincount(doc, x, n) / words if len(doc) else np.zeros(n)
    first, last = w.raw[w.starts] if len(w) else w.raw[:0], w.raw[w.ends - 1] if len(w) else w.raw[:0]
    sign = lambda b: ~(W.ALNUM[b]) & ~np.isin(b, np.frombuffer(b".,;:?!)\"'", np.uint8))
    fresh = lambda h, own, total: np.bincount(own[np.unique(h ^ W.mix(own.astype(np.uint64)), return_index=True)[1]], minlength=n) / np.maximum(total, 1) if len(own) else np.zeros(n)
    lines = hist[:, 10] + (size > 0)
    # lines as words of their own
    as_lines = W.Words(texts, _LINE)
    line_n = as_lines.counts
    cols = [
        np.log1p(size), np.log1p(count), per(length), np.sqrt(np.maximum(per(length**2) - per(length) ** 2, 0)), per((length > 15).astype(float)), per((length < 3).astype(float)),
        per(sign(first).astype(float)), per(sign(last).astype(float)), per((last == 0x21).astype(float)), per(((first >= 65) & (first <= 90)).astype(float)),
        fresh(w.hashes, doc, count), fresh(as_lines.hashes, as_lines.doc, line_n), count / np.maximum(lines, 1) / 50, np.log1p(lines), lines / words,
        share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1), share[:, 32], (size == 0).astype(float),
    ]
    return np.concatenate([np.stack(cols, 1), np.log1p(300 * share[:, _ASCII])], 1)


_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False


class Model:
    """Standardised features, weights and threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, spread: float):
        self.mean, self.scale, self.weights, self.threshold, self.spread = mean, scale, weights, threshold, spread

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.worth(x) - self.threshold) / self.spread, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 12, seed: int = 7) -> Model:
    """Weights from random pairs of a preferred and another row; the threshold from the scores' quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(width), 0.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = (z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]).astype(np.float64)
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, grad)
        w = w + step * min(1.0, 5 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)
    threshold = (s[k - 1] + s[min(k, len(s) - 1)]) / 2
    return Model(mean, scale, w, float(threshold), 1.0)


def held_out(doc_id) -> F.Column:
    """Whether a row is held out; a row without doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches):
    for batch in W.pieces(batches, "text"):
        x = features(batch.column("text")).astype(np.float32)
        yield pa.record_batch([batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = 30_000) -> Model:
    """The model from labelled rows that are not held out; most_rows bounds what reaches the driver."""
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    own = own.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "quality").limit(most_rows)
    small_batches(spark)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("id"))  # at most most_rows pairs of numbers
    # a doc_id with several texts counts with each of them, once; of very many those of least hash
    rows = rows.withColumn("h", F.xxhash64("id", "text")).groupBy("id", "quality", "h").agg(F.first("text").alias("text"))
    many = rows.count()
    if many > 2 * most_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < (1 << 40) * 2 * most_rows // many)
    got = rows.select("quality", "text").mapInArrow(_featured, "quality int, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64) if got else np.zeros((0, features(pa.array([""])).shape[1]))
    return fit(x, np.array([r["quality"] for r in got]))


def _scored(model):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            yield batch.append_column("score", pa.array(model.value.score(features(batch.column("text"))), pa.float64()))

    return run


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, most_rows: int = 30_000) -> DataFrame:
    """(doc_id, text, score): 0 to 1, at least 0.5 for documents kept.  carry: other columns, as a struct `carry`."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels, most_rows))
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    rows = docs.select("doc_id", "text", *rest)
    return rows.mapInArrow(_scored(model), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", score double")
