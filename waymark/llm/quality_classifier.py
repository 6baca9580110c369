"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text gives a short vector of shares and lengths, taken whole and transformed towards normal shape.
Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards its own mean
variance.  Class sums are added up by Spark over all training rows, with no sample; only sums of the size of
a covariance reach the driver, where each class's Cholesky factor is computed once.  A score is the logistic
function of the difference of the Mahalanobis log densities.

Defined results: null and empty texts have an all-zero count vector and a score like any other; rows without
a label, or with one that isn't 0 or 1, don't train; where a class has no training rows all scores are 0.5;
repeated rows give a row each; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordbuf import BY_SPACE, Words, chunks, runs

#: Shares of the pooled covariance and of the spherical one that a class covariance is shrunk to.
TO_POOLED, TO_SPHERE = 0.2, 0.02
THRESHOLD = 0.7
FEATURES = ["words", "word_length", "upper", "digit", "symbol", "exclaim", "stop", "bar", "high", "distinct", "repeats", "line_length", "longest_run", "common"]


def _classes() -> np.ndarray:
    """Which byte counts towards which share."""
    c = np.zeros((256, 7))
    c[65:91, 0] = 1
    c[48:58, 1] = 1
    for b in b"#$%&*<>@^~_=+\\{}[]":
        c[b, 2] = 1
    c[ord("!"), 3] = 1
    for b in b".,;:":
        c[b, 4] = 1
    c[ord("|"), 5] = 1
    c[128:, 6] = 1
    return c


_CLASSES = _classes()


def features_of(texts: list[bytes]) -> np.ndarray:
    words = Words(texts, BY_SPACE)
    hashes = words.hashes()
    threes = runs(hashes, 3) if len(words) >= 3 else np.zeros(0, np.uint64)
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        lo, n = int(words.first[k]), int(words.counts[k])
        size = max(len(text), 1)
        raw = np.frombuffer(text, np.uint8)
        counts = np.bincount(raw, minlength=256)
        shares = np.sqrt(counts @ _CLASSES / size)
        own = np.sort(hashes[lo : lo + n])
        distinct = 1 + np.count_nonzero(own[1:] != own[:-1]) if n else 0
        most = 0
        if n:
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            most = int(np.diff(edge).max())
        windows = np.sort(threes[lo : lo + max(0, n - 2)])
        repeats = np.count_nonzero(windows[1:] == windows[:-1]) / max(1, len(windows))
        mean = (size - n) / max(n, 1)
        out[k] = [np.log1p(n), np.log1p(mean), *shares, np.log((distinct + 1) / (n + 1)), np.sqrt(repeats), np.log1p(n / (counts[10] + 1)), np.log1p(most), np.sqrt(most / max(n, 1))]
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (array<double>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            x = features_of(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Two Gaussian densities; log odds of class 1 are a quadratic function of the statistics."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(FEATURES)
        self.ok = len(sums) == 2
        if not self.ok:
            return
        n = {c: s[0] for c, s in sums.items()}
        mean = {c: s[1 : d + 1] / n[c] for c, s in sums.items()}
        scatter = {c: s[d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = sum(n[c] * scatter[c] for c in sums) / sum(n.values())
        scale = np.sqrt(np.diag(pooled) + 1e-9)
        self.scale = scale
        self.mean, self.inverse, self.constant = {}, {}, {}
        for c in sums:
            own = scatter[c] / np.outer(scale, scale)
            own = (1 - TO_POOLED) * own + TO_POOLED * pooled / np.outer(scale, scale)
            own = (1 - TO_SPHERE) * own + TO_SPHERE * max(np.trace(own) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.mean[c], self.inverse[c] = mean[c] / scale, np.linalg.inv(factor)
            self.constant[c] = np.log(n[c] / sum(n.values())) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(x), 0.5)
        x = x / self.scale
        log = {c: self.constant[c] - 0.5 * np.square((x - self.mean[c]) @ self.inverse[c].T).sum(1) for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: DataFrame) -> Model:
    """rows: x and label (0 or 1).  Sums of 1, x and x x' by class, added up by Spark."""
    d = len(FEATURES)
    terms = F.concat(F.array(F.lit(1.0)), F.col("x"), F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b))))
    sums = rows.where("label in (0, 1)").select("label", terms.alias("t")).groupBy("label").agg(F.array(*[F.sum(F.col("t")[k]) for k in range(1 + d + d * d)]).alias("s"))
    return Model({r["label"]: np.array(r["s"]) for r in sums.collect()})  # two rows at most


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels (doc_id, quality) of held-out rows aren't used."""
    vectors = materialize(features(docs))
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    model = fit(vectors.join(known, "doc_id").select("x", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
