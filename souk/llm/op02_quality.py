"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics, transformed so that a class is near a Gaussian. From labelled rows outside the
held-out fold, at most `max_train` of them, taken by a hash of their id, each class gets a mean and a covariance shrunk
towards the pooled one and towards a multiple of the identity. The score of a text is the logistic of the difference of
the two log densities, from Mahalanobis distances through the cached Cholesky factors, plus the log odds of the classes.

doc_id, source, lang and labels are never inputs of a score. Ratios carry pseudo-counts, so short and empty texts lie near the
middle of the range of normal texts.

Defined results: a null text scores as an empty one, and an empty one by its statistics like any other (on the tables here it scores
above the threshold); labels that are null, no number or other than 0 and 1 are not learnt from, nor is an id with both; equal
labels of an id count once, and rows of documents that share a labelled id are learnt from each. If a class has fewer than two rows
to learn from, every score is the smoothed share of label 1; rows that repeat are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import binary_column, slices, with_text

#: Fixed by the contract.
FOLDS = 5
THRESHOLD = 0.3
#: Most labelled rows that are fitted.
MAX_TRAIN = 20_000
#: Shares of the pooled covariance and of the scaled identity in a class covariance.
TO_POOLED = 0.1
TO_IDENTITY = 0.02

_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))
_MARKS = re.compile(rb"[#*$%&<>@^~=+\\{}\[\]_/]")
N_FEATURES = 14


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text, N_FEATURES of them."""
    words = text.split()
    n = len(words)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_chars = sum(map(len, words))
    upper, lower = (len(text) - len(text.translate(None, x)) for x in (_UPPER, _LOWER))
    digits = len(text) - len(text.translate(None, _DIGIT))
    marks = len(_MARKS.findall(text))
    pipes, bangs, stops = text.count(b"|"), text.count(b"!"), text.count(b".") + text.count(b",")

    def share(x: float, of: float, usual: float, weight: float = 10.0) -> float:
        return math.log((x + usual * weight + 0.05) / (of + weight))

    return [
        share(marks, n, 0.01),
        share(pipes, n, 0.005),
        share(bangs, n, 0.01),
        share(upper, upper + lower, 0.03, 30.0),
        share(digits, n_chars, 0.005, 50.0),
        share(stops, n, 0.12),
        share(runs, n, 0.01),
        share(top, n, 0.1),
        (len(counts) + 8.0) / (10.0 + n) ** 0.85,
        share(pairs, n, 0.9),
        share(len(lines) - len(set(lines)), len(lines), 0.02, 5.0),
        math.log((n + 10.0) / (len(lines) + 1.0)),
        math.log((n_chars + 45.0) / (n + 10.0)),
        math.log(n + 10.0),
    ]


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the Cholesky factor of the covariance
    log_norm: float

    @staticmethod
    def of(mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        cholesky = np.linalg.cholesky(covariance)
        return Gaussian(mean, np.linalg.inv(cholesky), -float(np.log(np.diag(cholesky)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.log_norm - 0.5 * np.square((x - self.mean) @ self.factor.T).sum(1)


@dataclass(frozen=True)
class Discriminant:
    good: Gaussian | None
    bad: Gaussian | None
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.good and self.bad and len(x):
            z = z + self.good.log_density(x) - self.bad.log_density(x)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    log_odds = math.log((n1 + 1.0) / (n0 + 1.0))
    if min(n0, n1) < 2:
        return Discriminant(None, None, log_odds)
    scatter = {k: np.cov(x[y == k], rowvar=False, bias=True) for k in (0, 1)}
    pooled = (n0 * scatter[0] + n1 * scatter[1]) / (n0 + n1)
    made = {}
    for k in (0, 1):
        s = (1 - to_pooled) * scatter[k] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        made[k] = Gaussian.of(x[y == k].mean(0), s)
    return Discriminant(made[1], made[0], log_odds)


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Discriminant:
    """Fitted on at most max_train labelled rows outside the held-out fold. Those rows' vectors, a bounded number, come to the driver."""
    told = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").try_cast("double").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & (fold(F.col("_id")) != 0))
    usable = told.groupBy("_id").agg(F.min("_label").cast("int").alias("_label"), F.max("_label").cast("int").alias("_top")).where("_label = _top").drop("_top")
    picked = usable.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_train)
    rows = with_text(docs, id_col, text_col).join(F.broadcast(picked), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            vectors = [statistics(t) for t in binary_column(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")).cast(pa.string()), batch.column(batch.schema.get_field_index("_label")), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "label", "x"])

    found = sorted((r["id"], r["label"], r["x"]) for r in rows.mapInArrow(run, "id string, label int, x array<double>").collect())
    x = np.array([r[2] for r in found], float).reshape(len(found), N_FEATURES)
    return fit(x, np.array([r[1] for r in found], int))


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    source = with_text(docs, id_col, text_col).withColumn("_held", F.coalesce(fold(F.col("_id")) == 0, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            s = model.score(np.array([statistics(t) for t in binary_column(batch, "_text")]).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {source.schema['_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            s = model.score(np.array([statistics(t) for t in binary_column(batch, text_col)]).reshape(-1, N_FEATURES))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
