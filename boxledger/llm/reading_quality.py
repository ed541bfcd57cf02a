"""Quality classifier (operator 7): Bradley-Terry scores learned from preference pairs of labelled documents.

A pair says that one document text is better than another. With scores s = w . f(text), the chance that the first wins
is sigmoid(s1 - s2): a logistic loss on feature differences without an intercept. The decision threshold is a quantile
of the training scores, taken at the share of bad documents among the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, first_by_hash, texts
from boxledger.llm.quality_rules import later_copies, repeated
from boxledger.llm.textarrays import Texts, U, mix, per_row, row_of, windows

TRAIN_ROWS = 6000
PARTNERS = 12  # preference pairs that each document of the smaller class gets
CUT_SCORE = 0.3  # what a score at the threshold quantile is mapped to

_BYTE_CLASSES = {
    "symbols": [ord(c) for c in "#*$%&<>~^=+_@\\"],
    "bars": [ord("|")],
    "marks": [ord(c) for c in "!?"],
    "stops": [ord(c) for c in ".,;:"],
    "digits": list(range(48, 58)),
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "other": list(range(128, 256)),
    "breaks": [10],
}
FEATURES = ("symbols", "bars", "marks", "stops", "digits", "upper_share", "other", "word_size", "long_words", "distinct_words", "doubled_words", "repeat_windows", "dup_lines", "line_words", "log_words", "no_words")


def features(t: Texts) -> np.ndarray:
    """One row of ``FEATURES`` per text; rates per word or byte, so that length enters only through its logarithm."""
    start, end, borders = t.words()
    hashes = t.span_hashes(start, end)
    n = np.diff(borders)
    words = np.maximum(n, 1)
    size = np.maximum(np.diff(t.at), 1)
    seen = {}
    for name, codes in _BYTE_CLASSES.items():
        hit = np.zeros(256, bool)
        hit[codes] = True
        seen[name] = per_row(hit[t.data], t.at)
    row = row_of(borders)
    salt = mix(np.arange(t.rows, dtype=np.uint64) + U(1))
    distinct = n - np.bincount(row[later_copies(hashes ^ salt[row])], minlength=t.rows)
    pair, pair_row, pair_first = windows(hashes, borders, 2)
    doubled = np.bincount(pair_row[hashes[pair_first] == hashes[pair_first + 1]], minlength=t.rows)
    tri, tri_row, _ = windows(hashes, borders, 3)
    again = np.bincount(tri_row[repeated(tri ^ salt[tri_row])], minlength=t.rows)
    line_start, line_end, line_borders = t.lines()
    line_row = row_of(line_borders)
    full = line_end > line_start
    copies = np.bincount(line_row[full][later_copies(t.span_hashes(line_start[full], line_end[full]) ^ salt[line_row[full]])], minlength=t.rows)
    lengths = end - start
    columns = [
        np.minimum(seen["symbols"] / words, 3),
        np.minimum(seen["bars"] / words, 3),
        np.minimum(seen["marks"] / words, 3),
        np.minimum(seen["stops"] / words, 3),
        np.minimum(seen["digits"] / words, 3),
        seen["upper"] / np.maximum(seen["upper"] + seen["lower"], 1),
        seen["other"] / size,
        np.minimum(per_row(lengths, borders) / words, 30),
        per_row(lengths > 30, borders) / words,
        distinct / words,
        doubled / words,
        again / words,
        copies / np.maximum(np.diff(line_borders), 1),
        np.minimum(n / np.diff(line_borders), 60),
        np.log1p(n),
        n == 0,
    ]
    return np.stack([c.astype(np.float64) for c in columns], 1)


@dataclass
class PreferenceModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, t: Texts) -> np.ndarray:
        """0 to 1, increasing in the Bradley-Terry score; ``CUT_SCORE`` at the threshold."""
        raw = (features(t) - self.mean) / self.scale @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT_SCORE / (1 - CUT_SCORE)), -30, 30)))


def fit_preferences(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> PreferenceModel:
    """Learn from at most ``train_rows`` labelled rows (document_id, quality 0 or 1); better means the higher label.

    Each document of the smaller class meets ``PARTNERS`` documents of the other class. Null labels or ids are left
    out; a document labelled several times has its lowest label. With one class or none, all scores are 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("document_id").isNotNull())
    known = known.groupBy("document_id").agg(F.min("quality").alias("quality"))
    # Bounded by train_rows, hence the broadcast.
    picked = F.broadcast(first_by_hash(known, "document_id", train_rows, seed=7))
    rows = texts(documents).join(picked, "document_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            f = features(Texts(batch.column(1)))
            values = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1], f.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], names=["document_id", "quality", "f"])

    got = rows.select(F.col("document_id").cast("bigint"), "text", F.col("quality").cast("int")).mapInArrow(measure, "document_id bigint, quality int, f array<double>").orderBy("document_id").toArrow()
    y = got.column("quality").to_numpy()
    k = len(FEATURES)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return PreferenceModel(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(CUT_SCORE / (1 - CUT_SCORE))))
    x = np.array(got.column("f").to_pylist())
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    ranks = (np.arange(len(few))[:, None] * PARTNERS + np.arange(PARTNERS)) % len(many)
    a, b = np.repeat(few, PARTNERS), many[ranks.ravel()]
    winner, loser = (b, a) if few is bad else (a, b)
    d = z[winner] - z[loser]
    w = np.zeros(k)
    for _ in range(40):  # Newton steps of the ridge-penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + 1e-3 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return PreferenceModel(mean, scale, w, float(np.quantile(s, (y == 0).mean())))


def score_documents(documents: DataFrame, model: PreferenceModel, cut_score: float = CUT_SCORE) -> DataFrame:
    """(document_id, score, predicted) of every document text; null texts count as empty, repeated rows stay."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            s = sent.value.score(Texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut_score).astype(np.int32))], names=["document_id", "score", "predicted"])

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(score, "document_id bigint, score double, predicted int")


def keep_good(documents: DataFrame, model: PreferenceModel, cut_score: float = CUT_SCORE) -> DataFrame:
    """The rows of ``documents`` that the model predicts as good, columns unchanged, in one pass over the texts."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            yield batch.filter(pa.array(sent.value.score(Texts(batch.column(place))) >= cut_score))

    return documents.mapInArrow(keep, documents.schema)
