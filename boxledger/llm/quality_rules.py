"""Quality rules (operator 9): a few counts with fixed limits, then a calibrated hashed n-gram classifier.

The classifier is a logistic regression over hashed words, word pairs and character trigrams, each as a share of the
document's n-grams, so that document length cancels out. It is trained on a bounded sample of labelled rows (parameter
``train_rows``), one third of which is kept back to calibrate its probability (Platt scaling). Scoring reads whole texts
in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, first_by_hash, texts
from boxledger.llm.textarrays import IS_HEAD, Texts, U, mix, per_row, row_of, windows

BUCKETS = 1 << 17  # of each of the three groups of n-grams
TRAIN_ROWS = 3000
CALIBRATION_ROWS = 10  # of each class
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_PROBABILITY = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "document_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, probability double, kept boolean"
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


@dataclass
class Grams:
    """N-gram buckets of a batch: for each group the buckets and their row borders."""

    groups: list[tuple[np.ndarray, np.ndarray]]
    counts: dict[str, np.ndarray]


def grams(t: Texts) -> Grams:
    start, end, borders = t.words()
    hashes = t.span_hashes(start, end)
    row = row_of(borders)
    n_words = np.diff(borders)

    trigrams, tri_row, first = windows(hashes, borders, 3)
    again = first[repeated(trigrams ^ mix(tri_row.astype(np.uint64) + U(1)))]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[again + k] = True

    line_start, line_end, line_borders = t.lines()
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_row = row_of(line_borders)[with_word]
    line_keys = t.span_hashes(line_start[with_word], line_end[with_word]) ^ mix(line_row.astype(np.uint64) + U(1))
    dup_lines = np.bincount(line_row[later_copies(line_keys)], minlength=t.rows)

    heads = IS_HEAD[t.data]
    before = np.zeros(len(heads) + 1, np.int64)
    np.cumsum(heads, out=before[1:])
    word_chars = per_row(before[end] - before[start], borders)
    counts = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_row(SYMBOLS[t.data], t.at),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_row(covered, borders),
    }

    pairs, pair_row, pair_first = windows(hashes, borders, 2)
    doubled = hashes[pair_first] == hashes[pair_first + 1]
    pairs[doubled] = U(1)  # any word said twice in a row is one n-gram
    pair_borders = np.searchsorted(pair_row, np.arange(t.rows + 1))

    points = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != before[-1]:  # malformed bytes: take bytes instead
        points, point_at = t.data.astype(np.uint32), t.at
    else:
        point_at = before[t.at]
    n_chars = np.maximum(np.diff(point_at) - 2, 0)
    char_row = np.repeat(np.arange(t.rows), n_chars)
    at = np.arange(len(char_row)) + 2 * char_row if not (np.diff(point_at) < 2).any() else np.arange(len(char_row)) - np.repeat(np.cumsum(n_chars) - n_chars, n_chars) + point_at[:-1][char_row]
    wide = points.astype(np.uint64)
    chars = mix((wide[at] << U(42)) ^ (wide[at + 1] << U(21)) ^ wide[at + 2])
    char_borders = np.concatenate([[0], np.cumsum(n_chars)])
    mask = U(BUCKETS - 1)
    groups = [
        ((hashes & mask).astype(np.int64), borders),
        ((pairs & mask).astype(np.int64), pair_borders),
        ((chars & mask).astype(np.int64), char_borders),
    ]
    return Grams(groups, counts)


@dataclass
class RulesModel:
    weights: np.ndarray  # 3 x BUCKETS
    bias: float
    slope: float
    shift: float

    def raw(self, g: Grams) -> np.ndarray:
        score = np.full(len(g.counts["n_words"]), self.bias)
        for weights, (buckets, borders) in zip(self.weights, g.groups, strict=True):
            score += per_row(weights[buckets], borders) / np.maximum(np.diff(borders), 1)
        return score

    def probability(self, g: Grams) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(g) + self.shift, -30, 30)))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps, with Platt's smoothed targets."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([raw, np.ones_like(raw)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit_quality_rules(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RulesModel:
    """Train on at most ``train_rows`` rows of ``labels`` (document_id, quality) and their document texts.

    ``documents``: document_id, text (recognised text of a form document). Null labels and ids are left out; a document
    labelled several times counts as good only if all its labels are. With one class or none, every document gets
    probability 1.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("document_id").isNotNull())
    known = known.groupBy("document_id").agg(F.min("quality").alias("quality"))
    # Bounded by train_rows, hence the broadcast.
    picked = F.broadcast(first_by_hash(known, "document_id", train_rows, seed=9))
    rows = texts(documents).join(picked, "document_id").orderBy("document_id", "text").toArrow()
    y = rows.column("quality").to_numpy().astype(float)
    weights = np.zeros((3, BUCKETS), np.float32)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return RulesModel(weights, 30.0, 1.0, 0.0)
    cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0
    for batch in byte_blocks(rows.select(["text"]).to_batches()):
        g = grams(Texts(batch.column(0)))
        for k, (buckets, borders) in enumerate(g.groups):
            flat = row_of(borders) * (3 * BUCKETS) + k * BUCKETS + buckets
            uniq, n = np.unique(flat, return_counts=True)
            r = uniq // (3 * BUCKETS)
            cells.append((r + done, uniq % (3 * BUCKETS), n / np.maximum(np.diff(borders), 1)[r]))
        done += batch.num_rows
    row, col, val = (np.concatenate(x) for x in zip(*cells, strict=True))
    held = np.arange(len(y)) % 3 == 2
    train = ~held
    balance = np.where(y > 0, 0.5 / max((y[train] > 0).mean(), 1e-9), 0.5 / max((y[train] == 0).mean(), 1e-9)) * train
    balance /= balance.sum()
    w, b = np.zeros(3 * BUCKETS), 0.0
    m, v = np.zeros(3 * BUCKETS + 1), np.zeros(3 * BUCKETS + 1)
    rate, decay = 0.5, 1e-7
    for step in range(1, 121):
        raw = np.bincount(row, val * w[col], minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * balance
        grad = np.append(np.bincount(col, val * err[row], minlength=3 * BUCKETS) + decay * w, err.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= move[:-1]
        b -= move[-1]
    raw = np.bincount(row, val * w[col], minlength=len(y)) + b
    # Too few rows kept back to see both classes: all rows calibrate.
    seen = held if min(y[held].sum(), (y[held] == 0).sum()) >= CALIBRATION_ROWS else np.ones(len(y), bool)
    slope, shift = platt(raw[seen], y[seen])
    return RulesModel(w.reshape(3, BUCKETS).astype(np.float32), float(b), slope, shift)


def quality_rules(
    documents: DataFrame,
    model: RulesModel,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    keep_probability: float = KEEP_PROBABILITY,
) -> DataFrame:
    """Counts, rule result and classifier verdict of every document text.

    ``documents``: document_id, text. A null text counts as empty (no words, base_failed). Every input row gives one
    output row, repeated rows too; a null document_id stays null. ``n_repeat_words`` counts the words that lie in some
    three-word window found at least twice in the text. ``kept`` is false where a base rule fails, else whether the
    calibrated probability reaches ``keep_probability``.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            g = grams(Texts(batch.column(1)))
            p = sent.value.probability(g)
            c = g.counts
            failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
            out = [batch.column(0), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_probability))]
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(score, SCHEMA)
