"""Mixing sources to target weights (operator 1): soft domain membership and rates by projected gradient.

A classifier trained on a labelled table gives every document a posterior over the domains. Nonnegative rates r then
solve the weighted least squares

    min  sum_d (sum_i u_i p_id r_i - w_d)^2 / (2 s_d)  +  ridge / 2 * sum_i u_i (r_i - 1)^2,   r >= 0

with u_i the document's share of all tokens, p_id its posterior, s_d the present share of domain d and w_d its target.
Measured with the weights u_i the Hessian has norm 1 + ridge, which fixes the step. A round needs only the K domain totals
of the corpus: a document's rate follows from its posterior and the short history of those totals, so no state is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

from boxledger.llm.common import byte_blocks, cut, texts
from boxledger.llm.textarrays import Texts, U, mix, per_row, row_of

BUCKETS = 1 << 15
TRAIN_ROWS = 2000  # of all domains together
LEAST_ROWS = 20  # of each domain, or all that it has
MAX_DOMAINS = 200
ROUNDS = 60
TOLERANCE = 1e-4
STILL = 1e-6  # change of the shares in a round at which the optimum is reached
RIDGE = 1e-3
SLOW = 0.5  # a round that leaves more of the error than this is slow


def gram_buckets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of every text and their row borders."""
    n = np.maximum(np.diff(t.at) - 2, 0)
    borders = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(t.rows), n)
    first = np.arange(len(row)) - borders[:-1][row] + t.at[:-1][row]
    wide = t.data.astype(np.uint64)
    return (mix((wide[first] << U(16)) | (wide[first + 1] << U(8)) | wide[first + 2]) & U(BUCKETS - 1)).astype(np.int32), borders


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # BUCKETS x domains
    bias: np.ndarray

    def posteriors(self, t: Texts) -> np.ndarray:
        buckets, borders = gram_buckets(t)
        z = np.empty((t.rows, len(self.domains)))
        for d in range(len(self.domains)):
            z[:, d] = per_row(self.weights[buckets, d].astype(np.float64), borders)
        z = z / np.maximum(np.diff(borders), 1)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_domains(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DomainModel:
    """Softmax regression on trigram shares of a sample of ``labelled`` (document_id, text, domain).

    The domains are those of all labelled rows. ``train_rows`` are shared out equally among them, at least
    ``LEAST_ROWS`` each: a domain's sample are the ids whose hashes lie below the share that gives this number on average,
    all ids of a domain that has no more; of a repeated id the first text. The bias then holds the shares of all labelled
    rows. Null ids and domains are left out; beyond ``MAX_DOMAINS`` names an error is raised. Without any labelled row
    there is one domain, ``all``.
    """
    known = texts(labelled.where(F.col("domain").isNotNull() & F.col("document_id").isNotNull()), F.col("domain").cast("string").alias("domain"))
    per_id = known.groupBy("domain", "document_id").agg(F.count("*").alias("n"))
    counts = per_id.groupBy("domain").agg(F.count("*").alias("ids"), F.sum("n").alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names = [r["domain"] for r in counts] or ["all"]
    each = max(LEAST_ROWS, train_rows // len(names))
    bounds = [(r["domain"], int(-(2**63) + min(1.0, each / r["ids"]) * (2**64 - 1)) if each < r["ids"] else 2**63 - 1) for r in counts]
    sampled = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "domain string, bound bigint"))  # at most MAX_DOMAINS rows
    inside = known.join(sampled, "domain").where(F.xxhash64(F.lit(1), "document_id") <= F.col("bound"))
    rows = inside.groupBy("domain", "document_id").agg(F.min("text").alias("text")).orderBy("document_id", "domain").toArrow()
    k, n = len(names), rows.num_rows
    weights, bias = np.zeros((BUCKETS, k)), np.zeros(k)
    if n and k > 1:
        y = np.array([names.index(x) for x in rows.column("domain").to_pylist()])
        cells, done = [], 0
        for batch in byte_blocks(rows.select(["text"]).to_batches()):
            buckets, borders = gram_buckets(Texts(batch.column(0)))
            flat, count = np.unique(row_of(borders) * BUCKETS + buckets, return_counts=True)
            r = flat // BUCKETS
            cells.append((r + done, flat % BUCKETS, count / np.maximum(np.diff(borders), 1)[r]))
            done += batch.num_rows
        row, col, val = (np.concatenate(x) for x in zip(*cells, strict=True))
        onehot = np.eye(k)[y]
        bias = np.log(np.maximum(onehot.mean(0), 1e-12))
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, 61):
            z = np.stack([np.bincount(row, val * weights[col, d], minlength=n) for d in range(k)], 1) + bias
            p = np.exp(z - z.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - onehot) / n
            grad = np.stack([np.bincount(col, val * err[row, d], minlength=BUCKETS) for d in range(k)], 1) + 1e-7 * weights
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            weights = weights - 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        share = np.array([r["n"] for r in counts], float)
        bias = np.log(share / share.sum())
    return DomainModel(names, weights.astype(np.float32), bias)


def domain_members(documents: DataFrame, model: DomainModel, keep: bool = False) -> DataFrame:
    """(document_id, n_tokens, posteriors): words and domain posteriors of every text; repeated rows stay.

    ``keep`` adds ``text`` as it was given and the other columns of ``documents`` as the struct ``kept``.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            t = Texts(batch.column(1).fill_null(""))
            p = sent.value.posteriors(t)
            values = pa.ListArray.from_arrays(np.arange(t.rows + 1, dtype=np.int32) * p.shape[1], p.ravel())
            more = batch.columns[1:] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(t.words()[2])), values, *more], names=["document_id", "n_tokens", "posteriors", *batch.schema.names[1 : 1 + len(more)]])

    rows = documents.select(F.col("document_id").cast("bigint").alias("document_id"), F.col("text").cast("string").alias("text"), *_kept(documents, keep))
    schema = StructType().add("document_id", LongType()).add("n_tokens", LongType()).add("posteriors", ArrayType(DoubleType()))
    for field in rows.schema.fields[1:] if keep else []:
        schema = schema.add(field)
    return rows.mapInArrow(score, schema)


def _kept(documents: DataFrame, keep: bool) -> list[Column]:
    others = [F.col(c) for c in documents.columns if c not in ("document_id", "text")]
    return [F.struct(*others).alias("kept")] if keep and others else []


def replay(p: np.ndarray, history: list[tuple[np.ndarray, float]], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead rates (Nesterov) of documents with posteriors ``p`` after the rounds of ``history``."""
    r = np.ones(len(p))
    z = r
    for slope, momentum in history:
        step = np.maximum(0.0, z - (p @ slope + ridge * (z - 1)) / (1 + ridge))
        z = step + momentum * (step - r)
        r = step
    return r, z


def _posteriors(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("posteriors")).flatten().to_numpy().reshape(-1, k)


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> tuple[DataFrame, dict[str, float]]:
    """Rates for the rows of ``members`` (document_id, n_tokens, posteriors) and the domain shares they lead to.

    ``weights``: target share of tokens per domain, in any unit; the total number of tokens is kept. Domains without any
    tokens are left out of the targets. Rounds end when no domain's share is further than ``tolerance`` from its target, or
    when the shares stand still: the ridge and rates that can't be negative may keep the optimum off the targets.
    ``converged`` is false where ``rounds`` ended before either. Every row has ``target_share`` and ``reached_share`` of its domain and ``largest_gap``, the distance of the domain that
    is furthest from its target: targets that no rates reach show there. Other columns of ``members`` stay.
    """
    k = len(domains)
    unknown = sorted(str(d) for d, w in weights.items() if w > 0 and d not in domains)
    if unknown:
        raise ValueError(f"no rows of the weighted domains {', '.join(unknown)}")

    def totals(history: list[tuple[np.ndarray, float]], ahead: bool) -> tuple[np.ndarray, float]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = np.zeros(k), 0.0
            for batch in batches:
                if batch.num_rows:
                    p = _posteriors(batch, k)
                    n = batch.column(0).to_numpy().astype(float)
                    total += (n * replay(p, history, ridge)[int(ahead)]) @ p
                    tokens += n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int64)), pa.array(np.append(total, tokens))], names=["d", "t"])

        rows = members.select("n_tokens", "posteriors").mapInArrow(add, "d bigint, t double").groupBy("d").agg(F.sum("t").alias("t")).collect()  # k + 1 rows
        got = np.zeros(k + 1)
        for r in rows:
            got[r["d"]] = r["t"]
        return got[:k], got[k]

    history: list[tuple[np.ndarray, float]] = []
    now, tokens = totals(history, False)
    shares = now / max(tokens, 1.0)
    there = shares > 1e-12
    target = np.array([max(0.0, float(weights.get(d, 0.0))) for d in domains]) * there
    reached, goal, converged = shares, shares, True
    if tokens and target.sum() > 0:
        goal = target = target / target.sum()
        ahead, t, error, converged = shares, 1.0, np.inf, False
        for _ in range(rounds):
            slope = np.round(np.where(there, (ahead - target) / np.where(there, shares, 1), 0.0), 10)
            off = np.abs(ahead - target).max()
            # Momentum only while plain steps shrink the error slowly (overlapping domains); it starts anew when they don't.
            next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2 if error * SLOW < off < error else 1.0
            history.append((slope, (t - 1) / next_t))
            t, error = max(next_t, 1.0), off
            before, ahead = ahead, totals(history, True)[0] / tokens
            converged = bool(np.abs(ahead - target).max() <= tolerance or np.abs(ahead - before).max() <= STILL)
            if converged:
                break
        # The look-ahead point that was measured is the last step.
        if history:
            history[-1] = (history[-1][0], 0.0)
        reached = totals(history, False)[0] / tokens
    gap = float(np.abs(reached - goal).max(initial=0))
    more = [f for f in members.schema.fields if f.name not in ("document_id", "n_tokens", "posteriors")]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(domains, object)
        for batch in batches:
            if batch.num_rows:
                p = _posteriors(batch, k)
                best = p.argmax(1)
                numbers = [replay(p, history, ridge)[0], goal[best], reached[best], np.full(len(p), gap), np.full(len(p), converged)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(p.max(1)), batch.column(2), *map(pa.array, numbers), *batch.columns[3:]],
                    names=[*schema.names[:10], *batch.schema.names[3:]],
                )

    schema = StructType().add("document_id", LongType()).add("n_tokens", LongType()).add("domain", StringType()).add("p_domain", DoubleType()).add("posteriors", ArrayType(DoubleType()))
    for name in ("rate", "target_share", "reached_share", "largest_gap"):
        schema = schema.add(name, DoubleType())
    schema = schema.add("converged", BooleanType())
    for field in more:
        schema = schema.add(field)
    rates = members.select("document_id", "n_tokens", "posteriors", *[f.name for f in more]).mapInArrow(rate, schema)
    return rates, dict(zip(domains, reached.tolist(), strict=True))


def mix_sources(documents: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, keep: bool = False) -> DataFrame:
    """(document_id, n_tokens, domain, p_domain, posteriors, rate, target_share, reached_share, largest_gap, converged) for every row.

    ``documents``: document_id, text (recognised text of a form document); ``labelled``: document_id, text, domain (the
    form family, supplier or language). ``rate`` says how often a document should be seen so that the expected tokens of
    each domain meet ``weights`` (default: equal shares) at the present total; a weight whose domain has no labelled row is
    an error. Null texts have no tokens and the prior
    as posterior. A null document_id stays null. A rate can be 0: where posteriors are weak or a target is far from the
    present share, equal targets may need that; ``largest_gap`` tells how far the reached shares are off. ``keep`` adds
    ``text`` and the other columns of ``documents`` as the struct ``kept``.
    """
    model = fit_domains(labelled)
    members = cut(domain_members(documents, model, keep))
    return fit_rates(members, model.domains, weights or dict.fromkeys(model.domains, 1.0))[0]
