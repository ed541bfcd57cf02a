"""Language ID (operator 5): prediction by partial matching over bytes with frozen statistics.

Every language has a context tree of orders 0 to ``ORDER``. The chance of a byte in the longest seen context is
count / (total + distinct); the rest of the mass escapes to the next shorter context, whose chances are taken under the
condition that no symbol seen in the longer one follows (exclusion); below order 0 all bytes are equally likely. As the statistics are frozen, the exact code
length of a byte depends only on its longest context in the tree, so the trees are flattened into one table of bits per
(context, byte, language) and a text is scored by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, first_by_hash, texts
from boxledger.llm.textarrays import Texts

ORDER = 3
TRAIN_ROWS = 250  # documents per language
TRAIN_BYTES = 500_000  # bytes per language that enter the trees, spread over its documents
TRAIN_LANGUAGES = 200  # languages that a model may have; more are an error
UNKNOWN = "und"


@dataclass
class ContextTrees:
    languages: list[str]
    alphabet: np.ndarray  # byte -> symbol; bytes never seen in training share symbol 0
    symbols: int
    state: np.ndarray  # context of ORDER symbols -> row of bits
    bits: np.ndarray  # rows x symbols x languages, float32

    def code_lengths(self, t: Texts) -> np.ndarray:
        """Bits of each text under each language; the context at the start of a text is ORDER line breaks."""
        s, k = self.symbols, len(self.languages)
        opening = int(self.alphabet[10])
        ids = self.alphabet[t.data]
        n = len(ids)
        total = np.zeros((t.rows, k))
        if not n:
            return total
        padded = np.concatenate([np.full(ORDER, opening, ids.dtype), ids]).astype(np.int32)
        context = np.zeros(n, np.int32)
        for back in range(ORDER, 0, -1):
            context = context * s + padded[ORDER - back : ORDER - back + n]
        starts = t.at[:-1]
        for j in range(ORDER):  # the first bytes of a row don't see the row before
            at = starts[np.diff(t.at) > j] + j
            value = np.zeros(len(at), np.int32)
            for back in range(ORDER, 0, -1):
                value = value * s + (padded[ORDER + at - back] if back <= j else opening)
            context[at] = value
        cell = self.state[context].astype(np.int64) * s + ids
        flat = self.bits.reshape(-1, k)
        full = np.diff(t.at) > 0
        step = 1 << 18
        order = starts[full]
        sums = np.empty((len(order), k))
        for lang in range(k):
            per_byte = np.empty(n, np.float64)
            for a in range(0, n, step):
                per_byte[a : a + step] = flat[cell[a : a + step], lang]
            sums[:, lang] = np.add.reduceat(per_byte, order) if len(order) else 0
        total[full] = sums
        return total


def _flatten(trees: list[list[tuple[np.ndarray, np.ndarray]]], s: int, alphabet_left: int) -> tuple[np.ndarray, np.ndarray]:
    """State table and bits of all contexts that any language has seen; ``trees[l][o]``: keys (context, symbol) and counts."""
    k = len(trees)
    seen = [np.unique(np.concatenate([tree[order][0] // s for tree in trees])) if order else np.array([0]) for order in range(ORDER + 1)]
    offset = np.cumsum([0] + [len(x) for x in seen])
    row_at = [np.full(s**order, -1, np.int32) for order in range(ORDER + 1)]
    for order in range(ORDER + 1):
        row_at[order][seen[order]] = offset[order] + np.arange(len(seen[order]))
    bits = np.empty((offset[-1], s, k), np.float32)
    for lang, tree in enumerate(trees):
        probs: list[np.ndarray] = []
        for order in range(ORDER + 1):
            keys, n_seen = tree[order]
            counts = np.zeros((len(seen[order]), s))
            counts[np.searchsorted(seen[order], keys // s), keys % s] = n_seen
            if order == 0:
                below = np.full((1, s), 1.0 / 256)
                below[0, 0] = alphabet_left / 256  # all unseen bytes together; the share of one is taken at the end
            else:
                suffix = seen[order] % (s ** (order - 1))
                below = probs[order - 1][row_at[order - 1][suffix] - offset[order - 1]]
            # With exclusion: what the escape leads to is spread over symbols not seen in this context.
            left = np.where(counts > 0, 0.0, _excluded(below, counts))
            n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            none = n == 0
            full = left.sum(1, keepdims=True) <= 1e-12
            escape = np.where(full, 0.0, d / np.maximum(n + d, 1))
            own = counts / np.maximum(n, 1) * (1 - escape)
            p = np.where(none, below, own + escape * left)
            probs.append(p)
            rows = slice(offset[order], offset[order + 1])
            shown = p.copy()
            if alphabet_left:
                shown[:, 0] /= alphabet_left
            bits[rows, :, lang] = -np.log2(np.maximum(shown, 1e-30))
    state = np.empty(s**ORDER, np.int32)
    keys = np.arange(s**ORDER)
    state[:] = row_at[ORDER]
    for order in range(ORDER - 1, -1, -1):
        missing = np.flatnonzero(state < 0)
        state[missing] = row_at[order][keys[missing] % (s**order)]
    return state, bits


def _excluded(below: np.ndarray, counts: np.ndarray) -> np.ndarray:
    rest = np.where(counts > 0, 0.0, below)
    return rest / np.maximum(rest.sum(1, keepdims=True), 1e-300)


def build_trees(samples: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees from training texts by language."""
    languages = sorted(samples)
    joined = b"".join(b"".join(x) for x in samples.values())
    used = np.unique(np.frombuffer(joined + b"\n", np.uint8))
    alphabet = np.zeros(256, np.uint8)
    alphabet[used] = np.arange(1, len(used) + 1)
    s = len(used) + 1
    trees = []
    for language in languages:
        keys: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
        for text in samples[language]:
            ids = np.concatenate([np.full(ORDER, alphabet[10], np.int64), alphabet[np.frombuffer(text, np.uint8)].astype(np.int64)])
            key = np.zeros(len(ids) - ORDER, np.int64)
            for order in range(ORDER + 1):
                # context of `order` symbols before each byte, then the byte itself
                key = ids[ORDER:].copy() if order == 0 else key + ids[ORDER - order : len(ids) - order] * s**order
                keys[order].append(key)
        trees.append([np.unique(np.concatenate(x), return_counts=True) for x in keys])
    state, bits = _flatten(trees, s, 256 - len(used))
    return ContextTrees(languages, alphabet, s, state, bits)


def _level(lengths: list[int], budget: int) -> int:
    """The length to which texts are cut so that all together have at most ``budget`` bytes."""
    left, rest = budget, sorted(lengths)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > left:
            return left // (len(rest) - i)
        left -= n
    return max(rest, default=0)


def fit_languages(documents: DataFrame, lang: str = "lang", learn: Column | None = None, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Trees from the rows of ``documents`` (document_id, text, ``lang``) with a language, and where ``learn`` holds.

    The sample is bounded by ``train_rows`` and ``train_bytes`` per language: the rows of the smallest id hashes. Where
    their bytes are more than ``train_bytes``, the longest texts are cut to one length that fits, the shorter ones stay
    whole. Every language is learnt; more than ``TRAIN_LANGUAGES`` raise an error. Returns None when no row can be learnt
    from.
    """
    known = documents if learn is None else documents.where(learn)
    known = texts(known.where(F.col(lang).isNotNull() & F.col("document_id").isNotNull()), F.col(lang).alias("lang"))
    names = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(TRAIN_LANGUAGES + 1).collect()]
    if len(names) > TRAIN_LANGUAGES:
        raise ValueError(f"more than {TRAIN_LANGUAGES} languages")
    picked = None
    for name in names:
        ids = first_by_hash(known.where(F.col("lang") == name).select("document_id").distinct(), "document_id", train_rows, seed=5).withColumn("lang", F.lit(name))
        picked = ids if picked is None else picked.unionByName(ids)
    if picked is None:
        return None
    # At most train_rows ids a language, hence the broadcast, and their lengths on the driver.
    rows = known.join(F.broadcast(picked), ["document_id", "lang"])
    lengths: dict[str, list[int]] = {}
    for row in rows.select("lang", F.octet_length("text").alias("n")).toLocalIterator():
        lengths.setdefault(row.lang, []).append(row.n)
    levels = [(lang, _level(n, train_bytes)) for lang, n in lengths.items()]
    cuts = F.broadcast(documents.sparkSession.createDataFrame(levels, "lang string, level int"))  # at most TRAIN_LANGUAGES rows
    heads = rows.join(cuts, "lang").select("lang", F.xxhash64("document_id").alias("_h"), "document_id", F.expr("substring(encode(text, 'UTF-8'), 1, level)").alias("head"))
    samples: dict[str, list[bytes]] = {}
    for row in heads.orderBy("lang", "_h", "document_id", "head").select("lang", "head").toLocalIterator():
        samples.setdefault(row.lang, []).append(bytes(row["head"]).decode(errors="ignore").encode())
    samples = {k: v for k, v in samples.items() if any(v)}
    return build_trees(samples) if samples else None


def identify_language(documents: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """(document_id, lang_pred, score, bits_per_byte) of every document text.

    ``documents``: document_id, text (recognised text of a form document). The language of the shortest code wins, ties
    go to the first name; ``score`` is its posterior under equal priors. A null text, one without any letter, or no
    trees at all give ``und`` with score 0. Repeated rows stay.
    """
    schema = "document_id bigint, lang_pred string, score double, bits_per_byte double"
    ids = texts(documents, F.col("text").rlike("\\p{L}").alias("_letters")).withColumn("document_id", F.col("document_id").cast("bigint"))
    if trees is None:
        return ids.select("document_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    sent = documents.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sent.value.languages, object)
        for batch in byte_blocks(batches):
            t = Texts(batch.column(1))
            bits = sent.value.code_lengths(t)
            best = bits.argmin(1)
            least = bits[np.arange(t.rows), best]
            posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            letters = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            size = np.maximum(np.diff(t.at), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, posterior, 0.0)), pa.array(least / size)],
                names=["document_id", "lang_pred", "score", "bits_per_byte"],
            )

    return ids.mapInArrow(score, schema)
