"""Prefix trie of sequences (operator 13): balanced parentheses per shard, shared spines merged.

A sequence is a document's readings in order (or a conversation's turns); a node is a prefix that some sequence starts with.
Readings are reduced to 16-byte keys, sequences sorted by their keys and dealt to shards by range, so every shard holds a
stretch of the trie in depth-first order. A shard writes its stretch as balanced parentheses: from one sequence to the next
the brackets below their common prefix close and those of the new nodes open. Over the excess of open brackets lie blocks
with their least excess (and least of blocks of blocks): ``findclose`` skips blocks that stay above a node and so delimits
its subtree. The rank of "()" pairs counts leaves, and cumulative sums over opening brackets give members and savings.

Prefixes of a shard's first and last sequence that the neighbouring shard has too are the shared spine, a few nodes a shard.
A node's own share (its text, its being a child or a leaf) is counted in the first shard that has it, everything else adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.llm.common import cut, partitions
from boxledger.session import settled

SHARD_STEPS = 200_000  # readings of a shard, about
CHUNK = 4096  # ids of a chunk that goes into a digest
BLOCK = 64  # brackets of a block, and blocks of a block of blocks
SMALL_SPINE = 200_000  # nodes of a merged spine that are sent to every task

NODE = ["document_id", "depth", "parent_document_id", "n_documents", "n_children", "n_leaves", "saved_chars", "ends_sha256"]
# A shard's nodes; those of the spine have its name and shares that add up. Rows with a chunk are ids that end at a spine node.
PART = pa.schema(
    [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in NODE]
    + [("spine", pa.binary()), ("parent_spine", pa.binary()), ("held", pa.int64()), ("owned", pa.int64()), ("first_id", pa.int64()), ("chunk", pa.binary())]
)
PART_DDL = ", ".join(f"{f.name} { {'int64': 'bigint'}.get(str(f.type), str(f.type))}" for f in PART)


class Parentheses:
    """Balanced parentheses with range min-max blocks over their excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        self.levels = [self.excess]
        while len(self.levels[-1]) > BLOCK:
            below = self.levels[-1]
            padded = np.append(below, np.full(-len(below) % BLOCK, np.iinfo(np.int64).max))
            self.levels.append(padded.reshape(-1, BLOCK).min(1))
        leaf = opens.copy()
        leaf[:-1] &= ~opens[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(leaf)])

    def _next_at_most(self, level: int, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First places from ``start`` on, at a level, whose least excess is at most ``bound``; there is one."""
        values = self.levels[level]
        end = np.minimum((start // BLOCK + 1) * BLOCK, len(values))  # of the own block
        out = np.full(len(start), -1)
        for at in range(0, len(start), 20_000):
            own = slice(at, at + 20_000)
            place = start[own, None] + np.arange(BLOCK)
            hit = (place < end[own, None]) & (values[np.minimum(place, len(values) - 1)] <= bound[own, None])
            out[own] = np.where(hit.any(1), start[own] + hit.argmax(1), -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            block = self._next_at_most(level + 1, end[rest] // BLOCK, bound[rest])
            out[rest] = self._next_at_most(level, block * BLOCK, bound[rest])
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the closing brackets of the opening ones ``at``."""
        return self._next_at_most(0, at + 1, self.excess[at] - 1)

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        return self.leaf_rank[close] - self.leaf_rank[at]


class RangeLeast:
    """Least value of stretches of an array, from doubling tables."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 ** len(self.tables) <= len(values):
            below, half = self.tables[-1], 2 ** (len(self.tables) - 1)
            self.tables.append(np.minimum(below[:-half], below[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.tables[k][low[own]], self.tables[k][high[own] - 2**k])
        return out


def common_prefixes(keys: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sequence with the one before it; 0 for the first."""
    sizes = np.diff(borders)
    out = np.zeros(len(sizes), np.int64)
    open_ = np.arange(1, len(sizes))
    depth = 0
    while len(open_):
        open_ = open_[(sizes[open_] > depth) & (sizes[open_ - 1] > depth)]
        same = (keys[borders[open_] + depth] == keys[borders[open_ - 1] + depth]).all(1)
        open_ = open_[same]
        depth += 1
        out[open_] = depth
    return out


def joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def shard_nodes(ids: np.ndarray, keys: np.ndarray, chars: np.ndarray, borders: np.ndarray, left: int, right: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PART`` for one shard of sequences sorted by keys, then id.

    ``left``: length of the prefix that the first sequence has in common with the last one of the shard before, ``right``:
    that of the last one with the first of the shard behind; -1 if there is no such shard.
    """
    sizes, shared = np.diff(borders), common_prefixes(keys, borders)
    # Nodes in depth-first order: the root, then what each sequence adds to the nodes of the one before.
    fresh = sizes - shared
    fresh[0] += 1
    base = np.cumsum(fresh) - fresh
    owner = np.repeat(np.arange(len(ids)), fresh)
    nodes = len(owner)
    number = np.arange(nodes)
    depth = number - base[owner] + shared[owner] + (owner > 0)
    at = number + np.concatenate([[0], np.cumsum(depth[:-1] - depth[1:] + 1)])  # brackets that close before a node opens
    opens = np.zeros(2 * nodes, bool)
    opens[at] = True
    tree = Parentheses(opens)
    close = tree.findclose(at)
    last = number + (close - at + 1) // 2  # the subtree of node i is [i, last[i])

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[last] - sums[number]

    end = np.maximum.accumulate(np.where(fresh > 0, base + fresh - 1, 0))  # node at which a sequence ends, ascending
    first_end, after_end = np.searchsorted(end, number), np.searchsorted(end, number, "right")
    members = total(after_end - first_end)
    least = RangeLeast(ids).least(first_end, np.searchsorted(end, last))
    text = np.zeros(nodes, np.int64)
    text[depth > 0] = chars[(borders[owner] + depth - 1)[depth > 0]]
    order = np.lexsort((number, depth))
    above = np.searchsorted(depth[order] * nodes + order, (depth - 1) * nodes + number) - 1
    parent = np.where(depth > 0, order[above], -1)

    line, i = [], int(end[-1])  # prefixes of the last sequence, of which the next shard has the first ones
    while i >= 0:
        line.append(i)
        i = int(parent[i])
    line.reverse()
    spine = {*range(max(left, 0) + 1), *line[: max(right, 0) + 1]}
    # A node's text and its being a child count in the first shard that has it, its being a leaf in the last one.
    fresh_here = np.ones(nodes, bool)
    fresh_here[: left + 1] = False
    children = np.bincount(parent[1:], weights=fresh_here[1:], minlength=nodes).astype(np.int64)
    leaves = tree.leaves(at, close)
    if right == len(line) - 1:
        leaves[line] -= 1
    held, owned = total(members * text), total(text * fresh_here)

    names = np.full(nodes + 1, None, object)  # the last one is the root's parent
    for path in (range(max(left, 0) + 1), line[: max(right, 0) + 1]):
        state = hashlib.blake2b(digest_size=16)
        for i in path:
            if depth[i]:
                state.update(keys[borders[owner[i]] + depth[i] - 1].tobytes())
            names[i] = state.digest()
    digests = np.full(nodes, hashlib.sha256(b"").hexdigest(), object)
    for i in np.flatnonzero(after_end > first_end):
        if i not in spine:
            digests[i] = hashlib.sha256(joined(ids[first_end[i] : after_end[i]])).hexdigest()
    above_id = pa.array(least[np.maximum(parent, 0)], mask=parent < 0)
    columns = [least, depth, above_id, members, children, leaves, held - owned, digests, names[:-1], names[parent], held, owned, None, None]
    table = pa.RecordBatch.from_arrays([pa.nulls(nodes, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, PART, strict=True)], schema=PART)
    for start in range(0, nodes, 20_000):
        yield table.slice(start, 20_000)
    for i in sorted(spine):
        for low in range(first_end[i], after_end[i], CHUNK):
            some = ids[low : min(low + CHUNK, after_end[i])]
            row = {"spine": names[i], "first_id": int(some[0]), "chunk": joined(some)}
            yield pa.RecordBatch.from_pylist([row], schema=PART)


def _fixed(values: pa.Array) -> np.ndarray:
    """16-byte binaries as rows of two integers."""
    if not len(values):  # an empty array may have no offsets
        return np.zeros((0, 2), np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    data = values.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]].view("<u8").reshape(-1, 2)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard_nodes`` of each shard in rows (shard, left, right, document_id, keys, chars) sorted by shard, keys and id."""

    def nodes(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [b.column("keys") for b in parts]
        sizes = np.concatenate([np.diff(k.offsets.to_numpy()) for k in keys])
        flat = np.concatenate([_fixed(k.flatten()) for k in keys])
        chars = np.concatenate([b.column("chars").flatten().to_numpy() for b in parts])
        ids = np.concatenate([b.column("document_id").to_numpy() for b in parts])
        yield from shard_nodes(ids, flat, chars, np.concatenate([[0], np.cumsum(sizes)]), parts[0].column("left")[0].as_py(), parts[0].column("right")[0].as_py())

    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for piece in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
            if len(piece):
                if held and held[-1].column("shard")[0].as_py() != shard[piece[0]]:
                    yield from nodes(held)
                    held = []
                held.append(batch.slice(piece[0], len(piece)))
    if held:
        yield from nodes(held)


def chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spine, ends_sha256) of rows (spine, chunk) sorted by spine and first id: a running hash, one chunk at a time."""
    name, state = None, hashlib.sha256()
    for batch in batches:
        for spine, chunk in zip(batch.column("spine").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if spine != name:
                if name is not None:
                    yield pa.RecordBatch.from_pydict({"spine": [name], "ends_sha256": [state.hexdigest()]})
                name, state = spine, hashlib.sha256(chunk)
            else:
                state.update(b"," + chunk)
    if name is not None:
        yield pa.RecordBatch.from_pydict({"spine": [name], "ends_sha256": [state.hexdigest()]})


def reading_sequences(readings: DataFrame) -> DataFrame:
    """(document_id, keys, chars): the readings of each document in order, as 16-byte keys and lengths in code points.

    ``readings``: document_id, position, field_id, text. Position null comes first, ties go by key. A null field_id or text
    counts as the empty one; rows without a document_id belong to no document. A document's sequence is one row.
    """
    field, text = F.coalesce("field_id", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(field).cast("string"), F.lit(":"), field, text)))
    step = F.struct(F.col("position").isNotNull().alias("placed"), "position", key.alias("key"), F.char_length(text).cast("bigint").alias("chars"))
    steps = readings.where(F.col("document_id").isNotNull()).groupBy(F.col("document_id").cast("bigint").alias("document_id")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return steps.select("document_id", F.col("steps.key").alias("keys"), F.col("steps.chars").alias("chars"))


def shared_heads(sequences: DataFrame, batch: int, heads: int) -> DataFrame:
    """The sequences with the head of their batch's first document in place of their own.

    The documents c of a batch have ids from ``c - c % batch``; h = crc32(c as text) % ``heads`` first steps are those of that
    document (all if it has fewer, none if it is absent), the rest c's own steps after its first h.
    """
    first = sequences.where(F.col("document_id") % batch == 0)
    first = first.select(F.col("document_id").alias("first_id"), F.slice("keys", 1, heads).alias("head_keys"), F.slice("chars", 1, heads).alias("head_chars"))
    h = F.pmod(F.crc32(F.col("document_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = sequences.withColumn("first_id", F.col("document_id") - F.col("document_id") % batch).withColumn("h", h)
    none = lambda name: F.coalesce(F.col(f"head_{name}"), F.slice(name, 1, 0))
    parts = lambda name: F.concat(F.slice(none(name), F.lit(1), F.col("h")), F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1))))
    return own.join(first, "first_id", "left").select("document_id", parts("keys").alias("keys"), parts("chars").alias("chars"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays, -1 where one is null."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(a.isNull() | b.isNull(), -1).when(differ == 0, n).otherwise(differ.cast("int") - 1)


def _parts(sequences: DataFrame) -> DataFrame:
    spark = sequences.sparkSession
    kept = cut(sequences.select("document_id", "keys", "chars"))
    steps = kept.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    shards = max(1, min(-(-steps // SHARD_STEPS), 100_000), min(partitions(spark), steps // 1000))
    dealt = cut(kept.repartitionByRange(shards, "keys", "document_id").withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min("keys").alias("low"), F.max("keys").alias("high"))  # a row for each shard
    order = Window.orderBy("shard")
    sides = ends.select("shard", _common(F.lag("high").over(order), F.col("low")).alias("left"), _common(F.col("high"), F.lead("low").over(order)).alias("right"))
    rows = dealt.join(F.broadcast(cut(sides)), "shard").select("shard", "left", "right", "document_id", "keys", "chars")
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "keys", "document_id").mapInArrow(shards_of, PART_DDL)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(document_id, depth, parent_document_id, n_documents, n_children, n_leaves, saved_chars, ends_sha256) of every node.

    ``sequences``: document_id, keys, chars, as ``reading_sequences`` gives them; one row for each document, empty arrays for
    a document without readings. A node is a prefix that a document starts with, from the empty one (depth 0); no documents
    give no node. ``document_id``: the smallest of its members, the documents that start with it; with ``depth`` it names the
    node. ``n_leaves``: nodes without children in its subtree, itself included. ``saved_chars``: over its subtree, what
    storing a node's last text once instead of for every member saves. ``ends_sha256``: hash of the comma-joined ascending ids
    of the documents that end here (a sequential hash: ids of a node that many end at stream through one task in chunks).
    """
    spark = sequences.sparkSession
    parts = settled(spark, lambda: _parts(sequences))
    shares = parts.where("spine IS NOT NULL AND chunk IS NULL").groupBy("spine").agg(
        *[F.min(c).alias(c) for c in ("document_id", "depth", "parent_spine")], *[F.sum(c).alias(c) for c in ("n_documents", "n_children", "n_leaves", "held", "owned")]
    )
    chunks = parts.where("chunk IS NOT NULL").select("spine", "first_id", "chunk").repartition("spine").sortWithinPartitions("spine", "first_id")
    digests = chunks.select("spine", "chunk").mapInArrow(chunk_digests, "spine binary, ends_sha256 string")
    merged = cut(shares.join(digests, "spine", "left"))
    above = merged.select(F.col("spine").alias("parent_spine"), F.col("document_id").alias("spine_parent"))
    above = F.broadcast(above) if merged.count() <= SMALL_SPINE else above
    saved = (F.col("held") - F.col("owned")).alias("saved_chars")
    none = F.sha2(F.lit(""), 256)
    on_spine = merged.select("document_id", "depth", F.lit(None).cast("bigint").alias("parent_document_id"), "n_documents", "n_children", "n_leaves", saved, F.coalesce("ends_sha256", none).alias("ends_sha256"), "parent_spine")
    nodes = parts.where("spine IS NULL").select(*NODE, "parent_spine").unionByName(on_spine)
    return nodes.join(above, "parent_spine", "left").withColumn("parent_document_id", F.coalesce("spine_parent", "parent_document_id")).select(*NODE)
