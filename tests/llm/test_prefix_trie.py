"""Prefix trie (operator 13) over form readings against nodes made of plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxledger.llm import prefix_trie
from tests.llm.forms import with_clashes

SCHEMA = "document_id bigint, position int, field_id string, text string"


def plain(docs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, steps in docs.items():
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        parts = [below(k) for k in kids.get(p, [])]
        return sum(x for x, _ in parts) or 1, own + sum(y for _, y in parts)

    out = []
    for p, m in members.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(m) if len(docs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(docs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    return [(c, i, f, t) for c, steps in docs.items() for i, (f, t) in enumerate(steps)]


def forms(rng: random.Random, n: int) -> dict[int, list[tuple[str, str]]]:
    """Documents whose readings share their first fields: issuer, kind, date, then totals."""
    docs = {c: [(f"f{k}", rng.choice(["paid", "due", "näh", ""])) for k in range(rng.randrange(1, 7))] for c in range(n)}
    hot = [("f0", "paid"), ("f1", "due"), ("f2", "open")]
    docs |= {c: hot for c in range(n, n + n // 2)}  # a group of copies with a third of all rows
    docs |= {n * 2 + k: hot + [("f3", f"{k}")] for k in range(5)}
    docs[-7] = [("f0", "x")] * 60
    return docs


@pytest.mark.parametrize("steps", [25, 400, 10**6])
def test_nodes_of_forms_in_any_number_of_shards(spark, monkeypatch, steps):
    monkeypatch.setattr(prefix_trie, "SHARD_STEPS", steps)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    docs = forms(random.Random(steps), 120)
    df = with_clashes(spark.createDataFrame(rows_of(docs), SCHEMA).repartition(3), "keys", "shard", "depth", "spine")
    assert found(prefix_trie.prefix_trie(prefix_trie.reading_sequences(df))) == plain(docs)


def test_spines_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_STEPS", 30)
    monkeypatch.setattr(prefix_trie, "SMALL_SPINE", 0)
    docs = forms(random.Random(1), 40)
    assert found(prefix_trie.prefix_trie(prefix_trie.reading_sequences(spark.createDataFrame(rows_of(docs), SCHEMA)))) == plain(docs)


def test_awkward_rows(spark):
    rows = [(1, 2, "b", "y"), (1, None, "a", None), (1, 0, None, "z"), (None, 0, "a", "q"), (2, 0, "a", ""), (2, 0, "a", ""), (3, None, "a", ""), (3, 0, "", "z"), (4, 0, "ab", "c"), (5, 0, "a", "bc"), (6, 0, "t", "w " * 300_000)]
    docs = {1: [("a", ""), ("", "z"), ("b", "y")], 2: [("a", ""), ("a", "")], 3: [("a", ""), ("", "z")], 4: [("ab", "c")], 5: [("a", "bc")], 6: [("t", "w " * 300_000)]}
    df = spark.createDataFrame(rows, SCHEMA)
    sequences = prefix_trie.reading_sequences(df)
    assert found(prefix_trie.prefix_trie(sequences)) == plain(docs)
    empty = spark.createDataFrame([(9,), (8,)], "document_id bigint").select("document_id", F.array().cast("array<binary>").alias("keys"), F.array().cast("array<bigint>").alias("chars"))
    assert found(prefix_trie.prefix_trie(empty)) == plain({8: [], 9: []})
    assert found(prefix_trie.prefix_trie(sequences.unionByName(empty))) == plain(docs | {8: [], 9: []})
    assert prefix_trie.prefix_trie(sequences.where("false")).count() == 0


def test_heads_of_a_batch(spark):
    rng = random.Random(3)
    docs = {c: [("f", f"{c} {k}") for k in range(rng.randrange(1, 9))] for c in [*range(95, 130), *range(203, 215), -150, -100, -230]}
    rebuilt = {}
    for c, steps in docs.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = docs.get(base, [])[:h] + steps[h:]
    sequences = prefix_trie.reading_sequences(spark.createDataFrame(rows_of(docs), SCHEMA))
    assert found(prefix_trie.prefix_trie(prefix_trie.shared_heads(sequences, batch=100, heads=6))) == plain(rebuilt)


def test_brackets_of_random_trees():
    rng = np.random.default_rng(2)
    for n in (1, 2, 70, 9000):
        depth = [0]
        for _ in range(n - 1):
            depth.append(int(rng.integers(1, depth[-1] + 2)))
        text = "".join("(" + ")" * (depth[i] - (depth[i + 1] if i + 1 < n else 0) + (1 if i + 1 < n else 1)) for i in range(n))
        opens = np.array([c == "(" for c in text])
        tree = prefix_trie.Parentheses(opens)
        at = np.flatnonzero(opens)
        stack, want, leaves = [], {}, {}
        for i, c in enumerate(text):
            if c == "(":
                stack.append(i)
            else:
                want[stack.pop()] = i
        close = tree.findclose(at)
        assert close.tolist() == [want[i] for i in at]
        leaves = [text[i : want[i] + 1].count("()") for i in at]
        assert tree.leaves(at, close).tolist() == leaves
