"""Centroid clustering (operator 11) against plain k-means in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from boxledger.llm import centroids
from tests.llm.forms import with_clashes

SCHEMA = "object_id bigint, features array<double>"


def plain(rows: list[tuple], dimensions: int, clusters: int, rounds: int, scale: int = 1024, seed: int = 3) -> list[tuple]:
    kept = [(i, [math.floor(max(-(2.0**27), min(2.0**27, scale * x))) for x in f]) for i, f in rows if f is not None and len(f) == dimensions and all(x is not None and math.isfinite(x) for x in f)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [f for _, f in order[:clusters]]

    def assign():
        out = []
        for i, f in kept:
            d = [sum((a - b) ** 2 for a, b in zip(f, c, strict=True)) for c in cents]
            out.append((i, f, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(cents)):
            own = [f for _, f, k, _ in now if k == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    now = assign()
    sums = {c: sum(d for _, _, k, d in now if k == c) for c in range(len(cents))}
    return sorted(((i, k, d, sums[k], sum(sums.values()), cents[k]) for i, _, k, d in now), key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def page_objects(rng: random.Random, n: int) -> list[tuple]:
    """Rects (x, y, w, h) of form objects: cells, panels and rules, some on several pages alike."""
    kinds = [(0.1, 0.2, 0.2, 0.03), (0.5, 0.2, 0.2, 0.03), (0.05, 0.05, 0.9, 0.6), (0.1, 0.7, 0.8, 0.01)]
    return [(i, [rng.gauss(v, 0.03) for v in rng.choice(kinds)]) for i in range(n)]


def test_page_objects_fall_into_the_clusters_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 37)
    rows = page_objects(random.Random(11), 400)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a hot group of copies
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(5), "block", "cluster", "vectors", "ids")
    for clusters in (1, 5):
        assert found(centroids.cluster_objects(df, dimensions=4, clusters=clusters, rounds=6)) == plain(rows, 4, clusters, 6)


def test_odd_rows_ties_and_large_numbers(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 0.0]), (10, [float("inf"), 0.0]), (11, [-1e300, 3e7]), (12, [0.0, -0.0004])]
    df = spark.createDataFrame(rows, SCHEMA)
    for clusters in (2, 3, 20):
        assert found(centroids.cluster_objects(df, dimensions=2, clusters=clusters, rounds=4)) == plain(rows, 2, clusters, 4)
    none = centroids.cluster_objects(df.where("false"), dimensions=2)
    assert none.count() == 0 and none.columns == ["object_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_heaps_measure_few_vectors_and_settle_like_a_full_pass():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 300, (3000, 8)).astype(np.int32) + rng.integers(0, 6, 3000)[:, None].astype(np.int32) * 900
    cents = x[rng.choice(3000, 6, replace=False)].astype(np.int64)
    heaps, drift, totals, measured = centroids.Heaps(6), np.zeros(6), np.zeros((6, 9), np.int64), []
    for r in range(12):
        gains, n = centroids.settle(x, heaps, cents, drift, r == 0)
        totals += gains
        measured.append(n)
        nearest = centroids.distances(x, cents).argmin(1)
        for c in range(6):
            assert sorted(heaps.vectors[c].tolist()) == np.flatnonzero(nearest == c).tolist()
            assert (np.diff(heaps.marks[c]) >= 0).all()
            assert totals[c].tolist() == [(nearest == c).sum(), *x[nearest == c].sum(0)]
        new = np.where(totals[:, :1] > 0, totals[:, 1:] // np.maximum(totals[:, :1], 1), cents)
        moves = np.sqrt(((new - cents) ** 2).sum(1))
        drift = drift + moves + [np.delete(moves, c).max() for c in range(6)]
        cents = new
    assert measured[0] == 3000 and sum(measured[6:]) < 3000


def test_distances_are_exact_beyond_floating_point():
    x = np.array([[2**27, -(2**27)], [2**27 - 1, 5]], np.int32)
    c = np.array([[-(2**27), 2**27], [1, 2]], np.int64)
    assert centroids.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
