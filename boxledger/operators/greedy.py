"""Order-dependent selections as data-parallel rounds.

"Scan in order, keep a row unless an earlier kept row conflicts" is decided here without ever
collecting a group: only conflicting pairs are materialised, and each round settles every row
whose earlier rivals are all settled. The number of rounds is the longest chain of conflicts,
not the group size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxledger.session import cut


def suppressed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, loser) that the greedy scan drops.

    ``edges``: keys, ``loser``, ``winner`` where winner precedes loser and conflicts with it.
    """
    pending = cut(edges.select(*keys, "loser", "winner").distinct())
    lost_parts = [pending.select(*keys, "loser").limit(0)]
    while not pending.isEmpty():
        open_rows = pending.select(*keys, F.col("loser").alias("winner")).distinct()
        lost = cut(pending.join(open_rows, keys + ["winner"], "left_anti").select(*keys, "loser").distinct())
        lost_parts.append(lost)
        gone = lost.withColumnRenamed("loser", "winner")
        pending = cut(pending.join(lost, keys + ["loser"], "left_anti").join(gone, keys + ["winner"], "left_anti"))
    return reduce(DataFrame.unionByName, lost_parts)


def by_score(left: str, right: str) -> Column:
    """Rank of a pair for both sides: higher score, then smaller ids."""
    return F.struct((-F.col("score")).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))


def one_to_one(
    pairs: DataFrame, keys: list[str], left: str, right: str, left_rank: Column | None = None, right_rank: Column | None = None
) -> DataFrame:
    """M-9: one-to-one assignment, each side used once.

    By default the sequential scan "best score first": every round takes all pairs that are the
    best of both their sides, which is what the scan would take, and removes their sides. With
    different ranks it is the scan over right-hand priority where each left side takes its best
    free partner. Best-of-side is an aggregate with map-side partials; no side is collected.
    """
    lr = by_score(left, right) if left_rank is None else left_rank
    rr = by_score(left, right) if right_rank is None else right_rank
    pending = cut(pairs)
    taken = []
    while not pending.isEmpty():
        by_left = pending.groupBy(*keys, left).agg(F.min_by(right, lr).alias(right))
        by_right = pending.groupBy(*keys, right).agg(F.min_by(left, rr).alias(left))
        mutual = by_left.join(by_right, keys + [left, right], "left_semi")
        won = cut(pending.join(mutual, keys + [left, right], "left_semi"))
        taken.append(won)
        pending = cut(
            pending.join(won.select(*keys, left), keys + [left], "left_anti").join(
                won.select(*keys, right), keys + [right], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, taken) if taken else pending
