"""Grid joins inside a page.

A plain self join on the page key emits every pair of a page, which is quadratic for a crowded
one. Here a rect is put into the few cells of the power-of-two grid that fits its longer side,
and a point looks up one cell per grid level, so only neighbours meet and a hot page spreads
over many join keys. Pairs meet at most once. Pages of few rows need no grid (``crowds``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxledger.session import cut

# Exponents of the cell sides for boxes in page units and in pixels.
NORM_LEVELS = (-10, 0)
PIXEL_LEVELS = (0, 12)


CROWD = 256  # rows of a page up to which all of them meet on the page key: any number gives the same pairs


def crowds(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more than ``CROWD`` rows, None if there are none.

    The others meet on their keys alone: that moves a row once, where a grid moves it once for every cell and level, and a
    row meets at most ``CROWD`` others.
    """
    known = rows.select(*keys).dropna()
    many = cut(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select(*keys))
    return None if many.isEmpty() else many


def without_crowds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Marks rows of pages that were found small and dealt by ``keys``; a step that drops or changes some need not count and deal again."""
    rows._small_on = (CROWD, *keys)
    return rows


def known_small(rows: DataFrame, keys: list[str]) -> bool:
    return rows.__dict__.get("_small_on") == (CROWD, *keys)


def level_of(side: Column, levels: tuple[int, int]) -> Column:
    """Exponent of the smallest power-of-two cell at least as long as ``side``."""
    raw = F.ceil(F.log2(F.greatest(side, F.lit(2.0 ** levels[0]))))
    return F.least(F.lit(levels[1]), F.greatest(F.lit(levels[0]), raw)).cast("int")


def rect_level(r: Column, levels: tuple[int, int]) -> Column:
    return level_of(F.greatest(r["w"], r["h"]), levels)


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def stab_join(
    points: DataFrame,
    rects: DataFrame,
    keys: list[str],
    px: Column,
    py: Column,
    low: Column,
    high: Column,
    rect: Column,
    margin: float,
    levels: tuple[int, int],
) -> DataFrame:
    """Pairs (point row, rect row) of equal keys where the point may lie in the rect grown by
    ``margin``; points look at rect levels ``low..high``. Apart from ``keys`` the two tables must
    not share column names. The exact predicate is left to the caller.
    """
    lo = F.greatest(F.lit(levels[0]), low)
    hi = F.greatest(lo, F.least(F.lit(levels[1]), high))
    probe = points.withColumn("_lv", F.explode(F.sequence(lo, hi)))
    probe = probe.withColumn("_cx", _cell(px, F.col("_lv"))).withColumn("_cy", _cell(py, F.col("_lv")))
    m = F.lit(float(margin))
    placed = rects.withColumn("_lv", rect_level(rect, levels))
    lv = F.col("_lv")
    placed = placed.withColumn(
        "_cx", F.explode(F.sequence(_cell(rect["x"] - m, lv), _cell(rect["x"] + rect["w"] + m, lv)))
    ).withColumn("_cy", F.explode(F.sequence(_cell(rect["y"] - m, lv), _cell(rect["y"] + rect["h"] + m, lv))))
    return probe.join(placed, keys + ["_lv", "_cx", "_cy"]).drop("_lv", "_cx", "_cy")


def containment_pairs(inner: DataFrame, outer: DataFrame, keys: list[str], ri: Column, ro: Column, eps: float,
                      levels: tuple[int, int] = NORM_LEVELS) -> DataFrame:
    """Candidate pairs for "outer contains inner (up to eps)": an outer box is at least as large."""
    return stab_join(
        inner, outer, keys, ri["x"] + ri["w"] / 2, ri["y"] + ri["h"] / 2,
        level_of(F.greatest(ri["w"], ri["h"]) - F.lit(2 * eps + 1e-9), levels), F.lit(levels[1]), ro, eps, levels,
    )


def lookalike_pairs(a: DataFrame, b: DataFrame, keys: list[str], ra: Column, rb: Column,
                    levels: tuple[int, int] = NORM_LEVELS) -> DataFrame:
    """Candidate pairs for IoU above one half: the centre of one lies in the other and the longer
    sides differ by less than a factor of two."""
    lv = rect_level(ra, levels)
    return stab_join(a, b, keys, ra["x"] + ra["w"] / 2, ra["y"] + ra["h"] / 2, lv - 1, lv + 1, rb, 0.0, levels)
