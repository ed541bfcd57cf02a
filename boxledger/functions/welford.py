"""Mergeable count/weight/mean/m2 states (F-6..F-8) as aggregate columns.

All of them combine map-side, so a group of any size is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "struct<count:bigint,total_weight:double,mean:double,m2:double>"


def state(count: Column, weight: Column, mean: Column, m2: Column) -> Column:
    return F.struct(
        count.cast("long").alias("count"), weight.cast("double").alias("total_weight"), mean.cast("double").alias("mean"), m2.cast("double").alias("m2")
    )


def empty() -> Column:
    zero = F.lit(0.0)
    return state(F.lit(0), zero, zero, zero)


def welford_agg(value: Column, weight: Column | None = None, where: Column | None = None) -> Column:
    """F-6: state over a group; non-finite values and weights of at most zero are ignored.

    Unweighted spread uses Spark's own merging central moment.
    """
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    if where is not None:
        good = good & F.coalesce(where, F.lit(False))
    if weight is None:
        x = F.when(good, value)
        n = F.count(x)
        zero = F.lit(0.0)
        return F.when(n == 0, empty()).otherwise(state(n, n, F.coalesce(F.avg(x), zero), F.coalesce(F.var_pop(x) * n, zero)))
    good = good & (weight > 0) & (F.abs(weight) != F.lit(float("inf")))
    x, w = F.when(good, value), F.when(good, weight)
    total = F.sum(w)
    mean = F.sum(w * x) / total
    m2 = F.greatest(F.lit(0.0), F.sum(w * x * x) - mean * F.sum(w * x))
    return F.when(F.count(x) == 0, empty()).otherwise(state(F.count(x), total, mean, m2))


def welford_merge(s: Column) -> Column:
    """F-7: N-way merge of states; empty states change nothing."""
    n, w = F.sum(s["count"]), F.sum(s["total_weight"])
    mean = F.sum(s["total_weight"] * s["mean"]) / w
    m2 = F.sum(s["m2"] + s["total_weight"] * s["mean"] * s["mean"]) - w * mean * mean
    return F.when(F.coalesce(w, F.lit(0.0)) > 0, state(n, w, mean, F.greatest(F.lit(0.0), m2))).otherwise(empty())


def welford_struct(value: Column, parts: tuple[str, ...], where: Column | None = None) -> Column:
    """F-8: one state per component of a struct (affine, rect, ratios)."""
    return F.struct(*[welford_agg(value[p], where=where).alias(p) for p in parts])


def merge_struct(s: Column, parts: tuple[str, ...]) -> Column:
    """F-8: component-wise merge."""
    return F.struct(*[welford_merge(s[p]).alias(p) for p in parts])


def empty_struct(parts: tuple[str, ...]) -> Column:
    return F.struct(*[empty().alias(p) for p in parts])
