"""Template to page matching (M-1..M-18).

Tables: ``tmpl`` (template_id, page_index, config_id, c rect, c_parent), ``rt`` (doc_id,
template_id, page_index, runtime_id, r rect, r_parent), ``tmpl_frames`` (template_id, page_index,
c_refined, c_cv, c_source), ``rt_frames`` (doc_id, page_index, r_refined, r_cv, r_source).

The template side is bounded by the form design; everything is linear in the runtime objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.boxes import PAGE, ancestors
from boxledger.operators.greedy import one_to_one
from boxledger.session import cut

TPL = ["template_id", "page_index"]

# Fixed values of the score.
SAME_DOCUMENT = {"position": 0.30, "size": 0.20, "aspect": 0.10, "parent": 0.25, "border": 0.15}
CROSS_DOCUMENT = {"position": 0.15, "size": 0.20, "aspect": 0.10, "parent": 0.25, "border": 0.30}
FLOOR_SIZE, FLOOR_ASPECT, FLOOR_PLACE = 0.5, 0.7, 0.55
MAX_DEPTH_GAP = 4
PRIORITY_BONUS = 0.05
RECOVERY_RELAXATION = 0.05
AMBIGUITY_PENALTY = 0.85
FIELD_RECOVERY_IOU, FIELD_RECOVERY_CONFIDENCE = 0.5, 0.7


@dataclass(frozen=True)
class MatchOptions:
    """Thresholds of the passes. The two minima, the margins and the pool size are ours: their
    """

    min_hierarchical: float = 0.75
    min_global: float = 0.80
    ambiguity_margin: float = 0.02
    recovery_margin: float = 0.05
    weights: dict | None = None
    cross_document: bool = True


def candidates(tmpl: DataFrame, rt: DataFrame) -> DataFrame:
    """M-1: template objects beside runtime objects of the same page."""
    return rt.join(tmpl, TPL)


def with_frames(tmpl: DataFrame, rt: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their measures, before they meet: what only one side decides is worked out once for an object and
    moves with it, not with each of its pairs."""
    c = tmpl.join(tmpl_frames.select(*TPL, "c_refined"), TPL).withColumn("c_is", measures(F.col("c"), F.col("c_refined")))
    r = rt.join(rt_frames.select(*PAGE, "r_refined"), PAGE).withColumn("r_is", measures(F.col("r"), F.col("r_refined")))
    return c.drop("c_refined"), r.drop("r_refined")


def measures(rect: Column, frame: Column) -> Column:
    """Centre, aspect and place inside the refined border of an object; ``flat`` tells a border without a side."""
    tiny = R.lit(1e-6)
    return F.struct(
        R.center(rect).alias("center"), R.aspect(rect).alias("aspect"), R.relative(rect, frame).alias("place"),
        ((frame["w"] < tiny) | (frame["h"] < tiny)).alias("flat"),
    )


def position_score(c: Column, r: Column) -> Column:
    """M-2, of the centres."""
    dx, dy = c["x"] - r["x"], c["y"] - r["y"]
    return R.clamp01(R.lit(1) - F.sqrt(dx * dx + dy * dy) / R.lit(0.7))


def size_score(c: Column, r: Column) -> Column:
    """M-2."""
    return R.clamp01(R.lit(1) - R.size_delta(c, r))


def aspect_score(c: Column, r: Column) -> Column:
    """M-2, of the aspects."""
    return R.clamp01(F.least(c, r) / F.greatest(c, r, R.lit(1e-6)))


def border_score(c: Column, r: Column) -> Column:
    """M-3: drift of the place inside each side's refined border."""
    a, b = c["place"], r["place"]
    drift = reduce(lambda s, k: s + F.abs(a[k] - b[k]), "yhw", F.abs(a["x"] - b["x"])) / R.lit(4)
    return F.when(c["flat"] | r["flat"], R.lit(0)).otherwise(R.clamp01(R.lit(1) - drift))


def _components(c: Column, c_is: Column, r: Column, r_is: Column) -> dict[str, Column]:
    return {
        "s_position": position_score(c_is["center"], r_is["center"]),
        "s_size": size_score(c, r),
        "s_aspect": aspect_score(c_is["aspect"], r_is["aspect"]),
        "s_border": border_score(c_is, r_is),
    }


def sim_components(pairs: DataFrame) -> DataFrame:
    """M-2, M-3: s_position, s_size, s_aspect, s_border."""
    return pairs.withColumns(_components(*[F.col(k) for k in ("c", "c_is", "r", "r_is")]))


def similar_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs that pass the floors, with their components.

    The floors are tested inside the join. The components of the pairs that pass are spelled as a lambda, which Spark runs
    after it: together with whole rows they would make one generated method that is too long for the JVM to compile.
    """
    near = sim_components(pairs).where(passes_floors()).select(*pairs.columns)
    sides = F.array(F.struct("c", "c_is", "r", "r_is"))
    both = F.transform(sides, lambda p: F.struct(*[v.alias(k) for k, v in _components(p["c"], p["c_is"], p["r"], p["r_is"]).items()]))
    return near.withColumn("_s", both[0]).select(*pairs.columns, "_s.*")


def passes_floors() -> Column:
    """M-5."""
    return (
        (F.col("s_size") >= R.lit(FLOOR_SIZE))
        & (F.col("s_aspect") >= R.lit(FLOOR_ASPECT))
        & (F.greatest("s_position", "s_border") >= R.lit(FLOOR_PLACE))
    )


def floor_notes() -> Column:
    """M-5: why a pair was rejected."""

    def f3(c: str) -> Column:
        return F.format_string("%.3f", F.col(c))

    return F.array_compact(
        F.array(
            F.when(
                F.col("s_size") < R.lit(FLOOR_SIZE),
                F.concat(F.lit("size component "), f3("s_size"), F.lit(f" below floor {FLOOR_SIZE:.2f} — pair rejected as non-match")),
            ),
            F.when(
                F.col("s_aspect") < R.lit(FLOOR_ASPECT),
                F.concat(F.lit("aspect component "), f3("s_aspect"), F.lit(f" below floor {FLOOR_ASPECT:.2f} — pair rejected as non-match")),
            ),
            F.when(
                F.greatest("s_position", "s_border") < R.lit(FLOOR_PLACE),
                F.concat(
                    F.lit("neither position ("), f3("s_position"), F.lit(") nor refined-border-relation ("), f3("s_border"),
                    F.lit(f") cleared floor {FLOOR_PLACE:.2f} — pair rejected as non-match"),
                ),
            ),
        )
    )


def weighted_score(weights: dict, parent: Column) -> Column:
    """M-6."""
    total = (
        R.lit(weights["position"]) * F.col("s_position")
        + R.lit(weights["size"]) * F.col("s_size")
        + R.lit(weights["aspect"]) * F.col("s_aspect")
        + R.lit(weights["parent"]) * parent
        + R.lit(weights["border"]) * F.col("s_border")
    )
    return R.clamp01(total)


def option_weights(opts: MatchOptions) -> dict:
    return opts.weights or (CROSS_DOCUMENT if opts.cross_document else SAME_DOCUMENT)


def score(pairs: DataFrame, weights: dict) -> DataFrame:
    """M-5 + M-6 over pairs with components and ``s_parent``: 0 below a floor."""
    return pairs.withColumn(
        "score", F.when(passes_floors(), weighted_score(weights, F.col("s_parent"))).otherwise(R.lit(0))
    )


def basis_tags() -> Column:
    """M-7."""
    shape = (F.col("s_position") >= 0.5) | (F.col("s_size") >= 0.5) | (F.col("s_aspect") >= 0.5)
    return F.array_compact(
        F.array(
            F.when(shape, F.lit("object-similarity")),
            F.when(F.col("s_parent") > 0, F.lit("parent-chain")),
            F.when(F.col("s_border") >= 0.5, F.lit("refined-border-relation")),
        )
    )


def similarity_notes() -> Column:
    """M-7."""
    return F.array_compact(
        F.array(
            F.when(F.col("s_position") < 0.4, F.lit("center-of-mass differs noticeably")),
            F.when(F.col("s_size") < 0.4, F.lit("width/height differ noticeably")),
        )
    )


def parent_evidence(rt: DataFrame, anc_c: DataFrame, anc_r: DataFrame, matches: DataFrame) -> DataFrame:
    """M-4: adds ``parent_ev``, a map from config_id to the best evidence, to the rows of ``rt`` (PAGE, runtime_id, ...).

    ``anc_c``: TPL + config_id, ancestor_id, distance; ``anc_r``: PAGE + runtime_id, ancestor_id,
    distance; ``matches``: doc_id, template_id, page_index, config_id, runtime_id. Evidence is built
    from the matched ancestors downwards, an equi join on each side. A map holds template objects of one page only.
    """
    m = matches.select("doc_id", *TPL, F.col("config_id").alias("_ca"), F.col("runtime_id").alias("_ra"))
    below_c = anc_c.select(*TPL, "config_id", F.col("ancestor_id").alias("_ca"), F.col("distance").alias("_dc"))
    below_r = anc_r.select(*PAGE, "runtime_id", F.col("ancestor_id").alias("_ra"), F.col("distance").alias("_dr"))
    gap = F.abs(F.col("_dc") - F.col("_dr"))
    value = F.when(gap == 0, R.lit(1)).otherwise(R.clamp01(R.lit(1) - gap / F.greatest("_dc", "_dr")))
    place = [*PAGE, "runtime_id"]
    best = (
        m.join(below_c, TPL + ["_ca"])
        .join(below_r, PAGE + ["_ra"])
        .where((gap <= MAX_DEPTH_GAP) & F.col("config_id").isNotNull())
        .groupBy(*place, "config_id")
        .agg(F.max(value).alias("_ev"))
    )
    maps = best.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("config_id", "_ev"))).alias("parent_ev"))
    return rt.join(maps, place, "left")


def parent_chain(pairs: DataFrame) -> DataFrame:
    """M-4: adds ``s_parent`` to pairs whose runtime side went through ``parent_evidence``; nothing is moved for it."""
    c_root, r_root = F.col("c_parent").isNull(), F.col("r_parent").isNull()
    s = (
        F.when(c_root & r_root, R.lit(1))
        .when(c_root | r_root, R.lit(0))
        .otherwise(F.coalesce(F.element_at("parent_ev", F.col("config_id")), R.lit(0)))
    )
    return pairs.withColumn("s_parent", s).drop("parent_ev")


# ------------------------------------------------------------------ assignment
def _solve(scores: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-total assignment of a small non-negative matrix by shortest augmenting paths.

    Zero cells stand for pairs that must not match and are left out of the answer.
    """
    if scores.shape[0] > scores.shape[1]:
        return [(i, j) for j, i in _solve(scores.T)]
    cost = -scores
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = cost[start] - row_price[start] - col_price
        via = np.full(m, -1)
        settled = np.zeros(m, dtype=bool)
        while True:
            end = int(np.argmin(np.where(settled, np.inf, dist)))
            if owner[end] < 0:
                break
            settled[end] = True
            row = owner[end]
            reach = dist[end] + cost[row] - row_price[row] - col_price
            closer = ~settled & (reach < dist)
            dist[closer], via[closer] = reach[closer], end
        slack = dist[end] - dist[settled]
        row_price[owner[settled]] += slack
        col_price[settled] -= slack
        row_price[start] += dist[end]
        while via[end] >= 0:
            owner[end] = owner[via[end]]
            end = via[end]
        owner[end] = start
    return [(int(i), j) for j, i in enumerate(owner) if i >= 0 and scores[i, j] > 0]


def _codes(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of the ids in their sorted order."""
    coded = ids.combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)]


def _borders(t: pa.Table, group: list[str]) -> np.ndarray:
    """First rows of the groups, which lie in runs, and the number of rows."""
    fresh = np.ones(t.num_rows, bool)
    fresh[1:] = False
    for k in group:
        codes = t.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(fresh), t.num_rows)


def _solved(t: pa.Table, borders: np.ndarray) -> pa.Table:
    left, right, scores = _codes(t.column("config_id")), _codes(t.column("runtime_id")), t.column("score").to_numpy()
    keep = np.zeros(t.num_rows, bool)
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        lu, li = np.unique(left[lo:hi], return_inverse=True)
        ru, ri = np.unique(right[lo:hi], return_inverse=True)
        grid = np.zeros((len(lu), len(ru)))
        grid[li, ri] = scores[lo:hi]
        chosen = np.zeros(grid.shape, bool)
        for i, j in _solve(grid):
            chosen[i, j] = True
        keep[lo:hi] = chosen[li, ri]
    return t.filter(pa.array(keep))


def _solve_groups(group: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves groups whose rows lie side by side in a stream; only the group that may go on in the next batch is held."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if t.num_rows:
            borders = _borders(t, group)
            rest = t.slice(borders[-2])
            yield from _solved(t.slice(0, borders[-2]), borders[:-1]).to_batches() if len(borders) > 2 else []
    if rest is not None and rest.num_rows:
        yield from _solved(rest, np.array([0, rest.num_rows])).to_batches()


def _good_enough(pairs: DataFrame, cols: list[str], min_score: float) -> DataFrame:
    """The pairs that may be assigned, from written scores: tested where the scores are made, Spark would make them twice."""
    return cut(pairs.select(*cols)).where((F.col("score") > 0) & (F.col("score") >= R.lit(min_score)))


def assign_optimal(pairs: DataFrame, group: list[str], min_score: float) -> DataFrame:
    """M-10: one-to-one pairs of maximum total ``score`` per group.

    In an optimum a template object never needs more than its best T partners, T being the
    number of template objects in the group: the others can occupy at most T - 1 of them. So each
    group shrinks to at most T² pairs before it reaches the solver, however many runtime objects a
    page has, and nothing is lost. The pairs are written, as they are read twice. The solver takes batches of many
    groups, whose rows lie side by side, as a call for each would cost more than the solution.
    """
    cols = [*group, "config_id", "runtime_id", "score"]
    ok = _good_enough(pairs, cols, min_score)
    t = ok.groupBy(*group).agg(F.count_distinct("config_id").alias("_t"))
    w = Window.partitionBy(*group, "config_id").orderBy(F.col("score").desc(), "runtime_id")
    slim = (
        ok.withColumn("_n", F.row_number().over(w))
        .join(t, group)
        .where(F.col("_n") <= F.col("_t"))
        .select(*cols)
    )
    groups = slim.groupBy(*group).agg(F.collect_list(F.struct("config_id", "runtime_id", "score")).alias("_pairs"))
    return groups.select(*group, F.inline("_pairs")).mapInArrow(partial(_solve_groups, group), slim.schema)


def assign_greedy(pairs: DataFrame, group: list[str], min_score: float) -> DataFrame:
    """M-9: highest score first, each side used once."""
    ok = _good_enough(pairs, [*group, "config_id", "runtime_id", "score"], min_score)
    return one_to_one(ok, group, "config_id", "runtime_id")


def assign(pairs: DataFrame, group: list[str], min_score: float) -> DataFrame:
    """M-10 for every group, whatever its size.

    Where the best partners of all template objects of a group differ, they are the optimum, so the common case is one
    aggregate; only contested groups go to the solver.
    """
    good = _good_enough(pairs, [*group, "config_id", "runtime_id", "score"], min_score)
    best = good.groupBy(*group, "config_id").agg(
        F.min_by(F.struct("runtime_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("runtime_id"))).alias("_b")
    ).select(*group, "config_id", "_b.runtime_id", "_b.score")
    contested = cut(best.groupBy(*group, "runtime_id").count().where(F.col("count") > 1).select(*group).distinct())
    easy = best.join(contested, group, "left_anti")
    hard = assign_optimal(good.join(contested, group, "left_semi"), group, min_score)
    return easy.unionByName(hard.select(*easy.columns))


def priority_ids(anchors: DataFrame) -> DataFrame:
    """M-11: template objects that are a primary or secondary anchor of some field."""
    return (
        anchors.where(F.col("rank").isin("primary", "secondary"))
        .select(*TPL, F.col("object_id").alias("config_id"), F.lit(True).alias("priority"))
        .distinct()
    )


def _place(n: int, value: Column, keys: list[str], order: list[Column]) -> Column:
    """``value`` of the n-th row of the group."""
    return F.nth_value(value, n).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def rivals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Best other partner per template object: every pair gets ``rival_id`` and ``rival_score``.

    The pairs of a template object on a page lie together once, in order, and learn its two best partners there.
    """
    partner = F.when(F.col("score") > 0, F.struct("runtime_id", "score"))
    own, order = [*keys, "config_id"], [F.col("score").desc(), F.col("runtime_id")]
    t = pairs.withColumns({"_first": _place(1, partner, own, order), "_second": _place(2, partner, own, order)})
    other = F.when(F.col("_first.runtime_id") == F.col("runtime_id"), F.col("_second")).otherwise(F.col("_first"))
    return t.withColumn("_o", other).withColumns(
        {"rival_id": F.col("_o.runtime_id"), "rival_score": F.col("_o.score")}
    ).drop("_first", "_second", "_o")


def flag_ambiguous(matches: DataFrame, margin: float) -> DataFrame:
    """M-12: a rival within the margin lowers the confidence and leaves a warning naming both."""
    close = F.col("rival_id").isNotNull() & (F.abs(F.col("score") - F.col("rival_score")) < R.lit(margin))
    warning = F.concat(
        F.lit("ambiguous match for "), "config_id", F.lit(": "), "runtime_id", F.lit(" ("), F.format_string("%.3f", "score"),
        F.lit(") vs "), "rival_id", F.lit(" ("), F.format_string("%.3f", "rival_score"), F.lit(")"),
    )
    return matches.withColumns(
        {
            "confidence": F.when(close, F.col("score") * R.lit(AMBIGUITY_PENALTY)).otherwise(F.col("score")),
            "warnings": F.when(close, F.array(warning)).otherwise(F.array().cast("array<string>")),
        }
    )


def match_affine(c: Column, r: Column) -> Column:
    """M-14."""
    return R.affine_from_rects(c, r)


MATCH_COLUMNS = [
    "doc_id", "template_id", "page_index", "config_id", "runtime_id", "score", "confidence", "basis", "affine", "notes", "warnings", "pass",
]


def _finish(chosen: DataFrame, scored: DataFrame, opts: MatchOptions, name: str, note: Column | None = None) -> DataFrame:
    """Assigned pairs with raw score, rival check, tags and affine."""
    picked = chosen.select(*PAGE, "config_id", "runtime_id")
    full = rivals(scored, PAGE).join(picked, PAGE + ["config_id", "runtime_id"], "left_semi")
    out = flag_ambiguous(full, opts.ambiguity_margin)
    notes = similarity_notes() if note is None else F.concat(similarity_notes(), F.array(note))
    return out.select(
        "doc_id", "template_id", "page_index", "config_id", "runtime_id", "score", "confidence", basis_tags().alias("basis"),
        match_affine(F.col("c"), F.col("r")).alias("affine"), notes.alias("notes"), "warnings", F.lit(name).alias("pass"),
    )


def _free(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    return pairs.join(matches.select(*PAGE, "config_id"), PAGE + ["config_id"], "left_anti").join(
        matches.select(*PAGE, "runtime_id"), PAGE + ["runtime_id"], "left_anti"
    )


def match_pages(
    tmpl: DataFrame, rt: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame, opts: MatchOptions = MatchOptions(),
    priority: DataFrame | None = None,
) -> DataFrame:
    """M-8: all passes; one row per matched pair.

    Roots with roots, then children under matched parents level by level (as many rounds as the
    template is deep), then everything left with graded parent evidence, then the recovery pass.
    Pairs below a floor can never match, so they are dropped once, before the first pass.
    """
    weights = option_weights(opts)
    base = similar_pairs(candidates(*with_frames(tmpl, rt, tmpl_frames, rt_frames)))
    bonus = R.lit(0)
    if priority is not None:
        base = base.join(priority, TPL + ["config_id"], "left")
        bonus = F.when(F.col("priority"), R.lit(PRIORITY_BONUS)).otherwise(R.lit(0))
    base = cut(base.withColumn("bonus", bonus).drop("c_is", "r_is"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", weighted_score(weights, F.col("s_parent")))

    def chosen(pairs: DataFrame, group: list[str], threshold: float) -> DataFrame:
        # The bonus helps a pair in the contest; whether it is good enough is decided without it.
        ranked = pairs.where(F.col("score") >= R.lit(threshold)).withColumn("score", F.col("score") + F.col("bonus"))
        return assign(ranked, group, threshold)

    roots = scored(base.where(F.col("c_parent").isNull() & F.col("r_parent").isNull()).withColumn("s_parent", R.lit(1)))
    level = cut(_finish(chosen(roots, PAGE, opts.min_hierarchical), roots, opts, "hierarchy"))
    found = [level]
    while not level.isEmpty():
        parents = level.select(*PAGE, F.col("config_id").alias("c_parent"), F.col("runtime_id").alias("r_parent"))
        kids = scored(base.join(parents, PAGE + ["c_parent", "r_parent"]).withColumn("s_parent", R.lit(1)))
        level = cut(_finish(chosen(kids, PAGE + ["c_parent"], opts.min_hierarchical), kids, opts, "hierarchy"))
        found.append(level)
    matches = cut(reduce(DataFrame.unionByName, found))

    anc_c = ancestors(tmpl.select(*TPL, F.col("config_id").alias("object_id"), F.col("c_parent").alias("parent_id")), TPL)
    anc_r = ancestors(rt.select(*PAGE, F.col("runtime_id").alias("object_id"), F.col("r_parent").alias("parent_id")), PAGE)
    sides = anc_c.withColumnRenamed("object_id", "config_id"), anc_r.withColumnRenamed("object_id", "runtime_id")
    evidence = parent_evidence(rt.select(*PAGE, "runtime_id").distinct(), *sides, matches)
    rest = cut(scored(parent_chain(_free(base, matches).join(evidence, PAGE + ["runtime_id"], "left"))))
    glob = cut(_finish(chosen(rest, PAGE, opts.min_global), rest, opts, "global"))
    left = _free(rest, glob)
    matches = matches.unionByName(glob)
    return matches.unionByName(recover_pairs(left, opts))


def recover_pairs(left: DataFrame, opts: MatchOptions) -> DataFrame:
    """M-13: pairs slightly below the global minimum whose lead over every alternative is clear."""
    own, order = [*PAGE, "runtime_id"], [F.col("score").desc(), F.col("config_id")]
    t = rivals(left, PAGE).withColumns({"_r1": _place(1, F.col("score"), own, order), "_r2": _place(2, F.col("score"), own, order)})
    lead = R.lit(opts.recovery_margin)
    clear_c = F.col("rival_score").isNull() | (F.col("score") - F.col("rival_score") >= lead)
    clear_r = (F.col("score") >= F.col("_r1")) & (F.col("_r2").isNull() | (F.col("score") - F.col("_r2") >= lead))
    ok = t.where((F.col("score") >= R.lit(opts.min_global - RECOVERY_RELAXATION)) & clear_c & clear_r)
    note = F.concat(F.lit("recovery pass admitted "), "config_id", F.lit(" ↔ "), "runtime_id", F.lit(" at "), F.format_string("%.3f", "score"))
    out = flag_ambiguous(ok, opts.ambiguity_margin)
    return out.select(
        "doc_id", "template_id", "page_index", "config_id", "runtime_id", "score", "confidence", basis_tags().alias("basis"),
        match_affine(F.col("c"), F.col("r")).alias("affine"), F.concat(similarity_notes(), F.array(note)).alias("notes"),
        "warnings", F.lit("recovery").alias("pass"),
    )


def unmatched_config(tmpl: DataFrame, docs: DataFrame, matches: DataFrame) -> DataFrame:
    """M-15: template objects without partner per document page. ``docs``: doc_id, template_id, page_index."""
    all_c = docs.join(tmpl.select(*TPL, "config_id"), TPL)
    return all_c.join(matches.select(*PAGE, "config_id"), PAGE + ["config_id"], "left_anti")


def unmatched_runtime(rt: DataFrame, matches: DataFrame) -> DataFrame:
    """M-15: runtime objects without partner."""
    return rt.select("doc_id", "template_id", "page_index", "runtime_id").join(
        matches.select(*PAGE, "runtime_id"), PAGE + ["runtime_id"], "left_anti"
    )


def recover_anchors(anchors: DataFrame, tmpl: DataFrame, free_runtime: DataFrame, matches: DataFrame, consensus: DataFrame) -> DataFrame:
    """M-16: unmatched anchors take the free runtime object that best covers their consensus place.

    ``anchors``: TPL + field_ord, pos, object_id. ``free_runtime``: doc_id, template_id, page_index,
    runtime_id, r. Anchors choose in field and rank order, which is the scan of
    :func:`boxledger.operators.greedy.one_to_one` with anchor order as right-hand priority.
    """
    first = anchors.groupBy(*TPL, F.col("object_id").alias("config_id")).agg(
        F.min(F.struct("field_ord", "pos")).alias("turn")
    )
    want = first.join(tmpl.select(*TPL, "config_id", "c"), TPL + ["config_id"])
    pages = consensus.where(F.col("affine").isNotNull()).select("doc_id", *TPL, F.col("affine").alias("_a"))
    open_anchors = pages.join(want, TPL).join(
        matches.select(*PAGE, "config_id"), PAGE + ["config_id"], "left_anti"
    )
    pairs = open_anchors.join(free_runtime.select(*PAGE, "runtime_id", "r"), PAGE)
    iou = R.iou_transform(R.apply_affine(F.col("c"), F.col("_a")), F.col("r"))
    good = pairs.withColumn("score", iou).where(F.col("score") >= R.lit(FIELD_RECOVERY_IOU))
    won = one_to_one(
        good, PAGE, "config_id", "runtime_id",
        left_rank=F.struct((-F.col("score")).alias("s"), F.col("runtime_id")), right_rank=F.struct("turn", "config_id"),
    )
    return won.select(
        "doc_id", "template_id", "page_index", "config_id", "runtime_id", "score",
        R.lit(FIELD_RECOVERY_CONFIDENCE).alias("confidence"), F.array(F.lit("field-recovery")).alias("basis"),
        match_affine(F.col("c"), F.col("r")).alias("affine"),
        F.array(F.concat(F.lit("recovered via consensus-projected location; IoU "), F.format_string("%.2f", "score"))).alias("notes"),
        F.array().cast("array<string>").alias("warnings"), F.lit("field-recovery").alias("pass"),
    )


def page_coverage(tmpl_pages: DataFrame, rt_pages: DataFrame) -> DataFrame:
    """M-17: warnings for pages that exist on one side only.

    ``tmpl_pages``: template_id, page_index; ``rt_pages``: doc_id, template_id, page_index.
    """
    docs = rt_pages.select("doc_id", "template_id").distinct()
    want = docs.join(tmpl_pages.select(*TPL), "template_id").withColumn("_t", F.lit(True))
    have = rt_pages.select("doc_id", *TPL).withColumn("_r", F.lit(True))
    both = want.join(have, ["doc_id", *TPL], "full_outer").where(F.col("_t").isNull() | F.col("_r").isNull())
    page = F.col("page_index").cast("string")
    return both.select(
        "doc_id", "template_id", "page_index",
        F.when(F.col("_r").isNull(), F.lit("page")).otherwise(F.lit("document")).alias("scope"),
        F.when(F.col("_r").isNull(), F.concat(F.lit("runtime model has no page with pageIndex "), page))
        .otherwise(F.concat(F.lit("runtime page "), page, F.lit(" has no matching page in the config model"))).alias("warning"),
    )


def empty_report(tmpl: DataFrame, rt: DataFrame, docs: DataFrame) -> DataFrame:
    """M-18: one row per template page and document, everything unmatched, no transform."""
    c = tmpl.groupBy(*TPL).agg(F.count(F.lit(1)).alias("n_unmatched_config"))
    r = rt.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_unmatched_runtime"))
    return (
        docs.select("doc_id", "template_id").distinct()
        .join(c, "template_id")
        .join(r, PAGE, "left")
        .select(
            "doc_id", *TPL, "n_unmatched_config", F.coalesce("n_unmatched_runtime", F.lit(0)).alias("n_unmatched_runtime"),
            F.lit(0).alias("n_matches"), F.lit(None).cast("struct<sx:double,sy:double,tx:double,ty:double>").alias("affine"),
            R.lit(0).alias("confidence"),
        )
    )
