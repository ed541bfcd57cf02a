"""Page-level consensus by maximum-inlier search (C-1..C-13).

``matches``: doc_id, template_id, page_index, config_id, runtime_id, confidence, basis, affine,
and the rects c and r. Affines that may agree meet in the cells of a four-dimensional grid, whose
sides are a few tolerances long, so a crowded page spreads over many join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.boxes import PAGE
from boxledger.operators.greedy import suppressed
from boxledger.operators.matching import TPL
from boxledger.session import cut

SCALE_TOLERANCE, TRANSLATE_TOLERANCE = 0.1, 0.06
MIN_MATCHES = 1
FRAME_CONFIDENCE = {"full-page-fallback": 0.4, "bbox-union": 0.7}
FRAME_CONFIDENCE_DEFAULT = 0.95
# Sums of weights decide ties between seeds; rounding removes the order of addition.
TIE_DECIMALS = 9
KEYS = ["doc_id", *TPL]


def weigh(matches: DataFrame, tmpl: DataFrame, rt: DataFrame) -> DataFrame:
    """C-1: squared confidence as weight; only matches whose objects exist on both sides."""
    c = tmpl.select(*TPL, "config_id", "c")
    r = rt.select(*PAGE, "runtime_id", "r")
    base = matches.drop("c", "r").join(c, TPL + ["config_id"]).join(r, PAGE + ["runtime_id"])
    return with_weight(base)


def with_weight(matches: DataFrame) -> DataFrame:
    return matches.withColumn("weight", F.greatest(R.lit(1e-6), F.col("confidence") * F.col("confidence")))


def _agrees(a: Column, b: Column, scale_tol: float, translate_tol: float) -> Column:
    return (R.scale_delta(a, b) <= R.lit(scale_tol)) & (R.translate_delta(a, b) <= R.lit(translate_tol))


# Cell side in tolerances: any value gives the same pairs. A side of four lets a seed look into 1.5 cells per dimension.
CELL = 4


def agreeing(left: DataFrame, right: DataFrame, la: str, ra: str, keys: list[str], scale_tol: float, translate_tol: float) -> DataFrame:
    """Pairs of rows of equal keys whose affines ``la`` and ``ra`` agree within the tolerances.

    A right row lies in one cell of the grid over (sx, sy, tx, ty); a left row looks into the cells that its tolerance box
    touches, one or two per dimension. Apart from ``keys`` the tables must not share column names.
    """
    cells = []
    for k, tol in (("sx", scale_tol), ("sy", scale_tol), ("tx", translate_tol), ("ty", translate_tol)):
        side, reach, cell = F.lit(CELL * tol), F.lit(1.001 * tol), f"_c{k}"
        left = left.withColumn(cell, F.explode(F.sequence(F.floor((F.col(f"{la}.{k}") - reach) / side), F.floor((F.col(f"{la}.{k}") + reach) / side))))
        right = right.withColumn(cell, F.floor(F.col(f"{ra}.{k}") / side))
        cells.append(cell)
    return left.join(right, keys + cells).where(_agrees(F.col(la), F.col(ra), scale_tol, translate_tol)).drop(*cells)


def _seed_counts(weighted: DataFrame, scale_tol: float, translate_tol: float) -> DataFrame:
    seed = weighted.select(*KEYS, F.col("config_id").alias("seed_id"), F.col("affine").alias("seed_affine"))
    member = weighted.select(*KEYS, F.col("affine").alias("_ma"), F.col("weight").alias("_mw"))
    inside = agreeing(seed, member, "seed_affine", "_ma", KEYS, scale_tol, translate_tol)
    return inside.groupBy(*KEYS, "seed_id", "seed_affine").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("_mw"), TIE_DECIMALS).alias("kept_weight"))


def seeds(weighted: DataFrame, scale_tol: float = SCALE_TOLERANCE, translate_tol: float = TRANSLATE_TOLERANCE) -> DataFrame:
    """C-2: every match as seed with inlier count, inlier weight and rank inside its page."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("n_kept").desc(), F.col("kept_weight").desc(), "seed_id")
    return _seed_counts(weighted, scale_tol, translate_tol).withColumn("seed_rank", F.row_number().over(w))


def max_inlier(weighted: DataFrame, scale_tol: float = SCALE_TOLERANCE, translate_tol: float = TRANSLATE_TOLERANCE) -> DataFrame:
    """C-2, C-3: each match with the winning seed, whether it is an inlier and the mean affine of the inliers."""
    order = F.struct(-F.col("n_kept"), -F.col("kept_weight"), "seed_id")
    best = _seed_counts(weighted, scale_tol, translate_tol).groupBy(*KEYS).agg(F.min_by(F.struct("seed_id", "seed_affine"), order).alias("_b")).select(*KEYS, "_b.*")
    t = weighted.join(best, KEYS)
    t = t.withColumn("scale_dev", R.scale_delta(F.col("affine"), F.col("seed_affine"))).withColumn(
        "translate_dev", R.translate_delta(F.col("affine"), F.col("seed_affine"))
    )
    t = t.withColumn("kept", (F.col("scale_dev") <= R.lit(scale_tol)) & (F.col("translate_dev") <= R.lit(translate_tol)))
    w = Window.partitionBy(*KEYS)
    kept_w = F.when(F.col("kept"), F.col("weight"))
    total = F.sum(kept_w).over(w)
    mean = R.make_affine(*[F.sum(kept_w * F.col(f"affine.{k}")).over(w) / total for k in ("sx", "sy", "tx", "ty")])
    return t.withColumn("mean_affine", F.when(total >= R.lit(1e-9), mean))


def _page_aggregates(inl: DataFrame) -> DataFrame:
    kept_w = F.when(F.col("kept"), F.col("weight"))
    agreement = R.iou_transform(R.apply_affine(F.col("c"), F.col("mean_affine")), F.col("r"))
    return inl.groupBy(*KEYS).agg(
        F.first("mean_affine").alias("affine"),
        F.first("seed_id").alias("seed_id"),
        F.count_if("kept").alias("n_matches"),
        F.count(F.lit(1)).alias("n_all"),
        (F.sum(kept_w * F.col("confidence")) / F.sum(kept_w)).alias("mean_confidence"),
        (F.sum(kept_w * agreement) / F.sum(kept_w)).alias("agreement"),
        (F.sum(kept_w) / F.sum("weight")).alias("coverage"),
    )


def weighted_affine(inl: DataFrame) -> DataFrame:
    """C-3: mean affine and mean confidence of the inliers per page."""
    return _page_aggregates(inl).select(*KEYS, "affine", "mean_confidence")


def projection_agreement(inl: DataFrame) -> DataFrame:
    """C-4: weighted mean IoU of projected template rects with their partners."""
    return _page_aggregates(inl).select(*KEYS, "agreement")


def consensus(inl: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """C-5: consensus transform, confidence and warnings per page with matches."""
    a = _page_aggregates(inl)
    enough = F.col("n_matches") >= min_matches
    conf = R.clamp01(F.col("mean_confidence") * (R.lit(0.4) + R.lit(0.3) * F.col("coverage") + R.lit(0.3) * F.col("agreement")))
    n_out = F.col("n_all") - F.col("n_matches")
    warnings = F.array_compact(
        F.array(
            F.when(enough & (n_out > 0), F.concat(n_out.cast("string"), F.lit(" outlier match(es) excluded from consensus"))),
            F.when(enough & (F.col("n_matches") == 1), F.lit("consensus formed from a single match — no cross-validation possible")),
            F.when(
                enough & (F.col("agreement") < 0.5),
                F.concat(
                    F.lit("consensus transform projects config rects to runtime with low IoU ("),
                    F.format_string("%.3f", "agreement"), F.lit(")"),
                ),
            ),
            F.when(~enough, F.lit("insufficient agreement to form a consensus transform")),
        )
    )
    return a.select(
        *KEYS,
        F.when(enough, F.col("affine")).alias("affine"),
        F.when(enough, conf).otherwise(R.lit(0)).alias("confidence"),
        "n_matches",
        n_out.alias("n_outliers"),
        "seed_id",
        "coverage",
        "agreement",
        warnings.alias("warnings"),
    )


def outliers(inl: DataFrame, scale_tol: float = SCALE_TOLERANCE, translate_tol: float = TRANSLATE_TOLERANCE) -> DataFrame:
    """C-6: matches outside the winning set with the reason and their delta from the consensus."""
    scale = F.col("scale_dev") > R.lit(scale_tol)
    tail = F.concat(F.lit(" from inlier set seeded by "), "seed_id")

    def reason(kind: str, col: str, tol: float) -> Column:
        return F.concat(
            F.lit(f"{kind} deviation "), F.format_string("%.3f", col), F.lit(f" exceeds tolerance {tol:.3f}"), tail
        )

    return inl.where(~F.col("kept")).select(
        *KEYS, "config_id", "runtime_id",
        F.when(scale, reason("scale", "scale_dev", scale_tol)).otherwise(reason("translate", "translate_dev", translate_tol)).alias("reason"),
        R.affine_sub(F.col("affine"), F.col("mean_affine")).alias("delta"),
    )


def local_transforms(weighted: DataFrame) -> DataFrame:
    """C-7: template object id to its own affine, one map per page (bounded by the template)."""
    entries = F.array_sort(F.collect_list(F.struct("config_id", "affine")))
    return weighted.groupBy(*KEYS).agg(F.map_from_entries(entries).alias("local"))


def regional_transforms(
    weighted: DataFrame, inl: DataFrame, scale_tol: float = SCALE_TOLERANCE, translate_tol: float = TRANSLATE_TOLERANCE
) -> DataFrame:
    """C-8: other coherent shifts on pages whose consensus says nothing moved: (KEYS, seed_rank, seed_id, n_kept, affine).

    Seeds are taken in rank order, a seed inside a cluster that is taken already is skipped: rounds over the pairs of
    seeds that agree (``greedy``), so neither seeds nor members of a page are packed.
    """
    still = inl.where(R.near_identity(F.col("mean_affine"))).select(*KEYS).distinct()
    w = cut(weighted.join(still, KEYS, "left_semi"))
    ranked = seeds(w, scale_tol, translate_tol).where((F.col("seed_rank") > 1) & (F.col("n_kept") >= 2))
    member = w.select(*KEYS, F.col("affine").alias("_ma"), F.col("weight").alias("_mw"))
    refined = R.make_affine(*[F.sum(F.col("_mw") * F.col(f"_ma.{k}")) / F.sum("_mw") for k in ("sx", "sy", "tx", "ty")])
    kept = agreeing(ranked, member, "seed_affine", "_ma", KEYS, scale_tol, translate_tol)
    clusters = kept.groupBy(*KEYS, "seed_rank", "seed_id", "seed_affine", "n_kept").agg(refined.alias("affine"))
    clusters = cut(clusters.where(~R.near_identity(F.col("affine"))))
    first = clusters.select(*KEYS, F.col("seed_id").alias("winner"), F.col("seed_rank").alias("_wr"), F.col("seed_affine").alias("_wa"))
    later = clusters.select(*KEYS, F.col("seed_id").alias("loser"), F.col("seed_rank").alias("_lr"), F.col("seed_affine").alias("_la"))
    edges = agreeing(first, later, "_wa", "_la", KEYS, scale_tol, translate_tol).where("_wr < _lr").select(*KEYS, "loser", "winner")
    lost = suppressed(edges, KEYS).withColumnRenamed("loser", "seed_id")
    return clusters.join(lost, KEYS + ["seed_id"], "left_anti").select(*KEYS, "seed_rank", "seed_id", "n_kept", "affine")


# ------------------------------------------------------------------ level summaries
def level_border(docs: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame) -> DataFrame:
    """C-9: page borders are a certain pair."""
    t = docs.select(*KEYS).join(tmpl_frames.select(*TPL, "c_border"), TPL).join(rt_frames.select(*PAGE, "r_border"), PAGE)
    return t.select(
        *KEYS, F.lit("border").alias("level"), R.affine_from_rects(F.col("c_border"), F.col("r_border")).alias("affine"),
        R.lit(1).alias("confidence"), F.lit(1).cast("long").alias("n_matches"), F.array().cast("array<string>").alias("warnings"),
    )


def _frame_confidence(source: Column) -> Column:
    out = F.when(F.lit(False), R.lit(0))
    for name, value in FRAME_CONFIDENCE.items():
        out = out.when(source == name, R.lit(value))
    return out.otherwise(R.lit(FRAME_CONFIDENCE_DEFAULT))


def level_refined(docs: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame) -> DataFrame:
    """C-10: content rects against each other, confidence by the weaker side's source."""
    t = docs.select(*KEYS).join(tmpl_frames.select(*TPL, "c_cv", "c_source"), TPL).join(
        rt_frames.select(*PAGE, "r_cv", "r_source"), PAGE
    )
    fallback = (F.col("c_source") == "full-page-fallback") | (F.col("r_source") == "full-page-fallback")
    return t.select(
        *KEYS, F.lit("refined-border").alias("level"), R.affine_from_rects(F.col("c_cv"), F.col("r_cv")).alias("affine"),
        F.least(_frame_confidence(F.col("c_source")), _frame_confidence(F.col("r_source"))).alias("confidence"),
        F.lit(1).cast("long").alias("n_matches"),
        F.array_compact(F.array(F.when(fallback, F.lit("refined border was a full-page fallback on at least one side")))).alias("warnings"),
    )


def _summary(inl: DataFrame, level: str) -> DataFrame:
    a = _page_aggregates(inl)
    conf = R.clamp01(F.col("mean_confidence") * (R.lit(0.5) + R.lit(0.5) * F.col("agreement")))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("n_matches") == 1, F.lit(f"{level} summary derived from a single match — limited cross-validation")),
            F.when(
                F.col("agreement") < 0.5,
                F.concat(
                    F.lit(f"{level} consensus projects config rects to runtime with low IoU ("),
                    F.format_string("%.3f", "agreement"), F.lit(")"),
                ),
            ),
        )
    )
    return a.select(
        *KEYS, F.lit(level).alias("level"), "affine", conf.alias("confidence"), "n_matches", warnings.alias("warnings")
    )


def level_object(inl: DataFrame) -> DataFrame:
    """C-11."""
    return _summary(inl, "object")


def level_parent_chain(weighted: DataFrame) -> DataFrame:
    """C-12: only matches with parent-chain evidence."""
    return _summary(max_inlier(weighted.where(F.array_contains("basis", "parent-chain"))), "parent-chain")


def overall_confidence(pages: DataFrame) -> DataFrame:
    """C-13: page confidences weighted by match count per document."""
    n = F.when(F.col("n_matches") > 0, F.col("n_matches")).otherwise(0)
    total = F.sum(n)
    return pages.groupBy("doc_id", "template_id").agg(
        F.when(total > 0, F.sum(F.col("confidence") * n) / total).otherwise(R.lit(0)).alias("overall_confidence")
    )
