"""Learning from batches: evidence, mergeable statistics and the refined template (F-1..F-24).

Statistics are kept per template in unfiltered, mergeable form; reliability and the emission
filter are derived on read, so merging never loses history.
"""

from __future__ import annotations

from dataclasses import dataclass, fields as dc_fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.functions import welford as W
from boxledger.operators import anchors as A
from boxledger.operators import boxes
from boxledger.operators.boxes import PAGE
from boxledger.operators.consensus import KEYS
from boxledger.operators.matching import TPL

AFFINE = ("sx", "sy", "tx", "ty")
RECT = ("x", "y", "w", "h")
LABELS = ("A", "B", "C")
TIER_NAMES = ("A", "B", "C", "refined", "border")
MIN_RELIABILITY = 0.3
MIN_PAIR = 2
PAGES_TOGETHER = 4096  # pages of a template that are expanded in one task: any number gives the same pairs
ABSENT_CONFIDENCE = 0.05


# ------------------------------------------------------------------ evidence
def match_evidence(matches: DataFrame, outliers: DataFrame) -> DataFrame:
    """F-1: matches with rects, IoU of their own projection and the outlier flag."""
    flagged = outliers.select(*PAGE, "config_id", F.lit(True).alias("_o"))
    iou = R.iou(R.apply_affine(F.col("c"), F.col("affine")), F.col("r"))
    return matches.where(F.col("c").isNotNull() & F.col("r").isNotNull()).join(flagged, PAGE + ["config_id"], "left").select(
        *KEYS, "config_id", "runtime_id", "confidence", "affine", "c", "r", iou.alias("iou"), F.coalesce("_o", F.lit(False)).alias("is_outlier")
    )


def outlier_flag(evidence: DataFrame, consensus: DataFrame, strict_delta: bool = True) -> DataFrame:
    """F-2: on pages with a consensus and no listed outlier, flag matches away from the consensus.

    ``strict_delta`` tests the delta against zero; without it the delta is tested as if it were an
    affine near identity, which flags every match.
    """
    k = consensus.where(F.col("affine").isNotNull() & (F.col("n_outliers") == 0)).select(*KEYS, F.col("affine").alias("_k"))
    t = evidence.join(k, KEYS, "left")
    d = R.affine_sub(F.col("affine"), F.col("_k"))
    if strict_delta:
        near = (F.abs(d["sx"]) < 0.01) & (F.abs(d["sy"]) < 0.01) & (F.abs(d["tx"]) < 0.005) & (F.abs(d["ty"]) < 0.005)
    else:
        near = R.near_identity_evidence(d)
    return t.withColumn("is_outlier", F.col("is_outlier") | (F.col("_k").isNotNull() & ~near)).drop("_k")


def pair_evidence(evidence: DataFrame) -> DataFrame:
    """F-3: ordered pairs of matched objects of a page, in template ids.

    A page has at most one match per template object, so it is packed and expanded in place. Pages of one template lie side by
    side, so what is counted by template is combined before it moves; those of a template with very many pages are dealt out.
    """
    packed = evidence.groupBy(*KEYS).agg(F.collect_list(F.struct("config_id", "r")).alias("_all"))
    many = evidence.groupBy(*TPL).agg(F.approx_count_distinct("doc_id").alias("_n")).where(F.col("_n") > PAGES_TOGETHER)
    deal = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / PAGES_TOGETHER)), F.lit(0))
    packed = packed.join(many, TPL, "left").withColumn("_deal", deal).repartition(*TPL, "_deal")
    both = packed.withColumn("a", F.explode("_all")).withColumn("b", F.explode("_all")).where(F.col("a.config_id") != F.col("b.config_id"))
    a, b = F.col("a.r"), F.col("b.r")
    w, h = F.greatest(a["w"], R.lit(R.EPS_FINE)), F.greatest(a["h"], R.lit(R.EPS_FINE))
    rel = R.make((R.center_x(b) - R.center_x(a)) / w, (R.center_y(b) - R.center_y(a)) / h, b["w"] / w, b["h"] / h)
    return both.select(*KEYS, F.col("a.config_id").alias("from_id"), F.col("b.config_id").alias("to_id"), rel.alias("rel"))


def evidence_tier(tier: Column) -> Column:
    out = F.when(tier == "border", F.lit("border"))
    for label in LABELS:
        out = out.when(tier == f"field-object-{label.lower()}", F.lit(label))
    return out.otherwise(F.lit("refined"))


def field_evidence(predicted: DataFrame, fields: DataFrame, rt: DataFrame) -> DataFrame:
    """F-4: predicted fields of the geometry with tier and IoU with the matched runtime object."""
    known = fields.select(*TPL, "field_id")
    r = rt.select(*PAGE, "runtime_id", "r")
    t = predicted.join(known, TPL + ["field_id"], "left_semi").join(r, PAGE + ["runtime_id"], "left")
    return t.select(
        *KEYS, "field_id", evidence_tier(F.col("tier")).alias("tier"), "bbox", F.coalesce(R.iou(F.col("bbox"), F.col("r")), R.lit(0)).alias("iou"), "config_id"
    )


def page_evidence(docs: DataFrame, consensus: DataFrame, refined: DataFrame, surfaces: DataFrame) -> DataFrame:
    """F-5: consensus, refined-border affine and page size per page."""
    k = consensus.select(*KEYS, F.col("affine").alias("consensus"), F.col("confidence").alias("consensus_confidence"), F.col("n_matches"))
    f = refined.select(*KEYS, F.col("affine").alias("refined_delta"))
    s = surfaces.select(*PAGE, "width", "height")
    return docs.select(*KEYS).join(k, KEYS, "left").join(f, KEYS, "left").join(s, PAGE, "left").withColumns(
        {"consensus_confidence": F.coalesce("consensus_confidence", R.lit(0)), "n_matches": F.coalesce("n_matches", F.lit(0))}
    )


@dataclass(frozen=True)
class Evidence:
    """F-24: everything a batch tells about its templates."""

    documents: DataFrame
    pages: DataFrame
    matches: DataFrame
    fields: DataFrame

    @property
    def pairs(self) -> DataFrame:
        return pair_evidence(self.matches)


def extract_evidence(docs, matches, outliers, consensus, refined, surfaces, predicted, fields, rt) -> Evidence:
    """F-24."""
    ev = outlier_flag(match_evidence(matches, outliers), consensus)
    return Evidence(
        docs.select("doc_id", "template_id").distinct(), page_evidence(docs, consensus, refined, surfaces), ev, field_evidence(predicted, fields, rt)
    )


# ------------------------------------------------------------------ statistics
def object_stats(evidence: DataFrame, tmpl: DataFrame) -> DataFrame:
    """F-9: state per template object; objects never seen carry empty states."""
    drift = R.make(*[F.col(f"r.{k}") - F.col(f"c.{k}") for k in RECT])
    s = evidence.withColumn("_d", drift).groupBy(*TPL, "config_id").agg(
        F.count(F.lit(1)).alias("appearances"),
        W.welford_agg(F.col("confidence")).alias("match_confidence"),
        W.welford_struct(F.col("affine"), AFFINE).alias("affine"),
        W.welford_agg(F.col("iou")).alias("iou"),
        F.count_if("is_outlier").alias("outliers"),
        W.welford_struct(F.col("_d"), RECT).alias("drift"),
    )
    base = tmpl.select(*TPL, "config_id")
    return base.join(s, TPL + ["config_id"], "full_outer").select(
        *TPL, "config_id", F.coalesce("appearances", F.lit(0)).alias("appearances"), F.coalesce("match_confidence", W.empty()).alias("match_confidence"),
        F.coalesce("affine", W.empty_struct(AFFINE)).alias("affine"), F.coalesce("iou", W.empty()).alias("iou"),
        F.coalesce("outliers", F.lit(0)).alias("outliers"), F.coalesce("drift", W.empty_struct(RECT)).alias("drift"),
    )


def pair_stats(pairs: DataFrame, minimum: int = MIN_PAIR) -> DataFrame:
    """F-10: pairs seen together at least ``minimum`` times."""
    return (
        pairs.groupBy(*TPL, "from_id", "to_id")
        .agg(F.count(F.lit(1)).alias("co_occurrence"), W.welford_struct(F.col("rel"), RECT).alias("rel"))
        .where(F.col("co_occurrence") >= minimum)
    )


def tier_histogram(tier: Column) -> Column:
    return F.struct(*[F.count_if(tier == t).alias(t) for t in TIER_NAMES])


def field_stats(evidence: DataFrame, fields: DataFrame) -> DataFrame:
    """F-11: tier histogram, predicted rect and IoU per A/B/C."""
    s = evidence.groupBy(*TPL, "field_id").agg(
        tier_histogram(F.col("tier")).alias("tiers"),
        W.welford_struct(F.col("bbox"), RECT).alias("rect"),
        F.struct(*[W.welford_agg(F.col("iou"), where=F.col("tier") == t).alias(t) for t in LABELS]).alias("anchor_iou"),
    )
    zero = F.struct(*[F.lit(0).cast("long").alias(t) for t in TIER_NAMES])
    return fields.select(*TPL, "field_id").join(s, TPL + ["field_id"], "left").select(
        *TPL, "field_id", F.coalesce("tiers", zero).alias("tiers"), F.coalesce("rect", W.empty_struct(RECT)).alias("rect"),
        F.coalesce("anchor_iou", W.empty_struct(LABELS)).alias("anchor_iou"),
    )


def anchor_usage(evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """F-12: how often an object anchored a field per A/B/C, with the IoU reached."""
    used = evidence.where(F.col("tier").isin(*LABELS) & F.col("config_id").isNotNull())
    s = used.groupBy(*TPL, "config_id").agg(
        F.struct(*[F.count_if(F.col("tier") == t).alias(t) for t in LABELS]).alias("usage"),
        F.struct(*[W.welford_agg(F.col("iou"), where=F.col("tier") == t).alias(t) for t in LABELS]).alias("usage_iou"),
    )
    zero = F.struct(*[F.lit(0).cast("long").alias(t) for t in LABELS])
    return objects.select(*TPL, "config_id").join(s, TPL + ["config_id"], "left").select(
        *TPL, "config_id", F.coalesce("usage", zero).alias("usage"), F.coalesce("usage_iou", W.empty_struct(LABELS)).alias("usage_iou")
    )


def page_stats(evidence: DataFrame, tmpl_pages: DataFrame) -> DataFrame:
    """F-13: consensus and refined-border states and the mean shift per template page."""
    has = F.col("consensus").isNotNull()
    s = evidence.groupBy(*TPL).agg(
        W.welford_struct(F.col("consensus"), AFFINE, where=has).alias("consensus"),
        W.welford_struct(F.col("refined_delta"), AFFINE, where=F.col("refined_delta").isNotNull()).alias("refined_delta"),
        F.count_if(has).alias("shift_n"), F.avg(F.when(has, F.col("consensus.tx"))).alias("shift_tx"), F.avg(F.when(has, F.col("consensus.ty"))).alias("shift_ty"),
    )
    return tmpl_pages.select(*TPL).join(s, TPL, "left").select(
        *TPL, F.coalesce("consensus", W.empty_struct(AFFINE)).alias("consensus"), F.coalesce("refined_delta", W.empty_struct(AFFINE)).alias("refined_delta"),
        F.coalesce("shift_n", F.lit(0)).alias("shift_n"), F.coalesce("shift_tx", R.lit(0)).alias("shift_tx"), F.coalesce("shift_ty", R.lit(0)).alias("shift_ty"),
    )


def doc_count(documents: DataFrame) -> DataFrame:
    """F-14: observed documents per template, with or without usable pages."""
    return documents.groupBy("template_id").agg(F.count_distinct("doc_id").alias("documents"))


def global_stats(documents: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """F-13, F-14: document count, tier histogram and mean consensus confidence per template."""
    tiers = fields.groupBy("template_id").agg(tier_histogram(F.col("tier")).alias("tiers"))
    conf = pages.where(F.col("consensus").isNotNull()).groupBy("template_id").agg(F.avg("consensus_confidence").alias("mean_confidence"))
    zero = F.struct(*[F.lit(0).cast("long").alias(t) for t in TIER_NAMES])
    return doc_count(documents).join(tiers, "template_id", "left").join(conf, "template_id", "left").select(
        "template_id", "documents", F.coalesce("tiers", zero).alias("tiers"), F.coalesce("mean_confidence", R.lit(0)).alias("mean_confidence")
    )


# ------------------------------------------------------------------ analytics
@dataclass(frozen=True)
class Analytics:
    """Stored statistics: unfiltered states per template and the merge history."""

    objects: DataFrame
    fields: DataFrame
    pages: DataFrame
    totals: DataFrame
    history: DataFrame

    def save(self, path: str) -> None:
        for f in dc_fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Analytics:
        return Analytics(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in dc_fields(Analytics)})


def reliability(appearances: Column, documents: Column, iou: Column, outliers: Column) -> Column:
    """F-15: presence, projection quality and agreement with the consensus in one number."""
    seen = F.least(R.lit(1), appearances / documents)
    quality = F.when(iou["total_weight"] > 0, R.clamp01(iou["mean"], True)).otherwise(R.lit(0))
    rate = F.when(appearances > 0, F.least(R.lit(1), outliers / appearances)).otherwise(R.lit(0))
    value = R.clamp01(R.lit(0.4) * seen + R.lit(0.4) * quality + R.lit(0.2) * (R.lit(1) - rate), True)
    return F.when(documents > 0, value).otherwise(R.lit(0))


def with_reliability(a: Analytics) -> DataFrame:
    docs = a.totals.select("template_id", "documents")
    t = a.objects.join(docs, "template_id", "left")
    n = F.coalesce(F.col("documents"), F.lit(0))
    return t.withColumn("reliability", reliability(F.col("appearances"), n, F.col("iou"), F.col("outliers"))).drop("documents")


def emit_filter(objects: DataFrame) -> DataFrame:
    """F-16: objects worth emitting."""
    return objects.where((F.col("appearances") > 0) & (F.col("reliability") >= R.lit(MIN_RELIABILITY)))


def to_analytics(ev: Evidence, tmpl: DataFrame, fields: DataFrame, batch_id: str, now_iso: str) -> Analytics:
    """F-17: states of one batch. Sorting is left to the reader: a stored table has no order."""
    objects = object_stats(ev.matches, tmpl)
    objects = objects.join(anchor_usage(ev.fields, objects), TPL + ["config_id"])
    totals = global_stats(ev.documents, ev.pages, ev.fields)
    history = totals.where(F.col("documents") > 0).select(
        "template_id", F.lit(batch_id).alias("batch_id"), F.col("documents").alias("added_documents"), F.lit(now_iso).alias("merged_at")
    )
    return Analytics(objects, field_stats(ev.fields, fields), page_stats(ev.pages, tmpl.select(*TPL).distinct()), totals, history)


def _add_struct(col: str, parts: tuple[str, ...]) -> Column:
    return F.struct(*[F.sum(F.col(f"{col}.{p}")).alias(p) for p in parts])


def merge_analytics(*parts: Analytics) -> Analytics:
    """F-18, F-19: states of several batches as if observed at once.

    The global mean confidence is averaged by document count.
    """

    def stack(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

    objects = stack("objects").groupBy(*TPL, "config_id").agg(
        F.sum("appearances").alias("appearances"), W.welford_merge(F.col("match_confidence")).alias("match_confidence"),
        W.merge_struct(F.col("affine"), AFFINE).alias("affine"), W.welford_merge(F.col("iou")).alias("iou"), F.sum("outliers").alias("outliers"),
        W.merge_struct(F.col("drift"), RECT).alias("drift"), _add_struct("usage", LABELS).alias("usage"), W.merge_struct(F.col("usage_iou"), LABELS).alias("usage_iou"),
    )
    fields = stack("fields").groupBy(*TPL, "field_id").agg(
        _add_struct("tiers", TIER_NAMES).alias("tiers"), W.merge_struct(F.col("rect"), RECT).alias("rect"), W.merge_struct(F.col("anchor_iou"), LABELS).alias("anchor_iou")
    )
    n = F.sum("shift_n")

    def shift(c: str) -> Column:
        return F.when(n > 0, F.sum(F.col(c) * F.col("shift_n")) / n).otherwise(R.lit(0)).alias(c)

    pages = stack("pages").groupBy(*TPL).agg(
        W.merge_struct(F.col("consensus"), AFFINE).alias("consensus"), W.merge_struct(F.col("refined_delta"), AFFINE).alias("refined_delta"),
        n.alias("shift_n"), shift("shift_tx"), shift("shift_ty"),
    )
    docs = F.sum("documents")
    mean = F.when(docs > 0, F.sum(F.col("mean_confidence") * F.col("documents")) / docs).otherwise(R.lit(0))
    totals = stack("totals").groupBy("template_id").agg(docs.alias("documents"), _add_struct("tiers", TIER_NAMES).alias("tiers"), mean.alias("mean_confidence"))
    return Analytics(objects, fields, pages, totals, stack("history"))


class IncompatibleAnalytics(ValueError):
    """Two analytics describe different templates."""


def merge_checked(a: Analytics, sig_a: DataFrame, b: Analytics, sig_b: DataFrame) -> Analytics:
    """F-18: refuses to merge when a template's signatures (S-10) are not compatible (S-11)."""
    from boxledger.sources.identity import signatures_compatible

    bad = signatures_compatible(sig_a, sig_b).where(~F.col("compatible")).select("template_id").limit(5).collect()
    if bad:
        raise IncompatibleAnalytics(f"signature mismatch for templates {[r.template_id for r in bad]}")
    return merge_analytics(a, b)


def empty_analytics(like: Analytics) -> Analytics:
    """F-20: identity element of the merge."""
    return replace(like, **{f.name: getattr(like, f.name).limit(0) for f in dc_fields(like)})


# ------------------------------------------------------------------ refined template
def refine_objects(tree: DataFrame, stats: DataFrame) -> DataFrame:
    """F-21: template objects moved by their mean drift; unseen ones keep their place with confidence at most 0.05.

    ``tree``: TPL, object_id, rect, confidence, parent_id, …; ``stats``: emitted object statistics.
    """
    s = stats.select(*TPL, F.col("config_id").alias("object_id"), "appearances", "drift", "reliability")
    t = tree.join(s, TPL + ["object_id"], "left")
    seen = F.coalesce(F.col("appearances"), F.lit(0)) > 0
    m = {k: F.col(f"drift.{k}.mean") for k in RECT}
    moved = R.make(
        F.col("rect.x") + m["x"], F.col("rect.y") + m["y"], F.greatest(R.lit(0), F.col("rect.w") + m["w"]), F.greatest(R.lit(0), F.col("rect.h") + m["h"])
    )
    new = {
        "rect": F.when(seen, moved).otherwise(F.col("rect")),
        "confidence": F.when(seen, F.col("reliability")).otherwise(F.least(F.col("confidence"), R.lit(ABSENT_CONFIDENCE))),
    }
    return t.select(*[new[c].alias(c) if c in new else F.col(c) for c in tree.columns])


def refine_frames(frames: DataFrame, border_anchors: DataFrame) -> DataFrame:
    """F-22: refined border united with the field boxes kept in the border anchors.

    ``frames``: TPL, border, refined, cv_content.
    """
    u = border_anchors.groupBy(*TPL).agg(R.union_agg(F.col("border_rel")).alias("_u"), F.count(F.lit(1)).cast("int").alias("_n"))
    t = frames.join(u, TPL, "left")
    has = F.col("_u").isNotNull()
    refined = F.when(has, R.union(F.col("refined"), F.col("_u"))).otherwise(F.col("refined"))
    return t.select(
        *TPL, "border", refined.alias("refined"), "cv_content", F.when(has, F.lit("cv-and-bbox-union")).otherwise(F.lit("cv-content")).alias("source"),
        F.coalesce("_n", F.lit(0)).alias("n_bbox"),
    )


def refine_template(tree: DataFrame, frames: DataFrame, border_anchors: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """F-23: refined objects with relations and anchors rebuilt from them."""
    objects = refine_objects(tree, stats)
    new_frames = refine_frames(frames, border_anchors)
    fields = border_anchors.select(*TPL, "field_id", F.col("border_rel").alias("bbox"))
    found = A.field_anchors(fields, objects, TPL)
    relations = boxes.relation_graph(objects, TPL)
    return {
        "objects": objects,
        "frames": new_frames,
        "relations": relations,
        "anchors": found,
        "borders": A.border_anchors(fields, new_frames, TPL),
        "frame_relations": boxes.frame_relations(objects, new_frames, TPL),
    }
