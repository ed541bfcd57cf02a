"""Placing every field on every document page (P-6..P-16).

A field has at most three anchor candidates, one parent candidate and two frames. They are packed
into one short array per field by a single aggregate; the choice, the override and the
agreement check are then expressions on that row, without further exchanges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.boxes import PAGE
from boxledger.operators.candidates import OBJECT_SOURCES
from boxledger.operators.consensus import KEYS
from boxledger.operators.matching import TPL

# Fixed values.
RESCUE_MIN, SINGLE_MIN = 0.6, 0.85
OVERRIDE_MIN, OVERRIDE_MATCHES, OVERRIDE_IOU, LOCAL_EVIDENCE_MIN = 0.7, 2, 0.6, 0.85
AGREEMENT_IOU, WEAK_CONFIDENCE, MODE_PENALTY = 0.5, 0.5, 0.7
MAX_DISTANCE, MAX_SIZE_DELTA, MIN_ASPECT = 0.35, 0.5, 0.7
TIERS = {"matched-object": "field-object-a", "parent-object": "field-object-b", "refined-border": "refined-border", "border": "border"}
STRATEGY = "type-hierarchy-geometry"

RECT_T = "struct<x:double,y:double,w:double,h:double>"
AFFINE_T = "struct<sx:double,sy:double,tx:double,ty:double>"
RES_T = (
    f"struct<tier:string,box:{RECT_T},affine:{AFFINE_T},src_config:{RECT_T},src_runtime:{RECT_T},config_id:string,"
    "runtime_id:string,strategy:string,warnings:array<string>,label:string,cand_ord:int,cand_object:boolean,cand_confidence:double>"
)


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast("array<string>")


def _f2(c: Column) -> Column:
    return F.format_string("%.2f", c)


def resolution(tier, box, affine, warnings, label, src_config=None, src_runtime=None, config_id=None, runtime_id=None,
               strategy=None, cand_ord=None, cand_object=None, cand_confidence=None) -> Column:
    def opt(v, t):
        return F.lit(None).cast(t) if v is None else v.cast(t)

    return F.struct(
        tier.alias("tier"), box.alias("box"), affine.alias("affine"), opt(src_config, RECT_T).alias("src_config"),
        opt(src_runtime, RECT_T).alias("src_runtime"), opt(config_id, "string").alias("config_id"), opt(runtime_id, "string").alias("runtime_id"),
        opt(strategy, "string").alias("strategy"), warnings.alias("warnings"), label.alias("label"), opt(cand_ord, "int").alias("cand_ord"),
        opt(cand_object, "boolean").alias("cand_object"), opt(cand_confidence, "double").alias("cand_confidence"),
    ).cast(RES_T)


# ------------------------------------------------------------------ resolvers on runtime objects
def node_facts(objects: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Depth, children, parent and peers at the same depth per object.

    ``objects``: keys, object_id, rect, parent_id, depth.
    """
    kids = objects.where(F.col("parent_id").isNotNull()).groupBy(*keys, F.col("parent_id").alias("object_id")).agg(F.lit(True).alias("_k"))
    peers = objects.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("peers"))
    return (
        objects.join(kids, keys + ["object_id"], "left")
        .join(peers, keys + ["depth"])
        .select(
            *keys, F.col("object_id").alias(id_col), "rect", "depth", F.coalesce("_k", F.lit(False)).alias("has_children"),
            F.col("parent_id").isNotNull().alias("has_parent"), "peers",
        )
    )


def _acceptable(c: Column, r: Column) -> Column:
    return (
        (R.geometry_distance(c, r) <= R.lit(MAX_DISTANCE))
        & (R.size_delta(c, r) <= R.lit(MAX_SIZE_DELTA))
        & (R.aspect_parity(c, r) >= R.lit(MIN_ASPECT))
    )


def resolve_object(config: DataFrame, runtime: DataFrame, docs: DataFrame, cross_document: bool = True, strict: bool = False) -> DataFrame:
    """P-11 (``strict``: P-12): runtime counterpart of template objects without a matcher.

    ``config``: node facts per template page; ``runtime``: node facts per document page;
    ``docs``: KEYS. The same id counts, unless it is a detector-made id of another document.
    Otherwise the template object must be alone at its depth: the best runtime object of that
    depth by role and distance (strict: the only one) is taken if it is close and similar enough.
    """
    c = config.select(*TPL, "config_id", F.col("rect").alias("c"), "depth", F.col("has_children").alias("_ck"), F.col("has_parent").alias("_cp"), F.col("peers").alias("_cn"))
    wanted = docs.select(*KEYS).join(c, TPL)
    r = runtime.select(*PAGE, "runtime_id", F.col("rect").alias("r"), "depth", F.col("has_children").alias("_rk"), F.col("has_parent").alias("_rp"), F.col("peers").alias("_rn"))
    same = wanted.join(r.select(*PAGE, F.col("runtime_id").alias("config_id"), "r"), PAGE + ["config_id"])
    if cross_document:
        same = same.where(~R.positional_id(F.col("config_id")))
    by_id = same.select(*KEYS, "config_id", F.col("config_id").alias("runtime_id"), "c", "r", F.lit("id").alias("strategy"))
    alone = wanted.where(F.col("_cn") == 1).join(by_id.select(*PAGE, "config_id"), PAGE + ["config_id"], "left_anti")
    peers = alone.join(r, PAGE + ["depth"])
    if strict:
        peers = peers.where(F.col("_rn") == 1)
    rank = F.struct(
        (F.col("_ck") != F.col("_rk")).alias("a"), (F.col("_cp") != F.col("_rp")).alias("b"),
        R.geometry_distance(F.col("c"), F.col("r")).alias("d"), F.col("runtime_id").alias("i"),
    )
    best = peers.groupBy(*KEYS, "config_id").agg(F.min_by(F.struct("runtime_id", "c", "r"), rank).alias("_b"))
    shaped = best.where(_acceptable(F.col("_b.c"), F.col("_b.r"))).select(*KEYS, "config_id", "_b.runtime_id", "_b.c", "_b.r", F.lit(STRATEGY).alias("strategy"))
    return by_id.unionByName(shaped)


def label_tier(label: Column) -> Column:
    return F.concat(F.lit("field-object-"), F.lower(label))


def relational_rescue(anchors: DataFrame, relations: DataFrame, tmpl: DataFrame, strict: DataFrame) -> DataFrame:
    """P-7: a missing anchor rebuilt inside another anchor of its field.

    The rescuer must contain the missing anchor in the template and resolve strictly on the page;
    the first such anchor in anchor order counts. Result per (KEYS, field_id, config_id) with the
    resolution struct ``rescue``.
    """
    a = anchors.select(*TPL, "field_id", F.col("label").alias("_label"), F.col("object_id").alias("config_id"), F.col("rel").alias("_frel"))
    b = anchors.select(*TPL, "field_id", F.col("pos").alias("_rpos"), F.col("object_id").alias("_rid"))
    hold = relations.where(F.col("kind") == "container").select(
        *TPL, F.col("from_id").alias("_rid"), F.col("to_id").alias("config_id"), F.col("rel").alias("_orel")
    )
    plan = a.join(b, TPL + ["field_id"]).where(F.col("_rid") != F.col("config_id")).join(hold, TPL + ["_rid", "config_id"])
    plan = plan.join(tmpl.select(*TPL, "config_id", F.col("c").alias("_cm")), TPL + ["config_id"])
    found = strict.select(*KEYS, F.col("config_id").alias("_rid"), F.col("r").alias("_rr"), F.col("strategy").alias("_st"))
    t = found.join(plan, TPL + ["_rid"])
    first = F.min_by(F.struct("_label", "_frel", "_orel", "_cm", "_rr", "_st"), "_rpos")
    t = t.groupBy(*KEYS, "field_id", "config_id").agg(first.alias("_p")).select(*KEYS, "field_id", "config_id", "_p.*")
    t = t.withColumn("_v", R.project_relative(F.col("_orel"), F.col("_rr")))
    t = t.withColumn("_q", R.project_relative(F.col("_frel"), F.col("_v.box")))
    res = resolution(
        label_tier(F.col("_label")), F.col("_q.box"), R.affine_from_rects_floored(F.col("_cm"), F.col("_v.box")),
        _strings(F.col("_v.warning"), F.col("_q.warning")), F.concat(F.lit("relational-rescue("), "config_id", F.lit(")")),
        F.col("_cm"), F.col("_v.box"), F.col("config_id"), None, F.col("_st"),
    )
    return t.select(*KEYS, "field_id", "config_id", res.alias("rescue"))


def resolve_legacy(docs: DataFrame, fields: DataFrame, ranked: DataFrame, resolved: DataFrame, rescues: DataFrame,
                   border_anchors: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame) -> DataFrame:
    """P-10: placement without matcher output, per (KEYS, field_id) as ``legacy``.

    Anchors in priority order, each directly (P-11) or by rescue (P-7); then the refined border;
    a field without anchors uses the refined-border affine.
    """
    base = docs.select(*KEYS).join(fields.select(*TPL, "field_id", "bbox"), TPL)
    turn = ranked.select(*TPL, "field_id", "label", "rel", "resolve_ord", F.col("object_id").alias("config_id"))
    d = resolved.join(turn, TPL + ["config_id"]).withColumn("_q", R.project_relative(F.col("rel"), F.col("r")))
    tier = label_tier(F.col("label"))
    direct = d.select(
        *KEYS, "field_id", (F.col("resolve_ord") * 2).alias("_o"),
        resolution(tier, F.col("_q.box"), R.affine_from_rects_floored(F.col("c"), F.col("r")), _strings(F.col("_q.warning")),
                   F.concat(F.lit("legacy-"), tier), F.col("c"), F.col("r"), F.col("config_id"), F.col("runtime_id"), F.col("strategy")).alias("_r"),
    )
    saved = rescues.join(turn, TPL + ["field_id", "config_id"]).select(
        *KEYS, "field_id", (F.col("resolve_ord") * 2 + 1).alias("_o"),
        F.col("rescue").withField("label", F.concat(F.lit("legacy-"), "rescue.tier")).alias("_r"),
    )
    first = direct.unionByName(saved).groupBy(*KEYS, "field_id").agg(F.min_by("_r", "_o").alias("_r"))
    frames = base.join(tmpl_frames.select(*TPL, "c_cv"), TPL).join(rt_frames.select(*PAGE, "r_cv"), PAGE)
    b = border_anchors.select(*TPL, "field_id", "refined_rel")
    t = frames.join(b, TPL + ["field_id"], "left").join(first, KEYS + ["field_id"], "left")
    affine = R.affine_from_rects_floored(F.col("c_cv"), F.col("r_cv"))
    rel = R.project_relative(F.col("refined_rel"), F.col("r_cv"))
    plain = R.clip_box(R.apply_affine(F.col("bbox"), affine), "transformed")
    t = t.withColumn("_p", F.when(F.col("refined_rel").isNotNull(), rel).otherwise(plain))
    refined = resolution(F.lit("refined-border"), F.col("_p.box"), affine, _strings(F.col("_p.warning")), F.lit("legacy-refined-border"), F.col("c_cv"), F.col("r_cv"))
    return t.select(*KEYS, "field_id", F.coalesce("_r", refined).alias("legacy"))


# ------------------------------------------------------------------ candidate rows
def packed_candidates(ordered: DataFrame, fields: DataFrame, tmpl: DataFrame, rt: DataFrame, tmpl_frames: DataFrame, rt_frames: DataFrame) -> DataFrame:
    """Candidates of a field in order with source rects and projected boxes, one array per field."""
    f = fields.select(*TPL, "field_id", "bbox")
    c = tmpl.select(*TPL, "config_id", "c")
    r = rt.select(*PAGE, "runtime_id", "r")
    cf = tmpl_frames.select(*TPL, "c_cv", "c_border")
    rf = rt_frames.select(*PAGE, "r_cv", "r_border")
    t = ordered.join(f, TPL + ["field_id"]).join(c, TPL + ["config_id"], "left").join(r, PAGE + ["runtime_id"], "left").join(cf, TPL).join(rf, PAGE)
    is_obj = F.col("source").isin(*OBJECT_SOURCES)
    t = t.withColumn("_is", is_obj).withColumn("_p", R.clip_box(R.apply_affine(F.col("bbox"), F.col("affine")), "transformed"))
    src_c = F.when(is_obj, F.col("c")).when(F.col("source") == "refined-border", F.col("c_cv")).otherwise(F.col("c_border"))
    src_r = F.when(is_obj, F.col("r")).when(F.col("source") == "refined-border", F.col("r_cv")).otherwise(F.col("r_border"))
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col("source"))
    label = F.when(is_obj, F.concat("source", F.lit("("), "config_id", F.lit(")"))).otherwise(F.col("source"))
    res = resolution(
        tier, F.col("_p.box"), F.col("affine"), _strings(F.col("_p.warning")), label, src_c, src_r, F.col("config_id"), F.col("runtime_id"),
        F.when(is_obj, F.lit(STRATEGY)), F.col("fallback_order"), is_obj, F.col("confidence"),
    )
    usable = ~is_obj | (F.col("c").isNotNull() & F.col("r").isNotNull())
    item = F.struct(
        F.col("fallback_order").cast("int").alias("ord"), usable.alias("usable"), F.col("_is").alias("is_object"),
        (F.col("source") == "matched-object").alias("is_matched"), F.col("config_id").alias("config_id"),
        F.coalesce(R.contains(F.col("c"), F.col("bbox"), 0.0), F.lit(False)).alias("holds_field"), res.alias("res"),
    )
    return t.groupBy(*KEYS, "field_id").agg(F.array_sort(F.collect_list(item)).alias("cands"))


def pick_object(cands: Column) -> Column:
    """P-6: usable object candidate of highest confidence, the earlier one on ties."""
    ranked = F.transform(
        F.filter(cands, lambda c: c["is_object"] & c["usable"]),
        lambda c: F.struct(c["res"]["cand_confidence"].alias("a"), (-c["ord"]).alias("b"), c.alias("c")),
    )
    return F.array_max(ranked)["c"]


def frame_fallback(cands: Column) -> Column:
    """P-9: first frame candidate in order."""
    return F.get(F.filter(cands, lambda c: ~c["is_object"]), 0)


def consensus_box(bbox: Column, affine: Column) -> Column:
    return R.clip_box(R.apply_affine(bbox, affine), "transformed")


def consensus_rescue(bbox: Column, affine: Column, confidence: Column, n: Column, minimum: float = RESCUE_MIN) -> Column:
    """P-8: resolution from the page consensus or NULL; it carries no source rects."""
    ok = (
        affine.isNotNull() & (n >= 1) & R.finite(confidence) & (confidence >= R.lit(minimum))
        & ((n >= 2) | (confidence >= R.lit(SINGLE_MIN)))
    )
    p = consensus_box(bbox, affine)
    single = F.when(
        n < 2,
        F.concat(
            F.lit("weak consensus rescue: page-consensus built from a single contributing match (confidence "), _f2(confidence),
            F.lit("); cannot be cross-checked against any second match"),
        ),
    )
    return F.when(ok, resolution(F.lit("page-consensus"), p["box"], affine, _strings(p["warning"], single), F.lit("page-consensus")))


def _choose(t: DataFrame) -> DataFrame:
    """P-6..P-10 in order of trust."""
    t = t.withColumn("_obj", pick_object(F.col("cands"))).withColumn("_frame", frame_fallback(F.col("cands")))
    t = t.withColumn("_cons", consensus_rescue(F.col("bbox"), F.col("k_affine"), F.col("k_confidence"), F.col("k_n")))
    rescued = F.when(
        F.col("rescue").isNotNull(),
        F.col("rescue").withField("cand_ord", F.col("rescue_cand.ord")).withField("cand_object", F.lit(True)).withField(
            "cand_confidence", F.col("rescue_cand.res.cand_confidence")
        ),
    )
    return t.withColumn("_r0", F.coalesce(F.col("_obj.res"), rescued, F.col("_cons"), F.col("_frame.res"), F.col("legacy")))


def consensus_override(t: DataFrame) -> DataFrame:
    """P-13: a confident consensus replaces a disagreeing object anchor, unless that anchor is
    strong local evidence. Adds ``_r1`` and the displaced anchor ``_displaced``."""
    k = consensus_box(F.col("bbox"), F.col("k_affine"))
    has_box = F.col("k_affine").isNotNull() & (F.col("k_n") >= 1) & R.finite(F.col("k_confidence"))
    t = t.withColumn("_kbox", F.when(has_box, k["box"]))
    r0 = F.col("_r0")
    t = t.withColumn("_iou", R.iou_transform(r0["box"], F.col("_kbox")))
    contest = (
        F.coalesce(r0["cand_object"], F.lit(False)) & F.col("_kbox").isNotNull() & (F.col("k_confidence") >= R.lit(OVERRIDE_MIN))
        & (F.col("k_n") >= OVERRIDE_MATCHES)
    )
    chosen = F.get(F.filter("cands", lambda c: c["ord"] == r0["cand_ord"]), 0)
    strong = (r0["cand_confidence"] >= R.lit(LOCAL_EVIDENCE_MIN)) & F.coalesce(chosen["holds_field"], F.lit(False))
    t = t.withColumn("_keep", contest & strong).withColumn("_over", contest & ~strong & (F.col("_iou") < R.lit(OVERRIDE_IOU)))
    note = F.concat(
        F.lit("consensus override: primary anchor "), r0["label"], F.lit(" disagreed with page consensus (IoU "), _f2(F.col("_iou")),
        F.lit(f" < {OVERRIDE_IOU:.2f}); consensus confidence "), _f2(F.col("k_confidence")), F.lit(" from "), F.col("k_n").cast("string"),
        F.lit(" contributing match(es) preferred over single-anchor projection"),
    )
    t = t.withColumn("_ov", consensus_rescue(F.col("bbox"), F.col("k_affine"), F.col("k_confidence"), F.col("k_n"), OVERRIDE_MIN))
    over = F.col("_ov").withField("warnings", F.array_append("_ov.warnings", note))
    kept = r0.withField("warnings", F.array_append(r0["warnings"], F.lit("local anchor projection retained over consensus (containment + high confidence)")))
    return t.withColumn("_r1", F.when(F.col("_over"), over).when(F.col("_keep"), kept).otherwise(r0)).withColumn(
        "_displaced", F.when(F.col("_over"), F.struct(r0["label"].alias("label"), r0["box"].alias("box")))
    )


def agreement_warnings(t: DataFrame) -> DataFrame:
    """P-14: compares the chosen box with every other projection; adds ``_agree``."""
    r0, r1 = F.col("_r0"), F.col("_r1")
    others = F.filter("cands", lambda c: c["usable"] & (r0["cand_ord"].isNull() | (c["ord"] != r0["cand_ord"])))
    alt = F.transform(others, lambda c: F.struct(c["res"]["label"].alias("label"), c["res"]["box"].alias("box")))
    cons = F.when(F.col("_kbox").isNotNull() & (r0["label"] != "page-consensus"), F.struct(F.lit("page-consensus").alias("label"), F.col("_kbox").alias("box")))
    t = t.withColumn("_alts", F.concat(alt, F.array_compact(F.array(cons, F.col("_displaced")))))
    scored = F.transform("_alts", lambda a: R.iou_transform(r1["box"], a["box"]))
    t = t.withColumn("_ious", scored).withColumn("_best", F.coalesce(F.greatest(R.lit(0), F.array_max("_ious")), R.lit(0)))
    closest = F.when(F.col("_best") > 0, F.get("_alts", F.array_position("_ious", F.col("_best")).cast("int") - 1)["label"]).otherwise(F.lit("n/a"))
    primary = F.coalesce(r1["cand_object"], F.lit(False))
    conf = r1["cand_confidence"]
    eff = F.when(F.col("mode_warning").isNotNull(), conf * R.lit(MODE_PENALTY)).otherwise(conf)
    weak = primary & R.finite(conf) & (eff < R.lit(WEAK_CONFIDENCE))
    text = F.concat(
        F.lit("weak object match: "), r1["label"], F.lit(" confidence "), _f2(conf),
        F.when(F.col("mode_warning").isNotNull(), F.concat(F.lit(" (effective "), _f2(eff), F.lit(" after cv-mode-mismatch penalty)"))).otherwise(F.lit("")),
    )
    none = F.size("_alts") == 0
    lonely = F.when(
        none & weak & (F.col("_kbox").isNull() | F.col("_over")),
        F.concat(text, F.lit(" with no agreeing alternative anchor or page consensus to cross-check")),
    )
    apart = ~none & (F.col("_best") < R.lit(AGREEMENT_IOU))
    disagree = F.when(
        apart,
        F.concat(
            F.lit("anchor disagreement: "), r1["label"], F.lit(" disagrees with "), F.size("_alts").cast("string"), F.lit(" alternative projection(s) ["),
            F.array_join(F.transform("_alts", lambda a: a["label"]), ", "), F.lit("]; max IoU "), _f2(F.col("_best")),
            F.lit(f" < {AGREEMENT_IOU:.2f} (closest: "), closest, F.lit(")"),
        ),
    )
    also = F.when(apart & weak, F.concat(text, F.lit(" with disagreeing alternatives")))
    demoted = F.when(
        primary & R.finite(conf),
        F.concat(F.col("mode_warning"), F.lit("; object-anchor confidence demoted "), _f2(conf), F.lit("→"), _f2(conf * R.lit(MODE_PENALTY)), F.lit(" for weak-match evaluation")),
    ).otherwise(F.col("mode_warning"))
    return t.withColumn("_agree", F.concat(_strings(lonely, disagree, also), r1["warnings"], _strings(F.when(F.col("mode_warning").isNotNull(), demoted))))


def mode_mismatch(tmpl_modes: DataFrame, rt_modes: DataFrame) -> DataFrame:
    """V-14: pages whose detector mode differs between template and document, with the warning text."""
    t = rt_modes.join(tmpl_modes.select(*TPL, F.col("cv_mode").alias("_c")), TPL).where(F.col("_c") != F.col("cv_mode"))
    text = F.concat(
        F.lit("cvExecutionMode mismatch on page "), F.col("page_index").cast("string"), F.lit(": config="), "_c", F.lit(" runtime="), "cv_mode",
        F.lit(" (object detection thresholds may differ between Config and Runtime)"),
    )
    return t.select(*KEYS, text.alias("mode_warning"))


def localize(surfaces: DataFrame, fields: DataFrame, cands: DataFrame, consensus: DataFrame, rescues: DataFrame | None = None,
             legacy: DataFrame | None = None, modes: DataFrame | None = None) -> DataFrame:
    """P-15: one predicted row per document page and field.

    ``surfaces``: KEYS, width, height (pages that exist at runtime); ``fields``: TPL, field_id, bbox;
    ``cands``: :func:`packed_candidates`; ``rescues``, ``legacy``, ``modes`` are optional tables.
    """
    base = surfaces.select(*KEYS, "width", "height").join(fields, TPL)
    k = consensus.select(*KEYS, F.col("affine").alias("k_affine"), F.col("confidence").alias("k_confidence"), F.col("n_matches").alias("k_n"))
    t = base.join(cands, KEYS + ["field_id"], "left").join(k, KEYS, "left")
    item_t = cands.schema["cands"].dataType.simpleString()
    t = t.withColumn("cands", F.coalesce("cands", F.array().cast(item_t)))
    if rescues is not None:
        missing = cands.select(*KEYS, "field_id", F.explode("cands").alias("_c")).where(F.col("_c.is_matched") & ~F.col("_c.usable"))
        saved = missing.withColumn("config_id", F.col("_c.config_id")).join(rescues, KEYS + ["field_id", "config_id"])
        first = saved.groupBy(*KEYS, "field_id").agg(F.min_by(F.struct("rescue", "_c"), F.col("_c.ord")).alias("_s"))
        t = t.join(first.select(*KEYS, "field_id", F.col("_s.rescue").alias("rescue"), F.col("_s._c").alias("rescue_cand")), KEYS + ["field_id"], "left")
    else:
        elem = cands.schema["cands"].dataType.elementType.simpleString()
        t = t.withColumn("rescue", F.lit(None).cast(RES_T)).withColumn("rescue_cand", F.lit(None).cast(elem))
    t = t.join(legacy, KEYS + ["field_id"], "left") if legacy is not None else t.withColumn("legacy", F.lit(None).cast(RES_T))
    t = t.join(modes, KEYS, "left") if modes is not None else t.withColumn("mode_warning", F.lit(None).cast("string"))
    t = agreement_warnings(consensus_override(_choose(t)))
    r = F.col("_r1")
    meta = [c for c in ("geometry_id", "confirmed_at", "confirmed_by") if c in fields.columns]
    return t.where(r.isNotNull()).select(
        *KEYS, "field_id", *meta, r["box"].alias("bbox"), R.to_pixels(r["box"], F.col("width"), F.col("height")).alias("pixel_bbox"),
        F.col("width").alias("surface_w"), F.col("height").alias("surface_h"), r["tier"].alias("tier"), r["affine"].alias("affine"),
        r["src_config"].alias("src_config"), r["src_runtime"].alias("src_runtime"), r["config_id"].alias("config_id"), r["runtime_id"].alias("runtime_id"),
        r["strategy"].alias("strategy"), r["label"].alias("label"), F.col("_agree").alias("warnings"),
    )


def project_template(docs: DataFrame, tmpl: DataFrame, chains: DataFrame, matches: DataFrame, consensus: DataFrame, refined: DataFrame, border: DataFrame) -> DataFrame:
    """P-16: every template object on every document: own match, matched ancestor, consensus, refined, border, identity."""
    base = docs.select(*KEYS).join(tmpl.select(*TPL, "config_id", "c"), TPL)
    own = matches.select(*PAGE, "config_id", F.col("affine").alias("_m"), F.col("confidence").alias("_mc"))
    up = chains.select(*TPL, F.col("object_id").alias("config_id"), "ancestor_id", "distance")
    anc = (
        matches.select(*KEYS, F.col("config_id").alias("ancestor_id"), F.col("affine").alias("_a"), F.col("confidence").alias("_ac"))
        .join(up, TPL + ["ancestor_id"])
        .groupBy(*PAGE, "config_id")
        .agg(F.min_by(F.struct("_a", "_ac"), "distance").alias("_p"))
    )
    t = base.join(own, PAGE + ["config_id"], "left").join(anc, PAGE + ["config_id"], "left")
    for name, df in (("k", consensus), ("f", refined), ("b", border)):
        t = t.join(df.select(*KEYS, F.col("affine").alias(f"_{name}"), F.col("confidence").alias(f"_{name}c")), KEYS, "left")
    rungs = [("matched-object", "_m", "_mc"), ("parent-object", "_p._a", "_p._ac"), ("consensus", "_k", "_kc"), ("refined-border", "_f", "_fc"), ("border", "_b", "_bc")]
    identity = R.make_affine(R.lit(1), R.lit(1), R.lit(0), R.lit(0))
    source = reduce(lambda acc, x: acc.when(F.col(x[1]).isNotNull(), F.lit(x[0])), rungs[1:], F.when(F.col("_m").isNotNull(), F.lit("matched-object"))).otherwise("identity")
    conf = reduce(lambda acc, x: acc.when(F.col(x[1]).isNotNull(), F.col(x[2])), rungs[1:], F.when(F.col("_m").isNotNull(), F.col("_mc"))).otherwise(R.lit(0))
    affine = F.coalesce(*[F.col(x[1]) for x in rungs], identity)
    return t.select(
        *KEYS, "config_id", R.apply_affine(F.col("c"), affine).alias("rect"), source.alias("source"), conf.alias("confidence"),
        F.col("_m").isNotNull().alias("matched"),
    )


def project_template_raw(docs: DataFrame, tmpl: DataFrame) -> DataFrame:
    """P-16: template objects where the template has them."""
    return docs.select(*KEYS).join(tmpl.select(*TPL, "config_id", "c"), TPL).select(
        *KEYS, "config_id", F.col("c").alias("rect"), F.lit("identity").alias("source"), R.lit(0).alias("confidence"), F.lit(False).alias("matched")
    )
