"""Localization and projection (P-6..P-16, V-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxledger.catalog import forms as G
from boxledger.catalog import sqlkit as K
from boxledger.catalog.forms import CAND_FX, CAND_SQL, CONSENSUS_SQL
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import clamp01, r6
from boxledger.operators import anchors as A
from boxledger.operators import boxes
from boxledger.operators import consensus as C
from boxledger.operators import localize as L
from boxledger.operators import matching as M
from boxledger.session import cut

TPL, PAGE, KEYS = M.TPL, boxes.PAGE, C.KEYS


def packed(s, sf):
    return L.packed_candidates(G.ordered(s, sf), G.geometry(s, sf), G.tmpl_flat(s, sf), G.rt_flat(s, sf), G.tmpl_frames(s, sf), G.rt_frames(s, sf))


def surfaces(s, sf):
    return G.docs(s, sf).withColumn("width", F.lit(1000)).withColumn("height", F.lit(1000))


def fields(s, sf):
    return G.geometry(s, sf).select(*TPL, "field_id", "geometry_id", "bbox")


def consensus(s, sf):
    """Some documents have a weak consensus, so that every rung is used."""
    c = C.consensus(G.inliers(s, sf))
    return c.withColumn("confidence", F.when(F.col("doc_id") % 9 == 4, F.col("confidence") * 0.5).otherwise(F.col("confidence")))


def modes(s, sf):
    t = G.tmpl_flat(s, sf).select(*TPL).distinct().withColumn("cv_mode", F.lit("opencv-runtime"))
    r = G.docs(s, sf).withColumn("cv_mode", F.when(F.col("doc_id") % 4 == 1, F.lit("heuristic-fallback")).otherwise(F.lit("opencv-runtime")))
    return L.mode_mismatch(t, r)


def predicted(s, sf):
    return L.localize(surfaces(s, sf), fields(s, sf), cut(packed(s, sf)), consensus(s, sf), modes=modes(s, sf))


def _box(df, *cols, col="bbox"):
    return df.select(*cols, *[rnd(F.col(f"{col}.{k}")).alias(k) for k in "xywh"])


def _clip(px, py, pw, ph, out="b"):
    """SQL of the clipped box (E-16) as columns {out}x..{out}h."""
    off = f"({px} < -1e-6 OR {px} + {pw} > 1 + 1e-6 OR {py} < -1e-6 OR {py} + {ph} > 1 + 1e-6)"

    def fit(p, s):
        return f"(CASE WHEN {s} > 1 THEN 0.0::DOUBLE WHEN {p} < 0 THEN 0.0::DOUBLE WHEN {p} + {s} > 1 THEN 1.0::DOUBLE - {s} ELSE {p} END)"

    return (
        f"CASE WHEN {off} THEN {clamp01(fit(px, pw))} ELSE {clamp01(px)} END AS {out}x, CASE WHEN {off} THEN {clamp01(fit(py, ph))} ELSE {clamp01(py)} END AS {out}y, "
        f"{clamp01(pw)} AS {out}w, {clamp01(ph)} AS {out}h, {off} AS {out}off"
    )


_CONS = CONSENSUS_SQL.replace(G.WEIGHTED_SQL + ",", "")
PRED_SQL = f"""{CAND_SQL}, {_CONS},
 kc AS (SELECT doc_id, template_id, page_index, msx, msy, mtx, mty, n_matches, CASE WHEN doc_id % 9 = 4 THEN confidence * 0.5::DOUBLE ELSE confidence END AS kconf FROM cons),
 cb0 AS (SELECT co.*, g.x AS gx, g.y AS gy, g.w AS gw, g.h AS gh, g.x * sx + tx AS qx, g.y * sy + ty AS qy, g.w * sx AS qw, g.h * sy AS qh,
   t.x <= g.x AND t.y <= g.y AND g.x + g.w <= t.x + t.w AND g.y + g.h <= t.y + t.h AS holds, CASE WHEN co.config_id IS NULL THEN source ELSE concat(source, '(', co.config_id, ')') END AS label
   FROM co JOIN fx_geometry g USING (template_id, page_index, field_id) LEFT JOIN fx_template t ON t.template_id = co.template_id AND t.object_id = co.config_id),
 cbx AS (SELECT *, {_clip('qx', 'qy', 'qw', 'qh')} FROM cb0),
 pick AS (SELECT * FROM cbx WHERE source IN ('matched-object', 'parent-object') QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, field_id ORDER BY confidence DESC, fallback_order) = 1),
 frames AS (SELECT * FROM cbx WHERE source IN ('refined-border', 'border') QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, field_id ORDER BY fallback_order) = 1),
 kb0 AS (SELECT k.*, g.field_id, g.x * msx + mtx AS qx, g.y * msy + mty AS qy, g.w * msx AS qw, g.h * msy AS qh FROM kc k JOIN fx_geometry g ON k.template_id = g.template_id AND k.page_index = g.page_index),
 kb AS (SELECT *, {_clip('qx', 'qy', 'qw', 'qh', 'k')}, kconf >= 0.6::DOUBLE AND (n_matches >= 2 OR kconf >= 0.85::DOUBLE) AS rescue FROM kb0),
 r0 AS (SELECT f.doc_id, f.template_id, f.page_index, f.field_id, CASE WHEN p.doc_id IS NOT NULL THEN 'object' WHEN k.rescue THEN 'page-consensus' ELSE 'frame' END AS kind,
   p.source AS psource, p.label AS plabel, p.fallback_order AS pord, p.confidence AS pconf, p.holds, p.config_id, p.runtime_id, f.source AS fsource, f.fallback_order AS ford, p.boff AS poff, f.boff AS foff,
   p.bx AS px, p.by AS py, p.bw AS pw, p.bh AS ph, f.bx AS fx, f.by AS fy, f.bw AS fw, f.bh AS fh, k.kx, k.ky, k.kw, k.kh, k.koff, k.kconf, k.n_matches
   FROM frames f LEFT JOIN pick p ON p.doc_id = f.doc_id AND p.page_index = f.page_index AND p.field_id = f.field_id LEFT JOIN kb k ON k.doc_id = f.doc_id AND k.page_index = f.page_index AND k.field_id = f.field_id),
 r1 AS (SELECT *, coalesce(kind = 'object' AND kconf >= 0.7::DOUBLE AND n_matches >= 2, false) AS contest, coalesce(pconf >= 0.85::DOUBLE AND holds, false) AS strong, {K.iou_t('p', 'k')} AS piou FROM r0),
 r2 AS (SELECT *, contest AND strong AS keep, contest AND NOT strong AND piou < 0.6::DOUBLE AS over FROM r1),
 r3 AS (SELECT *, CASE WHEN over THEN 'page-consensus' WHEN kind = 'object' THEN CASE psource WHEN 'matched-object' THEN 'field-object-a' ELSE 'field-object-b' END WHEN kind = 'frame' THEN fsource ELSE kind END AS tier,
   CASE WHEN over OR kind = 'page-consensus' THEN kx WHEN kind = 'object' THEN px ELSE fx END AS x, CASE WHEN over OR kind = 'page-consensus' THEN ky WHEN kind = 'object' THEN py ELSE fy END AS y,
   CASE WHEN over OR kind = 'page-consensus' THEN kw WHEN kind = 'object' THEN pw ELSE fw END AS w, CASE WHEN over OR kind = 'page-consensus' THEN kh WHEN kind = 'object' THEN ph ELSE fh END AS h,
   CASE WHEN over OR kind = 'page-consensus' THEN koff WHEN kind = 'object' THEN poff ELSE foff END AS off, CASE WHEN kind = 'object' THEN pord WHEN kind = 'frame' THEN ford END AS cord FROM r2),
 alts AS (SELECT r.doc_id, r.page_index, r.field_id, c.bx AS ax, c.by AS ay, c.bw AS aw, c.bh AS ah FROM r3 r JOIN cbx c ON r.doc_id = c.doc_id AND r.page_index = c.page_index AND r.field_id = c.field_id AND (r.cord IS NULL OR c.fallback_order <> r.cord)
   UNION ALL SELECT doc_id, page_index, field_id, kx, ky, kw, kh FROM r3 WHERE kx IS NOT NULL AND kind <> 'page-consensus'
   UNION ALL SELECT doc_id, page_index, field_id, px, py, pw, ph FROM r3 WHERE over),
 ag AS (SELECT r.doc_id, r.page_index, r.field_id, count(*) AS n_alts, max({K.iou_t('r.', 'a').replace('ax', 'a.ax').replace('ay', 'a.ay').replace('aw', 'a.aw').replace('ah', 'a.ah')}) AS best FROM r3 r JOIN alts a ON r.doc_id = a.doc_id AND r.page_index = a.page_index AND r.field_id = a.field_id GROUP BY 1, 2, 3),
 pred AS (SELECT r3.*, n_alts, best, doc_id % 4 = 1 AS mism, kind = 'object' AND NOT over AND pconf * CASE WHEN doc_id % 4 = 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END < 0.5::DOUBLE AS weak FROM r3 JOIN ag USING (doc_id, page_index, field_id))"""

add(
    "P6_pick_object",
    lambda s, sf: packed(s, sf).withColumn("p", L.pick_object(F.col("cands"))).where(F.col("p").isNotNull()).select("doc_id", "field_id", F.col("p.res.label").alias("label"), rnd(F.col("p.res.cand_confidence")).alias("confidence")),
    f"WITH {PRED_SQL} SELECT doc_id, field_id, label, {r6('confidence', 'confidence')} FROM pick",
    CAND_FX,
)
add(
    "P8_consensus_rescue",
    lambda s, sf: _box(
        consensus(s, sf).join(fields(s, sf), TPL).withColumn("res", L.consensus_rescue(F.col("bbox"), F.col("affine"), F.col("confidence"), F.col("n_matches"))).where(F.col("res").isNotNull()),
        "doc_id", "field_id", F.col("res.tier").alias("tier"), col="res.box",
    ),
    f"WITH {PRED_SQL} SELECT doc_id, field_id, 'page-consensus' AS tier, {r6('kx', 'x')}, {r6('ky', 'y')}, {r6('kw', 'w')}, {r6('kh', 'h')} FROM kb WHERE rescue",
    CAND_FX,
)
add(
    "P9_frame_fallback",
    lambda s, sf: _box(packed(s, sf).withColumn("f", L.frame_fallback(F.col("cands"))), "doc_id", "field_id", F.col("f.res.tier").alias("tier"), col="f.res.box"),
    f"WITH {PRED_SQL} SELECT doc_id, field_id, source AS tier, {r6('bx', 'x')}, {r6('frames.by', 'y')}, {r6('bw', 'w')}, {r6('bh', 'h')} FROM frames",
    CAND_FX,
)
add(
    "P13_consensus_override",
    lambda s, sf: predicted(s, sf).select(
        "doc_id", "field_id", F.exists("warnings", lambda w: w.startswith("consensus override")).alias("over"), F.exists("warnings", lambda w: w.startswith("local anchor projection retained")).alias("kept")
    ),
    f"WITH {PRED_SQL} SELECT doc_id, field_id, over, keep AS kept FROM pred",
    CAND_FX,
)
add(
    "P14_agreement_warnings",
    lambda s, sf: predicted(s, sf).select(
        "doc_id", "field_id", F.exists("warnings", lambda w: w.startswith("anchor disagreement")).alias("apart"), F.exists("warnings", lambda w: w.startswith("weak object match")).alias("weak"), F.size("warnings").alias("n")
    ),
    f"""WITH {PRED_SQL} SELECT doc_id, field_id, best < 0.5::DOUBLE AS apart, best < 0.5::DOUBLE AND weak AS weak,
      CAST(best < 0.5::DOUBLE AS INT) + CAST(best < 0.5::DOUBLE AND weak AS INT) + CAST(off AS INT) + CAST(over AS INT) + CAST(keep AS INT) + CAST(mism AS INT) + CAST(tier = 'page-consensus' AND n_matches = 1 AS INT) AS n FROM pred""",
    CAND_FX,
)
add(
    "P15_localize",
    lambda s, sf: _box(predicted(s, sf), "doc_id", "field_id", "geometry_id", "tier", "label", "config_id", "runtime_id", rnd(F.col("pixel_bbox.x")).alias("pixel_x"), F.col("src_config").isNotNull().alias("has_source")),
    f"""WITH {PRED_SQL} SELECT doc_id, field_id, concat('geo-', template_id) AS geometry_id, tier, CASE WHEN over OR kind <> 'object' THEN tier ELSE plabel END AS label,
      CASE WHEN kind = 'object' AND NOT over THEN config_id END AS config_id, CASE WHEN kind = 'object' AND NOT over THEN runtime_id END AS runtime_id,
      {r6('x * 1000', 'pixel_x')}, tier <> 'page-consensus' AS has_source, {r6('x', 'x')}, {r6('y', 'y')}, {r6('w', 'w')}, {r6('h', 'h')} FROM pred""",
    CAND_FX,
)
add(
    "V14_mode_mismatch",
    lambda s, sf: modes(s, sf).select("doc_id", "page_index", "mode_warning"),
    """SELECT DISTINCT doc_id, page_index, concat('cvExecutionMode mismatch on page ', page_index, ': config=opencv-runtime runtime=heuristic-fallback (object detection thresholds may differ between Config and Runtime)') AS mode_warning
      FROM fx_runtime WHERE doc_id % 4 = 1""",
    ("fx_runtime",),
)


# ------------------------------------------------------------------ resolvers without matcher
def _nodes(s, sf):
    ct = cut(boxes.depths(G.template_tree(s, sf), TPL, G.chains_c(s, sf)))
    rt = cut(boxes.depths(cut(G.runtime_tree(s, sf)), PAGE))
    # Part numbers are content-derived ids here: a third of the documents keeps the template's ids.
    rt = rt.withColumn("object_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("obj_"), F.expr("substring(object_id, 3)"))).otherwise(F.col("object_id")))
    rt = rt.withColumn("parent_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("obj_"), F.expr("substring(parent_id, 3)"))).otherwise(F.col("parent_id")))
    return ct, rt


def _resolved(s, sf, strict=False):
    ct, rt = _nodes(s, sf)
    return L.resolve_object(L.node_facts(ct, TPL, "config_id"), L.node_facts(rt, PAGE, "runtime_id"), G.docs(s, sf), cross_document=False, strict=strict)


_RES_SQL = f"""{G._TN}, {G._RN}, {K.ancestors_cte('ta', 'tn', 'template_id, page_index')}, {K.ancestors_cte('ra', 'rn', 'doc_id, page_index')},
 cn AS (SELECT t.template_id, t.page_index, t.object_id, t.x, t.y, t.w, t.h, t.parent_id, (SELECT count(*) FROM ta WHERE ta.template_id = t.template_id AND ta.object_id = t.object_id) AS depth,
   EXISTS (SELECT 1 FROM tn k WHERE k.template_id = t.template_id AND k.parent_id = t.object_id) AS kids FROM tn t),
 cnp AS (SELECT *, count(*) OVER (PARTITION BY template_id, page_index, depth) AS peers FROM cn),
 rn2 AS (SELECT t.doc_id, t.template_id, t.page_index, CASE WHEN t.doc_id % 3 = 0 THEN concat('obj_', substring(t.object_id, 3)) ELSE t.object_id END AS object_id, t.x, t.y, t.w, t.h, t.parent_id,
   (SELECT count(*) FROM ra WHERE ra.doc_id = t.doc_id AND ra.object_id = t.object_id) AS depth, EXISTS (SELECT 1 FROM rn k WHERE k.doc_id = t.doc_id AND k.parent_id = t.object_id) AS kids FROM rn t),
 rnp AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_index, depth) AS peers FROM rn2),
 byid AS (SELECT r.doc_id, c.template_id, c.page_index, c.object_id AS config_id, r.object_id AS runtime_id, 'id' AS strategy FROM cnp c JOIN rnp r ON c.template_id = r.template_id AND c.page_index = r.page_index AND c.object_id = r.object_id),
 alone AS (SELECT r.doc_id, c.object_id AS config_id, r.object_id AS runtime_id, r.peers, c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh,
   row_number() OVER (PARTITION BY r.doc_id, r.page_index, c.object_id ORDER BY c.kids <> r.kids, (c.parent_id IS NULL) <> (r.parent_id IS NULL), {K.gdist('c.', 'r.')}, r.object_id) AS n
   FROM cnp c JOIN rnp r ON c.template_id = r.template_id AND c.page_index = r.page_index AND c.depth = r.depth WHERE c.peers = 1 AND NOT EXISTS (SELECT 1 FROM byid b WHERE b.doc_id = r.doc_id AND b.config_id = c.object_id)),
 won AS (SELECT doc_id, config_id, runtime_id, peers FROM alone WHERE n = 1 AND {K.gdist('c', 'r')} <= 0.35::DOUBLE AND {K.size_delta('c', 'r')} <= 0.5::DOUBLE AND {K.aspect_parity('c', 'r')} >= 0.7::DOUBLE)"""
add(
    "P11_resolve_object",
    lambda s, sf: _resolved(s, sf).select("doc_id", "config_id", "runtime_id", "strategy"),
    f"WITH {_RES_SQL} SELECT doc_id, config_id, runtime_id, strategy FROM byid UNION ALL SELECT doc_id, config_id, runtime_id, 'type-hierarchy-geometry' FROM won",
    ("fx_template", "fx_runtime"),
)
add(
    "P12_resolve_strict",
    lambda s, sf: _resolved(s, sf, strict=True).select("doc_id", "config_id", "runtime_id", "strategy"),
    f"WITH {_RES_SQL} SELECT doc_id, config_id, runtime_id, strategy FROM byid UNION ALL SELECT doc_id, config_id, runtime_id, 'type-hierarchy-geometry' FROM won WHERE peers = 1",
    ("fx_template", "fx_runtime"),
)


def _rescues(s, sf):
    strict = cut(_resolved(s, sf, strict=True))
    return L.relational_rescue(G.template_anchors(s, sf), boxes.relation_graph(G.template_tree(s, sf), TPL), G.tmpl_flat(s, sf), strict)


add("P7_relational_rescue", lambda s, sf: _box(_rescues(s, sf), "doc_id", "field_id", "config_id", F.col("rescue.tier").alias("tier"), col="rescue.box"))


def _legacy(s, sf):
    tree = G.template_tree(s, sf)
    g = G.geometry(s, sf)
    ranked = A.rank_anchors(A.field_anchors(g, tree, TPL), tree, G.chains_c(s, sf), boxes.relation_graph(tree, TPL), A.contained_by(g, tree, TPL), TPL)
    return L.resolve_legacy(G.docs(s, sf), g, cut(ranked), cut(_resolved(s, sf)), _rescues(s, sf), G.template_borders(s, sf), G.tmpl_frames(s, sf), G.rt_frames(s, sf))


add("P10_resolve_legacy", lambda s, sf: _box(_legacy(s, sf), "doc_id", "field_id", F.col("legacy.tier").alias("tier"), F.col("legacy.label").alias("label"), col="legacy.box"))
add(
    "P16_project_template",
    lambda s, sf: _box(L.project_template(G.docs(s, sf), G.tmpl_flat(s, sf), G.chains_c(s, sf), G.matches(s, sf), consensus(s, sf).withColumn("affine", F.when(F.col("doc_id") % 5 != 1, F.col("affine"))), *G.levels(s, sf)), "doc_id", "config_id", "source", "matched", rnd(F.col("confidence")).alias("confidence"), col="rect"),
    f"""WITH {CAND_SQL}, {_CONS},
     own AS (SELECT DISTINCT r.doc_id, r.template_id, r.page_index, t.object_id AS config_id, t.x, t.y, t.w, t.h FROM fx_runtime r JOIN fx_template t ON r.template_id = t.template_id AND r.page_index = t.page_index),
     anc AS (SELECT m.doc_id, a.object_id AS config_id, m.sx, m.sy, m.tx, m.ty, m.confidence FROM ta a JOIN wm m ON m.template_id = a.template_id AND m.page_index = a.page_index AND m.config_id = a.ancestor_id QUALIFY row_number() OVER (PARTITION BY m.doc_id, a.object_id ORDER BY a.distance) = 1),
     lad AS (SELECT o.doc_id, o.config_id, o.x, o.y, o.w, o.h, CASE WHEN m.doc_id IS NOT NULL THEN 'matched-object' WHEN a.doc_id IS NOT NULL THEN 'parent-object' WHEN k.doc_id IS NOT NULL THEN 'consensus' ELSE 'refined-border' END AS source,
       coalesce(m.sx, a.sx, k.msx, f.sx) AS sx, coalesce(m.sy, a.sy, k.msy, f.sy) AS sy, coalesce(m.tx, a.tx, k.mtx, f.tx) AS tx, coalesce(m.ty, a.ty, k.mty, f.ty) AS ty,
       coalesce(m.confidence, a.confidence, k.kconf, f.confidence) AS confidence, m.doc_id IS NOT NULL AS matched
       FROM own o LEFT JOIN wm m ON m.doc_id = o.doc_id AND m.config_id = o.config_id LEFT JOIN anc a ON a.doc_id = o.doc_id AND a.config_id = o.config_id
       LEFT JOIN (SELECT *, CASE WHEN doc_id % 9 = 4 THEN confidence * 0.5::DOUBLE ELSE confidence END AS kconf FROM cons WHERE doc_id % 5 <> 1) k ON k.doc_id = o.doc_id LEFT JOIN (SELECT DISTINCT doc_id, sx, sy, tx, ty, confidence FROM cr) f ON f.doc_id = o.doc_id)
     SELECT doc_id, config_id, source, matched, {r6('confidence', 'confidence')}, {r6('x * sx + tx', 'x')}, {r6('y * sy + ty', 'y')}, {r6('w * sx', 'w')}, {r6('h * sy', 'h')} FROM lad""",
    CAND_FX,
)
