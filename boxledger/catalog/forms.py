"""Field anchors, matching, consensus and field candidates (A-*, M-*, C-*, P-1..P-5).

Anchor queries use customer pages (``fx_objects``); the others match template forms with
customer documents. Consensus and candidates start from matches by equal part number, so that
their SQL does not depend on the assignment; the matcher itself is checked by M-* queries.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import functions as F

from boxledger import fixtures
from boxledger.catalog import pages
from boxledger.catalog import sqlkit as K
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import clamp01, d, r6
from boxledger.functions import rect as R
from boxledger.operators import anchors as A
from boxledger.operators import boxes
from boxledger.operators import candidates as P
from boxledger.operators import consensus as C
from boxledger.operators import matching as M
from boxledger.session import cut

TPL, PAGE, KEYS = M.TPL, boxes.PAGE, C.KEYS


def rect_cols(prefix, c, names="xywh"):
    return [rnd(c[n]).alias(f"{prefix}{n}") for n in names]


AFF = ("sx", "sy", "tx", "ty")

# ------------------------------------------------------------------ anchors over customer pages
_AF = ("fx_page_fields", "fx_detections", "fx_objects")


def nested(s, sf):
    return boxes.assign_parents(pages.objects(s, sf))


_NEST = K.parents_cte("nest", "fx_objects")


def anchors_cte(src: str, fields: str, keys: str) -> str:
    """CTEs ``chain`` and ``anch`` (pos, label, distance, rx..rh) over nodes ``src`` with parent_id."""
    ks = [k.strip() for k in keys.split(",")]

    def on(a, b):
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)

    fk = ", ".join(f"f.{k}" for k in ks)
    return f"""
 fo AS (SELECT {fk}, f.field_id, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh, o.object_id, o.parent_id, o.input_ord, o.x AS ox, o.y AS oy, o.w AS ow, o.h AS oh,
   {K.contains('o.', 'f.')} AS inside, {K.cdist('f.', 'o.')} AS dist,
   {K.overlap('o.x', 'o.x + o.w', 'f.x', 'f.x + f.w')} > 1e-6 AND {K.overlap('o.y', 'o.y + o.h', 'f.y', 'f.y + f.h')} > 1e-6 AS touching
   FROM {fields} f JOIN {src} o ON {on('f', 'o')}),
 ch0 AS (SELECT * FROM fo WHERE inside QUALIFY row_number() OVER (PARTITION BY {keys}, field_id ORDER BY ow * oh, input_ord, object_id) = 1),
 ch1 AS (SELECT {', '.join('c.' + k for k in ks)}, c.field_id, o.object_id, o.parent_id FROM ch0 c JOIN {src} o ON {on('c', 'o')} AND c.parent_id = o.object_id),
 ch2 AS (SELECT {', '.join('c.' + k for k in ks)}, c.field_id, o.object_id FROM ch1 c JOIN {src} o ON {on('c', 'o')} AND c.parent_id = o.object_id),
 chain AS (SELECT {keys}, field_id, object_id, 0 AS cpos FROM ch0 UNION ALL SELECT {keys}, field_id, object_id, 1 FROM ch1 UNION ALL SELECT {keys}, field_id, object_id, 2 FROM ch2),
 pooled AS (SELECT fo.*, cpos, CASE WHEN cpos IS NOT NULL THEN 0 WHEN inside THEN 1 WHEN touching THEN 2 ELSE 3 END AS pool
   FROM fo LEFT JOIN chain c ON {on('fo', 'c')} AND fo.field_id = c.field_id AND fo.object_id = c.object_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}, field_id ORDER BY pool, CASE pool WHEN 0 THEN cpos WHEN 1 THEN ow * oh ELSE dist END,
   CASE WHEN pool < 3 THEN input_ord END, object_id) AS pos FROM pooled),
 anch AS (SELECT {keys}, field_id, object_id, pos, ['A', 'B', 'C'][pos] AS label, ['primary', 'secondary', 'tertiary'][pos] AS rank, dist AS distance,
   (fx - ox) / greatest(ow, 1e-6) AS relx, (fy - oy) / greatest(oh, 1e-6) AS rely, fw / greatest(ow, 1e-6) AS relw, fh / greatest(oh, 1e-6) AS relh
   FROM ranked WHERE pos <= 3)"""


_ANCH = f"{_NEST}, {anchors_cte('nest', 'fx_page_fields', 'doc_id, page_index')}"


def page_anchors(s, sf):
    return A.field_anchors(pages.page_fields(s, sf), nested(s, sf))


add(
    "A1_containment_chain",
    lambda s, sf: A.containment_chain(pages.page_fields(s, sf), nested(s, sf)).select("doc_id", "field_id", "object_id", "pos"),
    f"WITH {_ANCH} SELECT doc_id, field_id, object_id, cpos AS pos FROM chain",
    _AF,
)
add(
    "A2_fill_anchors",
    lambda s, sf: A.fill_anchors(pages.page_fields(s, sf), nested(s, sf)).select("doc_id", "field_id", "object_id", "pos"),
    f"WITH {_ANCH} SELECT doc_id, field_id, object_id, pos FROM anch",
    _AF,
)
add(
    "A3_field_anchors",
    lambda s, sf: page_anchors(s, sf).select("doc_id", "field_id", "object_id", "label", "rank", rnd(F.col("distance")).alias("distance"), *rect_cols("r", F.col("rel"))),
    f"""WITH {_ANCH} SELECT doc_id, field_id, object_id, label, rank, {r6('distance', 'distance')}, {r6('relx', 'rx')}, {r6('rely', 'ry')}, {r6('relw', 'rw')}, {r6('relh', 'rh')} FROM anch""",
    _AF,
)
add(
    "A4_border_anchors",
    lambda s, sf: A.border_anchors(pages.page_fields(s, sf), pages.frames(s, sf)).select(
        "doc_id", "field_id", *rect_cols("r", F.col("refined_rel")), rnd(F.col("refined_edge")).alias("re"), rnd(F.col("border_edge")).alias("be")
    ),
    f"""WITH {pages.FRAMES_SQL} SELECT p.doc_id, field_id, {r6('(p.x - cx) / greatest(cw, 1e-6)', 'rx')}, {r6('(p.y - cy) / greatest(ch, 1e-6)', 'ry')},
      {r6('p.w / greatest(cw, 1e-6)', 'rw')}, {r6('p.h / greatest(ch, 1e-6)', 'rh')}, {r6('least(p.x - cx, p.y - cy, cx + cw - (p.x + p.w), cy + ch - (p.y + p.h))', 're')},
      {r6('least(p.x, p.y, 1 - (p.x + p.w), 1 - (p.y + p.h))', 'be')} FROM fx_page_fields p JOIN frm f ON p.doc_id = f.doc_id AND p.page_index = f.page_index""",
    ("fx_page_fields", "fx_detections", "fx_surfaces"),
)
add(
    "A5_nearest_k",
    lambda s, sf: A.nearest_k(pages.page_fields(s, sf), pages.objects(s, sf).withColumn("parent_id", F.lit(None).cast("string"))).select("doc_id", "field_id", "object_id", "pos"),
    f"""SELECT f.doc_id, field_id, object_id, row_number() OVER (PARTITION BY f.doc_id, f.page_index, field_id ORDER BY {K.cdist('f.', 'o.')}, object_id) AS pos
      FROM fx_page_fields f JOIN fx_objects o ON f.doc_id = o.doc_id AND f.page_index = o.page_index QUALIFY pos <= 3""",
    _AF,
)
add(
    "A5_contained_by",
    lambda s, sf: A.contained_by(pages.page_fields(s, sf), nested(s, sf)).select("doc_id", "field_id", "contained_by", *rect_cols("p", F.col("position"))),
    f"""WITH {_ANCH} SELECT f.doc_id, f.field_id, c.object_id AS contained_by, {r6('(fx - ox) / greatest(ow, 1e-6)', 'px')}, {r6('(fy - oy) / greatest(oh, 1e-6)', 'py')},
      {r6('fw / greatest(ow, 1e-6)', 'pw')}, {r6('fh / greatest(oh, 1e-6)', 'ph')} FROM fx_page_fields f LEFT JOIN ch0 c ON f.doc_id = c.doc_id AND f.page_index = c.page_index AND f.field_id = c.field_id""",
    _AF,
)
add(
    "A6_anchor_graph",
    lambda s, sf: A.anchor_graph(cut(page_anchors(s, sf)), boxes.relation_graph(nested(s, sf))).select("doc_id", "field_id", "from_label", "to_label", "from_id", "to_id", "kind", "fallback_order"),
    f"""WITH {_ANCH}, {pages.relations_cte('nest')} SELECT a.doc_id, a.field_id, a.label AS from_label, b.label AS to_label, from_id, to_id, kind, fallback_order
      FROM relg r JOIN anch a ON r.doc_id = a.doc_id AND r.from_id = a.object_id JOIN anch b ON r.doc_id = b.doc_id AND r.to_id = b.object_id AND a.field_id = b.field_id""",
    _AF,
)


def _geometry_rows(s, sf):
    return fx("fx_geometry")(s, sf).select("geometry_id", "field_id", "ord", R.pack().alias("bbox"))


def _geometry_upsert(s, sf):
    old = A.build_geometry(_geometry_rows(s, sf).where(F.col("ord") <= 2), "2024-01-01T00:00:00.000Z")
    moved = _geometry_rows(s, sf).where(F.col("ord") >= 2).withColumn("bbox", R.make(F.col("bbox.x") + 0.01, F.col("bbox.y"), F.col("bbox.w"), F.col("bbox.h")))
    new = A.build_geometry(moved.withColumn("ord", F.col("ord") + 5), "2024-02-01T00:00:00.000Z", "reviewer")
    both = A.upsert_geometry(old, new, ["geometry_id", "field_id"])
    gone = old.where((F.col("field_id") == "f1") & (F.col("bbox.y") < 0.065))
    return A.remove_fields(both, gone, ["geometry_id", "field_id"]).select("geometry_id", "field_id", "ord", "confirmed_at", "confirmed_by", rnd(F.col("bbox.x")).alias("x"))


add(
    "A7_geometry_upsert",
    _geometry_upsert,
    f"""SELECT geometry_id, field_id, CASE ord WHEN 3 THEN 8 ELSE ord END AS ord, CASE WHEN ord >= 2 THEN '2024-02-01T00:00:00.000Z' ELSE '2024-01-01T00:00:00.000Z' END AS confirmed_at,
      CASE WHEN ord >= 2 THEN 'reviewer' ELSE 'user' END AS confirmed_by, {r6("CASE WHEN ord >= 2 THEN x + 0.01::DOUBLE ELSE x END", "x")} FROM fx_geometry WHERE NOT (field_id = 'f1' AND y < 0.065::DOUBLE)""",
    ("fx_geometry",),
)
add(
    "A8_normalize_fields",
    lambda s, sf: A.normalize_fields(
        fixtures.table(s, sf, "orders").select(
            F.concat(F.lit(" w"), "o_custkey", F.lit(" ")).alias("wizard_id"), F.col("o_orderkey").alias("ord"),
            F.when(F.col("o_orderstatus") == "F", F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("field_id"),
            F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat("o_orderstatus", F.lit("  "))).alias("label"),
        )
    ),
    """WITH n AS (SELECT concat('w', o_custkey) AS wizard_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderstatus, o_orderpriority FROM orders)
      SELECT wizard_id, ord, CASE WHEN o_orderstatus = 'F' THEN concat('field_', ord) ELSE o_orderpriority END AS field_id, CASE WHEN o_orderstatus = 'P' THEN concat('Field ', ord) ELSE o_orderstatus END AS label FROM n""",
)


def _ranked_anchors(s, sf):
    tree = cut(boxes.assign_parents(boxes.collapse_trivial(pages.objects(s, sf))))
    f = pages.page_fields(s, sf)
    return A.rank_anchors(A.field_anchors(f, tree), tree, boxes.ancestors(tree), boxes.relation_graph(tree), A.contained_by(f, tree)).select(
        "doc_id", "field_id", "label", "priority", "resolve_ord"
    )


add(
    "A9_rank_anchors",
    _ranked_anchors,
    f"""WITH {K.greedy_cte("triv", "fx_objects", "doc_id, page_index", "confidence DESC, (w * h) DESC, object_id", K.trivial("k.", "o."))},
      flat AS (SELECT s.* FROM fx_objects s JOIN triv_k k ON s.doc_id = k.doc_id AND s.object_id = k.object_id), {K.parents_cte('nest', 'flat')},
      {anchors_cte('nest', 'fx_page_fields', 'doc_id, page_index')}, {pages.relations_cte('nest')}, {K.ancestors_cte('anc', 'nest')},
      pr AS (SELECT a.doc_id, a.page_index, a.field_id, a.label, CASE WHEN c.object_id IS NULL THEN 4 WHEN a.object_id = c.object_id THEN 0
        WHEN EXISTS (SELECT 1 FROM anc x WHERE x.doc_id = a.doc_id AND x.object_id = c.object_id AND x.ancestor_id = a.object_id) THEN 1
        WHEN c.parent_id IS NOT NULL AND o.parent_id = c.parent_id THEN 2
        WHEN EXISTS (SELECT 1 FROM relg g WHERE g.doc_id = a.doc_id AND g.from_id = c.object_id AND g.to_id = a.object_id AND g.kind = 'adjacent') THEN 3 ELSE 4 END AS priority
       FROM anch a LEFT JOIN ch0 c ON a.doc_id = c.doc_id AND a.field_id = c.field_id JOIN nest o ON o.doc_id = a.doc_id AND o.object_id = a.object_id)
      SELECT doc_id, field_id, label, priority, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY priority, label) - 1 AS resolve_ord FROM pr""",
    _AF,
)


# ------------------------------------------------------------------ template and documents
_STORED: dict = {}


def stored(build):
    """Template artifacts are captured once per session and read back by every query, as a deployed
    template would be; document data is never kept."""

    @functools.wraps(build)
    def get(s, sf):
        key = (s.sparkContext.applicationId, sf, build.__name__)
        if key not in _STORED:
            _STORED[key] = cut(build(s, sf))
        return _STORED[key]

    return get


@stored
def template_tree(s, sf):
    t = fx("fx_template")(s, sf).select(*TPL, "object_id", "input_ord", R.pack().alias("rect"), "confidence")
    return boxes.assign_parents(t, TPL)


def tmpl(s, sf):
    return template_tree(s, sf).select(*TPL, F.col("object_id").alias("config_id"), F.col("rect").alias("c"), F.col("parent_id").alias("c_parent"))


def runtime_tree(s, sf):
    r = fx("fx_runtime")(s, sf).select("doc_id", *TPL, "object_id", "input_ord", R.pack().alias("rect"), "confidence")
    return boxes.assign_parents(r, PAGE)


def rt(s, sf):
    return runtime_tree(s, sf).select("doc_id", *TPL, F.col("object_id").alias("runtime_id"), F.col("rect").alias("r"), F.col("parent_id").alias("r_parent"))


def rt_flat(s, sf):
    return fx("fx_runtime")(s, sf).select("doc_id", *TPL, F.col("object_id").alias("runtime_id"), R.pack().alias("r"))


def tmpl_flat(s, sf):
    return fx("fx_template")(s, sf).select(*TPL, F.col("object_id").alias("config_id"), R.pack().alias("c"))


@stored
def tmpl_frames(s, sf):
    f = tmpl_flat(s, sf).groupBy(*TPL).agg(R.union_agg(F.col("c")).alias("c_cv"))
    return f.select(*TPL, F.col("c_cv").alias("c_refined"), "c_cv", F.lit("cv-content").alias("c_source"), R.full_page().alias("c_border"))


def rt_frames(s, sf, objects=None):
    """Documents of a few customers have no usable content and fall back to the full page."""
    f = (rt_flat(s, sf) if objects is None else objects).groupBy(*PAGE).agg(R.union_agg(F.col("r")).alias("_u"))
    full = F.col("doc_id") % 10 == 3
    frame = F.when(full, R.full_page()).otherwise(F.col("_u"))
    return f.select(
        *PAGE, frame.alias("r_refined"), frame.alias("r_cv"), F.when(full, F.lit("full-page-fallback")).otherwise(F.lit("cv-content")).alias("r_source"), R.full_page().alias("r_border")
    )


def docs(s, sf):
    return rt_flat(s, sf).select(*KEYS).distinct()


FORM_SQL = f"""tfr AS (SELECT template_id, page_index, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM fx_template GROUP BY 1, 2),
 rfr AS (SELECT doc_id, page_index, template_id, doc_id % 10 = 3 AS fallback, CASE WHEN doc_id % 10 = 3 THEN 0.0::DOUBLE ELSE min(x) END AS x, CASE WHEN doc_id % 10 = 3 THEN 0.0::DOUBLE ELSE min(y) END AS y,
   CASE WHEN doc_id % 10 = 3 THEN 1.0::DOUBLE ELSE max(x + w) - min(x) END AS w, CASE WHEN doc_id % 10 = 3 THEN 1.0::DOUBLE ELSE max(y + h) - min(y) END AS h FROM fx_runtime GROUP BY 1, 2, 3)"""
_TN, _RN = K.parents_cte("tn", "fx_template", "template_id, page_index"), K.parents_cte("rn", "fx_runtime", "doc_id, page_index")
_FRM = ("fx_template", "fx_runtime")


def _pos(c, r):
    return clamp01(f"1.0::DOUBLE - {K.cdist(c, r)} / 0.7::DOUBLE")


_BORDER = clamp01(
    "1.0::DOUBLE - (abs((c.x - cf.x) / cf.w - (r.x - rf.x) / rf.w) + abs((c.y - cf.y) / cf.h - (r.y - rf.y) / rf.h) + abs(c.w / cf.w - r.w / rf.w) + abs(c.h / cf.h - r.h / rf.h)) / 4.0::DOUBLE"
)
PAIRS_SQL = f"""{FORM_SQL}, {_TN}, {_RN},
 pairs AS (SELECT r.doc_id, r.template_id, r.page_index, c.object_id AS config_id, r.object_id AS runtime_id, c.parent_id AS c_parent, r.parent_id AS r_parent,
   c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh,
   {_pos('c.', 'r.')} AS s_position, {clamp01('1.0::DOUBLE - ' + K.size_delta('c.', 'r.'))} AS s_size, {clamp01(K.aspect_parity('c.', 'r.'))} AS s_aspect, {_BORDER} AS s_border
   FROM tn c JOIN rn r ON c.template_id = r.template_id AND c.page_index = r.page_index JOIN tfr cf ON cf.template_id = c.template_id AND cf.page_index = c.page_index
   JOIN rfr rf ON rf.doc_id = r.doc_id AND rf.page_index = r.page_index)"""
_FLOORS = "s_size >= 0.5::DOUBLE AND s_aspect >= 0.7::DOUBLE AND greatest(s_position, s_border) >= 0.55::DOUBLE"


def pairs(s, sf):
    return M.sim_components(M.candidates(*M.with_frames(tmpl(s, sf), rt(s, sf), tmpl_frames(s, sf), rt_frames(s, sf))))


ID = ["doc_id", "config_id", "runtime_id"]
add(
    "M1_candidates",
    lambda s, sf: M.candidates(tmpl_flat(s, sf), rt_flat(s, sf)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_pairs")),
    "SELECT r.doc_id, r.template_id, r.page_index, count(*) AS n_pairs FROM fx_template c JOIN fx_runtime r ON c.template_id = r.template_id AND c.page_index = r.page_index GROUP BY 1, 2, 3",
    _FRM,
)
add(
    "M2_sim_components",
    lambda s, sf: pairs(s, sf).select(*ID, *[rnd(F.col(k)).alias(k) for k in ("s_position", "s_size", "s_aspect")]),
    f"WITH {PAIRS_SQL} SELECT doc_id, config_id, runtime_id, {r6('s_position', 's_position')}, {r6('s_size', 's_size')}, {r6('s_aspect', 's_aspect')} FROM pairs",
    _FRM,
)
add(
    "M3_sim_border_relation",
    lambda s, sf: pairs(s, sf).select(*ID, rnd(F.col("s_border")).alias("s_border")),
    f"WITH {PAIRS_SQL} SELECT doc_id, config_id, runtime_id, {r6('s_border', 's_border')} FROM pairs",
    _FRM,
)

# Matches by equal part number; displaced and badly resized objects stay in as outliers.
fixtures.SQL["fx_matches"] = """
SELECT doc_id, template_id, page_index, config_id, runtime_id, CAST(60 + CAST(floor(cx * 1000 + doc_id) AS BIGINT) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
 CASE WHEN doc_id % 4 = 0 THEN 'object-similarity' ELSE 'parent-chain' END AS tag, cx, cy, cw, ch, rx, ry, rw, rh
FROM (__fx_pairs__) AS p"""


def matches(s, sf):
    m = fx("fx_matches")(s, sf)
    c, r = R.make(*[F.col(f"c{k}") for k in "xywh"]), R.make(*[F.col(f"r{k}") for k in "xywh"])
    return m.select(*KEYS, "config_id", "runtime_id", "confidence", F.array("tag").alias("basis"), R.affine_from_rects(c, r).alias("affine"), c.alias("c"), r.alias("r"))


def weighted(s, sf):
    return C.with_weight(matches(s, sf))


def inliers(s, sf):
    return C.max_inlier(weighted(s, sf))


_SX, _SY = "(rw / cw)", "(rh / ch)"
WEIGHTED_SQL = f"wm AS (SELECT *, {_SX} AS sx, {_SY} AS sy, rx - cx * {_SX} AS tx, ry - cy * {_SY} AS ty, greatest(1e-6, confidence * confidence) AS weight FROM fx_matches)"
_DIST_S, _DIST_T = "greatest(abs(a.sx - b.sx), abs(a.sy - b.sy))", "greatest(abs(a.tx - b.tx), abs(a.ty - b.ty))"
CONSENSUS_SQL = f"""{WEIGHTED_SQL},
 sd AS (SELECT b.doc_id, b.page_index, b.template_id, b.config_id AS seed_id, any_value(b.sx) AS sx, any_value(b.sy) AS sy, any_value(b.tx) AS tx, any_value(b.ty) AS ty,
   count(*) AS n_kept, round(sum(a.weight), 9) AS kept_weight FROM wm a JOIN wm b ON a.doc_id = b.doc_id AND a.page_index = b.page_index
   AND {_DIST_S} <= 0.1::DOUBLE AND {_DIST_T} <= 0.06::DOUBLE GROUP BY 1, 2, 3, 4),
 sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n_kept DESC, kept_weight DESC, seed_id) AS seed_rank FROM sd),
 inl AS (SELECT a.*, b.seed_id, {_DIST_S} AS scale_dev, {_DIST_T} AS translate_dev, {_DIST_S} <= 0.1::DOUBLE AND {_DIST_T} <= 0.06::DOUBLE AS kept
   FROM wm a JOIN sr b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND b.seed_rank = 1),
 mn AS (SELECT doc_id, page_index, template_id, any_value(seed_id) AS seed_id, sum(weight * sx) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS msx, sum(weight * sy) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS msy,
   sum(weight * tx) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS mtx, sum(weight * ty) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS mty FROM inl GROUP BY 1, 2, 3),
 proj AS (SELECT i.*, m.msx, m.msy, m.mtx, m.mty, cx * msx + mtx AS px, cy * msy + mty AS py, cw * msx AS pw, ch * msy AS ph FROM inl i JOIN mn m ON i.doc_id = m.doc_id AND i.page_index = m.page_index),
 agg AS (SELECT doc_id, template_id, page_index, any_value(seed_id) AS seed_id, any_value(msx) AS msx, any_value(msy) AS msy, any_value(mtx) AS mtx, any_value(mty) AS mty, count_if(kept) AS n_matches, count(*) AS n_all,
   sum(weight * confidence) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS mean_confidence, sum(weight * {K.iou_t('p', 'r')}) FILTER (WHERE kept) / sum(weight) FILTER (WHERE kept) AS agreement,
   sum(weight) FILTER (WHERE kept) / sum(weight) AS coverage FROM proj GROUP BY 1, 2, 3),
 cons AS (SELECT *, {clamp01('mean_confidence * (0.4::DOUBLE + 0.3::DOUBLE * coverage + 0.3::DOUBLE * agreement)')} AS confidence FROM agg)"""
_MX = ("fx_matches",)

_PARENT_SQL = f"""{PAIRS_SQL}, {K.ancestors_cte('ta', 'tn', 'template_id, page_index')}, {K.ancestors_cte('ra', 'rn', 'doc_id, page_index')},
 ev AS (SELECT m.doc_id, m.page_index, a.object_id AS config_id, b.object_id AS runtime_id, max(CASE WHEN a.distance = b.distance THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - abs(a.distance - b.distance) / CAST(greatest(a.distance, b.distance) AS DOUBLE) END) AS v
   FROM fx_matches m JOIN ta a ON a.template_id = m.template_id AND a.page_index = m.page_index AND a.ancestor_id = m.config_id
   JOIN ra b ON b.doc_id = m.doc_id AND b.page_index = m.page_index AND b.ancestor_id = m.runtime_id WHERE abs(a.distance - b.distance) <= 4 GROUP BY 1, 2, 3, 4),
 pp AS (SELECT p.*, CASE WHEN c_parent IS NULL AND r_parent IS NULL THEN 1.0::DOUBLE WHEN c_parent IS NULL OR r_parent IS NULL THEN 0.0::DOUBLE ELSE coalesce(v, 0.0::DOUBLE) END AS s_parent
   FROM pairs p LEFT JOIN ev ON p.doc_id = ev.doc_id AND p.page_index = ev.page_index AND p.config_id = ev.config_id AND p.runtime_id = ev.runtime_id),
 sc AS (SELECT *, CASE WHEN {_FLOORS} THEN {clamp01('0.15::DOUBLE * s_position + 0.2::DOUBLE * s_size + 0.1::DOUBLE * s_aspect + 0.25::DOUBLE * s_parent + 0.3::DOUBLE * s_border')} ELSE 0.0::DOUBLE END AS score,
   CASE WHEN {_FLOORS} THEN {clamp01('0.3::DOUBLE * s_position + 0.2::DOUBLE * s_size + 0.1::DOUBLE * s_aspect + 0.25::DOUBLE * s_parent + 0.15::DOUBLE * s_border')} ELSE 0.0::DOUBLE END AS score_same FROM pp)"""
_FM = ("fx_template", "fx_runtime", "fx_matches")


@stored
def chains_c(s, sf):
    return boxes.ancestors(template_tree(s, sf), TPL)


def with_parent(s, sf):
    tt, rr = template_tree(s, sf), cut(runtime_tree(s, sf))
    t = tt.select(*TPL, F.col("object_id").alias("config_id"), F.col("rect").alias("c"), F.col("parent_id").alias("c_parent"))
    r = rr.select("doc_id", *TPL, F.col("object_id").alias("runtime_id"), F.col("rect").alias("r"), F.col("parent_id").alias("r_parent"))
    sides = chains_c(s, sf).withColumnRenamed("object_id", "config_id"), boxes.ancestors(rr, PAGE).withColumnRenamed("object_id", "runtime_id")
    r = M.parent_evidence(r, *sides, matches(s, sf))
    return M.parent_chain(M.sim_components(M.candidates(*M.with_frames(t, r, tmpl_frames(s, sf), rt_frames(s, sf)))))


add(
    "M4_parent_chain",
    lambda s, sf: with_parent(s, sf).select(*ID, rnd(F.col("s_parent")).alias("s_parent")),
    f"WITH {_PARENT_SQL} SELECT doc_id, config_id, runtime_id, {r6('s_parent', 's_parent')} FROM pp",
    _FM,
)
add(
    "M5_apply_floors",
    lambda s, sf: pairs(s, sf).where(~M.passes_floors()).select(*ID, F.size(M.floor_notes()).alias("n_notes")),
    f"""WITH {PAIRS_SQL} SELECT doc_id, config_id, runtime_id, CAST(s_size < 0.5::DOUBLE AS INT) + CAST(s_aspect < 0.7::DOUBLE AS INT) + CAST(greatest(s_position, s_border) < 0.55::DOUBLE AS INT) AS n_notes
      FROM pairs WHERE NOT ({_FLOORS})""",
    _FRM,
)
add(
    "M6_score",
    lambda s, sf: M.score(M.score(with_parent(s, sf), M.SAME_DOCUMENT).withColumnRenamed("score", "score_same"), M.CROSS_DOCUMENT).select(
        *ID, rnd(F.col("score")).alias("score"), rnd(F.col("score_same")).alias("score_same")
    ),
    f"WITH {_PARENT_SQL} SELECT doc_id, config_id, runtime_id, {r6('score', 'score')}, {r6('score_same', 'score_same')} FROM sc",
    _FM,
)
add(
    "M7_basis_tags",
    lambda s, sf: M.score(with_parent(s, sf), M.CROSS_DOCUMENT).where(F.col("score") > 0).select(
        *ID, F.array_join(M.basis_tags(), ",").alias("basis"), F.size(M.similarity_notes()).alias("n_notes")
    ),
    f"""WITH {_PARENT_SQL} SELECT doc_id, config_id, runtime_id, concat_ws(',', CASE WHEN s_position >= 0.5 OR s_size >= 0.5 OR s_aspect >= 0.5 THEN 'object-similarity' END,
      CASE WHEN s_parent > 0 THEN 'parent-chain' END, CASE WHEN s_border >= 0.5 THEN 'refined-border-relation' END) AS basis, CAST(s_position < 0.4 AS INT) + CAST(s_size < 0.4 AS INT) AS n_notes FROM sc WHERE score > 0""",
    _FM,
)


# ------------------------------------------------------------------ assignment
def root_scores(s, sf):
    """Scores of all pairs as if both were roots: a dense contest for the assignment."""
    p = M.sim_components(M.candidates(*M.with_frames(tmpl_flat(s, sf), rt_flat(s, sf), tmpl_frames(s, sf), rt_frames(s, sf))))
    p = p.where(M.passes_floors()).withColumn("s_parent", R.lit(1))
    return p.withColumn("score", F.round(M.weighted_score(M.CROSS_DOCUMENT, F.col("s_parent")), 9))


_ROOT_SQL = f"""{PAIRS_SQL}, rs AS MATERIALIZED (SELECT doc_id, template_id, page_index, config_id, runtime_id, cx, cy, cw, ch, rx, ry, rw, rh, round({clamp01('0.15::DOUBLE * s_position + 0.2::DOUBLE * s_size + 0.1::DOUBLE * s_aspect + 0.25::DOUBLE + 0.3::DOUBLE * s_border')}, 9) AS score
   FROM pairs WHERE {_FLOORS})"""
_GREEDY_SQL = f"""{_ROOT_SQL}, go AS (SELECT doc_id, list([config_id, runtime_id] ORDER BY score DESC, config_id, runtime_id) AS ps FROM rs WHERE score >= 0.75::DOUBLE GROUP BY 1),
 gr AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k[1] = x[1][1] OR k[2] = x[1][2])) > 0 THEN acc ELSE list_concat(acc, x) END) AS chosen FROM go),
 gd AS (SELECT doc_id, unnest(chosen) AS p FROM gr)"""
add(
    "M9_assign_greedy",
    lambda s, sf: M.assign_greedy(root_scores(s, sf), PAGE, 0.75).select("doc_id", "config_id", "runtime_id"),
    f"WITH {_GREEDY_SQL} SELECT doc_id, p[1] AS config_id, p[2] AS runtime_id FROM gd",
    _FRM,
)
add("M10_assign_optimal", lambda s, sf: M.assign_optimal(root_scores(s, sf), PAGE, 0.75).select("doc_id", "config_id", "runtime_id", rnd(F.col("score")).alias("score")))
add(
    "M12_flag_ambiguous",
    lambda s, sf: M.flag_ambiguous(M.rivals(root_scores(s, sf), PAGE), 0.02).select(*ID, "rival_id", rnd(F.col("confidence")).alias("confidence"), F.size("warnings").alias("n_warnings")),
    f"""WITH {_ROOT_SQL}, rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, config_id ORDER BY score DESC, runtime_id) AS n FROM rs),
      rv AS (SELECT a.*, b.runtime_id AS rival_id, b.score AS rival_score FROM rk a LEFT JOIN rk b ON a.doc_id = b.doc_id AND a.config_id = b.config_id AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END)
      SELECT doc_id, config_id, runtime_id, rival_id, {r6("CASE WHEN abs(score - rival_score) < 0.02::DOUBLE THEN score * 0.85::DOUBLE ELSE score END", "confidence")},
      CASE WHEN abs(score - rival_score) < 0.02::DOUBLE THEN 1 ELSE 0 END AS n_warnings FROM rv""",
    _FRM,
)


def matched(s, sf, opts=M.MatchOptions()):
    t, r = tmpl(s, sf), cut(rt(s, sf))
    anch = template_anchors(s, sf)
    return M.match_pages(t, r, tmpl_frames(s, sf), rt_frames(s, sf), opts, M.priority_ids(anch))


add("M8_match_pages", lambda s, sf: matched(s, sf).select("doc_id", "config_id", "runtime_id", rnd(F.col("confidence")).alias("confidence"), "pass"))


def _recovery(s, sf):
    opts = M.MatchOptions(min_global=0.97)
    return M.recover_pairs(root_scores(s, sf), opts).select("doc_id", "config_id", "runtime_id", rnd(F.col("score")).alias("score"))


add(
    "M13_recover_pairs",
    _recovery,
    f"""WITH {_ROOT_SQL}, best AS (SELECT a.*, (SELECT max(b.score) FROM rs b WHERE b.doc_id = a.doc_id AND b.config_id = a.config_id AND b.runtime_id <> a.runtime_id) AS oc,
      (SELECT max(b.score) FROM rs b WHERE b.doc_id = a.doc_id AND b.runtime_id = a.runtime_id AND b.config_id <> a.config_id) AS orr FROM rs a)
      SELECT doc_id, config_id, runtime_id, {r6('score', 'score')} FROM best WHERE score >= 0.97::DOUBLE - 0.05::DOUBLE AND (oc IS NULL OR score - oc >= 0.05::DOUBLE) AND (orr IS NULL OR score - orr >= 0.05::DOUBLE)""",
    _FRM,
)


# ------------------------------------------------------------------ template anchors
def geometry(s, sf):
    return fx("fx_geometry")(s, sf).select(*TPL, "field_id", F.col("ord").alias("field_ord"), "geometry_id", R.pack().alias("bbox"))


@stored
def template_anchors(s, sf):
    return A.field_anchors(geometry(s, sf), template_tree(s, sf), TPL)


@stored
def template_borders(s, sf):
    f = tmpl_frames(s, sf).select(*TPL, F.col("c_cv").alias("cv_content"), F.col("c_border").alias("border"))
    return A.border_anchors(geometry(s, sf), f, TPL)


TANCH_SQL = f"{_TN}, {anchors_cte('tn', 'fx_geometry', 'template_id, page_index')}"
_TG = ("fx_template", "fx_geometry")
add(
    "M11_priority_ids",
    lambda s, sf: M.priority_ids(template_anchors(s, sf)),
    f"WITH {TANCH_SQL} SELECT DISTINCT template_id, page_index, object_id AS config_id, true AS priority FROM anch WHERE pos <= 2",
    _TG,
)
add(
    "M14_match_affine",
    lambda s, sf: matches(s, sf).select(*ID, *[rnd(F.col(f"affine.{k}")).alias(k) for k in AFF]),
    f"WITH {WEIGHTED_SQL} SELECT doc_id, config_id, runtime_id, {r6('sx', 'sx')}, {r6('sy', 'sy')}, {r6('tx', 'tx')}, {r6('ty', 'ty')} FROM wm",
    _MX,
)
def _well_sized(s, sf):
    """For the unmatched case: badly resized objects have no match."""
    return matches(s, sf).where(F.col("r.w") * 2 >= F.col("c.w"))


add(
    "M15_unmatched",
    lambda s, sf: M.unmatched_config(tmpl_flat(s, sf), docs(s, sf), _well_sized(s, sf)).select("doc_id", F.lit("config").alias("side"), F.col("config_id").alias("object_id")).union(
        M.unmatched_runtime(rt_flat(s, sf), _well_sized(s, sf)).select("doc_id", F.lit("runtime"), "runtime_id")
    ),
    """SELECT p.doc_id, 'config' AS side, p.config_id AS object_id FROM fx_pairs p WHERE NOT EXISTS (SELECT 1 FROM fx_matches m WHERE m.doc_id = p.doc_id AND m.config_id = p.config_id AND m.rw * 2 >= m.cw)
      UNION ALL SELECT r.doc_id, 'runtime', r.object_id FROM fx_runtime r WHERE NOT EXISTS (SELECT 1 FROM fx_matches m WHERE m.doc_id = r.doc_id AND m.runtime_id = r.object_id AND m.rw * 2 >= m.cw)""",
    ("fx_pairs", "fx_matches", "fx_runtime"),
)


def _anchor_recovery(s, sf):
    """Anchors lose their matches; the consensus of the others brings them back."""
    ta = cut(template_anchors(s, sf).join(geometry(s, sf).select(*TPL, "field_id", "field_ord"), TPL + ["field_id"]))
    m = matches(s, sf).join(ta.select(*TPL, F.col("object_id").alias("config_id")).distinct(), TPL + ["config_id"], "left_anti")
    cons = C.consensus(C.max_inlier(C.with_weight(m)))
    free = rt_flat(s, sf).join(m.select(*PAGE, "runtime_id"), PAGE + ["runtime_id"], "left_anti")
    return M.recover_anchors(ta, tmpl_flat(s, sf), free, m, cons).select("doc_id", "config_id", "runtime_id", "confidence", rnd(F.col("score")).alias("iou"))


add("M16_recover_anchors", _anchor_recovery)
add(
    "M17_page_coverage",
    lambda s, sf: M.page_coverage(
        fx("fx_geometry")(s, sf).select("template_id", (F.col("ord") - 1).alias("page_index")), fx("fx_surfaces")(s, sf).select("doc_id", F.floor(F.col("doc_id") / 15).alias("template_id"), (F.col("page_index") * 3).alias("page_index"))
    ),
    """SELECT c_custkey AS doc_id, CAST(floor(c_custkey / 15) AS BIGINT) AS template_id, p AS page_index, CASE p WHEN 3 THEN 'document' ELSE 'page' END AS scope,
      CASE p WHEN 3 THEN 'runtime page 3 has no matching page in the config model' ELSE concat('runtime model has no page with pageIndex ', p) END AS warning
      FROM customer JOIN (VALUES (1), (2), (3)) AS t(p) ON p > 0""",
)
add(
    "M18_empty_report",
    lambda s, sf: M.empty_report(tmpl_flat(s, sf), rt_flat(s, sf), docs(s, sf)).drop("affine"),
    """SELECT doc_id, template_id, page_index, n AS n_unmatched_config, count(*) AS n_unmatched_runtime, 0 AS n_matches, CAST(0 AS DOUBLE) AS confidence FROM fx_runtime r
      JOIN (SELECT template_id AS t, page_index AS p, count(*) AS n FROM fx_template GROUP BY 1, 2) c ON r.template_id = c.t AND r.page_index = c.p GROUP BY 1, 2, 3, 4""",
    _FRM,
)

# ------------------------------------------------------------------ consensus
add(
    "C1_weigh",
    lambda s, sf: C.weigh(matches(s, sf), tmpl_flat(s, sf), rt_flat(s, sf)).select(*ID, rnd(F.col("weight")).alias("weight")),
    f"WITH {WEIGHTED_SQL} SELECT doc_id, config_id, runtime_id, {r6('weight', 'weight')} FROM wm",
    _MX,
)
add(
    "C2_max_inlier",
    lambda s, sf: inliers(s, sf).select("doc_id", "config_id", "seed_id", "kept"),
    f"WITH {CONSENSUS_SQL} SELECT doc_id, config_id, seed_id, kept FROM inl",
    _MX,
)
add(
    "C2_seeds",
    lambda s, sf: C.seeds(weighted(s, sf)).select("doc_id", "seed_id", "n_kept", rnd(F.col("kept_weight")).alias("kept_weight"), "seed_rank"),
    f"WITH {CONSENSUS_SQL} SELECT doc_id, seed_id, n_kept, {r6('kept_weight', 'kept_weight')}, seed_rank FROM sr",
    _MX,
)
add(
    "C3_weighted_affine",
    lambda s, sf: C.weighted_affine(inliers(s, sf)).select("doc_id", *[rnd(F.col(f"affine.{k}")).alias(k) for k in AFF], rnd(F.col("mean_confidence")).alias("mean_confidence")),
    f"WITH {CONSENSUS_SQL} SELECT doc_id, {r6('msx', 'sx')}, {r6('msy', 'sy')}, {r6('mtx', 'tx')}, {r6('mty', 'ty')}, {r6('mean_confidence', 'mean_confidence')} FROM agg",
    _MX,
)
add(
    "C4_projection_agreement",
    lambda s, sf: C.projection_agreement(inliers(s, sf)).select("doc_id", rnd(F.col("agreement")).alias("agreement")),
    f"WITH {CONSENSUS_SQL} SELECT doc_id, {r6('agreement', 'agreement')} FROM agg",
    _MX,
)
add(
    "C5_consensus",
    lambda s, sf: C.consensus(inliers(s, sf)).select("doc_id", rnd(F.col("confidence")).alias("confidence"), "n_matches", "n_outliers", "seed_id", rnd(F.col("affine.tx")).alias("tx"), F.size("warnings").alias("n_warnings")),
    f"""WITH {CONSENSUS_SQL} SELECT doc_id, {r6('confidence', 'confidence')}, n_matches, n_all - n_matches AS n_outliers, seed_id, {r6('mtx', 'tx')},
      CAST(n_all > n_matches AS INT) + CAST(n_matches = 1 AS INT) + CAST(agreement < 0.5 AS INT) AS n_warnings FROM cons""",
    _MX,
)
add(
    "C6_outliers",
    lambda s, sf: C.outliers(inliers(s, sf)).select("doc_id", "config_id", "reason", *[rnd(F.col(f"delta.{k}")).alias(k) for k in AFF]),
    f"""WITH {CONSENSUS_SQL} SELECT doc_id, config_id, CASE WHEN scale_dev > 0.1::DOUBLE THEN concat('scale deviation ', format('{{:.3f}}', scale_dev), ' exceeds tolerance 0.100') ELSE
      concat('translate deviation ', format('{{:.3f}}', translate_dev), ' exceeds tolerance 0.060') END || concat(' from inlier set seeded by ', seed_id) AS reason,
      {r6('sx - msx', 'sx')}, {r6('sy - msy', 'sy')}, {r6('tx - mtx', 'tx')}, {r6('ty - mty', 'ty')} FROM proj WHERE NOT kept""",
    _MX,
)
add(
    "C7_local_transforms",
    lambda s, sf: C.local_transforms(weighted(s, sf)).select("doc_id", F.explode("local").alias("config_id", "_a")).select("doc_id", "config_id", *[rnd(F.col(f"_a.{k}")).alias(k) for k in AFF]),
    f"WITH {WEIGHTED_SQL} SELECT doc_id, config_id, {r6('sx', 'sx')}, {r6('sy', 'sy')}, {r6('tx', 'tx')}, {r6('ty', 'ty')} FROM wm",
    _MX,
)


def _regional(s, sf):
    """Documents seen in their own consensus frame: the page stands still, the displaced objects do not."""
    i = inliers(s, sf)
    own = i.withColumn("affine", R.make_affine(F.col("affine.sx"), F.col("affine.sy"), F.col("affine.tx") - F.col("mean_affine.tx"), F.col("affine.ty") - F.col("mean_affine.ty")))
    w = cut(own.select(*KEYS, "config_id", "runtime_id", "confidence", "basis", "affine", "c", "r", "weight"))
    return C.regional_transforms(w, C.max_inlier(w)).select("doc_id", "seed_id", "n_kept", *[rnd(F.col(f"affine.{k}")).alias(k) for k in AFF])


# The consensus steps once more, over affines that have lost the page's mean shift.
_OWN_STEPS = re.sub(r"\b(wm|sd|sr|inl|mn|proj|agg|cons)\b", r"\1_own", CONSENSUS_SQL[len(WEIGHTED_SQL) + 1 :])
_STILL = " AND ".join(f"abs({a} - {b}) <= 0.005::DOUBLE" for a, b in (("{p}sx", "1"), ("{p}sy", "1"), ("{p}tx", "0"), ("{p}ty", "0")))
_REFINED = ", ".join(f"sum(a.weight * a.{k}) / sum(a.weight) AS r{k}" for k in AFF)
add(
    "C8_regional_transforms",
    _regional,
    f"""WITH {CONSENSUS_SQL},
     wm_own AS (SELECT w.* EXCLUDE (tx, ty), w.tx - m.mtx AS tx, w.ty - m.mty AS ty FROM wm w JOIN mn m ON w.doc_id = m.doc_id AND w.page_index = m.page_index), {_OWN_STEPS},
     cl AS MATERIALIZED (SELECT b.doc_id, b.page_index, b.seed_rank, b.seed_id AS object_id, b.n_kept, b.sx AS x, b.sy AS y, b.tx AS w, b.ty AS h, {_REFINED}
       FROM sr_own b JOIN mn_own m ON b.doc_id = m.doc_id AND b.page_index = m.page_index AND {_STILL.format(p="m.m")}
       JOIN wm_own a ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND {_DIST_S} <= 0.1::DOUBLE AND {_DIST_T} <= 0.06::DOUBLE
       WHERE b.seed_rank > 1 AND b.n_kept >= 2 GROUP BY ALL),
     cz AS MATERIALIZED (SELECT * FROM cl WHERE NOT ({_STILL.format(p="r")})),
     {K.greedy_cte("gz", "cz", "doc_id, page_index", "seed_rank", "greatest(abs(k.x - o.x), abs(k.y - o.y)) <= 0.1::DOUBLE AND greatest(abs(k.w - o.w), abs(k.h - o.h)) <= 0.06::DOUBLE")}
     SELECT c.doc_id, c.object_id AS seed_id, c.n_kept, {r6('rsx', 'sx')}, {r6('rsy', 'sy')}, {r6('rtx', 'tx')}, {r6('rty', 'ty')}
     FROM cz c JOIN gz_k k ON c.doc_id = k.doc_id AND c.page_index = k.page_index AND c.object_id = k.object_id""",
    _MX,
)
_LV = "n_matches, doc_id, level"
add(
    "C9_level_border",
    lambda s, sf: C.level_border(docs(s, sf), tmpl_frames(s, sf), rt_frames(s, sf)).select("doc_id", "level", "confidence", "n_matches", *[rnd(F.col(f"affine.{k}")).alias(k) for k in AFF]),
    "SELECT DISTINCT doc_id, 'border' AS level, CAST(1 AS DOUBLE) AS confidence, 1 AS n_matches, CAST(1 AS DOUBLE) AS sx, CAST(1 AS DOUBLE) AS sy, CAST(0 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty FROM fx_runtime",
    ("fx_runtime",),
)
add(
    "C10_level_refined",
    lambda s, sf: C.level_refined(docs(s, sf), tmpl_frames(s, sf), rt_frames(s, sf)).select("doc_id", "confidence", F.size("warnings").alias("n_warnings"), *[rnd(F.col(f"affine.{k}")).alias(k) for k in AFF]),
    f"""WITH {FORM_SQL} SELECT doc_id, CASE WHEN fallback THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS confidence, CAST(fallback AS INT) AS n_warnings, {r6('r.w / c.w', 'sx')}, {r6('r.h / c.h', 'sy')},
      {r6('r.x - c.x * (r.w / c.w)', 'tx')}, {r6('r.y - c.y * (r.h / c.h)', 'ty')} FROM rfr r JOIN tfr c ON r.template_id = c.template_id AND r.page_index = c.page_index""",
    _FRM,
)
_SUM = clamp01("mean_confidence * (0.5::DOUBLE + 0.5::DOUBLE * agreement)")
add(
    "C11_level_object",
    lambda s, sf: C.level_object(inliers(s, sf)).select("doc_id", "level", rnd(F.col("confidence")).alias("confidence"), "n_matches", rnd(F.col("affine.ty")).alias("ty")),
    f"WITH {CONSENSUS_SQL} SELECT doc_id, 'object' AS level, {r6(_SUM, 'confidence')}, n_matches, {r6('mty', 'ty')} FROM agg",
    _MX,
)
add(
    "C12_level_parent_chain",
    lambda s, sf: C.level_parent_chain(weighted(s, sf)).select("doc_id", "level", rnd(F.col("confidence")).alias("confidence"), "n_matches", rnd(F.col("affine.ty")).alias("ty")),
    f"WITH {CONSENSUS_SQL.replace('FROM fx_matches)', 'FROM fx_matches' + ' WHERE ' + 'tag = ' + chr(39) + 'parent-chain' + chr(39) + ')')} SELECT doc_id, 'parent-chain' AS level, {r6(_SUM, 'confidence')}, n_matches, {r6('mty', 'ty')} FROM agg",
    _MX,
)
add(
    "C13_overall_confidence",
    lambda s, sf: C.overall_confidence(C.consensus(inliers(s, sf)).withColumn("doc_id", F.floor(F.col("doc_id") / 2))).select("doc_id", "template_id", rnd(F.col("overall_confidence")).alias("overall_confidence")),
    f"WITH {CONSENSUS_SQL} SELECT CAST(floor(doc_id / 2) AS BIGINT) AS doc_id, template_id, {r6('sum(confidence * n_matches) / sum(n_matches)', 'overall_confidence')} FROM cons GROUP BY 1, 2",
    _MX,
)


# ------------------------------------------------------------------ candidates
def levels(s, sf):
    d_ = docs(s, sf)
    refined = C.level_refined(d_, tmpl_frames(s, sf), rt_frames(s, sf))
    border = C.level_border(d_, tmpl_frames(s, sf), rt_frames(s, sf))
    # Some documents have a border summary without a transform and get the identity fallback.
    return refined, border.withColumn("affine", F.when(F.col("doc_id") % 7 != 2, F.col("affine")))


def ordered(s, sf):
    refined, border = levels(s, sf)
    anch = template_anchors(s, sf)
    return P.field_candidates(docs(s, sf), anch, template_borders(s, sf), chains_c(s, sf), tmpl_flat(s, sf), matches(s, sf), refined, border)


CAND_SQL = f"""{TANCH_SQL}, {K.ancestors_cte('ta', 'tn', 'template_id, page_index')}, {WEIGHTED_SQL}, {FORM_SQL},
 am AS (SELECT m.doc_id, m.template_id, m.page_index, a.field_id, a.pos, a.rank, m.config_id, m.runtime_id, m.confidence AS mc, m.sx, m.sy, m.tx, m.ty, a.relx, a.rely, a.relw, a.relh
   FROM wm m JOIN anch a ON a.template_id = m.template_id AND a.page_index = m.page_index AND a.object_id = m.config_id),
 cm AS (SELECT doc_id, template_id, page_index, field_id, 'matched-object' AS source, pos AS ord, config_id, runtime_id, sx, sy, tx, ty, relx, rely, relw, relh,
   mc * CASE pos WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM am WHERE mc >= 0.7::DOUBLE),
 pm AS (SELECT m.doc_id, m.template_id, m.page_index, p.field_id, p.object_id AS primary_id, t.distance, m.config_id, m.runtime_id, m.confidence AS mc, m.sx, m.sy, m.tx, m.ty, p.relx, p.rely, p.relw, p.relh
   FROM anch p JOIN ta t ON t.template_id = p.template_id AND t.page_index = p.page_index AND t.object_id = p.object_id JOIN wm m ON m.template_id = p.template_id AND m.page_index = p.page_index AND m.config_id = t.ancestor_id WHERE p.pos = 1),
 pn AS (SELECT * FROM pm WHERE mc >= 0.7::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, field_id ORDER BY distance) = 1),
 cp AS (SELECT n.doc_id, n.template_id, n.page_index, n.field_id, 'parent-object' AS source, 10 AS ord, n.config_id, n.runtime_id, n.sx, n.sy, n.tx, n.ty,
   (o.x + n.relx * o.w - a.x) / greatest(a.w, 1e-9) AS relx, (o.y + n.rely * o.h - a.y) / greatest(a.h, 1e-9) AS rely, n.relw * o.w / greatest(a.w, 1e-9) AS relw, n.relh * o.h / greatest(a.h, 1e-9) AS relh, mc * 0.85::DOUBLE AS confidence
   FROM pn n JOIN fx_template o ON o.template_id = n.template_id AND o.object_id = n.primary_id JOIN fx_template a ON a.template_id = n.template_id AND a.object_id = n.config_id),
 cr AS (SELECT r.doc_id, r.template_id, r.page_index, g.field_id, 'refined-border' AS source, 20 AS ord, CAST(NULL AS VARCHAR) AS config_id, CAST(NULL AS VARCHAR) AS runtime_id, r.w / c.w AS sx, r.h / c.h AS sy, r.x - c.x * (r.w / c.w) AS tx, r.y - c.y * (r.h / c.h) AS ty,
   (g.x - c.x) / greatest(c.w, 1e-6) AS relx, (g.y - c.y) / greatest(c.h, 1e-6) AS rely, g.w / greatest(c.w, 1e-6) AS relw, g.h / greatest(c.h, 1e-6) AS relh, CASE WHEN fallback THEN 0.4::DOUBLE ELSE 0.95::DOUBLE END AS confidence
   FROM rfr r JOIN tfr c ON r.template_id = c.template_id AND r.page_index = c.page_index JOIN fx_geometry g ON g.template_id = r.template_id AND g.page_index = r.page_index),
 cb AS (SELECT doc_id, template_id, page_index, field_id, 'border' AS source, 30 AS ord, config_id, runtime_id, 1.0::DOUBLE AS sx, 1.0::DOUBLE AS sy, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, g.x AS relx, g.y AS rely, g.w AS relw, g.h AS relh,
   CASE WHEN doc_id % 7 = 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM cr JOIN fx_geometry g USING (template_id, page_index, field_id)),
 ca AS (SELECT * FROM cm UNION ALL SELECT * FROM cp UNION ALL SELECT * FROM cr UNION ALL SELECT * FROM cb),
 cd AS (SELECT ca.*, ca.source IN ('matched-object', 'parent-object') AND cr.confidence >= 0.7::DOUBLE AND greatest(abs(ca.sx - cr.sx), abs(ca.sy - cr.sy)) < 0.01::DOUBLE AND greatest(abs(ca.tx - cr.tx), abs(ca.ty - cr.ty)) < 0.01::DOUBLE AS demoted
   FROM ca JOIN cr ON ca.doc_id = cr.doc_id AND ca.page_index = cr.page_index AND ca.field_id = cr.field_id),
 co AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, field_id ORDER BY CASE WHEN source = 'border' THEN 3 WHEN demoted THEN 2 WHEN source = 'refined-border' THEN 1 ELSE 0 END, ord) - 1 AS fallback_order FROM cd)"""
CAND_FX = ("fx_template", "fx_runtime", "fx_geometry", "fx_matches")
_CC = f"doc_id, field_id, source, config_id, runtime_id, {r6('confidence', 'confidence')}, {r6('sx', 'sx')}, {r6('ty', 'ty')}, {r6('relx', 'relx')}, {r6('relh', 'relh')}"


def _cand_out(df, *extra):
    return df.select(
        "doc_id", "field_id", "source", "config_id", "runtime_id", rnd(F.col("confidence")).alias("confidence"), rnd(F.col("affine.sx")).alias("sx"), rnd(F.col("affine.ty")).alias("ty"),
        rnd(F.col("rel.x")).alias("relx"), rnd(F.col("rel.h")).alias("relh"), *extra
    )


add("P1_cand_matched", lambda s, sf: _cand_out(P.cand_matched(template_anchors(s, sf), matches(s, sf))), f"WITH {CAND_SQL} SELECT {_CC} FROM cm", CAND_FX)
add("P2_cand_parent", lambda s, sf: _cand_out(P.cand_parent(template_anchors(s, sf), chains_c(s, sf), tmpl_flat(s, sf), matches(s, sf))), f"WITH {CAND_SQL} SELECT {_CC} FROM cp", CAND_FX)
add(
    "P3_cand_frames",
    lambda s, sf: _cand_out(P.cand_frames(docs(s, sf), template_borders(s, sf), *levels(s, sf))),
    f"WITH {CAND_SQL}, f AS (SELECT * FROM cr UNION ALL SELECT * FROM cb) SELECT {_CC} FROM f",
    CAND_FX,
)
add("P4_order_candidates", lambda s, sf: _cand_out(ordered(s, sf), "fallback_order", "demoted"), f"WITH {CAND_SQL} SELECT {_CC}, fallback_order, demoted FROM co", CAND_FX)
add(
    "P5_candidate_warnings",
    lambda s, sf: P.candidate_warnings(ordered(s, sf), template_anchors(s, sf), chains_c(s, sf), matches(s, sf)).select("doc_id", "field_id", F.size("warnings").alias("n"), F.element_at("warnings", 1).substr(1, 24).alias("first_warning")),
    f"""WITH {CAND_SQL},
      fg AS (SELECT doc_id, field_id, min(distance) AS g FROM pm WHERE mc >= 0.7::DOUBLE GROUP BY 1, 2),
      pf AS (SELECT doc_id, field_id, count_if(ord <= 10) AS nobj, count_if(demoted) AS ndem FROM co GROUP BY 1, 2),
      w AS (SELECT doc_id, field_id, pos AS o, rank || ' object anchor ' || config_id AS t FROM am WHERE mc < 0.7::DOUBLE
        UNION ALL SELECT pm.doc_id, pm.field_id, distance + 10, 'parent-object fallback ancestor' FROM pm LEFT JOIN fg ON pm.doc_id = fg.doc_id AND pm.field_id = fg.field_id WHERE mc < 0.7::DOUBLE AND (g IS NULL OR distance < g)
        UNION ALL SELECT doc_id, field_id, 101, 'border level summary missing' FROM pf WHERE doc_id % 7 = 2
        UNION ALL SELECT doc_id, field_id, 102, 'no object-level candidate available' FROM pf WHERE nobj = 0
        UNION ALL SELECT doc_id, field_id, 103, concat(ndem, ' object-rung candidate(s) demoted') FROM pf WHERE ndem > 0)
      SELECT doc_id, field_id, count(*) AS n, substring(first(CASE WHEN o < 10 THEN concat(t, ' matched r_') ELSE t END ORDER BY o), 1, 24) AS first_warning FROM w GROUP BY 1, 2""",
    CAND_FX,
)
