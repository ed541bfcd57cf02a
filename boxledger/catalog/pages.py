"""Detection filters, hierarchy, relations, frames and density (D-1..D-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxledger import fixtures
from boxledger.catalog import sqlkit as K
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import r6, r9
from boxledger.functions import rect as R
from boxledger.operators import boxes
from boxledger.session import cut

PAGE = "doc_id, page_index"


def _det(s, sf):
    raw = fx("fx_detections")(s, sf)
    return raw.select("doc_id", "page_index", "object_id", R.pack("p").alias("px"), "confirmed", "fill_ratio")


def surfaces(s, sf):
    return fx("fx_surfaces")(s, sf)


def _thr(s, sf):
    return boxes.page_thresholds(surfaces(s, sf))


def objects(s, sf):
    return fx("fx_objects")(s, sf).select("doc_id", "page_index", "object_id", "input_ord", R.pack().alias("rect"), "confidence")


def tree(s, sf):
    return boxes.build_hierarchy(objects(s, sf))


def flat_rect(df, *cols, col="rect"):
    return df.select(*cols, *[(rnd(F.col(f"{col}.{k}"))).alias(k) for k in "xywh"])


def _js_round(e):
    return f"CAST(floor({e} + 0.5::DOUBLE) AS BIGINT)"


_THR = f"""thr AS (SELECT doc_id, page_index, width, height, greatest(36, {_js_round('width * height * 0.0008::DOUBLE')}) AS min_area,
  greatest(24, {_js_round('least(width, height) * 0.025::DOUBLE')}) AS min_line_length,
  greatest(6, {_js_round('least(width, height) * 0.01::DOUBLE')}) AS max_line_thickness,
  greatest(8, {_js_round('least(width, height) * 0.012::DOUBLE')}) AS glyph_min_side FROM fx_surfaces)"""
_FXD, _FXS, _FXO = ("fx_detections",), ("fx_surfaces",), ("fx_detections", "fx_objects")
_DT = ("fx_detections", "fx_surfaces")

add("D1_page_thresholds", lambda s, sf: _thr(s, sf), f"WITH {_THR} SELECT * FROM thr", _FXS)
# Boxes are moved so that some leave the page.
add(
    "D2_clamp_and_floor",
    lambda s, sf: boxes.clamp_and_floor(
        _det(s, sf).withColumn("px", R.make(F.col("px.x") + 200, F.col("px.y") - 40, F.col("px.w"), F.col("px.h"))), _thr(s, sf)
    ).select("doc_id", "object_id", F.col("px.x").alias("x"), F.col("px.y").alias("y"), F.col("px.w").alias("w"), F.col("px.h").alias("h")),
    f"""WITH {_THR}, c AS (SELECT f.doc_id, object_id, greatest(0, px + 200) AS x, greatest(0, py - 40) AS y, least(width, px + 200 + pw) AS r,
     least(height, py - 40 + ph) AS b, min_area FROM fx_detections f JOIN thr t ON f.doc_id = t.doc_id AND f.page_index = t.page_index),
     q AS (SELECT doc_id, object_id, x, y, greatest(0, r - x) AS w, greatest(0, b - y) AS h, min_area FROM c)
     SELECT doc_id, object_id, x, y, w, h FROM q WHERE w > 0 AND h > 0 AND w * h >= min_area""",
    _DT,
)
add(
    "D3_drop_line_shaped",
    lambda s, sf: boxes.drop_line_shaped(_det(s, sf), _thr(s, sf)).select("doc_id", "object_id"),
    f"""WITH {_THR} SELECT f.doc_id, object_id FROM fx_detections f JOIN thr t ON f.doc_id = t.doc_id AND f.page_index = t.page_index
      WHERE NOT ((ph <= max_line_thickness AND pw >= min_line_length) OR (pw <= max_line_thickness AND ph >= min_line_length))""",
    _DT,
)
_ASP = "CAST(pw AS DOUBLE) / ph BETWEEN 1.0::DOUBLE / 12 AND 12"
add(
    "D4_glyph_gate",
    lambda s, sf: boxes.glyph_gate(_det(s, sf), _thr(s, sf)).select("doc_id", "object_id"),
    f"""WITH {_THR} SELECT f.doc_id, object_id FROM fx_detections f JOIN thr t ON f.doc_id = t.doc_id AND f.page_index = t.page_index
      WHERE least(pw, ph) >= glyph_min_side AND (confirmed OR ({_ASP} AND fill_ratio >= 0.55::DOUBLE))""",
    _DT,
)
add(
    "D4_glyph_gate_blobs",
    lambda s, sf: boxes.glyph_gate(_det(s, sf), _thr(s, sf), presume_large=True).select("doc_id", "object_id"),
    f"""WITH {_THR} SELECT f.doc_id, object_id FROM fx_detections f JOIN thr t ON f.doc_id = t.doc_id AND f.page_index = t.page_index
      WHERE least(pw, ph) >= glyph_min_side AND (least(pw, ph) >= 4 * glyph_min_side OR ({_ASP} AND fill_ratio >= 0.55::DOUBLE))""",
    _DT,
)
add(
    "D5_score_boxes",
    lambda s, sf: boxes.score_boxes(_det(s, sf), surfaces(s, sf)).select("doc_id", "object_id", F.round("confidence", 9).alias("confidence")),
    f"""SELECT f.doc_id, object_id, {r9("least(0.99::DOUBLE, CASE WHEN confirmed THEN 0.78::DOUBLE + pw * ph / CAST(width * height AS DOUBLE) * (1 - 0.78::DOUBLE) ELSE 0.62::DOUBLE + pw * ph / CAST(width * height AS DOUBLE) * (1 - 0.62::DOUBLE) END)", "confidence")}
      FROM fx_detections f JOIN fx_surfaces s ON f.doc_id = s.doc_id AND f.page_index = s.page_index""",
    _DT,
)
add(
    "D5_score_line_bounded",
    lambda s, sf: boxes.score_boxes(_det(s, sf), surfaces(s, sf), line_bounded=True).select("doc_id", "object_id", F.round("confidence", 9).alias("confidence")),
    f"""SELECT f.doc_id, object_id, {r9("least(0.99::DOUBLE, 0.78::DOUBLE + least(0.18::DOUBLE, pw * ph / CAST(width * height AS DOUBLE)))", "confidence")}
      FROM fx_detections f JOIN fx_surfaces s ON f.doc_id = s.doc_id AND f.page_index = s.page_index""",
    _DT,
)
_SCAN = f"NOT coalesce(confirmed, false), {K.area('')} DESC, object_id"


_PXBD = "b AS MATERIALIZED (SELECT doc_id, page_index, object_id, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, CAST(pw AS DOUBLE) AS w, CAST(ph AS DOUBLE) AS h, confirmed FROM fx_detections)"
add(
    "D6_nms",
    lambda s, sf: boxes.nms(_det(s, sf)).select("doc_id", "page_index", "object_id"),
    f"WITH {_PXBD}, {K.greedy_cte('g', 'b', PAGE, _SCAN, K.iou('k.', 'o.') + ' >= 0.85::DOUBLE')} SELECT * FROM g_k",
    _FXD,
)
add(
    "D7_is_duplicate",
    lambda s, sf: _dup_pairs(s, sf),
    f"""WITH {_PXBD} SELECT a.doc_id, a.object_id AS a_id, c.object_id AS b_id FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.object_id < c.object_id
      AND {K.duplicate('a.', 'c.')}""",
    _FXD,
)


def _dup_pairs(s, sf):
    return boxes.duplicate_pairs(_det(s, sf), ["doc_id"]).select("doc_id", "a_id", "b_id")


add(
    "D8_dedup_sources",
    lambda s, sf: boxes.dedup_sources(_det(s, sf)).select("doc_id", "page_index", "object_id"),
    f"WITH {_PXBD}, {K.greedy_cte('g', 'b', PAGE, _SCAN, K.duplicate('o.', 'k.'))} SELECT * FROM g_k",
    _FXD,
)


def _two_sources(s, sf):
    a = _det(s, sf)
    moved = a.withColumn("px", R.make(F.col("px.x") + 1, F.col("px.y") + 1, F.col("px.w"), F.col("px.h"))).withColumn("confirmed", F.lit(True))
    return boxes.union_sources({"obj_cv": a, "obj_cell": moved}).select("doc_id", "page_index", "object_id")


add(
    "D9_union_sources",
    _two_sources,
    f"""WITH u AS (SELECT doc_id, page_index, concat('obj_cv_', object_id) AS object_id, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, CAST(pw AS DOUBLE) AS w, CAST(ph AS DOUBLE) AS h, confirmed FROM fx_detections
      UNION ALL SELECT doc_id, page_index, concat('obj_cell_', object_id), CAST(px + 1 AS DOUBLE), CAST(py + 1 AS DOUBLE), CAST(pw AS DOUBLE), CAST(ph AS DOUBLE), true FROM fx_detections),
      {K.greedy_cte('g', 'u', PAGE, _SCAN, K.duplicate('o.', 'k.'))} SELECT * FROM g_k""",
    _FXD,
)
add(
    "D10_collapse_trivial",
    lambda s, sf: boxes.collapse_trivial(objects(s, sf)).select("doc_id", "page_index", "object_id"),
    f"WITH {K.greedy_cte('g', 'fx_objects', PAGE, "confidence DESC, (w * h) DESC, object_id", K.trivial('k.', 'o.'))} SELECT * FROM g_k",
    _FXO,
)
add(
    "D11_assign_parents",
    lambda s, sf: boxes.assign_parents(objects(s, sf)).select("doc_id", "object_id", "parent_id"),
    f"WITH {K.parents_cte('nest', 'fx_objects')} SELECT doc_id, object_id, parent_id FROM nest",
    _FXO,
)
add(
    "D12_dedup_siblings",
    lambda s, sf: boxes.dedup_siblings(boxes.assign_parents(boxes.collapse_trivial(objects(s, sf)))).select("doc_id", "object_id", "parent_id"),
    f"WITH {K.hierarchy_cte('fx_objects')} SELECT doc_id, object_id, parent_id FROM tree",
    _FXO,
)
add(
    "D13_depths",
    lambda s, sf: boxes.depths(boxes.assign_parents(boxes.collapse_trivial(objects(s, sf)))).select("doc_id", "object_id", "depth"),
    f"""WITH {K.greedy_cte("triv", "fx_objects", PAGE, f"confidence DESC, {K.area('')} DESC, object_id", K.trivial("k.", "o."))},
      flat AS (SELECT s.* FROM fx_objects s JOIN triv_k k ON s.doc_id = k.doc_id AND s.object_id = k.object_id),
      {K.parents_cte('nest', 'flat')}, {K.ancestors_cte('anc', 'nest')}
      SELECT n.doc_id, n.object_id, count(a.ancestor_id) AS depth FROM nest n LEFT JOIN anc a ON n.doc_id = a.doc_id AND n.object_id = a.object_id GROUP BY 1, 2""",
    _FXO,
)
add(
    "D14_ancestors",
    lambda s, sf: boxes.ancestors(tree(s, sf)).select("doc_id", "object_id", "ancestor_id", "distance"),
    f"WITH {K.hierarchy_cte('fx_objects')} SELECT doc_id, object_id, ancestor_id, distance FROM tree_anc",
    _FXO,
)
add(
    "D15_build_hierarchy",
    lambda s, sf: tree(s, sf).select("doc_id", "page_index", "object_id", "parent_id", "depth"),
    f"WITH {K.hierarchy_cte('fx_objects')} SELECT doc_id, page_index, object_id, parent_id, depth FROM tree",
    _FXO,
)
add(
    "D15_hierarchy_counts",
    lambda s, sf: boxes.hierarchy_counts(objects(s, sf), tree(s, sf)),
    f"""WITH {K.hierarchy_cte('fx_objects')} SELECT a.doc_id, a.page_index, a.n AS n_before, coalesce(b.n, 0) AS n_after FROM
      (SELECT doc_id, page_index, count(*) AS n FROM fx_objects GROUP BY 1, 2) a LEFT JOIN (SELECT doc_id, page_index, count(*) AS n FROM tree GROUP BY 1, 2) b
      ON a.doc_id = b.doc_id AND a.page_index = b.page_index""",
    _FXO,
)


def relations_cte(src: str, keys: str = PAGE) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""rel0 AS (SELECT {ak}, a.object_id AS from_id, b.object_id AS to_id, CASE WHEN {K.contains('a.', 'b.')} THEN 'container'
   WHEN a.parent_id = b.parent_id THEN 'sibling' WHEN {K.adjacent('a.', 'b.')} THEN 'adjacent' WHEN {K.cdist('a.', 'b.')} <= 0.35::DOUBLE THEN 'near' END AS kind,
   {K.cdist('a.', 'b.')} AS distance, (b.x - a.x) / greatest(a.w, 1e-6) AS rx, (b.y - a.y) / greatest(a.h, 1e-6) AS ry, b.w / greatest(a.w, 1e-6) AS rw, b.h / greatest(a.h, 1e-6) AS rh
   FROM {src} a JOIN {src} b ON {on} AND a.object_id <> b.object_id),
 relg AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE kind WHEN 'container' THEN 0 WHEN 'sibling' THEN 1 WHEN 'adjacent' THEN 2 ELSE 3 END,
   distance, from_id, to_id) - 1 AS fallback_order FROM rel0 WHERE kind IS NOT NULL)"""


def _relation_summary(graph):
    """All relations of an object in one row; the order sum pins the order of every one."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in boxes.KINDS]
    sums = [F.sum("fallback_order").alias("order_sum"), rnd(F.sum("distance")).alias("distance_sum"), rnd(F.min("rel.x")).alias("rx_min"), rnd(F.max("rel.h")).alias("rh_max")]
    return graph.groupBy("doc_id", "from_id").agg(*counts, *sums)


add(
    "D16_relation_graph",
    lambda s, sf: _relation_summary(boxes.relation_graph(boxes.assign_parents(objects(s, sf)))),
    f"""WITH {K.parents_cte('nest', 'fx_objects')}, {relations_cte('nest')}
      SELECT doc_id, from_id, {", ".join(f"count_if(kind = '{k}') AS n_{k}" for k in boxes.KINDS)}, sum(fallback_order)::BIGINT AS order_sum, {r6('sum(distance)', 'distance_sum')}, {r6('min(rx)', 'rx_min')}, {r6('max(rh)', 'rh_max')}
      FROM relg GROUP BY doc_id, from_id""",
    _FXO,
)

add(
    "D16_sibling_classes",
    lambda s, sf: boxes.sibling_classes(boxes.assign_parents(objects(s, sf))).select("doc_id", "parent_id", "n_members", "n_links"),
    f"""WITH {K.parents_cte('nest', 'fx_objects')}, {relations_cte('nest')},
      m AS (SELECT doc_id, page_index, parent_id, count(*) AS n_members FROM nest WHERE parent_id IS NOT NULL GROUP BY 1, 2, 3),
      l AS (SELECT g.doc_id, n.parent_id, count(*) AS n_links FROM relg g JOIN nest n ON n.doc_id = g.doc_id AND n.object_id = g.from_id WHERE g.kind = 'sibling' GROUP BY 1, 2)
      SELECT m.doc_id, m.parent_id, n_members, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l ON l.doc_id = m.doc_id AND l.parent_id = m.parent_id""",
    _FXO,
)

# Field boxes per customer page, some of them reaching out of the content.
fixtures.SQL["fx_page_fields"] = """
SELECT c_custkey AS doc_id, 0 AS page_index, concat('f', n) AS field_id, CAST(n * 230 + c_nationkey AS DOUBLE) / CAST(1000 AS DOUBLE) AS x,
 CAST(100 + c_nationkey * 30 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y, CAST(60 AS DOUBLE) / CAST(1000 AS DOUBLE) AS w, CAST(25 AS DOUBLE) / CAST(1000 AS DOUBLE) AS h
FROM {customer} JOIN (VALUES (1), (2), (3), (4)) AS t(n) ON n > 0"""


def page_fields(s, sf):
    """Written: as a constant, the page index would vanish from joins, for which the objects were dealt once more."""
    return cut(fx("fx_page_fields")(s, sf).select("doc_id", "page_index", "field_id", R.pack().alias("bbox")))


def _content(s, sf):
    return boxes.content_rect(_det(s, sf), surfaces(s, sf))


def frames(s, sf):
    return boxes.refined_border(_content(s, sf), page_fields(s, sf))


_CONTENT = """u AS (SELECT doc_id, page_index, min(px) AS l, min(py) AS t, max(px + pw) AS r, max(py + ph) AS b FROM fx_detections GROUP BY 1, 2),
 content AS (SELECT s.doc_id, s.page_index, width, height, l IS NOT NULL AND least(width, r) - l >= 4 AND least(height, b) - t >= 4 AS ok,
   l, t, least(width, r) AS r, least(height, b) AS b FROM fx_surfaces s LEFT JOIN u ON s.doc_id = u.doc_id AND s.page_index = u.page_index),
 cr AS (SELECT doc_id, page_index, width, height, CAST(CASE WHEN ok THEN l ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN ok THEN t ELSE 0 END AS DOUBLE) AS y,
   CAST(CASE WHEN ok THEN r - l ELSE width END AS DOUBLE) AS w, CAST(CASE WHEN ok THEN b - t ELSE height END AS DOUBLE) AS h FROM content)"""
add(
    "D18_content_rect",
    lambda s, sf: flat_rect(_content(s, sf), "doc_id", "page_index", col="content"),
    f"WITH {_CONTENT} SELECT doc_id, page_index, x, y, w, h FROM cr",
    _DT,
)
FRAMES_SQL = f"""{_CONTENT},
 cvn AS (SELECT doc_id, page_index, least(1.0::DOUBLE, x / width) AS x, least(1.0::DOUBLE, y / height) AS y, least(1.0::DOUBLE, w / width) AS w, least(1.0::DOUBLE, h / height) AS h FROM cr),
 fu AS (SELECT doc_id, page_index, min(x) AS l, min(y) AS t, max(x + w) AS r, max(y + h) AS b, count(*) AS n FROM fx_page_fields GROUP BY 1, 2),
 frm AS (SELECT c.doc_id, c.page_index, c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch, coalesce(n, 0) AS n_bbox,
   CASE WHEN n IS NULL THEN 'cv-content' ELSE 'cv-and-bbox-union' END AS source,
   CASE WHEN n IS NULL THEN c.x ELSE least(c.x, l) END AS x, CASE WHEN n IS NULL THEN c.y ELSE least(c.y, t) END AS y,
   CASE WHEN n IS NULL THEN c.w ELSE least(1.0::DOUBLE, greatest(c.x + c.w, r)) - least(c.x, l) END AS w,
   CASE WHEN n IS NULL THEN c.h ELSE least(1.0::DOUBLE, greatest(c.y + c.h, b)) - least(c.y, t) END AS h,
   n IS NULL OR (r <= 1 + 1e-6 AND b <= 1 + 1e-6) AS contains_all
   FROM cvn c LEFT JOIN fu ON c.doc_id = fu.doc_id AND c.page_index = fu.page_index)"""
_FR = ("fx_detections", "fx_surfaces", "fx_page_fields")
add(
    "D19_refined_border",
    lambda s, sf: flat_rect(frames(s, sf), "doc_id", "page_index", "source", "n_bbox", "contains_all", (rnd("cv_content.w")).alias("cv_w"), col="refined"),
    f"WITH {FRAMES_SQL} SELECT doc_id, page_index, source, n_bbox, contains_all, {r6('cw', 'cv_w')}, {r6('x', 'x')}, {r6('y', 'y')}, {r6('w', 'w')}, {r6('h', 'h')} FROM frm",
    _FR,
)
add(
    "D17_frame_relations",
    lambda s, sf: flat_rect(boxes.frame_relations(objects(s, sf), frames(s, sf)), "doc_id", "object_id", col="rel"),
    f"""WITH {FRAMES_SQL} SELECT o.doc_id, object_id, {r6('(o.x - f.x) / greatest(f.w, 1e-6)', 'x')}, {r6('(o.y - f.y) / greatest(f.h, 1e-6)', 'y')},
      {r6('o.w / greatest(f.w, 1e-6)', 'w')}, {r6('o.h / greatest(f.h, 1e-6)', 'h')} FROM fx_objects o JOIN frm f ON o.doc_id = f.doc_id AND o.page_index = f.page_index""",
    _FR + ("fx_objects",),
)
add(
    "D17_border_relations",
    lambda s, sf: flat_rect(boxes.border_relations(frames(s, sf)), "doc_id", "page_index", col="rel"),
    f"WITH {FRAMES_SQL} SELECT doc_id, page_index, {r6('x', 'x')}, {r6('y', 'y')}, {r6('w', 'w')}, {r6('h', 'h')} FROM frm",
    _FR,
)


def _blobs(s, sf):
    named = _det(s, sf).withColumn(
        "object_id",
        F.concat(F.when(F.col("fill_ratio") > 0.6, F.lit("obj_cv_cell_")).when(F.col("confirmed"), F.lit("obj_cv_")).otherwise(F.lit("obj_blob_")), "object_id"),
    )
    return boxes.blobs_to_decompose(named, surfaces(s, sf)).select("doc_id", "object_id")


add(
    "D20_blobs_to_decompose",
    _blobs,
    f"""WITH b AS (SELECT doc_id, page_index, concat(CASE WHEN fill_ratio > 0.6::DOUBLE THEN 'obj_cv_cell_' WHEN confirmed THEN 'obj_cv_' ELSE 'obj_blob_' END, object_id) AS object_id,
      CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, CAST(pw AS DOUBLE) AS w, CAST(ph AS DOUBLE) AS h, fill_ratio FROM fx_detections)
      SELECT a.doc_id, a.object_id FROM b a JOIN fx_surfaces s ON a.doc_id = s.doc_id AND a.page_index = s.page_index
      WHERE a.fill_ratio <= 0.6::DOUBLE AND a.w * a.h / (width * height) >= 0.01::DOUBLE
      AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.page_index = a.page_index AND c.object_id <> a.object_id AND {K.contains('a.', 'c.', 1.0)})""",
    _DT,
)


def density(s, sf, least_confidence=0.0):
    return boxes.density_check(page_fields(s, sf), objects(s, sf).where(F.col("confidence") >= least_confidence))


def density_sql(where="true"):
    return f"""SELECT f.doc_id, f.page_index, f.field_id, count(o.object_id) AS n_near, count(o.object_id) >= 2 AS passes FROM fx_page_fields f
      LEFT JOIN fx_objects o ON f.doc_id = o.doc_id AND f.page_index = o.page_index AND o.confidence >= 0.7::DOUBLE AND {where} AND {K.cdist('f.', 'o.')} <= 2.0::DOUBLE * greatest(f.w, f.h)
      GROUP BY 1, 2, 3"""


_DF = ("fx_page_fields", "fx_objects")
add("D21_density_check", density, density_sql(), _DF)
add(
    "D22_accept_alternative",
    lambda s, sf: boxes.accept_alternative(density(s, sf, 0.9), density(s, sf), ["doc_id"]),
    f"""WITH b AS ({density_sql("o.confidence >= 0.9::DOUBLE")}), a AS ({density_sql()})
      SELECT b.doc_id, bool_or(NOT b.passes AND a.passes) AS accept FROM b JOIN a ON a.doc_id = b.doc_id AND a.field_id = b.field_id GROUP BY 1""",
    _DF,
)
add(
    "D23_visible_objects",
    lambda s, sf: boxes.visible_objects(boxes.depths(boxes.assign_parents(boxes.collapse_trivial(objects(s, sf))))).select("doc_id", "object_id"),
    f"""WITH {K.greedy_cte("triv", "fx_objects", PAGE, f"confidence DESC, {K.area('')} DESC, object_id", K.trivial("k.", "o."))},
      flat AS (SELECT s.* FROM fx_objects s JOIN triv_k k ON s.doc_id = k.doc_id AND s.object_id = k.object_id), {K.parents_cte('nest', 'flat')}
      SELECT doc_id, object_id FROM nest WHERE parent_id IS NULL OR confidence >= 0.75::DOUBLE""",
    _FXO,
)
