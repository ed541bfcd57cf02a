"""Evidence, statistics, merging and the refined template (F-*), signatures (S-9..S-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxledger.catalog import forms as G
from boxledger.catalog import placement as PL
from boxledger.catalog import sqlkit as K
from boxledger.catalog.forms import CAND_FX, CONSENSUS_SQL, FORM_SQL
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import clamp01, r6
from boxledger.operators import boxes
from boxledger.operators import consensus as C
from boxledger.operators import matching as M
from boxledger.operators import refine as RF
from boxledger.functions import rect as R
from boxledger.functions import welford as W
from boxledger.session import cut
from boxledger.sources import identity as S

TPL, PAGE, KEYS = M.TPL, boxes.PAGE, C.KEYS
_MX = ("fx_matches",)
NOW = "2024-03-01T00:00:00.000Z"


def inl(s, sf):
    return cut(G.inliers(s, sf))


def evidence(s, sf):
    i = inl(s, sf)
    ev = RF.match_evidence(G.matches(s, sf), C.outliers(i))
    return RF.outlier_flag(ev, C.consensus(i))


EV_SQL = f"""{CONSENSUS_SQL},
 oc AS (SELECT doc_id, count_if(NOT kept) AS n_out FROM inl GROUP BY 1),
 ev0 AS (SELECT p.*, {K.iou('j', 'r')} AS iou, n_out FROM (SELECT *, cx * sx + tx AS jx, cy * sy + ty AS jy, cw * sx AS jw, ch * sy AS jh FROM proj) p JOIN oc USING (doc_id)),
 ev AS (SELECT *, NOT kept OR (n_out = 0 AND NOT (abs(sx - msx) < 0.01 AND abs(sy - msy) < 0.01 AND abs(tx - mtx) < 0.005 AND abs(ty - mty) < 0.005)) AS is_outlier FROM ev0)"""

add(
    "F1_match_evidence",
    lambda s, sf: RF.match_evidence(G.matches(s, sf), C.outliers(inl(s, sf))).select("doc_id", "config_id", rnd(F.col("iou")).alias("iou"), "is_outlier"),
    f"WITH {EV_SQL} SELECT doc_id, config_id, {r6('iou', 'iou')}, NOT kept AS is_outlier FROM ev",
    _MX,
)
add(
    "F2_outlier_flag",
    lambda s, sf: evidence(s, sf).groupBy("doc_id").agg(F.count_if("is_outlier").alias("n_outliers")),
    f"WITH {EV_SQL} SELECT doc_id, count_if(is_outlier) AS n_outliers FROM ev GROUP BY 1",
    _MX,
)


def _w(prefix, col):
    return [F.col(f"{col}.count").alias(f"{prefix}n"), rnd(F.col(f"{col}.mean")).alias(f"{prefix}mean"), rnd(F.col(f"{col}.m2")).alias(f"{prefix}m2")]


def wsql(prefix, expr, where="true"):
    """SQL of a state's count, mean and m2, two-pass by the engine's own variance."""
    return (
        f"count({expr}) FILTER (WHERE {where}) AS {prefix}n, round(coalesce(avg({expr}) FILTER (WHERE {where}), 0.0::DOUBLE) + 1.3e-10::DOUBLE, 6) AS {prefix}mean, "
        f"round(coalesce(var_pop({expr}) FILTER (WHERE {where}) * count({expr}) FILTER (WHERE {where}), 0.0::DOUBLE) + 1.3e-10::DOUBLE, 6) AS {prefix}m2"
    )


add(
    "F3_pair_evidence",
    lambda s, sf: RF.pair_evidence(evidence(s, sf)).select("doc_id", "from_id", "to_id", *G.rect_cols("p", F.col("rel"))),
    f"""WITH {EV_SQL} SELECT a.doc_id, a.config_id AS from_id, b.config_id AS to_id, {r6('(b.rx + b.rw / 2.0::DOUBLE - (a.rx + a.rw / 2.0::DOUBLE)) / a.rw', 'px')},
      {r6('(b.ry + b.rh / 2.0::DOUBLE - (a.ry + a.rh / 2.0::DOUBLE)) / a.rh', 'py')}, {r6('b.rw / a.rw', 'pw')}, {r6('b.rh / a.rh', 'ph')} FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.config_id <> b.config_id""",
    _MX,
)


def _field_ev(s, sf):
    return RF.field_evidence(cut(PL.predicted(s, sf)), G.geometry(s, sf), G.rt_flat(s, sf))


FE_SQL = f"""{PL.PRED_SQL},
 fe0 AS (SELECT p.doc_id, p.template_id, p.page_index, p.field_id, p.x, p.y, p.w, p.h, CASE tier WHEN 'field-object-a' THEN 'A' WHEN 'field-object-b' THEN 'B' WHEN 'border' THEN 'border' ELSE 'refined' END AS tier,
   CASE WHEN kind = 'object' AND NOT over THEN p.config_id END AS config_id, r.x AS qx, r.y AS qy, r.w AS qw, r.h AS qh FROM pred p LEFT JOIN fx_runtime r ON r.doc_id = p.doc_id AND kind = 'object' AND NOT over AND r.object_id = p.runtime_id),
 fe AS (SELECT *, CASE WHEN qx IS NULL THEN 0.0::DOUBLE ELSE {K.iou('', 'q')} END AS iou FROM fe0)"""
add(
    "F4_field_evidence",
    lambda s, sf: _field_ev(s, sf).select("doc_id", "field_id", "tier", "config_id", rnd(F.col("iou")).alias("iou")),
    f"WITH {FE_SQL} SELECT doc_id, field_id, tier, config_id, {r6('iou', 'iou')} FROM fe",
    CAND_FX,
)


def _page_ev(s, sf):
    refined, _ = G.levels(s, sf)
    return RF.page_evidence(G.docs(s, sf), C.consensus(inl(s, sf)), refined, PL.surfaces(s, sf))


add(
    "F5_page_evidence",
    lambda s, sf: _page_ev(s, sf).select("doc_id", "width", "height", "n_matches", rnd(F.col("consensus.tx")).alias("tx"), rnd(F.col("refined_delta.sx")).alias("rsx"), rnd(F.col("consensus_confidence")).alias("confidence")),
    f"""WITH {CONSENSUS_SQL}, {FORM_SQL} SELECT r.doc_id, 1000 AS width, 1000 AS height, n_matches, {r6('mtx', 'tx')}, {r6('r.w / c.w', 'rsx')}, {r6('confidence', 'confidence')}
      FROM rfr r JOIN tfr c ON r.template_id = c.template_id LEFT JOIN cons k ON k.doc_id = r.doc_id""",
    ("fx_matches", "fx_template", "fx_runtime"),
)
# A state per order status: plain and weighted by the order's month.
add(
    "F6_welford_agg",
    lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(
        W.welford_agg(F.col("o_totalprice") / 1000).alias("u"), W.welford_agg(F.col("o_totalprice") / 1000, F.month("o_orderdate") - F.lit(1.0)).alias("v")
    ).select("o_custkey", *[rnd(F.col(f"{a}.{k}")).alias(f"{a}{k}") for a in "uv" for k in ("count", "total_weight", "mean")], F.round("u.m2", 4).alias("um2"), F.round("v.m2", 4).alias("vm2")),
    """WITH o AS (SELECT o_custkey, o_totalprice / 1000 AS x, CAST(month(o_orderdate) - 1 AS DOUBLE) AS w FROM orders),
      m AS (SELECT o_custkey, sum(w) AS tw, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE 0 END AS wm FROM o GROUP BY 1)
      SELECT o.o_custkey, round(count(*) + 1.3e-10::DOUBLE, 6) AS ucount, round(count(*) + 1.3e-10::DOUBLE, 6) AS utotal_weight, round(avg(x) + 1.3e-10::DOUBLE, 6) AS umean, round(var_pop(x) * count(*), 4) AS um2, round(count_if(w > 0) + 1.3e-10::DOUBLE, 6) AS vcount,
      round(any_value(tw) + 1.3e-10::DOUBLE, 6) AS vtotal_weight, round(any_value(wm) + 1.3e-10::DOUBLE, 6) AS vmean, round(sum(w * (x - wm) * (x - wm)), 4) + 0.0::DOUBLE AS vm2 FROM o JOIN m ON o.o_custkey = m.o_custkey GROUP BY 1""",
)
add(
    "F7_welford_merge",
    lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(W.welford_agg(F.col("o_totalprice") / 1000).alias("u"))
    .groupBy("o_custkey").agg(W.welford_merge(F.col("u")).alias("u")).select("o_custkey", F.col("u.count").alias("n"), rnd(F.col("u.mean")).alias("mean"), F.round("u.m2", 4).alias("m2")),
    "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice / 1000) + 1.3e-10::DOUBLE, 6) AS mean, round(var_pop(o_totalprice / 1000) * count(*), 4) AS m2 FROM orders GROUP BY 1",
)
add(
    "F8_welford_struct",
    lambda s, sf: evidence(s, sf).groupBy(*TPL).agg(W.welford_struct(F.col("affine"), RF.AFFINE).alias("a")).select("template_id", *_w("sx_", "a.sx"), *_w("tx_", "a.tx"), *_w("ty_", "a.ty")),
    f"WITH {EV_SQL} SELECT template_id, {wsql('sx_', 'sx')}, {wsql('tx_', 'tx')}, {wsql('ty_', 'ty')} FROM ev GROUP BY template_id",
    _MX,
)
add(
    "F9_object_stats",
    lambda s, sf: RF.object_stats(evidence(s, sf), G.tmpl_flat(s, sf)).select(*TPL, "config_id", "appearances", "outliers", *_w("iou_", "iou"), *_w("dx_", "drift.x"), *_w("c_", "match_confidence")),
    f"""WITH {EV_SQL} SELECT t.template_id, t.page_index, t.object_id AS config_id, count(e.doc_id) AS appearances, count_if(coalesce(is_outlier, false)) AS outliers, {wsql('iou_', 'iou')}, {wsql('dx_', '(rx - cx)')}, {wsql('c_', 'e.confidence')}
      FROM fx_template t LEFT JOIN ev e ON e.template_id = t.template_id AND e.page_index = t.page_index AND e.config_id = t.object_id GROUP BY 1, 2, 3""",
    ("fx_matches", "fx_template"),
)
add(
    "F10_pair_stats",
    lambda s, sf: RF.pair_stats(RF.pair_evidence(evidence(s, sf))).select("template_id", "from_id", "to_id", "co_occurrence", *_w("x_", "rel.x"), *_w("h_", "rel.h")),
    f"""WITH {EV_SQL} SELECT a.template_id, a.config_id AS from_id, b.config_id AS to_id, count(*) AS co_occurrence, {wsql('x_', '((b.rx + b.rw / 2.0::DOUBLE - (a.rx + a.rw / 2.0::DOUBLE)) / a.rw)')}, {wsql('h_', '(b.rh / a.rh)')}
      FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.config_id <> b.config_id GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    _MX,
)
add(
    "F11_field_stats",
    lambda s, sf: RF.field_stats(_field_ev(s, sf), G.geometry(s, sf)).select("template_id", "field_id", *[F.col(f"tiers.{t}").alias(f"n_{t}") for t in RF.TIER_NAMES], *_w("x_", "rect.x"), *_w("a_", "anchor_iou.A")),
    f"""WITH {FE_SQL} SELECT template_id, field_id, count_if(tier = 'A') AS n_A, count_if(tier = 'B') AS n_B, count_if(tier = 'C') AS n_C, count_if(tier = 'refined') AS n_refined, count_if(tier = 'border') AS n_border,
      {wsql('x_', 'x')}, {wsql('a_', 'iou', "tier = 'A'")} FROM fe GROUP BY 1, 2""",
    CAND_FX,
)
add(
    "F12_anchor_usage",
    lambda s, sf: RF.anchor_usage(_field_ev(s, sf), G.tmpl_flat(s, sf)).select("template_id", "config_id", F.col("usage.A").alias("n_a"), F.col("usage.B").alias("n_b"), *_w("a_", "usage_iou.A")),
    f"""WITH {FE_SQL} SELECT t.template_id, t.object_id AS config_id, count_if(coalesce(tier = 'A', false)) AS n_a, count_if(coalesce(tier = 'B', false)) AS n_b, {wsql('a_', 'iou', "tier = 'A'")}
      FROM fx_template t LEFT JOIN fe ON fe.template_id = t.template_id AND fe.config_id = t.object_id AND tier IN ('A', 'B', 'C') GROUP BY 1, 2""",
    CAND_FX,
)
add(
    "F13_page_stats",
    lambda s, sf: RF.page_stats(_page_ev(s, sf), G.tmpl_flat(s, sf).select(*TPL).distinct()).select(*TPL, "shift_n", rnd(F.col("shift_tx")).alias("shift_tx"), rnd(F.col("shift_ty")).alias("shift_ty"), *_w("k_", "consensus.tx"), *_w("r_", "refined_delta.sx")),
    f"""WITH {CONSENSUS_SQL}, {FORM_SQL} SELECT r.template_id, r.page_index, count(mtx) AS shift_n, {r6('avg(mtx)', 'shift_tx')}, {r6('avg(mty)', 'shift_ty')}, {wsql('k_', 'mtx')}, {wsql('r_', '(r.w / c.w)')}
      FROM rfr r JOIN tfr c ON r.template_id = c.template_id LEFT JOIN cons k ON k.doc_id = r.doc_id GROUP BY 1, 2""",
    ("fx_matches", "fx_template", "fx_runtime"),
)
add(
    "F14_doc_count",
    lambda s, sf: RF.doc_count(G.docs(s, sf)),
    "SELECT template_id, count(DISTINCT doc_id) AS documents FROM fx_runtime GROUP BY 1",
    ("fx_runtime",),
)


# ------------------------------------------------------------------ analytics
def batch_evidence(s, sf, part=None):
    """Evidence of the documents whose number leaves ``part`` of 3, or of all documents."""

    def mine(df):
        return df if part is None else df.where(F.col("doc_id") % 3 == part)

    i = mine(inl(s, sf))
    docs = mine(G.docs(s, sf))
    refined, _ = G.levels(s, sf)
    pred = mine(cut(simple_predicted(s, sf)))
    return RF.extract_evidence(docs, mine(G.matches(s, sf)), C.outliers(i), C.consensus(i), refined, PL.surfaces(s, sf), pred, G.geometry(s, sf), G.rt_flat(s, sf))


def simple_predicted(s, sf):
    """Fields moved with their direct container's match; a light stand-in for the full placement."""
    a = G.template_anchors(s, sf).where(F.col("rank") == "primary").select(*TPL, "field_id", F.col("object_id").alias("config_id"), "rel")
    m = G.matches(s, sf).select(*KEYS, "config_id", "runtime_id", "r")
    return m.join(a, TPL + ["config_id"]).select(*KEYS, "field_id", F.lit("field-object-a").alias("tier"), R.from_relative(F.col("rel"), F.col("r")).alias("bbox"), "config_id", "runtime_id")


def analytics(s, sf, part=None):
    return RF.to_analytics(batch_evidence(s, sf, part), G.tmpl_flat(s, sf), G.geometry(s, sf), f"batch-{part}", NOW)


def merged(s, sf):
    return RF.merge_analytics(*[analytics(s, sf, p) for p in (0, 1, 2)])


def _objects_out(df):
    return df.select(*TPL, "config_id", "appearances", "outliers", rnd(F.col("reliability")).alias("reliability"), *_w("iou_", "iou"), *_w("dx_", "drift.x"))


REL_SQL = f"""{EV_SQL}, dc AS (SELECT template_id, count(DISTINCT doc_id) AS documents FROM fx_runtime GROUP BY 1),
 os AS (SELECT t.template_id, t.page_index, t.object_id AS config_id, t.x, t.y, t.w, t.h, t.confidence, any_value(documents) AS documents, count(e.doc_id) AS appearances, count_if(coalesce(is_outlier, false)) AS outliers, avg(iou) AS iou_raw,
   avg(rx - cx) AS dx, avg(ry - cy) AS dy, avg(rw - cw) AS dw, avg(rh - ch) AS dh, {wsql('iou_', 'iou')}, {wsql('dx_', '(rx - cx)')}
   FROM fx_template t JOIN dc ON dc.template_id = t.template_id LEFT JOIN ev e ON e.template_id = t.template_id AND e.config_id = t.object_id GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
 rl AS (SELECT *, {clamp01("0.4::DOUBLE * least(1.0::DOUBLE, appearances / CAST(documents AS DOUBLE)) + 0.4::DOUBLE * coalesce(iou_raw, 0.0::DOUBLE) + 0.2::DOUBLE * (1.0::DOUBLE - CASE WHEN appearances > 0 THEN outliers / CAST(appearances AS DOUBLE) ELSE 0.0::DOUBLE END)")} AS reliability FROM os)"""
_FXL = ("fx_matches", "fx_template", "fx_runtime")
_OC = f"template_id, page_index, config_id, appearances, outliers, {r6('reliability', 'reliability')}, iou_n, iou_mean, iou_m2, dx_n, dx_mean, dx_m2"
add("F15_reliability", lambda s, sf: _objects_out(RF.with_reliability(analytics(s, sf))), f"WITH {REL_SQL} SELECT {_OC} FROM rl", _FXL)
add("F16_emit_filter", lambda s, sf: _objects_out(RF.emit_filter(RF.with_reliability(analytics(s, sf)))), f"WITH {REL_SQL} SELECT {_OC} FROM rl WHERE appearances > 0 AND reliability >= 0.3::DOUBLE", _FXL)
add(
    "F17_to_analytics",
    lambda s, sf: analytics(s, sf).history.unionByName(analytics(s, sf, 0).history),
    f"""SELECT template_id, 'batch-None' AS batch_id, count(DISTINCT doc_id) AS added_documents, '{NOW}' AS merged_at FROM fx_runtime GROUP BY 1
      UNION ALL SELECT template_id, 'batch-0', count(DISTINCT doc_id), '{NOW}' FROM fx_runtime WHERE doc_id % 3 = 0 GROUP BY 1""",
    ("fx_runtime",),
)
# The merge of three parts must give what one pass over all documents gives.
add("F18_merge_analytics", lambda s, sf: _objects_out(RF.with_reliability(merged(s, sf))), f"WITH {REL_SQL} SELECT {_OC} FROM rl", _FXL)
add(
    "F19_merged_globals",
    lambda s, sf: merged(s, sf).totals.select("template_id", "documents", rnd(F.col("mean_confidence")).alias("mean_confidence")),
    f"""WITH {CONSENSUS_SQL}, p AS (SELECT r.template_id, r.doc_id % 3 AS part, count(*) AS n, avg(confidence) AS m FROM (SELECT DISTINCT template_id, doc_id FROM fx_runtime) r LEFT JOIN cons k ON k.doc_id = r.doc_id GROUP BY 1, 2)
      SELECT template_id, sum(n) AS documents, {r6('sum(coalesce(m, 0.0::DOUBLE) * n) / sum(n)', 'mean_confidence')} FROM p GROUP BY 1""",
    ("fx_matches", "fx_runtime"),
)


def _with_identity(s, sf):
    a = analytics(s, sf)
    return _objects_out(RF.with_reliability(RF.merge_analytics(a, RF.empty_analytics(a))))


add("F20_empty_analytics", _with_identity, f"WITH {REL_SQL} SELECT {_OC} FROM rl", _FXL)


def _emitted(s, sf):
    return RF.emit_filter(RF.with_reliability(analytics(s, sf)))


def _refined_tree(s, sf):
    return RF.refine_objects(G.template_tree(s, sf), _emitted(s, sf))


REFT_SQL = f"""{REL_SQL}, rt2 AS (SELECT template_id, page_index, config_id AS object_id, CASE WHEN appearances > 0 AND reliability >= 0.3::DOUBLE THEN x + dx ELSE x END AS x, CASE WHEN appearances > 0 AND reliability >= 0.3::DOUBLE THEN y + dy ELSE y END AS y,
   CASE WHEN appearances > 0 AND reliability >= 0.3::DOUBLE THEN greatest(0, w + dw) ELSE w END AS w, CASE WHEN appearances > 0 AND reliability >= 0.3::DOUBLE THEN greatest(0, h + dh) ELSE h END AS h,
   CASE WHEN appearances > 0 AND reliability >= 0.3::DOUBLE THEN reliability ELSE least(confidence, 0.05::DOUBLE) END AS confidence FROM rl)"""
add(
    "F21_refine_objects",
    lambda s, sf: _refined_tree(s, sf).select("template_id", "object_id", *G.rect_cols("", F.col("rect")), rnd(F.col("confidence")).alias("confidence")),
    f"WITH {REFT_SQL} SELECT template_id, object_id, {r6('x', 'x')}, {r6('y', 'y')}, {r6('w', 'w')}, {r6('h', 'h')}, {r6('confidence', 'confidence')} FROM rt2",
    _FXL,
)


def _tframes(s, sf):
    return G.tmpl_frames(s, sf).select(*TPL, F.col("c_border").alias("border"), F.col("c_refined").alias("refined"), F.col("c_cv").alias("cv_content"))


add(
    "F22_refine_frames",
    lambda s, sf: RF.refine_frames(_tframes(s, sf), G.template_borders(s, sf)).select("template_id", "source", "n_bbox", *G.rect_cols("", F.col("refined"))),
    f"""WITH {FORM_SQL}, g AS (SELECT template_id, count(*) AS n, min(x) AS l, min(y) AS t, max(x + w) AS r, max(y + h) AS b FROM fx_geometry GROUP BY 1)
      SELECT f.template_id, 'cv-and-bbox-union' AS source, n AS n_bbox, {r6('least(x, l)', 'x')}, {r6('least(y, t)', 'y')}, {r6('greatest(x + w, r) - least(x, l)', 'w')}, {r6('greatest(y + h, b) - least(y, t)', 'h')} FROM tfr f JOIN g ON f.template_id = g.template_id""",
    ("fx_template", "fx_runtime", "fx_geometry"),
)
add(
    "F23_refine_template",
    lambda s, sf: RF.refine_template(cut(G.template_tree(s, sf)), _tframes(s, sf), G.template_borders(s, sf), cut(_emitted(s, sf)))["anchors"].select("template_id", "field_id", "label", "object_id"),
    f"""WITH {REFT_SQL}, {G._TN}, rt3 AS (SELECT a.*, b.parent_id, b.input_ord FROM rt2 a JOIN tn b ON a.template_id = b.template_id AND a.object_id = b.object_id), {G.anchors_cte('rt3', 'fx_geometry', 'template_id, page_index')}
      SELECT template_id, field_id, label, object_id FROM anch""",
    _FXL + ("fx_geometry",),
)
add(
    "F24_extract_evidence",
    lambda s, sf: _ev_counts(batch_evidence(s, sf)),
    f"""WITH {EV_SQL}, {G.TANCH_SQL} SELECT r.template_id, count(DISTINCT r.doc_id) AS documents, any_value(m.n) AS n_matches, any_value(m.o) AS n_outliers, coalesce(any_value(f.n), 0) AS n_fields
      FROM fx_runtime r LEFT JOIN (SELECT template_id, count(*) AS n, count_if(is_outlier) AS o FROM ev GROUP BY 1) m ON m.template_id = r.template_id
      LEFT JOIN (SELECT e.template_id, count(*) AS n FROM ev e JOIN anch a ON a.template_id = e.template_id AND a.object_id = e.config_id AND a.pos = 1 GROUP BY 1) f ON f.template_id = r.template_id GROUP BY 1""",
    _FXL + ("fx_geometry",),
)


def _ev_counts(ev):
    m = ev.matches.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if("is_outlier").alias("n_outliers"))
    f = ev.fields.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_fields"))
    return RF.doc_count(ev.documents).join(m, "template_id", "left").join(f, "template_id", "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))


# ------------------------------------------------------------------ signatures
def signature(s, sf, shift=0.0):
    g = fx("fx_geometry")(s, sf)
    # Each template declares its own three fields.
    wiz = g.select("template_id", "field_id", F.concat(F.lit("Field "), "ord").alias("label"), F.lit("text").alias("field_type"), (F.col("ord") == 1).alias("required"))
    objects = G.tmpl_flat(s, sf).select(*TPL, F.col("config_id").alias("object_id"))
    if shift:
        objects = objects.where(~((F.col("template_id") < F.lit(shift)) & F.col("object_id").endswith("7")))
    frames = G.tmpl_frames(s, sf).select(*TPL, F.col("c_refined").alias("refined"), F.col("c_cv").alias("cv_content"))
    size = G.tmpl_frames(s, sf).select(*TPL, F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return S.compat_signature(wiz, objects, frames, g, size)


_SIG_SQL = f"""{FORM_SQL},
 wz AS (SELECT template_id, sha256(concat('[', string_agg(concat('{{"fieldId":"', field_id, '","label":"Field ', ord, '","required":', CASE WHEN ord = 1 THEN 'true' ELSE 'false' END, ',"type":"text"}}'), ',' ORDER BY field_id), ']')) AS field_hash, count(*) AS n_fields,
   sha256(concat('["', string_agg(field_id, '","' ORDER BY field_id), '"]')) AS geometry_hash FROM fx_geometry GROUP BY 1),
 ob AS (SELECT template_id, sha256(concat('["', string_agg(object_id, '","' ORDER BY object_id), '"]')) AS object_hash FROM fx_template GROUP BY 1)"""
add(
    "S10_compat_signature",
    lambda s, sf: signature(s, sf).select("template_id", "field_hash", "n_fields", "object_hash", "n_pages", "geometry_hash", F.size("page_sizes").alias("n_sizes")),
    f"WITH {_SIG_SQL} SELECT w.template_id, field_hash, n_fields, object_hash, 1 AS n_pages, geometry_hash, 1 AS n_sizes FROM wz w JOIN ob o ON w.template_id = o.template_id",
    ("fx_template", "fx_geometry", "fx_runtime"),
)
add(
    "S11_signatures_compatible",
    lambda s, sf: S.signatures_compatible(signature(s, sf), signature(s, sf, 5.0)),
    """SELECT template_id, NOT (template_id < 5 AND bool_or(object_id LIKE '%7')) AS compatible FROM fx_template GROUP BY 1""",
    ("fx_template",),
)
add(
    "S9_canonical_json",
    lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", S.canonical_json({"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "priority": S.sorted_struct({"name": F.col("o_orderpriority"), "by": F.lit(None).cast("string")})}).alias("json")
    ),
    """SELECT o_orderkey, concat('{"custkey":', o_custkey, ',"priority":{"by":null,"name":"', o_orderpriority, '"},"status":"', o_orderstatus, '"}') AS json FROM orders""",
)
add(
    "S7_document_fingerprint",
    lambda s, sf: S.document_fingerprint(fx("fx_surfaces")(s, sf)),
    "SELECT doc_id, concat('surface:scan ', doc_id, '.pdf#', string_agg(concat(page_index, ':', width, 'x', height), '|' ORDER BY page_index)) AS fingerprint FROM fx_surfaces GROUP BY 1",
    ("fx_surfaces",),
)
add(
    "S8_first_page_fingerprint",
    lambda s, sf: S.first_page_fingerprint(fx("fx_surfaces")(s, sf)),
    "SELECT doc_id, concat('surface:', source_name, '#0:', width, 'x', height) AS first_fingerprint FROM fx_surfaces WHERE page_index = 0",
    ("fx_surfaces",),
)
