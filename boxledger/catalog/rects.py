"""Rect and affine expressions (E-*), one query each over all template/document object pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxledger.catalog import sqlkit as K
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import clamp01
from boxledger.functions import rect as R

PAIRS = fx("fx_pairs")
KEY = ["doc_id", "config_id"]


def _rects():
    c = R.make(*[F.col(f"c{k}") for k in "xywh"])
    r = R.make(*[F.col(f"r{k}") for k in "xywh"])
    return c, r



def pair_query(name, columns, sql_columns):
    """``columns(c, r)`` -> {name: Column}; ``sql_columns``: {name: SQL expression}; numbers get six decimals."""

    def run(spark, sf):
        c, r = _rects()
        cols = columns(c, r)
        return PAIRS(spark, sf).select(
            *KEY, *[v.alias(n) if n.startswith("is_") or n.startswith("t_") else rnd(v).alias(n) for n, v in cols.items()]
        )

    sql = ", ".join(
        f"{v} AS {n}" if n.startswith("is_") or n.startswith("t_") else K.r6(v, n) for n, v in sql_columns.items()
    )
    add(name, run, f"SELECT doc_id, config_id, {sql} FROM fx_pairs", ("fx_pairs",))


def _parts(prefix, s, names="xywh"):
    return {f"{prefix}{n}": s[n] for n in names}


AFF = ("sx", "sy", "tx", "ty")
_SX = "(CASE WHEN cw > 1e-9 THEN rw / cw ELSE 1.0::DOUBLE END)"
_SY = "(CASE WHEN ch > 1e-9 THEN rh / ch ELSE 1.0::DOUBLE END)"
_AFF = {"sx": _SX, "sy": _SY, "tx": f"(rx - cx * {_SX})", "ty": f"(ry - cy * {_SY})"}

pair_query("E1_area", lambda c, r: {"a": R.area(c), "b": R.area_clamped(r)}, {"a": "cw * ch", "b": "rw * rh"})
pair_query("E2_center", lambda c, r: _parts("c", R.center(r), "xy"), {"cx": "rx + rw / 2.0::DOUBLE", "cy": "ry + rh / 2.0::DOUBLE"})
pair_query(
    "E3_contains",
    lambda c, r: {"is_in": R.contains(c, r), "is_fine": R.contains(c, r, 1e-9), "is_strict": R.contains(r, c, 0.0)},
    {"is_in": K.contains("c", "r"), "is_fine": K.contains("c", "r", 1e-9), "is_strict": K.contains("r", "c", 0.0)},
)
pair_query("E4_iou", lambda c, r: {"s": R.iou(c, r), "t": R.iou_transform(c, r)}, {"s": K.iou("c", "r"), "t": K.iou_t("c", "r")})
pair_query("E5_center_distance", lambda c, r: {"v": R.center_distance(c, r)}, {"v": K.cdist("c", "r")})
pair_query("E6_geometry_distance", lambda c, r: {"v": R.geometry_distance(c, r)}, {"v": K.gdist("c", "r")})
pair_query(
    "E7_spans",
    lambda c, r: {"o": R.x_overlap(c, r), "g": R.x_gap(c, r)},
    {"o": K.overlap("cx", "cx + cw", "rx", "rx + rw"), "g": K.gap("cx", "cx + cw", "rx", "rx + rw")},
)
pair_query("E8_adjacent", lambda c, r: {"is_adj": R.adjacent(c, r)}, {"is_adj": K.adjacent("c", "r")})
pair_query(
    "E9_edge_distance",
    lambda c, r: {"v": R.edge_distance(c, r)},
    {"v": "least(rx - cx, ry - cy, cx + cw - (rx + rw), cy + ch - (ry + rh))"},
)
_REL = {
    "rx": "(rx - cx) / greatest(cw, 1e-6)",
    "ry": "(ry - cy) / greatest(ch, 1e-6)",
    "rw": "rw / greatest(cw, 1e-6)",
    "rh": "rh / greatest(ch, 1e-6)",
}
pair_query("E10_relative", lambda c, r: _parts("r", R.relative(r, c)), _REL)
_PX, _PY = "(cx + (rx - cx) / greatest(cw, 1e-6) * cw)", "(cy + (ry - cy) / greatest(ch, 1e-6) * ch)"
pair_query(
    "E11_project_relative",
    lambda c, r: _parts("p", R.project_relative(R.relative(r, c), c)["box"]),
    {"px": clamp01(_PX), "py": clamp01(_PY), "pw": clamp01("rw"), "ph": clamp01("rh")},
)
pair_query(
    "E12_re_express",
    lambda c, r: _parts("q", R.re_express(R.relative(r, c), c, R.make(F.col("cx"), F.col("cy"), F.col("rw"), F.col("rh")))),
    {"qx": "(rx - cx) / greatest(rw, 1e-9)", "qy": "(ry - cy) / greatest(rh, 1e-9)", "qw": "rw / greatest(rw, 1e-9)", "qh": "rh / greatest(rh, 1e-9)"},
)
_U = {"ux": "least(cx, rx)", "uy": "least(cy, ry)", "uw": "greatest(cx + cw, rx + rw) - least(cx, rx)", "uh": "greatest(cy + ch, ry + rh) - least(cy, ry)"}
pair_query("E13_union", lambda c, r: _parts("u", R.union(c, r)), _U)
add(
    "E13_union_agg",
    lambda s, sf: PAIRS(s, sf)
    .groupBy("doc_id")
    .agg(R.union_agg(_rects()[1]).alias("u"))
    .select("doc_id", *[rnd(F.col(f"u.{k}")).alias(f"u{k}") for k in "xywh"]),
    f"""SELECT doc_id, {K.r6('min(rx)', 'ux')}, {K.r6('min(ry)', 'uy')}, {K.r6('max(rx + rw) - min(rx)', 'uw')},
     {K.r6('max(ry + rh) - min(ry)', 'uh')} FROM fx_pairs GROUP BY 1""",
    ("fx_pairs",),
)
pair_query(
    "E14_pixels",
    lambda c, r: {
        **_parts("p", R.to_pixels(r, F.lit(850.0), F.lit(1100.0))),
        **_parts("n", R.to_normalized(R.to_pixels(r, F.lit(1700.0), F.lit(1100.0)), F.lit(850.0), F.lit(1100.0))),
        **_parts("k", R.from_corners(F.col("rx") * 900, F.col("cy") * 900, F.col("cx") * 400, F.col("ry") * 400, F.lit(800.0), F.lit(600.0))),
    },
    {
        "px": "rx * 850.0::DOUBLE", "py": "ry * 1100.0::DOUBLE", "pw": "rw * 850.0::DOUBLE", "ph": "rh * 1100.0::DOUBLE",
        "nx": clamp01("rx * 2"), "ny": clamp01("ry"), "nw": clamp01("rw * 2"), "nh": clamp01("rh"),
        "kx": "greatest(0.0::DOUBLE, least(rx * 900, cx * 400))", "ky": "greatest(0.0::DOUBLE, least(cy * 900, ry * 400))",
        "kw": "greatest(0.0::DOUBLE, least(800.0::DOUBLE, greatest(rx * 900, cx * 400)) - greatest(0.0::DOUBLE, least(rx * 900, cx * 400)))",
        "kh": "greatest(0.0::DOUBLE, least(600.0::DOUBLE, greatest(cy * 900, ry * 400)) - greatest(0.0::DOUBLE, least(cy * 900, ry * 400)))",
    },
)
_SHIFT = "(rx + 0.25::DOUBLE)"
pair_query(
    "E15_in_bounds",
    lambda c, r: {
        "is_in": R.in_bounds(R.make(F.col("rx") + 0.25, F.col("ry"), F.col("rw"), F.col("rh"))),
        "is_fine": R.in_bounds(R.make(F.col("rx") * 0 + 0.9, F.col("ry"), F.col("rw"), F.col("rh")), 1e-9),
    },
    {
        "is_in": f"({_SHIFT} <= 1 AND ry <= 1 AND rw > 0 AND rh > 0 AND {_SHIFT} + rw <= 1 + 2.220446049250313e-16 AND ry + rh <= 1 + 2.220446049250313e-16)",
        "is_fine": "(rx * 0 + 0.9::DOUBLE + rw <= 1 + 1e-9 AND ry + rh <= 1 + 1e-9)",
    },
)


def _moved(c, r):
    return R.make(F.col("rx") * F.lit(1.6) - F.lit(0.2), F.col("ry") * F.lit(1.4) - F.lit(0.1), F.col("rw") * F.lit(1.3), F.col("rh"))


_CX, _CY, _CW, _CH = "(rx * 1.6::DOUBLE - 0.2::DOUBLE)", "(ry * 1.4::DOUBLE - 0.1::DOUBLE)", "(rw * 1.3::DOUBLE)", "rh"
_OFF = f"({_CX} < -1e-6 OR {_CX} + {_CW} > 1 + 1e-6 OR {_CY} < -1e-6 OR {_CY} + {_CH} > 1 + 1e-6)"


def _fit(p, s):
    return f"(CASE WHEN {s} > 1 THEN 0.0::DOUBLE WHEN {p} < 0 THEN 0.0::DOUBLE WHEN {p} + {s} > 1 THEN 1.0::DOUBLE - {s} ELSE {p} END)"


_F4 = "format('{:.4f}', %s)"
pair_query(
    "E16_clip_box",
    lambda c, r: {**_parts("b", R.clip_box(_moved(c, r), "projected")["box"]), "t_warn": R.clip_box(_moved(c, r), "projected")["warning"]},
    {
        "bx": f"CASE WHEN {_OFF} THEN {clamp01(_fit(_CX, _CW))} ELSE {clamp01(_CX)} END",
        "by": f"CASE WHEN {_OFF} THEN {clamp01(_fit(_CY, _CH))} ELSE {clamp01(_CY)} END",
        "bw": clamp01(_CW),
        "bh": clamp01(_CH),
        "t_warn": f"""CASE WHEN {_OFF} THEN concat(CASE WHEN {_CW} > 1 OR {_CH} > 1 THEN concat('projected box exceeds page in ',
           concat_ws('/', CASE WHEN {_CW} > 1 THEN 'width' END, CASE WHEN {_CH} > 1 THEN 'height' END), '; clamped (size reduced)')
           ELSE 'projected box partially off-page; shifted back to fit (width/height preserved)' END, '; off-page sides=[',
           concat_ws(',', CASE WHEN {_CX} < -1e-6 THEN 'left' END, CASE WHEN {_CX} + {_CW} > 1 + 1e-6 THEN 'right' END,
             CASE WHEN {_CY} < -1e-6 THEN 'top' END, CASE WHEN {_CY} + {_CH} > 1 + 1e-6 THEN 'bottom' END), '] unclipped=[',
           concat_ws(',', {_F4 % _CX}, {_F4 % _CY}, {_F4 % f'({_CX} + {_CW})'}, {_F4 % f'({_CY} + {_CH})'}), ']') END""",
    },
)
pair_query(
    "E17_pad_box",
    lambda c, r: _parts("p", R.pad_box(r, F.col("confidence") / 50)),
    {
        "px": clamp01("rx - least(0.02::DOUBLE, confidence / 50)"),
        "py": clamp01("ry - least(0.02::DOUBLE, confidence / 50)"),
        "pw": f"greatest(0.0::DOUBLE, {clamp01('rx + rw + least(0.02::DOUBLE, confidence / 50)')} - {clamp01('rx - least(0.02::DOUBLE, confidence / 50)')})",
        "ph": f"greatest(0.0::DOUBLE, {clamp01('ry + rh + least(0.02::DOUBLE, confidence / 50)')} - {clamp01('ry - least(0.02::DOUBLE, confidence / 50)')})",
    },
)
pair_query("E18_affine_from_rects", lambda c, r: _parts("a_", R.affine_from_rects(c, r), AFF), {f"a_{k}": v for k, v in _AFF.items()})
pair_query(
    "E18_affine_floored",
    lambda c, r: _parts("a_", R.affine_from_rects_floored(c, r), AFF),
    {"a_sx": "rw / greatest(cw, 1e-9)", "a_sy": "rh / greatest(ch, 1e-9)", "a_tx": "rx - cx * (rw / greatest(cw, 1e-9))", "a_ty": "ry - cy * (rh / greatest(ch, 1e-9))"},
)
pair_query(
    "E19_apply_affine",
    lambda c, r: _parts("p", R.apply_affine(R.make(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)), R.affine_from_rects(c, r))),
    {"px": f"0.1::DOUBLE * {_AFF['sx']} + {_AFF['tx']}", "py": f"0.2::DOUBLE * {_AFF['sy']} + {_AFF['ty']}", "pw": f"0.3::DOUBLE * {_AFF['sx']}", "ph": f"0.4::DOUBLE * {_AFF['sy']}"},
)


def _ident():
    return R.make_affine(F.lit(1.0), F.lit(1.0), F.lit(0.02), F.lit(0.01))


pair_query(
    "E20_affine_dist",
    lambda c, r: {
        **_parts("s_", R.affine_sub(R.affine_from_rects(c, r), _ident()), AFF),
        "scale": R.affine_dist(R.affine_from_rects(c, r), _ident())["scale"],
        "translate": R.affine_dist(R.affine_from_rects(c, r), _ident())["translate"],
    },
    {
        "s_sx": f"{_AFF['sx']} - 1", "s_sy": f"{_AFF['sy']} - 1", "s_tx": f"{_AFF['tx']} - 0.02::DOUBLE", "s_ty": f"{_AFF['ty']} - 0.01::DOUBLE",
        "scale": f"greatest(abs({_AFF['sx']} - 1), abs({_AFF['sy']} - 1))",
        "translate": f"greatest(abs({_AFF['tx']} - 0.02::DOUBLE), abs({_AFF['ty']} - 0.01::DOUBLE))",
    },
)
pair_query(
    "E21_near_identity",
    lambda c, r: {
        "is_near": R.near_identity(R.affine_from_rects(c, r), 0.0055),
        "is_near_evidence": R.near_identity_evidence(R.affine_from_rects(c, r)),
    },
    {
        "is_near": f"(abs({_AFF['sx']} - 1) <= 0.0055::DOUBLE AND abs({_AFF['sy']} - 1) <= 0.0055::DOUBLE AND abs({_AFF['tx']}) <= 0.0055::DOUBLE AND abs({_AFF['ty']}) <= 0.0055::DOUBLE)",
        "is_near_evidence": f"(abs({_AFF['sx']} - 1) < 0.01::DOUBLE AND abs({_AFF['sy']} - 1) < 0.01::DOUBLE AND abs({_AFF['tx']}) < 0.005::DOUBLE AND abs({_AFF['ty']}) < 0.005::DOUBLE)",
    },
)
pair_query(
    "E22_size_delta",
    lambda c, r: {"d": R.size_delta(c, r), "p": R.aspect_parity(c, r)},
    {"d": K.size_delta("c", "r"), "p": K.aspect_parity("c", "r")},
)
pair_query(
    "E23_clamp01",
    lambda c, r: {"v": R.clamp01(F.col("rx") * 3 - 1), "z": R.clamp01(F.when(F.col("rx") > 0.5, F.lit(float("nan"))).otherwise(F.col("rx") * 2), True)},
    {"v": clamp01("rx * 3 - 1"), "z": "CASE WHEN rx > 0.5::DOUBLE THEN 0.0::DOUBLE ELSE " + clamp01("rx * 2") + " END"},
)
pair_query(
    "E24_positional_id",
    lambda c, r: {"is_pos": R.positional_id(F.col("config_id")), "is_pos_r": R.positional_id(F.col("runtime_id"))},
    {"is_pos": "regexp_matches(config_id, '^obj(?:_[a-z]+)*_\\d+$')", "is_pos_r": "regexp_matches(runtime_id, '^obj(?:_[a-z]+)*_\\d+$')"},
)
