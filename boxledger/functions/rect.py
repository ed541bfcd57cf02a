"""Rect and affine expressions (E-1..E-24) as pure Catalyst columns.

A rect is a struct ``x,y,w,h`` of doubles in page units [0,1]; a relative rect has the same
shape but holds ratios; an affine is a struct ``sx,sy,tx,ty``. No function here runs Python
per row: every one returns a ``Column`` that stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed tolerances that decide results.
EPS_HIERARCHY = 1e-6
EPS_FINE = 1e-9
EPS_CLIP = 1e-6
EPS_MACHINE = 2.220446049250313e-16
ADJACENT_GAP = 0.04
POSITIONAL_ID_PATTERN = r"^obj(?:_[a-z]+)*_\d+$"


def lit(v: float) -> Column:
    return F.lit(float(v))


def make(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def pack(prefix: str = "", suffix: str = "") -> Column:
    """Rect struct from the flat columns x,y,w,h of a table."""
    return make(*[F.col(f"{prefix}{c}{suffix}") for c in "xywh"])


def full_page() -> Column:
    return make(lit(0), lit(0), lit(1), lit(1))


def make_affine(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    return F.struct(sx.alias("sx"), sy.alias("sy"), tx.alias("tx"), ty.alias("ty"))


def clamp01(v: Column, non_finite_zero: bool = False) -> Column:
    """E-23. Non-finite becomes 0 in the statistics variant."""
    out = F.least(lit(1), F.greatest(lit(0), v))
    if non_finite_zero:
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == lit(float("inf")))
        return F.when(bad, lit(0)).otherwise(out)
    return out


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def area(r: Column) -> Column:
    """E-1."""
    return r["w"] * r["h"]


def area_clamped(r: Column) -> Column:
    """E-1, negative sides count as zero."""
    return F.greatest(lit(0), r["w"]) * F.greatest(lit(0), r["h"])


def center_x(r: Column) -> Column:
    return r["x"] + r["w"] / lit(2)


def center_y(r: Column) -> Column:
    return r["y"] + r["h"] / lit(2)


def center(r: Column) -> Column:
    """E-2."""
    return F.struct(center_x(r).alias("x"), center_y(r).alias("y"))


def contains(outer: Column, inner: Column, eps: float = EPS_HIERARCHY) -> Column:
    """E-3: all four edges of inner within outer, up to eps."""
    e = lit(eps)
    return (
        (inner["x"] + e >= outer["x"])
        & (inner["y"] + e >= outer["y"])
        & (right(inner) <= right(outer) + e)
        & (bottom(inner) <= bottom(outer) + e)
    )


def touching(a: Column, b: Column) -> Column:
    """The rects meet: a cheap condition that any positive overlap needs."""
    return (a["x"] <= right(b)) & (b["x"] <= right(a)) & (a["y"] <= bottom(b)) & (b["y"] <= bottom(a))


def _intersection(a: Column, b: Column) -> tuple[Column, Column]:
    iw = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    ih = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return iw, ih


def iou(a: Column, b: Column) -> Column:
    """E-4, structural variant: zero without positive overlap or union."""
    iw, ih = _intersection(a, b)
    inter = iw * ih
    union = area(a) + area(b) - inter
    return F.when((iw <= 0) | (ih <= 0) | (union <= 0), lit(0)).otherwise(inter / union)


def iou_transform(a: Column, b: Column) -> Column:
    """E-4, transform variant: clamped areas, zero when the union is at most 1e-9."""
    iw, ih = _intersection(a, b)
    inter = F.greatest(lit(0), iw) * F.greatest(lit(0), ih)
    union = area_clamped(a) + area_clamped(b) - inter
    return F.when(union <= lit(EPS_FINE), lit(0)).otherwise(inter / union)


def center_distance(a: Column, b: Column) -> Column:
    """E-5."""
    dx = center_x(a) - center_x(b)
    dy = center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def geometry_distance(a: Column, b: Column) -> Column:
    """E-6."""
    return (
        F.abs(center_x(a) - center_x(b))
        + F.abs(center_y(a) - center_y(b))
        + F.abs(a["w"] - b["w"])
        + F.abs(a["h"] - b["h"])
    )


def overlap_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """E-7."""
    return F.greatest(lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def gap_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """E-7."""
    return F.greatest(lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def x_overlap(a: Column, b: Column) -> Column:
    return overlap_span(a["x"], right(a), b["x"], right(b))


def y_overlap(a: Column, b: Column) -> Column:
    return overlap_span(a["y"], bottom(a), b["y"], bottom(b))


def x_gap(a: Column, b: Column) -> Column:
    return gap_span(a["x"], right(a), b["x"], right(b))


def y_gap(a: Column, b: Column) -> Column:
    return gap_span(a["y"], bottom(a), b["y"], bottom(b))


def adjacent(a: Column, b: Column) -> Column:
    """E-8."""
    e, g = lit(EPS_HIERARCHY), lit(ADJACENT_GAP)
    side = (y_overlap(a, b) > e) & (x_gap(a, b) > e) & (x_gap(a, b) <= g)
    stacked = (x_overlap(a, b) > e) & (y_gap(a, b) > e) & (y_gap(a, b) <= g)
    return side | stacked


def edge_distance(outer: Column, inner: Column) -> Column:
    """E-9; negative when inner sticks out."""
    return F.least(
        inner["x"] - outer["x"],
        inner["y"] - outer["y"],
        right(outer) - right(inner),
        bottom(outer) - bottom(inner),
    )


def relative(subject: Column, anchor: Column, floor: float = EPS_HIERARCHY) -> Column:
    """E-10: offsets and sizes of subject as ratios of the anchor's size."""
    w = F.greatest(anchor["w"], lit(floor))
    h = F.greatest(anchor["h"], lit(floor))
    return make(
        (subject["x"] - anchor["x"]) / w, (subject["y"] - anchor["y"]) / h, subject["w"] / w, subject["h"] / h
    )


def from_relative(rel: Column, anchor: Column) -> Column:
    """Inverse of E-10 without clipping."""
    return make(
        anchor["x"] + rel["x"] * anchor["w"],
        anchor["y"] + rel["y"] * anchor["h"],
        rel["w"] * anchor["w"],
        rel["h"] * anchor["h"],
    )


def project_relative(rel: Column, anchor: Column) -> Column:
    """E-11: from_relative followed by the page clip; struct of box and warning."""
    return clip_box(from_relative(rel, anchor), "projected")


def re_express(rel: Column, old: Column, new: Column) -> Column:
    """E-12: same absolute rect, ratios against another anchor."""
    return relative(from_relative(rel, old), new, EPS_FINE)


def from_edges(left: Column, top: Column, r: Column, b: Column) -> Column:
    return make(left, top, r - left, b - top)


def union(a: Column, b: Column) -> Column:
    """E-13."""
    return from_edges(
        F.least(a["x"], b["x"]),
        F.least(a["y"], b["y"]),
        F.greatest(right(a), right(b)),
        F.greatest(bottom(a), bottom(b)),
    )


def union_clamped(a: Column, b: Column) -> Column:
    """E-13 with edges clamped to the page and non-negative sides."""
    left, top = clamp01(F.least(a["x"], b["x"])), clamp01(F.least(a["y"], b["y"]))
    r = clamp01(F.greatest(right(a), right(b)))
    bt = clamp01(F.greatest(bottom(a), bottom(b)))
    return make(left, top, F.greatest(lit(0), r - left), F.greatest(lit(0), bt - top))


def union_agg(r: Column) -> Column:
    """E-13 over the rows of a group; min/max combine map-side."""
    return from_edges(F.min(r["x"]), F.min(r["y"]), F.max(right(r)), F.max(bottom(r)))


def to_normalized(px: Column, width: Column, height: Column) -> Column:
    """E-14."""
    return make(
        clamp01(px["x"] / width), clamp01(px["y"] / height), clamp01(px["w"] / width), clamp01(px["h"] / height)
    )


def to_pixels(r: Column, width: Column, height: Column) -> Column:
    """E-14."""
    return make(r["x"] * width, r["y"] * height, r["w"] * width, r["h"] * height)


def from_corners(ax: Column, ay: Column, bx: Column, by: Column, width: Column, height: Column) -> Column:
    """E-14: pixel rect spanned by two corners, clipped to the page."""
    x0 = F.greatest(lit(0), F.least(ax, bx))
    y0 = F.greatest(lit(0), F.least(ay, by))
    x1 = F.least(width, F.greatest(ax, bx))
    y1 = F.least(height, F.greatest(ay, by))
    return make(x0, y0, F.greatest(lit(0), x1 - x0), F.greatest(lit(0), y1 - y0))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != lit(float("inf")))


def all_finite(r: Column) -> Column:
    return finite(r["x"]) & finite(r["y"]) & finite(r["w"]) & finite(r["h"])


def in_bounds(r: Column, slack: float = EPS_MACHINE) -> Column:
    """E-15: finite, inside [0,1], positive sides, right and bottom at most 1 + slack."""
    inside = F.lit(True)
    for c in "xywh":
        inside = inside & (r[c] >= 0) & (r[c] <= 1)
    return all_finite(r) & inside & (r["w"] > 0) & (r["h"] > 0) & (right(r) <= lit(1 + slack)) & (
        bottom(r) <= lit(1 + slack)
    )


def _fit_axis(pos: Column, size: Column) -> tuple[Column, Column]:
    size = F.greatest(size, lit(0))
    shifted = F.when(size > 1, lit(0)).when(pos < 0, lit(0)).when(pos + size > 1, lit(1) - size).otherwise(pos)
    return shifted, F.least(size, lit(1))


def _fixed4(v: Column) -> Column:
    return F.format_string("%.4f", v)


def clip_box(r: Column, origin: str) -> Column:
    """E-16: struct(box, warning).

    Inside the page (within 1e-6) the sides are clamped and there is no warning. Otherwise the
    box is moved back keeping its size, and only a side longer than the page is cut.
    """
    t = lit(EPS_CLIP)
    sides = {
        "left": r["x"] < -t,
        "right": right(r) > lit(1) + t,
        "top": r["y"] < -t,
        "bottom": bottom(r) > lit(1) + t,
    }
    off = sides["left"] | sides["right"] | sides["top"] | sides["bottom"]
    x, w = _fit_axis(r["x"], r["w"])
    y, h = _fit_axis(r["y"], r["h"])
    moved = F.when(off, make(clamp01(x), clamp01(y), clamp01(w), clamp01(h))).otherwise(
        make(clamp01(r["x"]), clamp01(r["y"]), clamp01(r["w"]), clamp01(r["h"]))
    )
    named = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in sides.items()])
    shrunk = F.concat_ws("/", F.when(r["w"] > 1, F.lit("width")), F.when(r["h"] > 1, F.lit("height")))
    note = F.when(
        shrunk != "", F.concat(F.lit(f"{origin} box exceeds page in "), shrunk, F.lit("; clamped (size reduced)"))
    ).otherwise(F.lit(f"{origin} box partially off-page; shifted back to fit (width/height preserved)"))
    unclipped = F.concat_ws(
        ",",
        _fixed4(r["x"]),
        _fixed4(r["y"]),
        _fixed4(r["x"] + F.greatest(r["w"], lit(0))),
        _fixed4(r["y"] + F.greatest(r["h"], lit(0))),
    )
    warning = F.when(
        off, F.concat(note, F.lit("; off-page sides=["), named, F.lit("] unclipped=["), unclipped, F.lit("]"))
    )
    return F.struct(moved.alias("box"), warning.alias("warning"))


def pad_box(r: Column, padding: Column) -> Column:
    """E-17: grow by a padding limited to [0, 0.02], edges clamped to the page."""
    p = F.greatest(lit(0), F.least(lit(0.02), padding))
    left, top = clamp01(r["x"] - p), clamp01(r["y"] - p)
    rt, bt = clamp01(right(r) + p), clamp01(bottom(r) + p)
    return make(left, top, F.greatest(lit(0), rt - left), F.greatest(lit(0), bt - top))


def affine_from_rects(config: Column, runtime: Column) -> Column:
    """E-18: scale runtime/config per axis (1 for a degenerate config side) and the matching shift."""
    sx = F.when(config["w"] > lit(EPS_FINE), runtime["w"] / config["w"]).otherwise(lit(1))
    sy = F.when(config["h"] > lit(EPS_FINE), runtime["h"] / config["h"]).otherwise(lit(1))
    return make_affine(sx, sy, runtime["x"] - config["x"] * sx, runtime["y"] - config["y"] * sy)


def affine_from_rects_floored(config: Column, runtime: Column) -> Column:
    """E-18, localization variant: the config side is floored at 1e-9 instead."""
    sx = runtime["w"] / F.greatest(config["w"], lit(EPS_FINE))
    sy = runtime["h"] / F.greatest(config["h"], lit(EPS_FINE))
    return make_affine(sx, sy, runtime["x"] - config["x"] * sx, runtime["y"] - config["y"] * sy)


def apply_affine(r: Column, a: Column) -> Column:
    """E-19."""
    return make(r["x"] * a["sx"] + a["tx"], r["y"] * a["sy"] + a["ty"], r["w"] * a["sx"], r["h"] * a["sy"])


def affine_sub(a: Column, b: Column) -> Column:
    """E-20."""
    return make_affine(a["sx"] - b["sx"], a["sy"] - b["sy"], a["tx"] - b["tx"], a["ty"] - b["ty"])


def scale_delta(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a["sx"] - b["sx"]), F.abs(a["sy"] - b["sy"]))


def translate_delta(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a["tx"] - b["tx"]), F.abs(a["ty"] - b["ty"]))


def affine_dist(a: Column, b: Column) -> Column:
    """E-20: largest scale and largest translate difference."""
    return F.struct(scale_delta(a, b).alias("scale"), translate_delta(a, b).alias("translate"))


def near_identity(a: Column, tol: float = 0.005) -> Column:
    """E-21, consensus variant: all four components within tol of the identity (inclusive)."""
    t = lit(tol)
    return (
        (F.abs(a["sx"] - 1) <= t) & (F.abs(a["sy"] - 1) <= t) & (F.abs(a["tx"]) <= t) & (F.abs(a["ty"]) <= t)
    )


def near_identity_evidence(a: Column) -> Column:
    """E-21, statistics variant: strict, 0.01 on scale and 0.005 on translate."""
    return (
        (F.abs(a["sx"] - 1) < lit(0.01))
        & (F.abs(a["sy"] - 1) < lit(0.01))
        & (F.abs(a["tx"]) < lit(0.005))
        & (F.abs(a["ty"]) < lit(0.005))
    )


def size_delta(a: Column, b: Column) -> Column:
    """E-22."""
    e = lit(1e-6)
    return F.greatest(
        F.abs(a["w"] - b["w"]) / F.greatest(a["w"], b["w"], e), F.abs(a["h"] - b["h"]) / F.greatest(a["h"], b["h"], e)
    )


def aspect(r: Column) -> Column:
    return F.when(r["h"] > lit(EPS_FINE), r["w"] / r["h"]).otherwise(lit(1))


def aspect_parity(a: Column, b: Column) -> Column:
    """E-22."""
    return F.least(aspect(a), aspect(b)) / F.greatest(aspect(a), aspect(b), lit(1e-6))


def positional_id(object_id: Column) -> Column:
    """E-24: detector-made ids such as ``obj_cv_12`` that carry no meaning across documents."""
    return object_id.rlike(POSITIONAL_ID_PATTERN)
