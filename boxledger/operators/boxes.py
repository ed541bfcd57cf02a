"""Detections to page hierarchy (D-1..D-23).

Detections are pixel boxes ``px`` (rect struct) keyed by (doc_id, page_index, object_id); page
objects carry a rect in page units in ``rect``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.greedy import suppressed
from boxledger.operators.spatial import (
    CROWD,
    NORM_LEVELS,
    PIXEL_LEVELS,
    containment_pairs,
    crowds,
    known_small,
    lookalike_pairs,
    without_crowds,
)
from boxledger.session import cut

PAGE = ["doc_id", "page_index"]

# Fixed values that decide which boxes survive.
DUPLICATE_MIN = 0.85
TRIVIAL_MIN = 0.95
NEAR_DISTANCE = 0.35
TOUCH_CELL = 0.125  # side of the grid in which adjacent boxes meet; any value gives the same pairs
MIN_CONTENT_SIDE = 4
CONFIRMED_BASE = 0.78
DENSITY_OBJECTS, DENSITY_RADIUS, DENSITY_CONFIDENCE = 2, 2.0, 0.7
OVERLAY_MIN_CONFIDENCE = {"simple": 0.75, "advanced": 0.0}
BLOB_MIN_AREA = 0.01
GLYPH_ASPECT, GLYPH_FILL = 12.0, 0.55


# ------------------------------------------------------------------ detection filters
def page_thresholds(surfaces: DataFrame) -> DataFrame:
    """D-1: page-relative floors."""
    w, h = F.col("width"), F.col("height")
    side = F.greatest(F.lit(1), F.least(w, h))

    def floor_at(minimum: int, value: Column) -> Column:
        return F.greatest(F.lit(minimum).cast("long"), F.floor(value + F.lit(0.5)).cast("long"))

    return surfaces.select(
        *PAGE,
        "width",
        "height",
        floor_at(36, F.greatest(F.lit(1), w * h) * F.lit(0.0008)).alias("min_area"),
        floor_at(24, side * F.lit(0.025)).alias("min_line_length"),
        floor_at(6, side * F.lit(0.01)).alias("max_line_thickness"),
        floor_at(8, F.least(w, h) * F.lit(0.012)).alias("glyph_min_side"),
    )


def with_thresholds(det: DataFrame, thresholds: DataFrame) -> DataFrame:
    return det.join(thresholds, PAGE)


def clamp_and_floor(det: DataFrame, thresholds: DataFrame) -> DataFrame:
    """D-2: clamp boxes to the page, drop empty and too small ones."""
    t = with_thresholds(det, thresholds)
    px = F.col("px")
    clamped = R.from_corners(px["x"], px["y"], R.right(px), R.bottom(px), F.col("width"), F.col("height"))
    out = t.withColumn("px", clamped)
    keep = (F.col("px.w") > 0) & (F.col("px.h") > 0) & (R.area(F.col("px")) >= F.col("min_area"))
    return out.where(keep).select(*det.columns)


def drop_line_shaped(det: DataFrame, thresholds: DataFrame) -> DataFrame:
    """D-3."""
    w, h = F.col("px.w"), F.col("px.h")
    thin, long = F.col("max_line_thickness"), F.col("min_line_length")
    line = ((h <= thin) & (w >= long)) | ((w <= thin) & (h >= long))
    return with_thresholds(det, thresholds).where(~line).select(*det.columns)


def glyph_gate(det: DataFrame, thresholds: DataFrame, presume_large: bool = False) -> DataFrame:
    """D-4; ``presume_large`` treats boxes of four glyph sides as confirmed (blob sources)."""
    w, h, floor = F.col("px.w"), F.col("px.h"), F.col("glyph_min_side")
    side = F.least(w, h)
    confirmed = (side >= floor * 4) if presume_large else F.coalesce(F.col("confirmed"), F.lit(False))
    fill = F.coalesce(F.col("fill_ratio"), F.when(confirmed, F.lit(1.0)).otherwise(F.lit(0.0)))
    aspect = w / h
    shaped = (aspect >= F.lit(1.0 / GLYPH_ASPECT)) & (aspect <= F.lit(GLYPH_ASPECT)) & (fill >= F.lit(GLYPH_FILL))
    keep = (w > 0) & (h > 0) & (side >= floor) & (confirmed | shaped)
    return with_thresholds(det, thresholds).where(keep).select(*det.columns)


def score_boxes(det: DataFrame, surfaces: DataFrame, base: float = 0.62, line_bounded: bool = False) -> DataFrame:
    """D-5: confidence from shape evidence and share of the page."""
    t = det.join(surfaces.select(*PAGE, "width", "height"), PAGE)
    share = R.area(F.col("px")) / F.greatest(F.lit(1), F.col("width") * F.col("height"))
    if line_bounded:
        score = F.lit(CONFIRMED_BASE) + F.least(F.lit(0.18), share)
    else:
        b = F.when(F.coalesce(F.col("confirmed"), F.lit(False)), F.lit(CONFIRMED_BASE)).otherwise(F.lit(float(base)))
        score = b + F.least(F.lit(1.0), share) * (F.lit(1.0) - b)
    return t.withColumn("confidence", F.least(F.lit(0.99), score)).select(
        *[c for c in det.columns if c != "confidence"], "confidence"
    )


# ------------------------------------------------------------------ duplicates
def is_duplicate(a: Column, b: Column) -> Column:
    """D-7: same object seen twice, neither box inside the other."""
    aa, ab = R.area(a), R.area(b)
    ra = a["w"] / F.greatest(R.lit(R.EPS_HIERARCHY), a["h"])
    rb = b["w"] / F.greatest(R.lit(R.EPS_HIERARCHY), b["h"])
    m = R.lit(DUPLICATE_MIN)
    return (
        (aa > 0)
        & (ab > 0)
        & (R.iou(a, b) >= m)
        & (F.least(aa, ab) / F.greatest(aa, ab) >= m)
        & (F.least(ra, rb) / F.greatest(ra, rb) >= m)
        & ~R.contains(a, b)
        & ~R.contains(b, a)
    )


def duplicate_pairs(det: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-7: (keys, a_id, b_id) of all duplicates of a group, smaller id first.

    Boxes of a small group meet on ``keys``, where they are dealt once; those of a crowd meet in a grid.
    """
    few, crowd = split_pages(det, keys, det.select(*keys, "object_id", *[F.col(f"px.{c}").alias(f"_{c}") for c in "xywh"]))
    named = lambda df, n: df.select(*keys, F.col("object_id").alias(f"{n}_id"), *[F.col(f"_{c}").alias(f"_{n}{c}") for c in "xywh"])
    a, b = R.pack("_a"), R.pack("_b")
    out = lambda near: near.where((F.col("a_id") < F.col("b_id")) & R.touching(a, b) & is_duplicate(a, b)).select(*keys, "a_id", "b_id")
    small = out(named(few, "a").join(named(few, "b"), keys))
    return small if crowd is None else small.unionByName(out(lookalike_pairs(named(crowd, "a"), named(crowd, "b"), keys, a, b, PIXEL_LEVELS)))


def is_trivial_containment(a: Column, b: Column) -> Column:
    """One box inside the other and both practically equal."""
    aa, ab = R.area(a), R.area(b)
    m = R.lit(TRIVIAL_MIN)
    return (
        (aa > 0)
        & (ab > 0)
        & (R.contains(a, b) | R.contains(b, a))
        & (F.least(aa, ab) / F.greatest(aa, ab) >= m)
        & (R.iou(a, b) >= m)
    )


def _on_page(value: Column, keys: list[str], where: Column | None = None) -> Column:
    """``value`` of all rows of the page (of those that meet ``where``), an array at each row; nothing for a key that is null.

    For pages of few rows: they lie together once, dealt by ``keys``, and stay there for the next step on the same keys.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return F.collect_list(F.when(known if where is None else known & where, value)).over(Window.partitionBy(*keys))


def split_pages(rows: DataFrame, keys: list[str], parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (``parts``: what is needed of them) of pages of few rows, dealt by ``keys``, and those of crowded pages, None if there are none.

    Rows are dealt as they are, before anything is worked out for them; what an earlier step dealt stays where it is.
    """
    parts = rows if parts is None else parts
    if known_small(rows, keys):
        return parts, None
    many = crowds(rows, keys)
    few = parts if many is None else parts.join(many, keys, "left_anti")
    return few.repartition(*keys), None if many is None else parts.join(many, keys, "left_semi")


def _united(small: DataFrame, crowded: DataFrame | None, keys: list[str]) -> DataFrame:
    return without_crowds(small, keys) if crowded is None else small.unionByName(crowded)


def _numbered(rows: DataFrame, keys: list[str], box: str, order: Column) -> DataFrame:
    """Keys, the sides of the rects and ``_o``: plain numbers keep the condition of a pair small and compiled."""
    return rows.select(*keys, *[F.col(f"{box}.{c}").alias(f"_{c}") for c in "xywh"], order.alias("_o"))


def _conflicts(boxes: DataFrame, keys: list[str], box: str, order: Column, conflict, levels) -> DataFrame:
    """Edges (loser, winner) of an ordered scan over crowded groups, found in a grid.

    Of exact copies only the first in order can decide anything for later rows (a later copy is
    kept only if the first one is), so winners are one representative per distinct rect: a group
    of n copies gives n edges, not n². Both orders are kept, for scans and "first winner" rules.
    """
    sides = [f"_{c}" for c in "xywh"]
    a, b = R.pack("_w"), R.pack("_")
    rows = _numbered(boxes, keys, box, order)
    firsts = rows.groupBy(*keys, *sides).agg(F.min("_o").alias("_wo"))
    reps = firsts.select(*keys, *[F.col(c).alias(f"_w{c[1]}") for c in sides], "_wo")
    near = lookalike_pairs(rows, reps, keys, b, a, levels)
    return near.where(R.touching(a, b) & conflict(a, b) & (F.col("_wo") < F.col("_o"))).select(
        *keys, F.col("_o.object_id").alias("loser"), F.col("_wo.object_id").alias("winner"),
        F.col("_o").alias("loser_order"), F.col("_wo").alias("winner_order"),
    )


def _with_edges(rows: DataFrame, keys: list[str], box: str, order: Column, conflict, group: Column | None = None) -> DataFrame:
    """Adds ``_edges``: the conflicts of the page, an array of (loser_order, g, winners) at one of its rows, NULL at the others.

    For pages of few rows. ``winners``: orders of the earlier boxes that conflict with the loser, one of each distinct rect as
    in ``_conflicts``. Boxes of different ``group`` do not conflict.
    """
    own = F.lit("") if group is None else group
    side = F.col(box)
    t = rows.withColumn("_b", F.struct(*[side[c].alias(c) for c in "xywh"], R.right(side).alias("r"), R.bottom(side).alias("b"), order.alias("o"), own.alias("g")))
    t = t.withColumn("_all", _on_page(F.col("_b"), keys))
    me = F.col("_b")
    touch = lambda a: (a["x"] <= me["r"]) & (me["x"] <= a["r"]) & (a["y"] <= me["b"]) & (me["y"] <= a["b"])
    met = F.filter("_all", lambda a: touch(a) & conflict(a, me) & (a["g"] == me["g"]) & (a["o"] < me["o"]))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in "xywh"])
    firsts = lambda m: F.filter(m, lambda a, i: (i == 0) | ~same(a, F.get(m, i - 1)))
    # Bound once: in order, equal rects lie side by side.
    winners = F.transform(F.array(F.array_sort(met)), lambda m: F.transform(firsts(m), lambda a: a["o"]))[0]
    t = t.withColumn("_won", winners).drop("_all")
    edge = F.struct(me["o"].alias("loser_order"), me["g"].alias("g"), F.col("_won").alias("winners"))
    t = t.withColumn("_page", _on_page(edge, keys, F.size("_won") > 0))
    first = F.array_min(F.transform("_page", lambda e: e["loser_order"]))
    return t.withColumn("_edges", F.when(me["o"] == first, F.col("_page"))).drop("_b", "_won", "_page")


def _ident(e: Column, order: Column) -> Column:
    return F.struct(e["g"].alias("g"), order["object_id"].alias("id"))


def _lost_of(edges: Column) -> Column:
    """(g, id) of the rows that the scan over the edges of a page drops; an id that is null is never dropped."""

    def step(lost: Column, e: Column) -> Column:
        kept = F.exists(e["winners"], lambda o: ~F.array_contains(lost, _ident(e, o)))
        return F.when(kept & e["loser_order"]["object_id"].isNotNull(), F.array_append(lost, _ident(e, e["loser_order"]))).otherwise(lost)

    return F.aggregate(F.array_sort(edges), F.array().cast("array<struct<g:string,id:string>>"), step)


def _told(rows: DataFrame, keys: list[str], outcome) -> DataFrame:
    """Adds ``_told``: ``outcome(lost, edges)`` at all rows of a page, worked out at the row that has the edges; NULL without any."""
    edges = F.col("_edges")
    once = F.when(edges.isNotNull(), F.transform(F.array(_lost_of(edges)), lambda lost: outcome(lost, edges))[0])
    t = rows.withColumn("_once", once).drop("_edges")
    return t.withColumn("_told", F.first("_once", ignorenulls=True).over(Window.partitionBy(*keys))).drop("_once")


def _by_area(box: str, *first: Column) -> Column:
    heads = [c.alias(f"k{i}") for i, c in enumerate(first)]
    return F.struct(*heads, (-R.area(F.col(box))).alias("area"), F.col("object_id").alias("object_id"))


def _scanned(boxes: DataFrame, keys: list[str], box: str, order: Column, conflict, levels) -> DataFrame:
    """``boxes`` that an ordered scan keeps.

    Boxes of a page of few lie together and learn there what is dropped, so each is moved once; those of a crowd meet in a grid.
    """
    few, crowd = split_pages(boxes, keys)
    ids = lambda lost, _: F.transform(lost, lambda x: x["id"])
    t = _told(_with_edges(few, keys, box, order, conflict), keys, ids)
    kept = t.where(~F.coalesce(F.array_contains("_told", F.col("object_id")), F.lit(False))).select(*boxes.columns)
    if crowd is not None:
        crowd = _drop(crowd, suppressed(_conflicts(crowd, keys, box, order, conflict, levels), keys), keys)
    return _united(kept, crowd, keys)


def _drop(boxes: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.join(lost.withColumnRenamed("loser", "object_id"), keys + ["object_id"], "left_anti")


def nms(det: DataFrame, threshold: float = DUPLICATE_MIN) -> DataFrame:
    """D-6: confirmed first, then larger, then id; drop a box of IoU at least ``threshold`` with a kept one."""
    order = _by_area("px", ~F.coalesce(F.col("confirmed"), F.lit(False)))
    return _scanned(det, PAGE, "px", order, lambda a, b: R.iou(a, b) >= R.lit(threshold), PIXEL_LEVELS)


def dedup_sources(det: DataFrame) -> DataFrame:
    """D-8: cross-source duplicates by D-7, same order as D-6."""
    order = _by_area("px", ~F.coalesce(F.col("confirmed"), F.lit(False)))
    return _scanned(det, PAGE, "px", order, is_duplicate, PIXEL_LEVELS)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """D-9: detections of several sources with prefixed ids, without cross-source duplicates."""
    tagged = [
        df.withColumn("object_id", F.concat(F.lit(f"{prefix}_"), F.col("object_id"))) for prefix, df in sources.items()
    ]
    return dedup_sources(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged))


def to_objects(det: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Scored detections as page objects (E-14)."""
    return det.join(surfaces.select(*PAGE, "width", "height"), PAGE).select(
        *PAGE,
        "object_id",
        F.col("object_id").alias("input_ord"),
        R.to_normalized(F.col("px"), F.col("width"), F.col("height")).alias("rect"),
        "confidence",
    )


def collapse_trivial(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-10: practically equal nested boxes become one; survivors by confidence, area, id."""
    order = _by_area("rect", -F.col("confidence"))
    return _scanned(objects, keys, "rect", order, is_trivial_containment, NORM_LEVELS)


# ------------------------------------------------------------------ hierarchy
def assign_parents(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-11: the smallest other box that contains the object; ties by input order.

    Objects of a page lie together, each looks through all of them; those of a crowded one meet in a grid, where the outer side
    keeps the first two of exact copies, enough for "the smallest other box".
    """
    few, crowd = split_pages(objects, keys, objects.drop("parent_id"))
    ri, ro = R.pack("_"), R.pack("_o")
    plain = F.struct(*[F.col(f"rect.{c}").alias(c) for c in "xywh"], F.col("input_ord").alias("ord"), F.col("object_id").alias("id"))
    t = few.withColumn("_me", plain)
    t = t.withColumn("_all", _on_page(F.col("_me"), keys))
    holds = F.filter("_all", lambda o: R.contains(o, F.col("_me")) & (o["id"] != F.col("object_id")))
    smallest = F.array_min(F.transform(holds, lambda o: F.struct(R.area(o).alias("a"), o["ord"].alias("ord"), o["id"].alias("id"))))
    t = t.withColumn("_p", smallest).drop("_all", "_me")
    # Rows of one id have one parent.
    t = t.withColumn("parent_id", F.min("_p").over(Window.partitionBy(*keys, "object_id"))["id"]).drop("_p")
    if crowd is not None:
        inner = crowd.select(*keys, "object_id", "input_ord", *[F.col(f"rect.{c}").alias(f"_{c}") for c in "xywh"])
        w = Window.partitionBy(*keys, *[f"_{c}" for c in "xywh"]).orderBy("input_ord", "object_id")
        outer = inner.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= 2)
        outer = outer.select(*keys, F.col("object_id").alias("_oid"), F.col("input_ord").alias("_oord"), *[F.col(f"_{c}").alias(f"_o{c}") for c in "xywh"])
        held = containment_pairs(inner, outer, keys, ri, ro, R.EPS_HIERARCHY).where(R.contains(ro, ri) & (F.col("_oid") != F.col("object_id")))
        best = held.groupBy(*keys, "object_id").agg(F.min(F.struct(R.area(ro).alias("a"), F.col("_oord"), F.col("_oid"))).alias("_p"))
        crowd = crowd.join(best.select(*keys, "object_id", F.col("_p._oid").alias("parent_id")), keys + ["object_id"], "left")
    return _united(t, crowd, keys)


def dedup_siblings(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-12: D-7 duplicates among siblings go; their children move to the surviving winner."""
    few, crowd = split_pages(objects, keys)

    def outcome(lost: Column, edges: Column) -> Column:
        """Lost ids, and the kept winners of each."""
        kept = lambda e: F.filter(e["winners"], lambda o: ~F.array_contains(lost, _ident(e, o)) & o["object_id"].isNotNull())
        own = F.filter(edges, lambda e: F.array_contains(lost, _ident(e, e["loser_order"])))
        heirs = F.transform(own, lambda e: F.struct(e["loser_order"]["object_id"].alias("id"), F.array_min(kept(e)).alias("heir")))
        return F.struct(F.transform(lost, lambda x: x["id"]).alias("ids"), heirs.alias("heirs"))

    t = _told(_with_edges(few, keys, "rect", _by_area("rect"), is_duplicate, F.coalesce("parent_id", F.lit(""))), keys, outcome)
    t = t.where(~F.coalesce(F.array_contains("_told.ids", F.col("object_id")), F.lit(False)))
    # The first kept winner in scan order takes over.
    heir = F.array_min(F.transform(F.filter("_told.heirs", lambda h: h["id"] == F.col("parent_id")), lambda h: h["heir"]))["object_id"]
    small = t.withColumn("parent_id", F.coalesce(F.when(F.col("parent_id").isNotNull(), heir), "parent_id")).select(*objects.columns)
    return _united(small, None if crowd is None else _dedup_crowd(crowd, keys), keys)


def _dedup_crowd(objects: DataFrame, keys: list[str]) -> DataFrame:
    group = keys + ["_group"]
    tagged = objects.withColumn("_group", F.coalesce("parent_id", F.lit("")))
    edges = cut(_conflicts(tagged, group, "rect", _by_area("rect"), is_duplicate, NORM_LEVELS))
    lost = cut(suppressed(edges, group))
    gone = lost.select(*group, F.col("loser").alias("winner"))
    # The first kept winner in scan order takes over.
    heirs = (
        edges.join(lost, group + ["loser"], "left_semi")
        .join(gone, group + ["winner"], "left_anti")
        .groupBy(*keys, "loser")
        .agg(F.min_by("winner", "winner_order").alias("_heir"))
        .withColumnRenamed("loser", "parent_id")
    )
    kept = _drop(tagged, lost.select(*keys, "loser"), keys).drop("_group")
    moved = kept.join(heirs, keys + ["parent_id"], "left")
    return moved.withColumn("parent_id", F.coalesce("_heir", "parent_id")).select(*objects.columns)


def ancestors(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-14: (keys, object_id, ancestor_id, distance) for every ancestor, cycle-guarded.

    One join per level of nesting; each level is cut from the lineage before the next, and the links before all, so that
    what made ``objects`` runs once and not once a level.
    """
    links = cut(objects.where(F.col("parent_id").isNotNull()).select(*keys, "object_id", "parent_id"))
    step = links.select(*keys, F.col("object_id").alias("ancestor_id"), F.col("parent_id").alias("_next"))
    front = cut(
        links.select(
            *keys, "object_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"),
            F.array("object_id", "parent_id").alias("_path"),
        )
    )
    levels = []
    while not front.isEmpty():
        levels.append(front.drop("_path"))
        front = cut(
            front.join(step, keys + ["ancestor_id"])
            .where(~F.array_contains("_path", F.col("_next")))
            .select(
                *keys, "object_id", F.col("_next").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"),
                F.concat("_path", F.array("_next")).alias("_path"),
            )
        )
    return reduce(DataFrame.unionByName, levels) if levels else front.drop("_path")


def _depth(links: Column, ids: Column, object_id: Column) -> Column:
    """Number of the ancestors of an object that are on its page, from the page's (id, parent) links; a chain ends where it would close."""
    first = F.filter(links, lambda x: x["id"] == object_id)
    start = F.transform(first, lambda x: F.struct(x["parent"].alias("a"), F.array(object_id, x["parent"]).alias("path")))

    def up(front: Column) -> Column:
        over = lambda f: F.filter(links, lambda x: (x["id"] == f["a"]) & ~F.array_contains(f["path"], x["parent"]))
        return F.flatten(F.transform(front, lambda f: F.transform(over(f), lambda x: F.struct(x["parent"].alias("a"), F.array_append(f["path"], x["parent"]).alias("path")))))

    both = lambda front, n: F.struct(front.alias("front"), n.alias("n"))
    real = lambda front: F.size(F.filter(front, lambda f: F.array_contains(ids, f["a"])))

    def step(acc: Column, _: Column) -> Column:
        # Bound once, as it is read twice; there are no more levels than links.
        more = F.transform(F.array(up(acc["front"])), lambda m: both(m, acc["n"] + real(m)))[0]
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(more)

    total = F.aggregate(links, both(start, real(start)), step, lambda acc: acc["n"])
    return F.when(F.exists(links, lambda x: x["id"] == object_id), total).otherwise(F.lit(0))


def depths(objects: DataFrame, keys: list[str] = PAGE, chains: DataFrame | None = None) -> DataFrame:
    """D-13: number of ancestors.

    Objects of a page lie together with its links. With ``chains``, or on crowded pages, they are counted from the chains;
    there the objects are written first, as they are read three times.
    """
    if chains is not None:
        return _counted(objects, keys, chains)
    few, crowd = split_pages(objects, keys, objects.drop("depth"))
    link = F.struct(F.col("object_id").alias("id"), F.col("parent_id").alias("parent"))
    t = few.withColumns({"_links": _on_page(link, keys, F.col("parent_id").isNotNull()), "_ids": _on_page(F.col("object_id"), keys)})
    small = t.withColumn("depth", F.coalesce(_depth(F.col("_links"), F.col("_ids"), F.col("object_id")), F.lit(0))).drop("_links", "_ids")
    if crowd is not None:
        crowd = cut(crowd)
        crowd = _counted(crowd, keys, ancestors(crowd, keys))
    return _united(small, crowd, keys)


def _counted(objects: DataFrame, keys: list[str], chains: DataFrame) -> DataFrame:
    known = objects.select(*keys, "object_id")
    real = chains.join(known.withColumnRenamed("object_id", "ancestor_id"), keys + ["ancestor_id"], "left_semi")
    count = real.groupBy(*keys, "object_id").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return objects.drop("depth").join(count, keys + ["object_id"], "left").withColumn(
        "depth", F.coalesce("depth", F.lit(0))
    )


def child_lists(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Children of each object in input order, for the nested artifact form (S-2)."""
    kids = (
        objects.where(F.col("parent_id").isNotNull())
        .groupBy(*keys, F.col("parent_id").alias("object_id"))
        .agg(F.array_sort(F.collect_list(F.struct("input_ord", "object_id"))).alias("_k"))
        .select(*keys, "object_id", F.transform("_k", lambda k: k["object_id"]).alias("child_ids"))
    )
    return objects.join(kids, keys + ["object_id"], "left").withColumn(
        "child_ids", F.coalesce("child_ids", F.array().cast("array<string>"))
    )


def build_hierarchy(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-15: collapse, parents, sibling dedup and depth."""
    step = lambda df: df if known_small(df, keys) else cut(df)
    flat = step(collapse_trivial(objects, keys))
    return depths(step(dedup_siblings(step(assign_parents(flat, keys)), keys)), keys)


def hierarchy_counts(raw: DataFrame, built: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-15: objects per page before and after."""
    before = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    after = built.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, keys, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


# ------------------------------------------------------------------ relations and frames
KINDS = ("container", "sibling", "adjacent", "near")  # in order of fallback
CROWDED, DISTANCE_BINS = 2000, 64  # objects of a page; bins per page unit: any numbers give the same order
OBJECTS_TOGETHER = 16_384  # objects of a task that relates small pages, so that its pairs are sorted in memory


def _kind(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """Place in ``KINDS`` of the relation from rect ``a`` to ``b`` with parents ``pa`` and ``pb``; NULL for none."""
    same = pa.isNotNull() & (pa == pb)
    near = R.center_distance(a, b) <= F.lit(NEAR_DISTANCE)
    return F.when(R.contains(a, b), 0).when(same, 1).when(R.adjacent(a, b), 2).when(near, 3)


def _node(objects: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Objects with their columns prefixed and the rect flat: plain numbers keep the pair conditions small and compiled."""
    return objects.select(*keys, F.col("object_id").alias(f"{n}object_id"), F.col("parent_id").alias(f"{n}parent_id"), *[F.col(f"rect.{c}").alias(f"{n}{c}") for c in "xywh"])


def _related(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered pairs (``_a_``, ``_b_`` columns, see ``_node``) of D-16 with their kind ``_k``, each once.

    Every kind has its own join: containment and touching through grids, siblings on the parent, near ones on cells of the
    centres. A join yields a pair once and drops it if an earlier kind holds, so nothing has to be made distinct. Boxes that
    touch share several cells; the pair counts in the lowest one that both have.
    """
    a, b, ra, rb = _node(objects, keys, "_a_"), _node(objects, keys, "_b_"), R.pack("_a_"), R.pack("_b_")
    out = [f"{n}{c}" for n in ("_a_", "_b_") for c in ("object_id", *"xywh")]

    def of_kind(pairs: DataFrame, k: int) -> DataFrame:
        kind = _kind(ra, rb, F.col("_a_parent_id"), F.col("_b_parent_id"))
        return pairs.where((F.col("_a_object_id") != F.col("_b_object_id")) & (kind == k)).select(*keys, *out, F.lit(k).alias("_k"))

    inside = containment_pairs(b, a, keys, rb, ra, R.EPS_HIERARCHY)
    child = lambda df, n: df.where(F.col(f"{n}parent_id").isNotNull()).withColumn("_p", F.col(f"{n}parent_id"))
    siblings = child(a, "_a_").join(child(b, "_b_"), [*keys, "_p"])

    def cell(v: Column, side: float) -> Column:
        return F.floor(v / F.lit(side)).cast("long")

    def covered(df: DataFrame, r: Column, grow: float, n: str) -> DataFrame:
        g, side = F.lit(grow), TOUCH_CELL
        df = df.withColumns({f"{n}x": cell(r["x"] - g, side), f"{n}y": cell(r["y"] - g, side)})
        df = df.withColumn("_cx", F.explode(F.sequence(f"{n}x", cell(R.right(r) + g, side))))
        return df.withColumn("_cy", F.explode(F.sequence(f"{n}y", cell(R.bottom(r) + g, side))))

    touching = covered(a, ra, 1.01 * R.ADJACENT_GAP, "_l").join(covered(b, rb, 0.0, "_m"), [*keys, "_cx", "_cy"])
    touching = touching.where((F.col("_cx") == F.greatest("_lx", "_mx")) & (F.col("_cy") == F.greatest("_ly", "_my")))
    side = 1.01 * NEAR_DISTANCE
    there = b.withColumns({"_cx": cell(R.center_x(rb), side), "_cy": cell(R.center_y(rb), side)})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = a.withColumn("_d", F.explode(around))
    here = here.withColumns({"_cx": cell(R.center_x(ra), side) + F.col("_d.i"), "_cy": cell(R.center_y(ra), side) + F.col("_d.j")}).drop("_d")
    near = here.join(there, [*keys, "_cx", "_cy"])
    return reduce(DataFrame.unionByName, [of_kind(p, k) for k, p in enumerate((inside, siblings, touching, near))])


def sibling_classes(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The siblings of D-16 as one row for each parent: (keys, parent_id, n_members, n_links).

    ``n_links`` is the number of sibling relations of the graph; its pairs follow from the members (``parent_id`` of the
    objects) less those of which one contains the other, so a crowd of children is told without its pairs.
    """
    child = objects.where(F.col("parent_id").isNotNull())
    members = child.groupBy(*keys, "parent_id").agg(F.count(F.lit(1)).alias("n_members"))
    outer = child.select(*keys, F.col("object_id").alias("_oid"), F.col("parent_id").alias("_op"), F.col("rect").alias("_ro"))
    inner = child.select(*keys, "object_id", "parent_id", F.col("rect").alias("_ri"))
    held = containment_pairs(inner, outer, keys, F.col("_ri"), F.col("_ro"), R.EPS_HIERARCHY)
    held = held.where((F.col("parent_id") == F.col("_op")) & (F.col("object_id") != F.col("_oid")) & R.contains(F.col("_ro"), F.col("_ri")))
    held = held.groupBy(*keys, "parent_id").agg(F.count(F.lit(1)).alias("_held"))
    links = F.col("n_members") * (F.col("n_members") - 1) - F.coalesce("_held", F.lit(0))
    return members.join(held, [*keys, "parent_id"], "left").select(*keys, "parent_id", "n_members", links.alias("n_links"))


def _meeting(objects: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The pairs of ``_related`` for pages of few objects, which meet on the page key: no pair is shuffled, and rows stay dealt by ``keys``."""
    ra, rb = R.pack("_a_"), R.pack("_b_")
    dealt = objects.repartition(tasks, *keys)
    pairs = _node(dealt, keys, "_a_").join(_node(dealt, keys, "_b_"), keys).where(F.col("_a_object_id") != F.col("_b_object_id"))
    kind = _kind(ra, rb, F.col("_a_parent_id"), F.col("_b_parent_id"))
    out = [f"{n}{c}" for n in ("_a_", "_b_") for c in ("object_id", *"xywh")]
    return pairs.select(*keys, *out, F.coalesce(kind, F.lit(len(KINDS))).alias("_k")).where(F.col("_k") < len(KINDS))


def _relations(pairs: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Columns of D-16 without the order for pairs of ``_related``, ``_k`` and ``_bin`` to order by, and ``more``."""
    a, b = R.pack("_a_"), R.pack("_b_")
    dist = R.center_distance(a, b)
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("_k"))
    return pairs.select(
        *keys, "_k", F.floor(dist * F.lit(DISTANCE_BINS)).alias("_bin"), F.col("_a_object_id").alias("from_id"), F.col("_b_object_id").alias("to_id"),
        kind.alias("kind"), R.relative(b, a).alias("rel"), dist.alias("distance"), *more,
    )


def relation_graph(objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-16: labelled ordered pairs of all related objects of a page.

    ``fallback_order`` counts a page's relations by kind, distance and ids. The objects of a page of at most ``CROWD`` meet on
    its key and are put in order where they meet; those of others are found by grid and parent joins. A page of at most
    ``CROWDED`` objects is put in order as a whole. On a larger one it is the place among the relations of equal kind and
    distance bin plus the number of relations in earlier bins, so no page is one task. The objects are written first, as
    every join reads them twice.
    """
    columns = [*keys, "from_id", "to_id", "kind", "rel", "distance", "fallback_order"]
    objects = cut(objects.select(*keys, "object_id", "parent_id", "rect"))
    order = ["distance", "from_id", "to_id"]

    def as_a_whole(pairs: DataFrame) -> DataFrame:
        # Only the distance is worked out before the sort: with the other columns the generated method is too long for the JVM to compile.
        near = pairs.withColumn("_far", R.center_distance(R.pack("_a_"), R.pack("_b_")))
        w = Window.partitionBy(*keys).orderBy("_k", "_far", "_a_object_id", "_b_object_id")
        return _relations(near.withColumn("fallback_order", F.row_number().over(w) - 1), keys, "fallback_order").select(*columns)

    sizes = cut(objects.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD))
    largest = sizes.agg(F.max("_n")).first()[0]
    few = objects if largest is None else objects.join(sizes, keys, "left_anti")
    # With fewer tasks than shuffles have, Spark would deal the pairs again before a join on the page key.
    tasks = max(int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + objects.count() // OBJECTS_TOGETHER)
    small = as_a_whole(_meeting(few, keys, tasks))
    if largest is None:
        return small
    of_size = lambda which: objects.join(sizes.where(which).select(*keys), keys, "left_semi")
    plain = small.unionByName(as_a_whole(_related(of_size(F.col("_n") <= CROWDED), keys)))
    if largest <= CROWDED:
        return plain
    part = [*keys, "_k", "_bin"]
    found = _relations(_related(cut(of_size(F.col("_n") > CROWDED)), keys), keys)
    counts = found.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    # A page has at most a few hundred bins.
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_k", "_bin")) - F.col("_n")
    binned = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1 + F.col("_before")
    ordered = found.join(counts.select(*part, before.alias("_before")), part).withColumn("fallback_order", binned.cast("int"))
    return plain.unionByName(ordered.select(*columns))


def frame_relations(objects: DataFrame, frames: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-17: each object relative to the refined border of its page."""
    f = frames.select(*keys, "refined")
    return objects.join(f, keys).select(*keys, "object_id", R.relative(F.col("rect"), F.col("refined")).alias("rel"))


def border_relations(frames: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-17: refined border relative to the page border."""
    return frames.select(*keys, R.relative(F.col("refined"), F.col("border")).alias("rel"))


def content_rect(det: DataFrame, surfaces: DataFrame) -> DataFrame:
    """D-18: union of the kept boxes in pixels, clamped; the full page when there is none or it is tiny."""
    px = F.col("px")
    u = det.groupBy(*PAGE).agg(R.union_agg(px).alias("_u"))
    s = surfaces.select(*PAGE, "width", "height").join(u, PAGE, "left")
    w, h, c = F.col("width").cast("double"), F.col("height").cast("double"), F.col("_u")
    clamped = R.from_corners(c["x"].cast("double"), c["y"].cast("double"), R.right(c).cast("double"), R.bottom(c).cast("double"), w, h)
    full = R.make(R.lit(0), R.lit(0), w, h)
    usable = c.isNotNull() & (clamped["w"] >= MIN_CONTENT_SIDE) & (clamped["h"] >= MIN_CONTENT_SIDE)
    return s.select(*PAGE, "width", "height", F.when(usable, clamped).otherwise(full).alias("content"))


def refined_border(content: DataFrame, fields: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-19: frames per page from the content rect and the field boxes on it.

    ``content``: keys, width, height, content (pixels). ``fields``: keys, field_id, bbox.
    """
    boxes = fields.groupBy(*keys).agg(R.union_agg(F.col("bbox")).alias("_u"), F.count(F.lit(1)).cast("int").alias("_n"))
    t = content.join(boxes, keys, "left").withColumn("n_bbox", F.coalesce("_n", F.lit(0)))
    t = t.withColumn("_cv", R.to_normalized(F.col("content"), F.col("width"), F.col("height")))
    cv, u = F.col("_cv"), F.col("_u")
    usable = R.all_finite(cv) & (cv["w"] > 0) & (cv["h"] > 0) & (cv["x"] >= 0) & (cv["y"] >= 0) & (
        R.right(cv) <= R.lit(1 + R.EPS_FINE)
    ) & (R.bottom(cv) <= R.lit(1 + R.EPS_FINE))
    none = F.col("n_bbox") == 0
    rect = (
        F.when(none & usable, cv)
        .when(none, R.full_page())
        .when(~usable, R.union_clamped(u, u))
        .otherwise(R.union_clamped(cv, u))
    )
    source = (
        F.when(none & usable, F.lit("cv-content"))
        .when(none, F.lit("full-page-fallback"))
        .when(~usable, F.lit("bbox-union"))
        .otherwise(F.lit("cv-and-bbox-union"))
    )
    t = t.withColumn("refined", rect).withColumn("source", source)
    mirror = F.when(usable, cv).otherwise(F.col("refined"))
    return t.select(
        *keys,
        R.full_page().alias("border"),
        "refined",
        mirror.alias("cv_content"),
        "source",
        "n_bbox",
        (none | R.contains(F.col("refined"), u)).alias("contains_all"),
    )


# ------------------------------------------------------------------ second pass, density, visibility
def blob_shaped(object_id: Column) -> Column:
    return object_id.startswith("obj_blob_") | (object_id.startswith("obj_cv_") & ~object_id.startswith("obj_cv_cell_"))


def blobs_to_decompose(det: DataFrame, surfaces: DataFrame) -> DataFrame:
    """D-20 eligibility: blob-shaped, at least 1% of the page, no other box inside (1 px slack)."""
    t = _with_nested(det.join(surfaces.select(*PAGE, "width", "height"), PAGE), crowds(det, PAGE), 1.0)
    share = R.area(F.col("px")) / F.greatest(F.lit(1), F.col("width") * F.col("height"))
    is_big = blob_shaped(F.col("object_id")) & (F.col("px.w") > 0) & (F.col("px.h") > 0)
    big = t.where(is_big & (share >= F.lit(BLOB_MIN_AREA)))
    big = big.withColumn("_held", F.max("_nested").over(Window.partitionBy(*PAGE, "object_id")))
    return big.where(~F.coalesce("_held", F.lit(False))).select(*det.columns)


def _with_nested(det: DataFrame, many: DataFrame | None, slack: float) -> DataFrame:
    """Adds ``_nested``: another box of the page lies inside this one.

    Boxes of a page of few lie together, where the join before has dealt them; those of a crowd (``many``) meet in a grid.
    """
    few = det if many is None else det.join(many, PAGE, "left_anti")
    side = F.col("px")
    t = few.withColumn("_all", _on_page(F.struct(*[side[c].alias(c) for c in "xywh"], F.col("object_id").alias("id")), PAGE))
    inside = F.exists("_all", lambda a: R.contains(side, a, slack) & (a["id"] != F.col("object_id")))
    small = t.withColumn("_nested", F.when(blob_shaped(F.col("object_id")), F.coalesce(inside, F.lit(False)))).drop("_all")
    if many is None:
        return small
    crowd = cut(det.join(many, PAGE, "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    outer = crowd.where(blob_shaped(F.col("object_id"))).select(*PAGE, "_row", F.col("object_id").alias("_oid"), F.col("px").alias("_ro"))
    inner = crowd.select(*PAGE, F.col("object_id").alias("_iid"), F.col("px").alias("_ri"))
    pairs = containment_pairs(inner, outer, PAGE, F.col("_ri"), F.col("_ro"), slack, PIXEL_LEVELS)
    held = pairs.where((F.col("_iid") != F.col("_oid")) & R.contains(F.col("_ro"), F.col("_ri"), slack)).select("_row", F.lit(True).alias("_nested")).distinct()
    return small.unionByName(crowd.join(held, "_row", "left").drop("_row"))


def density_check(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """D-21: enough confident objects near each field, and how many."""
    f = fields.select(*keys, "field_id", F.col("bbox").alias("_f"))
    o = objects.where(F.col("confidence") >= F.lit(DENSITY_CONFIDENCE)).select(*keys, F.col("rect").alias("_o"))
    radius = F.lit(DENSITY_RADIUS) * F.greatest(F.col("_f.w"), F.col("_f.h"))
    near = R.center_distance(F.col("_f"), F.col("_o")) <= radius
    counted = f.join(o, keys, "left").groupBy(*keys, "field_id").agg(F.count_if(near).alias("_c"))
    return counted.select(*keys, "field_id", F.col("_c").alias("n_near"), (F.col("_c") >= DENSITY_OBJECTS).alias("passes"))


def accept_alternative(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """D-22: per key, true iff some field that failed before passes now."""
    b = before.select(*keys, "field_id", F.col("passes").alias("_b"))
    a = after.select(*keys, "field_id", F.col("passes").alias("_a"))
    return (
        b.join(a, keys + ["field_id"], "left")
        .groupBy(*keys)
        .agg(F.bool_or(~F.col("_b") & F.coalesce(F.col("_a"), F.lit(False))).alias("accept"))
    )


def visible_objects(objects: DataFrame, preset: str = "simple", show_all: bool | None = None) -> DataFrame:
    """D-23: roots always, others by the preset's confidence."""
    if preset == "advanced" if show_all is None else show_all:
        return objects
    return objects.where((F.col("depth") == 0) | (F.col("confidence") >= F.lit(OVERLAY_MIN_CONFIDENCE[preset])))


def visible_projections(projections: DataFrame, hide_unmatched: bool) -> DataFrame:
    """D-23: optionally hide template projections without a match."""
    return projections.where(F.col("matched")) if hide_unmatched else projections
