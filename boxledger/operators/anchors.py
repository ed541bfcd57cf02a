"""Field anchors (A-1..A-9).

``fields``: keys, field_id, bbox. ``objects``: keys, object_id, rect, parent_id, input_ord.
A page has few declared fields, so joining them to its objects on the page key is linear in the
objects, and the top-three ranks are cut map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.boxes import PAGE, split_pages
from boxledger.session import cut

MAX_ANCHORS = 3
LABELS = ("A", "B", "C")
RANKS = ("primary", "secondary", "tertiary")


def _pairs(fields: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    f = fields.select(*keys, "field_id", "bbox")
    o = objects.select(*keys, "object_id", "rect", "parent_id", "input_ord")
    return f.join(o, keys)


def direct_container(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Smallest object that contains the field; ties by input order."""
    pick = F.min(F.struct(R.area(F.col("rect")).alias("a"), F.col("input_ord"), F.col("object_id")))
    return (
        _pairs(fields, objects, keys)
        .where(R.contains(F.col("rect"), F.col("bbox")))
        .groupBy(*keys, "field_id")
        .agg(pick.alias("_p"))
        .select(*keys, "field_id", F.col("_p.object_id").alias("object_id"))
    )


def containment_chain(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-1: direct container, its parent and grandparent as (field, object_id, pos)."""
    up = objects.select(*keys, F.col("object_id").alias("_id"), F.col("parent_id").alias("_up"))
    d = direct_container(fields, objects, keys).withColumnRenamed("object_id", "_o0")
    for i in range(1, MAX_ANCHORS):
        step = up.select(*keys, F.col("_id").alias(f"_o{i - 1}"), F.col("_up").alias(f"_o{i}"))
        d = d.join(step, keys + [f"_o{i - 1}"], "left")
    items = [F.struct(F.col(f"_o{i}").alias("object_id"), F.lit(i).alias("pos")) for i in range(MAX_ANCHORS)]
    return d.select(*keys, "field_id", F.inline(F.array(*items))).where(F.col("object_id").isNotNull())


def fill_anchors(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-1 + A-2: up to three distinct anchor objects per field in rank order.

    Pools: containment chain, other containers by area, overlapping objects by centre distance,
    then nearest. An object counts in its first pool only. A field of a page of few objects meets them as one array, where its
    chain and its ranks are found; pairs are made on crowded pages only.
    """
    few, crowd = split_pages(objects, keys, objects.select(*keys, "object_id", "rect", "parent_id", "input_ord"))
    small = _fill_small(fields, few, keys)
    return small if crowd is None else small.unionByName(_fill_crowd(fields, crowd, keys))


def _pool(in_chain: Column, inside: Column, overlap: Column) -> Column:
    return F.when(in_chain, 0).when(inside, 1).when(overlap, 2).otherwise(3)


def _touches(o: Column, f: Column) -> Column:
    eps = R.lit(R.EPS_HIERARCHY)
    return (R.x_overlap(o, f) > eps) & (R.y_overlap(o, f) > eps)


def _fill_small(fields: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """The ranks of ``_fill_crowd`` from one row for each field. Every row of a repeated object is a link of its own, as in joins."""
    node = F.struct("object_id", "rect", "parent_id", "input_ord")
    pages = objects.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(node).alias("_objs"))
    let = lambda value, f: F.transform(F.array(value), f)[0]
    f, objs = F.col("bbox"), F.col("_objs")

    def chain_of(first: Column) -> Column:
        """(object_id, pos) of the first three of each chain, one chain for each way up."""
        above = lambda i: F.transform(F.filter(objs, lambda o: o["object_id"] == i), lambda o: o["parent_id"])
        ways = lambda i: let(above(i), lambda up: F.when(F.size(up) == 0, F.array(F.lit(None).cast("string"))).otherwise(up))
        links = lambda a, b: F.transform(ways(b), lambda c: F.array(*[F.struct(x.alias("object_id"), F.lit(n).alias("pos")) for n, x in enumerate((a, b, c))]))
        return F.flatten(F.flatten(F.transform(ways(first), lambda b: links(first, b))))

    inside = F.filter(objs, lambda o: R.contains(o["rect"], f))
    # Rows of one field share one container.
    least = F.array_min(F.transform(inside, lambda o: F.struct(R.area(o["rect"]).alias("a"), o["input_ord"].alias("ord"), o["object_id"].alias("id"))))
    t = fields.select(*keys, "field_id", "bbox").join(pages, keys)
    t = t.withColumn("_first", F.min(least).over(Window.partitionBy(*keys, "field_id"))["id"])
    none = F.array().cast("array<struct<object_id:string,pos:int>>")
    chain = F.when(F.col("_first").isNotNull() & F.col("field_id").isNotNull(), F.filter(chain_of(F.col("_first")), lambda c: c["object_id"].isNotNull()))

    def rank(o: Column, pos: Column) -> Column:
        r, held, dist = o["rect"], R.contains(o["rect"], f), R.center_distance(f, o["rect"])
        pool = _pool(pos.isNotNull(), held, _touches(r, f))
        key = F.when(pos.isNotNull(), pos.cast("double")).when(held, R.area(r)).otherwise(dist)
        return F.struct(
            pool.alias("_pool"), key.alias("_key"), F.when(pool < 3, o["input_ord"]).alias("_ord"),
            F.when(pool < 3, o["input_ord"].cast("string")).otherwise(o["object_id"]).alias("_tie"),
            o["object_id"].alias("object_id"), r.alias("rect"), dist.alias("distance"),
        )

    # The chain is bound once, not worked out again for every object.
    place = lambda o, ch: F.transform(F.filter(ch, lambda c: c["object_id"] == o["object_id"]), lambda c: c["pos"])
    each = lambda o, ch: let(place(o, ch), lambda p: F.transform(F.when(F.size(p) == 0, F.array(F.lit(None).cast("int"))).otherwise(p), lambda n: rank(o, n)))
    best = let(F.coalesce(chain, none), lambda ch: F.slice(F.array_sort(F.flatten(F.transform(objs, lambda o: each(o, ch)))), 1, MAX_ANCHORS))
    t = t.withColumn("_best", best).drop("_objs", "_first")
    w = Window.partitionBy(*keys, "field_id").orderBy("_pool", "_key", "_ord", "_tie")
    # No page is empty; "outer" spares a filter on the size, which would work the ranks out twice.
    t = t.select(*keys, "field_id", "bbox", F.inline_outer("_best")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MAX_ANCHORS)
    return t.select(*keys, "field_id", "object_id", "bbox", "rect", "distance", "_pool", "_key", "_ord", "_tie", "pos")


def _fill_crowd(fields: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    chain = containment_chain(fields, objects, keys)
    p = _pairs(fields, objects, keys).join(chain, keys + ["field_id", "object_id"], "left")
    f, o = F.col("bbox"), F.col("rect")
    inside = R.contains(o, f)
    dist = R.center_distance(f, o)
    in_chain = F.col("pos").isNotNull()
    pool = _pool(in_chain, inside, _touches(o, f))
    key = F.when(in_chain, F.col("pos").cast("double")).when(inside, R.area(o)).otherwise(dist)
    tie = F.when(pool < 3, F.col("input_ord").cast("string")).otherwise(F.col("object_id"))
    ranked = p.select(
        *keys, "field_id", "object_id", "bbox", "rect", dist.alias("distance"), pool.alias("_pool"), key.alias("_key"),
        F.when(pool < 3, F.col("input_ord")).alias("_ord"), tie.alias("_tie"),
    )
    w = Window.partitionBy(*keys, "field_id").orderBy("_pool", "_key", "_ord", "_tie")
    return ranked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MAX_ANCHORS)


def _nth(names: tuple[str, ...], pos: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), pos)


def field_anchors(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-3: labelled anchors with distance and the field's rect relative to the anchor."""
    return fill_anchors(fields, objects, keys).select(
        *keys,
        "field_id",
        _nth(LABELS, F.col("pos")).alias("label"),
        _nth(RANKS, F.col("pos")).alias("rank"),
        "pos",
        "object_id",
        "distance",
        R.relative(F.col("bbox"), F.col("rect")).alias("rel"),
    )


def border_anchors(fields: DataFrame, frames: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-4: the field relative to the refined (cv-content) frame and to the page border."""
    b = F.col("bbox")
    return fields.join(frames.select(*keys, "cv_content", "border"), keys).select(
        *keys,
        "field_id",
        R.relative(b, F.col("cv_content")).alias("refined_rel"),
        R.edge_distance(F.col("cv_content"), b).alias("refined_edge"),
        R.relative(b, F.col("border")).alias("border_rel"),
        R.edge_distance(F.col("border"), b).alias("border_edge"),
    )


def nearest_k(fields: DataFrame, objects: DataFrame, k: int = 3, keys: list[str] = PAGE) -> DataFrame:
    """A-5: nearest objects by (centre distance, id)."""
    p = _pairs(fields, objects, keys).select(
        *keys, "field_id", "object_id", R.center_distance(F.col("bbox"), F.col("rect")).alias("distance")
    )
    w = Window.partitionBy(*keys, "field_id").orderBy("distance", "object_id")
    return p.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def contained_by(fields: DataFrame, objects: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-5: direct container per field (NULL when none) and the position inside it."""
    d = direct_container(fields, objects, keys)
    rects = objects.select(*keys, "object_id", "rect")
    return fields.join(d, keys + ["field_id"], "left").join(rects, keys + ["object_id"], "left").select(
        *keys, "field_id", F.col("object_id").alias("contained_by"),
        F.when(F.col("rect").isNotNull(), R.relative(F.col("bbox"), F.col("rect"))).alias("position"),
    )


def anchor_graph(anchors: DataFrame, relations: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """A-6: relations whose both ends are anchors of the same field, labelled.

    The anchor pairs of a page, few for each of its few fields, come to its relations, which stay where they lie.
    """
    a = anchors.select(*keys, "field_id", F.col("object_id").alias("from_id"), F.col("label").alias("from_label"))
    b = anchors.select(*keys, "field_id", F.col("object_id").alias("to_id"), F.col("label").alias("to_label"))
    ends = a.join(b, keys + ["field_id"]).where(F.col("from_id") != F.col("to_id"))
    ends = ends.groupBy(*keys).agg(F.collect_list(F.struct("field_id", "from_label", "to_label", "from_id", "to_id")).alias("_ends"))
    own = F.filter("_ends", lambda e: (e["from_id"] == F.col("from_id")) & (e["to_id"] == F.col("to_id")))
    met = relations.join(ends, keys).select(*keys, F.explode(own).alias("_e"), "kind", "fallback_order", "rel")
    return met.select(*keys, *[f"_e.{c}" for c in ("field_id", "from_label", "to_label", "from_id", "to_id")], "kind", "fallback_order", "rel")


def build_geometry(drafts: DataFrame, confirmed_at: str, confirmed_by: str = "user") -> DataFrame:
    """A-7: stamp drafts that carry no confirmer or time of their own."""
    at = F.coalesce(F.col("confirmed_at"), F.lit(confirmed_at)) if "confirmed_at" in drafts.columns else F.lit(confirmed_at)
    by = (
        F.coalesce(F.nullif(F.col("confirmed_by"), F.lit("")), F.lit(confirmed_by))
        if "confirmed_by" in drafts.columns
        else F.lit(confirmed_by)
    )
    return drafts.withColumn("confirmed_at", at).withColumn("confirmed_by", by)


def upsert_geometry(existing: DataFrame, drafts: DataFrame, key: list[str]) -> DataFrame:
    """A-7: replace by (geometry, field) keeping the old position, or append. ``ord`` is the position."""
    place = existing.select(*key, F.col("ord").alias("_ord"))
    kept = existing.join(drafts.select(*key), key, "left_anti")
    new = drafts.join(place, key, "left").withColumn("ord", F.coalesce("_ord", "ord")).drop("_ord")
    return kept.unionByName(new.select(*existing.columns))


def remove_fields(existing: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """A-7: drop boxes by key."""
    return existing.join(removed.select(*key), key, "left_anti")


def normalize_fields(fields: DataFrame) -> DataFrame:
    """A-8: trimmed ids and labels with defaults ``field_{n}`` / ``Field {n}``, dense order from 1."""
    w = Window.partitionBy("wizard_id").orderBy("ord")
    n = F.row_number().over(w)
    t = fields.withColumn("_n", n)
    return t.withColumn(
        "field_id", F.coalesce(F.nullif(F.trim("field_id"), F.lit("")), F.concat(F.lit("field_"), "_n"))
    ).withColumn(
        "label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Field "), "_n"))
    ).withColumn("wizard_id", F.trim("wizard_id")).withColumn("ord", F.col("_n")).drop("_n")


def rank_anchors(anchors: DataFrame, objects: DataFrame, chains: DataFrame, relations: DataFrame, containers: DataFrame,
                 keys: list[str] = PAGE) -> DataFrame:
    """A-9: resolution priority of each anchor.

    0 the container of the field, 1 an ancestor of it, 2 a sibling of it, 3 the target of an adjacency
    relation from it, 4 anything else; A before B before C inside a class. ``containers``: contained_by. The few pairs that
    are asked for come to the relations of their page, which stay where they lie; the anchors are written first, as they are read twice.
    """
    anchors = cut(anchors)
    c = containers.select(*keys, "field_id", F.col("contained_by").alias("_c"))
    own = objects.select(*keys, "object_id", F.col("parent_id").alias("_p"))
    cont = objects.select(*keys, F.col("object_id").alias("_c"), F.col("parent_id").alias("_cp"))
    anc = chains.select(*keys, F.col("object_id").alias("_c"), F.col("ancestor_id").alias("object_id"), F.lit(True).alias("_anc"))
    c = cut(c)
    asked = anchors.join(c, keys + ["field_id"]).groupBy(*keys).agg(F.collect_set(F.struct("_c", "object_id")).alias("_asked"))
    is_asked = F.exists("_asked", lambda e: (e["_c"] == F.col("from_id")) & (e["object_id"] == F.col("to_id")))
    ends = relations.where(F.col("kind") == "adjacent").join(asked, keys).where(is_asked).select(
        *keys, F.col("from_id").alias("_c"), F.col("to_id").alias("object_id"), F.lit(True).alias("_adj")
    )
    t = (
        anchors.join(c, keys + ["field_id"], "left")
        .join(own, keys + ["object_id"], "left")
        .join(cont, keys + ["_c"], "left")
        .join(anc, keys + ["_c", "object_id"], "left")
        .join(ends, keys + ["_c", "object_id"], "left")
    )
    cls = (
        F.when(F.col("object_id") == F.col("_c"), 0)
        .when(F.col("_anc"), 1)
        .when(F.col("_cp").isNotNull() & (F.col("_p") == F.col("_cp")), 2)
        .when(F.col("_adj"), 3)
        .otherwise(4)
    )
    w = Window.partitionBy(*keys, "field_id").orderBy("priority", "label")
    return t.select(*anchors.columns, cls.alias("priority")).withColumn("resolve_ord", F.row_number().over(w) - 1)
