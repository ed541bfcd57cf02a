import contextlib
import functools
import io
import itertools
import random
import re

from pyspark.sql import functions as F

from boxledger.operators import anchors, boxes, lines, spatial
from boxledger.session import settings

RECT = "struct<x:double,y:double,w:double,h:double>"


def objects(spark, rows):
    data = [(1, 0, i, i, tuple(float(v) for v in r), c) for i, r, c in rows]
    return spark.createDataFrame(data, f"doc_id int, page_index int, object_id string, input_ord string, rect {RECT}, confidence double")


def test_nested_boxes_and_jittered_twin(spark):
    df = objects(spark, [("a", (0, 0, 1, 1), 0.9), ("b", (0.1, 0.1, 0.5, 0.5), 0.9), ("b2", (0.101, 0.101, 0.5, 0.5), 0.8), ("c", (0.2, 0.2, 0.1, 0.1), 0.9), ("c2", (0.2, 0.2, 0.1, 0.1), 0.7)])
    got = {r.object_id: (r.parent_id, r.depth) for r in boxes.build_hierarchy(df).collect()}
    assert got == {"a": (None, 0), "b": ("a", 1), "c": ("b", 2)}


def brute_nms(rows, threshold):
    def iou(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return 0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    kept = []
    for i, r in sorted(rows, key=lambda x: (-x[1][2] * x[1][3], x[0])):
        if all(iou(r, k) < threshold for _, k in kept):
            kept.append((i, r))
    return {i for i, _ in kept}


def test_nms_equals_scan_on_copies_and_chains(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        base = rng.choice([(100, 100, 60, 40), (105, 100, 60, 40), (300, 200, 80, 80)])
        rows.append((f"o{i:03d}", tuple(v + rng.randint(-3, 3) for v in base)))
    rows += [(f"z{i:03d}", (100, 100, 60, 40)) for i in range(200)]
    df = spark.createDataFrame([(1, 0, i, tuple(float(v) for v in r), False) for i, r in rows], f"doc_id int, page_index int, object_id string, px {RECT}, confirmed boolean")
    assert {r.object_id for r in boxes.nms(df).collect()} == brute_nms(rows, 0.85)


def grid(nx, ny, step=50):
    xs, ys = [i * step for i in range(nx + 1)], [i * step for i in range(ny + 1)]
    return [(a, c, b + 1, d + 1) for a, b in itertools.combinations(xs, 2) for c, d in itertools.combinations(ys, 2)]


def brute_leaves(rects, tol):
    """Leaves are what no straight cut divides into covered parts; found by trying every cut of every area."""
    area = lambda a: max(0, a[2] - a[0]) * max(0, a[3] - a[1])
    bins = lambda a: tuple(int((v / tol + 0.5) // 1) for v in a)
    known = {bins(r) for r in rects}
    xs, ys = sorted({v for r in rects for v in (r[0], r[2])}), sorted({v for r in rects for v in (r[1], r[3])})

    @functools.cache
    def covered(a):
        return bins(a) in known or divides(a)

    @functools.cache
    def divides(a):
        x0, y0, x1, y1 = a
        return any(covered((x0, y0, x1, y)) and covered((x0, y, x1, y1)) for y in ys if y0 + tol < y < y1 - tol) or any(
            covered((x0, y0, x, y1)) and covered((x, y0, x1, y1)) for x in xs if x0 + tol < x < x1 - tol
        )

    joins = [r for r in rects if divides(r)]
    near = [r for r in joins if not any(0 < area(b) < area(r) and area(b) >= 0.85 * area(r) and within(r, b, tol) for b in rects)]

    def framed(r):
        for f in near:
            bands = [(f[0], f[1], f[2], r[1]), (f[0], r[3], f[2], f[3]), (f[0], r[1], r[0], r[3]), (r[2], r[1], f[2], r[3])]
            bands = [b for b, w in zip(bands, (r[1] - f[1], f[3] - r[3], r[0] - f[0], f[2] - r[2]), strict=True) if w > tol]
            if area(f) > area(r) and area(f) >= 1.05 * area(r) and within(f, r, tol) and all(covered(b) for b in bands):
                return True
        return False

    return {r for r in rects if r not in joins or not framed(r)}


def within(outer, inner, tol):
    return outer[0] <= inner[0] + tol and outer[1] <= inner[1] + tol and outer[2] + tol >= inner[2] and outer[3] + tol >= inner[3]


def test_leaves_equal_exhaustive_cuts(spark):
    rng = random.Random(4)
    pages = {0: grid(5, 3), 1: grid(1, 1), 2: grid(2, 1)} | {k: [r for r in grid(4, 4) if rng.random() < 0.7] for k in range(3, 7)}
    rows = [(1, k, *r) for k, rects in pages.items() for r in rects]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, left long, top long, right long, bottom long")
    got = {}
    for r in lines.leaves_and_outermost(df, boxes.PAGE, F.lit(5)).collect():
        got.setdefault(r.page_index, set()).add((r.left, r.top, r.right, r.bottom))
    assert got == {k: brute_leaves(rects, 5) for k, rects in pages.items()}
    assert len(got[0]) == 5 * 3 + 1


def test_runs_of_neighbouring_scanlines_form_stripes(spark):
    runs = [(0, y, x, x + 40) for y in (3, 4, 5) for x in (0, 100)] + [(0, 7, 0, 40), (0, 8, 25, 65), (0, 20, 5, 6)] + [(0, y, 200, 300) for y in range(3, 12)]
    df = spark.createDataFrame(runs, "axis int, scan long, start_pos long, end_pos long")
    got = {(r.axis_pos, r.thickness, r.start_pos, r.end_pos) for r in lines.stripes_to_segments(df, ["axis"], F.lit(4)).collect()}
    assert got == {(4, 3, 0, 40), (4, 3, 100, 140), (7, 1, 0, 40), (8, 1, 25, 65), (20, 1, 5, 6)}


def test_no_rule_and_no_object_is_left_out(spark):
    """A page with more than two hundred rules keeps all, one with forty objects relates all."""
    seg = [(1, 0, 0, 10 * i, 1, 0, 500 + i % 7) for i in range(210)]
    df = spark.createDataFrame(seg, "doc_id int, page_index int, axis int, axis_pos int, thickness int, start_pos int, end_pos int")
    assert lines.rank_segments(df, boxes.PAGE).count() == 210
    rows = [(f"o{i:02d}", (0.02 * (i % 10), 0.05 * (i // 10), 0.015, 0.03), 0.9) for i in range(40)]
    graph = boxes.relation_graph(boxes.assign_parents(objects(spark, rows))).select("from_id", "to_id").distinct().collect()
    want = {(a, b) for a, ra, _ in rows for b, rb, _ in rows if a != b and ((ra[0] - rb[0]) ** 2 + (ra[1] - rb[1]) ** 2) ** 0.5 <= 0.35}
    assert {(r.from_id, r.to_id) for r in graph} >= want and len({r.from_id for r in graph}) == 40


def test_points_to_boxes_of_a_ruled_table(spark):
    """Six uprights and three rules, two points thick: ten cells and the frame around them. Both sides of a rule fall into one bin."""
    xs, ys = [35, 130, 190, 302, 365, 481], [50, 166, 310]
    ink = {(x, y + k) for y in ys for x in range(xs[0], xs[-1] + 2) for k in (0, 1)} | {(x + k, y) for x in xs for y in range(ys[0], ys[-1] + 2) for k in (0, 1)}
    pts = spark.createDataFrame([(1, 0, x, y) for x, y in ink], "doc_id int, page_index int, x int, y int")
    thr = boxes.page_thresholds(spark.createDataFrame([(1, 0, 521, 360)], "doc_id int, page_index int, width int, height int"))
    seg = lines.detect_segments(pts, thr)
    assert {(r.axis, r["count"]) for r in seg.groupBy("axis").count().collect()} == {(0, len(ys)), (1, len(xs))}
    assert lines.boxes_from_segments(seg, boxes.PAGE, F.lit(3)).count() == (len(xs) - 1) * (len(ys) - 1) + 1


SEGMENT = "doc_id int, page_index int, axis int, axis_pos int, thickness int, start_pos int, end_pos int"


def clusters(spark, seg, tol):
    df = spark.createDataFrame([(1, 0, 0, p, t, s, e) for p, t, s, e in seg], SEGMENT)
    return sorted((r.axis_pos, r.thickness, r.start_pos, r.end_pos) for r in lines.cluster_segments(df, boxes.PAGE, F.lit(tol)).collect())


def test_a_thick_rule_found_in_seven_strips_is_one(spark):
    assert clusters(spark, [(p, 2, 33 + p % 2, 912) for p in range(640, 647)], 9) == [(643, 2, 33, 912)]
    assert clusters(spark, [(640, 1, 0, 40), (640, 4, 90, 150)], 9) == [(640, 1, 0, 40), (640, 4, 90, 150)]


def test_clusters_cover_their_segments_and_nothing_else(spark):
    """What holds for any clustering of fragments, on random pages: coverage, tight extents, no two rules that belong together."""
    rng, tol = random.Random(8), 6
    seg = [(rng.randrange(0, 90), rng.randrange(1, 5), s, s + rng.randrange(5, 70)) for s in (rng.randrange(0, 400) for _ in range(180))]
    got = clusters(spark, seg, tol)
    for p, t, s, e in seg:
        assert any(abs(q - p) < tol and a <= s and b >= e and u >= t for q, u, a, b in got)
    for q, u, a, b in got:
        near = [x for x in seg if abs(x[0] - q) < tol and a <= x[2] and x[3] <= b]
        assert q in {x[0] for x in near} and a in {x[2] for x in near} and b in {x[3] for x in near} and u in {x[1] for x in near}
    for x, y in itertools.combinations(got, 2):  # rules of one position lie further apart than the tolerance
        assert x[0] != y[0] or x[3] + tol < y[2] or y[3] + tol < x[2] or len({z[0] for z in seg if abs(z[0] - x[0]) < tol}) > 1
    assert clusters(spark, rng.sample(seg, len(seg)), tol) == got
    moved = [(p + 700, t, s + 55, e + 55) for p, t, s, e in seg]
    assert clusters(spark, moved, tol) == [(q + 700, u, a + 55, b + 55) for q, u, a, b in got]


def brute_rects(h, v, g):
    """All four-sided figures, every combination tried; of equal bins the outermost one."""
    best = {}
    for (t, b), (x, y) in itertools.product(itertools.permutations(h, 2), itertools.permutations(v, 2)):
        lo, hi = max(t[1], b[1]), min(t[2], b[2])
        wide = b[0] - t[0] >= g and hi - lo >= 2 * g and y[0] - x[0] >= g
        stands = all(lo - g <= u[0] <= hi + g and u[1] - g <= t[0] and u[2] + g >= b[0] for u in (x, y))
        lies = all(r[1] - g <= x[0] and r[2] + g >= y[0] for r in (t, b))
        if wide and stands and lies:
            edges = (x[0], t[0], y[0] + 1, b[0] + 1)
            key = tuple(int(e / g + 0.5) for e in edges)
            order = (edges[1], -b[0], edges[0], -y[0])
            best[key] = min(best.get(key, (order, edges)), (order, edges))
    return sorted(e for _, e in best.values())


def test_rectangles_equal_all_combinations(spark):
    rng = random.Random(12)
    for n in (5, 9):
        rule = lambda: (rng.randrange(0, 300), s := rng.randrange(0, 150), s + rng.randrange(20, 220))
        h, v = [rule() for _ in range(n)], [rule() for _ in range(n)]
        rows = [(1, 0, axis, p, 1, s, e) for axis, side in ((0, h), (1, v)) for p, s, e in side]
        found = lines.line_rects(spark.createDataFrame(rows, SEGMENT), boxes.PAGE, F.lit(4)).collect()
        assert sorted((r.left, r.top, r.right, r.bottom) for r in found) == brute_rects(h, v, 4)


def test_relations_in_bins_equal_those_of_a_whole_page(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"o{i:02d}", (rng.randrange(0, 80) / 100, rng.randrange(0, 80) / 100, rng.randrange(2, 30) / 100, rng.randrange(2, 30) / 100), 0.9) for i in range(45)]
    rows += [(f"t{i}", rows[0][1], 0.9) for i in range(5)]
    df = boxes.assign_parents(objects(spark, rows)).cache()
    graph = lambda: sorted((r.fallback_order, r.from_id, r.to_id, r.kind) for r in boxes.relation_graph(df).collect())
    plain = graph()
    monkeypatch.setattr(boxes, "CROWDED", 10)
    assert graph() == plain and [x[0] for x in plain] == list(range(len(plain)))
    links = {}
    up = {r.object_id: r.parent_id for r in df.collect()}
    for _, a, b, kind in plain:
        if kind == "sibling":
            assert up[a] == up[b]
            links[up[a]] = links.get(up[a], 0) + 1
    got = {r.parent_id: r.n_links for r in boxes.sibling_classes(df).collect()}
    assert {k: n for k, n in got.items() if n} == links


def test_small_pages_meet_on_their_key(spark, monkeypatch):
    """A box of a page of few objects is not copied into grid cells; grid and page key give the same rows."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = rng.choice([(0.1, 0.1, 0.06, 0.04), (0.105, 0.1, 0.06, 0.04), (0.3, 0.2, 0.3, 0.3), (0.32, 0.22, 0.1, 0.1)])
        rows.append((f"o{i:02d}", tuple(v + rng.randint(-2, 2) / 1000 for v in base), rng.choice([0.7, 0.9])))
    rows += [(f"z{i:02d}", (0.1, 0.1, 0.06, 0.04), 0.9) for i in range(8)]
    df = objects(spark, rows).cache()
    det = df.select("doc_id", "page_index", "object_id", boxes.R.make(*[F.col(f"rect.{c}") * 1000 for c in "xywh"]).alias("px"), (F.col("confidence") > 0.8).alias("confirmed"))
    steps = {
        "collapse": lambda: boxes.collapse_trivial(df).select("object_id"),
        "parents": lambda: boxes.assign_parents(df).select("object_id", "parent_id"),
        "siblings": lambda: boxes.dedup_siblings(boxes.assign_parents(df)).select("object_id", "parent_id"),
        "sources": lambda: boxes.dedup_sources(det).select("object_id"),
    }
    told = lambda: {k: sorted(map(tuple, f().collect()), key=str) for k, f in steps.items()}
    small = told()
    for k in ("collapse", "parents", "sources"):
        assert "Generate" not in steps[k]()._jdf.queryExecution().optimizedPlan().toString(), k
    monkeypatch.setattr(spatial, "CROWD", 10)
    assert told() == small


def counted(spark, df):
    """``df`` and an accumulator of the rows that were made for it, however often they are read."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(parent):
        made.add(1)
        return parent

    return df.withColumn("parent_id", seen("parent_id")), made


def test_what_made_the_objects_runs_once(spark):
    """Six boxes, one in the other: depths, ancestors and relations don't run their input again for every level or join."""
    rows = [(f"o{i}", (0.1 * i / 2, 0.1 * i / 2, 1 - 0.1 * i, 1 - 0.1 * i), 0.9) for i in range(6)]
    nested = boxes.assign_parents(objects(spark, rows))
    for result, want in ((boxes.depths, 6), (boxes.ancestors, 15), (boxes.relation_graph, 30)):
        df, made = counted(spark, nested)
        assert result(df).count() == want
        assert made.value <= 2 * 6  # once as a condition, once as a column
    assert {r.object_id: r.depth for r in boxes.depths(nested).collect()} == {f"o{i}": i for i in range(6)}


def test_relations_of_small_pages_are_not_shuffled(spark, monkeypatch):
    """Pairs are put in order where the objects of a page meet; page key and grid give the same rows."""
    rng = random.Random(8)
    rows = [(f"o{i:02d}", (rng.randrange(0, 80) / 100, rng.randrange(0, 80) / 100, rng.randrange(2, 40) / 100, rng.randrange(2, 40) / 100), 0.9) for i in range(40)]
    df = boxes.assign_parents(objects(spark, rows + [("t0", rows[0][1], 0.9)])).cache()
    found = boxes.relation_graph(df)
    got = sorted(found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.kind for r in got} == set(boxes.KINDS) and "Generate" not in plan and plan.count("RepartitionByExpression [doc_id") == 2
    monkeypatch.setattr(boxes, "CROWD", 10)
    assert sorted(boxes.relation_graph(df).collect()) == got


def test_a_hierarchy_moves_its_objects_once(spark, monkeypatch):
    """Objects are dealt by page once for all steps; copies, repeated rows and null keys or ids give the rows of the grid."""
    rng = random.Random(5)
    base = [(0.1, 0.1, 0.06, 0.04), (0.105, 0.1, 0.06, 0.04), (0.3, 0.2, 0.3, 0.3), (0.32, 0.22, 0.1, 0.1), (0.05, 0.05, 0.8, 0.8)]
    rows = [(f"o{i:02d}", tuple(v + rng.randint(-3, 3) / 1000 for v in rng.choice(base)), rng.choice([0.7, 0.9])) for i in range(50)]
    df = objects(spark, rows + [("z", base[0], 0.9)] * 2 + [(None, base[3], 0.9), (None, base[1], 0.7)])
    lost = objects(spark, rows[:20]).withColumn("doc_id", F.lit(None).cast("int"))
    df = df.unionByName(lost).unionByName(objects(spark, rows).withColumn("page_index", F.lit(1)).withColumn("confidence", F.lit(0.9)))
    assert boxes.build_hierarchy(df)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    small = sorted(map(tuple, boxes.build_hierarchy(df).drop("rect").collect()), key=str)
    assert sum(r[0] is None for r in small) == 20 and len({r[-1] for r in small}) > 2
    monkeypatch.setattr(spatial, "CROWD", 10)
    assert sorted(map(tuple, boxes.build_hierarchy(df).drop("rect").collect()), key=str) == small


def test_a_crowded_page_of_null_keys_is_no_page(spark):
    df = objects(spark, [(f"o{i:03d}", (0.1, 0.1, 0.5, 0.5), 0.9) for i in range(300)]).withColumn("doc_id", F.lit(None).cast("int"))
    got = boxes.build_hierarchy(df).collect()
    assert len(got) == 300 and {(r.parent_id, r.depth) for r in got} == {(None, 0)}


def test_anchors_are_ranked_where_the_objects_of_a_page_lie(spark, monkeypatch):
    """No pair of a field and an object is shuffled; repeated objects and fields and null ids count as in joins."""
    rng = random.Random(9)
    rows = [(f"o{i:02d}", (rng.randrange(0, 60) / 100, rng.randrange(0, 60) / 100, rng.randrange(2, 50) / 100, rng.randrange(2, 50) / 100), 0.9) for i in range(40)]
    rows += [("big", (0, 0, 1, 1), 0.9)] * 2 + [("mid", (0.1, 0.1, 0.8, 0.8), 0.9)] * 2 + [(None, (0.2, 0.2, 0.5, 0.5), 0.9)]
    df = boxes.assign_parents(objects(spark, rows))
    spots = [(1, 0, f"f{i}", (rng.randrange(0, 80) / 100, rng.randrange(0, 80) / 100, 0.05, 0.02)) for i in range(6)]
    spots += [(1, 0, "f0", (0.3, 0.3, 0.05, 0.02)), (1, 0, None, (0.5, 0.5, 0.05, 0.02)), (1, 5, "f0", (0.5, 0.5, 0.05, 0.02)), (None, 0, "f0", (0.5, 0.5, 0.05, 0.02))]
    fields = spark.createDataFrame(spots, f"doc_id int, page_index int, field_id string, bbox {RECT}")
    told = lambda: sorted(map(str, anchors.field_anchors(fields, df).collect()))
    plan = anchors.field_anchors(fields, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # the objects and the fields
    small = told()
    assert len(small) == 7 * 3
    monkeypatch.setattr(spatial, "CROWD", 10)
    assert told() == small


def test_duplicates_and_nested_boxes_meet_where_their_page_lies(spark, monkeypatch):
    """Each box is moved once and copied into no grid cell; page key and grid give the same rows."""
    rng = random.Random(6)
    base = [(100, 100, 260, 240), (300, 200, 300, 300), (310, 210, 60, 60), (500, 500, 20, 20)]
    rows = [(1, 0, f"obj_{rng.choice(['cv', 'blob', 'cv_cell'])}_{i}", tuple(float(v + rng.randint(-4, 4)) for v in rng.choice(base))) for i in range(40)]
    rows += [(1, 0, None, (300.0, 200.0, 300.0, 300.0)), (None, 0, "obj_cv_1", (100.0, 100.0, 260.0, 240.0)), (2, 0, "obj_cv_x", (0.0, 0.0, 900.0, 900.0))] + rows[:2]
    det = spark.createDataFrame(rows, f"doc_id int, page_index int, object_id string, px {RECT}").cache()
    pages = spark.createDataFrame([(1, 0, 1000, 1000), (2, 0, 1000, 1000)], "doc_id int, page_index int, width int, height int")
    steps = (lambda: boxes.duplicate_pairs(det), lambda: boxes.blobs_to_decompose(det, pages))
    told = lambda: [sorted(map(str, f().collect())) for f in steps]
    small = told()
    assert all(small) and all("Generate" not in f()._jdf.queryExecution().optimizedPlan().toString() for f in steps)
    monkeypatch.setattr(spatial, "CROWD", 10)
    assert told() == small


def test_rectangles_of_small_pages_meet_where_they_are_dealt(spark, monkeypatch):
    """Page key and grid give the same rectangles, leaves and chains; chains of small pages are found after one shuffle."""
    rng = random.Random(14)
    rule = lambda: (rng.randrange(0, 300), s := rng.randrange(0, 150), s + rng.randrange(20, 220))
    rows = [(1, page, axis, p, 1, s, e) for page in (0, 1) for axis in (0, 1) for p, s, e in (rule() for _ in range(8))]
    rows += [(2, 0, axis, 40 * i, 1, 0, 200) for axis in (0, 1) for i in range(6)] + [(None, 0, axis, 40 * i, 1, 0, 200) for axis in (0, 1) for i in range(2)]
    seg = spark.createDataFrame(rows, SEGMENT)
    given = spark.createDataFrame([(d, k, *r) for d, k in ((1, 0), (2, 0), (None, 0)) for r in grid(5, 2)], "doc_id int, page_index int, left long, top long, right long, bottom long")
    steps = {
        "rects": lambda: lines.line_rects(seg, boxes.PAGE, F.lit(4)),
        "leaves": lambda: lines.leaves_and_outermost(given, boxes.PAGE, F.lit(5)),
        "chains": lambda: lines.suppress_chains(given, boxes.PAGE),
    }
    told = lambda: {k: sorted(map(str, f().collect())) for k, f in steps.items()}
    small = told()
    assert all(small.values()) and steps["chains"]()._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    monkeypatch.setattr(spatial, "CROWD", 6)
    assert told() == small


def test_relations_are_sorted_in_compiled_code(spark):
    """Beyond 8,000 bytes the JVM interprets a generated method, which takes several times as long for each pair."""
    rows = [(f"o{i:02d}", (0.02 * (i % 10), 0.05 * (i // 10), 0.015, 0.03), 0.9) for i in range(40)]
    out = io.StringIO()
    with settings(spark, spark__sql__adaptive__enabled="false"), contextlib.redirect_stdout(out):
        boxes.relation_graph(boxes.assign_parents(objects(spark, rows))).explain("codegen")
    text = out.getvalue()
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
