import itertools
import random

import pyarrow as pa
import pytest

from boxledger.functions import rect as R
from boxledger.operators import consensus as C
from boxledger.operators import matching as M
from boxledger.session import settings

RECT = "struct<x:double,y:double,w:double,h:double>"
PAGE = ["doc_id", "page_index"]


def pairs(spark, scores):
    return spark.createDataFrame([(1, 0, c, r, s) for c, r, s in scores], "doc_id int, page_index int, config_id string, runtime_id string, score double")


def test_optimal_places_more_than_greedy(spark):
    """Every box likes the first column a little more than its own: the scan gives it to one and strands another."""
    n = 6
    scores = [(f"box{i}", f"col{j}", 0.8 if j == i else 0.81 + i / 1000 if j == 0 else 0.2) for i in range(n) for j in range(n)]
    p = pairs(spark, scores)
    greedy = M.assign_greedy(p, PAGE, 0.5).collect()
    best = {r.config_id: r.runtime_id for r in M.assign_optimal(p, PAGE, 0.5).collect()}
    assert len(greedy) == n - 1
    assert best == {f"box{i}": f"col{i}" for i in range(n)}


def test_one_more_object_does_not_change_the_method(spark):
    rng = random.Random(11)
    for n in (2, 3, 4, 6):
        s = [(f"t{i}", f"p{j}", round(0.5 + rng.random() / 2, 4)) for i in range(n) for j in range(n)]
        want = max(sum(x[2] for x in s if (int(x[0][1:]), int(x[1][1:])) in set(enumerate(o))) for o in itertools.permutations(range(n)))
        assert sum(r.score for r in M.assign(pairs(spark, s), PAGE, 0.1).collect()) == pytest.approx(want)


def test_optimal_equals_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        s = [(f"c{i}", f"r{j}", round(rng.random(), 3)) for i in range(4) for j in range(9)]
        grid = {(c, r): v for c, r, v in s if v >= 0.3}
        want = max(sum(grid.get((f"c{i}", f"r{j}"), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(9), 4))
        got = M.assign_optimal(pairs(spark, s), PAGE, 0.3).collect()
        assert sum(r.score for r in got) == pytest.approx(want)


def page(spark, nodes, side):
    rows = [(1, 1, 0, i, tuple(float(v) for v in r), p) for i, r, p in nodes]
    name = "config_id" if side == "c" else "runtime_id"
    df = spark.createDataFrame(rows, f"doc_id int, template_id int, page_index int, {name} string, {side} {RECT}, {side}_parent string")
    return df.drop("doc_id") if side == "c" else df


def match(spark, config, runtime, **opts):
    tf = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0, 1.0))], f"template_id int, page_index int, c_refined {RECT}")
    rf = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0, 1.0))], f"doc_id int, page_index int, r_refined {RECT}")
    o = M.MatchOptions(cross_document=False, **opts)
    return M.match_pages(page(spark, config, "c"), page(spark, runtime, "r"), tf, rf, o).collect()


def test_near_equal_partner_is_named_in_a_warning(spark):
    place = (0.31, 0.62, 0.25, 0.07)
    got = match(spark, [("stamp", place, None)], [("scan_stamp", place, None), ("scan_copy", (0.313, 0.621, 0.25, 0.07), None)])
    assert [(m.config_id, m.runtime_id) for m in got] == [("stamp", "scan_stamp")]
    assert got[0].warnings[0].startswith("ambiguous match") and "scan_copy" in got[0].warnings[0] and got[0].confidence < got[0].score


def test_recovery_admits_a_lone_pair_and_refuses_twins(spark):
    box = [("signature", (0.55, 0.4, 0.3, 0.12), None)]
    strict = {"min_hierarchical": 0.99, "min_global": 0.96}
    lone = match(spark, box, [("ink", (0.64, 0.4, 0.3, 0.12), None)], **strict)
    assert [m["pass"] for m in lone] == ["recovery"] and lone[0].notes[0].startswith("recovery pass admitted")
    assert match(spark, box, [("ink_a", (0.64, 0.4, 0.3, 0.12), None), ("ink_b", (0.642, 0.4, 0.3, 0.12), None)], **strict) == []


def test_depth_gap_is_matched_by_the_global_pass(spark):
    """On the scan the amount sits in a stack of frames that the form does not have; its place gives it away."""
    form = [("sheet", (0.03, 0.02, 0.91, 0.94), None), ("table", (0.12, 0.22, 0.66, 0.58), "sheet"), ("amount", (0.52, 0.61, 0.14, 0.06), "table")]
    scan = [("s_sheet", form[0][1], None), ("s_table", form[1][1], "s_sheet")]
    for k in range(3):  # frames of their own shape, each around the amount
        scan.append((f"frame{k}", (0.2 + 0.05 * k, 0.3 + 0.04 * k, 0.55 - 0.07 * k, 0.47 - 0.06 * k), scan[-1][0]))
    scan.append(("s_amount", form[2][1], scan[-1][0]))
    got = {m.config_id: (m.runtime_id, m["pass"]) for m in match(spark, form, scan)}
    assert got == {"sheet": ("s_sheet", "hierarchy"), "table": ("s_table", "hierarchy"), "amount": ("s_amount", "global")}


KEYS = ("sx", "sy", "tx", "ty")


def agree(a, b):
    return max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 0.1 and max(abs(a[2] - b[2]), abs(a[3] - b[3])) <= 0.06


def brute_seeds(matches):
    """{id: (members, weight)} by comparing every pair."""
    return {i: ([k for k, (b, _) in matches.items() if agree(a, b)], round(sum(w for b, w in matches.values() if agree(a, b)), 9)) for i, (a, _) in matches.items()}


def mean_of(matches, ids):
    total = sum(matches[i][1] for i in ids)
    return tuple(sum(matches[i][0][d] * matches[i][1] for i in ids) / total for d in range(4))


def still(a):
    return abs(a[0] - 1) <= 0.005 and abs(a[1] - 1) <= 0.005 and abs(a[2]) <= 0.005 and abs(a[3]) <= 0.005


def brute_regions(matches):
    seeds = brute_seeds(matches)
    order = sorted(seeds, key=lambda i: (-len(seeds[i][0]), -seeds[i][1], i))
    if not still(mean_of(matches, seeds[order[0]][0])):
        return []
    out = []
    for i in order[1:]:
        if len(seeds[i][0]) >= 2 and not still(mean_of(matches, seeds[i][0])) and not any(agree(matches[i][0], matches[k][0]) for k in out):
            out.append(i)
    return out


def random_page(rng, n):
    """Matches around a few shifts, one of them none at all, and some strays; weights are squared confidences."""
    centres = [(1.0, 1.0, 0.0, 0.0)] + [(1 + rng.uniform(-0.3, 0.3), 1 + rng.uniform(-0.3, 0.3), rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)) for _ in range(rng.randrange(1, 4))]
    out = {}
    for k in range(n):
        c = rng.choice(centres[:1] * 4 + centres) if rng.random() < 0.9 else tuple(rng.uniform(-1, 2) for _ in range(4))
        spread = 0.001 if c is centres[0] else 0.04
        confidence = rng.randrange(40, 100) / 100
        out[f"m{k:02d}"] = (tuple(v + rng.uniform(-spread, spread) for v in c), confidence * confidence)
    return out


def test_consensus_and_regions_equal_all_pairs_on_random_pages(spark):
    rng = random.Random(23)
    pages = {d: random_page(rng, rng.randrange(1, 32)) for d in range(40)}
    rows = [(d, 1, 0, i, f"r_{i}", w**0.5, ["x"], a, (0.2, 0.1, 0.3, 0.1), (0.2, 0.1, 0.3, 0.1)) for d, page in pages.items() for i, (a, w) in page.items()]
    m = spark.createDataFrame(
        rows, f"doc_id int, template_id int, page_index int, config_id string, runtime_id string, confidence double, basis array<string>, affine struct<sx:double,sy:double,tx:double,ty:double>, c {RECT}, r {RECT}"
    )
    w = C.with_weight(m)
    found = {(r.doc_id, r.seed_id): r for r in C.seeds(w).collect()}
    for d, page in pages.items():
        for i, (members, weight) in brute_seeds(page).items():
            assert found[d, i].n_kept == len(members) and found[d, i].kept_weight == pytest.approx(weight, abs=1e-8)
    regions = {}
    for r in C.regional_transforms(w, C.max_inlier(w)).orderBy("doc_id", "seed_rank").collect():
        regions.setdefault(r.doc_id, []).append(r.seed_id)
        assert tuple(r.affine) == pytest.approx(mean_of(pages[r.doc_id], brute_seeds(pages[r.doc_id])[r.seed_id][0]))
    assert regions == {d: x for d, page in pages.items() if (x := brute_regions(page))} and regions


def test_clip_keeps_size(spark):
    box = spark.range(1).select(R.clip_box(R.make(R.lit(0.9), R.lit(-0.1), R.lit(0.3), R.lit(0.2)), "projected").alias("c")).first().c
    assert tuple(round(v, 9) for v in box.box) == (0.7, 0.0, 0.3, 0.2) and "sides=[right,top]" in box.warning


def test_pairs_are_not_moved_for_frames_and_parent_evidence(spark):
    """Frames and evidence are joined to the objects: behind the pair join nothing is shuffled."""
    unit = (0.0, 0.0, 1.0, 1.0)
    tmpl = page(spark, [("p", unit, None), ("k", (0.1, 0.1, 0.2, 0.2), "p")], "c")
    rt = page(spark, [("q", unit, None), ("l", (0.1, 0.1, 0.2, 0.2), "q")], "r")
    tf = spark.createDataFrame([(1, 0, unit)], f"template_id int, page_index int, c_refined {RECT}")
    rf = spark.createDataFrame([(1, 0, unit)], f"doc_id int, page_index int, r_refined {RECT}")
    anc_c = spark.createDataFrame([(1, 0, "k", "p", 1)], "template_id int, page_index int, config_id string, ancestor_id string, distance int")
    anc_r = spark.createDataFrame([(1, 0, "l", "q", 1)], "doc_id int, page_index int, runtime_id string, ancestor_id string, distance int")
    matched = spark.createDataFrame([(1, 1, 0, "p", "q")], "doc_id int, template_id int, page_index int, config_id string, runtime_id string")
    known = M.parent_evidence(rt, anc_c, anc_r, matched)
    scored = M.parent_chain(M.sim_components(M.candidates(*M.with_frames(tmpl, known, tf, rf))))
    assert {(r.config_id, r.runtime_id): r.s_parent for r in scored.collect()} == {("p", "q"): 1.0, ("p", "l"): 0.0, ("k", "q"): 0.0, ("k", "l"): 1.0}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "template_id" in top and "runtime_id" not in top


def test_groups_are_solved_across_the_borders_of_batches():
    """Rows of a group lie side by side, but a batch may end inside of it; a null key is a group of its own."""
    rng = random.Random(3)
    rows = [(d, 0, f"c{i}", f"r{j}", round(rng.uniform(0.5, 1), 4)) for d in (None, *range(9)) for i in range(3) for j in range(4)]
    names = [*PAGE, "config_id", "runtime_id", "score"]
    t = pa.table({k: [r[n] for r in rows] for n, k in enumerate(names)})
    want = None
    for size in (1000, 13, 5, 1):
        got = pa.Table.from_batches(M._solve_groups(PAGE, iter(t.to_batches(max_chunksize=size)))).to_pylist()
        assert len(got) == 10 * 3 and len({(r["doc_id"], r["runtime_id"]) for r in got}) == 10 * 3
        want = want or got
        assert got == want
    for d in (None, 4):
        grid = {(r[2], r[3]): r[4] for r in rows if r[0] == d}
        best = max(sum(grid[f"c{i}", f"r{j}"] for i, j in enumerate(p)) for p in itertools.permutations(range(4), 3))
        assert sum(r["score"] for r in want if r["doc_id"] == d) == pytest.approx(best)


def test_many_small_groups_need_no_call_each(spark):
    """One Python step takes the groups of a task in batches."""
    p = pairs(spark, [("c1", "r1", 0.9), ("c2", "r1", 0.8), ("c2", "r2", 0.7)])
    plan = M.assign_optimal(p, PAGE, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_rivals_move_the_pairs_once(spark):
    """The best and second best partners come from windows over one shuffle, without a join of the pairs with themselves."""
    p = pairs(spark, [("c1", "r1", 0.9), ("c1", "r2", 0.8), ("c1", "r3", 0.0), ("c2", "r1", 0.7), ("c2", "r3", 0.0), ("c3", "r3", 0.0)])
    got = M.rivals(p, PAGE)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.config_id, r.runtime_id): (r.rival_id, r.rival_score) for r in got.collect()} == {
        ("c1", "r1"): ("r2", 0.8), ("c1", "r2"): ("r1", 0.9), ("c1", "r3"): ("r1", 0.9), ("c2", "r1"): (None, None), ("c2", "r3"): ("r1", 0.7), ("c3", "r3"): (None, None),
    }


def test_scoring_of_pairs_stays_compilable(spark):
    """The JVM does not compile methods of more than 8,000 bytes; whole rows and scores together were longer than that."""
    rect, rows = RECT, [(1, 1, 0, "a", (0.1, 0.1, 0.2, 0.2), None)]
    rt = spark.createDataFrame(rows, f"doc_id int, template_id int, page_index int, runtime_id string, r {rect}, r_parent string")
    tmpl = spark.createDataFrame([r[1:] for r in rows], f"template_id int, page_index int, config_id string, c {rect}, c_parent string")
    tf = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0, 1.0))], f"template_id int, page_index int, c_refined {rect}")
    rf = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0, 1.0))], f"doc_id int, page_index int, r_refined {rect}")
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        both = M.candidates(*M.with_frames(tmpl, rt, tf, rf))
        got = M.similar_pairs(both)
        codes = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(got._jdf.queryExecution().executedPlan())
        sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert sizes and max(sizes) <= 8000
    names = ["s_position", "s_size", "s_aspect", "s_border"]
    assert got.select(*names).collect() == M.sim_components(both).where(M.passes_floors()).select(*names).collect()
