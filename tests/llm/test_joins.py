"""Shingle join, line dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxledger.llm import decontaminate, line_dedup, queries, shingle_join
from boxledger.llm.common import document_texts
from tests.llm.forms import AWKWARD, documents, with_clashes, words

SPACE = " \t\n\x0b\x0c\r"


def shingles(text, size):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                label[hi] = lo
    return {d: root(d) for d in label}


def near_copies(seed):
    rng = random.Random(seed)
    rows, doc = list(AWKWARD), 0
    for base in range(12):
        text = words(rng, rng.choice([4, 9, 12, 15, 20, 23, 30, 60, 150, 400]))
        for _ in range(rng.randrange(1, 14)):
            copy = list(text)
            for _ in range(rng.randrange(0, max(2, len(copy) // 40 + 1))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = words(rng, rng.randrange(2))
            rows.append((doc, " ".join(copy).upper() if doc % 3 else "  ".join(copy)))
            doc += 1
            if rng.random() < 0.5:
                text = copy  # chains: the ends may not link directly
    passage = " ".join(words(rng, 60))
    rows += [(doc + i, passage + "\n" + " ".join(words(rng, 15))) for i in range(12)]
    return rows


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_components_match_brute_force(spark, seed, size, percent):
    rows = near_copies(seed)
    got = shingle_join.linked_components(with_clashes(documents(spark, rows)), size, percent).collect()
    want = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    assert {r.document_id: r.component_id for r in got if r.document_id is not None} == want
    sizes = {d: len(shingles(t, size)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.document_id] for r in got)
    assert [r.component_id for r in got if r.document_id is None] == [None]
    kept = [r.document_id for r in shingle_join.one_of_each(documents(spark, rows), size, percent).collect()]
    assert sorted(x for x in kept if x is not None and x != 904) == sorted(d for d, c in want.items() if d == c and d != 904)


def test_star_of_near_copies_needs_no_common_pivot(spark):
    """Copies that differ more from the first one than from each other still meet."""
    rng = random.Random(5)
    base = words(rng, 120, 10**6)
    rows = []
    for i in range(40):
        copy = list(base)
        for at in range(i % 8):
            copy[at * 13 + 5] = f"v{at}"
        rows.append((i, " ".join(copy)))
    got = {r.document_id: r.component_id for r in shingle_join.linked_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows, 3, 90)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        small = shingle_join.boundary(percent)
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 90))).astype(np.uint64))
            cut = int(rng.integers(0, max(1, len(a) // 6) + 1))
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), cut, False)), rng.integers(0, 2**63, int(rng.integers(0, cut + 2))).astype(np.uint64)]))
            both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both >= percent * union and both < union:
                grams, borders = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                for heavy in (None, np.sort(np.concatenate([a[::3], b[::2]]))):
                    sig, row = shingle_join.signatures(grams, borders, percent, small, heavy)
                    assert np.intersect1d(sig[row == 0], sig[row == 1]).size
                bits, at = shingle_join.bitmaps(grams, borders)
                assert int(np.bitwise_count(bits[: at[1]] ^ bits[at[1] :]).sum()) <= union - both


def test_bitmaps_of_large_sets_fold_onto_those_of_smaller_ones(spark):
    """Sets on both sides of a power of two: equal up to few elements, and unrelated ones of their size."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**63, 4400).astype(np.uint64)
    b, c = a[:4000], rng.integers(0, 2**63, 4000).astype(np.uint64)
    bits, at = shingle_join.bitmaps(np.concatenate([np.sort(x) for x in (a, b, c)]), np.array([0, 4400, 8400, 12400]))
    assert np.diff(at).tolist() == [128, 64, 64]
    half = bits[:64] ^ bits[64:128]
    assert int(np.bitwise_count(half ^ bits[128:192]).sum()) <= 400 < 1000 < int(np.bitwise_count(half ^ bits[192:]).sum())
    rows = [(i, n, bits[at[i] : at[i + 1]].view(np.int64).tolist()) for i, n in enumerate((4400, 4000, 4000))]
    sets = spark.createDataFrame(rows, "document_id bigint, n_shingles bigint, bits array<bigint>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint")
    assert [tuple(r) for r in shingle_join.plausible(pairs, sets, 80).collect()] == [(0, 1)]


def test_empty_table_has_no_components(spark):
    assert shingle_join.linked_components(documents(spark, [])).count() == 0


def brute_dedup(rows, min_chars=10):
    keys = {}
    lines = {i: (t or "").split("\n") for i, (_, t) in enumerate(rows)}

    def key(line):
        return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})

    for i, (d, _) in enumerate(rows):
        for line in lines[i] if d is not None else []:
            if len(key(line)) >= min_chars:
                keys.setdefault(key(line), set()).add(d)
    out = []
    for i, (d, _) in enumerate(rows):
        keep = [x for x in lines[i] if d is None or len(key(x)) < min_chars or len(keys[key(x)]) < 2 or d == min(keys[key(x)])]
        out.append((d, len(lines[i]), len(lines[i]) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(words(rng, rng.randrange(1, 6))) for _ in range(30)] + ["", "  Übergabe der Akten  ", "ÜBERGABE der akten", "short", "PAGE  1 of 1"]
    rows = list(AWKWARD) + [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else f" {rng.choice(pool)}\t" for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    # one line that most documents have, often
    rows += [(100 + i, "\n".join(["please print in capital letters"] * (i % 3 + 1) + [f"own line number {i}"])) for i in range(1500)]
    want = sorted(brute_dedup(rows), key=str)
    got = line_dedup.without_repeated_lines(with_clashes(documents(spark, rows), "h1", "position", "dropped", "keep_runs")).select("document_id", "n_lines", "n_dropped", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    maps = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert "text" not in maps[0].asDict()
    for r in maps:
        assert sum(r.keep_runs) == r.n_lines and sum(r.keep_runs[1::2]) == r.n_dropped
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_of_form_readings(spark):
    """Printed template lines that field readings repeat stay in the first document only."""
    rows = [(d, 0, f, t) for d in (1, 2, 3) for f, t in (("a_title", "Application for leave"), ("b_name", f"Applicant number {d}"))]
    readings = spark.createDataFrame(rows, "doc_id bigint, page_index int, field_id string, text string")
    got = {r.document_id: r.text for r in line_dedup.without_repeated_lines(document_texts(readings)).collect()}
    assert got == {1: "Application for leave\nApplicant number 1", 2: "Applicant number 2", 3: "Applicant number 3"}


ITEMS = [
    (1, "If Anna buys 12 pears for 3 dollars each and sells 5 pears to Ben, how much money did Anna spend on the pears she kept?"),
    (2, "A train runs 120 km in 2 hours. How many km does the train run in 7 hours at the same speed on the same track?"),
    (3, "name the largest moon"),
    (4, None),
]


def test_decontamination_finds_copies_and_new_parameters(spark):
    filler = " ".join(words(random.Random(3), 80))
    rows = [
        (1, f"{filler}. {ITEMS[0][1]} {filler}"),
        (2, f"{filler}\nIf Clara buys 30 pears for 9 dollars each and sells 8 pears to Tom, how much money did Clara spend on the pears she kept? {filler}"),
        # The same shape, but Anna's place is filled with two different names: no consistent copy.
        (3, f"{filler}\nIf Clara buys 30 pears for 9 dollars each and sells 8 pears to Tom, how much money did Olga spend on the pears she kept? {filler}"),
        (4, filler),
        (5, "A TRAIN RUNS 120 KM IN 2 HOURS. HOW MANY KM DOES THE TRAIN RUN IN 7 HOURS AT THE SAME SPEED ON THE SAME TRACK?"),
        (6, "please name the largest moon now"),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
        *AWKWARD,
    ]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS size", "'x' AS h")
    docs = with_clashes(documents(spark, rows), "h", "canon", "raw", "size", "shift")
    got = {(r.document_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 3)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 6
    kept = decontaminate.clean_of_benchmark(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.document_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in (1, 2, 5, 6)), key=str)
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.contaminated(documents(spark, rows), items.limit(0)).count() == 0


def brute_windows(rows, items, size=8):
    def plain_words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = set()
    for i, t in items:
        w = plain_words(t)
        have = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for d, x in rows:
            y = plain_words(x)
            if len(have & {tuple(y[k : k + size]) for k in range(len(y) - size + 1)}) >= min(5, -(-len(have) // 2)):
                out.add((d, i))
    return out


def test_decontamination_query_on_given_tables(spark):
    """Benchmark passages of the given tables hold no changed slots: plain word windows must find the same pairs."""
    from boxledger.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got == brute_windows(rows, items)


LONG = "we saw that Tom keeps all of his old books in a large box under the bed at home"
PLAIN = "every small boat on this quiet river carries bread and fruit from one green village down to another"


def found_in(spark, item, *rows):
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    return {r.document_id for r in decontaminate.contaminated(documents(spark, list(enumerate(rows))), items).collect()}


def test_decontamination_follows_edits_that_move_the_diagonal(spark):
    w = PLAIN.split()
    assert found_in(spark, LONG, LONG.replace("Tom", "Mary Ann"), "all of his old books are in a box") == {0}
    assert found_in(spark, PLAIN, " ".join([*w[:9], "new", *w[9:]]), " ".join(w[:8] + w[9:]), " ".join(w[9:] + w[:9]), " ".join(w[:9])) == {0, 1}


def test_decontamination_finds_exact_copies_in_any_case_and_context(spark):
    item = "What is the capital city of France?"
    assert found_in(spark, item, f"text 12 {item} more", item.lower(), item.upper(), "What is the capital of France?") == {0, 1, 2}
    assert found_in(spark, LONG, LONG.lower(), LONG.replace(" Tom", "\nTom"), LONG.replace(" Tom", "\nMax")) == {0, 1, 2}


def test_decontamination_checks_slots_of_matched_windows_only(spark):
    half = "Tom walked down the long road to the old mill and sat there for one whole day until the rain was over"
    item = f"we know that {half} and so we think that Tom never came home again in all these years of war"
    kept = item.replace("that Tom never", "that he never")  # no match there, so no slot
    other = item.replace("that Tom never", "that Max never")  # unchanged windows are enough
    assert found_in(spark, item, kept, other) == {0, 1}


def test_join_query_on_given_tables(spark):
    from boxledger.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in queries.op2_shingle_join(spark, sf).collect()}
    assert got == brute_components(rows, 3, 90)


def test_dedup_query_hashes_kept_text(spark):
    from boxledger.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_dedup(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op3_line_dedup(spark, sf).select(F.col("*")).collect()} == want


def test_large_benchmarks_are_shuffled_with_the_same_result(spark, monkeypatch):
    read = lambda bound: sorted(map(tuple, queries.op8_decontaminate(spark, "/root/testdata/sf0.001").collect())) if monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound) is None else None
    assert read(500_000) == read(-1) != []
