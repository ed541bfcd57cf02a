"""HTML extraction and chat formatting."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from boxledger.llm import chat_format, html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav></header>
<div id="cookie-notice"><p>We use cookies to make this site better for every reader.</p></div><!-- <p>no</p> -->
<div class="layout"><article><header><h1>A &amp; B</h1></header><p><b>One</b> two&nbsp;
 three<br>four<p>Un&eacute; &#8364;<ul><li>x<li>y</ul><form><label>Mail</label><button>Go</button></form>
<div class="ad">Buy this now, it is really cheap today!</div><aside>See also</aside></article>
<section id="comments"><article class="comment"><p>What a nice text this was, thank you for writing it.</p></article></section></div>
<aside><p>A long story about something else that nobody has asked for at all.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "A & B\nOne two three four\nUné €\nx\ny"
    assert html_text.main_text("") == ""
    assert html_text.main_text("just &lt;text&gt; here") == "just <text> here"
    assert html_text.main_text("<p>a<p>b<div>c</div") != ""


def test_a_form_around_the_page_is_no_form():
    page = "<body><form id=f><nav><a href=x>Home</a></nav><main><h2>Head</h2><p>Some text of the page, long enough.</p></main></form></body>"
    assert html_text.main_text(page) == "Head\nSome text of the page, long enough."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 8)
        costs = [(rng.randrange(0, 9), rng.randrange(0, 9)) for _ in range(n)]
        ties = [(i, j, rng.randrange(0, 5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def price(labels):
            return sum(b if x else a for (a, b), x in zip(costs, labels)) + sum(c for i, j, c in ties if labels[i] != labels[j])  # noqa: B905, B023

        got = html_text.minimum_cut(costs, ties)
        assert price(got) <= min(price(x) for x in itertools.product([False, True], repeat=n)) + 1e-6


def test_extraction_on_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.n_chars for r in got if r.page_id == 3] == [249_999]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_extraction_of_given_pages(spark):
    """Whatever stands outside the article element is gone, whatever stands in it is there."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in queries.op10_html_text(spark, "/root/testdata/sf0.001").collect():
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = [html_text.html.unescape(x) for x in html_text.re.split(r"</?(?:p|h1|b)>|<br>", inside)]
        assert r.text.split() == " ".join(want).split()


def brute_format(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1

    def show(turns):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    return k, show(chosen[:k]), show(chosen[k:]), show(rejected[k:])


def test_preference_format_matches_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for pair in range(60):
        base = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a", "b é", ""])) for _ in range(rng.randrange(0, 6))]
        sides = {}
        for side in ("chosen", "rejected"):
            sides[side] = base[: rng.randrange(0, len(base) + 1)] + [(rng.choice(["user", "assistant"]), rng.choice(["c", "d"])) for _ in range(rng.randrange(0, 3))]
            rows += [(pair, side, i, r, t) for i, (r, t) in enumerate(sides[side])]
        if any(sides.values()):
            want[pair] = brute_format(sides["chosen"], sides["rejected"])
    rows += [(None, "chosen", 0, "user", "x"), (1000, "other", 0, "user", "x"), (1001, "chosen", None, None, None), (1001, "rejected", None, None, None)]
    want[1001] = (1, "<|im_start|>\n<|im_end|>\n", "", "")
    turns = spark.createDataFrame(rows, "pair_id bigint, side string, turn int, role string, text string").selectExpr("*", "1 AS k", "2 AS c").repartition(4)
    got = {r.pair_id: r for r in chat_format.preference_format(turns).collect()}
    assert {p: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for p, r in got.items()} == want
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(m.n_chars for m in mask) == len(text)
            at, learnt = 0, ""
            for m in mask:
                learnt += text[at : at + m.n_chars] if m.learnt else ""
                at += m.n_chars
            turns_of = [x.split("\n", 1) for x in text.split("<|im_start|>")[1:]]
            assert learnt == "".join(body for role, body in turns_of if role == "assistant")
    assert chat_format.preference_format(turns.limit(0)).count() == 0


def test_every_conversation_gives_a_pair(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "only"), (None, 0, "assistant", "x")]
    conversations = spark.createDataFrame(rows, "conversation_id bigint, turn int, role string, text string").selectExpr("*", "1 AS part", "2 AS partner", "3 AS ts")
    got = {r.pair_id: r for r in chat_format.preference_format(chat_format.preference_pairs(conversations)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].n_prompt_turns, got[1].rejected) == (3, "<|im_start|>assistant\na1<|im_end|>\n")
    assert got[1].chosen == "<|im_start|>assistant\na2<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert got[2].rejected == "<|im_start|>assistant\n<|im_end|>\n" and got[2].decided
    assert (got[3].prompt, got[3].chosen, got[3].rejected, got[3].decided) == ("<|im_start|>user\nonly<|im_end|>\n", "", "", False)
    assert chat_format.preference_pairs(conversations.where(F.lit(False))).count() == 0


def test_partners_share_the_first_turn_and_part_later(spark):
    """A hot first turn: every conversation has at most one partner, and they part at any turn."""
    rng = random.Random(4)
    talks = {c: [("user", "hello"), *[(rng.choice(["assistant", "user"]), rng.choice("xy")) for _ in range(rng.randrange(0, 5))]] for c in range(200)}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conversation_id bigint, turn int, role string, text string").repartition(3)
    got = chat_format.preference_format(chat_format.preference_pairs(df)).collect()
    assert len(got) == 200 and {r.n_prompt_turns for r in got} >= {1, 2, 3}
    parts = {}
    for c in talks:
        parts.setdefault(hashlib.md5(str(c).encode()).hexdigest()[0], []).append(c)
    follows = {a: b for ids in parts.values() for a, b in zip(ids, ids[1:])}  # noqa: B905
    for r in got:
        if r.pair_id in follows:
            k, prompt, chosen, rejected = brute_format(talks[r.pair_id], talks[follows[r.pair_id]])
            assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (k, prompt, chosen, rejected)


LONG = "<p>This is a rather long sentence of the story that goes on for a while and ends with a stop.</p>"


def test_no_class_word_takes_an_article_away():
    line = LONG[3:-4]
    assert html_text.main_text(f'<div class="layout with-sidebar"><article>{LONG}</article></div>') == line
    assert html_text.main_text(f'<div id="main" class="has-sidebar">{LONG}{LONG}</div>') == f"{line}\n{line}"
    assert html_text.main_text(f'<article><div class="post-body share-enabled">{LONG}</div></article>') == line
    assert html_text.main_text('<article><p class="has-comments">hello there you</p></article>') == "hello there you"
    assert html_text.main_text(f'<aside class="sidebar"><main>{LONG}</main></aside>') == line
    assert html_text.main_text(f'<div id="comments"><article>{LONG}</article></div><article><p>Me.</p></article>') == "Me."
    assert html_text.main_text(f'<div><a href="x">Home</a> | <a href="y">About</a></div>{LONG}') == line


def given_pages() -> list[str]:
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()


def test_cut_is_right_where_thresholds_are_wrong():
    """Pages without landmarks and classes whose every other paragraph is a plain div: neighbours tell what its look does not."""
    pages = given_pages()
    rows = html_text.np.array([r for p in pages[:100] for r in html_text.training_blocks(p)])
    weights = html_text.logistic(rows[:, :-1], rows[:, -1])
    wrong_alone = wrong_cut = total = 0
    for page in pages[100:]:
        truth = [r[-1] > 0 for r in html_text.training_blocks(page)]
        bare = html_text.re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", html_text.re.sub(r' class="[^"]*"', "", page))
        pieces = bare.split("<p>")
        bare = pieces[0] + "".join(f"<div>{x.replace('</p>', '</div>')}" if k % 2 else f"<p>{x}" for k, x in enumerate(pieces[1:]))
        blocks = html_text.blocks_of(bare)
        assert len(blocks) == len(truth)
        alone = [html_text.block_odds(b, weights) > 0 for b in blocks]
        cut = html_text.minimum_cut([html_text.block_costs(b, weights) for b in blocks], html_text.ties_of(blocks))
        wrong_alone += sum(a != t for a, t in zip(alone, truth, strict=True))
        wrong_cut += sum(a != t for a, t in zip(cut, truth, strict=True))
        total += len(blocks)
    assert wrong_cut < 0.5 * wrong_alone and wrong_alone > 0.02 * total, (wrong_cut, wrong_alone, total)


def test_weights_without_articles_are_the_given_ones(spark):
    pages = spark.createDataFrame([(1, "u", "<p>no article here</p>"), (2, "v", None)], "page_id bigint, url string, html string")
    assert (html_text.fit_blocks(pages) == html_text.UNTRAINED).all()
