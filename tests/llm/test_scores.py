"""Language, tokens, quality, mixing: against brute force, the libraries themselves and held-out rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxledger.llm import language, quality_rules, queries, reading_quality, source_mix, token_counts
from boxledger.llm.textarrays import Texts
from tests.llm.forms import AWKWARD, documents, with_clashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, labels


# --- language -------------------------------------------------------------------------------------------------------


def ppm_bits(samples: list[bytes], text: bytes) -> float:
    """Escape method C; the escape goes to the shorter context given that nothing seen in this one follows."""
    counts = collections.defaultdict(collections.Counter)
    for s in samples:
        padded = b"\n" * language.ORDER + s
        for i in range(language.ORDER, len(padded)):
            for order in range(language.ORDER + 1):
                counts[padded[i - order : i]][padded[i]] += 1

    def chances(context: bytes) -> list[float]:
        lower = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context)
        if not seen:
            return lower
        total, kinds = sum(seen.values()), len(seen)
        left = sum(p for b, p in enumerate(lower) if b not in seen)
        return [seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * lower[b] / left for b in range(256)]

    padded = b"\n" * language.ORDER + text
    return -sum(math.log2(chances(padded[i - language.ORDER : i])[padded[i]]) for i in range(language.ORDER, len(padded)))


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"the end"], "b": ["où est le thé".encode(), b"la fin"]}
    trees = language.build_trees(samples)
    texts = ["the thé", "", "zzz the", "a", "mat on the end\nla fin"]
    got = trees.code_lengths(Texts(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        for name, bits in zip(trees.languages, row, strict=True):
            assert bits == pytest.approx(ppm_bits(samples[name], t.encode()), rel=1e-5, abs=1e-5)


def test_languages_of_held_out_rows(spark, given):
    got = queries.op5_language(spark, SF).collect()
    assert len(got) == len(given[0])
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = sum(r.lang_pred == given[0][r.doc_id].lang for r in held)
    assert held and right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    rows = [(1, "der die das und nicht " * 20, "de"), (2, "the of and that it " * 20, "en"), (3, "le la et des que " * 20, None), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "document_id bigint, text string, lang string")
    trees = language.fit_languages(docs)
    assert trees.languages == ["de", "en"]
    got = language.identify_language(with_clashes(documents(spark, AWKWARD)), trees).collect()
    assert len(got) == len(AWKWARD)
    assert {r.lang_pred for r in got if r.document_id in (900, 901, 902)} == {"und"}
    assert language.fit_languages(docs.where("false")) is None
    assert language.identify_language(documents(spark, [(1, "abc")]), None).first().lang_pred == "und"
    assert language.identify_language(documents(spark, []), trees).count() == 0


def test_every_language_and_document_is_learnt_from(spark, monkeypatch):
    rows = [(i, "é" * 5000 if i == 3 else f"short text {i}", "en") for i in range(8)] + [(i, "x" * 3000, "de") for i in range(10, 13)]
    docs = spark.createDataFrame(rows, "document_id bigint, text string, lang string").repartition(3)
    monkeypatch.setattr(language, "build_trees", lambda samples: samples)
    got = language.fit_languages(docs, train_bytes=1000)
    assert {k: len(v) for k, v in got.items()} == {"en": 8, "de": 3}
    assert all(990 <= sum(map(len, v)) <= 1000 for v in got.values()) and {len(x) for x in got["de"]} == {333}
    assert {t.encode() for i, t, lang in rows if lang == "en" and i != 3} < set(got["en"])
    monkeypatch.setattr(language, "TRAIN_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language.fit_languages(docs)


# --- tokens ---------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = AWKWARD + [(i, t) for i, t in enumerate([" lead", "trail ", "a  b", "a \n b", "don't  stop", "x<|endoftext|> y", " <|endoftext|>", "naïve café   x", "\u0085 a", "日本 語", "🙂 🙂", "tab\tq r"])]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public.path(name)
        got = {(r.document_id, r.n_bytes): r for r in token_counts.token_counts(with_clashes(documents(spark, rows)), path, limit=3).collect()}
        if name.endswith(".json"):
            library = Tokenizer.from_file(path)
            count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(library.encode(t))
        for d, t in rows:
            r = got[d, len((t or "").encode())]
            assert (r.n_tokens, r.over_limit) == (count(t or ""), count(t or "") > 3), (name, t)
    assert token_counts.token_counts(documents(spark, []), path).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------


def test_preference_scores_on_held_out_rows(spark, given):
    got = {r.doc_id: r for r in queries.op7_reading_quality(spark, SF).collect()}
    assert len(got) == len(given[0])
    held = [(got[d].score, q) for d, q in given[1].items() if got[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    wins = [a > b for a in good for b in bad]
    assert not wins or sum(wins) >= 0.9 * len(wins)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_preference_model_without_both_classes(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(900, 1), (None, 0), (903, None)], "document_id bigint, quality int")
    for known in (labels, labels.where("false")):
        model = reading_quality.fit_preferences(docs, known)
        got = reading_quality.score_documents(with_clashes(docs), model).collect()
        assert len(got) == len(AWKWARD) and {r.predicted for r in got} == {1}
    kept = reading_quality.keep_good(with_clashes(docs), model)
    assert kept.count() == len(AWKWARD) and kept.columns[:2] == ["document_id", "text"]


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark, given):
    docs, labels = given
    got = queries.op9_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, labels[r.doc_id]) for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.9 * len(judged)


def test_rules_on_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    model = quality_rules.fit_quality_rules(docs, spark.createDataFrame([], "document_id bigint, quality int"))
    got = quality_rules.quality_rules(with_clashes(docs), model).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(brute_counts(t) for _, t in AWKWARD)
    assert quality_rules.quality_rules(documents(spark, []), model).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.2, 0.1], 500)
    n = rng.integers(0, 300, 500)
    rows = [(int(i), int(n[i]), [float(x) for x in p[i]]) for i in range(500)]
    members = spark.createDataFrame(rows, "document_id bigint, n_tokens bigint, posteriors array<double>")
    target = {"a": 0.5, "b": 0.2, "c": 0.3}
    rates, reached = source_mix.fit_rates(members, ["a", "b", "c"], target, ridge=1e-4)
    got = {r.document_id: r.rate for r in rates.collect()}
    assert min(got.values()) >= 0
    share = sum(n[i] * got[i] * p[i] for i in got) / n.sum()
    assert np.abs(share - [0.5, 0.2, 0.3]).max() < 2e-3
    assert all(abs(reached[k] - target[k]) < 2e-3 for k in target)
    # No other rates are closer: the gradient of the same problem by a dense solver vanishes where rates are free.
    u, s = n / n.sum(), (n[:, None] * p).sum(0) / n.sum()
    r = np.array([got[i] for i in range(500)])
    grad = p @ (((u * r) @ p - [0.5, 0.2, 0.3]) / s) + 1e-4 * (r - 1)
    assert np.abs(grad[r > 0]).max() < 5e-3 and grad[r == 0].min(initial=0) > -5e-3


def test_mix_query_and_awkward_rows(spark, given):
    got = queries.op1_source_mix(spark, SF).collect()
    assert len(got) == len(given[0])
    right = sum(r.domain == given[0][r.doc_id].lang for r in got)
    assert right >= 0.95 * len(got)
    total = sum(r.n_tokens for r in got)
    for lang in ("de", "en", "es", "fr"):
        assert abs(sum(r.n_tokens * r.rate for r in got if r.domain == lang) / total - 0.25) < 0.03
    docs = with_clashes(documents(spark, AWKWARD))
    for labelled in (docs.withColumn("domain", F.lit(None).cast("string")), docs.withColumn("domain", F.col("text").substr(1, 1))):
        out = source_mix.mix_sources(docs, labelled).collect()
        assert len(out) == len(AWKWARD) and all(r.rate >= 0 for r in out)
    empty = documents(spark, [])
    assert source_mix.mix_sources(empty, empty.withColumn("domain", F.lit("x"))).count() == 0


def test_rare_domains_are_learnt_and_missing_ones_raise(spark):
    rows = [(i, f"the common words of row {i}", "a") for i in range(3000)] + [(3000 + i, f"zyx wvu {i} qqq", "rare") for i in range(2)]
    docs = spark.createDataFrame(rows, "document_id bigint, text string, domain string").repartition(4)
    model = source_mix.fit_domains(docs, train_rows=40)
    assert model.domains == ["a", "rare"] and np.exp(model.bias) == pytest.approx([3000 / 3002, 2 / 3002])
    with pytest.raises(ValueError, match="gone"):
        source_mix.mix_sources(docs.limit(20), docs, {"a": 1.0, "gone": 1.0})
