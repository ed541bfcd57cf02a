"""The corpus pipeline against the same stages in plain Python."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from boxledger.llm import queries, source_mix
from boxledger.llm.textarrays import Texts
from tests.llm.test_joins import brute_components, brute_dedup, brute_windows

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in queries.op7_reading_quality(spark, SF).collect() if r.predicted}
    rows = [(d, r.text) for d, r in docs.items() if d in good]
    rows = [(d, t) for d, _, _, t in brute_dedup(rows)]
    label = brute_components(rows, 5, 80)
    rows = [(d, t) for d, t in rows if label[d] == d]
    found = {d for d, _ in brute_windows(rows, items)}
    rows = dict(x for x in rows if x[0] not in found)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: r.text for d, r in got.items()} == rows
    assert all(r.rate > 0 and r.lang == docs[d].lang and r.source == docs[d].source for d, r in got.items())
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "mix"]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_mix_keeps_documents_of_rate_zero_and_without_id(spark, monkeypatch):
    """Weak posteriors of a rare language push the others to rate 0; they stay, and the missed targets show."""
    chances = {"aaaa": [0.98, 0.01, 0.01], "bbbb": [0.01, 0.98, 0.01], "cccc": [0.4, 0.3, 0.3]}
    weights = np.zeros((source_mix.BUCKETS, 3))
    for text, p in chances.items():
        weights[source_mix.gram_buckets(Texts(pa.array([text])))[0]] = np.log(p)
    monkeypatch.setattr(source_mix, "fit_domains", lambda labelled: source_mix.DomainModel(["a", "b", "c"], weights, np.zeros(3)))
    rows = [(i, t, t[0], "s", 4) for i, t in enumerate(["aaaa"] * 70 + ["bbbb"] * 30 + ["cccc"])] + [(None, "aaaa", "a", "s", 4), (500, None, "b", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    assert sorted((str(tuple(r)[:5]) for r in got)) == sorted(str(r) for r in rows)
    assert any(r.rate == 0 for r in got)
    assert all(r.largest_gap > 0.02 and abs(r.target_share - 1 / 3) < 1e-6 for r in got)


def test_stages_take_repeated_rows_and_clashing_names(spark, tmp_path):
    """Extra columns whose names the operators use, rows given twice, null ids and texts: every stage writes its result."""
    names = ["document_id", "kept", "kept_columns", "_rest", "_found", "class_id", "component_id", "rate", "domain", "n_tokens", "largest_gap", "n_lines", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    plain = plain.unionByName(docs.limit(1).selectExpr("900000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    docs = plain.selectExpr("*", *[f"concat('extra ', doc_id) AS {n}" for n in names])
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= given
        if name != "mix":
            assert docs.columns == columns
    rows = docs.collect()
    assert docs.columns == [c for c in columns if c not in corpus_pipeline.MIXED] + corpus_pipeline.MIXED
    assert all(r.document_id == (None if r.doc_id is None else f"extra {r.doc_id}") for r in rows)
