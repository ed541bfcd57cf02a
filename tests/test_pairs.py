from boxledger.operators import refine as RF

RECT = "struct<x:double,y:double,w:double,h:double>"


def test_pages_of_a_template_are_counted_where_they_lie(spark, monkeypatch):
    """Also where a template's pages are dealt over several tasks; the pairs themselves are dealt by template."""
    ids = [f"o{i}" for i in range(4)]
    rows = [(d, d // 6, 0, o, (0.1 * i, 0.1, 0.2, 0.2)) for d in range(12) for i, o in enumerate(ids)]
    ev = spark.createDataFrame(rows, f"doc_id int, template_id int, page_index int, config_id string, r {RECT}")
    for together in (RF.PAGES_TOGETHER, 2):
        monkeypatch.setattr(RF, "PAGES_TOGETHER", together)
        pairs = RF.pair_evidence(ev)
        got = RF.pair_stats(pairs).collect()
        assert len(got) == 2 * 12 and {r.co_occurrence for r in got} == {6}
        assert "RepartitionByExpression [template_id" in pairs._jdf.queryExecution().optimizedPlan().toString()
