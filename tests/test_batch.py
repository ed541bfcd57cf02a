"""Whole batches: every document ends in the ledger or among the failures."""

from dataclasses import replace

from pyspark.sql import functions as F

from boxledger.catalog import runs
from boxledger.operators import ledger as LG
from boxledger.plans import batch as B

SF = "/root/testdata/sf0.001"


def test_no_document_vanishes(spark):
    batch = runs.batch_input(spark, SF)
    ids = sorted(r.doc_id for r in batch.documents.select("doc_id").collect())
    empty, stray = [d for d in ids if d % 25 != 9][:2]
    batch = replace(
        batch,
        objects=batch.objects.where(F.col("doc_id") != empty),
        documents=batch.documents.withColumn("template_id", F.when(F.col("doc_id") == stray, F.lit(-1)).otherwise(F.col("template_id"))),
    )
    result = B.run_batch(runs.template(spark, SF), batch, spark.createDataFrame([], LG.ledger_schema(runs.FIELD_ORDER)), runs.FIELD_ORDER, 1, runs.NOW)
    kept = {int(r.document_id.removeprefix("doc-")) for r in result.ledger.select("document_id").collect()}
    lost = {r.doc_id: r.reason for r in result.failures.collect()}
    assert kept | set(lost) == set(ids) and not kept & set(lost)
    assert empty in kept and lost[stray] == "no template"
    assert {r["tier"] for r in result.predicted.where(F.col("doc_id") == empty).collect()} <= {"refined-border", "border"}
    assert result.counts().first().n_failed == len(lost)
