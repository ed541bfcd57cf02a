"""Ledger tables keyed by document (L-1..L-8).

A wide ledger has ``document_id, source_name, extracted_at_iso``, one string column per field
and the position columns ``row_batch, row_ord`` (the order of first appearance). Positions are
pairs, so appending never needs a global numbering over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FIXED = ["document_id", "source_name", "extracted_at_iso"]
POSITION = ["row_batch", "row_ord"]


def field_list(fields: DataFrame) -> list[str]:
    """Field ids in wizard order; a wizard is a form definition, so the list is short."""
    return [r.field_id for r in fields.select("field_id", "ord").orderBy("ord").collect()]


def field_types(fields: DataFrame) -> dict[str, str]:
    return {r.field_id: r.field_type for r in fields.select("field_id", "field_type").collect()}


def ledger_fields(ledger: DataFrame) -> list[str]:
    return [c for c in ledger.columns if c not in FIXED + POSITION]


def reconcile_order(existing: list[str], wizard: list[str]) -> list[str]:
    """L-1: existing order first, then wizard fields it lacks; nothing is reordered."""
    return existing + [f for f in wizard if f not in existing]


def document_key(artifact_id: Column, fingerprint: Column, result_id: Column) -> Column:
    """L-5: first non-empty of artifact, fingerprint, result."""
    return F.coalesce(F.nullif(artifact_id, F.lit("")), F.nullif(fingerprint, F.lit("")), result_id)


def source_name(artifact_id: Column, fingerprint: Column, result_id: Column) -> Column:
    """L-5: first non-empty of fingerprint, artifact, result."""
    return F.coalesce(F.nullif(fingerprint, F.lit("")), F.nullif(artifact_id, F.lit("")), result_id)


def batch_rows(readings: DataFrame, order: list[str], batch_no: int) -> DataFrame:
    """L-2: one row per document of one batch, ready for :func:`upsert_ledger`.

    Within a result the last reading of a field wins; a document repeated in the batch keeps only
    its last result; failed and empty readings write ''.

    ``readings``: document_id, source_name, extracted_at_iso, result_ord, ord, field_id, text, status.
    The newest result of a document is found inside the same aggregate that builds the row, by
    ordering every cell on (result, position) and blanking cells of older results: no pivot
    pre-pass, no sort, and a document with very many readings is combined before the shuffle.
    """
    value = F.when(F.col("status") == "ok", F.col("text")).otherwise(F.lit(""))
    aggs = [
        F.max_by(F.struct("source_name", "extracted_at_iso"), F.struct("result_ord", "ord")).alias("_meta"),
        F.max("result_ord").alias("_last"),
        F.min("result_ord").alias("row_ord"),
        F.count_distinct("result_ord").alias("n_results"),
    ]
    for f in order:
        mine = F.col("field_id") == f
        stamp = F.struct("result_ord", "ord", value.alias("v"))
        aggs.append(F.max(F.when(mine, stamp)).alias(f"_c_{f}"))
    rows = readings.groupBy("document_id").agg(*aggs)
    cells = [
        F.when(F.col(f"_c_{f}.result_ord") == F.col("_last"), F.col(f"_c_{f}.v")).otherwise(F.lit("")).alias(f)
        for f in order
    ]
    return rows.select(
        "document_id",
        "_meta.source_name",
        "_meta.extracted_at_iso",
        *cells,
        F.lit(batch_no).alias("row_batch"),
        F.col("row_ord").cast("long").alias("row_ord"),
        F.col("n_results").cast("long").alias("n_results"),
    )


def upsert_ledger(ledger: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """L-3: rows replace whole existing rows in place, new documents are appended.

    One full outer join on the document key gives kept, replaced and new rows, so both sides are computed once.
    """
    old_cols = ledger_fields(ledger)
    old = ledger.select("document_id", F.struct(*FIXED, *[F.col(f) if f in old_cols else F.lit("").alias(f) for f in order], *POSITION).alias("_old"))
    new = rows.select("document_id", F.struct(*FIXED, *order, *POSITION).alias("_new"))
    both = old.join(new, "document_id", "full")
    replaced = F.col("_new").isNotNull()
    return both.select(
        *[F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in [*FIXED, *order]],
        *[F.coalesce(f"_old.{c}", f"_new.{c}").alias(c) for c in POSITION],
    )


def upsert_outcome(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """L-4: (document_id, outcome). A new document repeated inside the batch is both appended and replaced."""
    known = ledger.select("document_id", F.lit(True).alias("_known"))
    marks = rows.select("document_id", "n_results").join(known, "document_id", "left")
    new = F.col("_known").isNull()
    outcomes = F.array_compact(
        F.array(F.when(new, F.lit("appended")), F.when(~new | (F.col("n_results") > 1), F.lit("replaced")))
    )
    return marks.select("document_id", F.explode(outcomes).alias("outcome"))


def ledger_schema(order: list[str]) -> T.StructType:
    cols = [T.StructField(c, T.StringType()) for c in FIXED + order]
    return T.StructType(cols + [T.StructField("row_batch", T.IntegerType()), T.StructField("row_ord", T.LongType())])


def seed_ledger(spark: SparkSession, fields: DataFrame) -> DataFrame:
    """L-6: empty ledger with the wizard's columns."""
    return spark.createDataFrame([], ledger_schema(field_list(fields)))


def apply_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """L-7: cell edits ``(document_id, field_id, value)``; the last edit of a cell (by ``ord``) wins."""
    order = ledger_fields(ledger)
    cells = [
        F.max_by(F.when(F.col("field_id") == f, F.col("value")), F.when(F.col("field_id") == f, F.col("ord"))).alias(
            f"_e_{f}"
        )
        for f in order
    ]
    per_doc = edits.groupBy("document_id").agg(*cells)
    joined = ledger.join(per_doc, "document_id", "left")
    new = {f: F.coalesce(F.col(f"_e_{f}"), F.col(f)).alias(f) for f in order}
    return joined.select(*[new.get(c, F.col(c)) for c in ledger.columns])


def to_long(ledger: DataFrame) -> DataFrame:
    """L-8: (document_id, field_id, value); a narrow unpivot without shuffle."""
    cells = [F.struct(F.lit(f).alias("field_id"), F.col(f).alias("value")) for f in ledger_fields(ledger)]
    return ledger.select("document_id", F.inline(F.array(*cells)))


def to_wide(long: DataFrame, order: list[str]) -> DataFrame:
    """L-8: one column per field, missing cells ''."""
    cells = [F.coalesce(F.max(F.when(F.col("field_id") == f, F.col("value"))), F.lit("")).alias(f) for f in order]
    return long.groupBy("document_id").agg(*cells)
