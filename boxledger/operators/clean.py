"""Ledger cleaning with a per-cell audit (K-6, K-7).

Cleaning a wide ledger is a projection: the type of each column is known from the wizard, so no
unpivot, join or pivot is needed and the job is a scan. The audit is the same projection
followed by a narrow explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.functions import text
from boxledger.operators.ledger import field_types, ledger_fields


def audit_cells(ledger: DataFrame, types: dict[str, str], compat_ascii_nbsp: bool = False) -> DataFrame:
    """Per (row, field) audit, rectangular."""
    raw = ledger.select(
        "document_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field_id"),
                        F.lit(types.get(f, "any")).alias("field_type"),
                        F.col(f).alias("raw_value"),
                    )
                    for f in ledger_fields(ledger)
                ]
            )
        ),
    )
    sub = raw.withColumn("_sub", text.stage1(F.col("raw_value"), F.col("field_type")))
    out, steps = text.with_steps(sub, "_sub", compat_ascii_nbsp)
    out = out.withColumn("clean_value", steps["final"])
    return out.select(
        "document_id",
        "field_id",
        "field_type",
        "raw_value",
        "clean_value",
        text.change_type(F.col("raw_value"), F.col("_sub"), F.col("clean_value")).alias("change_type"),
        text.reason_codes(F.col("raw_value"), F.col("_sub"), compat_ascii_nbsp, steps).alias("reason_codes"),
    )


def clean_wide(ledger: DataFrame, types: dict[str, str], compat_ascii_nbsp: bool = False) -> DataFrame:
    """The cleaned parallel table; the raw ledger is untouched."""

    def cleaned(f: str):
        t = types.get(f, "any")
        sub = {"numeric": text.stage1_numeric, "text": text.stage1_text}.get(t, text.stage1_any)(F.col(f))
        return text.stage1b(sub, compat_ascii_nbsp).alias(f)

    fields = set(ledger_fields(ledger))
    return ledger.select(*[cleaned(c) if c in fields else F.col(c) for c in ledger.columns])


def clean_ledger(ledger: DataFrame, fields: DataFrame, compat_ascii_nbsp: bool = False) -> tuple[DataFrame, DataFrame]:
    """K-6: (cleaned ledger, cell audit)."""
    types = field_types(fields)
    return clean_wide(ledger, types, compat_ascii_nbsp), audit_cells(ledger, types, compat_ascii_nbsp)


def change_counts(audit: DataFrame) -> DataFrame:
    """K-7: cells per change type, zeros present."""
    counts = audit.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = audit.sparkSession.createDataFrame([(k,) for k in text.CHANGE_TYPES], "change_type string")
    return kinds.join(counts, "change_type", "left").select("change_type", F.coalesce("n", F.lit(0)).alias("n"))


def change_summary(audit: DataFrame) -> DataFrame:
    """K-7: touched and total cells with the declared type per column."""
    return audit.groupBy("field_id", "field_type").agg(
        F.count_if(F.col("change_type") != "unchanged").alias("touched"), F.count(F.lit(1)).alias("total")
    )
