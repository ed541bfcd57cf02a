"""Queries for readings, ledger and cleaning (R-*, L-*, K-*, S-5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from boxledger import fixtures
from boxledger.catalog.registry import add, fx, rnd
from boxledger.catalog.sqlkit import clamp01, clean_steps, d, lit, r6, re_replace
from boxledger.functions import rect, text
from boxledger.operators import clean, ledger, readings

ORDER = ["cust_name", "total", "order_date", "priority"]
R, FLD = fx("fx_readings"), fx("fx_fields")


# ------------------------------------------------------------------ ledger
def _batch(spark, sf, n):
    return ledger.batch_rows(R(spark, sf).where(F.col("batch") == n), ORDER, n)


def _seeded(spark, sf):
    return ledger.upsert_ledger(ledger.seed_ledger(spark, FLD(spark, sf)), _batch(spark, sf, 1), ORDER)


def _full(spark, sf):
    return ledger.upsert_ledger(_seeded(spark, sf), _batch(spark, sf, 2), ORDER)


_ROWS_SQL = """
last_res AS (SELECT batch, document_id, max(result_ord) AS result_ord, min(result_ord) AS row_ord,
  count(DISTINCT result_ord) AS n_results FROM fx_readings GROUP BY batch, document_id),
cells AS (SELECT r.batch, r.document_id, r.field_id, CASE WHEN status = 'ok' THEN text ELSE '' END AS v,
  row_number() OVER (PARTITION BY r.batch, r.document_id, r.field_id ORDER BY ord DESC) AS rn
  FROM fx_readings r JOIN last_res l ON r.batch = l.batch AND r.document_id = l.document_id AND r.result_ord = l.result_ord),
meta AS (SELECT DISTINCT r.batch, r.document_id, r.source_name, r.extracted_at_iso, l.row_ord, l.n_results
  FROM fx_readings r JOIN last_res l ON r.batch = l.batch AND r.document_id = l.document_id AND r.result_ord = l.result_ord),
rows_b AS (SELECT m.batch, m.document_id, m.source_name, m.extracted_at_iso, m.row_ord, m.n_results,
  coalesce(max(v) FILTER (WHERE field_id = 'cust_name'), '') AS cust_name,
  coalesce(max(v) FILTER (WHERE field_id = 'total'), '') AS total,
  coalesce(max(v) FILTER (WHERE field_id = 'order_date'), '') AS order_date,
  coalesce(max(v) FILTER (WHERE field_id = 'priority'), '') AS priority
  FROM meta m LEFT JOIN cells c ON m.batch = c.batch AND m.document_id = c.document_id AND c.rn = 1
  GROUP BY 1, 2, 3, 4, 5, 6)"""
_LEDGER_SQL = (
    _ROWS_SQL
    + """,
ledger AS (
  SELECT n.document_id, n.source_name, n.extracted_at_iso, n.cust_name, n.total, n.order_date, n.priority,
    CASE WHEN o.document_id IS NULL THEN 2 ELSE 1 END AS row_batch, coalesce(o.row_ord, n.row_ord) AS row_ord
  FROM rows_b n LEFT JOIN rows_b o ON o.batch = 1 AND o.document_id = n.document_id WHERE n.batch = 2
  UNION ALL
  SELECT document_id, source_name, extracted_at_iso, cust_name, total, order_date, priority, 1, row_ord FROM rows_b b1
  WHERE batch = 1 AND NOT EXISTS (SELECT 1 FROM rows_b b2 WHERE b2.batch = 2 AND b2.document_id = b1.document_id)),
long AS (
  SELECT document_id, 'cust_name' AS field_id, 'text' AS field_type, cust_name AS value FROM ledger
  UNION ALL SELECT document_id, 'total', 'numeric', total FROM ledger
  UNION ALL SELECT document_id, 'order_date', 'text', order_date FROM ledger
  UNION ALL SELECT document_id, 'priority', 'any', priority FROM ledger)"""
)
_AUDIT_SQL = (
    _LEDGER_SQL
    + f""",
staged AS (SELECT document_id, field_id, field_type, value AS raw_value, CASE field_type
   WHEN 'numeric' THEN translate(value, {lit(text.NUMERIC_FROM)}, {lit(text.NUMERIC_TO)})
   WHEN 'text' THEN translate(value, {lit(text.TEXT_FROM)}, {lit(text.TEXT_TO)}) ELSE value END AS sub FROM long),
{clean_steps("staged", "sub", "")},
audit AS (SELECT document_id, field_id, field_type, raw_value, s_final AS clean_value,
  CASE WHEN raw_value <> sub AND sub <> s_final THEN 'stage-1-and-1b' WHEN raw_value <> sub THEN 'stage-1'
       WHEN sub <> s_final THEN 'stage-1b' ELSE 'unchanged' END AS change_type,
  concat_ws(',', CASE WHEN raw_value <> sub THEN 'stage-1-substituted' END, CASE WHEN sub <> s_nbsp THEN 'replaced-nbsp' END,
    CASE WHEN s_zero <> s_nbsp THEN 'stripped-zero-width' END, CASE WHEN s_multi <> s_zero THEN 'collapsed-multi-space' END,
    CASE WHEN s_trim <> s_multi THEN 'trimmed-whitespace' END, CASE WHEN s_lead <> s_trim THEN 'stripped-leading-edge-junk' END,
    CASE WHEN s_trail <> s_lead THEN 'stripped-trailing-edge-junk' END,
    CASE WHEN s_trim = s_multi AND s_final <> s_trail THEN 'trimmed-whitespace' END) AS reason_codes FROM k8)"""
)
_FXR = ("fx_readings",)

add(
    "L1_reconcile_order",
    lambda s, sf: s.createDataFrame(
        list(enumerate(ledger.reconcile_order(["total", "legacy_note"], ledger.field_list(FLD(s, sf))))),
        "pos int, field_id string",
    ).join(R(s, sf).groupBy("field_id").agg(F.count(F.lit(1)).alias("n_readings")), "field_id", "left")
    .select("pos", "field_id", F.coalesce("n_readings", F.lit(0)).alias("n_readings")),
    """SELECT p.pos, p.field_id, count(r.field_id) AS n_readings FROM (VALUES (0, 'total'), (1, 'legacy_note'), (2, 'cust_name'),
       (3, 'order_date'), (4, 'priority')) AS p(pos, field_id) LEFT JOIN fx_readings r ON r.field_id = p.field_id GROUP BY 1, 2""",
    _FXR,
)
add(
    "L2_readings_to_rows",
    lambda s, sf: _batch(s, sf, 1).unionByName(_batch(s, sf, 2)).drop("row_batch", "n_results"),
    f"WITH {_ROWS_SQL} SELECT document_id, source_name, extracted_at_iso, cust_name, total, order_date, priority, row_ord FROM rows_b",
    _FXR,
)
add(
    "L3_upsert_ledger",
    lambda s, sf: _full(s, sf),
    f"WITH {_LEDGER_SQL} SELECT * FROM ledger",
    _FXR,
)
add(
    "L4_upsert_outcome",
    lambda s, sf: ledger.upsert_outcome(_seeded(s, sf), _batch(s, sf, 2)),
    f"""WITH {_ROWS_SQL} SELECT n.document_id, k.outcome FROM rows_b n LEFT JOIN rows_b o ON o.batch = 1 AND o.document_id = n.document_id
    JOIN (VALUES ('appended'), ('replaced')) AS k(outcome) ON (k.outcome = 'appended' AND o.document_id IS NULL)
      OR (k.outcome = 'replaced' AND (o.document_id IS NOT NULL OR n.n_results > 1)) WHERE n.batch = 2""",
    _FXR,
)


def _sources(s, sf):
    o = fixtures.table(s, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("art-"), "o_orderkey")).otherwise("").alias("artifact_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("fp-"), "o_custkey")).otherwise("").alias("fingerprint"),
        F.concat(F.lit("res-"), "o_orderkey").alias("result_id"),
    )


add(
    "L5_document_key",
    lambda s, sf: _sources(s, sf).select(
        "result_id",
        ledger.document_key(F.col("artifact_id"), F.col("fingerprint"), F.col("result_id")).alias("document_id"),
        ledger.source_name(F.col("artifact_id"), F.col("fingerprint"), F.col("result_id")).alias("source_name"),
    ),
    """SELECT concat('res-', o_orderkey) AS result_id,
      CASE WHEN o_orderstatus = 'F' THEN concat('art-', o_orderkey) WHEN o_orderpriority <> '5-LOW' THEN concat('fp-', o_custkey)
        ELSE concat('res-', o_orderkey) END AS document_id,
      CASE WHEN o_orderpriority <> '5-LOW' THEN concat('fp-', o_custkey) WHEN o_orderstatus = 'F' THEN concat('art-', o_orderkey)
        ELSE concat('res-', o_orderkey) END AS source_name FROM orders""",
)
add(
    "L6_seed_ledger",
    lambda s, sf: ledger.upsert_ledger(
        ledger.upsert_ledger(ledger.seed_ledger(s, FLD(s, sf)), _batch(s, sf, 1), ORDER), _batch(s, sf, 2), ORDER
    ).groupBy("extracted_at_iso").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("order_date") == "").alias("n_blank")),
    f"WITH {_LEDGER_SQL} SELECT extracted_at_iso, count(*) AS n_rows, count_if(order_date = '') AS n_blank FROM ledger GROUP BY 1",
    _FXR,
)


def _edits(s, sf):
    """Reviewer edits: the total of urgent orders twice (the later one counts), the name of failed ones."""
    o = fixtures.table(s, sf, "orders")
    doc = F.concat(F.lit("doc-"), "o_orderkey").alias("document_id")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT")
    first = urgent.select(doc, F.lit("total").alias("field_id"), F.lit("0").alias("value"), F.lit(1).alias("ord"))
    second = urgent.select(doc, F.lit("total"), F.col("o_custkey").cast("string"), F.lit(2))
    third = o.where(F.col("o_orderstatus") == "P").select(doc, F.lit("cust_name"), F.lit("checked"), F.lit(1))
    return first.union(second).union(third)


add(
    "L7_apply_edits",
    lambda s, sf: ledger.apply_edits(_full(s, sf), _edits(s, sf)),
    f"""WITH {_LEDGER_SQL} SELECT l.document_id, source_name, extracted_at_iso,
      CASE WHEN o_orderstatus = 'P' THEN 'checked' ELSE cust_name END AS cust_name,
      CASE WHEN o_orderpriority = '1-URGENT' THEN concat('', o_custkey) ELSE total END AS total, order_date, priority, row_batch, row_ord
    FROM ledger l JOIN orders ON l.document_id = concat('doc-', o_orderkey)""",
    _FXR,
)
add(
    "L8_to_long",
    lambda s, sf: ledger.to_long(_full(s, sf)),
    f"WITH {_LEDGER_SQL} SELECT document_id, field_id, value FROM long",
    _FXR,
)
add(
    "L8_to_wide",
    lambda s, sf: ledger.to_wide(ledger.to_long(_full(s, sf)), ORDER),
    f"WITH {_LEDGER_SQL} SELECT document_id, cust_name, total, order_date, priority FROM ledger",
    _FXR,
)


# ------------------------------------------------------------------ cleaning
def _doc_text(s, sf):
    return fixtures.table(s, sf, "documents").select("doc_id", "text")


def _digest(c):
    return F.sha2(c, 256)


add(
    "K1_stage1_numeric",
    lambda s, sf: _doc_text(s, sf).select("doc_id", _digest(text.stage1_numeric(F.col("text"))).alias("digest")),
    f"SELECT doc_id, sha256(translate(text, {lit(text.NUMERIC_FROM)}, {lit(text.NUMERIC_TO)})) AS digest FROM documents",
)
add(
    "K2_stage1_text",
    lambda s, sf: _doc_text(s, sf).select(
        "doc_id",
        _digest(text.stage1_text(F.col("text"))).alias("digest"),
        _digest(text.stage1_any(F.col("text"))).alias("digest_any"),
    ),
    f"SELECT doc_id, sha256(translate(text, {lit(text.TEXT_FROM)}, {lit(text.TEXT_TO)})) AS digest, sha256(text) AS digest_any FROM documents",
)
add(
    "K3_stage1b",
    lambda s, sf: _doc_text(s, sf).select("doc_id", _digest(text.stage1b(F.col("text"))).alias("digest")),
    f"WITH src AS (SELECT doc_id, text FROM documents), {clean_steps('src', 'text', '')} SELECT doc_id, sha256(s_final) AS digest FROM k8",
)


def _audit(s, sf):
    return clean.clean_ledger(_full(s, sf), FLD(s, sf))[1]


add(
    "K4_reason_codes",
    lambda s, sf: _audit(s, sf).groupBy(F.array_join("reason_codes", ",").alias("reason_codes")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_AUDIT_SQL} SELECT reason_codes, count(*) AS n FROM audit GROUP BY 1",
    _FXR,
)
add(
    "K5_change_type",
    lambda s, sf: _audit(s, sf).select("document_id", "field_id", "change_type"),
    f"WITH {_AUDIT_SQL} SELECT document_id, field_id, change_type FROM audit",
    _FXR,
)
add(
    "K6_clean_ledger",
    lambda s, sf: clean.clean_ledger(_full(s, sf), FLD(s, sf))[0],
    f"""WITH {_AUDIT_SQL} SELECT a.document_id, l.source_name, l.extracted_at_iso, l.row_batch, l.row_ord,
      max(clean_value) FILTER (WHERE field_id = 'cust_name') AS cust_name, max(clean_value) FILTER (WHERE field_id = 'total') AS total,
      max(clean_value) FILTER (WHERE field_id = 'order_date') AS order_date, max(clean_value) FILTER (WHERE field_id = 'priority') AS priority
    FROM audit a JOIN ledger l ON a.document_id = l.document_id GROUP BY 1, 2, 3, 4, 5""",
    _FXR,
)
add(
    "K6_cell_audit",
    lambda s, sf: _audit(s, sf).withColumn("reason_codes", F.array_join("reason_codes", ",")),
    f"WITH {_AUDIT_SQL} SELECT * FROM audit",
    _FXR,
)
add(
    "K7_change_counts",
    lambda s, sf: clean.change_counts(_audit(s, sf)),
    f"""WITH {_AUDIT_SQL} SELECT k.change_type, count(a.change_type) AS n FROM (VALUES ('unchanged'), ('stage-1'), ('stage-1b'), ('stage-1-and-1b'))
      AS k(change_type) LEFT JOIN audit a ON a.change_type = k.change_type GROUP BY 1""",
    _FXR,
)
add(
    "K7_change_summary",
    lambda s, sf: clean.change_summary(_audit(s, sf)),
    f"WITH {_AUDIT_SQL} SELECT field_id, field_type, count_if(change_type <> 'unchanged') AS touched, count(*) AS total FROM audit GROUP BY 1, 2",
    _FXR,
)

# ------------------------------------------------------------------ readings
# Boxes of three fields per customer; the third sits on a page that some documents lack.
_REQ_SQL = """
SELECT c.c_custkey AS doc_id, concat('f', n) AS field_id, CASE WHEN n = 3 AND c_nationkey < 5 THEN 2 ELSE n % 2 END AS page_index,
  CAST(50 + n * 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS x, CAST(c_nationkey * 40 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y,
  CASE WHEN c_nationkey = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(90 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS w,
  CAST(30 AS DOUBLE) / CAST(1000 AS DOUBLE) AS h, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat('fp-', c_custkey) END AS fingerprint,
  concat('pred-', c_custkey) AS artifact_id
FROM {customer} c JOIN (VALUES (1), (2), (3)) AS t(n) ON n > 0"""
_REC_SQL = """
SELECT c_custkey AS doc_id, concat('f', n) AS field_id, CASE n WHEN 1 THEN concat('  ', c_name, chr(13), chr(10), ' ', chr(10), c_mktsegment, '  x ')
  WHEN 2 THEN CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END ELSE concat(chr(9), c_name) END AS raw_text,
  CAST(50 + c_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE WHEN c_mktsegment = 'MACHINERY' AND n = 2 THEN 'recogniser failed' END AS error
FROM {customer} JOIN (VALUES (1), (2), (3)) AS t(n) ON n > 0"""
fixtures.SQL["fx_requests"] = _REQ_SQL
fixtures.SQL["fx_recognised"] = _REC_SQL


def _fallback(s, sf):
    from boxledger.sources.identity import first_page_fingerprint

    return first_page_fingerprint(fx("fx_surfaces")(s, sf))


def _requests(s, sf):
    boxes = fx("fx_requests")(s, sf).withColumn("bbox", rect.pack()).drop("x", "y", "w", "h")
    return readings.field_requests(boxes, "predicted-geometry-file", "artifact_id", "fingerprint", _fallback(s, sf))


def _attached(s, sf):
    return readings.attach_readings(_requests(s, sf), fx("fx_surfaces")(s, sf), fx("fx_recognised")(s, sf))


_PAD = f"""p AS (SELECT q.doc_id, q.field_id, q.page_index, q.x, q.y, q.w, q.h, s.width, s.height, r.confidence, r.error, raw_text,
   {clamp01("q.x - " + d(0.004))} AS px, {clamp01("q.y - " + d(0.004))} AS py,
   greatest({d(0.0)}, {clamp01("q.x + q.w + " + d(0.004))} - {clamp01("q.x - " + d(0.004))}) AS pw,
   greatest({d(0.0)}, {clamp01("q.y + q.h + " + d(0.004))} - {clamp01("q.y - " + d(0.004))}) AS ph
  FROM fx_requests q LEFT JOIN fx_surfaces s ON q.doc_id = s.doc_id AND q.page_index = s.page_index
  LEFT JOIN fx_recognised r ON q.doc_id = r.doc_id AND q.field_id = r.field_id)"""
_TIDY = (
    "array_to_string(list_filter(list_transform(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: "
    + re_replace(re_replace("l", f"[{text.SPACE}]+", " "), "^ | $", "")
    + "), lambda l: l <> ''), chr(10))"
)
_ATT = (
    _PAD
    + f""",
t AS (SELECT *, {_TIDY.replace("{c}", "coalesce(raw_text, '')")} AS tidy,
  CASE WHEN width IS NULL THEN 'nopage' WHEN pw * width <= 0.5 OR ph * height <= 0.5 THEN 'nocrop' WHEN error IS NOT NULL THEN 'failed' ELSE 'read' END AS st
  FROM p)"""
)
_FXQ = ("fx_requests", "fx_surfaces", "fx_recognised")

add(
    "R1_field_requests",
    lambda s, sf: _requests(s, sf).drop("bbox"),
    """SELECT q.doc_id, field_id, page_index, 'predicted-geometry-file' AS bbox_source, artifact_id AS source_artifact_id,
      CASE WHEN fingerprint = '' THEN concat('surface:scan ', q.doc_id, '.pdf#0:1000x1000') ELSE fingerprint END AS fingerprint FROM fx_requests q""",
    ("fx_requests",),
)
add(
    "R2_attach_readings",
    lambda s, sf: _attached(s, sf).select(
        "doc_id", "field_id", "text", rnd("confidence").alias("confidence"), "status", "error_message",
        rnd("bbox_used.w").alias("used_w"), rnd("bbox_used.h").alias("used_h"),
    ),
    f"""WITH {_ATT} SELECT doc_id, field_id, CASE WHEN st = 'read' THEN tidy ELSE '' END AS text,
      {r6("CASE WHEN st = 'read' THEN confidence ELSE " + d(0.0) + " END", "confidence")},
      CASE WHEN st IN ('nopage', 'failed') THEN 'error' WHEN st = 'read' AND tidy <> '' THEN 'ok' ELSE 'empty' END AS status,
      CASE WHEN st = 'nopage' THEN concat('No NormalizedPage for pageIndex ', page_index, '.') WHEN st = 'failed' THEN error END AS error_message,
      {r6("CASE WHEN st IN ('nopage', 'nocrop') THEN w ELSE pw END", "used_w")}, {r6("CASE WHEN st IN ('nopage', 'nocrop') THEN h ELSE ph END", "used_h")} FROM t""",
    _FXQ,
)
add(
    "R3_tidy_text",
    lambda s, sf: _doc_text(s, sf).select("doc_id", _digest(text.tidy_text(F.col("text"))).alias("digest")),
    f"SELECT doc_id, sha256({_TIDY.replace("{c}", 'text')}) AS digest FROM documents",
)
add(
    "R4_norm_confidence",
    lambda s, sf: fixtures.table(s, sf, "customer").select(
        "c_custkey", rnd(text.norm_confidence(F.col("c_acctbal"))).alias("confidence")
    ),
    f"SELECT c_custkey, {r6(clamp01('c_acctbal / ' + d(100.0)), 'confidence')} FROM customer",
)


def _reader_query(s, sf):
    """A user hook that reads the text from the box id; stands for any recogniser."""
    @F.pandas_udf("raw_text string, confidence double, error string")
    def reader(box: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "raw_text": box["field_id"] + " of " + box["doc_id"].astype(str),
                "confidence": box["page_index"].astype(float) * 60.0,
                "error": None,
            }
        )

    return readings.with_reader(_requests(s, sf), reader)


add(
    "R5_with_reader",
    _reader_query,
    """SELECT doc_id, field_id, concat(field_id, ' of ', doc_id) AS raw_text, least(CAST(1 AS DOUBLE), page_index * CAST(0.6 AS DOUBLE)) AS confidence,
       CAST(NULL AS VARCHAR) AS error FROM fx_requests""",
    ("fx_requests",),
)


def _labels(s, sf):
    return s.createDataFrame([("f1", "Customer"), ("f2", "Segment")], "field_id string, label string")


add(
    "R6_readings_report",
    lambda s, sf: readings.readings_report(_attached(s, sf), _labels(s, sf)),
    f"""WITH {_ATT} SELECT doc_id, field_id, CASE field_id WHEN 'f1' THEN 'Customer' WHEN 'f2' THEN 'Segment' ELSE field_id END AS label,
      page_index + 1 AS page, format('{{:.2f}}', CASE WHEN st = 'read' THEN confidence ELSE {d(0.0)} END) AS confidence,
      CASE WHEN st IN ('nopage', 'failed') THEN 'error' WHEN st = 'read' AND tidy <> '' THEN 'ok' ELSE 'empty' END AS status,
      CASE WHEN st = 'read' THEN tidy ELSE '' END AS text FROM t""",
    _FXQ,
)
add(
    "S5_artifact_name",
    lambda s, sf: fixtures.table(s, sf, "documents").select(
        "doc_id",
        text.artifact_name(F.col("text"), "structural").alias("id_name"),
        _digest(text.artifact_name(F.col("text"), "masterdb")).alias("wizard_name"),
    ),
    f"""SELECT doc_id, concat(substring(lower({re_replace("CASE WHEN text = '' THEN 'document' ELSE text END", "[^A-Za-z0-9-]+", "-")}), 1, 48), '.structural.json') AS id_name,
      sha256(concat(lower({re_replace("CASE WHEN text = '' THEN 'wizard' ELSE text END", f"[{text.SPACE}]+", "-")}), '.masterdb.csv')) AS wizard_name FROM documents""",
)
