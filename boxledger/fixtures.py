"""Derived input tables.

Each fixture is one SQL text that both Spark and DuckDB run over the given tables, so every
operator can be checked at every scale. Fixtures use whole tables: row counts grow with the data.
Coordinates are integers on a 1000 x 1000 surface divided by 1000.

A supplier stands for a form issuer (template). The tables grow together, 20 parts and 15
customers per supplier: twenty consecutive parts are the objects of its form page, fifteen
consecutive customers are filled-in documents of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxledger.session import real_sizes

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _norm(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST(1000 AS DOUBLE)"


SQL: dict[str, str] = {}

SQL["fx_fields"] = """
SELECT field_id, ord, field_type, required, label FROM (VALUES
 ('cust_name', 1, 'text', true, 'Customer'), ('total', 2, 'numeric', true, 'Total'),
 ('order_date', 3, 'text', false, 'Date'), ('priority', 4, 'any', false, 'Priority'))
 AS t(field_id, ord, field_type, required, label)
"""

# Dirty readings, one result per order and batch; some orders are read again in batch 2, and
# urgent orders carry a second reading of the same field in their result.
SQL["fx_readings"] = """
WITH o AS (
 SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, c_name,
  concat('', CAST(floor(o_totalprice) AS BIGINT)) AS amount,
  CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS batch
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey),
r AS (
 SELECT o_orderkey, batch, 1 AS result_no, 1 AS pos, 'cust_name' AS field_id, CASE o_orderkey % 4
   WHEN 0 THEN concat('"', c_name) WHEN 1 THEN concat('  ', c_name, ' |')
   WHEN 2 THEN replace(c_name, '#', '  ') ELSE c_name END AS text, 'ok' AS status FROM o
 UNION ALL
 SELECT o_orderkey, batch, 1, 2, 'total', CASE o_orderkey % 3
   WHEN 0 THEN concat('| ', replace(amount, '0', 'O')) WHEN 1 THEN concat(amount, ',')
   ELSE replace(amount, '1', 'l') END, CASE WHEN amount < '12' THEN 'error' ELSE 'ok' END FROM o
 UNION ALL
 SELECT o_orderkey, batch, 1, 3, 'priority', CASE WHEN o_orderkey % 11 = 0 THEN ''
   WHEN o_orderkey % 5 = 0 THEN concat(o_orderpriority, ' (') ELSE o_orderpriority END,
   CASE WHEN o_orderkey % 11 = 0 THEN 'empty' ELSE 'ok' END FROM o
 UNION ALL
 SELECT o_orderkey, batch, 1, 4, 'total', '7O7', 'ok' FROM o WHERE o_orderpriority = '1-URGENT'
 UNION ALL
 SELECT o_orderkey, batch, 1, 5, 'not_declared', 'x', 'ok' FROM o WHERE o_orderpriority = '5-LOW'
 UNION ALL
 SELECT o_orderkey, 2, 2, 1, 'cust_name', concat('second ', c_name), 'ok' FROM o WHERE o_orderpriority = '2-HIGH'
 UNION ALL
 SELECT o_orderkey, 2, 2, 2, 'order_date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 'ok' FROM o
   WHERE o_orderpriority = '2-HIGH')
SELECT o_orderkey AS doc, concat('doc-', o_orderkey) AS document_id, concat('scan-', o_orderkey, '-', result_no) AS source_name,
 concat('2024-01-0', batch, 'T00:00:00.000Z') AS extracted_at_iso, batch, concat('res-', o_orderkey, '-', result_no) AS result_id,
 o_orderkey * 10 + result_no AS result_ord, pos AS ord, field_id, text, status
FROM r
"""

# Form page of a template: rows of one panel (slot 0 of 5) with a nested pair and two cells.
SQL["fx_template_px"] = f"""
WITH p AS (
 SELECT p_partkey, p_size, CAST(floor(p_partkey / 20) AS BIGINT) AS template_id, p_partkey % 20 AS slot FROM {{part}}),
q AS (SELECT p.*, slot % 5 AS col, CAST(floor(slot / 5) AS BIGINT) AS line FROM p)
SELECT template_id, 0 AS page_index, p_partkey, concat('obj_', p_partkey) AS object_id, slot AS input_ord,
 CASE col WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 420 ELSE 620 END + (template_id * 7) % 12 AS px,
 20 + line * 190 + CASE col WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 35 ELSE 40 END + (template_id * 3) % 9 AS py,
 CASE col WHEN 0 THEN 830 WHEN 1 THEN 300 ELSE 40 + p_size * 2 END AS pw,
 CASE col WHEN 0 THEN 165 WHEN 1 THEN 120 ELSE 30 + (p_partkey * 7) % 60 END AS ph,
 60 + p_partkey % 40 AS conf
FROM q
"""

SQL["fx_template"] = f"""
SELECT template_id, page_index, object_id, input_ord, {_norm('px')} AS x, {_norm('py')} AS y, {_norm('pw')} AS w, {_norm('ph')} AS h,
 CAST(conf AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence FROM (__fx_template_px__) AS t
"""

# A document shows its template shifted; some objects are displaced (outliers) and some badly
# resized, so that the similarity floors leave them without partner.
SQL["fx_runtime"] = f"""
SELECT c_custkey AS doc_id, template_id, page_index, p_partkey, concat('r_', p_partkey) AS object_id, input_ord,
 {_norm("px + (c_custkey * 7) % 41 + CASE WHEN (p_partkey + c_custkey) % 13 = 0 THEN 90 ELSE 0 END")} AS x,
 {_norm("py + (c_custkey * 11) % 31")} AS y,
 {_norm("CASE WHEN (p_partkey + c_custkey) % 17 = 0 THEN CAST(floor(pw / 3) AS BIGINT) ELSE pw END")} AS w,
 {_norm("CASE WHEN (p_partkey + c_custkey) % 17 = 0 THEN CAST(floor(ph / 3) AS BIGINT) ELSE ph END")} AS h,
 CAST(conf AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {{customer}} JOIN (__fx_template_px__) AS t ON CAST(floor(c_custkey / 15) AS BIGINT) = template_id
"""

# Same objects side by side: the pairs every rect expression is checked on.
SQL["fx_pairs"] = """
SELECT r.doc_id, r.template_id, r.page_index, t.object_id AS config_id, r.object_id AS runtime_id,
 t.x AS cx, t.y AS cy, t.w AS cw, t.h AS ch, r.x AS rx, r.y AS ry, r.w AS rw, r.h AS rh, t.confidence AS confidence
FROM (__fx_template__) AS t JOIN (__fx_runtime__) AS r
 ON t.template_id = r.template_id AND t.page_index = r.page_index AND concat('r_', substring(t.object_id, 5)) = r.object_id
"""

SQL["fx_geometry"] = f"""
SELECT s_suppkey AS template_id, concat('geo-', s_suppkey) AS geometry_id, concat('f', n) AS field_id, n AS ord, 0 AS page_index,
 {_norm("80 + n * 5 + (s_suppkey * 7) % 12")} AS x, {_norm("(n - 1) * 190 + 60 + (s_suppkey * 3) % 9")} AS y,
 {_norm("30")} AS w, {_norm("18")} AS h
FROM {{supplier}} JOIN (VALUES (1), (2), (3)) AS t(n) ON n > 0
"""

SQL["fx_surfaces"] = """
SELECT c_custkey AS doc_id, 0 AS page_index, 1000 AS width, 1000 AS height, concat('scan ', c_custkey, '.pdf') AS source_name
FROM {customer}
UNION ALL
SELECT c_custkey, 1, 600 + c_nationkey * 40, 800 + c_nationkey * 20, concat('scan ', c_custkey, '.pdf') FROM {customer}
"""

# Raw pixel detections per customer; returned lines give a shifted near copy.
_DET = """SELECT o_custkey AS doc_id, 0 AS page_index,
 concat('d_', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', CAST(floor(l_extendedprice * 10) AS BIGINT), '_', __V__) AS object_id,
 (l_partkey * 37) % 700 + __V__ AS px, (l_suppkey * 53) % 700 AS py, 2 + (l_partkey * 11) % 250 AS pw,
 2 + (l_suppkey * 13) % 250 AS ph, l_returnflag = 'A' AS confirmed, CAST(l_linenumber AS DOUBLE) / CAST(8 AS DOUBLE) AS fill_ratio
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
SQL["fx_detections"] = (
    _DET.replace("__V__", "0") + "\nUNION ALL\n" + _DET.replace("__V__", "1") + " WHERE l_returnflag = 'R'"
)

# The same detections as page objects.
SQL["fx_objects"] = f"""
SELECT doc_id, page_index, object_id, object_id AS input_ord, {_norm('px')} AS x, {_norm('py')} AS y, {_norm('pw')} AS w,
 {_norm('ph')} AS h, CASE WHEN confirmed THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence
FROM (__fx_detections__) AS d
"""

SQL["fx_points"] = "SELECT DISTINCT user_id AS scanline, event_id % 500 AS pos FROM {events}"

SQL["fx_segments"] = """
SELECT DISTINCT o_custkey AS doc_id, 0 AS page_index, l_linenumber % 2 AS axis, ((l_partkey * 7) % 6) * 150 + l_suppkey % 3 AS axis_pos,
 1 + l_linenumber % 3 AS thickness, (l_suppkey % 4) * 60 AS start_pos, 700 + (l_orderkey % 10) * 20 AS end_pos
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""


def text(name: str) -> str:
    """SQL of a fixture with nested fixtures expanded; table names stay as ``{table}``."""
    sql = SQL[name]
    for other in SQL:
        tag = f"__{other}__"
        if tag in sql:
            sql = sql.replace(tag, text(other))
    return sql


def oracle_text(name: str) -> str:
    """The fixture for DuckDB, whose views carry the table names."""
    return text(name).format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a Spark DataFrame over the tables of ``sf_dir``."""
    real_sizes(spark)
    sql = text(name)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)
