from pyspark.sql import functions as F

from boxledger.functions import text
from boxledger.operators import ledger as LG

# raw, type, cleaned; each row is about one rule, the last ones about several
DIRTY = [
    ("S0Z-4GI", "numeric", "502-461"),
    ("1OO80 5Q", "text", "IOOBO SQ"),
    ("l0O15", "any", "l0O15"),
    ("tax\u00a0id", "any", "tax id"),
    ("\u200bAhorn\u200dweg\ufeff", "any", "Ahornweg"),
    ("Haus   am \t See", "any", "Haus am See"),
    ("\u2003Kassel\u3000\n", "any", "Kassel"),
    ("•~(Rechnung", "any", "Rechnung"),
    ("Lager B;:_", "any", "Lager B"),
    ("Menge §§", "any", "Menge"),
    ("C++ ++", "any", "C++ ++"),
    ("--", "any", ""),
    ("  |\u00a0ZB.l7|  ", "numeric", "28.17"),
]


def test_dirty_cells(spark):
    df = spark.createDataFrame([(r, t, c) for r, t, c in DIRTY], "raw string, kind string, want string")
    rows = df.select("raw", "want", text.clean_cell(F.col("raw"), F.col("kind")).alias("c")).collect()
    assert [(r.raw, r.c.clean_value) for r in rows] == [(r.raw, r.want) for r in rows]


def test_reason_codes_and_compat_space(spark):
    df = spark.createDataFrame([("3S9 ",)], "raw string")
    sub = text.stage1(F.col("raw"), F.lit("numeric"))
    plain, compat = df.select(text.reason_codes(F.col("raw"), sub), text.reason_codes(F.col("raw"), sub, True)).first()
    assert plain == ["stage-1-substituted", "trimmed-whitespace"]
    assert compat == ["stage-1-substituted", "replaced-nbsp", "trimmed-whitespace"]


def test_tidy_text(spark):
    got = spark.createDataFrame([("  a \t b\r\n\r\n c\rd ",)], "t string").select(text.tidy_text(F.col("t"))).first()[0]
    assert got == "a b\nc\nd"


def reading(doc, result, field, value, status="ok", pos=1):
    return (doc, f"src-{result}", "t", result, pos, field, value, status)


SCHEMA = "document_id string, source_name string, extracted_at_iso string, result_ord long, ord int, field_id string, text string, status string"


def test_upsert_replaces_whole_rows_in_place(spark):
    order = ["a", "b"]
    first = spark.createDataFrame([reading("d1", 1, "a", "1"), reading("d1", 1, "b", "2"), reading("d2", 2, "a", "3")], SCHEMA)
    led = LG.upsert_ledger(spark.createDataFrame([], LG.ledger_schema(order)), LG.batch_rows(first, order, 1), order)
    second = spark.createDataFrame([reading("d1", 5, "a", "9"), reading("d3", 6, "b", "x", "error"), reading("d3", 7, "a", "7")], SCHEMA)
    rows = LG.batch_rows(second, order, 2)
    out = {r.document_id: (r.a, r.b, r.row_batch, r.row_ord) for r in LG.upsert_ledger(led, rows, order).collect()}
    assert out == {"d1": ("9", "", 1, 1), "d2": ("3", "", 1, 2), "d3": ("7", "", 2, 6)}
    marks = {(r.document_id, r.outcome) for r in LG.upsert_outcome(led, rows).collect()}
    assert marks == {("d1", "replaced"), ("d3", "appended"), ("d3", "replaced")}


def test_reconcile_order():
    assert LG.reconcile_order(["b", "old"], ["a", "b", "c"]) == ["b", "old", "a", "c"]
