"""Readers over real files, and the type walk of the contracts against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxledger.sources import contracts, intake, ledger_csv

FIXED = "document_id,source_name,extracted_at_iso"


def test_csv_files_of_several_headers_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{FIXED},net,tax\nd1,s1,t,10,2\nd2,s2,t,"1,5"\n,,,,\n')
    (tmp_path / "b.csv").write_text(f'{FIXED},tax,note\nd3,s3,t,7,"two\nlines, ""quoted"""\nd4,s4,t,8,x,surplus\n')
    got = {r.document_id: r for r in ledger_csv.read_ledger_csv(spark, str(tmp_path), "w").collect()}
    assert set(got) == {"d1", "d2", "d3", "d4"}
    assert (got["d1"].net, got["d1"].tax, got["d1"].note) == ("10", "2", "")
    assert (got["d2"].net, got["d2"].tax) == ("1,5", "")
    assert (got["d3"].net, got["d3"].tax, got["d3"].note) == ("", "7", 'two\nlines, "quoted"')
    assert (got["d4"].tax, got["d4"].note, got["d4"].wizard_id) == ("8", "x", "w")


def test_csv_errors(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ledger_csv.LedgerCsvError, match="empty"):
        ledger_csv.read_ledger_csv(spark, str(tmp_path), "w")
    (tmp_path / "wrong.csv").write_text("document_id,net\nd,1\n")
    with pytest.raises(ledger_csv.LedgerCsvError, match="must start"):
        ledger_csv.read_ledger_csv(spark, str(tmp_path), "w")


def test_manifest_of_a_folder(spark, tmp_path):
    for name, size in (("one/scan.pdf", 5), ("two/scan.pdf", 5), ("two/other.PDF", 7), ("photo.JpEg", 3), ("notes.txt", 2), ("plain", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    good, bad = intake.intake_manifest(spark, str(tmp_path))
    rows = {(r.name, r.length, r.mime, r.path.rsplit("/", 2)[1]) for r in good.collect()}
    assert {(n, size, m) for n, size, m, _ in rows} == {("scan.pdf", 5, "application/pdf"), ("other.PDF", 7, "application/pdf"), ("photo.JpEg", 3, "image/jpeg")}
    assert ("scan.pdf", 5, "application/pdf", "one") in rows
    assert {(r.name, r.reason) for r in bad.collect()} == {("notes.txt", "unsupported type"), ("plain", "unsupported type")}


STRING, DOUBLE = T.StringType(), T.DoubleType()
ITEM = T.StructType().add("e", STRING).add("f", T.ArrayType(DOUBLE))
WANTED = T.StructType().add("a", STRING).add("b", DOUBLE).add("c", T.BooleanType()).add("d", T.ArrayType(ITEM)).add("g", T.MapType(STRING, STRING)).add("h", T.StructType().add("i", DOUBLE))


def plain_fits(value, wanted) -> bool:
    if value is None or wanted is None:
        return True
    if isinstance(wanted, T.StringType):
        return isinstance(value, str)
    if isinstance(wanted, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(wanted, T.DoubleType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(wanted, T.ArrayType):
        return isinstance(value, list) and all(plain_fits(x, wanted.elementType) for x in value)
    if isinstance(wanted, T.MapType):
        return isinstance(value, dict) and all(plain_fits(x, wanted.valueType) for x in value.values())
    return isinstance(value, dict) and all(plain_fits(x, wanted[k].dataType if k in wanted.names else None) for k, x in value.items())


def test_types_equal_a_plain_walk(spark):
    rng = random.Random(9)

    def some(wanted, depth=0):
        if rng.random() < 0.08 or wanted is None and depth > 2:
            return rng.choice([None, "x", 1, 2.5, 10**20, True, [], {}, [1, "y"], {"k < z>, q": {"`": 1}}])
        if wanted is None:
            return rng.choice([lambda: {rng.choice("abcz"): some(None, depth + 1)}, lambda: [some(None, depth + 1) for _ in range(2)], lambda: 3])()
        if isinstance(wanted, T.StringType):
            return rng.choice(["", "t", "2024-01-01", "true"])
        if isinstance(wanted, T.BooleanType):
            return rng.random() < 0.5
        if isinstance(wanted, T.DoubleType):
            return rng.choice([0, 1.25, -3e300, 7])
        if isinstance(wanted, T.ArrayType):
            return [some(wanted.elementType, depth + 1) for _ in range(rng.randrange(0, 4))]
        if isinstance(wanted, T.MapType):
            return {f"k{i}": some(wanted.valueType, depth + 1) for i in range(rng.randrange(0, 3))}
        out = {f.name: some(f.dataType, depth + 1) for f in wanted.fields if rng.random() < 0.85}
        return out | ({"extra: `x`": some(None, depth)} if rng.random() < 0.3 else {})

    docs = [some(WANTED) for _ in range(600)]
    docs = [d for d in docs if isinstance(d, dict)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    shapes = {r.i: r.s for r in df.select("i", F.schema_of_variant(F.parse_json("t")).alias("s")).collect()}
    want = [plain_fits(d, WANTED) for d in docs]
    assert [contracts.fits_type(shapes[i], WANTED) for i in range(len(docs))] == want and 0 < sum(want) < len(want)


def test_extracted_values_may_mix_scalars_but_hold_no_parts(spark):
    def text(*values):
        fields = [{"fieldId": "a", "value": v, "confidence": 0.5, "source": "localized-ocr"} for v in values]
        return json.dumps({"schema": "boxledger/extraction-result", "version": "1.0", "id": "e", "wizardId": "w", "documentFingerprint": "f", "generatedAtIso": "t", "fields": fields})

    rows = [("mixed", text("x", 1, True, None)), ("object", text("x", {"a": 1})), ("array", text([1])), ("none", text())]
    bad = {(r.artifact_id, r.rule) for r in contracts.violations(spark.createDataFrame(rows, "artifact_id string, text string"), "extraction").collect()}
    assert bad == {("object", "types"), ("array", "types")}
