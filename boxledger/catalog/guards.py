"""Contract guards, geometry validation, sources (V-*, S-1..S-6).

One artifact per order is built as JSON text: the tag is wrong for some orders, one required part is
missing for others, and some texts do not parse.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from boxledger import fixtures
from boxledger.catalog.registry import add, fx
from boxledger.functions import rect as R
from boxledger.operators import validate as V
from boxledger.sources import contracts as C
from boxledger.session import shared_dir
from boxledger.sources import intake

_RECT = {"xNorm": 0.1, "yNorm": 0.2, "wNorm": 0.3, "hNorm": 0.1}
_PX = {"x": 1, "y": 2, "width": 3, "height": 4}
_AFF = {"scaleX": 1, "scaleY": 1, "translateX": 0.1, "translateY": 0}
_HOLE = "@@"  # the part that is missing in some artifacts

_REL = {"xRatio": 0.1, "yRatio": 0.1, "wRatio": 0.5, "hRatio": 0.5}


def _structural(mode="opencv-runtime", edge=0.2, threshold=9) -> dict:
    to_edge = {"relativeFieldRect": _REL, "distanceToEdge": 0.1}
    anchors = {
        "objectAnchors": [{"rank": "primary", "objectId": "o", "relativeFieldRect": _REL}], "stableObjectAnchors": [{"label": "A", "objectId": "o", "distance": 0.1, "relativeFieldRect": _REL}],
        "refinedBorderAnchor": to_edge, "borderAnchor": to_edge,
    }
    relation = {"fromObjectId": "o", "toObjectId": "o2", "relationKind": "near", "relativeRect": _REL, "fallbackOrder": 0}
    field = {
        "fieldId": "a", "fieldAnchors": anchors, "objectAnchorGraph": [{"fromAnchor": "A", "toAnchor": "B", **relation}], "containedBy": None, "nearestObjects": [{"objectId": "o", "distance": 0.1}],
        "relativePositionWithinParent": None, "distanceToBorder": edge, "distanceToRefinedBorder": 0.1,
    }
    node = {"objectId": "o", "objectRectNorm": _RECT, "bbox": _RECT, "parentObjectId": None, "childObjectIds": [], "confidence": 0.9, "depth": 0}
    page = {
        "pageIndex": 0, "pageSurface": {"pageIndex": 0, "surfaceWidth": 10, "surfaceHeight": 10}, "cvExecutionMode": mode, "border": {"rectNorm": _RECT},
        "refinedBorder": {"rectNorm": _RECT, "cvContentRectNorm": _RECT, "source": "cv-content", "influencedByBBoxCount": 0, "containsAllSavedBBoxes": True}, "objectHierarchy": {"objects": [node]},
        "pageAnchorRelations": {"objectToObject": [{**relation, "distance": 0.2}], "objectToRefinedBorder": [{"objectId": "o", "relativeRect": _REL}], "refinedBorderToBorder": {"relativeRect": _REL}}, "fieldRelationships": [field],
    }
    profile = {"adaptiveThresholdC": threshold, "cannyAutoSigma": 0.33, "darkPageNormalizedThresholdFloor": 4.5, "acceptRoundedRectanglesAsConfirmed": True}
    return {"structureVersion": "boxledger/structure/v3", "id": "s", "documentFingerprint": "f", "createdAtIso": "t", "cvAdapter": {"name": "n", "version": "1"}, "cvSensitivityValues": profile, "pages": [page]}


# Valid documents per kind with the breakable value, and the rule its absence breaks.
DOCS = {
    "wizard": ({"wizardName": "w", "fields": [{"fieldId": "a", "label": "A", "type": _HOLE, "required": True}]}, '"text"', "type"),
    "geometry": (
        {"geometryFileVersion": "boxledger/geometry/v1", "id": "g", "wizardId": "w", "documentFingerprint": "f",
         "fields": [{"fieldId": "a", "pageIndex": 0, "bbox": _RECT, "pixelBbox": _PX, "pageSurface": {"pageIndex": 0, "surfaceWidth": 10, "surfaceHeight": 10}, "confirmedAtIso": "t", "confirmedBy": _HOLE}]},
        '"user"', "confirmer",
    ),
    "page": ({"pageIndex": 0, "width": _HOLE, "height": 10, "aspectRatio": 1.25, "sourceName": "s", "normalization": {"pipelineVersion": "1.0", "boundary": "intake-raster-only"}}, "12.5", "numbers"),
    "structural": (_structural(mode=_HOLE), '"opencv-runtime"', "mode"),
    "transformation": (
        {"id": "t", "overallConfidence": 0.5, "pages": [{"pageIndex": 0, "objectMatches": [{"configObjectId": "a", "runtimeObjectId": "b", "confidence": 0.9, "basis": ["parent-chain"], "transform": _AFF, "notes": [], "warnings": []}],
         "levelSummaries": [{"level": _HOLE, "transform": None, "confidence": 0}], "fieldAlignments": [{"fieldId": "a", "candidates": [{"source": "border", "fallbackOrder": 0, "confidence": 1}]}]}]},
        '"object"', "levels",
    ),
    "predicted": (
        {"geometryFileVersion": "boxledger/geometry/v1", "id": "p", "wizardId": "w", "fields": [{"fieldId": "a", "pageIndex": 0, "bbox": _RECT, "pixelBbox": _PX, "anchorTierUsed": "border",
         "transform": {"pageIndex": 0, "basis": "border", "sourceConfigRectNorm": _HOLE, "sourceRuntimeRectNorm": _RECT, **_AFF}}]},
        json.dumps(_RECT, separators=(",", ":")), "source-rects",
    ),
    "readings": (
        {"id": "r", "wizardId": "w", "documentFingerprint": "f", "bboxSource": "geometry-file", "sourceArtifactId": "g", "generatedAtIso": "t",
         "fields": [{"fieldId": "a", "pageIndex": 0, "text": "x", "confidence": 0.5, "status": _HOLE, "bboxUsed": _RECT, "bboxPaddingNorm": 0.004}]},
        '"ok"', "status",
    ),
    "masterdb": ({"wizardId": "w", "fieldOrder": ["a", _HOLE], "rows": [{"documentId": "d", "sourceName": "s", "extractedAtIso": "t", "values": {"a": "1"}}]}, '"b"', "order"),
    "ocrmagic": ({"cellAudits": [{"documentId": "d", "fieldId": "a", "fieldType": "any", "rawValue": "x", "cleanValue": "x", "changeType": _HOLE, "reasonCodes": []}]}, '"unchanged"', "change"),
    "refine": (
        {"refineVersion": "boxledger/structural-refine/v1", "id": "x", "documentCount": _HOLE, "compatibility": {"wizardFieldCount": 1, "wizardFieldSignature": "a", "configStructuralObjectIdSignature": "b", "geometryFieldIdSignature": "c"},
         "pages": [{"pageIndex": 0, "objects": [{"configObjectId": "o", "appearanceCount": 1, "projectionIou": {"count": 1, "totalWeight": 1, "mean": 0.5, "m2": 0}, "reliability": 0.9}]}]},
        "3", "count",
    ),
    "extraction": ({"id": "e", "wizardId": "w", "documentFingerprint": "f", "generatedAtIso": "t", "fields": [{"fieldId": "a", "value": "v", "confidence": _HOLE, "source": "localized-ocr"}]}, "0.5", "confidence"),
}
IDS = {k: f"V{i}" for i, k in enumerate(DOCS, 1)}
# Further parts of a kind that may be broken.
MORE = {
    "legacy_fields": ("structural", (_structural(edge=_HOLE), "0.25", "legacy")),
    "sensitivity_profile": ("structural", (_structural(threshold=_HOLE), "7.5", "profile")),
}


def _wrong(good: str) -> str:
    """A JSON value of another type than ``good``."""
    return "7" if good.startswith('"') else "[1]" if good.startswith("{") else '"x"'


# Rules that tell a wrong type from a missing part only by the type itself.
TYPE_ONLY = ("geometry", "masterdb")


def _artifact_sql(kind: str, part: tuple) -> str:
    body, good, _ = part
    name, version = C.TAGS[kind]
    text = json.dumps({"schema": "##", "version": version, **body}, separators=(",", ":"))
    head, rest = text.split("##")
    mid, tail = rest.split(f'"{_HOLE}"')

    def q(t: str) -> str:
        return "'" + t.replace("{", "{{").replace("}", "}}") + "'"

    tag = f"CASE WHEN o_orderkey % 9 = 0 THEN 'other/tag' ELSE 'boxledger/{name}' END"
    hole = f"CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 11 = 0 THEN {q(_wrong(good))} ELSE {q(good)} END"
    return (
        f"SELECT concat('{kind}-', o_orderkey) AS artifact_id, concat(CASE WHEN o_orderkey % 23 = 0 THEN 'broken ' ELSE '' END, {q(head)}, {tag}, {q(mid)}, {hole}, {q(tail)}) AS text FROM {{orders}}"
    )


for _name, (_kind, _part) in {**{k: (k, d) for k, d in DOCS.items()}, **MORE}.items():
    fixtures.SQL[f"fx_art_{_name}"] = _artifact_sql(_kind, _part)
    _rule = _part[2]
    add(
        f"{IDS[_kind]}_validate_{_name}",
        lambda s, sf, k=_kind, n=_name: C.violations(fx(f"fx_art_{n}")(s, sf), k),
        f"""SELECT concat('{_kind}-', o_orderkey) AS artifact_id, r.rule FROM orders JOIN (VALUES ('parse'), ('tag'), ('types'), ('{_rule}')) AS r(rule)
          ON (o_orderkey % 23 = 0 AND r.rule = 'parse') OR (o_orderkey % 23 <> 0 AND ((o_orderkey % 9 = 0 AND r.rule = 'tag') OR (o_orderkey % 7 = 0 AND r.rule = '{_rule}')
            OR (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AND r.rule IN ('types', {"''" if _kind in TYPE_ONLY else f"'{_rule}'"}))))""",
    )


def _split(s, sf):
    valid, rejected = C.split_artifacts(fx("fx_art_wizard")(s, sf), "wizard")
    return valid.select("artifact_id", F.lit("valid").alias("outcome")).union(rejected.select("artifact_id", "reason"))


add(
    "S1_read_artifacts",
    _split,
    """SELECT concat('wizard-', o_orderkey) AS artifact_id, CASE WHEN o_orderkey % 23 = 0 THEN 'could not parse' WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'invalid schema' ELSE 'valid' END AS outcome FROM orders""",
)


# One file for each issuer.
fixtures.SQL["fx_art_files"] = _artifact_sql("wizard", DOCS["wizard"]).replace("o_orderkey", "s_suppkey").replace("{orders}", "{supplier}")


def _from_files(s, sf):
    """Every artifact is a file of its own; what is told of a file goes by its folder, named after the artifact."""
    path = f"{shared_dir(s)}/artifacts-{uuid.uuid4().hex}"
    fx("fx_art_files")(s, sf).select(F.col("artifact_id").alias("artifact"), F.col("text").alias("value")).write.partitionBy("artifact").text(path)
    valid, rejected = C.read_artifacts(s, f"{path}/*", "wizard")
    told = valid.select("artifact_id", F.lit("valid").alias("outcome")).union(rejected.select("artifact_id", "reason"))
    return told.select(F.regexp_extract("artifact_id", "artifact=([^/]+)", 1).alias("artifact_id"), "outcome")


add(
    "S1_artifact_per_file",
    _from_files,
    """SELECT concat('wizard-', s_suppkey) AS artifact_id, CASE WHEN s_suppkey % 23 = 0 THEN 'could not parse' WHEN s_suppkey % 9 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'invalid schema' ELSE 'valid' END AS outcome FROM supplier""",
)


def _rewritten(s, sf):
    """Valid artifacts written as JSON again must equal the text they were read from."""
    valid, _ = C.split_artifacts(fx("fx_art_wizard")(s, sf), "wizard")
    return C.artifact_json(valid, "wizard")


add(
    "S2_write_artifacts",
    _rewritten,
    """SELECT concat('wizard-', o_orderkey) AS artifact_id, '{"schema":"boxledger/wizard-file","version":"1.0","wizardName":"w","fields":[{"fieldId":"a","label":"A","type":"text","required":true}]}' AS text
      FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""",
)


def _written(s, sf):
    """Valid artifacts written to a folder and read back from it, the texts counted."""
    valid, _ = C.split_artifacts(fx("fx_art_wizard")(s, sf), "wizard")
    path = f"{shared_dir(s)}/artifacts-{uuid.uuid4().hex}"
    C.write_artifacts(valid, path, "wizard")
    again, rejected = C.read_artifact_lines(s, path, "wizard")
    texts = C.artifact_json(again, "wizard").select("text").unionByName(rejected.select("text"))
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


add(
    "S1_S2_artifact_files",
    _written,
    """SELECT '{"schema":"boxledger/wizard-file","version":"1.0","wizardName":"w","fields":[{"fieldId":"a","label":"A","type":"text","required":true}]}' AS text, count(*) AS n
      FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""",
)
add(
    "S6_intake_manifest",
    lambda s, sf: _manifest(s, sf),
    """WITH f AS (SELECT url, concat(split_part(url, '/', -1), CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '' END) AS name, length(html) % 50 AS len, page_id FROM pages)
      SELECT concat(min(url)) AS path, name, len AS length, CASE WHEN name LIKE '%.PDF' THEN 'application/pdf' ELSE 'image/jpeg' END AS outcome FROM f WHERE page_id % 5 <= 1 GROUP BY name, len
      UNION ALL SELECT url, name, len, 'unsupported type' FROM f WHERE page_id % 5 > 1""",
)


def _manifest(s, sf):
    p = fixtures.table(s, sf, "pages")
    suffix = F.when(F.col("page_id") % 5 == 0, ".PDF").when(F.col("page_id") % 5 == 1, ".jpeg").when(F.col("page_id") % 5 == 2, ".txt").otherwise("")
    files = p.select(F.col("url").alias("path"), F.concat(F.element_at(F.split("url", "/"), -1), suffix).alias("name"), (F.length("html") % 50).alias("length"))
    ok, bad = intake.manifest(files)
    return ok.select("path", "name", "length", F.col("mime").alias("outcome")).union(bad.select("path", "name", "length", "reason"))


# ------------------------------------------------------------------ geometry against wizard and pages
_GEO = """
SELECT concat('geo-', c_custkey) AS geometry_id, CASE WHEN c_nationkey = 3 THEN 'other' ELSE 'forms' END AS wizard_id, CASE WHEN c_nationkey = 4 THEN '' ELSE 'forms' END AS expected_wizard,
 CASE n WHEN 1 THEN 'cust_name' WHEN 2 THEN CASE WHEN c_nationkey = 5 THEN 'surprise' ELSE 'total' END ELSE 'priority' END AS field_id,
 CASE WHEN n = 3 AND c_mktsegment = 'BUILDING' THEN 2 ELSE n % 2 END AS page_index, n % 2 AS surface_index, 1000 + CASE WHEN c_nationkey = 6 THEN 2 ELSE 1 END AS surface_w, 1000 AS surface_h,
 CASE WHEN c_nationkey = 7 AND n = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n * 300 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS x, CAST(100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS y,
 CASE WHEN c_nationkey = 8 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.09 AS DOUBLE) END AS w, CAST(0.03 AS DOUBLE) AS h
FROM {customer} JOIN (VALUES (1), (2), (3)) AS t(n) ON n > 0"""
fixtures.SQL["fx_geo_check"] = _GEO


def _geometry_issues(s, sf):
    g = fx("fx_geo_check")(s, sf).withColumn("bbox", R.pack())
    wiz = g.select("geometry_id", "wizard_id", "expected_wizard").distinct()
    pages = fixtures.table(s, sf, "customer").select(F.concat(F.lit("geo-"), "c_custkey").alias("geometry_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page_index"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return V.validate_geometry(g, wiz, fx("fx_fields")(s, sf), pages)


add(
    "V12_validate_geometry",
    _geometry_issues,
    """WITH g AS (SELECT *, page_index <= 1 AS on_page FROM fx_geo_check),
      i AS (SELECT geometry_id, field_id, CASE WHEN field_id = 'surprise' THEN 'unknown-field-id' END AS a, CASE WHEN NOT on_page THEN 'invalid-page-index' END AS b,
        CASE WHEN on_page AND (abs(1000 - surface_w) > 1 OR page_index <> surface_index) THEN 'page-surface-mismatch' END AS c, CASE WHEN on_page AND isnan(x) THEN 'invalid-normalized-coordinates' END AS d,
        CASE WHEN on_page AND NOT isnan(x) AND (x > 1 OR x + w > 1 + 2.220446049250313e-16) THEN 'out-of-bounds-coordinates' END AS e FROM g)
      SELECT geometry_id, field_id, code FROM (SELECT geometry_id, field_id, unnest([a, b, c, d, e]) AS code FROM i) WHERE code IS NOT NULL
      UNION ALL SELECT DISTINCT geometry_id, NULL, 'wizard-id-mismatch' FROM g WHERE expected_wizard <> '' AND wizard_id <> expected_wizard
      UNION ALL SELECT geometry_id, 'total', 'missing-required-field' FROM g WHERE field_id = 'surprise'""",
    ("fx_geo_check",),
)


def _runs(s, sf):
    o = fixtures.table(s, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.lit("w").alias("wizard_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "v").otherwise("w").alias("geometry_wizard_id"),
        F.lit("c").alias("config_id"), F.when(F.col("o_orderstatus") == "O", F.lit(None)).when(F.col("o_orderpriority") == "5-LOW", F.lit("d")).otherwise(F.lit("c")).alias("transformation_config_id"),
        F.col("o_custkey").alias("runtime_id"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("transformation_runtime_id"),
    )


add(
    "V13_cross_references",
    lambda s, sf: V.cross_reference_errors(_runs(s, sf)),
    """SELECT o_orderkey AS run_id, 'configGeometry.wizardId does not match expected wizardId' AS error FROM orders WHERE o_orderpriority = '1-URGENT'
      UNION ALL SELECT o_orderkey, 'transformationModel.config.id does not match configStructuralModel.id' FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '5-LOW'
      UNION ALL SELECT o_orderkey, 'transformationModel.runtime.id does not match runtimeStructuralModel.id' FROM orders WHERE o_orderstatus = 'P'""",
)
add(
    "V15_surface_errors",
    lambda s, sf: V.surface_errors(
        fx("fx_surfaces")(s, sf).withColumn("width", F.when(F.col("doc_id") % 50 == 7, 0).otherwise(F.col("width"))), fx("fx_surfaces")(s, sf).withColumn("height", F.when(F.col("doc_id") % 40 == 3, 5).otherwise(F.col("height")))
    ),
    """SELECT doc_id, page_index, 'invalid surface dimensions' AS error FROM fx_surfaces WHERE doc_id % 50 = 7 UNION ALL SELECT doc_id, page_index, 'surface mismatch' FROM fx_surfaces WHERE doc_id % 50 = 7 OR doc_id % 40 = 3""",
    ("fx_surfaces",),
)
