"""Contract guards as data-quality jobs (V-1..V-11) and the artifact reader/writer (S-1, S-2).

A contract is a table of rules over one parsed artifact; a document breaks a rule where the rule is
not true. Rules are column expressions, so checking a folder of artifacts is one scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the contracts.
FIELD_TYPES = ("text", "numeric", "any")
STATUSES = ("ok", "empty", "error")
BBOX_SOURCES = ("geometry-file", "predicted-geometry-file")
BORDER_SOURCES = ("cv-content", "bbox-union", "cv-and-bbox-union", "full-page-fallback")
CV_MODES = ("opencv-runtime", "heuristic-fallback")
LEVELS = ("border", "refined-border", "object", "parent-chain", "field-anchor")
BASES = ("object-similarity", "parent-chain", "refined-border-relation", "field-recovery")
CANDIDATE_SOURCES = ("matched-object", "parent-object", "refined-border", "border")
TIERS = ("field-object-a", "field-object-b", "field-object-c", "page-consensus", "refined-border", "border")
STRATEGIES = ("id", "type-hierarchy-geometry")
RELATION_KINDS = ("container", "sibling", "adjacent", "near")
CHANGE_TYPES = ("unchanged", "stage-1", "stage-1b", "stage-1-and-1b")
EXTRACTION_SOURCE = "localized-ocr"
ANCHOR_RANKS, ANCHOR_LABELS = ("primary", "secondary", "tertiary"), ("A", "B", "C")

# Artifacts are tagged ``{namespace}/{name}``; files of another application are read with its namespace.
NAMESPACE = "boxledger"
TAGS = {
    "wizard": ("wizard-file", "1.0"),
    "geometry": ("geometry-file", "1.1"),
    "page": ("normalized-page", "2.0"),
    "structural": ("structural-model", "4.0"),
    "transformation": ("transformation-model", "1.0"),
    "predicted": ("predicted-geometry-file", "1.0"),
    "readings": ("ocrbox-result", "1.0"),
    "masterdb": ("masterdb-table", "1.0"),
    "ocrmagic": ("ocrmagic-result", "1.1"),
    "refine": ("structural-refine-analytics", "1.0"),
    "extraction": ("extraction-result", "1.0"),
}

_RECT = "struct<xNorm:double,yNorm:double,wNorm:double,hNorm:double>"
_PX = "struct<x:double,y:double,width:double,height:double>"
_SURFACE = "struct<pageIndex:double,surfaceWidth:double,surfaceHeight:double>"
_REL = "struct<xRatio:double,yRatio:double,wRatio:double,hRatio:double>"
_AFF = "struct<scaleX:double,scaleY:double,translateX:double,translateY:double>"
_W = "struct<count:double,totalWeight:double,mean:double,m2:double>"



def _structural_schema() -> str:
    anchor = f"struct<relativeFieldRect:{_REL},distanceToEdge:double>"
    anchors = (
        f"struct<objectAnchors:array<struct<rank:string,objectId:string,relativeFieldRect:{_REL}>>,"
        f"stableObjectAnchors:array<struct<label:string,objectId:string,distance:double,relativeFieldRect:{_REL}>>,refinedBorderAnchor:{anchor},borderAnchor:{anchor}>"
    )
    graph = f"array<struct<fromAnchor:string,toAnchor:string,fromObjectId:string,toObjectId:string,relationKind:string,fallbackOrder:double,relativeRect:{_REL}>>"
    legacy = (
        "containedBy:string,nearestObjects:array<struct<objectId:string,distance:double>>,"
        "relativePositionWithinParent:struct<xRatio:double,yRatio:double,widthRatio:double,heightRatio:double>,distanceToBorder:double,distanceToRefinedBorder:double"
    )
    relations = (
        f"struct<objectToObject:array<struct<fromObjectId:string,toObjectId:string,relationKind:string,relativeRect:{_REL},fallbackOrder:double,distance:double>>,"
        f"objectToRefinedBorder:array<struct<objectId:string,relativeRect:{_REL}>>,refinedBorderToBorder:struct<relativeRect:{_REL}>>"
    )
    objects = f"array<struct<objectId:string,objectRectNorm:{_RECT},bbox:{_RECT},parentObjectId:string,childObjectIds:array<string>,confidence:double,depth:double>>"
    page = (
        f"struct<pageIndex:double,pageSurface:{_SURFACE},cvExecutionMode:string,border:struct<rectNorm:{_RECT}>,"
        f"refinedBorder:struct<rectNorm:{_RECT},cvContentRectNorm:{_RECT},source:string,influencedByBBoxCount:double,containsAllSavedBBoxes:boolean>,"
        f"objectHierarchy:struct<objects:{objects}>,pageAnchorRelations:{relations},"
        f"fieldRelationships:array<struct<fieldId:string,fieldAnchors:{anchors},objectAnchorGraph:{graph},{legacy}>>>"
    )
    profile = "struct<adaptiveThresholdC:double,cannyAutoSigma:double,darkPageNormalizedThresholdFloor:double,acceptRoundedRectanglesAsConfirmed:boolean>"
    return f"schema string, version string, structureVersion string, id string, documentFingerprint string, createdAtIso string, cvAdapter struct<name:string,version:string>, cvSensitivityValues {profile}, pages array<{page}>"


SCHEMAS = {
    "wizard": "schema string, version string, wizardName string, fields array<struct<fieldId:string,label:string,type:string,required:boolean>>",
    "geometry": f"schema string, version string, geometryFileVersion string, id string, wizardId string, documentFingerprint string, fields array<struct<fieldId:string,pageIndex:double,bbox:{_RECT},pixelBbox:{_PX},pageSurface:{_SURFACE},confirmedAtIso:string,confirmedBy:string>>",
    "page": "schema string, version string, pageIndex double, width double, height double, aspectRatio double, sourceName string, normalization struct<pipelineVersion:string,boundary:string>",
    "structural": _structural_schema(),
    "transformation": f"schema string, version string, id string, overallConfidence double, pages array<struct<pageIndex:double,objectMatches:array<struct<configObjectId:string,runtimeObjectId:string,confidence:double,basis:array<string>,transform:{_AFF},notes:array<string>,warnings:array<string>>>,levelSummaries:array<struct<level:string,transform:{_AFF},confidence:double>>,fieldAlignments:array<struct<fieldId:string,candidates:array<struct<source:string,fallbackOrder:double,confidence:double>>>>>>",
    "predicted": f"schema string, version string, geometryFileVersion string, id string, wizardId string, fields array<struct<fieldId:string,pageIndex:double,bbox:{_RECT},pixelBbox:{_PX},anchorTierUsed:string,transform:struct<pageIndex:double,basis:string,sourceConfigRectNorm:{_RECT},sourceRuntimeRectNorm:{_RECT},scaleX:double,scaleY:double,translateX:double,translateY:double,objectMatchStrategy:string>,warnings:array<string>>>",
    "readings": f"schema string, version string, id string, wizardId string, documentFingerprint string, bboxSource string, sourceArtifactId string, generatedAtIso string, fields array<struct<fieldId:string,pageIndex:double,text:string,confidence:double,status:string,errorMessage:string,bboxUsed:{_RECT},bboxPaddingNorm:double>>",
    "masterdb": "schema string, version string, wizardId string, fieldOrder array<string>, rows array<struct<documentId:string,sourceName:string,extractedAtIso:string,values:map<string,string>>>",
    "ocrmagic": "schema string, version string, cellAudits array<struct<documentId:string,fieldId:string,fieldType:string,rawValue:string,cleanValue:string,changeType:string,reasonCodes:array<string>>>",
    "refine": f"schema string, version string, refineVersion string, id string, documentCount double, compatibility struct<wizardFieldCount:double,wizardFieldSignature:string,configStructuralObjectIdSignature:string,geometryFieldIdSignature:string>, pages array<struct<pageIndex:double,objects:array<struct<configObjectId:string,appearanceCount:double,projectionIou:{_W},reliability:double>>>>",
    "extraction": "schema string, version string, id string, wizardId string, documentFingerprint string, generatedAtIso string, fields array<struct<fieldId:string,value:string,confidence:double,source:string>>",
}


def _one_of(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _rect(r: Column) -> Column:
    return _finite(r["xNorm"]) & _finite(r["yNorm"]) & _finite(r["wNorm"]) & _finite(r["hNorm"])


def _ratios(r: Column) -> Column:
    return _finite(r["xRatio"]) & _finite(r["yRatio"]) & _finite(r["wRatio"]) & _finite(r["hRatio"])


def _all(items: Column, rule: Callable[[Column], Column]) -> Column:
    """An array whose every item satisfies the rule; a missing array does not."""
    return items.isNotNull() & F.forall(items, lambda x: F.coalesce(rule(x), F.lit(False)))


def _strings(items: Column) -> Column:
    return _all(items, lambda s: s.isNotNull())


def _prefix_of(items: Column, names: tuple[str, ...]) -> Column:
    """One to three values equal to the beginning of ``names``."""
    n = F.size(items)
    return (n >= 1) & (n <= len(names)) & (items == F.slice(F.array(*[F.lit(x) for x in names]), F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(len(names)))))


_SCALAR = re.compile(r"[A-Z][A-Z_ ]*(?:\(\d+, ?\d+\))?")
_KEY = re.compile(r"`((?:[^`]|``)*)`: |([^`:<>, ]+): ")
ANY = None  # of which any type will do


def _walk(shape: str, at: int, wanted: T.DataType | None) -> tuple[bool, int]:
    """Whether the type that begins at ``at`` fits, and where it ends. ``shape`` is what ``schema_of_variant`` says."""
    if shape.startswith("OBJECT<", at):
        fits, at = wanted is ANY or isinstance(wanted, (T.StructType, T.MapType)), at + 7
        while shape[at] != ">":
            key = _KEY.match(shape, at)
            name = key[2] if key[1] is None else key[1].replace("``", "`")
            inner = wanted.valueType if isinstance(wanted, T.MapType) else wanted[name].dataType if isinstance(wanted, T.StructType) and name in wanted.names else ANY
            good, at = _walk(shape, key.end(), inner)
            fits, at = fits and good, at + 2 * shape.startswith(", ", at)
        return fits, at + 1
    if shape.startswith("ARRAY<", at):
        good, at = _walk(shape, at + 6, wanted.elementType if isinstance(wanted, T.ArrayType) else ANY)
        return (wanted is ANY or isinstance(wanted, T.ArrayType)) and good, at + 1
    name = _SCALAR.match(shape, at)
    kind = name[0]
    if kind == "VOID" or wanted is ANY:
        fits = True
    elif isinstance(wanted, T.StringType):
        fits = kind == "STRING"
    elif isinstance(wanted, T.BooleanType):
        fits = kind == "BOOLEAN"
    else:
        fits = isinstance(wanted, T.DoubleType) and (kind in ("BIGINT", "DOUBLE", "FLOAT") or kind.startswith("DECIMAL"))
    return fits, name.end()


def fits_type(shape: str, wanted: T.DataType) -> bool:
    """Whether a JSON document of this shape has the contract's type in every part; JSON null and missing parts pass."""
    return _walk(shape, 0, wanted)[0]


def _typed(json: Column, kind: str, wanted: T.StructType) -> Column:
    """One walk of the document gives its shape; each different shape is compared with the contract once a batch."""
    if kind == "extraction":  # an extracted value may be any scalar
        fields = next(f for f in wanted.fields if f.name == "fields").dataType.elementType
        wanted = T.StructType([f if f.name != "fields" else T.StructField("fields", T.ArrayType(T.StructType([x for x in fields.fields if x.name != "value"]))) for f in wanted.fields])

    @F.pandas_udf("boolean")
    def fits(shapes: pd.Series) -> pd.Series:
        known = {x: fits_type(x, wanted) for x in shapes.dropna().unique()}
        return shapes.map(lambda x: known.get(x, False))

    good = fits(F.schema_of_variant(json))
    if kind == "extraction":
        values = F.transform(F.try_variant_get(json, "$.fields", "array<variant>"), lambda f: F.schema_of_variant(F.try_variant_get(f, "$.value", "variant")))
        good = good & ~F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v.startswith("OBJECT") | v.startswith("ARRAY"), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def rules(kind: str, namespace: str = NAMESPACE) -> dict[str, Column]:
    """Rule name to condition over the parsed columns. A part that may be null counts as null where it is missing."""
    schema, version = TAGS[kind]
    c = F.col
    out = {"tag": (c("schema") == f"{namespace}/{schema}") & (c("version") == version)}
    if kind == "wizard":
        out["name"] = c("wizardName").isNotNull()
        out["fields"] = _all(c("fields"), lambda f: f["fieldId"].isNotNull() & f["label"].isNotNull())
        out["type"] = _all(c("fields"), lambda f: _one_of(f["type"], FIELD_TYPES))
        out["required"] = _all(c("fields"), lambda f: f["required"].isNotNull())
    elif kind == "geometry":
        out["version-tag"] = c("geometryFileVersion") == f"{namespace}/geometry/v1"
        out["ids"] = c("id").isNotNull() & c("wizardId").isNotNull() & c("documentFingerprint").isNotNull()
        out["boxes"] = _all(c("fields"), lambda f: f["fieldId"].isNotNull() & _rect(f["bbox"]) & _finite(f["pixelBbox"]["width"]) & _finite(f["pixelBbox"]["height"]))
        out["surface"] = _all(c("fields"), lambda f: _finite(f["pageSurface"]["surfaceWidth"]) & _finite(f["pageSurface"]["surfaceHeight"]))
        out["confirmer"] = _all(c("fields"), lambda f: f["confirmedBy"].isNotNull() & f["confirmedAtIso"].isNotNull())
    elif kind == "page":
        out["numbers"] = _finite(c("pageIndex")) & _finite(c("width")) & _finite(c("height")) & _finite(c("aspectRatio"))
        out["boundary"] = c("normalization.boundary") == "intake-raster-only"
        out["pipeline"] = c("normalization.pipelineVersion") == "1.0"
    elif kind == "structural":
        out["version-tag"] = c("structureVersion") == f"{namespace}/structure/v3"
        out["ids"] = c("id").isNotNull() & c("documentFingerprint").isNotNull() & c("createdAtIso").isNotNull() & c("cvAdapter.name").isNotNull() & c("cvAdapter.version").isNotNull()
        out["surface"] = _all(c("pages"), lambda p: _finite(p["pageIndex"]) & _finite(p["pageSurface"]["pageIndex"]) & _finite(p["pageSurface"]["surfaceWidth"]) & _finite(p["pageSurface"]["surfaceHeight"]))
        out["frames"] = _all(c("pages"), lambda p: _rect(p["border"]["rectNorm"]) & _rect(p["refinedBorder"]["rectNorm"]) & _rect(p["refinedBorder"]["cvContentRectNorm"]) & _one_of(p["refinedBorder"]["source"], BORDER_SOURCES) & _finite(p["refinedBorder"]["influencedByBBoxCount"]) & p["refinedBorder"]["containsAllSavedBBoxes"].isNotNull())
        out["mode"] = _all(c("pages"), lambda p: _one_of(p["cvExecutionMode"], CV_MODES))
        out["objects"] = _all(c("pages"), lambda p: _all(p["objectHierarchy"]["objects"], lambda o: o["objectId"].isNotNull() & _rect(o["objectRectNorm"]) & _rect(o["bbox"]) & _finite(o["confidence"]) & _finite(o["depth"]) & _strings(o["childObjectIds"])))

        def related(r: Column) -> Column:
            return _one_of(r["relationKind"], RELATION_KINDS) & _finite(r["fallbackOrder"]) & _ratios(r["relativeRect"]) & r["fromObjectId"].isNotNull() & r["toObjectId"].isNotNull()

        def to_frames(r: Column) -> Column:
            return _all(r["objectToRefinedBorder"], lambda x: x["objectId"].isNotNull() & _ratios(x["relativeRect"])) & _ratios(r["refinedBorderToBorder"]["relativeRect"])

        out["relations"] = _all(c("pages"), lambda p: _all(p["pageAnchorRelations"]["objectToObject"], lambda x: related(x) & _finite(x["distance"])) & to_frames(p["pageAnchorRelations"]))

        def anchored(f: Column) -> Column:
            a = f["fieldAnchors"]
            named = _prefix_of(a["objectAnchors"]["rank"], ANCHOR_RANKS) & _prefix_of(a["stableObjectAnchors"]["label"], ANCHOR_LABELS)
            placed = _all(a["objectAnchors"], lambda x: x["objectId"].isNotNull() & _ratios(x["relativeFieldRect"])) & _all(a["stableObjectAnchors"], lambda x: x["objectId"].isNotNull() & _finite(x["distance"]) & _ratios(x["relativeFieldRect"]))
            edges = _ratios(a["refinedBorderAnchor"]["relativeFieldRect"]) & _finite(a["refinedBorderAnchor"]["distanceToEdge"]) & _ratios(a["borderAnchor"]["relativeFieldRect"]) & _finite(a["borderAnchor"]["distanceToEdge"])
            graph = _all(f["objectAnchorGraph"], lambda x: related(x) & _one_of(x["fromAnchor"], ANCHOR_LABELS) & _one_of(x["toAnchor"], ANCHOR_LABELS))
            return f["fieldId"].isNotNull() & named & placed & edges & graph

        out["anchors"] = _all(c("pages"), lambda p: _all(p["fieldRelationships"], anchored))

        def legacy(f: Column) -> Column:
            place = f["relativePositionWithinParent"]
            inside = place.isNull() | (_finite(place["xRatio"]) & _finite(place["yRatio"]) & _finite(place["widthRatio"]) & _finite(place["heightRatio"]))
            return _all(f["nearestObjects"], lambda x: x["objectId"].isNotNull() & _finite(x["distance"])) & inside & _finite(f["distanceToBorder"]) & _finite(f["distanceToRefinedBorder"])

        out["legacy"] = _all(c("pages"), lambda p: _all(p["fieldRelationships"], legacy))
        sensitivity = c("cvSensitivityValues")
        out["profile"] = sensitivity.isNull() | (_finite(sensitivity["adaptiveThresholdC"]) & _finite(sensitivity["cannyAutoSigma"]) & _finite(sensitivity["darkPageNormalizedThresholdFloor"]))
    elif kind == "transformation":
        out["confidence"] = _finite(c("overallConfidence"))
        out["matches"] = _all(c("pages"), lambda p: _all(p["objectMatches"], lambda m: _all(m["basis"], lambda b: _one_of(b, BASES)) & _finite(m["confidence"]) & _strings(m["notes"]) & _strings(m["warnings"])))
        out["levels"] = _all(c("pages"), lambda p: _all(p["levelSummaries"], lambda s: _one_of(s["level"], LEVELS) & _finite(s["confidence"])))
        out["candidates"] = _all(c("pages"), lambda p: _all(p["fieldAlignments"], lambda f: _all(f["candidates"], lambda k: _one_of(k["source"], CANDIDATE_SOURCES))))
    elif kind == "predicted":
        out["version-tag"] = c("geometryFileVersion") == f"{namespace}/geometry/v1"
        out["tier"] = _all(c("fields"), lambda f: _one_of(f["anchorTierUsed"], TIERS))
        out["strategy"] = _all(c("fields"), lambda f: f["transform"]["objectMatchStrategy"].isNull() | _one_of(f["transform"]["objectMatchStrategy"], STRATEGIES))

        def pair(f: Column) -> Column:
            t = f["transform"]
            both = _rect(t["sourceConfigRectNorm"]) & _rect(t["sourceRuntimeRectNorm"])
            none = t["sourceConfigRectNorm"].isNull() & t["sourceRuntimeRectNorm"].isNull()
            return F.when(t["basis"] == "page-consensus", none).otherwise(both)

        out["source-rects"] = _all(c("fields"), pair)
        out["boxes"] = _all(c("fields"), lambda f: _rect(f["bbox"]))
    elif kind == "readings":
        out["source"] = _one_of(c("bboxSource"), BBOX_SOURCES)
        out["status"] = _all(c("fields"), lambda f: _one_of(f["status"], STATUSES))
        out["numbers"] = _all(c("fields"), lambda f: _finite(f["confidence"]) & _finite(f["bboxPaddingNorm"]) & _finite(f["pageIndex"]))
        out["text"] = _all(c("fields"), lambda f: f["text"].isNotNull())
    elif kind == "masterdb":
        out["order"] = _strings(c("fieldOrder"))
        out["values"] = _all(c("rows"), lambda r: r["documentId"].isNotNull() & r["sourceName"].isNotNull() & r["extractedAtIso"].isNotNull() & _strings(F.map_values(r["values"])))
    elif kind == "ocrmagic":
        out["type"] = _all(c("cellAudits"), lambda a: _one_of(a["fieldType"], FIELD_TYPES))
        out["change"] = _all(c("cellAudits"), lambda a: _one_of(a["changeType"], CHANGE_TYPES))
        out["codes"] = _all(c("cellAudits"), lambda a: _strings(a["reasonCodes"]))
    elif kind == "refine":
        out["version-tag"] = c("refineVersion") == f"{namespace}/structural-refine/v1"
        out["states"] = _all(c("pages"), lambda p: _all(p["objects"], lambda o: _finite(o["projectionIou"]["mean"]) & _finite(o["projectionIou"]["m2"]) & _finite(o["projectionIou"]["totalWeight"]) & _finite(o["reliability"])))
        out["signature"] = c("compatibility.wizardFieldSignature").isNotNull() & c("compatibility.configStructuralObjectIdSignature").isNotNull() & c("compatibility.geometryFieldIdSignature").isNotNull()
        out["count"] = _finite(c("documentCount"))
    elif kind == "extraction":
        out["ids"] = c("id").isNotNull() & c("wizardId").isNotNull() & c("documentFingerprint").isNotNull() & c("generatedAtIso").isNotNull()
        out["confidence"] = _all(c("fields"), lambda f: f["fieldId"].isNotNull() & _finite(f["confidence"]))
        out["source"] = _all(c("fields"), lambda f: f["source"] == EXTRACTION_SOURCE)
    return out


def parse(raw: DataFrame, kind: str) -> DataFrame:
    """``raw``: artifact_id, text. Adds ``doc`` (typed struct), ``parsed`` (is it a JSON object at all) and ``typed`` (has
    every part the JSON type of the contract, which the struct alone can't tell as it turns numbers into strings)."""
    doc = F.from_json("text", SCHEMAS[kind])
    json = raw.withColumn("doc", doc).withColumn("_json", F.try_parse_json("text"))
    parsed = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    typed = _typed(F.col("_json"), kind, json.schema["doc"].dataType)
    return json.withColumn("parsed", parsed).withColumn("typed", typed).drop("_json")


def violations(raw: DataFrame, kind: str, namespace: str = NAMESPACE) -> DataFrame:
    """V-1..V-11: (artifact_id, rule). ``parse`` stands for text that is not JSON."""
    t = parse(raw, kind)
    checks = rules(kind, namespace) | {"types": F.col("typed")}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks.items()]))
    cols = t.schema["doc"].dataType.names
    flat = t.select("artifact_id", "parsed", "typed", *[F.col(f"doc.{c}").alias(c) for c in cols])
    found = F.when(F.col("parsed"), broken).otherwise(F.array(F.lit("parse")))
    return flat.select("artifact_id", F.explode(found).alias("rule"))


def split_artifacts(raw: DataFrame, kind: str, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """S-1: (valid artifacts with typed columns, rejected ones with raw text and reason)."""
    t = parse(raw, kind)
    cols = t.schema["doc"].dataType.names
    flat = t.select("artifact_id", "text", "parsed", "typed", *[F.col(f"doc.{c}").alias(c) for c in cols])
    ok = F.col("typed")
    for cond in rules(kind, namespace).values():
        ok = ok & F.coalesce(cond, F.lit(False))
    reason = F.when(~F.col("parsed"), F.lit("could not parse")).when(~ok, F.lit("invalid schema"))
    checked = flat.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("text", "parsed", "typed", "reason"), checked.where(F.col("reason").isNotNull()).select("artifact_id", "text", "reason")


def read_artifacts(spark: SparkSession, path: str, kind: str, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """S-1: one artifact per file under ``path``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("artifact_id"), F.col("value").alias("text"))
    return split_artifacts(raw, kind, namespace)


def artifact_json(df: DataFrame, kind: str, namespace: str = NAMESPACE) -> DataFrame:
    """S-2: typed rows to one JSON text per artifact; absent optional parts are left out."""
    tag, version = TAGS[kind]
    names = [c for c in df.columns if c not in ("artifact_id", "schema", "version")]
    doc = F.struct(F.lit(f"{namespace}/{tag}").alias("schema"), F.lit(version).alias("version"), *names)
    return df.select("artifact_id", F.to_json(doc).alias("text"))


def write_artifacts(df: DataFrame, path: str, kind: str, namespace: str = NAMESPACE) -> None:
    """S-2: one JSON document per line, readable again after splitting lines (see ``read_artifact_lines``)."""
    artifact_json(df, kind, namespace).select(F.col("text").alias("value")).write.text(path)


def read_artifact_lines(spark: SparkSession, path: str, kind: str, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """S-1 for folders written by :func:`write_artifacts`; the document id is the artifact id."""
    raw = spark.read.text(path).select(F.sha2("value", 256).alias("artifact_id"), F.col("value").alias("text"))
    return split_artifacts(raw, kind, namespace)
