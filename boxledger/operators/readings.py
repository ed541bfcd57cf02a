"""Field readings (R-1..R-6): requests, attached text, status and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.functions import rect
from boxledger.functions.text import norm_confidence, tidy_text
from boxledger.operators.spatial import NORM_LEVELS, stab_join

DEFAULT_PADDING = 0.004
MIN_CROP_PIXELS = 0.5


def field_requests(boxes: DataFrame, bbox_source: str, id_col: str, fingerprint_col: str, fallback: DataFrame) -> DataFrame:
    """R-1: one request per box of a confirmed or predicted geometry.

    ``fallback`` is (doc_id, first_fingerprint) from S-8, used when the artifact has no fingerprint.
    """
    with_fp = boxes.join(fallback, "doc_id", "left")
    fp = F.coalesce(F.nullif(F.col(fingerprint_col), F.lit("")), F.col("first_fingerprint"), F.lit(""))
    return with_fp.select(
        "doc_id",
        "field_id",
        "page_index",
        "bbox",
        F.lit(bbox_source).alias("bbox_source"),
        F.col(id_col).alias("source_artifact_id"),
        fp.alias("fingerprint"),
    )


def attach_readings(
    requests: DataFrame, surfaces: DataFrame, recognised: DataFrame, padding: float = DEFAULT_PADDING
) -> DataFrame:
    """R-2: status and text per request; a failed row never fails the batch.

    ``surfaces``: doc_id, page_index, width, height. ``recognised``: doc_id, field_id, raw_text,
    confidence, error. Both are keyed equi joins.
    """
    pages = surfaces.select("doc_id", "page_index", "width", "height", F.lit(True).alias("_page"))
    text = recognised.select("doc_id", "field_id", "raw_text", F.col("confidence").alias("_conf"), "error")
    joined = requests.join(pages, ["doc_id", "page_index"], "left").join(text, ["doc_id", "field_id"], "left")
    padded = rect.pad_box(F.col("bbox"), F.lit(float(padding)))
    work = joined.withColumn("_pad", padded).withColumn(
        "_text", tidy_text(F.coalesce(F.col("raw_text"), F.lit("")))
    )
    no_page = F.col("_page").isNull()
    no_crop = ~no_page & (
        (F.col("_pad.w") * F.col("width") <= MIN_CROP_PIXELS) | (F.col("_pad.h") * F.col("height") <= MIN_CROP_PIXELS)
    )
    failed = ~no_page & ~no_crop & F.col("error").isNotNull()
    read = ~no_page & ~no_crop & F.col("error").isNull()
    ok = read & (F.col("_text") != "")
    return work.select(
        *requests.columns,
        F.when(ok, F.col("_text")).otherwise(F.lit("")).alias("text"),
        F.when(read, F.coalesce(F.col("_conf"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(no_page | failed, F.lit("error")).when(ok, F.lit("ok")).otherwise(F.lit("empty")).alias("status"),
        F.when(no_page, F.format_string("No NormalizedPage for pageIndex %d.", F.col("page_index")))
        .when(failed, F.col("error"))
        .alias("error_message"),
        F.when(no_page | no_crop, F.col("bbox")).otherwise(F.col("_pad")).alias("bbox_used"),
        F.lit(float(padding)).alias("padding"),
    )


def text_at(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """The recognised text of every request that any text of its page lies in: (doc_id, field_id, raw_text, confidence, error).

    ``texts``: PAGE, x, y (a point, page units), raw_text, confidence, error. A request (``bbox``) reads the texts whose
    point lies in its box, from top to bottom and left to right, with the lowest confidence and the first error among them.
    Points meet boxes through the page grid, so a page full of text costs no more than its neighbourhoods.
    """
    boxes = requests.select("doc_id", "page_index", "field_id", "bbox")
    points = texts.select("doc_id", "page_index", "x", "y", "raw_text", F.col("confidence").alias("_conf"), "error")
    everywhere = F.lit(NORM_LEVELS[0]), F.lit(NORM_LEVELS[1])
    met = stab_join(points, boxes, ["doc_id", "page_index"], F.col("x"), F.col("y"), *everywhere, F.col("bbox"), 0.0, NORM_LEVELS)
    b = F.col("bbox")
    inside = (F.col("x") >= b["x"]) & (F.col("x") <= rect.right(b)) & (F.col("y") >= b["y"]) & (F.col("y") <= rect.bottom(b))
    place = F.struct("y", "x", "raw_text")  # the texts inside one field are few
    parts = F.array_sort(F.collect_list(place))
    return met.where(inside).groupBy("doc_id", "field_id").agg(
        F.array_join(F.transform(parts, lambda t: t["raw_text"]), " ").alias("raw_text"), F.min("_conf").alias("confidence"), F.min_by("error", F.when(F.col("error").isNotNull(), place)).alias("error")
    )


def with_reader(requests: DataFrame, reader: Callable, percent_confidence: bool = True) -> DataFrame:
    """R-5: plug a user's vectorized recogniser into the plan.

    ``reader`` is a ``pandas_udf`` over (doc_id, field_id, page_index, bbox) returning
    ``struct<raw_text:string, confidence:double, error:string>``. The engine ships none.
    """
    read = requests.select(
        "doc_id", "field_id", reader(F.struct("doc_id", "field_id", "page_index", "bbox")).alias("_r")
    )
    conf = norm_confidence(F.col("_r.confidence")) if percent_confidence else F.col("_r.confidence")
    return read.select("doc_id", "field_id", "_r.raw_text", conf.alias("confidence"), "_r.error")


def readings_report(readings: DataFrame, fields: DataFrame) -> DataFrame:
    """R-6: display listing with labels, 1-based page and two-decimal confidence."""
    labels = fields.select("field_id", "label")
    return readings.join(labels, "field_id", "left").select(
        "doc_id",
        "field_id",
        F.coalesce("label", "field_id").alias("label"),
        (F.col("page_index") + 1).alias("page"),
        F.format_string("%.2f", F.col("confidence")).alias("confidence"),
        "status",
        "text",
    )
