"""Document identity: fingerprints, canonical JSON and compatibility signatures (S-7..S-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE_DECIMALS = 6


def document_fingerprint(surfaces: DataFrame) -> DataFrame:
    """S-7: ``surface:{source}#{i}:{w}x{h}|{i}:{w}x{h}`` in page order, one row per document.

    The collected array holds the pages of one document and becomes part of its one string.
    """
    size = F.concat(F.round("width").cast("long"), F.lit("x"), F.round("height").cast("long"))
    pages = F.array_sort(F.collect_list(F.struct("page_index", size.alias("size"))))
    parts = F.transform(pages, lambda p: F.concat(p["page_index"], F.lit(":"), p["size"]))
    source = F.min_by("source_name", "page_index")
    return surfaces.groupBy("doc_id").agg(
        F.concat(F.lit("surface:"), source, F.lit("#"), F.array_join(parts, "|")).alias("fingerprint")
    )


def first_page_fingerprint(surfaces: DataFrame) -> DataFrame:
    """S-8: fingerprint of the first page only; documents without pages have no row and read as ''."""
    first = F.min_by(F.struct("source_name", "page_index", "width", "height"), "page_index").alias("p")
    return (
        surfaces.groupBy("doc_id")
        .agg(first)
        .select(
            "doc_id",
            F.concat(
                F.lit("surface:"), "p.source_name", F.lit("#"), "p.page_index", F.lit(":"), "p.width", F.lit("x"), "p.height"
            ).alias("first_fingerprint"),
        )
    )


def canonical_json(columns: dict[str, Column]) -> Column:
    """S-9: JSON with keys sorted, arrays in order, no spaces, nulls written out.

    Nested structs must already have sorted members (use this function's ``struct`` helper).
    """
    return F.to_json(sorted_struct(columns), {"ignoreNullFields": "false"})


def sorted_struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[columns[k].alias(k) for k in sorted(columns)])


def _list_json(values: Column) -> Column:
    return F.to_json(F.array_sort(values), {"ignoreNullFields": "false"})


def _rect_json(r: Column) -> Column:
    """Rect with sorted long names; six decimals, whole numbers without fraction as in JSON."""

    def number(v: Column) -> Column:
        n = F.round(v, SIGNATURE_DECIMALS)
        return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("decimal(20,6)").cast("double").cast("string"))

    parts = [F.concat(F.lit(f'"{k}Norm":'), number(r[k])) for k in "hwxy"]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def compat_signature(fields: DataFrame, objects: DataFrame, frames: DataFrame, geometry: DataFrame, surfaces: DataFrame) -> DataFrame:
    """S-10: hashes of what must agree before statistics of two batches may be merged, per template.

    ``fields``: template_id, field_id, label, field_type, required; ``objects``: template_id,
    page_index, object_id; ``frames``: template_id, page_index, refined, cv_content; ``geometry``:
    template_id, field_id; ``surfaces``: template_id, page_index, width, height. The collected
    lists are the template's own definition.
    """
    key = "template_id"
    f = sorted_struct({"fieldId": F.col("field_id"), "label": F.col("label"), "required": F.col("required"), "type": F.col("field_type")})
    wiz = fields.groupBy(key).agg(F.sha2(_list_json(F.collect_list(f)), 256).alias("field_hash"), F.count(F.lit(1)).alias("n_fields"))
    obj = objects.groupBy(key).agg(F.sha2(_list_json(F.collect_list("object_id")), 256).alias("object_hash"))
    page = F.struct(
        "page_index",
        F.concat(F.lit('{"cvContentRectNorm":'), _rect_json(F.col("cv_content")), F.lit(',"pageIndex":'), F.col("page_index").cast("string"),
                 F.lit(',"rectNorm":'), _rect_json(F.col("refined")), F.lit("}")).alias("json"),
    )
    listed = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["json"])
    frm = frames.groupBy(key).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("frame_hash"), F.count(F.lit(1)).alias("n_pages"))
    geo = geometry.groupBy(key).agg(F.sha2(_list_json(F.collect_list("field_id")), 256).alias("geometry_hash"))
    size = surfaces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_index", "width", "height"))).alias("page_sizes"))
    return wiz.join(obj, key).join(frm, key).join(geo, key).join(size, key)


def signatures_compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """S-11: (template_id, compatible); names, times and the frame hash may differ."""
    must = ["field_hash", "n_fields", "object_hash", "n_pages", "geometry_hash", "page_sizes"]
    right = b.select("template_id", *[F.col(c).alias(f"_{c}") for c in must])
    same = F.lit(True)
    for c in must:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(right, "template_id").select("template_id", same.alias("compatible"))
