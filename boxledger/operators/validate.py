"""Geometry and cross-reference checks (V-12, V-13, V-15). Contract guards are in sources.contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.functions import rect as R

SURFACE_TOLERANCE = 1


def validate_geometry(geometry: DataFrame, wizards: DataFrame, fields: DataFrame, pages: DataFrame, tolerate_unknown: bool = False) -> DataFrame:
    """V-12: issues (geometry_id, field_id, code); a geometry is valid iff it has none.

    ``geometry``: geometry_id, wizard_id, expected_wizard, field_id, page_index, surface_index,
    surface_w, surface_h, bbox. ``wizards``: geometry_id, wizard_id, expected_wizard (one row each, also for
    empty geometries). ``fields``: wizard fields field_id, required. ``pages``: geometry_id,
    page_index, width, height. A wizard is a form definition, so its required ids are read once.
    """
    known = fields.select("field_id", F.lit(True).alias("_known"))
    p = pages.select("geometry_id", "page_index", "width", "height", F.lit(True).alias("_page"))
    t = geometry.join(known, "field_id", "left").join(p, ["geometry_id", "page_index"], "left")
    on_page = F.col("_page").isNotNull()
    finite = R.all_finite(F.col("bbox"))
    moved = (
        (F.abs(F.col("width") - F.col("surface_w")) > SURFACE_TOLERANCE)
        | (F.abs(F.col("height") - F.col("surface_h")) > SURFACE_TOLERANCE)
        | (F.col("page_index") != F.col("surface_index"))
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull() & F.lit(not tolerate_unknown), F.lit("unknown-field-id")),
            F.when(~on_page, F.lit("invalid-page-index")),
            F.when(on_page & moved, F.lit("page-surface-mismatch")),
            F.when(on_page & ~finite, F.lit("invalid-normalized-coordinates")),
            F.when(on_page & finite & ~R.in_bounds(F.col("bbox")), F.lit("out-of-bounds-coordinates")),
        )
    )
    per_field = t.select("geometry_id", "field_id", F.explode(codes).alias("code"))
    wrong = wizards.where((F.col("expected_wizard") != "") & ~F.col("wizard_id").eqNullSafe(F.col("expected_wizard"))).select(
        "geometry_id", F.lit(None).cast("string").alias("field_id"), F.lit("wizard-id-mismatch").alias("code")
    )
    required = [r.field_id for r in fields.where(F.col("required")).select("field_id").collect()]
    missing = (
        wizards.select("geometry_id", F.explode(F.array(*[F.lit(f) for f in required]).cast("array<string>")).alias("field_id"))
        .join(geometry.select("geometry_id", "field_id"), ["geometry_id", "field_id"], "left_anti")
        .select("geometry_id", "field_id", F.lit("missing-required-field").alias("code"))
    )
    return per_field.unionByName(wrong).unionByName(missing)


def cross_reference_errors(runs: DataFrame) -> DataFrame:
    """V-13: hard errors of a run whose artifacts do not belong together.

    ``runs``: run_id, wizard_id, geometry_wizard_id, config_id, transformation_config_id, runtime_id,
    transformation_runtime_id; transformation ids are NULL when there is no transformation.
    """
    def differ(a: str, b: str, message: str):
        return F.when(F.col(a).isNotNull() & (F.col(a) != F.col(b)), F.lit(message))

    errors = F.array_compact(
        F.array(
            differ("geometry_wizard_id", "wizard_id", "configGeometry.wizardId does not match expected wizardId"),
            differ("transformation_config_id", "config_id", "transformationModel.config.id does not match configStructuralModel.id"),
            differ("transformation_runtime_id", "runtime_id", "transformationModel.runtime.id does not match runtimeStructuralModel.id"),
        )
    )
    return runs.select("run_id", F.explode(errors).alias("error"))


def surface_errors(left: DataFrame, right: DataFrame) -> DataFrame:
    """V-15: pages of non-positive size and pages whose size differs from the reference surface."""
    bad = left.where(~(R.finite(F.col("width").cast("double")) & R.finite(F.col("height").cast("double")) & (F.col("width") > 0) & (F.col("height") > 0)))
    invalid = bad.select("doc_id", "page_index", F.lit("invalid surface dimensions").alias("error"))
    b = right.select("doc_id", "page_index", F.col("width").alias("_w"), F.col("height").alias("_h"))
    other = left.join(b, ["doc_id", "page_index"]).where((F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h")))
    return invalid.unionByName(other.select("doc_id", "page_index", F.lit("surface mismatch").alias("error")))
