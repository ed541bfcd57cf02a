"""Ranked field candidates (P-1..P-5).

``anchors`` and ``border_anchors`` are template tables (TPL keys) from :mod:`anchors`;
``matches`` and the level summaries are document tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.functions import rect as R
from boxledger.operators.consensus import KEYS
from boxledger.operators.matching import TPL

RANK_FACTOR = {"primary": 1.0, "secondary": 0.85, "tertiary": 0.7}
PARENT_PENALTY = 0.85
MIN_MATCH = 0.7
NEAR_REFINED = 0.01
REFINED_RELIABLE = 0.7
MISSING_BORDER_CONFIDENCE = 0.4
OBJECT_SOURCES = ("matched-object", "parent-object")
REL = "struct<x:double,y:double,w:double,h:double>"
COLUMNS = [
    *KEYS, "field_id", "source", "ord", "rank", "config_id", "runtime_id", "affine", "rel", "confidence", "notes",
]


def _f3(c: str) -> Column:
    return F.format_string("%.3f", F.col(c))


def rank_factor(rank: Column) -> Column:
    out = F.when(rank == "primary", R.lit(RANK_FACTOR["primary"]))
    return out.when(rank == "secondary", R.lit(RANK_FACTOR["secondary"])).otherwise(R.lit(RANK_FACTOR["tertiary"]))


def _anchor_matches(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    a = anchors.select(*TPL, "field_id", "pos", "rank", F.col("object_id").alias("config_id"), "rel")
    m = matches.select(*KEYS, "config_id", "runtime_id", "affine", F.col("confidence").alias("match_confidence"))
    return m.join(a, TPL + ["config_id"])


def cand_matched(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """P-1: matched anchors of confidence at least 0.7, weighted by rank."""
    t = _anchor_matches(anchors, matches).where(F.col("match_confidence") >= R.lit(MIN_MATCH))
    factor = rank_factor(F.col("rank"))
    notes = F.array(
        F.concat("rank", F.lit(" object anchor matched runtime object "), "runtime_id"),
        F.concat(F.lit("match confidence "), _f3("match_confidence"), F.lit(" x rank factor "), F.format_string("%.2f", factor)),
    )
    return t.select(
        *KEYS, "field_id", F.lit("matched-object").alias("source"), F.col("pos").alias("ord"), "rank", "config_id", "runtime_id",
        "affine", "rel", R.clamp01(F.col("match_confidence") * factor).alias("confidence"), notes.alias("notes"),
    )


def _ancestor_matches(anchors: DataFrame, chains: DataFrame, matches: DataFrame) -> DataFrame:
    primary = anchors.where(F.col("rank") == "primary").select(
        *TPL, "field_id", F.col("object_id").alias("primary_id"), F.col("rel").alias("primary_rel")
    )
    up = chains.select(*TPL, F.col("object_id").alias("primary_id"), F.col("ancestor_id").alias("config_id"), "distance")
    ladder = primary.join(up, TPL + ["primary_id"])
    m = matches.select(*KEYS, "config_id", "runtime_id", "affine", F.col("confidence").alias("match_confidence"))
    return m.join(ladder, TPL + ["config_id"])


def cand_parent(anchors: DataFrame, chains: DataFrame, tmpl: DataFrame, matches: DataFrame) -> DataFrame:
    """P-2: nearest ancestor of the primary anchor with a match of at least 0.7."""
    t = _ancestor_matches(anchors, chains, matches).where(F.col("match_confidence") >= R.lit(MIN_MATCH))
    pick = F.min_by(F.struct("primary_id", "primary_rel", "config_id", "runtime_id", "affine", "match_confidence"), "distance")
    near = t.groupBy(*KEYS, "field_id").agg(pick.alias("_p")).select(*KEYS, "field_id", "_p.*")
    rects = tmpl.select(*TPL, "config_id", "c")
    old = rects.select(*TPL, F.col("config_id").alias("primary_id"), F.col("c").alias("_old"))
    new = rects.select(*TPL, "config_id", F.col("c").alias("_new"))
    t = near.join(old, TPL + ["primary_id"]).join(new, TPL + ["config_id"])
    notes = F.array(
        F.concat(F.lit("primary anchor "), "primary_id", F.lit(" did not match — falling back to ancestor "), "config_id"),
        F.concat(F.lit("ancestor match confidence "), _f3("match_confidence"), F.lit(f" x parent penalty {PARENT_PENALTY:.2f}")),
    )
    return t.select(
        *KEYS, "field_id", F.lit("parent-object").alias("source"), F.lit(10).alias("ord"), F.lit(None).cast("string").alias("rank"),
        "config_id", "runtime_id", "affine", R.re_express(F.col("primary_rel"), F.col("_old"), F.col("_new")).alias("rel"),
        R.clamp01(F.col("match_confidence") * R.lit(PARENT_PENALTY)).alias("confidence"), notes.alias("notes"),
    )


def cand_frames(docs: DataFrame, border_anchors: DataFrame, refined: DataFrame, border: DataFrame) -> DataFrame:
    """P-3: refined-border and border candidates; without a border summary an identity one at 0.4."""
    b = border_anchors.select(*TPL, "field_id", "refined_rel", "border_rel")
    base = docs.select(*KEYS).join(b, TPL)
    none = F.lit(None).cast("string")

    def level(summary: DataFrame, how: str) -> DataFrame:
        s = summary.select(*KEYS, F.col("affine").alias("_a"), F.col("confidence").alias("_c"), F.col("warnings").alias("_w"))
        return base.join(s.where(F.col("_a").isNotNull()), KEYS, how)

    r = level(refined, "inner")
    r_notes = F.concat(
        F.array(F.concat(F.lit("refined-border level confidence "), _f3("_c"))),
        F.transform("_w", lambda w: F.concat(F.lit("refined-border warning: "), w)),
    )
    r = r.select(
        *KEYS, "field_id", F.lit("refined-border").alias("source"), F.lit(20).alias("ord"), none.alias("rank"),
        none.alias("config_id"), none.alias("runtime_id"), F.col("_a").alias("affine"), F.col("refined_rel").alias("rel"),
        F.col("_c").alias("confidence"), r_notes.alias("notes"),
    )
    p = level(border, "left")
    missing = F.col("_a").isNull()
    identity = R.make_affine(R.lit(1), R.lit(1), R.lit(0), R.lit(0))
    p = p.select(
        *KEYS, "field_id", F.lit("border").alias("source"), F.lit(30).alias("ord"), none.alias("rank"), none.alias("config_id"),
        none.alias("runtime_id"), F.coalesce("_a", identity).alias("affine"), F.col("border_rel").alias("rel"),
        F.when(missing, R.lit(MISSING_BORDER_CONFIDENCE)).otherwise(F.col("_c")).alias("confidence"),
        F.array(
            F.when(missing, F.lit("border level summary missing — using identity transform as last-resort fallback")).otherwise(
                F.concat(F.lit("border level confidence "), _f3("_c"))
            )
        ).alias("notes"),
    )
    return r.unionByName(p)


def order_candidates(cands: DataFrame, refined: DataFrame) -> DataFrame:
    """P-4: final order per field; object candidates that only repeat a reliable refined border move below it."""
    s = refined.select(*KEYS, F.col("affine").alias("_ra"), F.col("confidence").alias("_rc"))
    t = cands.join(s, KEYS, "left")
    repeats = (
        F.col("source").isin(*OBJECT_SOURCES)
        & F.col("_ra").isNotNull()
        & (F.col("_rc") >= R.lit(REFINED_RELIABLE))
        & (R.scale_delta(F.col("affine"), F.col("_ra")) < R.lit(NEAR_REFINED))
        & (R.translate_delta(F.col("affine"), F.col("_ra")) < R.lit(NEAR_REFINED))
    )
    t = t.withColumn("demoted", F.coalesce(repeats, F.lit(False)))
    cls = F.when(F.col("source") == "border", 3).when(F.col("demoted"), 2).when(F.col("source") == "refined-border", 1).otherwise(0)
    note = F.concat(
        F.lit(f"transform within ±{NEAR_REFINED}/±{NEAR_REFINED} of refined-border (refined-border confidence "), _f3("_rc"),
        F.lit(f" ≥ {REFINED_RELIABLE:.2f}) — demoted below refined-border"),
    )
    w = Window.partitionBy(*KEYS, "field_id").orderBy("_cls", "ord")
    return (
        t.withColumn("_cls", cls)
        .withColumn("notes", F.when(F.col("demoted"), F.concat("notes", F.array(note))).otherwise(F.col("notes")))
        .withColumn("fallback_order", F.row_number().over(w) - 1)
        .drop("_ra", "_rc", "_cls", "ord")
    )


def candidate_warnings(ordered: DataFrame, anchors: DataFrame, chains: DataFrame, matches: DataFrame) -> DataFrame:
    """P-5: warnings per document field (only fields that have some)."""
    weak = _anchor_matches(anchors, matches).where(F.col("match_confidence") < R.lit(MIN_MATCH))
    tail = F.lit(f" is below the near-perfect floor {MIN_MATCH:.2f} — ")
    weak_rows = weak.select(
        *KEYS, "field_id", F.col("pos").alias("_o"),
        F.concat("rank", F.lit(" object anchor "), "config_id", F.lit(" matched "), "runtime_id", F.lit(" but match confidence "),
                 _f3("match_confidence"), tail, F.lit("candidate not emitted")).alias("warning"),
    )
    up = _ancestor_matches(anchors, chains, matches)
    good = F.col("match_confidence") >= R.lit(MIN_MATCH)
    first_good = F.min(F.when(good, F.col("distance"))).over(Window.partitionBy(*KEYS, "field_id"))
    up_rows = (
        up.withColumn("_g", first_good)
        .where(~good & (F.col("_g").isNull() | (F.col("distance") < F.col("_g"))))
        .select(
            *KEYS, "field_id", (F.col("distance") + 10).alias("_o"),
            F.concat(F.lit("parent-object fallback ancestor "), "config_id", F.lit(" matched "), "runtime_id",
                     F.lit(" but match confidence "), _f3("match_confidence"), tail, F.lit("ancestor candidate not emitted")).alias("warning"),
        )
    )
    is_obj = F.col("source").isin(*OBJECT_SOURCES)
    per_field = ordered.groupBy(*KEYS, "field_id").agg(
        F.count_if(is_obj).alias("_obj"), F.count_if(F.col("source") == "refined-border").alias("_ref"), F.count_if("demoted").alias("_dem"),
        F.count_if((F.col("source") == "border") & F.col("notes")[0].startswith("border level summary missing")).alias("_ident"),
    )
    general = per_field.select(
        *KEYS, "field_id",
        F.inline(
            F.array(
                F.struct(F.lit(100).alias("_o"), F.when(F.col("_ref") == 0, F.lit("refined-border fallback unavailable for this page")).alias("warning")),
                F.struct(F.lit(101).alias("_o"), F.when(F.col("_ident") > 0, F.lit("border level summary missing — emitted identity fallback")).alias("warning")),
                F.struct(F.lit(102).alias("_o"), F.when(F.col("_obj") == 0, F.lit("no object-level candidate available — relying on refined-border/border fallbacks only")).alias("warning")),
                F.struct(
                    F.lit(103).alias("_o"),
                    F.when(
                        (F.col("_dem") > 0) & (F.col("_ref") > 0),
                        F.concat(F.col("_dem").cast("string"), F.lit(" object-rung candidate(s) demoted below refined-border as their transform was within the near-identity tolerance of a confident refined-border summary")),
                    ).alias("warning"),
                ),
            )
        ),
    ).where(F.col("warning").isNotNull())
    rows = weak_rows.unionByName(up_rows).unionByName(general)
    packed = F.array_sort(F.collect_list(F.struct("_o", "warning")))
    return rows.groupBy(*KEYS, "field_id").agg(F.transform(packed, lambda x: x["warning"]).alias("warnings"))


def field_candidates(docs, anchors, border_anchors, chains, tmpl, matches, refined, border) -> DataFrame:
    """P-1..P-4 for all documents."""
    objects = cand_matched(anchors, matches).unionByName(cand_parent(anchors, chains, tmpl, matches))
    return order_candidates(objects.unionByName(cand_frames(docs, border_anchors, refined, border)), refined)
