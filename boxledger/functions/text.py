"""Text expressions: reading tidy-up (R-3, R-4), cell cleaning (K-1..K-5), artifact names (S-5)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character maps and junk classes that decide cleaned cells.
NUMERIC_FROM, NUMERIC_TO = "OoQIlLZzSsGB", "000111225568"
TEXT_FROM, TEXT_TO = "0158", "OISB"
# Unicode white space, spelled out because the engines disagree on \s.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
NO_BREAK_SPACE = r"\x{A0}"
MULTI_SPACE = r"[ \t]{2,}"
LEADING_JUNK = rf"^[{SPACE}'`\"|©®@*•·.,;:_~^\\/()\-]+"
TRAILING_JUNK = rf"[{SPACE}'`\"|*•·,;:_~^\\/()\-]+\z"
TRAILING_ISOLATED = r" [^A-Za-z0-9_@.+\-]{1,3}\z"
TRIM = rf"^[{SPACE}]+|[{SPACE}]+\z"

CHANGE_TYPES = ("unchanged", "stage-1", "stage-1b", "stage-1-and-1b")


def tidy_text(raw: Column) -> Column:
    """R-3: one space inside lines, no empty lines, LF between lines."""
    lines = F.split(F.regexp_replace(raw, r"\r\n?", "\n"), "\n")
    tidied = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, rf"[{SPACE}]+", " "), r"^ | \z", ""))
    return F.array_join(F.filter(tidied, lambda s: s != ""), "\n")


def norm_confidence(raw: Column) -> Column:
    """R-4: percent to [0,1], non-finite to 0."""
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / F.lit(100.0))))


def stage1_numeric(c: Column) -> Column:
    """K-1: letters that look like digits become digits."""
    return F.translate(c, NUMERIC_FROM, NUMERIC_TO)


def stage1_text(c: Column) -> Column:
    """K-2: digits that look like letters become letters."""
    return F.translate(c, TEXT_FROM, TEXT_TO)


def stage1_any(c: Column) -> Column:
    """K-2: untyped cells pass through."""
    return c


def stage1(c: Column, field_type: Column) -> Column:
    return F.when(field_type == "numeric", stage1_numeric(c)).when(field_type == "text", stage1_text(c)).otherwise(c)


def _edge_steps(compat_ascii_nbsp: bool) -> dict[str, Callable[[Column], Column]]:
    """The edge cleanup step by step, each a function of the value after the step before.

    ``compat_ascii_nbsp`` treats the plain space as the "no-break" character: the value is the
    same except that real no-break spaces inside a cell stay, and the reason code fires on any space.
    """

    def without(*patterns: str) -> Callable[[Column], Column]:
        return lambda c: reduce(lambda v, p: F.regexp_replace(v, p, ""), patterns, c)

    return {
        "nbsp": lambda c: F.regexp_replace(c, " " if compat_ascii_nbsp else NO_BREAK_SPACE, " "),
        "zero_width": without(ZERO_WIDTH),
        "multi": lambda c: F.regexp_replace(c, MULTI_SPACE, " "),
        "trim": without(TRIM),
        "lead": without(LEADING_JUNK),
        "trail": without(TRAILING_ISOLATED, TRAILING_JUNK),
        "final": without(TRIM),
    }


def stage1b_steps(c: Column, compat_ascii_nbsp: bool = False) -> dict[str, Column]:
    """K-3: the value after each edge-cleanup step, in order, as nested expressions of ``c``."""
    steps: dict[str, Column] = {}
    for name, step in _edge_steps(compat_ascii_nbsp).items():
        c = steps[name] = step(c)
    return steps


def with_steps(df: DataFrame, column: str, compat_ascii_nbsp: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """K-3 as one column for each step, so that what looks at several steps computes none of them twice."""
    steps = {}
    for name, step in _edge_steps(compat_ascii_nbsp).items():
        df = df.withColumn(f"_step_{name}", step(F.col(column)))
        column = f"_step_{name}"
        steps[name] = F.col(column)
    return df, steps


def stage1b(c: Column, compat_ascii_nbsp: bool = False) -> Column:
    """K-3: cleaned value only."""
    return stage1b_steps(c, compat_ascii_nbsp)["final"]


def reason_codes(raw: Column, substituted: Column, compat_ascii_nbsp: bool = False, steps: dict[str, Column] | None = None) -> Column:
    """K-4: codes of the steps that changed the cell, in step order. ``steps``: of ``with_steps``, where they are columns."""
    s = stage1b_steps(substituted, compat_ascii_nbsp) if steps is None else steps
    nbsp = " " if compat_ascii_nbsp else NO_BREAK_SPACE
    early_trim = s["trim"] != s["multi"]
    late_trim = ~early_trim & (s["final"] != s["trail"])
    return F.array_compact(
        F.array(
            F.when(raw != substituted, F.lit("stage-1-substituted")),
            F.when(substituted.rlike(nbsp), F.lit("replaced-nbsp")),
            F.when(s["zero_width"] != s["nbsp"], F.lit("stripped-zero-width")),
            F.when(s["multi"] != s["zero_width"], F.lit("collapsed-multi-space")),
            F.when(early_trim, F.lit("trimmed-whitespace")),
            F.when(s["lead"] != s["trim"], F.lit("stripped-leading-edge-junk")),
            F.when(s["trail"] != s["lead"], F.lit("stripped-trailing-edge-junk")),
            F.when(late_trim, F.lit("trimmed-whitespace")),
        )
    )


def change_type(raw: Column, substituted: Column, cleaned: Column) -> Column:
    """K-5."""
    first, second = raw != substituted, substituted != cleaned
    return (
        F.when(first & second, F.lit("stage-1-and-1b"))
        .when(first, F.lit("stage-1"))
        .when(second, F.lit("stage-1b"))
        .otherwise(F.lit("unchanged"))
    )


def clean_cell(raw: Column, field_type: Column, compat_ascii_nbsp: bool = False) -> Column:
    """K-1..K-5 for one cell: struct(clean_value, change_type, reason_codes)."""
    sub = stage1(raw, field_type)
    out = stage1b(sub, compat_ascii_nbsp)
    return F.struct(
        out.alias("clean_value"),
        change_type(raw, sub, out).alias("change_type"),
        reason_codes(raw, sub, compat_ascii_nbsp).alias("reason_codes"),
    )


# File suffix per artifact kind. Wizard kinds keep every character of the wizard
# name but white space; id kinds keep only [a-z0-9-] and 48 characters.
WIZARD_KINDS = {
    "wizard": ".wizard.json",
    "geometry": ".geometry.json",
    "predicted": ".predicted-geometry.json",
    "readings": ".ocrbox.json",
    "masterdb": ".masterdb.csv",
    "masterdb-cleaned": ".masterdb.cleaned.csv",
}
ID_KINDS = {
    "structural": (".structural.json", "document"),
    "transformation": (".transformation.json", "document"),
    "refine-analytics": (".refine-analytics.json", "analytics"),
}
ID_STEM_LENGTH = 48


def artifact_name(ident: Column, kind: str) -> Column:
    """S-5: file name of an artifact."""
    if kind in WIZARD_KINDS:
        stem = F.when(F.length(ident) > 0, ident).otherwise(F.lit("wizard"))
        return F.concat(F.lower(F.regexp_replace(stem, rf"[{SPACE}]+", "-")), F.lit(WIZARD_KINDS[kind]))
    suffix, default = ID_KINDS[kind]
    stem = F.when(F.length(ident) > 0, ident).otherwise(F.lit(default))
    slug = F.substring(F.lower(F.regexp_replace(stem, r"[^A-Za-z0-9-]+", "-")), 1, ID_STEM_LENGTH)
    return F.concat(slug, F.lit(suffix))
