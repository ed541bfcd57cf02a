"""Intake manifest (S-6): which files of a folder are documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted types by file suffix.
MIME_BY_SUFFIX = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
}


def mime_type(name: Column) -> Column:
    """MIME type by suffix, NULL when not accepted."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for s, m in MIME_BY_SUFFIX.items():
        out = out.when(suffix == s, F.lit(m))
    return out


def manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files``: path, name, length. Accepted files once per (name, length), the smallest path; the rest is rejected."""
    typed = files.withColumn("mime", mime_type(F.col("name")))
    good = typed.where(F.col("mime").isNotNull())
    first = good.groupBy("name", "length").agg(F.min(F.struct("path", "mime")).alias("_f"))
    accepted = first.select("_f.path", "name", "length", "_f.mime")
    return accepted, typed.where(F.col("mime").isNull()).select("path", "name", "length", F.lit("unsupported type").alias("reason"))


def intake_manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """S-6: only names and sizes are read, the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return manifest(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"))
