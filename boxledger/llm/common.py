"""Small helpers of the text operators: column picks, lineage cuts, hash-ordered samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxledger.session import cut  # noqa: F401

# Bytes of text that one vectorised block takes; the arrays of a block need about 60 times as much.
BLOCK_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """(document_id, text, more...) with a null text as the empty one; other columns never reach a plan."""
    return documents.select("document_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def without_ids(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose document_id is not in ``gone``, whatever their other columns are called.

    The ids are written first: where they are few, the join sees it and no text is shuffled.
    """
    name = f"gone_{uuid.uuid4().hex}"
    ids = cut(gone.select(F.col("document_id").alias(name)).distinct())
    return documents.join(ids, documents["document_id"] == ids[name], "left_anti")


def document_texts(readings: DataFrame) -> DataFrame:
    """One text per document from the readings of its fields (doc_id, page_index, field_id, text), in page and field order.

    Every reading is a line of its own; a document's readings are the fields of one form, so the list stays small.
    """
    row = F.struct("page_index", "field_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"])
    return readings.groupBy(F.col("doc_id").alias("document_id")).agg(F.array_join(lines, "\n").alias("text"))


def fold(document_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold rule of the labelled tables."""
    return F.crc32(document_id.cast("string").cast("binary")) % parts


def first_by_hash(df: DataFrame, id_col: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows, those of the smallest id hashes: a bounded sample that no row order changes.

    Before the top-k, rows beyond a hash bound that about twice the wanted number passes are left out.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    total = df.count()
    share = min(1.0, (2.0 * rows + 200) / max(total, 1))
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    return df.where(key <= F.lit(min(bound, 2**63 - 1))).orderBy(key, *[F.col(c) for c in df.columns]).limit(rows)


def byte_blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that a piece has at most ``BLOCK_BYTES`` of text or a single row."""
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.nbytes
        if sizes <= BLOCK_BYTES:
            if batch.num_rows:
                yield batch
            continue
        lengths = pa.compute.binary_length(column).to_pylist()
        held = 0
        for i, n in enumerate(lengths):
            if i > at and held + (n or 0) > BLOCK_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)
