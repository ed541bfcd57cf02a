"""Token counts (operator 6): batch encoding in Arrow functions that return lengths only.

Rows are cut into batches of about equal bytes, and long texts into windows of them. Both are split at safe boundaries, so
that the counts of the pieces add up to that of the whole text (``llm.encode``); each different piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, texts
from boxledger.llm.encode import encoder

LIMIT = 512


def token_counts(documents: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """(document_id, n_bytes, n_tokens, over_limit) of every document text.

    ``documents``: document_id, text (recognised text of a form document). ``tokenizer_file``: a ``.json`` of the
    tokenizers library or a ``.model`` of sentencepiece, at a path that every executor has. Nothing is truncated, no
    begin or end token is added, special strings inside texts count as the library has it by default. Null and empty
    texts have no token; repeated rows stay. Texts of any length are counted whole, a window at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer_file)
        for batch in byte_blocks(batches):
            n = counter.count(batch.column(1))
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["document_id", "n_bytes", "n_tokens", "over_limit"])

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(count, "document_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
