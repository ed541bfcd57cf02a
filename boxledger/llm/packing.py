"""Packing (operator 12): first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut every ``size`` ids. Full pieces are sequences of their own; the last pieces of the documents are
packed by decreasing length, each into the first sequence of its group that has room. The tree over a group's sequences
holds the largest room below each node, so the first sequence with enough room is found by one descent. Groups are dealt by
a hash of the row, not of its id, so no key crowds one of them; each is packed on its own, and only lengths are shuffled
unless the caller carries the ids along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxledger.llm.common import byte_blocks, cut, texts
from boxledger.llm.encode import encoder

SIZE = 1024
END_ID = 0  # follows the ids of a document
GROUP_PIECES = 20_000  # pieces of a group, about


def token_pieces(documents: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(document_id, row, start, length, doc_tokens, ids) of the pieces of all document texts.

    ``documents``: document_id, text (recognised text of a form document). A document's ids are those of ``tokenizer_file``
    (as in ``token_counts``, without added tokens) and ``end_id``, at once 1 for a null or empty text; a piece holds
    ``size`` of them, the last one what is left. ``ids``: the piece's ids as little-endian unsigned 32-bit integers. ``row``
    is a number of the input row: rows that share a document_id, or have none, stay apart.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_file)
        row = TaskContext.get().partitionId() << 33
        for batch in byte_blocks(batches):
            ids, borders = tokens.ids(batch.column(1))
            ids = np.insert(ids, borders[1:], end_id).astype("<u4")
            borders = borders + np.arange(len(borders))
            lengths = np.diff(borders)
            pieces = -(-lengths // size)
            owner = np.repeat(np.arange(len(lengths)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            length = np.minimum(size, lengths[owner] - start)
            offsets = np.append(borders[owner] + start, borders[-1]) * 4
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            columns = [batch.column(0).take(pa.array(owner)), pa.array(row + owner), pa.array(start), pa.array(length), pa.array(lengths[owner]), packed]
            row += batch.num_rows
            whole = pa.RecordBatch.from_arrays(columns, names=["document_id", "row", "start", "length", "doc_tokens", "ids"])
            for at in range(0, len(owner), 4096):
                some = whole.slice(at, 4096)
                yield some.set_column(5, "ids", some.column(5).cast(pa.binary()))

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(spell, "document_id bigint, row bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every length: by decreasing length, equal ones in order, into the first sequence with room."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [size] * (2 * leaves)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        sequence[i], offset[i] = node - leaves, size - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return sequence, offset


def pack_pieces(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset: where each piece lies; all other columns are carried along.

    ``pieces``: row, start, length (1 to ``size``), and any more columns, as ``token_pieces`` gives them; none of them may
    be called sequence_id or offset. Pieces of a sequence follow each other without a gap from offset 0. The groups are
    fixed by ``row`` and the number of pieces; in a group ties go by row and start. An empty table gives no sequence.
    """
    stored = cut(pieces)
    groups = max(1, -(-stored.count() // group_pieces))
    dealt = stored.withColumn("sequence_id", F.pmod(F.xxhash64(F.lit(12), "row"), F.lit(groups)))
    schema = T.StructType([*stored.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("start", "ascending")])
        number = group.column("sequence_id")[0].as_py()
        lengths = group.column("length").to_numpy()
        full = lengths == size
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        sequence[~full], offset[~full] = first_fit_decreasing(lengths[~full], size)
        used = sequence[~full].max(initial=-1) + 1
        sequence[full] = used + np.arange(full.sum())
        at = group.schema.get_field_index("sequence_id")
        return group.set_column(at, "sequence_id", pa.array((number << 32) + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("sequence_id").applyInArrow(pack, schema)


def sequence_table(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, padded_tokens, ids): the sequences themselves.

    ``packed``: what ``pack_pieces`` gives for pieces with their ids. A sequence is padded to ``size`` unless its length is
    a power of two; ``ids`` has no padding.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``size`` pieces
    out = packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    padded = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(size).cast("bigint"))
    return out.select("sequence_id", "n_pieces", "n_tokens", padded.alias("padded_tokens"), ids.alias("ids"))
