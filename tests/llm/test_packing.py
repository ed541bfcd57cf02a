"""Token ids by pieces and packing (operators 6 and 12) against the library and a plain first-fit decreasing."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxledger.llm import encode, packing
from boxledger.llm.common import document_texts
from tests.llm.forms import AWKWARD, documents, with_clashes

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
ODD = [" ", "  ", "\n", "\t", " ", "　", " ", " ", "\u0085", "\x1c", "​", "a", "é", "ß", "“", "–", "don't", "<|endoftext|>", "12", "…", "漢", "😀", ".", "'s"]


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts_are_those_of_the_library(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(2000)] + [None, ""]
    coder = encode.Encoder(JSON)
    for window in (encode.WINDOW, 64):
        monkeypatch.setattr(encode, "WINDOW", window)
        flat, borders = coder.ids(pa.array(texts))
        for i, text in enumerate(texts):
            assert flat[borders[i] : borders[i + 1]].tolist() == ids_of(text), repr(text)
        assert coder.count(pa.array(texts)).tolist() == np.diff(borders).tolist()


def test_long_text_is_taken_in_windows():
    rng = random.Random(6)
    text = "".join(f"{'  ' if rng.random() < 0.2 else ' '}w{rng.randrange(3000)}" for _ in range(400_000))
    assert len(text) > 2 * encode.WINDOW
    coder = encode.Encoder(JSON)
    pieces = list(coder._windows(encode.Texts(pa.array([text]))))
    assert len(pieces) > 2 and all(len(b) > 1000 for _, b in pieces)
    flat, _ = coder.ids(pa.array([text]))
    assert flat.tolist() == ids_of(text)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_first_fit_decreasing_equals_the_plain_one(n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 1024, n)
    sequence, offset = packing.first_fit_decreasing(lengths, 1024)
    room: list[int] = []
    for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [1024] * (k == len(room))
        assert (sequence[i], offset[i]) == (k, 1024 - room[k])
        room[k] -= lengths[i]


def check_packed(rows: list, expected: dict[int, list[list[int]]], size: int) -> None:
    """Every document's ids lie in its pieces once and in order, and every sequence is gapless."""
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault((r.document_id, r.row), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    found: dict[int, list[list[int]]] = {}
    for (document, _), pieces in by_row.items():
        pieces.sort(key=lambda r: r.start)
        ids = [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert all(r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in pieces)
        found.setdefault(document, []).append(ids)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= size


def test_form_documents_are_packed_whole(spark):
    rng = random.Random(7)
    readings = [(d, p, f"f{k}", f"total {rng.randrange(10**6)} paid  to w{rng.randrange(50)}") for d in range(60) for p in range(rng.randrange(1, 4)) for k in range(rng.randrange(1, 9))]
    docs = document_texts(spark.createDataFrame(readings, "doc_id bigint, page_index int, field_id string, text string"))
    docs = docs.unionByName(documents(spark, AWKWARD))
    expected: dict[int, list[list[int]]] = {}
    for r in docs.collect():
        expected.setdefault(r.document_id, []).append([*ids_of(r.text), 0])
    pieces = packing.token_pieces(with_clashes(docs, "row", "start", "sequence_id", "ids"), JSON, size=64)
    packed = packing.pack_pieces(pieces, size=64, group_pieces=50)
    rows = packed.collect()
    check_packed(rows, expected, 64)
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    sequences = packing.sequence_table(packed, 64)
    got = {r.sequence_id: r for r in sequences.collect()}
    assert sum(r.n_tokens for r in got.values()) == sum(len(x) for v in expected.values() for x in v)
    assert all(len(r.ids) == 4 * r.n_tokens and r.padded_tokens == (r.n_tokens if r.n_tokens.bit_count() == 1 else 64) for r in got.values())
    one = [r for r in rows if r.sequence_id == rows[0].sequence_id]
    assert got[rows[0].sequence_id].ids == b"".join(r.ids for r in sorted(one, key=lambda r: r.offset))


def test_no_documents_give_no_sequence(spark):
    packed = packing.pack_pieces(packing.token_pieces(documents(spark, []), JSON))
    assert packed.count() == 0 and {"sequence_id", "offset"} <= set(packed.columns)


def test_one_hot_id_is_spread_over_groups(spark):
    docs = documents(spark, [(7, f"w{i}") for i in range(400)])
    packed = packing.pack_pieces(packing.token_pieces(docs, JSON), group_pieces=40)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 100
