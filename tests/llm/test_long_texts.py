"""Texts longer than a vectorised block: taken whole by the operators, to the last word."""

from __future__ import annotations

import public_tokenizers

from boxledger.llm import decontaminate, language, line_dedup, shingle_join, token_counts
from boxledger.llm.common import BLOCK_BYTES
from tests.llm.forms import documents

ITEM = "The auditor of Lübeck counted 418 crates of dried figs before the third ferry left the northern quay at dawn"
WORDS = [f"wort{i}" for i in range(250_000)]
LONG = " ".join(WORDS) + "\nthe very last line of it\n" + ITEM
ROWS = [(1, "the very last line of it"), (2, LONG), (3, None), (4, " ".join(WORDS[:-3]))]


def test_long_texts_are_read_to_the_end(spark):
    assert len(LONG) > BLOCK_BYTES
    docs = documents(spark, ROWS)
    sets = {r.document_id: r for r in shingle_join.linked_components(docs).collect()}
    assert sets[2].n_shingles == len(WORDS) + 6 + len(ITEM.split()) - 2 and sets[4].component_id == 2
    kept = {r.document_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert (kept[2].n_lines, kept[2].n_dropped) == (3, 1) and kept[2].text == LONG.replace("\nthe very last line of it", "")
    items = spark.createDataFrame([("i1", ITEM)], "item_id string, text string")
    assert [(r.document_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(2, "i1")]
    trees = language.build_trees({"x": [b"wort12 wort34 " * 50], "y": [b"quite other things here " * 50]})
    assert {r.document_id: r.lang_pred for r in language.identify_language(docs, trees).collect()} == {1: "y", 2: "x", 3: language.UNKNOWN, 4: "x"}
    counts = {r.document_id: r for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts[2].n_bytes == len(LONG.encode()) and counts[2].n_tokens > len(WORDS) and counts[3].n_tokens == 0
