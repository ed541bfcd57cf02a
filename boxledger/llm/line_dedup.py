"""Line dedup (operator 3): range-partitioned line hashes, streamed in (hash, document, position) order.

Only hashes, ids and positions travel; texts stay where they are. What comes out is one compressed keep bitmap per
document: the lengths of alternating runs of kept and dropped lines, the first run being kept lines (maybe 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.llm.common import cut, partitions, texts

MIN_CHARS = 10
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, document_id, text_id, position): 128 bits of hash for every line whose key has ``min_chars`` code points."""
    rows = documents.where(F.col("document_id").isNotNull()).select("document_id", F.xxhash64("text").alias("text_id"), "text")
    lines = rows.select("document_id", "text_id", F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    keys = lines.select("document_id", "text_id", "position", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "document_id", "text_id", "position")


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """(document_id, text_id, position) of every line whose key stands in a smaller document.

    Hashes are range-partitioned with a secondary sort by document and position, and a window streams through each run:
    a line goes when its document isn't that of the run's first line. A hash with more than a quarter of an average
    partition would fill a task of its own; there are at most four times as many such hashes as partitions, so their
    first documents, found by a pre-aggregated minimum, are broadcast instead.
    """
    parts = partitions(keyed.sparkSession)
    total = keyed.count()
    many = max(1000, total // (4 * parts))
    heavy = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("document_id").alias("first_document")).where(F.col("n") > many)
    heavy = cut(heavy.select("h1", "h2", "first_document"))
    known = F.broadcast(heavy)  # at most 4 x partitions rows, or total / 1000
    of_heavy = keyed.join(known, ["h1", "h2"]).where(F.col("document_id") > F.col("first_document"))
    light = keyed.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
    run = Window.partitionBy("h1", "h2").orderBy("document_id", "position")
    streamed = light.repartitionByRange(parts, "h1", "h2").withColumn("first_document", F.first("document_id").over(run))
    of_light = streamed.where(F.col("document_id") > F.col("first_document"))
    place = ["document_id", "text_id", "position"]
    return of_light.select(*place).unionByName(of_heavy.select(*place))


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document_id, text_id, dropped): the dropped runs (start, length) of every text that loses a line.

    ``documents``: document_id, text (recognised text of a form document; the lines that templates print on every form
    are what goes). Documents without an entry keep all lines, rows without a document_id too. Rows that share a
    document_id are texts of one document and don't drop each other's lines.
    """
    drops = repeated_lines(cut(keyed_lines(documents, min_chars))).distinct()
    place = Window.partitionBy("document_id", "text_id").orderBy("position")
    runs = drops.withColumn("run", F.col("position") - F.row_number().over(place))
    runs = runs.groupBy("document_id", "text_id", "run").agg(F.min("position").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy("document_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("dropped"))


def run_lengths(dropped: Column, n_lines: Column) -> Column:
    """Compressed bitmap: lengths of alternating kept and dropped runs from the dropped (start, length) runs."""
    gaps = F.transform(
        dropped,
        lambda r, i: F.array(r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(dropped, F.greatest(i, F.lit(1))).getField("start") + F.element_at(dropped, F.greatest(i, F.lit(1))).getField("length")), r["length"]),
    )
    last = F.element_at(dropped, -1)
    return F.concat(F.flatten(gaps), F.array((n_lines - last["start"] - last["length"]).cast("int")))


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The lines that a bitmap keeps, joined by a line break."""
    flags = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.array_join(F.zip_with(lines_of(text), flags, lambda line, keep: F.when(keep, line)), "\n")


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document_id, n_lines, n_dropped, keep_runs) of every row of ``documents``, without texts.

    A key of at least ``min_chars`` code points that stands in two or more documents stays only in the smallest
    document_id, with all its lines there. A null or empty text is one empty line; rows without a document_id keep
    all lines.
    """
    return _with_runs(documents, min_chars).drop("text")


def _with_runs(documents: DataFrame, min_chars: int, *more: str) -> DataFrame:
    rows = texts(documents, *more)
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = rows.withColumn("n_lines", n_lines).withColumn("text_id", F.xxhash64("text"))
    joined = rows.join(keep_bitmaps(rows.select("document_id", "text"), min_chars), ["document_id", "text_id"], "left")
    none = F.col("dropped").isNull()
    n_dropped = F.when(none, F.lit(0)).otherwise(F.aggregate("dropped", F.lit(0), lambda a, r: a + r["length"])).cast("long")
    runs = F.when(none, F.array(F.col("n_lines").cast("int"))).otherwise(run_lengths(F.col("dropped"), F.col("n_lines")))
    return joined.select("document_id", "text", *more, "n_lines", n_dropped.alias("n_dropped"), runs.alias("keep_runs"))


def without_repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``documents`` with its kept text and the counts: document_id, text, n_lines, n_dropped, others as they are."""
    more = [c for c in documents.columns if c not in ("document_id", "text")]
    clash = {"n_lines", "n_dropped", "keep_runs", "dropped", "text_id"} & set(more)
    source = documents.withColumnsRenamed({c: f"_{c}" for c in clash})
    rows = _with_runs(source, min_chars, *[f"_{c}" if c in clash else c for c in more])
    changed = F.when(F.col("n_dropped") > 0, kept_text(F.col("text"), F.col("keep_runs"))).otherwise(F.col("text"))
    return rows.withColumn("text", changed).drop("keep_runs")
