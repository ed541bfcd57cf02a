"""Benchmark decontamination (operator 8): windows of canonical templates and of plain words, then a check of the slots.

Numbers, names and units become typed placeholders, so that a question with other numbers or names keeps its windows; a
name of several words is one placeholder. Windows of the lower-cased words themselves stand beside them, as case, line
breaks and the words before decide what is taken for a name. Matching windows of a document and an item are aligned
when they follow each other in both and their diagonals lie close together, as edits that change the number of words move
them. The values in the slots of matched windows must map consistently, the same value of the item always to the same value
of the document, unless windows of unchanged words are enough on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.llm.common import cut, texts, without_ids
from boxledger.session import settled

WINDOW = 8  # canonical words
MIN_LITERALS = 4  # words of a window that are no placeholders
MIN_WINDOWS = 5  # aligned windows that make a match, or half of the item's windows if that is less
MAX_STEP = 8  # words by which neighbouring diagonals of a stretch may differ
SHORT_WORDS = 3  # shortest item that is searched, as a whole
BROADCAST_WINDOWS = 500_000  # benchmark windows up to which they are broadcast (16 bytes and an id each)

NUMBER, NAME, UNIT, MORE = "\ue000", "\ue001", "\ue002", "\ue003"  # MORE: a further word of a name
# Units that follow a number.
UNITS = (
    "mm cm m km in ft mi mg g kg lb oz ml l cl s ms min h hr hrs sec day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce "
    "ounces liter liters litre litres dollar dollars cent cents euro euros usd eur gbp percent degree degrees kb mb gb tb hz khz mhz ghz w kw mph kmh"
)
_UNIT_RULE = "(?i)(?<=" + NUMBER + " {0,3})(?:" + "|".join(UNITS.split()) + ")(?![\\p{L}\\p{N}])"


def plain(text: Column) -> Column:
    """Without separators inside numbers, and with a gap between a number and letters that touch it."""
    text = F.regexp_replace(text, "[" + NUMBER + NAME + UNIT + MORE + "]", " ")
    text = F.regexp_replace(text, "(?<=\\p{Nd})[.,](?=\\p{Nd})", "")
    return F.regexp_replace(text, "(?<=\\p{Nd})(?=\\p{L})|(?<=\\p{L})(?=\\p{Nd})", " ")


def template(text: Column) -> Column:
    """Placeholders in place of numbers, of units after them, and of capitalised words inside a sentence; word by word."""
    text = F.regexp_replace(text, "(?<=[\\p{L}\\p{N},;]\\s)\\p{Lu}\\p{Ll}+(?![\\p{L}\\p{N}])", NAME)
    text = F.regexp_replace(text, "(?<=" + NAME + "\\s)" + NAME, MORE)
    text = F.regexp_replace(text, "\\p{Nd}+", NUMBER)
    return F.regexp_replace(text, _UNIT_RULE, UNIT)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}" + NUMBER + NAME + UNIT + MORE + "]+", -1), lambda w: w != "")


def with_templates(rows: DataFrame) -> DataFrame:
    """``raw``: words; ``canon``: canonical words; ``ends``: the place in ``raw``, from 1, of the last word of each of ``canon``."""
    rows = rows.withColumn("_p", plain(F.col("text")))
    rows = rows.withColumn("raw", words_of(F.col("_p"))).withColumn("_c", words_of(template(F.col("_p"))))
    ends = F.filter(F.transform(F.slice("_c", 2, F.size("_c")), lambda w, i: F.when(w != MORE, i + 1)), lambda i: i.isNotNull())
    ends = F.when(F.size("_c") > 0, F.concat(ends, F.array(F.size("_c")))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("canon", F.filter("_c", lambda w: w != MORE)).withColumn("ends", ends).drop("_p", "_c", "text")


def windows(words: Column, size: Column | int) -> Column:
    """First places, from 1, of the windows of ``size`` words."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when((F.size(words) >= size) & (size > 0), F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def has_slots(window: Column) -> Column:
    return F.arrays_overlap(window, F.array(F.lit(NUMBER), F.lit(NAME), F.lit(UNIT)))


def literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda w: ~w.isin(NUMBER, NAME, UNIT)))


def benchmark_windows(benchmark: DataFrame, window: int, min_literals: int, short_words: int) -> DataFrame:
    """(h, w, size, item_id, item_at, item_end, slots, n_windows): all windows of plain words, and template windows with slots.

    ``item_at`` and ``item_end`` are places in the plain words, those at which the first and last word of the window end: the
    words before a name may seem to belong to it in one text and not in the other. A shorter item is one window of its own length. Template
    windows of too many placeholders are left out, unless the item has no others. ``n_windows`` is the smaller number of
    the two kinds, where a template window may be without slots.
    """
    items = with_templates(texts(benchmark.withColumnRenamed("item_id", "document_id")).where(F.col("document_id").isNotNull()))
    items = items.where(F.size("raw") >= short_words)

    def cuts(words: str, at: Column) -> DataFrame:
        size = F.least(F.size(words), F.lit(window))
        spots = items.where(F.size(words) >= short_words).select("document_id", "raw", "ends", F.col(words).alias("words"), size.alias("size"), F.explode(windows(F.col(words), size)).alias("i"))
        return spots.withColumn("w", F.slice("words", F.col("i"), F.col("size"))).withColumn("item_at", at)

    typed = cuts("canon", F.element_at("ends", F.col("i")))
    typed = typed.withColumn("item_end", F.element_at("ends", F.col("i") + F.col("size") - 1))
    rich = typed.withColumn("enough", literals(F.col("w")) >= F.least(F.lit(min_literals), F.col("size")))
    some = rich.groupBy(F.col("document_id").alias("_item")).agg(F.max("enough").alias("any_enough"), F.sum(F.col("enough").cast("int")).alias("n_enough"), F.count("*").alias("n_all"))
    some = some.withColumn("n_windows", F.when(F.col("any_enough"), F.col("n_enough")).otherwise(F.col("n_all")).cast("int"))
    kept = rich.join(some, F.col("document_id") == F.col("_item")).where((F.col("enough") | ~F.col("any_enough")) & has_slots(F.col("w")))
    plainly = cuts("raw", F.col("i")).withColumn("item_end", F.col("i") + F.col("size") - 1).join(some, F.col("document_id") == F.col("_item"), "left")
    n = F.coalesce("n_windows", F.size("words") - F.col("size") + 1)
    columns = ["w", "size", F.col("document_id").alias("item_id"), "item_at", "item_end"]
    return kept.select(F.xxhash64("w").alias("h"), *columns, F.lit(True).alias("slots"), "n_windows").unionByName(
        plainly.select(F.xxhash64("w").alias("h"), *columns, F.lit(False).alias("slots"), n.alias("n_windows"))
    )


def anchored(found: DataFrame) -> DataFrame:
    """The windows of ``found`` with their ``anchor`` and its place ``anchor_at`` (from 0): the word that fewest windows have.

    A text has a window only where it has the window's anchor, so windows are cut around anchors alone. Placeholders are
    taken last, then longer words first, as they are rarer in texts.
    """
    words = found.withColumn("_key", F.xxhash64("h", "size", "item_id", "item_at", "slots")).select("_key", "slots", F.posexplode("w").alias("anchor_at", "anchor"))
    counts = words.groupBy("slots", "anchor").agg(F.count("*").alias("_n"))
    typed = F.col("anchor").isin(NUMBER, NAME, UNIT)
    best = F.min(F.struct(typed.alias("typed"), "_n", (-F.length("anchor")).alias("short"), "anchor_at", "anchor"))
    chosen = words.join(counts, ["slots", "anchor"]).groupBy("_key").agg(best.alias("_b")).select("_key", "_b.anchor", "_b.anchor_at")
    return found.withColumn("_key", F.xxhash64("h", "size", "item_id", "item_at", "slots")).join(chosen, "_key").drop("_key", "w")


def _hits_at_anchors(canon: DataFrame, found: DataFrame) -> DataFrame:
    """Windows of documents that equal a window of ``found``, which is small: its anchors are looked up word by word."""
    words = canon.select("document_id", "raw", "canon", "ends", F.posexplode(F.concat("raw", "canon")).alias("p", "anchor"))
    words = words.withColumn("slots", F.col("p") >= F.size("raw"))
    spots = words.join(F.broadcast(cut(anchored(found))), ["anchor", "slots"])  # at most BROADCAST_WINDOWS rows
    own = F.when(F.col("slots"), F.col("canon")).otherwise(F.col("raw"))
    start = F.col("p") - F.when(F.col("slots"), F.size("raw")).otherwise(0) - F.col("anchor_at") + 1
    inside = (start >= 1) & (start + F.col("size") - 1 <= F.size(own))
    same = F.xxhash64(F.slice(own, F.greatest(start, F.lit(1)), F.col("size"))) == F.col("h")
    at = F.when(F.col("slots"), F.element_at("ends", start)).otherwise(start)
    return spots.where(inside & same).select("document_id", at.alias("at"), "size", "item_id", "item_at", "item_end", "slots", "n_windows")


def _hits_of_all(canon: DataFrame, found: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: all windows of the documents are shuffled to those of the items."""
    hits = None
    for (size,) in found.select("size").distinct().orderBy("size").collect():  # at most ``window`` sizes
        own = found.where(F.col("size") == size).drop("w")
        plainly = F.transform(windows(F.col("raw"), size), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("raw", i, size)).alias("h")))  # noqa: B023
        # A template window without slots is one of plain words.
        slotted = F.filter(windows(F.col("canon"), size), lambda i: has_slots(F.slice("canon", i, size)))  # noqa: B023
        typed = F.transform(slotted, lambda i: F.struct(F.element_at("ends", i).alias("at"), F.xxhash64(F.slice("canon", i, size)).alias("h")))  # noqa: B023
        seen = canon.select("document_id", F.explode(F.concat(plainly, typed)).alias("s")).select("document_id", "s.at", "s.h")
        part = seen.join(own, "h").drop("h")
        hits = part if hits is None else hits.unionByName(part)
    return hits


def _aligned(hits: DataFrame) -> DataFrame:
    """Windows that follow each other, as rows with a ``stretch``: those of one diagonal, and those of diagonals that lie close.

    Close diagonals form one stretch of the windows that come later than all before them in item and document. One
    diagonal counts on its own besides, so that two copies side by side don't spoil each other.
    """
    pair = ["document_id", "item_id"]
    spots = hits.repartition(*pair).groupBy(*pair, "item_at", "at").agg(
        F.max("item_end").alias("item_end"), F.max(F.when(F.col("slots"), F.col("size"))).alias("typed"), F.max(~F.col("slots")).alias("same"), F.min("n_windows").alias("of"), F.max("size").alias("size")
    )
    spots = spots.withColumn("shift", F.col("at") - F.col("item_at"))
    by_shift = Window.partitionBy(*pair).orderBy("shift")
    spots = spots.withColumn("_step", (F.col("shift") - F.lag("shift").over(by_shift) > MAX_STEP).cast("int"))
    spots = spots.withColumn("_group", F.coalesce(F.sum("_step").over(by_shift), F.lit(0)))
    group = Window.partitionBy(*pair, "_group")
    before = group.orderBy("item_at", "at").rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("_many", F.min("shift").over(group) != F.max("shift").over(group)).withColumn("_last", F.max("at").over(before))
    ordered = F.col("_many") & F.coalesce(F.col("at") > F.col("_last"), F.lit(True))
    names = F.array(F.struct(F.lit(False).alias("many"), F.col("shift").cast("long").alias("of")), F.when(ordered, F.struct(F.lit(True).alias("many"), F.col("_group").cast("long").alias("of"))))
    return spots.select(*pair, "item_at", "item_end", "at", "typed", "same", "of", "size", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("stretch"))


def _enough(some: Column, min_windows: int) -> Column:
    """Whether the windows for which ``some`` holds are as many as a match needs, or cover as many words as those would."""
    places = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(some, F.sequence("item_at", "item_end"))))))
    need = F.least(F.lit(min_windows), F.ceil(F.max("of") / 2))
    return (F.count_distinct(F.when(some, F.col("item_at"))) >= need) | (places >= need + F.max("size") - 1)


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_literals: int = MIN_LITERALS,
    min_windows: int = MIN_WINDOWS,
    short_words: int = SHORT_WORDS,
) -> DataFrame:
    """One row per (document_id, item_id) whose texts share an aligned stretch of windows.

    ``documents``: document_id, text (recognised text of a form document); ``benchmark``: item_id, text. Columns:
    document_id, item_id, n_windows (most windows of one stretch), n_slots (slots in its matched template windows),
    n_changed (slots with another value than in the item). A stretch has ``min_windows`` windows, or half of the item's
    if that is less, or covers as many words as these would. Stretches whose slot values don't map consistently from item to
    document count only if their windows of unchanged words are enough alone. Null texts and ids match nothing, repeated
    rows count once. The tables made on the way are deleted once the result is written.
    """
    return settled(documents.sparkSession, lambda: _contaminated(documents, benchmark, window, min_literals, min_windows, short_words))


def _contaminated(documents: DataFrame, benchmark: DataFrame, window: int, min_literals: int, min_windows: int, short_words: int) -> DataFrame:
    found = cut(benchmark_windows(benchmark, window, min_literals, short_words))
    rows = texts(documents).where(F.col("document_id").isNotNull())
    canon = with_templates(rows)
    # The benchmark is broadcast only while its counted windows stay below the bound, else both sides are shuffled.
    hits = _hits_at_anchors(canon, found) if found.count() <= BROADCAST_WINDOWS else _hits_of_all(canon, found)
    template_hits = F.when(F.col("typed").isNotNull(), F.struct("item_at", "at", "typed"))
    runs = _aligned(hits).groupBy("document_id", "item_id", "stretch").agg(
        F.count_distinct("item_at").alias("n"), _enough(F.lit(True), min_windows).alias("enough"), _enough(F.col("same"), min_windows).alias("unchanged"), F.collect_list(template_hits).alias("hits")
    )
    runs = cut(runs.where("enough").drop("enough"))
    # Only documents with a stretch are looked at again, for the words in the slots.
    marked = runs.select("document_id").distinct()
    words = with_templates(rows.join(marked, "document_id", "left_semi")).select("document_id", F.col("raw").alias("d_raw"), F.col("ends").alias("d_ends"))
    items = with_templates(texts(benchmark.withColumnRenamed("item_id", "document_id")).where(F.col("document_id").isNotNull()))
    items = items.select(F.col("document_id").alias("item_id"), F.col("raw").alias("i_raw"), F.col("canon").alias("i_canon"), F.col("ends").alias("i_ends"))
    both = runs.join(items, "item_id").join(words, "document_id")

    def value(side: str, k: Column) -> Column:
        end = F.element_at(f"{side}_ends", k)
        before = F.when(k > 1, F.element_at(f"{side}_ends", F.greatest(k - 1, F.lit(1)))).otherwise(0)
        return F.array_join(F.slice(f"{side}_raw", before + 1, end - before), " ")

    def slots_of(hit: Column) -> Column:
        i, d = F.array_position("i_ends", hit["item_at"]).cast("int"), F.array_position("d_ends", hit["at"]).cast("int")
        places = F.filter(F.sequence(F.lit(0), hit["typed"] - 1), lambda j: F.element_at("i_canon", i + j).isin(NUMBER, NAME, UNIT))
        return F.transform(places, lambda j: F.struct((i + j).alias("i"), F.element_at("i_canon", i + j).alias("kind"), value("i", i + j).alias("item"), value("d", d + j).alias("doc")))

    checked = both.select("document_id", "item_id", "n", "unchanged", F.array_distinct(F.flatten(F.transform("hits", slots_of))).alias("slots"))
    maps = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["item"].alias("item"), F.concat(F.lit(" "), s["doc"], F.lit(" ")).alias("doc"))))
    checked = checked.withColumn("maps", maps)

    # A name with a capitalised word beside it is still that name.
    def clash(a: Column, b: Column) -> Column:
        return (a["kind"] == b["kind"]) & (a["item"] == b["item"]) & ~a["doc"].contains(b["doc"]) & ~b["doc"].contains(a["doc"])

    consistent = checked.where(F.col("unchanged") | ~F.exists("maps", lambda a: F.exists("maps", lambda b: clash(a, b))))
    changed = F.size(F.array_distinct(F.transform(F.filter("slots", lambda s: ~s["item"].eqNullSafe(s["doc"])), lambda s: s["i"])))
    count = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    best = F.max(F.struct(F.col("n"), (-changed).alias("kept"), count.alias("slots")))
    top = consistent.groupBy("document_id", "item_id").agg(best.alias("b"))
    return top.select("document_id", "item_id", F.col("b.n").alias("n_windows"), F.col("b.slots").cast("long").alias("n_slots"), (-F.col("b.kept")).cast("long").alias("n_changed"))


def clean_of_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item, columns unchanged; rows without an id stay."""
    return without_ids(documents, contaminated(documents, benchmark))
