"""N-gram Jaccard join (operator 2): size-aware heavy-light join of shingle sets, with components of linked documents.

Equal sets form classes first; one document stands for each class. Two different sets A, B link when
``100 |A n B| >= percent |A u B|``, so at most ``d = |A ^ B| <= (100 - percent) / (100 + percent) * (|A| + |B|)`` elements differ.

* Small sets enumerate fixed-size subsets: for every size m that a partner may have, all subsets of the c elements that
  the two must share. Small linked sets have such a subset in common.
* Large sets go into inverted lists and scan them. Shingles of five words and more hardly recur by chance, so their lists
  hold single shingles: under one order of all shingles, two linked sets have one in common among the first
  ``n - ceil(percent n / 100) + 1`` of each. The order puts heavy shingles last: those that a bounded sample of documents
  (``ORDER_SAMPLE``) shows in several of them; any choice of them finds every link. Shorter shingles recur, so their lists
  hold blocks: in the size range of a set the hash space is cut into so many blocks that two linked sets agree in at least
  ``SPARE + 1`` of them, and a list is keyed by its block's whole content. A block with fewer than two elements is skipped
  unless a set has more than ``SPARE`` of them.
* The boundary between small and large is the size up to which a set's subsets cost no more than its list entries, an
  entry counting ``ENTRY_COST`` subsets because what lists find has to be checked on whole sets.

Lists give candidates. A candidate pair first meets a bitmap of both sets, each bit the parity of the elements that fall on
it: linked sets differ in no more bits than elements. What passes is checked on the whole sets. Short lists give all their
pairs. The members of a long list first meet its smallest member; lists whose members are then still in several components are
cut by size, as linked sets differ little in it. Parts that are short then give all their pairs; the members of the others
meet a central member, the pivot, and what is left is joined on the differences E = A ^ pivot: as ``|A ^ B| = |E_A ^ E_B|``,
two members that do not both link with the pivot can link only if they share a good part of their differences, so short
prefixes of the differences are all that has to meet. A crowd of texts that stem from one template and are too far from
each other to link thus forms no pairs, and no link is lost that a component depends on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxledger.llm.common import byte_blocks, cut, first_by_hash, partitions, texts, without_ids
from boxledger.llm.components import components
from boxledger.llm.textarrays import Texts, U, mix, row_of, windows
from boxledger.session import settled

SHINGLE = 3
PERCENT = 90
ENTRY_COST = 10
SINGLE_FROM = 5  # words of a shingle from which on lists hold single shingles
SPARE = 1
RANGE = 1.35  # ratio of the largest to the smallest size of a size range
SHORT_LIST = 8  # members of a list that gives all its pairs
BITMAP = 1024  # bits, at least
LARGEST_BOUNDARY = 40
ORDER_SAMPLE = 32_000  # documents
HEAVY_DOCUMENTS = 2  # sampled documents that make a shingle heavy
HEAVY_SHINGLES = 300_000  # at most; those in most documents


def needed(n: int, m: int, percent: int) -> int:
    """Elements that sets of n and m elements must share to link."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes c of the subsets that a small set of n elements enumerates; pairs of equal size and c = n are the same set."""
    return sorted({c for m in partner_sizes(n, percent) if (c := needed(n, m, percent)) <= min(n, m) and (m != n or c < n)})


def differing(total: int, percent: int) -> int:
    """Most elements in which two linked sets of ``total`` elements together may differ."""
    return (100 - percent) * total // (100 + percent)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """List entries of sets of n shingles."""
    return n + (-percent * n) // 100 + 1


def boundary(percent: int) -> int:
    """Largest size of a small set: up to it, enumerating subsets costs no more than list entries."""
    best = 0
    for n in range(1, LARGEST_BOUNDARY + 1):
        subsets = sum(math.comb(n, c) for c in subset_sizes(n, percent))
        if subsets > ENTRY_COST * int(prefix_size(np.array(n), percent)):
            break
        best = n
    return best


def size_ranges(lowest: int, largest: int) -> list[tuple[int, int]]:
    out, lo = [], max(1, lowest)
    while lo <= largest:
        hi = max(lo, int(lo * RANGE))
        out.append((lo, hi))
        lo = hi + 1
    return out


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and their row borders."""
    start, end, borders = t.words()
    hashes = t.span_hashes(start, end)
    grams, row, _ = windows(hashes, borders, size)
    n = np.diff(borders)
    for i in np.flatnonzero((n > 0) & (n < size)):  # the whole sequence is the only shingle
        h = np.array([n[i]], np.uint64)
        for k in range(borders[i], borders[i + 1]):
            h = mix(h * U(0xD6E8FEB86659FD93) + hashes[k : k + 1])
        grams, row = np.append(grams, h), np.append(row, i)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[fresh], row[fresh]
    return grams, np.searchsorted(row, np.arange(t.rows + 1))


def block_entries(grams: np.ndarray, borders: np.ndarray, percent: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the blocks of sets with at least ``lowest`` elements."""
    sizes = np.diff(borders)
    weights = mix(grams)
    largest = int(sizes.max(initial=0))
    out_sig, out_row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if largest < lowest:
        return out_sig[0], out_row[0]
    row = row_of(borders)
    for place, (lo, hi) in enumerate(size_ranges(lowest, int(largest * RANGE) + 2)):
        # A set is in its own range, and in the next one where a partner there may be.
        inside = (sizes >= min(lo, -(-percent * lo // 100))) & (sizes <= hi)
        if not inside.any():
            continue
        blocks = differing(2 * hi, percent) + 1 + SPARE
        mine = inside[row]
        g, r = grams[mine], row[mine]
        salt = mix(np.array([place + 1], np.uint64))
        block = (mix(g ^ salt) % U(blocks)).astype(np.int64)
        key = r * blocks + block
        order = np.argsort(key, kind="stable")
        key, w = key[order], weights[mine][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        content = np.add.reduceat(w, first) if len(first) else np.zeros(0, np.uint64)
        count = np.diff(np.append(first, len(key)))
        owner, block = key[first] // blocks, key[first] % blocks
        strong = count > 1
        weak = blocks - np.bincount(owner[strong], minlength=len(sizes))
        kept = strong | (weak[owner] > SPARE)
        sig = mix(content ^ mix(np.uint64(place << 32) + block.astype(np.uint64) + salt))
        out_sig.append(sig[kept])
        out_row.append(owner[kept])
        for i in np.flatnonzero(inside & (weak > SPARE)):  # their empty blocks agree, too
            empty = np.setdiff1d(np.arange(blocks), block[owner == i])
            out_sig.append(mix(np.uint64(place << 32) + empty.astype(np.uint64) + salt))
            out_row.append(np.full(len(empty), i))
    return np.concatenate(out_sig), np.concatenate(out_row)


def is_heavy(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Membership in the sorted array ``heavy``; a small table of low bits turns most shingles away at once."""
    mask = U((1 << 20) - 1)
    table = np.zeros(1 << 20, bool)
    table[(heavy & mask).astype(np.int64)] = True
    out = table[(grams & mask).astype(np.int64)]
    maybe = np.flatnonzero(out)
    if len(maybe):
        at = np.minimum(np.searchsorted(heavy, grams[maybe]), len(heavy) - 1)
        out[maybe] = heavy[at] == grams[maybe]
    return out


def signatures(grams: np.ndarray, borders: np.ndarray, percent: int, small: int, heavy: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): subsets of small sets, list entries of large ones and of small ones that may link to large.

    Without ``heavy`` lists are keyed by blocks, else by single shingles with the heavy ones last.
    """
    sizes = np.diff(borders)
    out_sig: list[np.ndarray] = []
    out_row: list[np.ndarray] = []
    for i in np.flatnonzero((sizes > 1) & (sizes <= small)):
        own, n = mix(grams[borders[i] : borders[i + 1]]), int(sizes[i])
        sums: list[np.ndarray] = []
        for c in subset_sizes(n, percent):
            if c == n:
                total = own.sum(dtype=np.uint64, keepdims=True)
            else:
                left_out = np.array(list(itertools.combinations(range(n), n - c)))
                total = own.sum(dtype=np.uint64) - own[left_out].sum(1, dtype=np.uint64)
            sums.append(mix(total ^ mix(np.array([c], np.uint64))))
        if sums:
            out_sig.append(np.concatenate(sums))
            out_row.append(np.full(len(out_sig[-1]), i))
    lowest = -(-percent * (small + 1) // 100)
    if heavy is None:
        sig, row = block_entries(grams, borders, percent, lowest)
        return np.concatenate([*out_sig, sig]), np.concatenate([*out_row, row])
    listed = sizes >= lowest
    row = row_of(borders)
    mine = np.flatnonzero(listed[row])
    g, r = grams[mine], row[mine]
    order = np.lexsort((g, is_heavy(g, heavy), r))
    g, r = g[order], r[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    first = place < prefix_size(sizes, percent)[r]
    out_sig.append(g[first])
    out_row.append(r[first])
    return np.concatenate(out_sig), np.concatenate(out_row)


def heavy_shingles(documents: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of at most ``HEAVY_SHINGLES`` shingles that several of ``ORDER_SAMPLE`` documents have.

    Only the lowest quarter of the hashes is looked at: prefixes hardly reach beyond.
    """
    ids = first_by_hash(documents.where(F.col("document_id").isNotNull()).select("document_id").distinct(), "document_id", ORDER_SAMPLE, seed=2)
    sampled = texts(documents).join(F.broadcast(ids), "document_id")  # bounded by ORDER_SAMPLE
    counted = shingle_table(sampled, shingle).select(F.explode(F.filter("shingles", lambda h: (h >= 0) & (h < 2**62))).alias("h")).groupBy("h").count().where(F.col("count") >= HEAVY_DOCUMENTS)
    found = counted.orderBy(F.desc("count"), "h").limit(HEAVY_SHINGLES).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) else np.zeros(1, np.uint64)


def shingle_order(documents: DataFrame, shingle: int) -> Broadcast:
    """The heavy shingles, sent to all tasks (at most ``HEAVY_SHINGLES``); None where lists hold blocks."""
    return documents.sparkSession.sparkContext.broadcast(heavy_shingles(documents, shingle) if shingle >= SINGLE_FROM else None)


def bitmaps(grams: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the sets as 64-bit words, and their row borders.

    A bitmap has at least ``BITMAP`` bits and as many as the set has elements, a power of two: on a shorter one the
    differences of large sets would cancel out. One of half the length is the two halves laid over each other.
    """
    sizes = np.diff(borders)
    bits = np.maximum(BITMAP, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    row = row_of(borders)
    place = (mix(grams ^ U(0x5BD1E995)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[row] + place, minlength=int(first[-1])) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64), first // 64


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(borders.astype(np.int32), values.view(np.int64))


def set_table(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, heavy: Broadcast | None = None) -> DataFrame:
    """(document_id, n_shingles, f1, f2, bits, signatures): size, 128-bit fingerprint and bitmap of the set, and its lists.

    ``heavy``: what ``shingle_order`` gives, made here if it is not given. Null and empty texts have no shingles and no
    lists; rows that share an id, or have none, stay rows of their own.
    """
    small = boundary(percent)
    heavy = shingle_order(documents, shingle) if heavy is None else heavy

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            grams, borders = shingle_sets(Texts(batch.column(1), lower=True), shingle)
            sums = np.zeros((2, len(grams) + 1), np.uint64)
            np.cumsum(mix(grams), out=sums[0, 1:])
            np.cumsum(mix(grams + U(0x1234567)), out=sums[1, 1:])
            f = sums[:, borders[1:]] - sums[:, borders[:-1]]
            sig, row = signatures(grams, borders, percent, small, heavy.value)
            order = np.argsort(row, kind="stable")
            sig_borders = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            bits, bit_borders = bitmaps(grams, borders)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(borders)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), _lists(bits, bit_borders), _lists(sig[order], sig_borders)],
                names=["document_id", "n_shingles", "f1", "f2", "bits", "signatures"],
            )

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(describe, "document_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bits array<bigint>, signatures array<bigint>")


def shingle_table(documents: DataFrame, shingle: int = SHINGLE, heavy: Broadcast | None = None) -> DataFrame:
    """(document_id, shingles): the sets themselves as arrays of hashes, in the order of the lists: heavy ones last."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches):
            grams, borders = shingle_sets(Texts(batch.column(1), lower=True), shingle)
            if heavy is not None and heavy.value is not None:
                grams = grams[np.lexsort((grams, is_heavy(grams, heavy.value), row_of(borders)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(grams, borders)], names=["document_id", "shingles"])

    ids = texts(documents).withColumn("document_id", F.col("document_id").cast("bigint"))
    return ids.mapInArrow(spell, "document_id bigint, shingles array<bigint>")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to link."""
    left = sets.select(F.col("document_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("x"))
    right = sets.select(F.col("document_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def folded(own: str, other: str) -> Column:
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(own))

    # Sizes that may link differ by less than two, so their bitmaps by one halving at most.
    apart = F.aggregate(F.zip_with(folded("x", "y"), folded("y", "x"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + F.coalesce(k, F.lit(0)))
    return near.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def short_and_long(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists (sig, pivot, member) of at most ``SHORT_LIST`` members, and the others."""
    sizes = lists.groupBy("sig").agg((F.count("*") + 1).alias("size"))
    sized = cut(lists.join(sizes, "sig"))
    return sized.where(F.col("size") <= SHORT_LIST).drop("size"), sized.where(F.col("size") > SHORT_LIST).drop("size")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, checked on the whole sets."""
    left = sets.select(F.col("document_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("document_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    nx, ny = F.size("x"), F.size("y")
    near = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (nx > 0) & (ny > 0)
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(near).select("a", "b", nx.alias("nx"), ny.alias("ny"), shared.alias("s")).where(100 * F.col("s") >= percent * (F.col("nx") + F.col("ny") - F.col("s"))).select("a", "b")


def long_lists(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig) of the lists that a hash sample of the class representatives shows to be long.

    At most 4 x partitions lists hold the share of the sampled entries that makes a list long, so the result is small.
    This only decides how lists are dealt over tasks, not what comes out.
    """
    own = sets.where(F.pmod(F.xxhash64("document_id"), F.lit(32)) == 0)
    own = own.join(classes, ["f1", "f2"]).where("document_id = class_id").select(F.explode(F.array_distinct("signatures")).alias("sig"))
    counted = own.groupBy("sig").count()
    threshold = max(64, (counted.agg(F.sum("count")).first()[0] or 0) // (4 * partitions(sets.sparkSession)))
    return cut(counted.where(F.col("count") > threshold).select("sig"))


def pivot_lists(entries: DataFrame, known_long: DataFrame) -> DataFrame:
    """(sig, pivot, member) for the members of each list other than its smallest; ``entries``: sig, member.

    A list streams through a window in order of members. Long lists are dealt over salts, whose first members then meet
    the smallest of them.
    """
    salt = F.pmod(F.xxhash64("member", F.lit(1)), F.lit(64))
    salted = entries.join(F.broadcast(known_long.withColumn("long", F.lit(True))), "sig", "left").withColumn("salt", F.when(F.col("long"), salt).otherwise(F.lit(0)))
    order = Window.partitionBy("sig", "salt").orderBy("member")
    streamed = salted.withColumn("pivot", F.first("member").over(order)).where("member <> pivot").select("sig", "pivot", "member")
    if known_long.isEmpty():
        return streamed
    heads = entries.join(F.broadcast(known_long), "sig").groupBy("sig", salt.alias("salt")).agg(F.min("member").alias("member"))
    least = heads.groupBy("sig").agg(F.min("member").alias("pivot"))  # at most 64 heads a list
    return streamed.unionByName(heads.join(least, "sig").where("member <> pivot").select("sig", "pivot", "member"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("id", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))


def _split_lists(everyone: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (sig, member, ...) with their component, of lists whose members are in several components."""
    own = _labelled(everyone, labels)
    split = own.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return cut(own.join(split, "sig"))


def band_of(n: Column, percent: int) -> Column:
    """Size band: sizes of linked sets lie in the same or in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(math.log(100.1 / percent))).cast("int")


def _size_bands(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The lists cut by size: each member goes to the part of its band and to the next one, where smaller partners may be."""
    sized = own.join(sets.select(F.col("document_id").alias("member"), "n_shingles"), "member")
    band = band_of(F.col("n_shingles"), percent)
    return sized.select("sig", "member", F.explode(F.array(band, band + 1)).alias("band")).select(F.xxhash64("sig", "band").alias("sig"), "member").distinct()


def _central(own: DataFrame) -> DataFrame:
    """(sig, pivot): the member of each list that shares most list places with others."""
    sizes = own.groupBy("sig").agg(F.count("*").alias("size"))
    scores = own.join(sizes, "sig").groupBy("member").agg(F.sum("size").alias("score"))
    return own.select("sig", "member").join(scores, "member").groupBy("sig").agg(F.max_by("member", F.struct("score", -F.col("member"))).alias("pivot"))


def difference_candidates(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that may link, from differences to a pivot of their group.

    ``groups``: pivot, member, component, home (the pivot's component). With d = |E| and t = (100 - percent) / (100 +
    percent): a member x that is not in the pivot's component has d_x > t (|x| + |pivot|). For a link |x ^ y| <=
    t (|x| + |y|), hence the shared part o of the differences satisfies 2 o >= d_x + d_y - t (|x| + |y|), and

    * seen from y, if x is such a member: 2 o > d_y + t (|pivot| - |y|);
    * seen from any x: o >= d_x - D_x, where D_x = |x| (100 - percent) / percent is the most that a partner may differ.

    Under one order of the elements (those not in the pivot first) the first d - o + 1 of both must have one in common.
    """
    left = sets.select(F.col("document_id").alias("pivot"), F.col("shingles").alias("c"))
    right = sets.select(F.col("document_id").alias("member"), F.col("shingles").alias("x"))
    rows = groups.join(left, "pivot").join(right, "member")
    rows = rows.select("pivot", "member", "component", (F.col("component") != F.col("home")).alias("far"), F.size("x").alias("n"), F.size("c").alias("nc"), F.concat(F.array_except("x", "c"), F.array_except("c", "x")).alias("e"))
    d = F.size("e")
    strict = F.floor((d * (100 + percent) + (F.col("nc") - F.col("n")) * (100 - percent)) / F.lit(2 * (100 + percent))) + 1
    near_enough = d - F.floor(F.col("n") * (100 - percent) / F.lit(percent))
    one = F.lit(1)
    short = F.greatest(one, d - F.when(F.col("far"), F.greatest(one, strict, near_enough)).otherwise(F.greatest(one, strict)) + 1)
    wide = F.greatest(one, d - F.greatest(one, near_enough) + 1)
    band = band_of(F.col("n"), percent)
    described = ["pivot", "member", "component", "far", "n", d.alias("d"), band.alias("band")]
    rows = cut(rows.where(d > 0).select(*described, F.slice("e", one, short.cast("int")).alias("short"), F.when(F.col("far"), F.slice("e", one, wide.cast("int"))).alias("wide")))

    def spelled(df: DataFrame, prefix: str, side: str, bands: Column) -> DataFrame:
        named = df.select("pivot", F.posexplode(prefix).alias("p", "e"), bands.alias("band"), *[F.col(c).alias(f"{side}_{c}") for c in ("member", "component", "n", "d")])
        return named.select(*[c for c in named.columns if c != "p"], (F.col(f"{side}_d") - F.col("p")).alias(f"{side}_rest"))

    # What two sets must share of their differences: with the first shared element at p and q, at most the rest behind is shared.
    t = (100 - percent) / (100 + percent)
    needs = (F.col("x_d") + F.col("y_d") - F.lit(t) * (F.col("x_n") + F.col("y_n"))) / 2
    fits = (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (F.least("x_rest", "y_rest") >= needs - F.lit(1e-6))
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    far, near = rows.where("far"), rows.where(~F.col("far"))
    own = far.withColumn("_b", around)
    probes = spelled(own, "wide", "x", F.col("_b")).join(spelled(near, "short", "y", F.col("band")), ["pivot", "e", "band"]).where(fits)
    others = spelled(own, "short", "x", F.col("_b")).join(spelled(far, "short", "y", F.col("band")), ["pivot", "e", "band"]).where(fits & (F.col("x_component") < F.col("y_component")))
    pairs = probes.select("x_member", "y_member").unionByName(others.select("x_member", "y_member"))
    return pairs.select(F.least("x_member", "y_member").alias("a"), F.greatest("x_member", "y_member").alias("b")).distinct()


def linked_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(document_id, n_shingles, component_id, class_id) for every row of ``documents``.

    ``documents``: document_id, text (recognised text of a form document). A text's words are its runs of characters
    other than 0x20 and 0x09-0x0D, A-Z in lower case; its set holds all distinct ``shingle``-word sequences, or the whole
    sequence when there are fewer words. ``component_id`` is the smallest document_id reachable by links, ``class_id``
    the smallest of those with the same set. Texts without words, or null, link with nothing. Rows that share a
    document_id are one document with the links of all of them; rows without an id have no component. The tables made on
    the way are deleted once the result is written.
    """
    return settled(documents.sparkSession, lambda: _linked_components(documents, shingle, percent))


def _linked_components(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    heavy = shingle_order(documents, shingle)
    sets = cut(set_table(documents, shingle, percent, heavy))
    real = sets.where((F.col("n_shingles") > 0) & F.col("document_id").isNotNull())
    classes = real.groupBy("f1", "f2").agg(F.min("document_id").alias("class_id"))
    members = real.join(classes, ["f1", "f2"])
    entries = members.where("document_id = class_id").select(F.explode(F.array_distinct("signatures")).alias("sig"), F.col("class_id").alias("member"))
    lists = cut(pivot_lists(entries, long_lists(real, classes)))

    short, crowded = short_and_long(lists)
    narrow = real.select("document_id", "n_shingles", "bits")
    others = short.select("sig", F.col("pivot").alias("a"), F.col("member").alias("b"))
    within = others.select("sig", F.col("b").alias("a")).join(others.select("sig", "b"), "sig").where("a < b").select("a", "b")
    stars = lists.select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    pairs = cut(plausible(stars.unionByName(within).distinct(), narrow, percent))

    def whole_sets(ids: DataFrame) -> DataFrame:
        """The sets of some documents, whose texts are read again for them."""
        wanted = cut(ids.select(F.col(ids.columns[0]).alias("document_id")).distinct())
        return cut(shingle_table(texts(documents).join(wanted, "document_id", "left_semi"), shingle, heavy))

    def both(found: DataFrame) -> DataFrame:
        return found.select(F.explode(F.array("a", "b")).alias("document_id"))

    edges = cut(linked(pairs, whole_sets(both(pairs)), percent))
    labels = components(edges)
    everyone = crowded.select("sig", F.col("pivot").alias("member")).unionByName(crowded.select("sig", "member")).distinct()
    own = _split_lists(everyone, labels)
    if not own.isEmpty():
        own = _split_lists(_size_bands(own, narrow, percent), labels)
        counts = own.groupBy("sig").agg(F.count("*").alias("size"))
        sized = cut(own.join(counts, "sig"))
        few, many = sized.where(F.col("size") <= SHORT_LIST), sized.where(F.col("size") > SHORT_LIST).drop("size")
        left, right = few.select("sig", F.col("member").alias("a"), F.col("component").alias("ca")), few.select("sig", F.col("member").alias("b"), F.col("component").alias("cb"))
        together = left.join(right, "sig").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b")
        pivots = cut(_central(many))
        met = many.join(pivots, "sig").join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("home")), "pivot", "left")
        met = met.where(F.col("component") != F.coalesce("home", "pivot")).select(F.least("pivot", "member").alias("a"), F.greatest("pivot", "member").alias("b"))
        met = cut(plausible(met.unionByName(together).distinct().join(pairs, ["a", "b"], "left_anti"), narrow, percent))
        tested = pairs.unionByName(met)
        wanted = whole_sets(both(met).unionByName(many.select(F.col("member").alias("document_id"))))
        edges = edges.unionByName(cut(linked(met, wanted, percent)))
        labels = components(edges)
        many = _split_lists(many.select("sig", "member"), labels)
        homes = labels.select(F.col("id").alias("pivot"), F.col("component").alias("home"))
        groups = many.join(pivots, "sig").select("pivot", "member", "component").distinct().join(homes, "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
        rest = difference_candidates(groups, wanted, percent).join(tested, ["a", "b"], "left_anti")
        more = cut(linked(cut(plausible(rest, narrow, percent)), wanted, percent))
        if not more.isEmpty():
            labels = components(edges.unionByName(more))
    found = members.select("f1", "f2", "document_id", "class_id").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    found = found.groupBy("document_id").agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = sets.select("document_id", "n_shingles").join(found, "document_id", "left")
    return out.select("document_id", "n_shingles", F.coalesce("component_id", "document_id").alias("component_id"), F.coalesce("class_id", "document_id").alias("class_id"))


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` whose document_id is the smallest of its component, columns unchanged; rows without an id stay."""
    found = linked_components(documents.select("document_id", "text"), shingle, percent)
    return without_ids(documents, found.where("document_id <> component_id"))
