"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import let, split_words

SHINGLE = 5
THRESHOLD = 0.8
# Two bags of shingles with a similarity of 0.8 have a cosine of at least 8/9, so their SimHashes differ in 9.7 of 64
# bits on average (deviation 2.9); 23 is 4.6 deviations above.
RADIUS = 23
BROADCAST_ROWS = 1_000_000  # of (hash, item, place): 24 MB


def _shingle(words: Column, at: Column) -> Column:
    """Hash of the five-word shingle at a place, in one step."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(SHINGLE)])


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles at each word, upper and lower case alike."""

    def body(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        hashes = F.transform(at, lambda i: _shingle(w, i))
        return F.when(F.size(w) >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))

    return let(split_words(F.lower(text)), body)


def simhash(shingles: Column) -> Column:
    """64 bits: each is set where more of the hashes have it set than not; a repeated shingle weighs more."""

    def bit(hashes: Column, b: int) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftright(h, b).bitwiseAND(1).cast("int") * 2 - 1)
        one = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        return F.when(votes > 0, one).otherwise(F.lit(0).cast("long"))

    def all_(hashes: Column) -> Column:
        out = bit(hashes, 0)
        for b in range(1, 64):
            out = out.bitwiseOR(bit(hashes, b))
        return out

    return let(shingles, all_)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """``radius + 1`` blocks of a fingerprint, as (number, bits).

    Two fingerprints at most ``radius`` bits apart agree in one block at least.
    """
    count, out, at = radius + 1, [], 0
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        bits = F.shiftrightunsigned(fingerprint, at).bitwiseAND((1 << width) - 1)
        out.append(F.struct(F.lit(k).alias("block"), bits.alias("bits")))
        at += width
    return F.array(*out)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared weight over joint weight of two bags of shingles (the sum of smaller over that of larger counts)."""

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    def body(p: Column, q: Column) -> Column:
        shared = F.aggregate(F.array_intersect(p, q), F.lit(0), lambda n, x: n + F.least(count(p, x), count(q, x)))
        return let(shared, lambda n: n / (F.size(p) + F.size(q) - n))

    return let(a, lambda p: let(b, lambda q: body(p, q)))


def _row_key(key: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), key, text).alias(f"_k{k}") for k in (1, 2)]


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item_key: str = "item_id", threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs of document and item with a window as long as the item that is at least ``threshold`` similar to it.

    Returns key, item_key, start (of the most similar window, in words; the first of equals), n_words (of the window),
    similarity, and _k1 and _k2, which name key and text for joins. Windows are compared by their bags of five-word shingles.

    1. A window that similar holds ``floor(m / 9)`` shingles at most that the item (of ``m``) lacks. So every
       k-th place of a text is looked up among the items' shingles, with k so small that a window has more such
       places than it may miss; windows that miss too many drop out. This loses no window. Found places are
       gathered by stretches of ``m`` places, so this takes time in proportion to the text, however often it holds an item.
    2. SimHashes of the windows meet those of the items that led to them in one of ``RADIUS + 1`` blocks, which finds all
       fingerprints within ``RADIUS``.
    3. Pairs within it are verified by the exact similarity.

    Null texts, and texts and items of fewer than five words, have no shingle and match nothing. A text shorter than
    an item is one window. Rows that repeat key and text give one result; so do items that repeat. Empty tables give no rows. Other columns are not
    carried and may have any name. A very long text is one row of its shingles (8 bytes a word) where a window of it is compared.
    """
    listed = items.select(F.col(item_key).alias("_item"), _shingles(F.col(item_text)).alias("_bag")).filter(F.size("_bag") > 0)
    listed = listed.dropDuplicates().withColumn("_m", F.size("_bag"))
    bound = F.floor(F.col("_m") * ((1 - threshold) / (1 + threshold)) + 1e-9).cast("int")  # floor(m / 9) at 0.8
    # _own names item and shingles for joins; a shared hash only adds pairs to verify.
    listed = listed.withColumn("_miss", bound).withColumn("_own", F.xxhash64("_item", "_bag"))
    known = listed.agg(F.min(F.floor(F.col("_m") / (F.col("_miss") + 1))).alias("stride"), F.sum("_m").alias("places")).first()
    stride, places = max(1, known["stride"] or 1), known["places"] or 0

    # 1. places of texts that hold a shingle of an item
    index = listed.select("_own", "_m", "_miss", F.explode("_bag").alias("_h")).distinct()
    if places <= BROADCAST_ROWS:
        index = F.broadcast(index)
    own = _row_key(F.col(key), F.col(text))
    words = split_words(F.lower(F.col(text)))

    def sampled(w: Column) -> Column:
        n = (F.size(w) - SHINGLE + 1).alias("n")
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE, F.lit(stride))
        return F.transform(at, lambda i: F.struct(i.alias("at"), n, _shingle(w, i).alias("h")))

    none = F.array().cast("array<struct<at: int, n: int, h: bigint>>")
    looked = docs.select(*own, F.explode(let(words, lambda w: F.when(F.size(w) >= SHINGLE, sampled(w)).otherwise(none))).alias("_s"))
    looked = looked.select("_k1", "_k2", F.col("_s.n").alias("_n"), F.col("_s.at").alias("_at"), F.col("_s.h").alias("_h"))
    anchors = looked.join(index, "_h").drop("_h")
    # A window that starts in a stretch of m places ends in it or the next one.
    here = F.floor(F.col("_at") / F.col("_m")).cast("int")
    anchors = anchors.withColumn("_stretch", F.explode(F.array_distinct(F.array(here, F.greatest(here - 1, F.lit(0))))))
    anchors = anchors.groupBy("_k1", "_k2", "_n", "_own", "_m", "_miss", "_stretch").agg(F.collect_set("_at").alias("_anchors"))

    # windows around them that miss few enough of their looked-up places
    last = F.greatest(F.lit(0), F.col("_n") - F.col("_m"))
    least = F.greatest(F.col("_stretch") * F.col("_m"), F.least(last, F.array_min("_anchors") - F.col("_m") + 1))
    most = F.least(F.col("_stretch") * F.col("_m") + F.col("_m") - 1, F.array_max("_anchors"), last)

    def enough(s: Column) -> Column:
        end = F.least(s + F.col("_m"), F.col("_n"))  # places s to end - 1
        looked_up = F.floor((end - 1) / stride) - F.floor((s - 1) / stride)
        return looked_up - F.size(F.filter("_anchors", lambda p: (p >= s) & (p < end))) <= F.col("_miss")

    anchors = anchors.withColumns({"_least": least, "_most": most}).filter("_least <= _most")
    starts = anchors.withColumn("_starts", F.filter(F.sequence("_least", "_most"), enough)).filter(F.size("_starts") > 0)
    starts = starts.groupBy("_k1", "_k2", "_own", "_m").agg(F.flatten(F.collect_list("_starts")).alias("_starts"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *own)
    held = texts.join(starts, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2", "_own", "_m"])
    held = held.select("_id", "_k1", "_k2", "_own", "_m", "_starts", _shingles(F.col("_text")).alias("_all"))
    windows = held.withColumn("_start", F.explode("_starts"))
    windows = windows.select("_id", "_k1", "_k2", "_own", "_m", "_start", F.slice("_all", F.col("_start") + 1, F.col("_m")).alias("_window"))

    # 2. fingerprints in blocks
    printed = windows.withColumn("_print", simhash(F.col("_window"))).withColumn("_block", F.explode(blocks(F.col("_print"))))
    prints = listed.select("_item", "_own", "_m", F.col("_bag"), simhash(F.col("_bag")).alias("_item_print"))
    prints = prints.withColumn("_block", F.explode(blocks(F.col("_item_print"))))
    if places <= BROADCAST_ROWS // (RADIUS + 1):
        prints = F.broadcast(prints)
    near = printed.join(prints, ["_own", "_m", "_block"]).filter(F.bit_count(F.col("_print").bitwiseXOR(F.col("_item_print"))) <= RADIUS)
    # A pair counts where its first equal block is, so that it is verified once.
    mine, theirs = blocks(F.col("_print")), blocks(F.col("_item_print"))
    first = F.array_min(F.filter(F.zip_with(mine, theirs, lambda a, b: F.when(a["bits"] == b["bits"], a["block"])), lambda k: k.isNotNull()))
    near = near.filter(F.col("_block.block") == first)

    # 3. exact similarity
    exact = near.withColumn("similarity", weighted_similarity(F.col("_window"), F.col("_bag"))).filter(F.col("similarity") >= threshold)
    best = exact.groupBy("_k1", "_k2", "_item").agg(
        F.first("_id").alias("_id"),
        F.max(F.struct("similarity", (-F.col("_start")).alias("back"), (F.size("_window") + SHINGLE - 1).alias("n"))).alias("b"),
    )
    return best.select(
        F.col("_id").alias(key), F.col("_item").alias(item_key), (-F.col("b.back")).cast("long").alias("start"),
        F.col("b.n").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"), "_k1", "_k2",
    )


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, which may have any name."""
    hit = contaminated(docs, items, text, key).select("_k1", "_k2").distinct()
    keyed = docs.select(F.struct("*").alias("_row"), *_row_key(F.col(key), F.col(text)))
    return keyed.join(hit, ["_k1", "_k2"], "left_anti").select("_row.*")
