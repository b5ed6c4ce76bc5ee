"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import discard, stored

ROUNDS = 4
BAND_ROWS = 20_000  # rows numbered in one window group


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def linked_groups(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_id, size, text_crc32 and the group of equal texts (_g1, _g2: 128 bits with the checksum and the size)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("_id"), text_size(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.col(text).isNull(), body).alias("_g1"), F.xxhash64(F.lit(7), F.col(text).isNull(), body).alias("_g2"),
    )


def _capped_flows(wanted: dict[tuple[int, int], int], held: list[int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each wanted flow (from, to) that may move.

    A shard takes what leaves it for the other side of a swap, and beyond that what its room allows.
    """
    share = {}
    for to in range(len(held)):
        come = sum(n for (_, b), n in wanted.items() if b == to)
        swap = sum(min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items() if b == to)
        allowed = min(come, max(0, room[to] - held[to]) + swap)
        for (a, b), _ in wanted.items():
            if b == to:
                share[a, b] = allowed / come if come else 0.0
    return share


def propagate(linked: DataFrame, shards: int, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Labels of linked rows (_row, _g1, _g2, shard), moved towards their neighbours' shards.

    A round counts each group's rows by shard (summed before the shuffle), gives the counts to the
    group's rows by a join, and lets rows ask for the shard that holds most of their group among those with
    room; ties go by a hash of the group, so that a group agrees. Quotas bound the rows
    that go from one shard to another, and a hash of row and round picks which; capacity holds for
    linked rows, as others can make way. Only the at most ``shards ** 2`` flows reach the driver.
    """
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        held = [held.get(s, 0) for s in range(shards)]
        full = [s for s in range(shards) if held[s] >= capacity[s]]
        open_ = ~F.col("shard").isin(full) if full else F.lit(True)
        # Members of a full shard weigh too: a group stays where most of it is.
        tie = F.xxhash64("_g1", "shard")
        best = linked.groupBy("_g1", "_g2", "shard").agg(F.count("*").alias("n")).withColumn("open", open_)
        pick = F.max(F.struct("n", tie.alias("tie"), "shard"))
        best = best.groupBy("_g1", "_g2").agg(
            pick.alias("all"), F.max(F.when(F.col("open"), F.struct("n", tie.alias("tie"), "shard"))).alias("free")
        ).select("_g1", "_g2", F.col("all.shard").alias("_home"), F.col("free.shard").alias("_to"))
        asking = linked.join(best, ["_g1", "_g2"]).withColumn(
            "_to", F.when(F.col("shard") == F.col("_home"), F.col("shard")).otherwise(F.coalesce("_to", "shard"))
        )
        flows = asking.filter("_to <> shard").groupBy("shard", "_to").agg(F.count("*").alias("n")).collect()
        wanted = {(r["shard"], r["_to"]): r["n"] for r in flows}
        if not wanted:
            break
        share = _capped_flows(wanted, held, capacity)
        odds = F.create_map(*[F.lit(x) for (a, b), v in share.items() for x in (a * shards + b, v)])
        draw = F.pmod(F.xxhash64(F.lit(turn), "_row"), F.lit(1 << 30)) / float(1 << 30)
        moves = draw < F.coalesce(F.try_element_at(odds, F.col("shard") * shards + F.col("_to")), F.lit(0.0))
        moved = stored(
            asking.select("_row", "_g1", "_g2", F.when(moves, F.col("_to")).otherwise(F.col("shard")).cast("int").alias("shard")),
            "labels",
        )
        if turn:
            discard(linked)
        linked = moved
    return linked


def numbered(rows: DataFrame, keys: list[str], order: list[str], bands: int, name: str) -> DataFrame:
    """``rows`` numbered from 0 within ``keys`` (no nulls), by ``order``, then by a hash band.

    Rows are counted by (keys, order, band); the small table of counts gives each band its first
    number, and a window numbers each band. No group is larger than a band of one ``order`` value.
    """
    rows = rows.withColumn("_band", F.pmod(F.xxhash64(F.lit(3), "_row"), F.lit(bands)))
    cells = [*keys, *order, "_band"]
    counts = rows.groupBy(*cells).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy(*order, "_band").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    within = Window.partitionBy(*cells).orderBy("_row")
    joined = rows.join(first, cells)
    return joined.withColumn(name, F.col("_first") + F.row_number().over(within) - 1).drop("_band", "_first")


def assign(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; counts of shards differ by at most one.

    Rows with equal texts are linked. Rows start on a shard by hash, linked ones move by
    :func:`propagate`, and rows over a shard's exact share then go to shards that lack rows, those
    without links first. ``slot`` numbers a shard's rows from 0.

    A null text has size 1 and the checksum of no bytes, and is linked to other null texts only.
    Rows that repeat a key are rows of their own; a null key is allowed. A group larger than a shard
    fills one after the other. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    base = linked_groups(docs, text, key)
    # A name for each row, the same from now on as the table is written.
    rows = stored(base.withColumn("_row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    bands = max(64, -(-n // BAND_ROWS))
    groups = rows.groupBy("_g1", "_g2").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    start = F.pmod(F.xxhash64(F.lit(5), "_row"), F.lit(shards)).cast("int")
    linked = stored(rows.join(groups, ["_g1", "_g2"]).select("_row", "_g1", "_g2", start.alias("shard")), "linked")
    labels = propagate(linked, shards, quota, rounds).select("_row", F.col("shard").alias("_label"))
    labelled = rows.join(labels, "_row", "left").select(
        "_id", "size", "text_crc32", "_row", F.col("_label").isNull().cast("int").alias("_single"),
        F.coalesce("_label", start).alias("shard"),
    )
    placed = stored(numbered(labelled, ["shard"], ["_single"], bands, "slot"), "placed")
    # Rows beyond a shard's share fill, in their order, the shards that lack rows.
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = placed.filter(F.col("slot") >= F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1))
    over = numbered(over.withColumn("_all", F.lit(0)), ["_all"], ["_single"], bands, "_k").select("_row", "_k")
    lacking, at = [], 0
    for s in range(shards):
        if (gap := quota[s] - held.get(s, 0)) > 0:
            lacking.append((s, at, at + gap, held.get(s, 0)))
            at += gap
    shard, slot = F.col("shard"), F.col("slot")
    for s, first, end, have in lacking:
        here = (F.col("_k") >= first) & (F.col("_k") < end)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("_k") - first + have).otherwise(slot)
    out = placed.join(over, "_row", "left")
    return out.select(
        F.col("_id").cast(kind).alias(key), "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )
