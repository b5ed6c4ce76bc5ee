"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

SHARE = 1.5  # words of the mix, as a share of the words there are
MOST = 2.0  # times that a source's words may be taken
PER_GROUP = 4096  # documents of a group of the first level
FAN_IN = 64  # residual groups that meet in one group of the next level


def count_words(text: Column) -> Column:
    """Runs of characters other than space and ``\\x09-\\x0D``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source(source: Column) -> Column:
    return F.xxhash64(source.isNull(), source)


def _name(key: Column) -> Column:
    """A key as text without nulls."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key.cast("string")))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size and target of each source from rows with source and size.

    Sources in code-point order (null last) weigh ``weights``, repeating. They split ``share`` of
    all sizes by weight; no target passes ``most`` times its source's size, and what is over is split among the
    others by weight until none is above. All targets are at their limit where ``share >= most``.

    The level at which the split ends is found without iteration: the sources by rising
    ``limit / weight`` are full up to one point, and running sums give the level for each point.
    The table has a row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.get(table, (F.row_number().over(everything) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", F.col("source_size") * float(most))
    rising = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * float(share)
    filled = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", (budget - filled) / open_weight)
    # The first source that stays below its limit sets the level of all after it.
    stays = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level"))
    leveled = leveled.withColumn("level", F.first(stays, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def _settle(part: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of fractions, the largest sizes first; at most one stays between 0 and 1.

    A document meets the smaller ones, taken together: words go from them to it or from it to them, until it or
    one of them is 0 or 1. The others share a transfer along one direction for both ways, so that the odds of the
    ways keep each fraction's mean, and ``size * fraction`` summed stays the same. What stays open is, as a rule,
    the smallest document.
    """
    out = part.copy()
    for i in range(len(part)):
        while 0.0 < out[i] < 1.0:
            rest = i + 1 + np.flatnonzero((out[i + 1:] > 0) & (out[i + 1:] < 1))
            if not len(rest):
                break
            p, x, q = out[i], float(size[i]), out[rest]
            along = q * (1 - q)
            words = float((along * size[rest]).sum())
            up, down = min((1 - p) * x / words, (1 / (1 - q)).min()), min(p * x / words, (1 / q).min())
            step = -up if draws.random() * (up + down) < down else down
            q = q + step * along
            out[i] = 1.0 if step == -(1 - p) * x / words else 0.0 if step == p * x / words else p - step * words / x
            q[q < 1e-12], q[q > 1 - 1e-12] = 0.0, 1.0
            out[rest] = q
            out[i] = 0.0 if out[i] < 1e-12 else 1.0 if out[i] > 1 - 1e-12 else out[i]
    return out


def pivotal(rows: DataFrame, groups: int, seed: int) -> DataFrame:
    """``rows`` (_key, _source, _group, size, part) with part 0 or 1.

    A tree: each group settles all but one fraction of each source; the fractions left meet in groups
    of ``FAN_IN`` groups, until one group is left, where a last fraction is drawn by its odds.
    Groups come from a hash of the document, so no source makes one larger. Beyond the first level a group
    holds up to ``FAN_IN`` fractions of each source; where sources are many it is split by source.
    """
    schema = "_key string, _source long, _group long, size long, part double, done boolean"
    columns = [c.split()[0] for c in schema.split(", ")]

    def level(last: bool, depth: int, parts: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_source", "size", "_key"], ascending=[True, False, True], kind="stable", ignore_index=True)
            part_of = [int(pdf["_source"].iloc[0]) % parts] if parts > 1 else []
            draws = np.random.default_rng([seed, depth, int(pdf["_group"].iloc[0]), *part_of])
            part, size = pdf["part"].to_numpy(float).copy(), pdf["size"].to_numpy()
            cuts = np.flatnonzero(np.diff(pdf["_source"].to_numpy())) + 1
            for at in np.split(np.arange(len(pdf)), cuts):
                part[at] = _settle(part[at], size[at], draws)
                if last:
                    part[at] = np.where((part[at] > 0) & (part[at] < 1), draws.random() < part[at], part[at])
            pdf["part"], pdf["done"] = part, (part <= 0) | (part >= 1)
            return pdf[columns]

        return run

    rows, done, depth, parts = rows.withColumn("done", F.lit(False)).select(columns), None, 0, 1
    while True:
        last = groups == 1
        grouped = rows.groupBy("_group", F.pmod("_source", F.lit(parts)))
        settled = stored(grouped.applyInPandas(level(last, depth, parts), schema), "pivotal")
        done = settled.filter("done") if done is None else done.unionByName(settled.filter("done"))
        if last:
            return done
        rows = settled.filter("NOT done").withColumn("_group", F.expr(f"_group div {FAN_IN}"))
        groups, depth = -(-groups // FAN_IN), depth + 1
        parts = max(1, -(-rows.count() // (groups * PER_GROUP)))


def choices(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = (3, 1, 2),
    share: float = SHARE, most: float = MOST, seed: int = 1, per_group: int = PER_GROUP,
) -> DataFrame:
    """_id, _name, _source, size, _nth, source_size, target, copies and taken (copies times size) of every row.

    A source's rows are each wanted ``target / source_size`` times: that many whole copies, and one
    more for a choice that pivotal rounding makes. Documents trade words, not chances, so a source's taken words
    miss its target by what the last open document holds, which is one of the smallest as a rule.

    A null text has size 0, and rows of size 0 take no copy beyond the whole ones; a null source is a source.
    Rows that repeat a key are choices of their own. A source of size 0 has target 0. Reruns agree.
    """
    kind = docs.schema[key].dataType
    sized = stored(docs.select(F.col(key).alias("_id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size")), "sizes")
    targets = source_targets(sized, weights, share, most)
    targets = stored(targets.withColumn("_source", _source(F.col("source"))), "targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumns({"base": F.floor(rate).cast("long"), "part": rate - F.floor(rate)})
    # Rows alike in key, source and size are told apart by a number only.
    rows = rows.withColumn("_name", _name(F.col("_id")))
    alike = rows.groupBy("_name", "_source", "size").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("_id", "base", "source_size", "target", "part")]
    )
    alike = alike.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    n = sized.count()
    groups = max(64, -(-n // per_group))
    placed = alike.withColumn("_key", F.concat_ws("/", "_name", "_nth"))
    placed = placed.withColumn("_group", F.pmod(F.xxhash64("_key", "size"), F.lit(groups)))
    wanted = placed.select(
        "_key", "_source", "_group", "size", F.when(F.col("size") > 0, F.col("part")).otherwise(0.0).alias("part")
    )
    chosen = pivotal(wanted, groups, seed).select("_key", "_source", "size", F.col("part").cast("long").alias("more"))
    out = placed.drop("part", "_group").join(chosen, ["_key", "_source", "size"])
    copies = F.col("base") + F.col("more")
    return out.select(
        F.col("_id").cast(kind).alias("_id"), "_name", "_source", "_nth", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """key, size, source_size, target, copies and taken (copies times size) of every row; see :func:`choices`."""
    out = choices(docs, text, source, key, **how)
    return out.select(F.col("_id").alias(key), "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`choices` takes it; columns may have any name."""
    alike = ["_name", "_source", "_size"]
    chosen = choices(docs, text, source, key, **how).withColumnRenamed("size", "_size").select(*alike, "_nth", "copies")
    chosen = stored(chosen.withColumnRenamed("copies", "_copies"), "copies")
    own = docs.select(
        F.struct("*").alias("_row"), _name(F.col(key)).alias("_name"), _source(F.col(source).cast("string")).alias("_source"),
        count_words(F.col(text)).alias("_size"), F.xxhash64(text).alias("_tie"),
    )
    counts = chosen.groupBy(*alike).agg(F.count("*").alias("_n"))
    single = chosen.join(counts.filter("_n = 1"), alike).drop("_n", "_nth").filter("_copies > 0")
    once = own.join(single, alike).select("_row", "_copies")
    many = counts.filter("_n > 1").drop("_n")
    if not many.isEmpty():  # only rows alike in key, source and size need a number
        within = Window.partitionBy(*alike).orderBy("_tie")
        ranked = own.join(many, alike).withColumn("_nth", F.row_number().over(within).cast("long"))
        once = once.union(ranked.join(chosen.filter("_copies > 0"), [*alike, "_nth"]).select("_row", "_copies"))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
