"""Manifest of a dataset: a Merkle tree for each source and one over the sources, with a proof for every row.

Nodes are reduced in superblocks of ``FAN ** DEPTH`` consecutive ones. A round gives the superblocks' roots, which
are the next round's nodes, so a source of any size takes a few rounds over tables that shrink
4,096-fold. On the way back each superblock is cogrouped with the outer nodes that its rows need (the siblings of
its ancestors, at most 15 a level), and one pandas step reduces it, joins the proofs and folds them.
Rows are numbered by a sort over all partitions, so no source, however large, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

FAN, DEPTH = 16, 3
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SOURCE = ["_none", "_source"]  # a null source is a key of its own, and the first


def digest_of(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of the columns' texts: ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, tree: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with _at (from 0 within ``tree``, by ``order``) and _total (rows of the tree).

    A range partition and a sort put the rows in order; each run of a tree in a partition is
    counted, and the table of runs (no longer than partitions and trees together) gives the first numbers.
    """
    ranged = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    held = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), label)
    held = held.withColumn("_part", F.shiftright("_id", 33))  # the upper bits of the id are the partition
    runs = held.groupBy(*tree, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*tree))}
    ).drop("_n")
    placed = held.join(runs, [*tree, "_part"]).withColumn("_at", F.col("_before") + F.col("_id") - F.col("_first"))
    return placed.drop("_id", "_part", "_first", "_before")


def block_roots(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """The nodes (tree, _at, _total, digest) that superblocks leave, ``DEPTH`` levels up.

    The levels group by keys that contain the superblock, so that the first shuffle serves all.
    """
    out = nodes.select(*tree, "_total", "digest", F.expr(f"_at div {BLOCK}").alias("_block"), (F.col("_at") % BLOCK).alias("_in"))
    out = out.repartition(*tree, "_block")
    for _ in range(DEPTH):
        run = F.array_sort(F.collect_list(F.struct("_in", "digest")))
        out = out.withColumn("_run", F.expr(f"_in div {FAN}")).groupBy(*tree, "_block", "_total", "_run").agg(run.alias("run"))
        joined = F.sha2(F.concat_ws("", "run.digest"), 256)
        out = out.select(
            *tree, "_block", F.expr(f"(_total + {FAN - 1}) div {FAN}").alias("_total"),
            F.when(F.col("_total") > 1, joined).otherwise(F.col("run")[0]["digest"]).alias("digest"), F.col("_run").alias("_in"),
        )
    return out.select(*tree, F.col("_block").alias("_at"), "_total", "digest")


def heights(nodes: DataFrame, tree: list[str]) -> list[DataFrame]:
    """Tables of nodes from ``nodes`` up to the one with a root for each tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("_total")).first()[0] or 0) > 1:
        levels.append(stored(block_roots(levels[-1], tree), "nodes"))
    return levels


def climb(digests: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes up; ``total`` counts the nodes of the whole tree."""
    levels = [digests]
    while len(levels) <= DEPTH and total > 1:
        low, total = levels[-1], -(-total // FAN)
        levels.append([hashlib.sha256("".join(low[i:i + FAN]).encode()).hexdigest() for i in range(0, len(low), FAN)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    """The siblings left and right of node ``i`` and of its ancestors below the superblock's root."""
    out = []
    for low in levels[:-1]:
        first = i // FAN * FAN
        out.append((low[first:i], low[i + 1:first + FAN]))
        i //= FAN
    return out


OUTER = "_step int, _left array<string>, _right array<string>, subroot string, root string"


def outward(nodes: DataFrame, outer: DataFrame, tree: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """The outer nodes of the superblocks below ``nodes``: those of ``nodes``' own superblocks and their siblings in them.

    A row holds one run: _step (0: no siblings, only the roots; then from the root down). With
    ``keep``, nodes are the roots of trees named by those columns; else each node heads the superblock _at of its tree.
    """
    names = list(keep) or tree
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def expand(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, rows = block.sort_values("_at"), []
        levels = climb(block["digest"].tolist(), int(block["_total"].iloc[0]))
        head = above[above["_step"] == 0].iloc[0]
        own = [(int(s), list(a), list(b)) for s, a, b in zip(above["_step"], above["_left"], above["_right"])]
        deepest = max(s for s, _, _ in own)
        for i, (at, *name) in enumerate(zip(block["_at"], *(block[n] for n in names))):
            inner = siblings(levels, i)
            steps = own + [(deepest + len(inner) - k, a, b) for k, (a, b) in enumerate(inner)]
            subroot = levels[0][i] if keep else head["subroot"]
            rows += [(*name, 0 if keep else int(at), s, a, b, subroot, head["root"]) for s, a, b in steps]
        return pd.DataFrame(rows, columns=[*names, "_block", "_step", "_left", "_right", "subroot", "root"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", _block long, " + OUTER
    blocks = nodes.withColumn("_block", F.expr(f"_at div {BLOCK}"))
    return blocks.groupBy(*tree, "_block").cogroup(outer.groupBy(*tree, "_block")).applyInPandas(expand, schema)


def fold(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """_doc, leaf, subroot, root, steps, proof and folded_root for each leaf.

    ``proof`` is the siblings' digests as one text, level by level from the leaf; ``steps`` gives
    place and length of the run on each level; ``folded_root`` starts from the digest ``shown``.
    """

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("_at"), above.sort_values("_step", ascending=False)
        levels = climb(block["digest"].tolist(), int(block["_total"].iloc[0]))
        head = above[above["_step"] == 0].iloc[0]
        out = [("".join(a), "".join(b)) for s, a, b in zip(above["_step"], above["_left"], above["_right"]) if s]
        out_proof = "".join(a + b for a, b in out)
        out_steps = [f"{len(a) // 64}/{(len(a) + len(b)) // 64 + 1}" for a, b in out]
        proofs, steps, folded = [], [], []
        for i, shown in enumerate(block["shown"]):
            inner = [("".join(a), "".join(b)) for a, b in siblings(levels, i)]
            proofs.append("".join(a + b for a, b in inner) + out_proof)
            steps.append(" ".join([*(f"{len(a) // 64}/{(len(a) + len(b)) // 64 + 1}" for a, b in inner), *out_steps]))
            for a, b in [*inner, *out]:
                shown = hashlib.sha256((a + shown + b).encode()).hexdigest()
            folded.append(shown)
        return pd.DataFrame(
            {
                "_doc": block["_doc"], "leaf": block["digest"], "subroot": head["subroot"], "root": head["root"],
                "steps": steps, "proof": proofs, "folded_root": folded,
            }
        )

    blocks = leaves.withColumn("_block", F.expr(f"_at div {BLOCK}"))
    schema = "_doc string, leaf string, subroot string, root string, steps string, proof string, folded_root string"
    return blocks.groupBy(*SOURCE, "_block").cogroup(outer.groupBy(*SOURCE, "_block")).applyInPandas(finish, schema)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source",
    shown: dict[str, Column] | None = None,
) -> DataFrame:
    """key, leaf, subroot, root, steps, proof, folded_root and verified for every row.

    A row's leaf is the digest of its ``fields``. Leaves of a source ascend by ``key`` (null first, equal
    keys by leaf), every 16 consecutive nodes become one until one remains, and the sources' roots (null source
    first, then by UTF-8 bytes) make the tree of the dataset. ``shown`` names fields that the row to be verified
    has otherwise; its leaf is folded with the original siblings.

    Null fields count as ``-``, an empty text as ``0:``. Equal rows are leaves of their own, with any
    of their places. Texts of any length are hashed where they are read; only digests are shuffled. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    changed = [(shown or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.col(source).isNull().alias("_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(key).alias("_key"), digest_of([F.col(f) for f in fields]).alias("digest"), digest_of(changed).alias("shown"),
    )
    order = leaves.withColumns({"_none": ~F.col("_none")})  # false, the null source, comes first
    placed = stored(numbered(order, SOURCE, ["_key", "digest"], "leaves").withColumn("_doc", F.col("_key").cast("string")), "leaves")
    levels = heights(placed.select(*SOURCE, "_at", "_total", "digest", "shown", "_doc"), SOURCE)

    roots = levels[-1].select(*SOURCE, "digest").withColumn("_top", F.lit(0))
    tops = heights(stored(numbered(roots, ["_top"], SOURCE, "roots"), "roots"), ["_top"])
    none = F.array().cast("array<string>")
    outer = tops[-1].select(
        "_top", F.lit(0).cast("long").alias("_block"), F.lit(0).alias("_step"), none.alias("_left"), none.alias("_right"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    for nodes in reversed(tops[1:-1]):
        outer = outward(nodes, outer, ["_top"])
    outer = outward(tops[0], outer, ["_top"], SOURCE)
    for nodes in reversed(levels[1:-1]):
        outer = outward(nodes, outer, SOURCE)
    out = fold(levels[0], outer)
    return out.select(
        F.col("_doc").cast(docs.schema[key].dataType).alias(key), "leaf", "subroot", "root", "steps", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
