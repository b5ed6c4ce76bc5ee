"""Near-duplicate detection by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import Words, find_words, mix, ngrams, slices, starts_within, word_hashes
from tidemark.llm.store import discard, stored

KMER = 4  # words
PICKED = 2  # k-mers of a sketch
SKETCHES = 40
THRESHOLD = 0.8


def _labelled(kmers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """K-mers told apart by how often their text had them before."""
    own = mix(kmers ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(own)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    before = np.zeros(len(kmers), np.uint64)
    if len(again):
        some = np.flatnonzero(np.isin(own, again))
        some = some[np.argsort(own[some], kind="stable")]
        new = np.diff(own[some], prepend=own[some][0] - np.uint64(1)) != 0
        run = np.arange(len(some))
        before[some] = run - np.maximum.accumulate(np.where(new, run, 0))
    return mix(kmers + mix(before + np.uint64(7)) * (before > 0))


def sketches(words: Words, kmer: int = KMER, picked: int = PICKED, count: int = SKETCHES) -> list[np.ndarray]:
    """``count`` keys for each text, none for texts without a k-mer.

    A key names the ``picked`` occurrence-labelled k-mers with the smallest hashes, in the order in
    which the text has them.
    """
    at = starts_within(words, kmer)
    hashes = ngrams(word_hashes(words), kmer)[at]
    doc = words.texts()[at]
    texts = len(words.bounds) - 1
    size = np.bincount(doc, minlength=texts)
    label = _labelled(hashes, doc)
    # Few k-mers lie below a bound that 12 are expected under; texts with too few there are searched in full.
    some = np.minimum(1.0, 12.0 / np.maximum(size, 1))
    bound = np.where(some >= 1.0, np.uint64(2**64 - 1), (some * 2.0**64).astype(np.float64).clip(0, 2.0**63 * 1.99).astype(np.uint64))[doc]
    keys = np.zeros((texts, count), np.uint64)
    for i in range(count):
        factor = mix(np.array([2 * i + 1], np.uint64)) | np.uint64(1)
        h = (label ^ mix(np.array([i + 77], np.uint64))) * factor
        low = np.flatnonzero(h <= bound)
        got = np.bincount(doc[low], minlength=texts)
        short = np.flatnonzero(got < np.minimum(picked, size))
        if len(short):
            low = np.flatnonzero((h <= bound) | np.isin(doc, short))
        low = low[np.lexsort((h[low], doc[low]))]
        first = np.searchsorted(doc[low], np.arange(texts))
        rank = np.arange(len(low)) - first[doc[low]]
        low = np.sort(low[rank < picked])  # text order
        key = np.full(texts, i + 1, np.uint64)
        place = np.arange(len(low)) - np.searchsorted(doc[low], np.arange(texts))[doc[low]]
        for p in range(picked):
            now = low[place == p]
            key[doc[now]] = mix(key[doc[now]] * np.uint64(0x9E3779B97F4A7C15) + hashes[now])
        keys[:, i] = key
    return [k if n else k[:0] for k, n in zip(keys, size)]


def _least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the distance: an edit takes one word, or two pairs of neighbours, from what both hold."""
    most = max(len(a), len(b))

    def shared(x: np.ndarray, y: np.ndarray) -> int:
        names, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        return int(np.minimum(np.bincount(back[:len(x)], minlength=len(names)), np.bincount(back[len(x):], minlength=len(names))).sum())

    pairs = most - 1 - shared(ngrams(a, 2), ngrams(b, 2)) if most > 1 else 0
    return max(abs(len(a) - len(b)), most - shared(a, b), -(-pairs // 2))


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The distance of ``a`` and ``b``, or None if over ``most``: a band of diagonals that widens with each edit.

    For a number of edits each diagonal keeps the furthest place reached; equal words are passed by
    a search among the diagonal's mismatches.
    """
    n, m = len(a), len(b)
    mismatches: dict[int, np.ndarray] = {}

    def slide(k: int, i: int) -> int:
        """From place i of a on the diagonal j = i + k to the next mismatch or the end."""
        if k not in mismatches:
            lo, hi = max(0, -k), min(n, m - k)
            mismatches[k] = np.append(np.flatnonzero(a[lo:hi] != b[lo + k:hi + k]) + lo, hi)
        row = mismatches[k]
        return int(row[np.searchsorted(row, i)]) if i < row[-1] else i

    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if edits:
            new = {}
            for k in range(-min(edits, n), min(edits, m) + 1):
                i = min(max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2)), n, m - k)
                if i >= max(0, -k):
                    new[k] = slide(k, i)
            reach = new
        if reach.get(m - n, -1) >= n:
            return edits
    return None


def _by_columns(a: np.ndarray, b: np.ndarray) -> int:
    """The distance by whole columns of the alignment table, each as the bits of two numbers (its ups and downs)."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    n = len(a)
    every, top, up, down, d = (1 << n) - 1, 1 << (n - 1), (1 << n) - 1, 0, n
    for x in b.tolist():
        same = places.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(diagonal | up)), up & diagonal
        d += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | 1) & every, (right_down << 1) & every
        up, down = right_down | (every & ~(diagonal | right_up)), right_up & diagonal
    return d


NARROW = 16  # edits up to which the band of diagonals is tried first
SHORT = 400  # words up to which whole columns cost less than that


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits (insert, delete, replace a word) that turn ``a`` into ``b`` if at most ``most``, else a lower bound above ``most``.

    Equal ends are cut off, bags of words and of word pairs refuse most distant pairs, then a narrow band of long texts is
    aligned, and what needs more edits than it holds is aligned in full, so that bounds near ``most`` are exact.
    """
    floor = abs(len(a) - len(b))
    if floor > most:
        return floor
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    floor = _least_edits(a, b)
    if floor > most + most // 2:
        return floor
    near = _banded(a, b, min(most, NARROW)) if floor <= most and min(len(a), len(b)) > SHORT else None
    return near if near is not None else _by_columns(a, b)


SKETCHED = "_id {kind}, _node binary, n_words long, keys array<long>"


def node_of(text: str) -> Column:
    """A text as a node: 128 bits of its SHA-256; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_id, _node, n_words and the sketch keys."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            words = find_words(batch.column("_text"))
            keys = sketches(words)
            flat = np.concatenate(keys).view(np.int64) if len(keys) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), batch.column("_node"), pa.array(words.counts(), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                ],
                ["_id", "_node", "n_words", "keys"],
            )

    return docs.select(F.col(key).alias("_id"), node_of(text).alias("_node"), F.col(text).alias("_text")).mapInArrow(run, SKETCHED.format(kind=kind))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b and d (see :func:`distance`) and similar for pairs (a, b) of nodes."""
    both = pairs.join(texts.select(F.col("_node").alias("a"), F.col("_text").alias("_x")), "a")
    both = both.join(texts.select(F.col("_node").alias("b"), F.col("_text").alias("_y")), "b").select("a", "b", "_x", "_y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "_x", "_y")):
            x, y = find_words(batch.column("_x")), find_words(batch.column("_y"))
            hx, hy = word_hashes(x), word_hashes(y)
            d, ok = [], []
            for i in range(batch.num_rows):
                a, b = hx[x.bounds[i]:x.bounds[i + 1]], hy[y.bounds[i]:y.bounds[i + 1]]
                most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
                d.append(distance(a, b, most))
                ok.append(d[-1] <= most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(d, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "d", "similar"]
            )

    return both.mapInArrow(run, "a binary, b binary, d long, similar boolean")


TILE = 2048  # nodes of a bucket that one task compares with as many others
TILE_WORDS = 1 << 20
BINS = 256  # of a text's counts of words, and of pairs of words


def _hashed(texts: DataFrame) -> DataFrame:
    """_node and the hashes of its words, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            words = find_words(batch.column("_text"))
            hashes = word_hashes(words)
            each = [hashes[i:j].tobytes() for i, j in zip(words.bounds[:-1], words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array(each, pa.binary())], ["_node", "_words"])

    return texts.select("_node", "_text").mapInArrow(run, "_node binary, _words binary")


def _counted(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.int32)


def _meeting(bands: list[list[int]], keys: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket key of each node by band, and whether it has one."""
    width = 1 + max(max(b) for b in bands)
    table, there = np.zeros((len(bands), width), np.int64), np.zeros((len(bands), width), bool)
    for i, (b, k) in enumerate(zip(bands, keys)):
        table[i, b], there[i, b] = k, True
    return table, there


def _left_over(state: DataFrame, members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, d) between nodes of two classes of a bucket, enough of them to join all classes that have any.

    Buckets are cut into tiles of about ``TILE`` nodes, and a task compares two tiles. A pair that shares several buckets is compared
    in one of them, which a hash of the pair names; where that bucket is worked off, the pair is. Counts of words and of pairs of
    words refuse most pairs: an edit changes two counts of the ones and four of the others, by one each. The rest is aligned in the task,
    unless links found there have joined the classes already, so that a task gives no more links than it has nodes.
    """
    nodes = state.select("_node").distinct()
    places = members.join(nodes, "_node", "left_semi").groupBy("_node").agg(
        F.collect_list("_band").alias("_bands"), F.collect_list("_key").alias("_keys")
    )
    held = stored(_hashed(texts.join(nodes, "_node", "left_semi")).join(places, "_node"), "words")
    sizes = state.groupBy("_band", "_key").agg(F.count("*").alias("_n"), F.sum("n_words").alias("_size"))
    tiles = F.greatest(F.ceil(F.col("_n") / TILE), F.ceil(F.col("_size") / TILE_WORDS)).cast("long")
    tiled = state.join(sizes, ["_band", "_key"]).withColumn("_tiles", tiles)
    tiled = tiled.withColumn("_tile", F.pmod(F.xxhash64("_node"), F.col("_tiles")))
    others = F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)
    placed = tiled.withColumn("_other", F.explode(others)).select(
        "_band", "_key", F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"), "_tile", "_node", "_class"
    ).join(held, "_node")

    def compare(table: pa.Table) -> pa.Table:
        low, high, band = table["_low"][0].as_py(), table["_high"][0].as_py(), table["_band"][0].as_py()
        names, tile = table["_node"].to_pylist(), table["_tile"].to_numpy()
        number: dict[bytes, int] = {}
        class_ = np.array([number.setdefault(c, len(number)) for c in table["_class"].to_pylist()])
        words = [np.frombuffer(w, np.uint64) for w in table["_words"].to_pylist()]
        length = np.array([len(w) for w in words])
        ones, twos = np.stack([_counted(w) for w in words]), np.stack([_counted(ngrams(w, 2)) for w in words])
        keys, there = _meeting(table["_bands"].to_pylist(), table["_keys"].to_pylist())
        mark = np.array([int.from_bytes(n[:8], "little") for n in names], np.uint64)
        turn = mix(np.arange(keys.shape[1], dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        out = []
        for k, i in enumerate(left):
            rest = left[k + 1:] if low == high else right
            most = ((1 - threshold) * np.maximum(length[rest], length[i]) + 1e-9).astype(np.int64)
            open_ = (class_[rest] != class_[i]) & (np.abs(length[rest] - length[i]) <= most)
            rest, most = rest[open_], most[open_]
            if not len(rest):
                continue
            shared = (keys[rest] == keys[i]) & there[rest] & there[i]
            rank = (mark[rest] ^ mark[i])[:, None] * turn | np.uint64(1)
            here = np.argmax(np.where(shared, rank, np.uint64(0)), axis=1) == band
            rest, most = rest[here], most[here]
            least = np.maximum((np.abs(ones[rest] - ones[i]).sum(1) + 1) // 2, (np.abs(twos[rest] - twos[i]).sum(1) + 3) // 4)
            rest, most = rest[least <= most], most[least <= most]
            for r, m in sorted(zip(rest.tolist(), most.tolist()), key=lambda x: x[0]):
                if class_[r] == class_[i]:
                    continue
                d = distance(words[i], words[r], m)
                if d <= m:
                    out.append((*sorted((names[i], names[r])), d))
                    class_[class_ == class_[r]] = class_[i]
        a, b, d = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "d": pa.array(d, pa.int64())})

    return placed.groupBy("_band", "_key", "_low", "_high").applyInArrow(compare, "a binary, b binary, d long").distinct()


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (_node, _class) after more links: the classes that they join are components of a graph of classes."""
    named = lambda end: labels.select(F.col("_node").alias(end), F.col("_class").alias(f"_{end}"))
    both = edges.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left")
    both = stored(both.select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")), "joined")
    if both.isEmpty():
        return labels
    upper = components(both.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("_node").alias("_class"), F.col("_class").alias("_upper"))
    new = both.select(F.col("a").alias("_node")).union(both.select(F.col("b").alias("_node"))).distinct()
    every = labels.union(new.join(labels, "_node", "left_anti").select("_node", F.col("_node").alias("_class")))
    return every.join(upper, "_class", "left").select("_node", F.coalesce("_upper", "_class").alias("_class"))


def linked(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, d) among the nodes of each bucket (_band, _key, _node, n_words), and _class of the nodes that have any.

    First one node of each bucket leads, and every other is aligned with it; the leader leaves, and so do
    the nodes linked to it, unless the triangle inequality leaves room for a link to a node that is
    still open. So a bucket of near copies, however large, costs one alignment a node. Of what is left, pairs of two classes that
    counts don't tell apart are aligned, also where both were linked to a leader. So each pair of a bucket is aligned, or in one
    class, or can't be similar; no bucket is cut off. Classes are those of links found before, in any bucket.
    """
    leads = members.groupBy("_band", "_key").agg(F.min("_node").alias("_lead"))
    followers = members.join(leads, ["_band", "_key"]).filter("_node <> _lead")
    asked = followers.select("_lead", "_node").distinct().withColumnsRenamed({"_lead": "a", "_node": "b"})  # the lead is the smaller
    known = stored(_verified(asked, texts, threshold), "verified")
    found = known.filter("similar").select("a", "b", "d")
    labels = components(found)
    judged = known.select(F.col("a").alias("_lead"), F.col("b").alias("_node"), "d", F.col("similar").alias("_linked"))
    rest = followers.join(judged, ["_lead", "_node"])
    # What the open nodes v of a bucket leave room for: a linked node u may be similar to v only if
    # d(v) - d(u) is at most the limit of the longer of both.
    limit = F.floor((1 - threshold) * F.col("n_words") + 1e-9)
    room = rest.filter("NOT _linked").groupBy("_band", "_key").agg(F.min("d").alias("_least"), F.min(F.col("d") - limit).alias("_slack"))
    may = (F.col("d") + limit >= F.col("_least")) | (F.col("d") >= F.col("_slack"))
    rest = rest.join(room, ["_band", "_key"]).filter(~F.col("_linked") | may).select("_band", "_key", "_node", "n_words")
    rest = rest.join(labels, "_node", "left").withColumn("_class", F.coalesce("_class", "_node"))
    crowd = rest.groupBy("_band", "_key").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high"))
    state = stored(rest.join(crowd.filter("_low != _high").drop("_low", "_high"), ["_band", "_key"]), "state")
    if state.isEmpty():
        return found, labels
    more = stored(_left_over(state, members, texts, threshold), "left")
    return found.unionByName(more).distinct(), _joined(labels, more)


def links(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links of :func:`linked`."""
    return linked(members, texts, threshold)[0]


def components(edges: DataFrame) -> DataFrame:
    """_node and _class (the smallest node reached) for the nodes of ``edges`` (a, b).

    Each round a node takes the smallest class among its own and its neighbours', then its class's class;
    rounds end when no node changes, after about the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("_node")).agg(F.least(F.min("a"), F.min("b")).alias("_class")), "classes")
    while True:
        near = both.join(labels, both["b"] == labels["_node"]).groupBy(F.col("a").alias("_node")).agg(F.min("_class").alias("_seen"))
        lower = labels.join(near, "_node").select("_node", F.col("_class").alias("_old"), F.least("_class", "_seen").alias("_class"))
        up = labels.select(F.col("_node").alias("_class"), F.col("_class").alias("_upper"))
        new = lower.join(up, "_class").select("_node", "_old", F.least("_class", "_upper").alias("_class"))
        new = stored(new, "classes")
        changed = new.filter(F.col("_old") != F.col("_class")).isEmpty()
        discard(labels)
        labels = new.drop("_old")
        if changed:
            return labels


def _classes(docs: DataFrame, text: str, key: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _node), and the class of each node with its first key, links and copies."""
    rows = stored(sketched(docs, text, key), "sketches")
    nodes = rows.groupBy("_node").agg(
        F.min("_id").alias("_first"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"), F.first("keys").alias("keys")
    )
    nodes = stored(nodes, "nodes")
    spread = nodes.select("_node", "n_words", F.posexplode("keys").alias("_band", "_key"))
    full = spread.groupBy("_band", "_key").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = stored(spread.join(full, ["_band", "_key"]).select("_band", "_key", "_node", "n_words"), "members")
    # One row for each text that an alignment may need.
    some = members.select("_node").distinct().join(nodes.select("_node", "_first"), "_node")
    named = docs.select(F.col(key).alias("_id"), node_of(text).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = named.join(some, (named["_own"] == some["_node"]) & named["_id"].eqNullSafe(some["_first"])).select("_node", "_text")
    texts = stored(texts.dropDuplicates(["_node"]), "texts")
    edges, classes = linked(members, texts, threshold)
    degree = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("_node")).agg(F.count("*").alias("n_links"))
    placed = nodes.select("_node", "_first", "n_copies").join(classes, "_node", "left").join(degree, "_node", "left")
    placed = placed.withColumn("_class", F.coalesce("_class", "_node"))
    # A class is named by its smallest key, of equals by the smallest text.
    head = F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "_node")).alias("head")
    placed = placed.join(placed.groupBy("_class").agg(head), "_class")
    placed = stored(placed.select("_node", "_first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "head"), "placed")
    for old in (members, texts, nodes):
        discard(old)
    return rows.select("_id", "_node"), placed


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id (the smallest key of the class), n_links and n_copies of every row.

    Texts whose word sequences have an edit similarity (1 - edits / words of the longer) of
    ``threshold`` or more are linked where an Order MinHash sketch brings them together; classes are
    connected components. Equal texts are one node of that graph. n_links: other texts that an alignment linked to the
    row's text, enough to hold the class together; n_copies: rows with the row's text.

    A null text counts as empty, and empty texts are copies of one another. Texts of fewer than four
    words have no sketch and are grouped with equal texts only. Rows that repeat a key are rows of their own; a
    class is named by null only if it has no other key. An empty table gives no rows. Other columns are not carried.

    Sketches miss a pair at random. With words replaced all over texts of 150 words, 25 of 300 pairs at an edit
    similarity of 0.8 were missed, 5 at 0.85 and none at 0.9 and 0.95.
    """
    kind = docs.schema[key].dataType
    rows, placed = _classes(docs, text, key, threshold)
    out = rows.join(placed, "_node")
    return out.select(
        F.col("_id").cast(kind).alias(key), F.col("head._first").cast(kind).alias("class_id"), "n_links", "n_copies"
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest key stays, of equal rows one.

    Columns may have any name.
    """
    rows, placed = _classes(docs, text, key, threshold)
    heads = rows.join(placed.filter(F.col("_node") == F.col("head._node")), "_node").filter(F.col("_id").eqNullSafe(F.col("_first")))
    heads = stored(heads.groupBy("_node", "_id").agg(F.count("*").alias("_rows")), "heads")
    owned = docs.select(F.struct("*").alias("_row"), node_of(text).alias("_own"), F.col(key).alias("_key"))

    def of(some: DataFrame) -> DataFrame:
        return owned.join(some, (owned["_own"] == some["_node"]) & owned["_key"].eqNullSafe(some["_id"]), "left_semi")

    chosen, again = of(heads.filter("_rows = 1")), heads.filter("_rows > 1")
    if not again.isEmpty():  # only heads that repeat need a choice
        chosen = chosen.union(of(again).dropDuplicates(["_own"]))
    return chosen.select("_row.*")
