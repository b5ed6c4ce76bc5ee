"""op2 to op6: shards, archives, mixes, benchmark items and near duplicates, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontam, mixing, near_dup, quality, sharding, warc

SCHEMA = "doc_id long, text string, source string, shard string, size string, class_id string, copies string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows):
    """Rows of (doc_id, text, source) with other columns whose names the operators use as well."""
    return spark.createDataFrame([(*r, "s", "z", "c", "k") for r in rows], SCHEMA)


# --- shards


def check_shards(out, rows, shards):
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    count = collections.Counter(r.shard for r in out)
    counts = [count.get(s, 0) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i % 90}", "a") for i in range(180)] + [(1000 + i, f"single {i}", "b") for i in range(300)]
    rows += [(None, None, None), (None, "", None), (5, "text 5", "a"), (5, "text 5", "a")]
    out = sharding.assign(table(spark, rows), 8).collect()
    check_shards(out, rows, 8)
    groups = collections.defaultdict(set)
    for r in out:
        groups[r.text_crc32, r.size].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 5  # of 90 groups


def test_shards_of_a_group_that_fills_a_third(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}", "a") for i in range(600)]
    out = sharding.assign(table(spark, rows), 4).collect()
    check_shards(out, rows, 4)
    held = collections.Counter(r.shard for r in out if r.text_crc32 == zlib.crc32(b"same"))
    assert len([n for n in held.values() if n > 10]) <= 3 and max(held.values()) >= 100


def test_shards_of_few_rows(spark):
    assert sharding.assign(table(spark, []), 8).count() == 0
    check_shards(sharding.assign(table(spark, [(1, "a", "s"), (2, "a", "s")]), 8).collect(), [(1, "a", "s"), (2, "a", "s")], 8)


# --- archives


def test_arc_versions_and_declared_lengths():
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nbody\n\nwith 1 0 lines\n", b"", b"plain\n"]
    for version in (1, 2):
        data = warc.arc_head("x.arc", version, "20240101000000")
        for i, b in enumerate(blocks):
            data += warc.arc_record(f"http://a/{i} b", "20240101000001", b, version, "x.arc", len(data))
        got = list(warc.arc_records(data))
        assert [b for _, _, b in got] == blocks
        assert [f["URL"] for _, f, _ in got] == ["http://a/0%20b", "http://a/1%20b", "http://a/2%20b"]
        assert set(got[0][1]) == set(warc.ARC_FIELDS[version])
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-9]))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://a 0.0.0.0 2024 text/html 3\nabc\n"))


def test_archives_round_trip(spark):
    long = "<p>" + "é x\r\n\r\n" * 40000
    html = [None, "", "short", "short", "x" * 100, "x" * 100, "x" * 99, "x" * 99, long, long, long, "WARC/1.1\r\n\r\n" * 20]
    rows = [(i, None if i == 4 else f"http://h/{i} {i}", h, "t") for i, h in enumerate(html)]
    rows += [(None, "u", "y" * 200, "t"), (3, "u", "y" * 200, "t"), (3, "u", "y" * 200, "t"), (None, "", "y" * 200, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    out = warc.archive(pages).collect()
    assert all(r.intact for r in out) and len({r.record_id for r in out}) == len(rows)
    body = lambda h: (h or "").encode()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest) for r in out) == sorted(
        (-1 if i is None else i, len(body(h)), hashlib.sha256(body(h)).hexdigest()) for i, _, h, _ in rows
    )
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in out if r.page_id is not None and r.page_id > 3}
    assert kinds[4, 100] == ("response", None) and kinds[5, 100] == ("revisit", 4)
    assert kinds[6, 99] == kinds[7, 99] == ("response", None)
    assert [kinds[i, len(body(long))] for i in (8, 9, 10)] == [("response", None), ("revisit", 8), ("revisit", 8)]
    ties = sorted((r.page_id is None, r.record_type, r.refers_to) for r in out if r.payload_bytes == 200)
    assert ties == [(False, "response", None), (False, "revisit", 3), (True, "revisit", 3), (True, "revisit", 3)]
    assert warc.archive(pages.limit(0)).count() == 0


# --- mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By repeating the split until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        level = rest / total if total else 0
        new = {s for s in order if s not in full and level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= new


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 10, 100, 5000]) for i in range(rnd.randrange(1, 12))} | {None: 40, "é": 7, "": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert {s: g[0] for s, g in got.items()} == sizes
    assert all(got[s][1] == pytest.approx(want[s]) for s in sizes)


def test_settling_keeps_words_and_means():
    rnd = np.random.default_rng(5)
    part, size = rnd.random(12), rnd.integers(1, 50, 12)
    order = np.argsort(-size)
    part, size = part[order], size[order]
    total = np.zeros(12)
    for _ in range(20000):
        out = mixing._settle(part, size, rnd)
        assert (out * size).sum() == pytest.approx((part * size).sum())
        assert ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 20000 - part).max() < 0.02


def test_mix(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join("w" * rnd.randrange(1, 60)), "big" if i % 3 else f"s{i % 7}") for i in range(700)]
    rows += [(None, "a b c", None), (None, "a b c", None), (3, None, "big"), (3, "", "big"), (8, rows[8][1], rows[8][2])]
    docs = table(spark, rows).withColumnRenamed("shard", "target")
    out = mixing.mix(docs, per_group=8).collect()
    assert sorted(r.size for r in out) == sorted(len(words(t)) for _, t, _ in rows)
    assert all(r.taken == r.size * r.copies and r.taken <= 2 * r.size for r in out)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(dict(sizes))
    for s, n in sizes.items():
        mine = [r for r in out if r.source_size == n]
        assert mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 60
    again = collections.Counter(mixing.mix(docs, per_group=8).collect())
    assert again == collections.Counter(out)
    taken = mixing.mixed(docs, per_group=8)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in out)
    got = collections.Counter(r.doc_id for r in taken.collect())
    by_id = collections.Counter()
    for r in out:
        by_id[r.doc_id] += r.copies
    assert +got == +by_id
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mix_of_many_sources(spark, monkeypatch):
    """Groups above the first level are split by source, so many sources do not meet in one task."""
    monkeypatch.setattr(mixing, "PER_GROUP", 16)
    rnd = random.Random(9)
    rows = [(i, " ".join("w" * rnd.randrange(1, 9)), f"s{i // 4:03}") for i in range(800)]
    out = mixing.mix(table(spark, rows), per_group=4).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, of = targets(dict(sizes)), {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in out:
        taken[of[r.doc_id]] += r.taken
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)  # one open document at most, of 8 words at most
    again = mixing.mix(table(spark, rows), per_group=4).collect()
    assert collections.Counter(again) == collections.Counter(out)


# --- benchmark items


def shingles(text):
    w = words((text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def leaks(docs, items, threshold=0.8):
    out = {}
    for d, t, *_ in docs:
        s = shingles(t)
        for i, x in items:
            bag = collections.Counter(shingles(x))
            m = sum(bag.values())
            for a in range(max(1, len(s) - m + 1)) if s and m else []:
                w = collections.Counter(s[a:a + m])
                n = sum((w & bag).values())
                v = n / (m + sum(w.values()) - n)
                if v >= threshold and v > out.get((d, i), (0,))[0]:
                    out[d, i] = (v, a)
    return out


def test_benchmark_items(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 60))) for i in range(12)] + [(50, "one two"), (51, None), (52, "a b c a b c a b c a b c"), (53, "Straße Ä é ñ x")]
    docs = []
    for i in range(80):
        x = words(rnd.choice(items[:12])[1])
        for _ in range(rnd.randrange(0, 4)):
            x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            x.insert(rnd.randrange(len(x)), "extra")
        docs.append((i, " ".join([text(rnd.randrange(0, 40)), *x, text(rnd.randrange(0, 40))]), "s"))
    docs += [(100, None, "s"), (101, "", "s"), (102, "A B C " * 40, "s"), (103, " ".join(words(items[0][1])[:-1]), "s"), (104, "the straße ä É ñ x y", "s")]
    docs += [docs[0], docs[0], (None, items[1][1].upper(), "s")]
    # Items again and again, whole and in parts, over many stretches of their length.
    docs += [(110 + i, " ".join(" ".join(words(items[j][1])[rnd.randrange(0, 4):]) + " z" * rnd.randrange(3) for j in (i, i + 4) * 9), "s") for i in range(4)]
    items.append((None, text(30)))
    docs.append((120, text(20) + " " + items[-1][1], "s"))
    bench = spark.createDataFrame([(i, t, "n") for i, t in items] + [(0, items[0][1], "n")], "item_id long, text string, start string")
    out = decontam.contaminated(table(spark, docs), bench).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in out}
    want = leaks(docs, items)
    assert len(got) == len(out) and got.keys() == want.keys() and len(want) > 15
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    clean = decontam.without_benchmark(table(spark, docs), bench)
    assert clean.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, *_ in docs if not any(k[0] == d for k in want))
    assert decontam.contaminated(table(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminated(table(spark, []), bench).count() == 0


def test_long_texts_that_repeat_an_item(spark):
    """Every window of a long text may hold the item: stretches of its length are looked through, not the whole text for each."""
    item = " ".join(f"v{i}" for i in range(40))
    n = 150
    docs = spark.createDataFrame([(1, " ".join([item] * n)), (2, " ".join(["q"] * n + [item]))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, " ".join(["q"] * 12))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontam.contaminated(docs, bench).collect()}
    # Windows of 36 shingles: a turned one holds the item's shingles but for the four that cross its end.
    assert got == {(1, 5): (0, 40, 1.0), (2, 5): (n, 40, 1.0), (2, 6): (0, 12, 1.0)}


# --- stages on tables with names of their own


def test_stages_keep_columns_of_any_name(spark):
    """Columns called like the stages' own intermediate ones come out as they went in."""
    own = [
        "_k1", "_k2", "_row", "_own", "_key", "_node", "_id", "_item", "_copies", "_copy", "_name", "_source", "_size", "_nth", "_n", "_tie",
        "_words", "_t", "_l", "_lang", "_kept0", "_chars", "head", "size", "group", "a.b", "_rows", "_first", "similarity", "start",
    ]
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("the of and to in alpha beta gamma delta".split()) for _ in range(60)) for _ in range(6)]
    texts += [texts[0], texts[1] + " more"]
    rows = [(i, t, "s", "en", *[f"{i}/{c}" for c in own]) for i, t in enumerate(texts)]
    rows.append((7, texts[7], "s", "en", *[f"again/{c}" for c in own]))
    schema = ", ".join(f"`{c}` string" for c in ("text", "source", "lang", *own))
    docs = spark.createDataFrame(rows, f"doc_id long, {schema}")
    items = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    given = collections.Counter(tuple(r) for r in rows)

    def out_of(df):
        assert df.columns == docs.columns
        return collections.Counter(tuple(r) for r in df.collect())

    clean = out_of(decontam.without_benchmark(docs, items))
    assert clean == collections.Counter({r: n for r, n in given.items() if r[0] != 3})
    heads = out_of(near_dup.one_of_each(docs))
    assert set(heads) <= set(given) and sorted(r[0] for r in heads) == [0, 1, 2, 3, 4, 5]
    mixed = out_of(mixing.mixed(docs, share=2.0))
    assert mixed == collections.Counter({r: 2 for r in given})
    judged = quality.judge(docs)
    assert collections.Counter(tuple(r) for r in judged.select(*[f"`{c}`" for c in docs.columns]).collect()) == given
    assert sharding.assign(docs, shards=3).count() == len(rows)


# --- near duplicates


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_distance_against_the_whole_table():
    rnd = random.Random(1)
    for _ in range(1500):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(0, 45))]
        b = [x for x in a if rnd.random() > 0.1]
        for _ in range(rnd.randrange(0, 6)):
            b.insert(rnd.randrange(len(b) + 1), rnd.randrange(5))
        if rnd.random() < 0.3:
            b = [rnd.randrange(5) for _ in range(rnd.randrange(0, 45))]
        d = edits(a, b)
        for most in (0, 3, 18, 60):
            got = near_dup.distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
            assert got == d if d <= most else most < got <= d


def near_rows(rnd, vocabulary=2000):
    text = lambda n: [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
    rows, want, k = [], [], 0
    passage = text(60)
    for g in range(25):
        base, own = text(rnd.randrange(60, 200)), []
        for c in range(rnd.choice([1, 2, 3, 12])):
            x = list(base)
            for _ in range(len(x) // 70 if c else 0):
                x[rnd.randrange(len(x))] = "new" + str(rnd.randrange(99))
            rows.append((k, " ".join(x), "s"))
            own.append(k)
            k += 1
        want.append(own)
    for g in range(30):  # one passage, otherwise different
        rows.append((k, " ".join(text(40) + passage + text(40)), "s"))
        want.append([k])
        k += 1
    return rows, want, k


def test_near_duplicate_classes(spark):
    rnd = random.Random(4)
    rows, want, k = near_rows(rnd)
    rows += [(k, None, "s"), (k + 1, "", "s"), (k + 2, "few words", "s"), (k + 3, "few words", "s"), (k + 4, "few word", "s")]
    want += [[k, k + 1], [k + 2, k + 3], [k + 4]]
    rows += [(k + 5, "again " * 4000, "s"), (k + 6, "again " * 3900, "s"), rows[0]]
    want += [[k + 5, k + 6]]
    out = near_dup.near_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.class_id for r in out}
    assert got == {i: min(own) for own in want for i in own}
    assert {r.doc_id: r.n_copies for r in out}[0] == 2 and {r.doc_id: r.n_copies for r in out}[k + 2] == 2
    one = near_dup.one_of_each(table(spark, rows))
    assert one.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in one.collect()) == sorted(min(own) for own in want)
    assert near_dup.near_duplicates(table(spark, [])).count() == 0 and near_dup.one_of_each(table(spark, [])).count() == 0


def test_null_and_repeated_keys(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(None, text, "s"), (None, text, "s"), (7, text + " y", "s"), (7, "other " * 9, "s"), (None, "lone " * 6, "s")]
    out = near_dup.near_duplicates(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_copies) for r in out) == collections.Counter(
        {(None, 7, 2): 2, (7, 7, 1): 2, (None, None, 1): 1}
    )
    assert near_dup.one_of_each(table(spark, rows)).count() == 3


@pytest.mark.parametrize("tile", [4, 2048])
def test_chains_and_rounds_lose_no_link(spark, monkeypatch, tile):
    """One bucket of a chain, far texts and copies: its texts get the classes that all pairs give, whatever leads."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    rnd = random.Random(9)
    base = [f"c{i}" for i in range(50)]
    chain = [base]
    for _ in range(5):
        x = list(chain[-1])
        for i in rnd.sample(range(50), 7):
            x[i] = f"n{rnd.randrange(10**6)}"
        chain.append(x)
    texts = [*chain, *[[f"far{g}{i}" for i in range(50)] for g in range(6)], *[[*base[:-1], f"e{i}"] for i in range(5)]]
    rows = [(bytes([i]), " ".join(t)) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "_node binary, _text string")
    members = nodes.selectExpr("0 AS _band", "5L AS _key", "_node", "50L AS n_words")
    found = near_dup.links(members, nodes).collect()
    classes = {bytes(r._node): bytes(r._class) for r in near_dup.components(spark.createDataFrame(found)).collect()}
    # Classes by all pairs.
    owner = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if edits(texts[i], texts[j]) <= 10:
                owner = [owner[j] if o == owner[i] else o for o in owner]
    want = {bytes([i]): bytes([min(k for k in range(len(owner)) if owner[k] == owner[i])]) for i in range(len(texts)) if owner.count(owner[i]) > 1}
    assert classes == want


def test_closed_nodes_of_two_leaders_are_linked(spark):
    """Chains under permuted ids, a bucket each: the middle link joins two nodes that different leaders may have taken."""
    rnd = random.Random(3)
    rows, want = [], {}
    for g in range(24):
        x, chain = [f"g{g}w{i}" for i in range(50)], []
        for c in range(4):
            chain.append(" ".join(x))
            for i in range(8 * c, 8 * c + 8):
                x[i] = f"g{g}n{i}"
        ids = [bytes([g, i]) for i in rnd.sample(range(4), 4)]
        rows += [(g, i, t) for i, t in zip(ids, chain)]
        want |= {i: bytes([g, 0]) for i in ids}
    nodes = spark.createDataFrame([r[1:] for r in rows], "_node binary, _text string")
    members = spark.createDataFrame([r[:2] for r in rows], "_key long, _node binary").selectExpr("0 AS _band", "_key", "_node", "50L AS n_words")
    found = near_dup.links(members, nodes).collect()
    assert {bytes(r._node): bytes(r._class) for r in near_dup.components(spark.createDataFrame(found)).collect()} == want


def test_sketches_meet_at_the_threshold():
    """Pairs with words replaced all over the text, at the edit similarity that is named."""
    rnd = random.Random(8)
    for similar, least in ((0.8, 0.9), (0.85, 0.97), (0.9, 0.99), (0.95, 0.99)):
        texts = []
        for pair in range(300):
            a = [f"{pair}w{i}" for i in range(150)]
            b = list(a)
            for i in rnd.sample(range(150), round(150 * (1 - similar))):
                b[i] = f"{pair}n{i}"
            texts += [" ".join(a), " ".join(b)]
        keys = near_dup.sketches(near_dup.find_words(pa.array(texts)))
        met = sum(bool((keys[i] == keys[i + 1]).any()) for i in range(0, 600, 2)) / 300
        print(similar, met)
        assert met >= least
