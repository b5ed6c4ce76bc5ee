"""op11 to op13: quartile digests, conversation repair and the Merkle manifest, against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, quartile, repair

# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    texts = [None if v is None else str(v) for v in values]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 16])) for i in range(0, len(low), 16)])
    return levels


def path_in(levels, i):
    """Siblings left and right, from the leaf up."""
    out = []
    for low in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(low[first:i]), "".join(low[i + 1:first + 16])))
        i //= 16
    return out


def merkle_brute(rows, shown):
    """rows: (doc_id, source, lang, n_chars, text); gives a list of result tuples."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree_of([leaf_of(r) for r in by[s]])
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = path_in(trees[s], i) + path_in(top, j)
            d = leaf_of(shown(r))
            for a, b in path:
                d = sha(a + d + b)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], "".join(a + b for a, b in path), d, d == top[-1][0]))
    return out


def key_of(row):
    return tuple((v is None, v) if v is not None else (True, 0) for v in row)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, _block string, leaf string, root string, digest string"


def check_merkle(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], MERKLE)
    out = merkle.manifest(docs, shown={"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))}).collect()
    want = merkle_brute(rows, lambda r: (*r[:4], r[4].lower() if r[4] and r[0] is not None and r[0] % 3 == 0 else r[4]))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out]
    assert sorted(got, key=key_of) == sorted(want, key=key_of)
    for r in out:  # places and lengths of the runs account for the proof
        assert 64 * sum(int(s.split("/")[1]) - 1 for s in r.steps.split()) == len(r.proof)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16], [17, 1], [257, 3, 16, 1], [40] * 18])
def test_manifest_of_small_trees(spark, sizes):
    rows = [(1000 * j + i, f"s{j}", "en", 5, f"Text {i}") for j, n in enumerate(sizes) for i in range(n)]
    check_merkle(spark, rows)


def test_manifest_of_nulls_ties_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "", 0, "B"), (2, None, "é", 1, "É"),
        (3, "é", None, 2, "ABC"), (3, "z", None, 2, "ABC"), (-5, "z", None, None, "x" * 300_000), (None, "z", "a", 1, "q"),
        (None, "z", "a", 1, "q"), (6, "Z", "-", 1, "-"),
    ]
    check_merkle(spark, rows)
    check_merkle(spark, [])


def test_manifest_across_superblocks(spark):
    rows = [(i, "big", "en", 1, f"T{i}") for i in range(9000)] + [(20_000 + i, f"s{i}", None, 1, "A") for i in range(30)]
    random.Random(3).shuffle(rows)
    check_merkle(spark, rows)


def test_manifest_of_many_sources(spark):
    check_merkle(spark, [(i, f"s{i}", None, 1, "A") for i in range(4200)])


# --- quartile digests


def digest_brute(text):
    raw = text.encode()
    data = b"\xff\xff" + raw + b"\xff\xff"
    count = [0] * 256
    for i in range(len(data) - 2):
        v = data[i] + 256 * data[i + 1] + 65536 * data[i + 2]
        count[(v * 2654435761 % 2**32) >> 24] += 1
    ranked = sorted(count)
    code = [sum(c > ranked[q] for q in (63, 127, 191)) for c in count]
    length = min(255, math.floor(8 * math.log2(len(raw) + 1)))
    return bytes([length, *(sum(code[4 * j + k] << 2 * k for k in range(4)) for j in range(64))]).hex(), [length, *code]


def near_brute(a, b):
    a, b = digest_brute(a)[1], digest_brute(b)[1]
    apart = sum(abs(x - y) for x, y in zip(a[1:], b[1:])) + 2 * min(32, abs(a[0] - b[0]))
    return 1 - min(320, apart) / 320


def neighbours_brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), r[1].encode()))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        out.append((k, len(t), sha(new), digest_brute(t)[0], digest_brute(new)[0], near_brute(t, new), near_brute(t, after)))
    return sorted(out, key=key_of)


def check_neighbours(spark, rows, parts=None):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "doc_id long, text string, _text string, fingerprint string, _part int")
    out = quartile.compare_neighbours(docs.repartition(parts) if parts else docs)
    assert out.columns == ["doc_id", *[c.split()[0] for c in quartile.COMPARED.split(", ")]]
    assert sorted(map(tuple, out.collect()), key=key_of) == neighbours_brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_neighbours_in_order(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 - 20, "".join(rng.choice("ab cé😀\n.") for _ in range(rng.randrange(60)))) for i in range(n)]
    rng.shuffle(rows)
    check_neighbours(spark, rows, 4)


def test_neighbours_with_nulls_ties_and_long_texts(spark):
    long = "lorem ipsum dolor " * 200_000
    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (1, "b"), (1, "a"), (2, long), (3, long), (4, "x"), (9, None)]
    check_neighbours(spark, rows, 3)


def test_digests_of_many_texts_at_once():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 2, 5, 300]))).encode() for _ in range(500)]
    coded = quartile.codes(texts)
    assert quartile.digests(coded) == [digest_brute(t.decode())[0] for t in texts]
    assert (quartile.parsed(quartile.digests(coded)) == coded).all()


def test_fingerprints_column(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "one")], "id long, text string")
    got = {r.id: r.fingerprint for r in quartile.fingerprints(docs).collect()}
    assert got == {1: digest_brute("one")[0], 2: digest_brute("")[0], 3: got[1]}


def test_likeness_follows_shared_text(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(60)]
    shared, other = [], []
    for a, b in zip(texts, texts[1:]):
        assert near_brute(a, a) == 1
        shared.append(near_brute(a, quartile.edited(a, b)))
        other.append(near_brute(a, b))
    assert all(x > y for x, y in zip(shared, other)) and sum(shared) > 2 * sum(other)


# --- conversation repair

SPACES = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """rows in order: (role, text); gives blank, duplicate, truncated or ok."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "ok" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by trying all edits, with up to two inserts at any place."""
    pattern = re.compile(r"(s?(ua)+)?")

    @functools.cache
    def best(i, made):  # made: what is left to match, as the last initials
        options = []
        if i == len(rows):
            if pattern.fullmatch(made):
                return (0, "", ())
            options += [(3, "I", r, best_or_none(i, made + r[0], r)) for r in ("user", "assistant") if len(made) < limit]
        else:
            role, text = rows[i]
            gone = faults[i] in ("blank", "duplicate")
            more = 3 if faults[i] == "truncated" else 0
            options.append((4, "D", None, best_or_none(i + 1, made, None)))
            if not gone:
                options.append((more, "K", f"{role}:{text}", best_or_none(i + 1, made + (role[:1] or " "), role)))
                options += [(3 + more, "R", f"{r}:{text}", best_or_none(i + 1, made + r[0], r)) for r in ("user", "assistant")]
            options += [(3, "I", r, best_or_none(i, made + r[0], r)) for r in ("user", "assistant") if len(made) < limit]
        found = [
            (c + o[0], letter + o[1], ((line + ":" if letter == "I" else line,) if line else ()) + o[2])
            for c, letter, line, o in options if o is not None
        ]
        return min(found) if found else None

    def best_or_none(i, made, _):
        if not re.fullmatch(r"(s?(ua)*u?)?", made):
            return None
        return best(i, made)

    limit = len(rows) + 4
    return best(0, "")


def repaired_brute(rows):
    """rows: (conv, turn, role, text, copies) with nulls; gives {conv: tuple}."""
    by = collections.defaultdict(list)
    for conv, turn, role, text, copies in rows:
        by[conv] += [(turn, role if role is not None else " ", text if text is not None else " ")] * copies
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        said = [(r, t) for _, r, t in own]
        faults = faults_of(said)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, lines = cheapest(said, faults) if said else (0, "", ())
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, copies int, n string, _conv string, fault string, edit string"


def check_repair(spark, rows, parts=1):
    table = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], CONVERSATIONS).repartition(parts)
    got = repair.repair(table, copies="copies").collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == repaired_brute(rows) and len({r.conv_id for r in got}) == len(got)


def random_rows(rng, conv, n, texts):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    return [(conv, rng.choice([None, i, i, i, i + 2]), rng.choice(roles), rng.choice(texts), rng.choice([0, 1, 1, 1, 2])) for i in range(n)]


TEXTS = ["Yes.", "No!", "Well", "and", "", " \n", None, "Why?\n", "a.b", "é.", "é"]


def test_repairs_of_random_conversations(spark):
    rng = random.Random(11)
    rows = [r for c in range(150) for r in random_rows(rng, c, rng.randrange(1, 8), TEXTS)]
    check_repair(spark, rows, 3)


def test_repairs_of_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "x" * 300_000, 1), (None, 2, "assistant", "ok.", 3), (5, None, "user", "Hi.", 0)]
    rows += [(6, 1, "user", "Hi.", 5), (6, 1, "user", "Hi.", 2), (6, 2, "user", "Hi.", 4), (7, 3, "system", "Be brief.", 1)]
    check_repair(spark, rows)
    assert repair.repair(spark.createDataFrame([], CONVERSATIONS), copies="copies").count() == 0


def test_conversations_cut_by_partitions(spark):
    rng = random.Random(12)
    texts = [f"{i}{end}" for i in range(40) for end in (".", "", "!")]
    for seed in range(3):
        rows = random_rows(rng, 1, 60, texts) + random_rows(rng, 2, 3, texts) + random_rows(rng, 3, 45, texts)
        held = repair.faulty(spark.createDataFrame([(*r, "", "", "", "") for r in rows], CONVERSATIONS), "conv_id", "turn", "role", "text", "copies")
        ranged = held.repartitionByRange(3, "_conv", "turn", "role").select("_conv", F.spark_partition_id().alias("p"))
        assert ranged.groupBy("_conv").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() > 0
        check_repair(spark, rows)


def test_runs_pass_powers():
    rng = random.Random(2)
    for _ in range(200):
        symbol = (rng.choice("sua "), rng.choice(["ok", "truncated", "blank"]))
        n, v = rng.randrange(1, 40), tuple(rng.choice([0, 3, 6, repair.NONE]) for _ in range(4))
        slow = v
        for _ in range(n):
            slow = repair.through(repair.power(symbol, 0), slow)
        assert repair.before_run(symbol, n, v) == slow == repair.through(repair.run_matrix(symbol, n), v)


def test_damage(spark):
    rows = [(c, t, r, "A. B? C!") for c in (None, 1, 2, 30) for t in (None, *range(30)) for r in ("assistant", None)]
    out = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want.append((c, t, "user" if k == 4 else r or " ", "" if k == 1 else "A B C" if k == 2 else text, {0: 0, 3: 2}.get(k, 1)))
    assert sorted(map(tuple, out), key=key_of) == sorted(want, key=key_of)
