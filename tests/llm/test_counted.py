"""op1 and op10: counts over the corpus, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import arrays, lm_scoring, substring

SCHEMA = "doc_id long, text string, n_words long, kept string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "naïve", "the", "a" * 40]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 90))), 1, "x") for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]}\t{passage}\n{rows[i + 1][1]}", 2, None) for i in range(5)]
    rows += [(200, None, 0, None), (201, "", 0, None), (202, " \n\t ", 0, None), (None, "lone text", 1, None)]
    rows += [(203, " ".join(["again"] * 3000), 3, None), (203, rows[0][1], 3, None), (204, passage, 0, None), (204, passage, 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_of_a_batch():
    texts = ["", None, " a  bb\tccc\n", "é\x0bÄ\x85x", "x" * 100, "a"]
    found = arrays.find_words(pa.array(texts))
    raw = found.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(found.starts[a:b], found.ends[a:b])] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    assert got == [words(t) for t in texts]
    hashes = arrays.word_hashes(found)
    assert len(set(hashes.tolist())) == len({w for t in texts for w in words(t)})
    assert arrays.find_words(pa.array([], pa.string())).counts().tolist() == []


def test_packing_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        assert (arrays.unpack_sorted(arrays.pack_sorted(keys)) == keys).all()
        small = rnd.integers(0, 300, n).astype(np.uint64)
        assert (arrays.unpack(arrays.pack(small, squeeze=True), squeezed=True) == small).all()


def test_rolling_equal_windows_only():
    h = arrays.mix(np.random.default_rng(2).integers(0, 5, 3000).astype(np.uint64))
    got = arrays.rolling(h, 4)
    want = [tuple(h[i:i + 4].tolist()) for i in range(len(h) - 3)]
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def removed(rows, window):
    count = collections.Counter(tuple(w[i:i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window,chunk", [(35, 8 << 20), (35, 3000), (4, 1000)])
def test_substring_removal(docs, window, chunk):
    out = substring.remove_repeats(docs, window=window, chunk_bytes=chunk).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in out) == removed([words(r.text) for r in docs.collect()], window)
    for r in out:
        assert sum(i.end - i.start for i in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:]))


def test_substring_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def scores(rows, backoff=0.4):
    def grams(w, n):
        return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]

    total = {n: collections.Counter(g for w in rows for g in grams(w, n)) for n in (1, 2, 3)}
    everything, out = sum(map(len, rows)), []
    for w in rows:
        own = {n: collections.Counter(grams(w, n)) for n in (1, 2, 3)}
        c = lambda g: total[len(g)][g] - own[len(g)][g]
        rest, score, steps = everything - len(w), 0.0, 0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if c(g) > 0:
                    score += math.log10(factor * c(g) / (c(g[:-1]) if n > 1 else rest))
                    break
                factor *= backoff
                steps += 1
            else:
                score += math.log10(factor / (rest + 1))
        out.append((len(w), steps, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_scores(docs, chunk):
    out = lm_scoring.score_documents(docs, chunk_bytes=chunk).collect()
    got = sorted((r.n_words, r.n_backoff, round(r.log10_score, 6)) for r in out)
    want = scores([words(r.text) for r in docs.collect()])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want))
    for r in out:
        assert (r.log10_per_word is None) == (r.n_words == 0)


def test_scores_of_empty_and_single(spark):
    assert lm_scoring.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a b a", 0, "")], SCHEMA)
    assert round(lm_scoring.score_documents(one).first().log10_score, 6) == scores([["a", "b", "a"]])[0][2]


def test_key_bits_grow_with_the_corpus():
    assert lm_scoring.key_bits(10**6, 3) < lm_scoring.key_bits(10**12, 3) < lm_scoring.key_bits(10**15, 3) == 64


def test_ngrams_that_share_leading_hash_bits_are_told_apart(spark):
    names = [f"w{i}" for i in range(60_000)]
    keys = arrays.ngrams(arrays.word_hashes(arrays.find_words(pa.array([" ".join(names)]))), 1) >> np.uint64(36)
    order = np.argsort(keys, kind="stable")
    i = int(np.flatnonzero(keys[order][1:] == keys[order][:-1])[0])
    rows = [[names[order[i]], "x"], [names[order[i + 1]], "y"]]
    got = lm_scoring.score_documents(spark.createDataFrame([(k, " ".join(w), 0, "") for k, w in enumerate(rows)], SCHEMA)).collect()
    assert sorted((r.n_words, r.n_backoff, round(r.log10_score, 6)) for r in got) == scores(rows)


def test_kept_digest(docs):
    r = next(r for r in substring.remove_repeats(docs).collect() if r.doc_id == 204)
    assert (r.n_words, r.n_removed, r.kept) == (60, 60, "")
    assert hashlib.sha256(r.kept.encode()).hexdigest().startswith("e3b0c442")
