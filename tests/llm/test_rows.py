"""op7, op8 and op9: row by row, against brute force."""

import collections
import math
import random
import re

import pytest

from pyspark.sql import functions as F
from tidemark.llm import licenses, quality, urls


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


TEXTS = [
    None, "", "   \n\t", "one", "The cat sat on the mat. " * 30, "a b c d e f g h a b c d e f g h i j", "ÉTÉ %% || <b> é " * 9,
    "x\ny\nx\n\n\ny\r\nx", "\x0bword\x0cword\x1cword word\u00a0word", "w " * 25000, "same line\n" * 400,
    " ".join(f"u{i}" for i in range(50)) + " tail " + " ".join(f"u{i}" for i in range(30)),
]


def counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    rows = [(i, t, ("en", None, "xx", "fr")[i % 4], True, i) for i, t in enumerate(TEXTS + TEXTS[4:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean, n_words int")
    out = quality.judge(docs).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((i, *counts(t)) for i, t, *_ in rows)
    assert not any(r.kept for r in out if r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


def test_junk_is_far_from_its_language(spark):
    plain = [f"the {a} of a {b} and the {b} is in it for a {a} {i}. On {b} was {a} as with {b}, to be by that {i}." for i, (a, b) in enumerate(zip("house tree river stone light".split() * 20, "dog cat bird fish horse".split() * 20))]
    clean = [" ".join(plain[i:i + 4]) for i in range(60)]
    junk = [re.sub(r" ", "### ", clean[0]), clean[1].upper().replace(" ", "!! ")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(60)) and not kept[60] and not kept[61]


def test_divergence_is_between_zero_and_one(spark):
    row = spark.range(1).select(
        quality.divergence(F.array(F.lit(5.0), F.lit(5.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
        quality.divergence(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart"),
        quality.divergence(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("none"),
    ).first()
    assert row.same == pytest.approx(0) and row.apart == pytest.approx(1) and row.none == 0


LICENSED = TEXTS + [
    "Released under the MIT License.", "UNDER THE MIT LICENSE under-the-mit license undér the mit license",
    "Licensed under the Apache License, Version 2.0; apache license version 2 apache license version 2",
    "CC BY-NC 4.0 cc by nc cc by ncx", "cc by nc sa 4.0", "mit license", "under the mit", "the GNU Lesser General Public License v2.1 or later",
    "under the mit license " * 3000, "SPDX-License-Identifier: MIT", "licensed under the GNU General Public License, version 3. All rights reserved",
]


def places(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_places_and_labels(spark):
    rows = [(i, t, 0.5, "x") for i, t in enumerate(LICENSED)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, score double, labels string")).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out}
    assert got == {i: places(t) for i, t, *_ in rows}
    for r in out:
        labels = r.labels.split(",")
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert 0 <= r.score <= 1
    label = {r.text: r.labels for r in out}
    assert label["mit license"] == "mit" and label["cc by nc sa 4.0"] == "cc-by-nc,cc-by-nc-sa"
    assert label["the GNU Lesser General Public License v2.1 or later"] == "lgpl-2.1"
    assert label["SPDX-License-Identifier: MIT"] == "mit"


def test_license_suppression(spark):
    """Against the definition: inside one of the same or higher priority, or around one of a higher."""
    docs = spark.createDataFrame([(t,) for t in LICENSED], "text string")
    rows = docs.select(licenses.normal(F.col("text")).alias("n")).select("n", licenses.detections(F.col("n")).alias("d"))
    for r in rows.select("d", licenses.unsuppressed(F.col("d")).alias("k")).collect():
        if len(r.d) > 300:
            continue
        hits = sorted(r.d, key=lambda h: (h.first, -h.last, -h.priority, h.rule))
        inside = lambda a, b: a.first >= b.first and a.last <= b.last
        kept = []
        for i, h in enumerate(hits):
            if not any(inside(h, g) and g.priority >= h.priority for g in hits[:i]):
                kept.append(h)
        kept = [h for h in kept if not any(inside(g, h) and g.priority > h.priority for g in kept)]
        assert sorted(map(tuple, kept)) == sorted(map(tuple, r.k))


URLS = [
    None, "", "no scheme/path", "http://a.net/x", "HTTP://Sub.Example.NET/en/a?utm_source=f#t", "https://example.com/de/x",
    "https://example.com/dex", "http://foo.org/fr/", "http://foo.org", "http://xexample.com/de/", "http://net/", "://net/q://org/fr/",
    "http://www.spam.com/a/index.html", "https://m.spam.com:443/a/?ref=1", "http://spam.com/a?b=2&utm_x=1", "http://ok.com/\nnet/",
]


def test_url_rules_and_list(spark):
    rules = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS + URLS[-4:])], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://spam.com/a",), ("http://spam.com/a",), (None,)], "url string")
    out = urls.judge(pages, listed, rules)
    assert out.columns == ["page_id", "url", "host", "path", "canonical_url", "rule", "listed", "verdict"]

    def expect(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        return host, path, rule and rule.name

    for r in out.collect():
        assert (r.host, r.path, r.rule) == expect(r.url)
    got = {r.url: (r.canonical_url, r.verdict) for r in out.collect()}
    assert got["http://www.spam.com/a/index.html"] == ("spam.com/a", "block")
    assert got["https://m.spam.com:443/a/?ref=1"] == ("spam.com/a", "block")
    assert got["http://spam.com/a?b=2&utm_x=1"] == ("spam.com/a?b=2", "allow")
    assert got[None] == (None, "allow") and got["HTTP://Sub.Example.NET/en/a?utm_source=f#t"][1] == "allow"
    empty = listed.limit(0)
    assert urls.judge(pages, empty, []).filter("verdict <> 'allow'").count() == 0
    assert urls.judge(pages.limit(0), listed, rules).count() == 0


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"))
    filter_, blocks = urls.bloom_filter(listed)
    assert filter_.count() <= blocks
    assert urls.possible_hits(listed, filter_, blocks).count() == 2000
    other = spark.range(20000).select(F.concat(F.lit("v"), "id").alias("url"))
    assert urls.possible_hits(other, filter_, blocks).count() < 200


def test_text_without_common_words_fails(spark):
    """Function words are a third of the clean texts, also at the start of sentences and before commas; the junk's characters are normal."""
    rnd = random.Random(2)
    names, common = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 9))) for _ in range(400)], quality.COMMON["en"]

    def text(share, low=str):
        w = [low(rnd.choice(common)) + rnd.choice(["", "", ","]) if rnd.random() < share else rnd.choice(names) for _ in range(150)]
        return " ".join(x.capitalize() if i % 8 == 0 else x + "." if i % 8 == 7 else x for i, x in enumerate(w))

    rows = [(i, text(0.35)) for i in range(60)] + [(i, text(0.35, str.upper if i % 2 else str.title)) for i in range(60, 64)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows + [(i, text(0.0)) for i in range(64, 68)]], "doc_id long, text string, lang string")
    refs = quality.references(quality.measure(docs.filter("doc_id < 60")))
    out = {r.doc_id: r for r in quality.judge(docs, refs=refs).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[i].kept or out[i].base_failed for i in range(64, 68))
    assert all(out[i].word_divergence < quality.WORD_CHANCE * 2 for i in range(60, 64))
    assert all(out[i].char_divergence < quality.CHAR_LIMIT for i in range(64, 68))


def test_common_words_are_counted_each(spark):
    rows = [("the of, The (and) x and", "en"), ("der und und", "de"), ("of of", "xx"), (None, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    out = quality.measure(docs, keep=["text", "lang"]).select("text", "lang", "_common").collect()
    for r in out:
        w = [x.strip(quality.EDGES).lower() for x in words(r.text)]
        names = quality.COMMON.get(r.lang, [])
        want = [w.count(n) for n in names] + [0] * (16 - len(names))
        assert r._common == [*want, len(w) - sum(want)]


def shortest(parsed, branch, optional):
    """A match of a parsed pattern: that branch of each choice, optional parts or not."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            kind, first = value[0]
            out += "x" if str(kind) == "NEGATE" else chr(first if str(kind) == "LITERAL" else first[0])
        elif name == "MAX_REPEAT":
            low, high, inner = value
            out += shortest(inner, branch, optional) * max(low, min(high, int(optional)))
        elif name == "SUBPATTERN":
            out += shortest(value[-1], branch, optional)
        elif name == "BRANCH":
            out += shortest(value[1][branch], branch, optional)
        else:
            raise AssertionError(name)
    return out


def test_every_license_rule_finds_its_own_match(spark):
    """Texts that hold nothing but a match: each rule's keyword and pattern find it whole, and some label comes out."""
    assert len(licenses.RULES) > 300 and len({(r.label, r.pattern) for r in licenses.RULES}) == len(licenses.RULES)
    texts = [
        (i, shortest(re._parser.parse(r.pattern), branch, optional))
        for i, r in enumerate(licenses.RULES) for branch in (0, -1) for optional in (False, True)
    ]
    rows = spark.createDataFrame(texts, "rule int, text string").select("rule", "text", licenses.normal(F.col("text")).alias("n"))
    rows = rows.select("rule", "text", licenses.detections(F.col("n")).alias("d"))
    bad = [(r.rule, r.text) for r in rows.collect() if (r.rule, 0, len(r.text.split()) - 1) not in {(h.rule, h.first, h.last) for h in r.d}]
    assert not bad
    assert not [r.text for r in licenses.scan(spark.createDataFrame(texts, "rule int, text string")).collect() if not r.labels]


def test_license_rules_in_long_mixed_texts(spark):
    """Places of all rules against Python's regular expressions, and suppression over many chunks of hits."""
    rnd = random.Random(5)
    parts = [shortest(re._parser.parse(r.pattern), b, o) for r in rnd.sample(licenses.RULES, 40) for b, o in ((0, True), (-1, False))]
    parts += ["some words between", "under the mit license", "undér", "cc by nc", "licensed under the", "apache license version 2"]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (0, 1, 7, 60, 900)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.normal(F.col("text")).alias("n"))
    for r in rows.select("text", "n", licenses.detections(F.col("n")).alias("d"), licenses.unsuppressed(licenses.detections(F.col("n"))).alias("k")).collect():
        want = sorted(
            (m.start() and r.n[:m.start()].count(" "), r.n[:m.end()].count(" ") - 1, i)
            for i, rule in enumerate(licenses.RULES) if " " + rule.keyword in r.n for m in re.finditer(f" {rule.pattern}(?= )", r.n)
        )
        assert sorted((h.first, h.last, h.rule) for h in r.d) == want
        hits = sorted(r.d, key=lambda h: (h.first, -h.last, -h.priority, h.rule))
        inside = lambda a, b: a.first >= b.first and a.last <= b.last
        kept = [h for i, h in enumerate(hits) if not any(inside(h, g) and g.priority >= h.priority for g in hits[:i])]
        kept = [h for h in kept if not any(inside(g, h) and g.priority > h.priority for g in kept)]
        assert sorted((h.first, h.last, h.rule) for h in r.k) == sorted((h.first, h.last, h.rule) for h in kept)


def test_license_families_and_identifiers(spark):
    want = {
        "Academic Free License version 3.0": "afl-3.0", "AFL v2.1": "afl-2.1", "the Open Software License 3.0": "osl-3.0", "CeCILL-B license": "cecill-b",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
        "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: Foo-1.0": "spdx", "SPDX-License-Identifier: MS-PL": "ms-pl",
        "Server Side Public License v1": "sspl-1", "Business Source License 1.1": "busl-1.1", "Blue Oak Model License 1.0.0": "blueoak-1.0.0",
        "PostgreSQL Licence": "postgresql", "IBM Public License": "ipl", "Zero-Clause BSD license": "0bsd", "W3C Software Notice and License": "w3c",
        "Zope Public License 9.7": "zpl", "a calm day with vim and ruby": "", "Elastic License 2.0": "elastic-2.0", "PolyForm Shield License 1.0.0": "polyform-shield-1.0.0",
    }
    docs = spark.createDataFrame([(t,) for t in want], "text string")
    assert {r.text: r.labels for r in licenses.scan(docs).collect()} == want


def test_license_versions_and_spellings(spark):
    want = {
        "GPL v3": "gpl-3", "GPL v2": "gpl-2", "GPLv2": "gpl-2", "gpl version 3.0": "gpl-3", "LGPL v2.1": "lgpl-2.1", "LGPL v3": "lgpl-3", "AGPL v3": "agpl-3",
        "MPL v2.0": "mpl-2", "EPL v2.0": "epl", "OFL v1.1": "ofl", "GNU General Public License v3.0": "gpl-3", "GNU General Public License v2": "gpl-2",
        "GNU Lesser General Public License v3": "lgpl-3", "GNU Affero General Public License v3": "agpl-3", "Mozilla Public License v1.1": "mpl-1",
        "Licensed under the Apache License, v2.0": "apache-2", "Apache License v2.0": "apache-2", "Apache v2": "apache-2", "Artistic License v2.0": "artistic-2",
        "Eclipse Public License v1.0": "epl-1", "subject to the terms of this licence": "other", "see the licence for details": "other",
        "released under a permissive licence": "other", "GPL v21": "",
    }
    docs = spark.createDataFrame([(t,) for t in want], "text string")
    assert {r.text: r.labels for r in licenses.scan(docs).collect()} == want


def test_kept_against_brute_force(spark):
    """Divergences and verdicts of random texts, worked out word by word and character by character."""
    rnd = random.Random(21)
    common = quality.COMMON["en"]
    names = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 9))) for _ in range(300)]

    def text():
        n, share = rnd.choice([5, 30, 60, 120, 300]), rnd.choice([0.0, 0.05, 0.4, 0.4])
        body = [rnd.choice(common) if rnd.random() < share else rnd.choice(names) for _ in range(n)]
        if rnd.random() < 0.2:
            body = [w.upper() + "###123" for w in body]
        return " ".join(w + rnd.choice(["", "", ",", ".\n"]) for w in body)

    rows = [(i, text(), rnd.choice(["en", "en", "de", None, "xx"]), "n", "b", "c") for i in range(120)] + [(200, None, "en", "n", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, _body string, _lang string")
    out = quality.judge(docs).collect()
    assert [c for c in quality.judge(docs).columns][:5] == ["doc_id", "text", "lang", "_body", "_lang"]

    def bins(t, lang):
        t = t or ""
        classes = [r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>=@~^_+/\\{}\[\]]", r"[^\x00-\x7F]"]
        some = [len(re.findall(p, t)) for p in classes]
        w = words(t)
        inside = sum(map(len, w))
        found = [x.strip(quality.EDGES).lower() for x in w]
        list_ = quality.COMMON.get(lang, [])
        own = [found.count(x) for x in list_] + [0] * (16 - len(list_))
        return [inside - sum(some), *some, len(t) - inside], [*own, len(w) - sum(own)]

    sums = {}
    for _, t, lang, *_ in rows:
        for k, b in enumerate(bins(t, lang)):
            kept = sums.setdefault(lang, [[0] * 7, [0] * 17])[k]
            sums[lang][k] = [x + y for x, y in zip(kept, b)]

    def js(counts, ref):
        p, q = ([x / sum(v) if sum(v) else 0.0 for x in v] for v in (counts, ref))
        if not sum(counts):
            return 0.0
        part = lambda a, m: a * math.log2(a / m) if a else 0.0
        return sum(part(a, (a + b) / 2) / 2 + part(b, (a + b) / 2) / 2 for a, b in zip(p, q))

    for r in out:
        chars, common_ = bins(r.text, r.lang)
        ref_chars, ref_words = sums[r.lang]
        a, b = js(chars, ref_chars), js(common_, ref_words)
        assert math.isclose(r.char_divergence, a, abs_tol=1e-9) and math.isclose(r.word_divergence, b, abs_tol=1e-9)
        limit = max(0.05, 0.5 * js([0] * 16 + [1], ref_words))
        n = r.n_words
        far = (n >= 50 and a > 0.1) or (n >= 100 and b > limit)
        assert r.kept == (not r.base_failed and not far), r.doc_id
    assert {r.kept for r in out} == {True, False}
