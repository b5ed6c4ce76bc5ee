"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontam, licenses, lm_scoring, merkle, mixing, near_dup, quality, quartile, repair, sharding, substring, urls, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op1_lm_scoring",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
    t AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, w FROM d),
    g AS (SELECT rid, p, w[p] AS w1, CASE WHEN p > 1 THEN w[p - 1] END AS w2, CASE WHEN p > 2 THEN w[p - 2] END AS w3 FROM t),
    c AS (SELECT rid, p,
            count(*) OVER () - count(*) OVER (PARTITION BY rid) AS n0,
            count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY rid, w1) AS c1,
            CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2, w1) - count(*) OVER (PARTITION BY rid, w2, w1) END AS c2,
            CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3, w2, w1) - count(*) OVER (PARTITION BY rid, w3, w2, w1) END AS c3
          FROM g),
    b AS (SELECT *, lag(c1) OVER (PARTITION BY rid ORDER BY p) AS b1, lag(c2) OVER (PARTITION BY rid ORDER BY p) AS b2 FROM c),
    s AS (SELECT rid, p,
            CASE WHEN c3 > 0 THEN 0 WHEN c2 > 0 THEN (p > 2)::INT
                 WHEN c1 > 0 THEN (p > 2)::INT + (p > 1)::INT ELSE (p > 2)::INT + (p > 1)::INT + 1 END AS k,
            CASE WHEN c3 > 0 THEN c3 / b2::DOUBLE WHEN c2 > 0 THEN c2 / b1::DOUBLE WHEN c1 > 0 THEN c1 / n0::DOUBLE
                 ELSE 1 / (n0 + 1)::DOUBLE END AS f
          FROM b),
    z AS (SELECT rid, sum(k) AS k, sum(log10(power(0.4, k) * f)) AS score FROM s GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_backoff,
           round(coalesce(score, 0), 4) AS log10_score, round(score / len(w), 4) AS log10_per_word
    FROM d LEFT JOIN z USING (rid)""",
)
def op1_lm_scoring(spark, sf):
    out = lm_scoring.score_documents(table(spark, sf, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("log10_score", "log10_per_word")})


@query("op2_sharding")
def op2_sharding(spark, sf):
    out = sharding.assign(table(spark, sf, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS k,
                      first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS f FROM pages)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN k > 1 AND strlen(html) >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN k > 1 AND strlen(html) >= 100 THEN f END AS refers_to
    FROM p""",
)
def op3_warc(spark, sf):
    out = warc.archive(table(spark, sf, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_mixing")
def op4_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontam.contaminated(docs, items).select("doc_id", "item_id", "start", "n_words", "similarity")


@query("op6_near_duplicates")
def op6_near_duplicates(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query("op7_licenses")
def op7_licenses(spark, sf):
    out = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


# The list of op8: the URLs of the table whose host has one of these terms, in any form of the URL.
SPAM_HOST = "(spam|pills|casino|viagra|porn)"
URL_RULES = [
    urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"),
]


def _rule_sql(result: str) -> str:
    """Longest rule first."""
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, result)}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.name))
    ]
    return f"CASE {' '.join(cases)} END"


@query(
    "op8_url_filter",
    rf"""
    WITH a AS (SELECT page_id, url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|\z)')) AS q
      FROM pages),
    b AS (SELECT *, CASE WHEN contains(url, '://') THEN
        regexp_replace(regexp_replace(host, '^(www\.|m\.)', ''), ':(80|443)\z', '')
        || regexp_replace(regexp_replace(path, '/index\.html?\z', '/'), '/+\z', '')
        || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c FROM a),
    listed AS (SELECT DISTINCT c FROM b WHERE regexp_matches(host, '{SPAM_HOST}'))
    SELECT page_id, host, path, {_rule_sql("name")} AS rule,
           coalesce({_rule_sql("verdict")}, CASE WHEN c IN (SELECT c FROM listed WHERE c IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
    FROM b""",
)
def op8_url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.filter(urls.host_of(F.col("url")).rlike(SPAM_HOST))
    return urls.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_quality")
def op9_quality(spark, sf):
    out = quality.judge(table(spark, sf, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op10_substring_dedup",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
    s AS (SELECT rid, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
    h AS (SELECT rid, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
    again AS (SELECT rid, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM again),
    listed AS (SELECT rid, list(p) AS g FROM gone GROUP BY rid),
    k AS (SELECT d.*, g, CASE WHEN g IS NULL THEN w
                 ELSE list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(g, i) THEN NULL ELSE w[i] END),
                                  lambda x: x IS NOT NULL) END AS kept
          FROM d LEFT JOIN listed USING (rid))
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
    FROM k""",
)
def op10_substring_dedup(spark, sf):
    out = substring.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    step = "xor(c, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)[1]"
    octets = f"[ascii(x)::UBIGINT FOR x IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {step}), 4294967295::UBIGINT)"


def _merkle_sql(levels: int = 6) -> str:
    """Levels of sixteen for each source and for the sources, spelled out up to 16 ** ``levels`` nodes."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = [field.format(f) for f in ("doc_id", "source", "lang", "n_chars")]
    crc = _crc_sql("doc_id::VARCHAR")
    out = [
        f"""d AS (SELECT doc_id, source, sha256({' || '.join([*fields, field.format('text')])}) AS leaf,
                  CASE WHEN {crc} % 5 = 0 THEN sha256({' || '.join([*fields, field.format(text)])}) END AS bad FROM documents)""",
        """a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM d)""",
    ]

    def up(name: str) -> None:
        for k in range(levels):
            out.append(
                f"""{name}{k + 1} AS (SELECT tree, i // 16 AS i, (any_value(n) + 15) // 16 AS n,
                    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
                    FROM {name}{k} GROUP BY tree, i // 16)"""
            )

    up("a")
    out.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, tree AS source FROM a{levels})")
    up("b")
    out.append(
        """f0 AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  coalesce(bad, leaf) AS f, '' AS p FROM d)"""
    )

    def along(old: str, new: str, level: str, tree: str) -> None:
        out.append(
            f"""{new} AS (SELECT e.doc_id, e.source, e.leaf, e.i // 16 AS i,
                CASE WHEN any_value(r.n) > 1 THEN sha256(string_agg(CASE WHEN r.i = e.i THEN e.f ELSE r.h END, '' ORDER BY r.i)) ELSE any_value(e.f) END AS f,
                any_value(e.p) || coalesce(string_agg(CASE WHEN r.i <> e.i THEN r.h END, '' ORDER BY r.i), '') AS p
                FROM {old} e JOIN {level} r ON r.tree IS NOT DISTINCT FROM {tree} AND r.i // 16 = e.i // 16
                GROUP BY e.doc_id, e.source, e.leaf, e.i)"""
        )

    for k in range(levels):
        along(f"f{k}", f"f{k + 1}", f"a{k}", "e.source")
    out.append(f"g0 AS (SELECT f.doc_id, f.source, f.leaf, b0.i, f.f, f.p FROM f{levels} f JOIN b0 ON b0.source IS NOT DISTINCT FROM f.source)")
    for k in range(levels):
        along(f"g{k}", f"g{k + 1}", f"b{k}", "0")
    return f"""WITH {', '.join(out)}
        SELECT g.doc_id, g.leaf, a.h AS subroot, b.h AS root, sha256(g.p) AS proof_sha256, g.f AS folded_root, g.f = b.h AS verified
        FROM g{levels} g JOIN a{levels} a ON a.tree IS NOT DISTINCT FROM g.source CROSS JOIN b{levels} b"""


@query("op13_merkle", _merkle_sql())
def op13_merkle(spark, sf):
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.manifest(table(spark, sf, "documents"), shown={"text": F.when(hit, text).otherwise(F.col("text"))})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query(
    "op11_fingerprints",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, length(coalesce(text, '')), text) AS i,
                      count(*) OVER () AS n FROM documents),
    e AS (SELECT d.i, d.n, d.doc_id, d.t, substr(d.t, 1, length(d.t) - length(d.t) // 2) || substr(x.t, 1, length(d.t) // 2) AS et
          FROM d JOIN d x ON x.i = d.i % d.n + 1),
    u AS (SELECT i, 0 AS k, t FROM e UNION ALL SELECT i, 1 AS k, et FROM e),
    b AS (SELECT i, k, [('0x' || x)::BIGINT FOR x IN regexp_extract_all('FFFF' || hex(encode(t)) || 'FFFF', '..')] AS b FROM u),
    p AS (SELECT i, k, unnest(range(1, len(b) - 1)) AS p, b FROM b),
    h AS (SELECT i, k, (((b[p] + 256 * b[p + 1] + 65536 * b[p + 2]) * 2654435761) % 4294967296) // 16777216 AS h FROM p),
    c AS (SELECT i, k, h, count(*) AS c FROM h GROUP BY ALL),
    f AS (SELECT u.i, u.k, r.range AS h, coalesce(c.c, 0) AS c FROM u CROSS JOIN range(256) r LEFT JOIN c ON c.i = u.i AND c.k = u.k AND c.h = r.range),
    q AS (SELECT i, k, list_sort(list(c)) AS s, list(c ORDER BY h) AS c FROM f GROUP BY ALL),
    z AS (SELECT i, k, [(x > s[64])::INT + (x > s[128])::INT + (x > s[192])::INT FOR x IN c] AS z FROM q),
    w AS (SELECT z.i, z.k, z, least(255, floor(8 * log2(strlen(t) + 1)))::INT AS l,
                 array_to_string([printf('%02x', z[4 * j + 1] + 4 * z[4 * j + 2] + 16 * z[4 * j + 3] + 64 * z[4 * j + 4]) FOR j IN range(64)], '') AS x
          FROM z JOIN u ON u.i = z.i AND u.k = z.k)
    SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.et) AS edited_sha256,
           printf('%02x', a.l) || a.x AS fingerprint, printf('%02x', b.l) || b.x AS edited_fingerprint,
           1 - least(320, list_sum([abs(a.z[j] - b.z[j]) FOR j IN range(1, 257)]) + 2 * least(32, abs(a.l - b.l)))::DOUBLE / 320 AS near_edited,
           1 - least(320, list_sum([abs(a.z[j] - c.z[j]) FOR j IN range(1, 257)]) + 2 * least(32, abs(a.l - c.l)))::DOUBLE / 320 AS near_next
    FROM e JOIN w a ON a.i = e.i AND a.k = 0 JOIN w b ON b.i = e.i AND b.k = 1 JOIN w c ON c.i = e.i % e.n + 1 AND c.k = 0""",
)
def op11_fingerprints(spark, sf):
    return quartile.compare_neighbours(table(spark, sf, "documents"))


def _repair_sql() -> str:
    """Costs, audits and repaired lines of the four states, carried from row to row."""
    far = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"

    def add(s: str, cost: str, letter: str, line: str = "") -> str:
        rest = f"list_append({s}.r, {line})" if line else f"{s}.r"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': {rest}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def insert(s: str, role: str) -> str:
        return add(s, "3", "I", f"'{role}:'")

    def edit(s: str, initial: str, role: str) -> str:
        """Keep, rerole to ``role`` or neither."""
        keep = f"WHEN role[1] = '{initial}' THEN {add(s, 'more', 'K', 'line')}"
        other = f"ELSE {add(s, '3 + more', 'R', f"'{role}:' || text")}" if role else f"ELSE {far}"
        return f"CASE WHEN gone THEN {far} {keep} {other} END"

    moved = [
        add("t0", "4", "D"),
        least(add("t1", "4", "D"), edit("t0", "s", "")),
        least(add("t2", "4", "D"), *(edit(t, "u", "user") for t in ("t0", "t1", "t3"))),
        least(add("t3", "4", "D"), edit("t2", "a", "assistant")),
    ]
    text = "coalesce(text, ' ')"
    crc = _crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    end = least("s0", "s3", insert("s2", "assistant"), f"list_transform([{insert('s1', 'user')}], lambda x: {insert('x', 'assistant')})[1]")
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, {text} AS text, {crc} % 20 AS k FROM conversations),
    m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                 CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS p FROM m),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again FROM o),
    x AS (SELECT *, role || ':' || text AS line, coalesce(conv_id::VARCHAR, ' ') AS v,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'ok' END AS fault,
                 lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1] AS pair FROM g),
    dp AS (
        SELECT DISTINCT v, 0::BIGINT AS p, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM x
        UNION ALL
        SELECT v, p, {', '.join(moved)} FROM (
            SELECT *, {least('s3', insert('t2', 'assistant'))} AS t3 FROM (
                SELECT d.v, x.p, x.role, x.text, x.line, x.fault IN ('blank', 'duplicate') AS gone, CASE WHEN x.fault = 'truncated' THEN 3 ELSE 0 END AS more,
                       s0 AS t0, s1 AS t1, s3, {least('s2', insert('s0', 'user'), insert('s1', 'user'), insert('s3', 'user'))} AS t2
                FROM dp d JOIN x ON x.v = d.v AND x.p = d.p + 1))),
    best AS (SELECT v, {end} AS e FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY p DESC) AS z FROM dp) WHERE z = 1),
    n AS (SELECT v, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY v),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost,
           coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN best ON best.v = coalesce(conv_id::VARCHAR, ' ') LEFT JOIN n ON n.v = coalesce(conv_id::VARCHAR, ' ')"""


@query("op12_conversations", _repair_sql())
def op12_conversations(spark, sf):
    return repair.repair(repair.damage(table(spark, sf, "conversations")), copies="copies")
