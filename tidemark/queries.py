"""The registered queries, each with the SQL that must give the same rows.

A query returns flat columns only; arrays and maps are joined to text or picked apart, times
are microseconds since the epoch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import derive
from tidemark.functions.cells import byte_size, first_value, joined
from tidemark.model import CELLS, RELATIONS, changes, events_to_changes, parse_lsn, read_table, rows_to_changes
from tidemark.operators import combine, counting, filters, progress, selection, stamping, values
from tidemark.plans.flow import Flow
from tidemark.session import checkpoint_root
from tidemark.sinks import deadletters, formats, ledger, writers
from tidemark.sources import changelog
from tidemark.streaming import carried, keyed, metrics, processors, runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86400

# The change log in SQL, as tidemark.model.events_to_changes derives it.
CHANGES_SQL = """changes AS (
  SELECT event_id AS seq, 10*event_id + (event_id*7919)%97 + 1 AS lsn, ts, epoch_us(ts) AS us,
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action,
         'public' AS schema_name,
         CASE user_id%4 WHEN 0 THEN 'accounts' WHEN 1 THEN 'orders' WHEN 2 THEN 'sessions' ELSE 'users' END AS table_name,
         CAST(user_id AS VARCHAR) AS c_user, event_type AS c_type,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS c_value, props AS c_props,
         user_id%4 + 1 AS relation_id
  FROM events)"""
CELLS_SQL = "'user_id=' || c_user || ';event_type=' || c_type || ';value=' || c_value || ';props=' || c_props"
# The documents as change rows.
DOCS_SQL = """docs AS (
  SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS c_id, text AS c_text, lang AS c_lang, source AS c_source
  FROM documents)"""
DOC_CELLS_SQL = "'doc_id=' || c_id || ';text=' || {text} || ';lang=' || {lang} || ';source=' || {source}"


def query(name: str, sql: str | None = None, recursive: bool = False, base: str = CHANGES_SQL):
    """Register a query; ``sql`` continues after the change-log CTE."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            start = "WITH RECURSIVE " if recursive else "WITH "
            more = text.startswith(",")
            ORACLES[name] = start + base + (text if more else "\n" + text)
        return fn

    return add


def us(column: str = "ts") -> Column:
    return F.unix_micros(column)


def cells() -> Column:
    return joined().alias("cells")


def meta(key: str, name: str | None = None) -> Column:
    return F.col("meta")[key].alias(name or key)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return rows_to_changes(
        read_table(spark, sf, "documents"), "documents", "doc_id", columns=["doc_id", "text", "lang", "source"]
    )


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """The events dealt out by id. A range of the ids, as it is cut off for one micro-batch, lies in a few
    pieces of the table's files, and few tasks would write and read it."""
    return events(spark, sf).repartition("event_id")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that the session names."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ scans and decoding


@query("scan_changes", f"SELECT seq, lsn, us AS ts_us, action, table_name, {CELLS_SQL} AS cells FROM changes")
def scan_changes(spark, sf):
    path = scratch(spark, "log")
    changes(spark, sf).write.parquet(path)
    return changelog.scan_changes(spark, path).select(
        "seq", "lsn", us().alias("ts_us"), "action", "table_name", cells()
    )


@query("scan_malformed", """
SELECT CASE WHEN seq % 50 = 7 THEN 'broken' WHEN seq % 50 = 9 THEN 'no seq' ELSE 'row' END AS kind, count(*) AS n,
  CAST(sum(CASE WHEN seq % 50 IN (7, 9) THEN 0 ELSE lsn END) AS BIGINT) AS lsns,
  count(DISTINCT CASE WHEN seq % 50 NOT IN (7, 9) THEN c_user END) AS users FROM changes GROUP BY 1""")
def scan_malformed(spark, sf):
    """A log in JSON lines, some cut off and some without a number; rows and broken lines are both read back."""
    path = scratch(spark, "lines")
    log = changes(spark, sf)
    whole = F.to_json(F.struct(*log.columns))
    nameless = F.to_json(F.struct(*[c for c in log.columns if c != "seq"]))
    cut_off = F.expr("left(value, length(value) - 5)")
    lines = log.select(F.when(F.col("seq") % 50 == 9, nameless).otherwise(whole).alias("value"), "seq")
    lines.select(F.when(F.col("seq") % 50 == 7, cut_off).otherwise(F.col("value")).alias("value")).write.text(path)
    rows, broken = changelog.part_malformed(changelog.scan_lines(spark, path))
    good = rows.agg(F.count("*").alias("n"), F.sum("lsn").alias("lsns"), F.countDistinct(first_value("user_id")).alias("users"))
    kind = F.when(F.col("line").endswith("}"), "no seq").otherwise("broken").alias("kind")
    bad = broken.groupBy(kind).agg(F.count("*").alias("n")).withColumns({"lsns": F.lit(0).cast("bigint"), "users": F.lit(0).cast("bigint")})
    return good.select(F.lit("row").alias("kind"), "n", "lsns", "users").unionByName(bad)


RELATIONS_SQL = """,
relations AS (
  SELECT 2*min(event_id) AS seq, user_id%4 + 1 AS relation_id,
         CASE user_id%4 WHEN 0 THEN 'accounts' WHEN 1 THEN 'orders' WHEN 2 THEN 'sessions' ELSE 'users' END AS table_name,
         dayofmonth(any_value(ts)) >= 15 AS has_props,
         user_id%4 = 3 AND dayofmonth(any_value(ts)) = 30 AS deleted
  FROM events GROUP BY user_id%4, CAST(ts AS DATE))"""
RAW_SQL = RELATIONS_SQL + """,
raw AS (
  SELECT 2*event_id + 1 AS seq, 10*event_id + (event_id*7919)%97 + 1 AS lsn,
         CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE'
              WHEN event_type = 'click' AND value < 2 THEN 'TRUNCATE' ELSE 'UPDATE' END AS action,
         CASE WHEN value < 1 THEN 9 ELSE user_id%4 + 1 END AS relation_id,
         CAST(user_id AS VARCHAR) AS c_user, event_type AS c_type,
         CASE WHEN value < 5 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS c_value,
         CASE WHEN value > 100 THEN NULL ELSE props END AS c_props, value
  FROM events),
decoded AS (
  SELECT raw.*, r.table_name, r.has_props,
         raw.action <> 'TRUNCATE' AND (r.seq IS NULL OR r.deleted) AS bad
  FROM raw ASOF LEFT JOIN relations r ON raw.relation_id = r.relation_id AND raw.seq > r.seq)
"""


@query("decode_changes", RAW_SQL + """
SELECT seq, lsn, action, CASE WHEN action <> 'TRUNCATE' AND NOT bad THEN table_name END AS table_name,
  CASE WHEN NOT bad AND action IN ('INSERT','UPDATE') THEN
    'user_id=' || c_user || ';event_type=' || c_type || ';value=' || coalesce(c_value,'<nil>') || ';' ||
    CASE WHEN has_props THEN 'props' ELSE '' END || '=' || coalesce(c_props,'<nil>') END AS cells,
  CASE WHEN NOT bad AND (action = 'DELETE' OR (action = 'UPDATE' AND value > 20)) THEN 'user_id=' || c_user END AS old,
  CASE WHEN bad THEN 'unknown relation id ' || relation_id END AS error
FROM decoded""")
def decode_changes(spark, sf):
    e = events(spark, sf)
    out = changelog.decode_changes(derive.raw_log(e), derive.relation_log(e))
    good = F.col("decode_error").isNull()
    return out.select(
        "seq", "lsn", "action", F.when(good, F.col("table_name")).alias("table_name"),
        F.when(good, joined()).alias("cells"), F.when(good, joined(over=F.col("old_keys"))).alias("old"),
        F.col("decode_error").alias("error"),
    )


@query("relation_dictionary", RELATIONS_SQL + """
SELECT relation_id, arg_max(table_name, seq) AS table_name, max(seq) AS seq,
  CASE WHEN arg_max(has_props, seq) THEN 'user_id:20 event_type:25 value:701 props:25'
       ELSE 'user_id:20 event_type:25 value:701' END AS names
FROM relations GROUP BY relation_id HAVING NOT arg_max(deleted, seq)""")
def relation_dictionary(spark, sf):
    return dictionary_rows(changelog.relation_dictionary(derive.relation_log(events(spark, sf))))


def dictionary_rows(relations: DataFrame) -> DataFrame:
    names = F.array_join(
        F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type_oid"].cast("string"))), " "
    )
    return relations.select("relation_id", "table_name", "seq", names.alias("names"))


# ------------------------------------------------------------------ filters and predicates


@query("filter_allow", """
SELECT seq, action, table_name FROM changes
WHERE schema_name || '.' || table_name IN ('public.orders','public.users') AND action IN ('INSERT','DELETE')""")
def filter_allow(spark, sf):
    stage = filters.allow(["public.orders", "public.users"], ["INSERT", "DELETE"])
    return changes(spark, sf).transform(stage).select("seq", "action", "table_name")


@query("filter_skip", """
SELECT seq, action, table_name FROM changes WHERE NOT (table_name = 'sessions' OR action = 'DELETE')""")
def filter_skip(spark, sf):
    return changes(spark, sf).transform(filters.skip(["Sessions"], ["delete"])).select("seq", "action", "table_name")


@query("drop_action", "SELECT seq, action FROM changes WHERE action <> 'UPDATE'")
def drop_action(spark, sf):
    return changes(spark, sf).transform(filters.drop_action("update", "TRUNCATE")).select("seq", "action")


@query("is_data_change", RAW_SQL + "SELECT seq, action FROM decoded WHERE NOT bad AND action <> 'TRUNCATE'")
def is_data_change(spark, sf):
    e = events(spark, sf)
    rows, _ = filters.split_errors(
        changelog.decode_changes(derive.raw_log(e), derive.relation_log(e)), "decode_error"
    )
    return rows.transform(filters.data_changes()).select("seq", "action")


@query("expire", """
SELECT seq, table_name FROM changes
WHERE table_name <> 'orders' OR ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 10 DAY""")
def expire(spark, sf):
    return changes(spark, sf).transform(filters.expire(10 * DAY, "2024-01-25 12:00:00", "orders")).select("seq", "table_name")


DOC_SIZED_SQL = DOCS_SQL + """,
sized AS (SELECT *, strlen('documents') + strlen('public') + strlen('INSERT') + strlen('doc_idtextlangsource')
  + strlen(c_id) + strlen(c_text) + strlen(c_lang) + strlen(c_source) AS bytes FROM docs)
"""


@query("size_drop", "SELECT seq, md5(c_text) AS text_md5 FROM sized WHERE bytes <= 2000", base=DOC_SIZED_SQL)
def size_drop(spark, sf):
    return docs(spark, sf).transform(filters.size_limit(2000)).select("seq", F.md5(first_value("text")).alias("text_md5"))


@query("size_stub", f"""
SELECT seq, CASE WHEN bytes > 2000 THEN '_truncated=original_bytes=' || bytes
  ELSE {DOC_CELLS_SQL.format(text='c_text', lang='c_lang', source='c_source')} END AS cells FROM sized""", base=DOC_SIZED_SQL)
def size_stub(spark, sf):
    return docs(spark, sf).transform(filters.size_limit(2000, keep_stub=True)).select("seq", cells())


@query("message_size", "SELECT seq, CAST(bytes AS BIGINT) AS bytes FROM sized", base=DOC_SIZED_SQL)
def message_size(spark, sf):
    return docs(spark, sf).select("seq", byte_size().alias("bytes"))


@query("cap", """
SELECT seq, table_name, action FROM (
  SELECT *, sum(CASE WHEN table_name = 'orders' AND action = 'UPDATE' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS n FROM changes)
WHERE NOT (table_name = 'orders' AND action = 'UPDATE') OR n <= 700""")
def cap(spark, sf):
    return changes(spark, sf).transform(filters.cap(700, "orders", "UPDATE")).select("seq", "table_name", "action")


@query("cap_remaining", """
SELECT CAST(greatest(4000 - count(*), 0) AS BIGINT) AS remaining FROM changes WHERE table_name = 'orders'""")
def cap_remaining(spark, sf):
    return changes(spark, sf).transform(filters.cap_remaining(4000, "orders"))


CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, length(k)+1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
    lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END))"""


@query("sample_rate", f"""
SELECT seq FROM (SELECT seq, CAST(seq AS VARCHAR) || 's1' AS k FROM changes)
WHERE xor({CRC_SQL}, CAST(4294967295 AS BIGINT)) / 4294967296.0 < 0.3""")
def sample_rate(spark, sf):
    return changes(spark, sf).transform(filters.sample_rate(0.3, "s1")).select("seq")


def per_user(spark, sf):
    return changes(spark, sf).withColumn("user", first_value("user_id"))


ORDERED_SQL = """,
o AS (SELECT *, c_user AS k, row_number() OVER (PARTITION BY c_user ORDER BY seq) AS rn FROM changes)"""


def greedy_sql(span_us: int, ordered: str = ORDERED_SQL) -> str:
    return ordered + f""",
f(k, rn, seq, us, e, kept) AS (
  SELECT k, rn, seq, us, us + {span_us}, true FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.seq, o.us, CASE WHEN o.us >= f.e THEN o.us + {span_us} ELSE f.e END, o.us >= f.e
  FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)"""


@query("sample_max_per_second", greedy_sql(DAY * 10**6) + """,
w AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY rn) AS win FROM f)
SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY k, win ORDER BY rn) AS n FROM w) WHERE n <= 2""", recursive=True)
def sample_max_per_second(spark, sf):
    return per_user(spark, sf).transform(selection.sample_max_per_second(2, ["user"], second=DAY)).select("seq")


@query("dedup_content_untimed", "SELECT doc_id AS seq FROM documents")
def dedup_content_untimed(spark, sf):
    """The documents have no times: no clock holds a row back."""
    return docs(spark, sf).transform(selection.dedup_content(60, ["text"])).select("seq")


@query("token_bucket_untimed", "SELECT doc_id AS seq, true AS admitted FROM documents")
def token_bucket_untimed(spark, sf):
    return docs(spark, sf).transform(selection.token_bucket(1, 1, 1)).select("seq", "admitted")


@query("token_bucket", ORDERED_SQL + """,
f(k, rn, seq, us, tok, ok) AS (
  SELECT k, rn, seq, us, CAST(43200000000 AS BIGINT), true FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.seq, o.us,
    least(86400000000, f.tok + o.us - f.us) - CASE WHEN least(86400000000, f.tok + o.us - f.us) >= 43200000000 THEN 43200000000 ELSE 0 END,
    least(86400000000, f.tok + o.us - f.us) >= 43200000000
  FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
SELECT seq, ok AS admitted FROM f""", recursive=True)
def token_bucket(spark, sf):
    stage = selection.token_bucket(1, per=DAY / 2, burst=2, keys=["user"])
    return per_user(spark, sf).transform(stage).select("seq", "admitted")


SWITCH_SQL = """,
switch AS (SELECT min(ts) AS sts, dayofmonth(min(ts)) % 2 = 1 AS sw FROM events GROUP BY CAST(ts AS DATE))"""


@query("gate", SWITCH_SQL + "SELECT seq FROM changes c ASOF LEFT JOIN switch s ON c.ts >= s.sts WHERE coalesce(sw, true)")
def gate(spark, sf):
    return changes(spark, sf).transform(filters.gate(derive.day_switch(events(spark, sf)))).select("seq")


@query("hold_release", SWITCH_SQL + """,
edges AS (SELECT sts, sw FROM (SELECT *, lag(sw) OVER (ORDER BY sts) AS was FROM switch) WHERE was IS DISTINCT FROM sw),
freezes AS (SELECT sts, sw, lead(sts) OVER (ORDER BY sts) AS thaw FROM edges),
held AS (
  SELECT c.seq, c.us, s.sw, s.thaw, row_number() OVER (PARTITION BY s.sts ORDER BY c.seq DESC) AS r
  FROM changes c ASOF LEFT JOIN freezes s ON c.ts >= s.sts)
SELECT seq, CASE WHEN coalesce(sw, false) THEN epoch_us(thaw) ELSE us END AS release_us
FROM held WHERE NOT coalesce(sw, false) OR r <= 50""")
def hold_release(spark, sf):
    stage = filters.hold_release(derive.day_switch(events(spark, sf)), 50)
    return changes(spark, sf).transform(stage).select("seq", us("release_ts").alias("release_us"))


@query("pin_or_filter", "SELECT seq, table_name FROM changes WHERE table_name = 'users' OR CAST(c_value AS DOUBLE) > 50")
def pin_or_filter(spark, sf):
    big = first_value("value").try_cast("double") > 50
    return changes(spark, sf).transform(filters.pin_or(big, ["users"])).select("seq", "table_name")


@query("validate", """
SELECT seq, CASE WHEN action = 'DELETE' THEN
    'validation rule "require_action" failed: action "DELETE" is not in allowed set [INSERT UPDATE]'
  WHEN CAST(c_value AS DOUBLE) > 100 THEN 'validation rule "value" failed: value is too large' END AS error FROM changes""")
def validate(spark, sf):
    small = filters.Check("value", first_value("value").try_cast("double") <= 100, F.lit("value is too large"))
    stage = filters.validate(filters.require_table(), filters.require_action("INSERT", "UPDATE"), small)
    return changes(spark, sf).transform(stage).select("seq", "error")


@query("reject", """
SELECT seq, CASE WHEN table_name = 'users' AND action = 'DELETE' THEN 'rejecter: message rejected: no user deletes'
  WHEN action = 'DELETE' THEN 'rejecter: message rejected: no deletes'
  WHEN table_name = 'sessions' THEN 'rejecter: message rejected: no sessions' END AS rejection FROM changes""")
def reject(spark, sf):
    rule = filters.RejectRule
    stage = filters.reject(
        rule("no user deletes", "users", "DELETE"), rule("no deletes", action="DELETE"), rule("no sessions", "sessions")
    )
    return changes(spark, sf).transform(stage).select("seq", "rejection")


@query("quorum", """
SELECT seq, v >= 3 AS all_agree, v > 1 AS majority, v >= 1 AS any_agrees FROM (
  SELECT seq, (action = 'UPDATE')::INT + (table_name = 'orders')::INT + (CAST(c_value AS DOUBLE) > 20)::INT AS v FROM changes)""")
def quorum(spark, sf):
    votes = [F.col("action") == "UPDATE", F.col("table_name") == "orders", first_value("value").try_cast("double") > 20]
    return changes(spark, sf).select(
        "seq", filters.quorum("all", *votes).alias("all_agree"),
        filters.quorum("majority", *votes).alias("majority"), filters.quorum("any", *votes).alias("any_agrees"),
    )


# ------------------------------------------------------------------ stateful selection


@query("dedup_ttl", greedy_sql(DAY * 10**6) + "SELECT seq FROM f WHERE kept", recursive=True)
def dedup_ttl(spark, sf):
    return per_user(spark, sf).transform(selection.dedup_ttl(["user"], DAY)).select("seq")


@query("dedup_content", greedy_sql(7 * DAY * 10**6, """,
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM (
  SELECT *, sha256(table_name || ':' || action || ':user_id=' || c_user || ';event_type=' || c_type || ';') AS k FROM changes))""")
  + "SELECT seq, k AS content FROM f WHERE kept", recursive=True)
def dedup_content(spark, sf):
    names = ["user_id", "event_type"]
    kept = changes(spark, sf).transform(selection.dedup_content(7 * DAY, names))
    return kept.select("seq", selection.content_hash(names).alias("content"))


@query("distinct_key", """
SELECT seq FROM (SELECT seq, table_name, row_number() OVER (PARTITION BY table_name, action, c_user ORDER BY seq) AS n FROM changes)
WHERE n = 1 OR table_name <> 'orders'""")
def distinct_key(spark, sf):
    return changes(spark, sf).transform(selection.distinct_key("user_id", "orders")).select("seq")


HIGH_SQL = """max(lsn) OVER (PARTITION BY table_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("align", f"SELECT seq, lsn FROM (SELECT seq, lsn, {HIGH_SQL} AS h FROM changes) WHERE h IS NULL OR lsn >= h")
def align(spark, sf):
    return changes(spark, sf).transform(selection.align()).select("seq", "lsn")


@query("align_last_lsn", "SELECT table_name, max(lsn) AS last_lsn FROM changes GROUP BY table_name")
def align_last_lsn(spark, sf):
    return changes(spark, sf).transform(selection.last_lsn())


@query("reorder", """,
c AS (SELECT seq, lsn, (row_number() OVER (ORDER BY seq) - 1) // 64 AS chunk FROM changes)
SELECT seq, chunk, row_number() OVER (PARTITION BY chunk ORDER BY lsn, seq) AS out_pos FROM c""")
def reorder(spark, sf):
    tagged = changes(spark, sf).withColumn("meta", F.create_map(F.lit("lsn"), F.col("lsn").cast("string")))
    return tagged.transform(selection.reorder(64)).select("seq", "chunk", "out_pos")


@query("sequence", """
SELECT seq, CASE WHEN table_name = 'orders' THEN CAST(1000 + row_number() OVER (PARTITION BY table_name ORDER BY seq) AS VARCHAR) END AS stamp
FROM changes""")
def sequence(spark, sf):
    return changes(spark, sf).transform(selection.sequence(1000, "orders")).select("seq", meta("seq", "stamp"))


HOUR_US = 3600 * 10**6


@query("debounce", ORDERED_SQL + f""",
f(k, rn, seq, us, first, start) AS (
  SELECT k, rn, seq, us, us, true FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.seq, o.us,
    CASE WHEN o.us - f.us >= {6 * HOUR_US} OR o.us >= f.first + {12 * HOUR_US} THEN o.us ELSE f.first END,
    o.us - f.us >= {6 * HOUR_US} OR o.us >= f.first + {12 * HOUR_US}
  FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
SELECT max(seq) AS seq, least(max(us) + {6 * HOUR_US}, first + {12 * HOUR_US}) AS emit_us, count(*) AS burst_rows
FROM f GROUP BY k, first""", recursive=True)
def debounce(spark, sf):
    stage = selection.debounce(["user"], 6 * 3600, 12 * 3600)
    return per_user(spark, sf).transform(stage).select("seq", us("emit_ts").alias("emit_us"), "burst_rows")


@query("debounce_disordered", f""",
o AS (SELECT seq, us - (seq % 7) * 7200000000 AS us, c_user AS k, row_number() OVER (PARTITION BY c_user ORDER BY seq) AS rn FROM changes),
f(k, rn, seq, us, first, start) AS (
  SELECT k, rn, seq, us, us, seq FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn, o.seq, o.us,
    CASE WHEN o.us - f.us >= {6 * HOUR_US} OR o.us >= f.first + {12 * HOUR_US} THEN o.us ELSE f.first END,
    CASE WHEN o.us - f.us >= {6 * HOUR_US} OR o.us >= f.first + {12 * HOUR_US} THEN o.seq ELSE f.start END
  FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
SELECT max(seq) AS seq, least(arg_max(us, seq) + {6 * HOUR_US}, any_value(first) + {12 * HOUR_US}) AS emit_us, count(*) AS burst_rows
FROM f GROUP BY k, start""", recursive=True)
def debounce_disordered(spark, sf):
    """A clock that goes back by up to twelve hours between arrivals."""
    back = F.timestamp_micros(F.unix_micros("ts") - (F.col("seq") % 7) * 7_200_000_000)
    stage = selection.debounce(["user"], 6 * 3600, 12 * 3600)
    out = per_user(spark, sf).withColumn("ts", back).transform(stage)
    return out.select("seq", us("emit_ts").alias("emit_us"), "burst_rows")


# ------------------------------------------------------------------ column values


@query("project_keep", "SELECT seq, 'user_id=' || c_user || ';value=' || c_value AS cells FROM changes")
def project_keep(spark, sf):
    return changes(spark, sf).transform(values.project(["value", "user_id"])).select("seq", cells())


@query("project_exclude", f"""
SELECT seq, CASE WHEN table_name = 'orders' THEN 'user_id=' || c_user || ';event_type=' || c_type ELSE {CELLS_SQL} END AS cells
FROM changes""")
def project_exclude(spark, sf):
    stage = values.project(exclude=["props", "value"], table="orders")
    return changes(spark, sf).transform(stage).select("seq", cells())


@query("get_column", "SELECT seq, c_type AS event_type, CAST(NULL AS VARCHAR) AS missing FROM changes")
def get_column(spark, sf):
    return (
        changes(spark, sf)
        .transform(values.chain(values.get_column("event_type", "event_type"), values.get_column("nothing", "missing")))
        .select("seq", "event_type", "missing")
    )


@query("flatten", """
SELECT seq, c_user AS user_id, c_props AS props, CAST(4 AS BIGINT) AS entries, CAST(NULL AS VARCHAR) AS error FROM changes""")
def flatten(spark, sf):
    flat = changes(spark, sf).transform(values.flatten(with_table=True))
    at = lambda n: F.try_element_at("flat", F.concat(F.col("table_name"), F.lit("." + n)))
    return flat.select(
        "seq", at("user_id").alias("user_id"), at("props").alias("props"),
        F.size("flat").cast("bigint").alias("entries"), F.col("flatten_error").alias("error"),
    )


@query("rename_table", "SELECT seq, CASE WHEN table_name = 'users' THEN 'people' ELSE table_name END AS table_name FROM changes")
def rename_table(spark, sf):
    return changes(spark, sf).transform(values.rename_table("USERS", "people")).select("seq", "table_name")


@query("mask_columns", "SELECT seq, 'user_id=***;event_type=' || c_type || ';value=' || c_value || ';props=***' AS cells FROM changes")
def mask_columns(spark, sf):
    return changes(spark, sf).transform(values.mask_columns("user_id", "props", "Value")).select("seq", cells())


@query("mask_rules", """
SELECT seq, 'user_id=' || sha256(c_user) || ';event_type=' || CASE WHEN table_name = 'orders' THEN '' ELSE c_type END
  || ';value=' || c_value || ';props=' || CASE WHEN table_name = 'users' THEN '#' ELSE '***' END AS cells FROM changes""")
def mask_rules(spark, sf):
    rule = values.MaskRule
    stage = values.mask_rules(
        rule("USER_ID", "redact"), rule("user_id", "hash", "*"), rule("event_type", "blank", "Orders"),
        rule("props"), rule("props", table="users", text="#"),
    )
    return changes(spark, sf).transform(stage).select("seq", cells())


PII = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{3}-[0-9]{2}-[0-9]{4}"


@query("redact", f"""
SELECT seq, {DOC_CELLS_SQL.format(text=f"CASE WHEN regexp_matches(c_text, '{PII}') THEN '[REDACTED]' ELSE c_text END",
                                  lang='c_lang', source="'[REDACTED]'")} AS cells FROM docs""", base=DOCS_SQL)
def redact(spark, sf):
    return docs(spark, sf).transform(values.redact({"documents": ["SOURCE"]}, PII)).select("seq", cells())


@query("cast", r"""
SELECT seq, 'user_id=' || CAST(CAST(c_user AS BIGINT) AS VARCHAR) || ';event_type=' || c_type
  || ';value=' || regexp_replace(CAST(CAST(c_value AS DOUBLE) AS VARCHAR), '\.0$', '') || ';props=' || c_props AS cells,
  'int,,float,' AS types,
  CASE WHEN table_name = 'orders' THEN 'cast: column "event_type" value "' || c_type || '": not a valid bool' END AS error
FROM changes""")
def cast(spark, sf):
    rule = values.CastRule
    stage = values.cast(rule("USER_ID", "int"), rule("value", "float"), rule("event_type", "bool", "Orders"))
    types = F.array_join(F.transform("columns", lambda c: F.coalesce(c["type"], F.lit(""))), ",")
    return changes(spark, sf).transform(stage).select("seq", cells(), types.alias("types"), F.col("cast_error").alias("error"))


@query("clamp", r"""
SELECT seq, CASE WHEN CAST(c_user AS BIGINT) < 10 THEN '10' WHEN CAST(c_user AS BIGINT) > 100 THEN '100' ELSE c_user END AS user_id,
  CASE WHEN CAST(c_value AS DOUBLE) < 2.5 THEN '2.5' WHEN CAST(c_value AS DOUBLE) > 50 THEN '50'
       ELSE regexp_replace(CAST(CAST(c_value AS DOUBLE) AS VARCHAR), '\.0$', '') END AS value,
  c_type AS event_type
FROM changes""")
def clamp(spark, sf):
    stage = values.chain(
        values.cast(values.CastRule("user_id", "int"), values.CastRule("value", "float")),
        values.clamp(
            values.ClampRule("user_id", 10, 100.9), values.ClampRule("value", 2.5, 50), values.ClampRule("event_type", 0, 1)
        ),
    )
    return changes(spark, sf).transform(stage).select(
        "seq", first_value("user_id").alias("user_id"), first_value("value").alias("value"),
        first_value("event_type").alias("event_type"),
    )


@query("clamp_wide", """
SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5), 45) AS l_quantity,
  least(greatest(l_discount, 0.02), 0.08) AS l_discount FROM lineitem""")
def clamp_wide(spark, sf):
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return values.clamp_wide(lines, {"l_quantity": (5.0, 45.0), "l_discount": (0.02, 0.08)})


TRIM = r"[\s\x0b\x{0085}\p{Z}]+"


@query("normalize_trim", f"""
SELECT page_id AS seq, regexp_replace(html, '^{TRIM}|{TRIM}$', '', 'g') AS html FROM pages""", base="_one AS (SELECT 1)")
def normalize_trim(spark, sf):
    pages = rows_to_changes(read_table(spark, sf, "pages"), "pages", "page_id")
    return pages.transform(values.normalize({"html": values.trim}, "pages")).select("seq", first_value("html").alias("html"))


@query("normalize_lower", f"""
SELECT seq, {DOC_CELLS_SQL.format(text='lower(c_text)', lang='c_lang', source='c_source')} AS cells FROM docs""", base=DOCS_SQL)
def normalize_lower(spark, sf):
    return docs(spark, sf).transform(values.normalize({"text": values.lower})).select("seq", cells())


@query("normalize_upper", """
SELECT conv_id, turn, upper(role) AS role, text FROM conversations""", base="_one AS (SELECT 1)")
def normalize_upper(spark, sf):
    talk = read_table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000000 + F.col("turn"))
    rows = rows_to_changes(talk, "conversations", "id", columns=["conv_id", "turn", "role", "text"])
    return rows.transform(values.normalize({"role": values.upper})).select(
        first_value("conv_id").cast("bigint").alias("conv_id"), first_value("turn").cast("bigint").alias("turn"),
        first_value("role").alias("role"), first_value("text").alias("text"),
    )


@query("lookup_map", """
SELECT seq, CASE c_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'see' WHEN 'error' THEN CASE WHEN table_name = 'users' THEN '?' ELSE c_type END
  ELSE CASE WHEN table_name = 'users' THEN '?' ELSE c_type END END AS event_type FROM changes""")
def lookup_map(spark, sf):
    rule = values.LookupRule
    stage = values.lookup(
        rule("EVENT_TYPE", {"click": "c", "view": "v"}), rule("event_type", {"v": "see", "c": "c"}),
        rule("event_type", {"see": "see", "c": "c"}, "Users", "?"),
    )
    return changes(spark, sf).transform(stage).select("seq", first_value("event_type").alias("event_type"))


@query("lookup_table", """
SELECT o_orderkey AS seq, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
       base="_one AS (SELECT 1)")
def lookup_table(spark, sf):
    orders = rows_to_changes(read_table(spark, sf, "orders"), "orders", "o_orderkey", columns=["o_orderkey", "o_custkey"])
    names = read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value")
    )
    out = orders.transform(values.lookup_table("O_CUSTKEY", names, "unknown", "orders"))
    return out.select("seq", first_value("o_custkey").alias("segment"))


@query("transform_chain", """
SELECT seq, CASE WHEN table_name = 'users' THEN 'people' ELSE table_name END AS table_name,
  'user_id=***;event_type=' || c_type || ';value=' || c_value || ';props=' || c_props AS cells
FROM changes WHERE action <> 'DELETE'""")
def transform_chain(spark, sf):
    stage = values.chain(filters.drop_action("delete"), values.rename_table("users", "people"), values.mask_columns("user_id"))
    return changes(spark, sf).transform(stage).select("seq", "table_name", cells())


# ------------------------------------------------------------------ metadata, keys, hashes


@query("annotate", """
SELECT seq, CASE WHEN action = 'DELETE' THEN 'gone' WHEN table_name = 'orders' THEN 'sales' END AS kind,
  CASE WHEN table_name = 'users' AND action = 'INSERT' THEN 'yes' END AS fresh FROM changes""")
def annotate(spark, sf):
    rule = stamping.MetaRule
    stage = stamping.annotate(
        rule("kind", "sales", "Orders"), rule("kind", "gone", action="delete"), rule("fresh", "yes", "users", "insert")
    )
    return changes(spark, sf).transform(stage).select("seq", meta("kind"), meta("fresh"))


@query("enrich", """
SELECT seq, CASE WHEN table_name IN ('orders','users') THEN 'eu' END AS region,
  CASE WHEN table_name IN ('orders','users') THEN 'core' END AS team FROM changes""")
def enrich(spark, sf):
    stage = stamping.enrich({"region": "eu", "team": "core"}, ["ORDERS", "users"])
    return changes(spark, sf).transform(stage).select("seq", meta("region"), meta("team"))


@query("label", "SELECT seq, c_type AS env, 'blue' AS color, 'prod' AS over FROM changes")
def label(spark, sf):
    base = changes(spark, sf).transform(stamping.pick("event_type", "env"))
    keep = base.transform(stamping.label({"ENV": "prod", "Color": "blue"}))
    over = stamping.label({"env": "prod"}, overwrite=True)
    return keep.withColumn("first", F.col("meta")).transform(over).select(
        "seq", F.col("first")["env"].alias("env"), F.col("first")["color"].alias("color"), meta("env", "over")
    )


@query("tag", """
SELECT seq, CASE WHEN action = 'DELETE' THEN 'high' ELSE 'low' END AS risk, 'cdc' AS origin FROM changes""")
def tag(spark, sf):
    stage = stamping.tag({"risk": "low", "origin": "cdc"}, stamping.MetaRule("risk", "high", action="DELETE"))
    return changes(spark, sf).transform(stage).select("seq", meta("risk"), meta("origin"))


@query("pick", "SELECT seq, CASE WHEN table_name = 'orders' THEN c_value END AS amount FROM changes")
def pick(spark, sf):
    return changes(spark, sf).transform(stamping.pick("value", "amount", "orders")).select("seq", meta("amount"))


@query("promote", """
SELECT seq, c_user AS who, CASE WHEN action = 'DELETE' THEN c_type END AS what FROM changes""")
def promote(spark, sf):
    rule = stamping.PromoteRule
    stage = stamping.promote(rule("USER_ID", "who"), rule("event_type", "what", action="delete"))
    return changes(spark, sf).transform(stage).select("seq", meta("who"), meta("what"))


@query("correlate", """
SELECT c_user AS correlation_id, count(*) AS rows, count(DISTINCT table_name) AS tables, min(lsn) AS first_lsn, max(lsn) AS last_lsn
FROM changes GROUP BY c_user""")
def correlate(spark, sf):
    return changes(spark, sf).transform(stamping.correlate("user_id", "cid")).transform(stamping.correlation_groups("cid"))


@query("score", """
SELECT seq, CASE WHEN table_name = 'orders' AND action = 'INSERT' THEN '10' WHEN table_name = 'users' THEN '5.5'
  WHEN action = 'DELETE' THEN '1' ELSE '0.25' END AS score FROM changes""")
def score(spark, sf):
    rule = stamping.ScoreRule
    stage = stamping.score([rule(10, "orders", "INSERT"), rule(5.5, "users"), rule(1, action="DELETE")], 0.25)
    return changes(spark, sf).transform(stage).select("seq", meta("score"))


PRIORITY_SQL = """CASE WHEN table_name = 'orders' AND action = 'INSERT' THEN 2 WHEN table_name = 'orders' THEN 0
  WHEN action = 'DELETE' THEN 2 ELSE 1 END"""
PRIORITIES = [
    stamping.PriorityRule(stamping.HIGH, "orders", "INSERT"), stamping.PriorityRule(stamping.LOW, "orders"),
    stamping.PriorityRule(stamping.HIGH, action="DELETE"),
]


@query("priority_assign", f"SELECT seq, {PRIORITY_SQL} AS priority FROM changes")
def priority_assign(spark, sf):
    return changes(spark, sf).transform(stamping.priority(PRIORITIES)).select("seq", "priority")


@query("priority_sort", f"""
SELECT seq, p AS priority, row_number() OVER (ORDER BY p DESC, seq) AS pos FROM (SELECT seq, {PRIORITY_SQL} AS p FROM changes)""")
def priority_sort(spark, sf):
    ranked = changes(spark, sf).transform(stamping.priority(PRIORITIES)).transform(stamping.priority_position())
    return ranked.transform(stamping.priority_sort()).select("seq", "priority", "pos")


def fnv_sql(k: str, n: int) -> str:
    return f"""list_reduce(list_prepend(CAST(2166136261 AS BIGINT),
      list_transform(range(1, length({k})+1), lambda i: CAST(ascii(substr({k}, CAST(i AS INTEGER), 1)) AS BIGINT))),
      lambda h, b: (xor(h, b) * 16777619) % 4294967296) % {n}"""


@query("partition_by", f"""
SELECT seq, {fnv_sql('table_name', 16)} AS by_table, {fnv_sql('action', 7)} AS by_action, {fnv_sql('c_user', 64)} AS by_key FROM changes""")
def partition_by(spark, sf):
    return changes(spark, sf).select(
        "seq", stamping.partition_bucket(16).alias("by_table"), stamping.partition_bucket(7, "action").alias("by_action"),
        stamping.partition_bucket(64, "first_column").alias("by_key"),
    )


@query("partitioned_join", """
SELECT seq, c_user AS "user", count(*) OVER (PARTITION BY c_user) AS n FROM changes""")
def partitioned_join(spark, sf):
    """The log and a table by user, both kept in buckets of the user: counted and joined without an exchange."""
    path, name = scratch(spark, "buckets"), f"log_{uuid.uuid4().hex}"
    writers.bucket_sink(name, ["user"], 16, path)(per_user(spark, sf).select("seq", "user"))
    log = spark.table(name)
    return log.join(log.groupBy("user").agg(F.count("*").alias("n")), "user").select("seq", "user", "n")


@query("route_key", "SELECT seq, table_name AS t, action AS a, table_name || '.' || action AS ta, table_name AS other FROM changes")
def route_key(spark, sf):
    return changes(spark, sf).select(
        "seq", stamping.route_key().alias("t"), stamping.route_key("ACTION").alias("a"),
        stamping.route_key("Table.Action").alias("ta"), stamping.route_key("else").alias("other"),
    )


DIGEST_SQL = "'doc_id=' || c_id || ';lang=' || c_lang || ';source=' || c_source || ';text=' || c_text || ';'"


@query("digest_sha256", f"SELECT seq, sha256({DIGEST_SQL}) AS digest FROM docs", base=DOCS_SQL)
def digest_sha256(spark, sf):
    return docs(spark, sf).transform(stamping.digest()).select("seq", meta("_digest", "digest"))


@query("digest_md5", "SELECT seq, md5('lang=' || c_lang || ';text=' || c_text || ';') AS digest FROM docs", base=DOCS_SQL)
def digest_md5(spark, sf):
    return docs(spark, sf).transform(stamping.digest("md5", ["text", "lang"], "d")).select("seq", meta("d", "digest"))


@query("trace_stamp", """
SELECT seq, CASE WHEN table_name = 'orders' THEN substr(sha256(seq || ':' || lsn), 1, 26) END AS trace_id,
  CASE WHEN table_name = 'orders' THEN '2' END AS trace_hop FROM changes""")
def trace_stamp(spark, sf):
    hop = stamping.trace("orders")
    return changes(spark, sf).transform(hop).transform(hop).select("seq", meta("trace_id"), meta("trace_hop"))


# ------------------------------------------------------------------ combining rows


def _merge_sides(spark, sf):
    orders = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount")
    )
    people = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name")
    )
    key = first_value("custkey").alias("key")
    dst = rows_to_changes(orders, "orders", "orderkey").select("*", key)
    src = rows_to_changes(people, "orders", "custkey").select("*", key)
    return dst, src


def merge_sql(amount: str) -> str:
    return f"""
SELECT o_orderkey AS seq, 'orderkey=' || o_orderkey || ';custkey=' || o_custkey || ';amount=' ||
  CASE WHEN c_custkey IS NULL THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST({amount} AS DECIMAL(18,2)) AS VARCHAR) END ||
  CASE WHEN c_custkey IS NULL THEN '' ELSE ';name=' || c_name END AS cells
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


@query("merge_prefer_src", merge_sql("c_acctbal"), base="_one AS (SELECT 1)")
def merge_prefer_src(spark, sf):
    dst, src = _merge_sides(spark, sf)
    return dst.transform(combine.merge(src, ["key"], table="orders")).select("seq", cells())


@query("merge_prefer_dst", merge_sql("o_totalprice"), base="_one AS (SELECT 1)")
def merge_prefer_dst(spark, sf):
    dst, src = _merge_sides(spark, sf)
    return dst.transform(combine.merge(src, ["key"], "dst")).select("seq", cells())


@query("coalesce_slice", """
SELECT min(seq) AS seq, table_name, arg_max(lsn, seq) AS lsn, arg_min(action, seq) AS action, arg_min(us, seq) AS ts_us,
  CASE WHEN count(*) FILTER (action <> 'DELETE') > 0 THEN
    'event_type=' || arg_max(c_type, seq) FILTER (action <> 'DELETE') || ';props=' || arg_max(c_props, seq) FILTER (action <> 'DELETE') ||
    ';user_id=' || c_user || ';value=' || arg_max(c_value, seq) FILTER (action <> 'DELETE')
  ELSE 'user_id=' || c_user END AS cells
FROM changes WHERE table_name <> 'users' GROUP BY table_name, c_user
UNION ALL
SELECT seq, table_name, lsn, action, us, CASE WHEN action = 'DELETE' THEN 'user_id=' || c_user ELSE 'user_id=' || c_user ||
  ';event_type=' || c_type || ';value=' || c_value || ';props=' || c_props END FROM changes WHERE table_name = 'users'""")
def coalesce_slice(spark, sf):
    short = F.filter("columns", lambda c: c["name"] == "user_id")
    rows = changes(spark, sf).withColumn("columns", F.when(F.col("action") == "DELETE", short).otherwise(F.col("columns")))
    out = rows.transform(combine.coalesce_rows("user_id", ["Orders", "accounts", "sessions"]))
    return out.select("seq", "table_name", "lsn", "action", us().alias("ts_us"), cells())


@query("stash_latest", """
SELECT c_user AS "user", max(seq) AS seq, arg_max(lsn, seq) AS lsn FROM changes WHERE c_user IN (
  SELECT c_user FROM changes GROUP BY c_user ORDER BY min(seq) LIMIT 100) GROUP BY c_user""")
def stash_latest(spark, sf):
    return per_user(spark, sf).transform(combine.stash_latest("user", 100)).select("user", "seq", "lsn")


CACHE_SQL = """,
ops AS (SELECT c_user AS k, ts AS ots, us AS ous, c_type AS op, c_value AS v FROM changes WHERE c_type IN ('signup','error')),
asked AS (SELECT * FROM changes WHERE c_type NOT IN ('signup','error'))"""


@query("ttl_lookup", CACHE_SQL + f"""
SELECT seq, CASE WHEN op = 'signup' AND us <= ous + {3 * DAY * 10**6} THEN v END AS cached
FROM asked a ASOF LEFT JOIN ops o ON a.c_user = o.k AND a.ts >= o.ots""")
def ttl_lookup(spark, sf):
    stage = combine.ttl_lookup(derive.cache_ops(events(spark, sf)), "user", 3 * DAY)
    log = events_to_changes(dealt(spark, sf)).withColumn("user", first_value("user_id"))
    asked = log.filter(~first_value("event_type").isin("signup", "error"))
    return asked.transform(stage).select("seq", "cached")


@query("ttl_purge", CACHE_SQL + f"""
SELECT count(*) AS purged FROM (SELECT arg_max(op, ots) AS op, max(ous) AS ous FROM ops GROUP BY k)
WHERE op = 'signup' AND epoch_us(TIMESTAMP '2024-01-28 00:00:00') > ous + {3 * DAY * 10**6}""")
def ttl_purge(spark, sf):
    as_of = F.to_timestamp(F.lit("2024-01-28 00:00:00Z"))
    return combine.ttl_purge(derive.cache_ops(events(spark, sf)), 3 * DAY, as_of)


# ------------------------------------------------------------------ counts


@query("agg_by_table", "SELECT table_name, count(*) AS n FROM changes GROUP BY table_name")
def agg_by_table(spark, sf):
    return changes(spark, sf).transform(counting.aggregate("table"))


@query("agg_by_action", "SELECT action, count(*) AS n FROM changes GROUP BY action")
def agg_by_action(spark, sf):
    return changes(spark, sf).transform(counting.aggregate("action"))


@query("census", "SELECT table_name, action, count(*) AS n FROM changes GROUP BY table_name, action")
def census(spark, sf):
    return changes(spark, sf).transform(counting.census())


@query("census_dense", """
SELECT t.table_name, a.action, count(c.seq) AS n FROM (SELECT DISTINCT table_name FROM changes) t
CROSS JOIN (VALUES ('INSERT'),('UPDATE'),('DELETE'),('TRUNCATE')) a(action)
LEFT JOIN changes c ON c.table_name = t.table_name AND c.action = a.action GROUP BY ALL""")
def census_dense(spark, sf):
    return changes(spark, sf).transform(counting.census(dense=True))


@query("census_lines", "SELECT '  ' || table_name || '/' || action || ': ' || count(*) AS line FROM changes GROUP BY table_name, action")
def census_lines(spark, sf):
    return changes(spark, sf).transform(counting.census_lines())


@query("snapshot_counts", """
SELECT table_name || ':' || action AS key, count(*) AS n, table_name || ':' || action || '=' || count(*) AS text
FROM changes GROUP BY table_name, action""")
def snapshot_counts(spark, sf):
    return changes(spark, sf).transform(counting.snapshot())


@query("summarize", """
SELECT table_name, action, count(*) AS n, CAST(grouping(table_name, action) AS BIGINT) AS level
FROM changes GROUP BY ROLLUP (table_name, action)""")
def summarize(spark, sf):
    return changes(spark, sf).transform(counting.summarize())


@query("pipeline_metrics", RAW_SQL + """
SELECT count(*) AS received, count(*) FILTER (bad OR action NOT IN ('INSERT','UPDATE')) AS filtered,
  count(*) FILTER (NOT bad AND action IN ('INSERT','UPDATE')) AS formatted, count(*) FILTER (bad) AS decode_errors,
  CAST(0 AS BIGINT) AS format_errors FROM decoded""")
def pipeline_metrics(spark, sf):
    e = events(spark, sf)
    rows = changelog.decode_changes(derive.raw_log(e), derive.relation_log(e))
    bad = F.col("decode_error").isNotNull()
    kept = ~bad & F.col("action").isin("INSERT", "UPDATE")
    return rows.agg(*counting.pipeline_metrics(kept, decode_error=bad))


@query("window_count", f"""
SELECT table_name, bucket, n, CAST(sum(n) OVER (PARTITION BY table_name ORDER BY bucket RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_n
FROM (SELECT table_name, us // {HOUR_US} AS bucket, count(*) AS n FROM changes GROUP BY ALL)""")
def window_count(spark, sf):
    return changes(spark, sf).transform(counting.window_count(24, 3600, ["table_name"]))


# ------------------------------------------------------------------ progress and schema


@query("watermark_status", """
SELECT table_name, max(lsn) AS lsn, epoch_us(arg_max(ts, lsn)) AS updated_us,
  epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(arg_max(ts, lsn)) > 7200000000 AS stale FROM changes GROUP BY table_name""")
def watermark_status(spark, sf):
    out = changes(spark, sf).transform(progress.watermark_status("2024-01-31 00:00:00", 7200, ["table_name"]))
    return out.select("table_name", "lsn", us("updated_at").alias("updated_us"), "stale")


VERSION_SQL = RELATIONS_SQL + """,
fp AS (SELECT *, 'public.' || table_name || ':user_id(20)event_type(25)value(701)' || CASE WHEN has_props THEN 'props(25)' ELSE '' END AS fp FROM relations),
ch AS (SELECT *, fp IS DISTINCT FROM lag(fp) OVER (PARTITION BY relation_id ORDER BY seq) AS changed FROM fp),
ver AS (SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY relation_id ORDER BY seq) AS BIGINT) AS version FROM ch)
"""


@query("schema_version", VERSION_SQL + "SELECT seq, relation_id, version, changed FROM ver")
def schema_version(spark, sf):
    return derive.relation_log(events(spark, sf)).transform(progress.schema_version()).select(
        "seq", "relation_id", "version", "changed"
    )


@query("schema_evolve", VERSION_SQL + "SELECT seq, table_name, version FROM ver WHERE changed AND table_name = 'orders'")
def schema_evolve(spark, sf):
    return derive.relation_log(events(spark, sf)).transform(progress.schema_evolve("orders")).select(
        "seq", "table_name", "version"
    )


# ------------------------------------------------------------------ formats, sinks, routing, retention


def rfc_sql(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


NANO_SQL = rfc_sql() + r" || regexp_replace('.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '\.?0+$', '') || 'Z'"
LSN_SQL = "printf('%X/%X', lsn // 4294967296, lsn % 4294967296)"
PROPS_JSON = """replace(c_props, '"', '\\"')"""


def json_cell(name: str, value: str) -> str:
    return f"""'{{"name":"{name}","type":"","value":"' || {value} || '"}}'"""


JSON_SQL = f"""'{{"lsn":"' || {LSN_SQL} || '","timestamp":"' || {NANO_SQL} || '","action":"' || action || '","schema":"public","table":"' || table_name
  || '","columns":[' || {json_cell('user_id', 'c_user')} || ',' || {json_cell('event_type', 'c_type')} || ',' || {json_cell('value', 'c_value')}
  || ',' || {json_cell('props', PROPS_JSON)} || ']' ||
  CASE WHEN action = 'INSERT' THEN '' ELSE ',"old_keys":[' || {json_cell('user_id', 'c_user')} || ']' END || '}}'"""


@query("format_json", f"SELECT seq, {JSON_SQL} AS line FROM changes")
def format_json(spark, sf):
    return changes(spark, sf).transform(formats.formatted("json")).select("seq", "line")


TEXT_SQL = """action || ' public.' || table_name || ' user_id=' || c_user || ' event_type=' || c_type || ' value=' || c_value || ' props=' || c_props"""


@query("format_text", f"SELECT seq, {TEXT_SQL} AS line FROM changes")
def format_text(spark, sf):
    return changes(spark, sf).transform(formats.formatted("text")).select("seq", "line")


def pretty_cell(name: str, value: str) -> str:
    return f"""chr(10) || '    {{' || chr(10) || '      "name": "{name}",' || chr(10) || '      "type": "",' || chr(10) || '      "value": "' || {value} || '"' || chr(10) || '    }}'"""


@query("format_pretty", f"""
SELECT seq, '{{' || chr(10) || '  "lsn": "' || {LSN_SQL} || '",' || chr(10) || '  "timestamp": "' || {NANO_SQL} || '",' || chr(10) ||
  '  "action": "' || action || '",' || chr(10) || '  "schema": "public",' || chr(10) || '  "table": "' || table_name || '",' || chr(10) ||
  '  "columns": [' || {pretty_cell('user_id', 'c_user')} || ',' || {pretty_cell('event_type', 'c_type')} || ',' ||
  {pretty_cell('value', 'c_value')} || ',' || {pretty_cell('props', PROPS_JSON)} || chr(10) || '  ]' ||
  CASE WHEN action = 'INSERT' THEN '' ELSE ',' || chr(10) || '  "old_keys": [' || {pretty_cell('user_id', 'c_user')} || chr(10) || '  ]' END ||
  chr(10) || '}}' AS line FROM changes""")
def format_pretty(spark, sf):
    return changes(spark, sf).transform(formats.formatted("pretty")).select("seq", "line")


@query("format_csv", """
SELECT seq, lsn, action, table_name, c_user AS user_id, c_value AS value FROM changes""")
def format_csv(spark, sf):
    lines = changes(spark, sf).transform(formats.formatted("csv")).select("seq", "line")
    back = F.from_csv("line", "lsn string, at string, action string, s string, t string, body string")
    parsed = lines.withColumn("c", back)
    item = lambda i: F.get_json_object("c.body", f"$[{i}].value")

    return parsed.select(
        "seq", parse_lsn(F.col("c.lsn")).alias("lsn"), F.col("c.action").alias("action"), F.col("c.t").alias("table_name"),
        item(0).alias("user_id"), item(2).alias("value"),
    )


@query("sink_write", f"SELECT {TEXT_SQL} AS line FROM changes")
def sink_write(spark, sf):
    path = scratch(spark, "lines")
    Flow(format="text", sink=writers.text_sink("file", path)).run(changes(spark, sf))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("sink_compressed", f"SELECT {TEXT_SQL} AS line FROM changes")
def sink_compressed(spark, sf):
    path = scratch(spark, "packed")
    Flow(format="text", sink=writers.compressed(path)).run(changes(spark, sf))
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("flow_filter_mask_json", f"""
SELECT '{{"lsn":"' || {LSN_SQL} || '","timestamp":"' || {NANO_SQL} || '","action":"' || action || '","schema":"public","table":"' || table_name
  || '","columns":[' || {json_cell('user_id', 'sha256(c_user)')} || ',' || {json_cell('value', 'c_value')} || ']' ||
  CASE WHEN action = 'INSERT' THEN '' ELSE ',"old_keys":[' || {json_cell('user_id', 'c_user')} || ']' END || '}}' AS line
FROM changes WHERE table_name IN ('orders','users')""")
def flow_filter_mask_json(spark, sf):
    flow = Flow(
        filters=[filters.allow(["public.orders", "public.users"])],
        transforms=[values.project(["user_id", "value"]), values.mask_rules(values.MaskRule("user_id", "hash"))],
    )
    return flow.plan(changes(spark, sf)).select("line")


@query("envelope", f"""
SELECT seq, '{{"id":"' || substr(sha256(seq || ':' || lsn), 1, 26) || '","timestamp":"' || {NANO_SQL} || '","source":"shop","payload":"'
  || replace(replace({TEXT_SQL}, '\\', '\\\\'), '"', '\\"') || '"' ||
  CASE WHEN table_name = 'orders' THEN ',"meta":{{"team":"core"}}' ELSE '' END || '}}' AS envelope FROM changes""")
def envelope(spark, sf):
    stage = values.chain(stamping.enrich({"team": "core"}, ["orders"]), formats.formatted("text"), formats.envelope("shop"))
    return changes(spark, sf).transform(stage).select("seq", "envelope")


@query("fanout", """
SELECT 'all' AS target, table_name, count(*) AS n FROM changes GROUP BY ALL
UNION ALL SELECT 'copy', table_name, count(*) FROM changes GROUP BY ALL""")
def fanout(spark, sf):
    one, two = scratch(spark, "fan-a"), scratch(spark, "fan-b")
    rows = changes(spark, sf).select("seq", "table_name", "action")
    writers.fanout({"all": writers.table_sink(one), "copy": writers.table_sink(two, "json"), "none": _noop})(rows)
    back = spark.read.parquet(one).select(F.lit("all").alias("target"), "table_name").unionByName(
        spark.read.schema("table_name string").json(two).select(F.lit("copy").alias("target"), "table_name")
    )
    return back.groupBy("target", "table_name").agg(F.count(F.lit(1)).alias("n"))


@query("fanout_once", """
SELECT target, table_name, count(*) AS n FROM changes, (VALUES ('all'), ('copy')) t(target) GROUP BY ALL""")
def fanout_once(spark, sf):
    """The second target fails at first; the retry writes it from the stage and leaves the first alone."""
    path = scratch(spark, "once")
    failures = [1]

    def flaky(df: DataFrame, batch_id: int) -> None:
        if failures:
            failures.pop()
            raise OSError("not there yet")
        runner.batch_table(f"{path}/copy")(df, batch_id)

    write = ledger.fanout_once({"all": runner.batch_table(f"{path}/all"), "copy": flaky}, path)
    rows = changes(spark, sf).select("seq", "table_name", "action")
    try:
        write(rows, 7)
    except RuntimeError:
        write(rows, 7)
    read = lambda t: spark.read.schema("table_name string").parquet(f"{path}/{t}/batch=*").withColumn("target", F.lit(t))
    return read("all").unionByName(read("copy")).groupBy("target", "table_name").agg(F.count(F.lit(1)).alias("n"))


def _noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


@query("route", """
SELECT seq, 'everything' AS route FROM changes UNION ALL SELECT seq, 'orders' FROM changes WHERE table_name = 'orders'
UNION ALL SELECT seq, 'deletes' FROM changes WHERE action = 'DELETE'""")
def route(spark, sf):
    stage = writers.route({"everything": None, "orders": F.col("table_name") == "orders", "deletes": F.col("action") == "DELETE"})
    return changes(spark, sf).transform(stage).select("seq", "route")


@query("forward_tap", "SELECT seq, action = 'DELETE' AS tapped FROM changes")
def forward_tap(spark, sf):
    return changes(spark, sf).transform(writers.tapped(F.col("action") == "DELETE")).select("seq", "tapped")


@query("dispatch_write", """
SELECT 'orders' AS target, seq FROM changes WHERE table_name = 'orders' UNION ALL SELECT 'deletes', seq FROM changes WHERE action = 'DELETE'
UNION ALL SELECT 'all', seq FROM changes""")
def dispatch_write(spark, sf):
    """Each route has its own table; all are read back."""
    paths = {name: scratch(spark, f"route-{name}") for name in ("orders", "deletes", "all")}
    conditions = {"orders": F.col("table_name") == "orders", "deletes": F.col("action") == "DELETE", "all": None}
    routes = {name: (cond, writers.table_sink(paths[name])) for name, cond in conditions.items()}
    writers.dispatch(routes)(changes(spark, sf).select("seq", "table_name", "action"))
    parts = [spark.read.schema("seq bigint").parquet(path).select(F.lit(name).alias("target"), "seq") for name, path in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("forward_write", """
SELECT 'main' AS target, seq FROM changes UNION ALL SELECT 'side', seq FROM changes WHERE action = 'DELETE'""")
def forward_write(spark, sf):
    """Deletes also go to a side table."""
    main, side = scratch(spark, "main"), scratch(spark, "side")
    writer = writers.forward(F.col("action") == "DELETE", writers.table_sink(side), writers.table_sink(main))
    writer(changes(spark, sf).select("seq", "action"))
    read = lambda path, name: spark.read.schema("seq bigint").parquet(path).select(F.lit(name).alias("target"), "seq")
    return read(main, "main").unionByName(read(side, "side"))


@query("route_write", """
SELECT route, count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM (
  SELECT seq, table_name AS route FROM changes UNION ALL SELECT seq, 'deletes' FROM changes WHERE action = 'DELETE') GROUP BY route""")
def route_write(spark, sf):
    """A folder for each route, of which a reader of one route prunes the others; all are read back."""
    path = scratch(spark, "routes")
    tables = {t: F.col("table_name") == t for t in ("accounts", "orders", "sessions", "users")}
    stage = writers.route({**tables, "deletes": F.col("action") == "DELETE"})
    writers.table_sink(path, partition_by=["route"])(changes(spark, sf).transform(stage).select("seq", "route"))
    back = spark.read.schema("seq bigint, route string").parquet(path)
    return back.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))


@query("shard_write", """
SELECT table_name AS shard, count(*) AS n, min(seq) AS first_seq FROM changes WHERE table_name IN ('orders','users') GROUP BY 1""")
def shard_write(spark, sf):
    path = scratch(spark, "shards")
    rows = changes(spark, sf).transform(writers.shard(["orders", "users", "empty"])).select("seq", "shard")
    writers.table_sink(path, partition_by=["shard"])(rows)
    back = spark.read.schema("seq bigint, shard string").parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("journal_append", """
SELECT strftime(ts, '%Y-%m-%d') AS day, table_name, count(*) AS n, max(lsn) AS lsn FROM changes GROUP BY ALL""")
def journal_append(spark, sf):
    """Two runs, of the odd and the even days, append to one journal, which is read back by day."""
    path = scratch(spark, "journal")
    for odd in (0, 1):
        rows = changes(spark, sf).filter(F.dayofmonth("ts") % 2 == odd).transform(formats.journal())
        writers.table_sink(path, partition_by=["day"])(rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")))
    back = spark.read.schema("table_name string, lsn bigint, line string, day string").parquet(path)
    return back.groupBy("day", "table_name").agg(F.count("line").alias("n"), F.max("lsn").alias("lsn"))


@query("audit_append", "SELECT action, count(*) AS n FROM changes WHERE table_name = 'orders' AND action IN ('INSERT','DELETE') GROUP BY 1")
def audit_append(spark, sf):
    """Lines of inserts, then of deletes, appended to one log and read back."""
    path = scratch(spark, "audit")
    for action in ("INSERT", "DELETE"):
        writers.text_sink("file", path)(changes(spark, sf).transform(formats.audit(["orders"], [action])))
    action = F.regexp_extract("value", r" action=(\w+) ", 1).alias("action")
    return spark.read.text(path).groupBy(action).agg(F.count(F.lit(1)).alias("n"))


@query("split_left", "SELECT seq, action FROM changes WHERE CAST(c_value AS DOUBLE) > 20")
def split_left(spark, sf):
    left, _ = writers.split(first_value("value").try_cast("double") > 20)
    return changes(spark, sf).transform(left).select("seq", "action")


@query("split_right", "SELECT seq, action FROM changes WHERE NOT CAST(c_value AS DOUBLE) > 20")
def split_right(spark, sf):
    _, right = writers.split(first_value("value").try_cast("double") > 20)
    return changes(spark, sf).transform(right).select("seq", "action")


@query("shard", "SELECT seq, table_name AS shard FROM changes WHERE table_name IN ('orders','users')")
def shard(spark, sf):
    return changes(spark, sf).transform(writers.shard(["orders", "users", "empty"])).select("seq", "shard")


@query("shard_sizes", """
SELECT v.shard, count(c.seq) AS n FROM (VALUES ('orders'),('users'),('empty')) v(shard) LEFT JOIN changes c ON c.table_name = v.shard GROUP BY 1""")
def shard_sizes(spark, sf):
    names = ["orders", "users", "empty"]
    return writers.shard_sizes(changes(spark, sf).transform(writers.shard(names)), names)


@query("batch_assign", "SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 100 AS batch FROM changes")
def batch_assign(spark, sf):
    return changes(spark, sf).transform(selection.batch_assign(100)).select("seq", "batch")


@query("batch_write", """
SELECT batch, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS batch FROM changes) GROUP BY batch""")
def batch_write(spark, sf):
    path = scratch(spark, "batches")
    rows = changes(spark, sf).transform(selection.batch_assign(1000)).select("seq", "batch")
    # Sorted ranges of batches, with the batch as a column: a reader of some batches skips the other files by their statistics.
    writers.table_sink(path)(rows.repartitionByRange("batch").sortWithinPartitions("batch", "seq"))
    return spark.read.schema("seq bigint, batch bigint").parquet(path).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


DEAD_SQL = """,
dead AS (SELECT seq, us, action, table_name FROM changes WHERE action = 'DELETE'
  AND us >= epoch_us(TIMESTAMP '2024-01-30 12:00:00') - 864000000000 ORDER BY us DESC, seq DESC LIMIT 500)"""


def _dead(spark, sf):
    failed = changes(spark, sf).transform(filters.reject(filters.RejectRule("no deletes", action="DELETE")))
    failed = failed.withColumnRenamed("rejection", "reason").withColumn("dead_at", F.col("ts"))
    return writers.dead_letters(failed, "reason", "2024-01-30 12:00:00", 10 * DAY, 500)


@query("dead_letter", DEAD_SQL + "SELECT seq, 'rejecter: message rejected: no deletes' AS reason, us AS dead_us FROM dead")
def dead_letter(spark, sf):
    return _dead(spark, sf).select("seq", "reason", us("dead_at").alias("dead_us"))


@query("dlq_replay", DEAD_SQL + "SELECT seq, 'rejecter: message rejected: orders only' AS reason FROM dead WHERE table_name = 'orders'")
def dlq_replay(spark, sf):
    retry = filters.reject(filters.RejectRule("orders only", "orders"))
    again = writers.replay_dead(_dead(spark, sf), lambda df: retry(df).withColumnRenamed("rejection", "reason"))
    return again.select("seq", "reason")


@query("dead_letter_table", """
, failed AS (SELECT seq, us, action, table_name FROM changes WHERE action = 'DELETE' AND us >= epoch_us(TIMESTAMP '2024-01-30 12:00:00') - 864000000000)
SELECT seq, CASE WHEN table_name = 'orders' THEN 'kept' ELSE 'passed' END AS outcome FROM failed""")
def dead_letter_table(spark, sf):
    """Rows are appended by two runs, aged, and replayed with a stage that refuses orders; what passed and what stays are read back."""
    path = scratch(spark, "letters")
    failed = changes(spark, sf).transform(filters.reject(filters.RejectRule("no deletes", action="DELETE")))
    failed = failed.select("seq", "table_name", F.col("rejection").alias("reason"), F.col("ts").alias("dead_at"))
    letters = deadletters.DeadLetters(spark, path, "seq bigint, table_name string, reason string, dead_at timestamp", 10 * DAY)
    for part in (0, 1):
        letters.append(failed.filter(F.col("seq") % 2 == part))
    end = "2024-01-30 12:00:00"
    letters.expire(end)
    refuse = F.when(F.col("table_name") == "orders", "orders wait")
    letters.replay(lambda df: df.withColumn("reason", refuse), writers.table_sink(f"{path}-passed"), end)
    passed = spark.read.schema("seq bigint").parquet(f"{path}-passed").withColumn("outcome", F.lit("passed"))
    return passed.unionByName(letters.read(end).select("seq", F.lit("kept").alias("outcome")))


@query("replay_recent", f"""
SELECT seq, {TEXT_SQL} AS line FROM (SELECT * FROM changes ORDER BY seq DESC LIMIT 512)
WHERE us >= epoch_us(TIMESTAMP '2024-01-30 23:00:00') - 43200000000""")
def replay_recent(spark, sf):
    stage = values.chain(writers.replay_recent("2024-01-30 23:00:00", 512, DAY / 2), formats.formatted("text"))
    return changes(spark, sf).transform(stage).select("seq", "line")


@query("journal", f"SELECT seq, {NANO_SQL} || chr(9) || table_name || chr(9) || action || chr(9) || 'lsn=' || lsn AS line FROM changes")
def journal(spark, sf):
    return changes(spark, sf).transform(formats.journal()).select("seq", "line")


@query("audit", f"""
SELECT seq, 'time=' || {rfc_sql()} || 'Z table=' || table_name || ' action=' || action || ' lsn=' || {LSN_SQL} AS line
FROM changes WHERE table_name IN ('orders','users') AND action = 'DELETE'""")
def audit(spark, sf):
    return changes(spark, sf).transform(formats.audit(["orders", "users"], ["DELETE"])).select("seq", "line")


@query("observe_lines", f"""
SELECT seq, '[cdc] ' || {rfc_sql()} || 'Z action=' || action || ' table=' || table_name || ' lsn=' || lsn || ' columns=4' AS line FROM changes""")
def observe_lines(spark, sf):
    return changes(spark, sf).select("seq", formats.observe_line("[cdc]").alias("line"))


# ------------------------------------------------------------------ streams


def live_events(spark: SparkSession, sf: str) -> DataFrame:
    # The pattern lets the table be one file as well as a folder of files, of which a micro-batch takes a bounded number.
    files = spark.readStream.schema(events(spark, sf).schema).option("maxFilesPerTrigger", 64)
    return files.parquet(f"{sf}/events.parque[t]")


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """The change log as a stream over the ``events`` files."""
    return events_to_changes(live_events(spark, sf))


def drained(spark: SparkSession, df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    path = scratch(spark, name)
    return runner.drain(df, os.path.join(path, "rows"), os.path.join(path, "progress"), output_mode)


def stream_per_user(spark, sf):
    return stream_events(spark, sf).withColumn("user", first_value("user_id"))


@query("stream_flow", ORACLES["flow_filter_mask_json"].removeprefix("WITH " + CHANGES_SQL))
def stream_flow(spark, sf):
    flow = Flow(
        filters=[filters.allow(["public.orders", "public.users"])],
        transforms=[values.project(["user_id", "value"]), values.mask_rules(values.MaskRule("user_id", "hash"))],
    )
    path = scratch(spark, "flow")
    runner.run_stream(stream_events(spark, sf), flow, path, os.path.join(path, "progress")).awaitTermination()
    return spark.read.text(f"{path}/lines/batch=*").withColumnRenamed("value", "line")


def same_sql(name: str) -> dict:
    """The SQL of a batch query, for its streaming form."""
    recursive = ORACLES[name].startswith("WITH RECURSIVE")
    start = ("WITH RECURSIVE " if recursive else "WITH ") + CHANGES_SQL
    return {"sql": ORACLES[name].removeprefix(start), "recursive": recursive}


RUNS = 4


def arriving(
    spark: SparkSession, sf: str, name: str, logs: dict[str, DataFrame], go: Callable[[dict[str, str]], None], places: int = 1
) -> None:
    """Append ``RUNS`` parts of each log, by ``seq``, to folders; after each, ``go`` runs over what is there.

    ``go`` continues from its checkpoint, so every part is a micro-batch of its own. ``places``: numbers of ``seq`` for an event.
    """
    path = scratch(spark, f"{name}-log")
    paths = {n: f"{path}/{n}" for n in logs}
    low, high = events(spark, sf).agg(F.min("event_id"), F.max("event_id")).first()
    for run in range(RUNS):
        for n, log in logs.items():
            edge = lambda k: places * (low + (high + 1 - low) * k // RUNS)
            inside = (F.col("seq") >= edge(run) if run else F.lit(True)) & (F.col("seq") < edge(run + 1) if run < RUNS - 1 else F.lit(True))
            log.filter(inside).write.mode("append").parquet(paths[n])
        go(paths)


def carried_rows(spark: SparkSession, sf: str, name: str, step: carried.Step, log: DataFrame | None = None, places: int = 1) -> DataFrame:
    """The rows that a step with carried tables gives over the change log (or ``log``), in ``RUNS`` micro-batches."""
    log, path = events_to_changes(dealt(spark, sf)) if log is None else log, scratch(spark, name)

    def go(paths: dict[str, str]) -> None:
        live = changelog.stream_changes(spark, paths["log"], schema=log.schema)
        carried.drain(live, step, path, f"{path}/progress")

    arriving(spark, sf, name, {"log": log}, go, places)
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*")


@query("stream_decode", **same_sql("decode_changes"))
def stream_decode(spark, sf):
    """Relation versions arrive between the runs, in a log of their own; rows wait until it has passed them."""
    path = scratch(spark, "decode")
    logs = {"raw": derive.raw_log(dealt(spark, sf)), "relations": derive.relation_log(events(spark, sf))}
    step = carried.decode(logs["raw"].schema, logs["relations"].schema)

    def go(paths: dict[str, str]) -> None:
        raw, relations = (changelog.stream_changes(spark, paths[n], schema=logs[n].schema) for n in ("raw", "relations"))
        carried.drain(carried.with_relations(raw, relations), step, path, f"{path}/progress")

    arriving(spark, sf, "decode", logs, go, 2)
    out = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*").drop("batch")
    out = out.unionByName(carried.decode_rest(step, spark, path))
    good = F.col("decode_error").isNull()
    return out.select(
        "seq", "lsn", "action", F.when(good, F.col("table_name")).alias("table_name"),
        F.when(good, joined()).alias("cells"), F.when(good, joined(over=F.col("old_keys"))).alias("old"),
        F.col("decode_error").alias("error"),
    )


@query("stream_gate", **same_sql("gate"))
def stream_gate(spark, sf):
    """The control table is joined to the stream by time buckets."""
    out = stream_events(spark, sf).transform(filters.gate(derive.day_switch(events(spark, sf))))
    return drained(spark, out.select("seq"), "gate").select("seq")


@query("stream_coalesce", """
SELECT min(seq) AS seq, table_name, arg_max(lsn, seq) AS lsn, arg_min(action, seq) AS action,
  CASE WHEN count(*) FILTER (action <> 'DELETE') > 0 THEN
    'event_type=' || arg_max(c_type, seq) FILTER (action <> 'DELETE') || ';props=' || arg_max(c_props, seq) FILTER (action <> 'DELETE') ||
    ';user_id=' || c_user || ';value=' || arg_max(c_value, seq) FILTER (action <> 'DELETE')
  ELSE 'user_id=' || c_user END AS cells
FROM changes GROUP BY table_name, c_user""")
def stream_coalesce(spark, sf):
    """Each micro-batch is merged into a table with one row per key, which is read back."""
    short = F.filter("columns", lambda c: c["name"] == "user_id")
    log = events_to_changes(dealt(spark, sf)).withColumn("columns", F.when(F.col("action") == "DELETE", short).otherwise(F.col("columns")))
    path = scratch(spark, "merged")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    table = keyed.upserts(spark, path, schema, "user_id", 8)

    def go(paths: dict[str, str]) -> None:
        keyed.upsert_stream(changelog.stream_changes(spark, paths["log"]), table, f"{path}/progress").awaitTermination()

    arriving(spark, sf, "merge", {"log": log}, go)
    table.vacuum()
    return table.read().select("seq", "table_name", "lsn", "action", cells())


@query("stream_metrics", **same_sql("pipeline_metrics"))
def stream_metrics(spark, sf):
    """Counters observed while a stream runs, appended by a listener and summed."""
    path = scratch(spark, "metrics")
    logs, relations = {"raw": derive.raw_log(dealt(spark, sf))}, derive.relation_log(events(spark, sf))
    bad = F.col("decode_error").isNotNull()
    counters = counting.pipeline_metrics(~bad & F.col("action").isin("INSERT", "UPDATE"), decode_error=bad)
    with metrics.MetricsLog(spark, f"{path}/metrics", "flow") as log:

        def go(paths: dict[str, str]) -> None:
            rows = changelog.decode_stream(changelog.stream_changes(spark, paths["raw"], schema=logs["raw"].schema), relations)
            seen = metrics.counted(rows, "flow", counters).select("seq")
            runner.start(seen, f"{path}/progress", runner.batch_table(f"{path}/rows")).awaitTermination()

        arriving(spark, sf, "metrics", logs, go, 2)
    return log.totals()


@query("stream_ttl_lookup", **same_sql("ttl_lookup"))
def stream_ttl_lookup(spark, sf):
    """Cache operations arrive with the rows; what no later row can find is forgotten."""
    path = scratch(spark, "cache")
    log = events_to_changes(dealt(spark, sf)).withColumn("user", first_value("user_id"))
    asked = log.filter(~first_value("event_type").isin("signup", "error")).select("seq", "ts", "user")
    logs = {"rows": asked, "ops": derive.cache_ops(dealt(spark, sf)).select("seq", "ts", "key", "op", "value")}
    step = carried.ttl_lookup("user", 3 * DAY)

    def go(paths: dict[str, str]) -> None:
        rows, ops = (changelog.stream_changes(spark, paths[n], schema=logs[n].schema) for n in ("rows", "ops"))
        carried.drain(carried.with_ops(rows, ops), step, path, f"{path}/progress")

    arriving(spark, sf, "cache", logs, go)
    return spark.read.parquet(f"{path}/rows/batch=*").select("seq", "cached")


def updated(
    spark: SparkSession, sf: str, name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], log: DataFrame, places: int = 1
) -> DataFrame:
    """A stream in update mode over the arriving parts of a log, as the table that its rows overwrite by key."""
    path = scratch(spark, name)

    def go(paths: dict[str, str]) -> None:
        rows = build(changelog.stream_changes(spark, paths["log"], schema=log.schema))
        keyed.update_stream(rows, keyed.update_table(spark, path, rows, keys), f"{path}/progress").awaitTermination()

    arriving(spark, sf, name, {"log": log}, go, places)
    return keyed.update_table(spark, path, build(log), keys).read()


@query("stream_summarize", **same_sql("summarize"))
def stream_summarize(spark, sf):
    return updated(spark, sf, "summary", counting.summarize(), ["table_name", "action", "level"], events_to_changes(dealt(spark, sf)))


@query("stream_relation_dictionary", **same_sql("relation_dictionary"))
def stream_relation_dictionary(spark, sf):
    """Deletions stay in the table, as an update has to overwrite what was there; the reader leaves them out."""
    log = derive.relation_log(events(spark, sf))
    latest = updated(spark, sf, "dictionary", changelog.latest_relations, ["relation_id"], log, 2)
    return dictionary_rows(changelog.known_relations(latest))


@query("stream_watermark_status", **same_sql("watermark_status"))
def stream_watermark_status(spark, sf):
    stage = progress.watermark_status("2024-01-31 00:00:00", 7200, ["table_name"])
    out = updated(spark, sf, "watermark", stage, ["table_name"], events_to_changes(dealt(spark, sf)))
    return out.select("table_name", "lsn", us("updated_at").alias("updated_us"), "stale")


@query("stream_dedup_ttl", **same_sql("dedup_ttl"))
def stream_dedup_ttl(spark, sf):
    path, live = scratch(spark, "dedup"), stream_per_user(spark, sf).select("seq", "ts", "user")
    return carried.drain(live, carried.dedup_ttl(["user"], DAY), path, f"{path}/progress").select("seq")


@query("stream_token_bucket", **same_sql("token_bucket"))
def stream_token_bucket(spark, sf):
    out = stream_per_user(spark, sf).transform(processors.token_bucket(1, DAY / 2, 2, ["user"]))
    return drained(spark, out.select("seq", "admitted"), "bucket").select("seq", "admitted")


@query("stream_sample_max_per_second", **same_sql("sample_max_per_second"))
def stream_sample_max_per_second(spark, sf):
    out = stream_per_user(spark, sf).transform(processors.sample_max_per_second(2, ["user"], DAY))
    return drained(spark, out.select("seq"), "sample").select("seq")


@query("stream_align", **same_sql("align"))
def stream_align(spark, sf):
    return carried_rows(spark, sf, "align", carried.align()).select("seq", "lsn")


@query("stream_cap", **same_sql("cap"))
def stream_cap(spark, sf):
    return carried_rows(spark, sf, "cap", carried.cap(700, "orders", "UPDATE")).select("seq", "table_name", "action")


@query("stream_sequence", **same_sql("sequence"))
def stream_sequence(spark, sf):
    return carried_rows(spark, sf, "sequence", carried.sequence(1000, "orders")).select("seq", meta("seq", "stamp"))


def drained_to_the_end(spark: SparkSession, sf: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over the log; then a last row of no table, far ahead in time, closes what is still open.

    The second run goes on from the checkpoint of the first, as a live stream would.
    """
    log, path = scratch(spark, f"{name}-log"), scratch(spark, name)
    changes(spark, sf).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(log)

    def drain() -> DataFrame:
        out = build(changelog.stream_changes(spark, log))
        return runner.drain(out, os.path.join(path, "rows"), os.path.join(path, "progress"))

    drain()
    last = changes(spark, sf).orderBy(F.desc("ts")).limit(1)
    nothing = {"seq": F.lit(-1).cast("bigint"), "table_name": F.lit("-"), "columns": F.array().cast(CELLS)}
    last.withColumns({**nothing, "ts": F.col("ts") + F.expr("INTERVAL 10 DAYS")}).write.mode("append").parquet(log)
    return drain()


@query("stream_debounce", **same_sql("debounce"))
def stream_debounce(spark, sf):
    """A last row of no user, far ahead in time, closes what is still open; that run goes on from the checkpoint of the first."""
    log, path = scratch(spark, "debounce-log"), scratch(spark, "debounce")
    rows = per_user(spark, sf).select("seq", "ts", "user")
    rows.write.parquet(log)
    step = carried.debounce(rows.schema, ["user"], 6 * 3600, 12 * 3600)

    def drain() -> DataFrame:
        return carried.drain(changelog.stream_changes(spark, log, schema=rows.schema), step, path, f"{path}/progress")

    drain()
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    last.select(F.lit(-1).cast("bigint").alias("seq"), "ts", F.lit(None).cast("string").alias("user")).write.mode("append").parquet(log)
    return drain().filter("seq >= 0").select("seq", us("emit_ts").alias("emit_us"), "burst_rows")


@query("stream_schema_version", **same_sql("schema_version"))
def stream_schema_version(spark, sf):
    out = carried_rows(spark, sf, "versions", carried.schema_version(), derive.relation_log(events(spark, sf)), 2)
    return out.select("seq", "relation_id", "version", "changed")


@query("stream_distinct_key", **same_sql("distinct_key"))
def stream_distinct_key(spark, sf):
    out = stream_events(spark, sf).transform(processors.distinct_key(first_value("user_id"), "orders"))
    return drained(spark, out.select("seq"), "distinct").select("seq")


@query("stream_sequence_all", """
SELECT seq, CAST(row_number() OVER (ORDER BY seq) AS VARCHAR) AS n FROM changes""")
def stream_sequence_all(spark, sf):
    """The defaults number all rows, as in batch."""
    return carried_rows(spark, sf, "numbers", carried.sequence()).select("seq", meta("seq", "n"))


@query("stream_census", **same_sql("census"))
def stream_census(spark, sf):
    counts = drained(spark, stream_events(spark, sf).transform(counting.census()), "census", "complete")
    # Complete mode: the last batch holds the whole result.
    last = counts.agg(F.max("batch").alias("_last"))
    return counts.join(last, F.col("batch") == F.col("_last")).select("table_name", "action", "n")


@query("stream_window_count", f""",
w AS (SELECT table_name, (us // {HOUR_US} - i) * {HOUR_US} AS start_us FROM changes, range(24) r(i))
SELECT table_name, start_us, count(*) AS window_n FROM w GROUP BY ALL""")
def stream_window_count(spark, sf):
    stage = counting.window_count_stream(24, "1 hour", "24 hours", "1 hour", ["table_name"])

    def build(live: DataFrame) -> DataFrame:
        return live.transform(stage).select("table_name", us("window.start").alias("start_us"), "window_n")

    out = drained_to_the_end(spark, sf, "windows", build)
    return out.filter("table_name <> '-'").select("table_name", "start_us", "window_n")


@query("stream_checkpoint", "SELECT max(lsn) AS lsn FROM changes WHERE table_name = 'orders'")
def stream_checkpoint(spark, sf):
    """Highest lsn written per batch; rows that the filter drops do not move it."""
    path = scratch(spark, "checkpoint")
    flow = Flow(filters=[filters.allow(["public.orders"])], format="text")
    runner.run_stream(stream_events(spark, sf), flow, path, os.path.join(path, "progress")).awaitTermination()
    return spark.read.schema("lsn bigint").parquet(f"{path}/checkpoint/batch=*").agg(F.max("lsn").alias("lsn"))
