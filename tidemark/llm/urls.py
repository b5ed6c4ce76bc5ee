"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 8  # a block has 512 bits: one cache line
BITS_PER_URL = 16  # one bit set in each word of the block


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # with its leading slash

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the URLs of a page.

    Host and path without scheme, A-Z of the host lower-cased, a leading ``www.`` or ``m.`` and the
    ports 80 and 443 left out, then the query without ``utm_*`` and ``ref`` parameters; no fragment,
    no ``index.html`` or ``index.htm``, no slash at the end of the path. Null without ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www\.|m\.)", ""), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?\z", "/"), r"/+\z", "")
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|\z)"))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).alias("_block")


def _masks(url: str) -> list[Column]:
    """The bit that a URL has in each word of its block."""
    bits = F.xxhash64(F.lit(17), url)
    place = [F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int") for k in range(BLOCK_WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def bloom_filter(listed: DataFrame, url: str = "url") -> tuple[DataFrame, int]:
    """A blocked Bloom filter as a table: ``_block`` and eight 64-bit words, a row for each used block.

    A URL sets one bit in each word of one block, so a block is summed with ``bit_or`` on the map
    side and probed with one equi-join; the table grows with the list and need not be broadcast.
    Also returns the number of blocks, for ``BITS_PER_URL`` bits a URL.
    """
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * BLOCK_WORDS)))
    words = [F.bit_or(m).alias(f"_w{k}") for k, m in enumerate(_masks(url))]
    return listed.groupBy(_block(url, blocks)).agg(*words), blocks


def possible_hits(urls: DataFrame, filter_: DataFrame, blocks: int, url: str = "url") -> DataFrame:
    """The rows of ``urls`` whose bits are all set: every listed URL, and a few others."""
    probed = urls.withColumn("_block", _block(url, blocks)).join(filter_, "_block")
    for k, m in enumerate(_masks(url)):
        probed = probed.filter(F.col(f"_w{k}").bitwiseAND(m) == m)
    return probed.select(urls.columns)


def judge(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url"
) -> DataFrame:
    """``pages`` with host, path, canonical_url, rule, listed and verdict (columns of these names go).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    fitting rule decides (``rule``: its host and path). Without one, pages whose canonical URL is that of a row of
    ``listed`` are blocked, others allowed. A blocked Bloom filter drops most unlisted URLs before
    an exact join removes its false positives; both work on distinct canonical URLs, so a URL
    that fills the table is judged once.

    Null URLs and URLs without ``://`` have empty host and path, fit no rule with a path, are not
    listed, and are allowed. Repeated rows stay; an empty list lists nothing.
    """
    new = ["host", "path", "canonical_url", "rule", "listed", "verdict"]
    out = pages.drop(*[c for c in new if c != url]).withColumns(
        {"_host": host_of(F.col(url)), "_path": path_of(F.col(url)), "_canonical": canonical(F.col(url))}
    )
    names = listed.select(canonical(F.col(listed_url)).alias("_url")).filter("_url IS NOT NULL").distinct()
    filter_, blocks = bloom_filter(names, "_url")
    asked = out.select(F.col("_canonical").alias("_url")).filter("_url IS NOT NULL").distinct()
    hits = possible_hits(asked, filter_, blocks, "_url").join(names, "_url", "left_semi")
    out = out.join(hits.select(F.col("_url").alias("_canonical"), F.lit(True).alias("_listed")), "_canonical", "left")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("_host") == r.host) | F.endswith("_host", F.lit("." + r.host))) & F.startswith("_path", F.lit(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    is_listed = F.coalesce("_listed", F.lit(False))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in new or c == url]
    return out.select(
        *keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_canonical").alias("canonical_url"),
        rule.alias("rule"), is_listed.alias("listed"),
        F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
    )
