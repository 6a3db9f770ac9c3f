"""URL filter: host and path rules first, then a blocked Bloom filter before an exact hash join.

The filter is a table of blocks of 256 bits.  A canonical URL hashes to one block and to
eight bits, one in each of its 32-bit words.  The list's bits are OR-ed by block, the pages
look up their block, and only pages whose eight bits are all set go on to the exact join
with the list, which removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path prefix), as the contract of the query states them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: First labels of the hosts whose pages make up the query's list.
LISTED_HOSTS = ["spam-farm", "casino-win"]
BITS_PER_URL, BLOCK_BITS = 16, 256
#: 32 MB of blocks at most: a longer list shares them, which only lets more pages through to the exact join.
MAX_BLOCKS = 1 << 20


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a closing ``/``; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/``) and its verdict, else nulls."""
    fits = [(v, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    first = lambda k: F.coalesce(*[F.when(x[2], F.lit(x[k])) for x in fits], F.lit(None).cast("string"))
    return first(1), first(0)


def _bits(url: Column, blocks: int) -> list[Column]:
    """The block of ``url`` and eight words with one bit set in each."""
    hashed = F.xxhash64(url, F.lit(7))
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *[F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(hashed, 5 * k).bitwiseAND(F.lit(31)).cast("int")).alias(f"w{k}") for k in range(8)]]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: a row for each block in use, at most ``blocks``."""
    return listed.select(*_bits(F.col("url"), blocks)).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"f{k}") for k in range(8)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, listed.

    ``listed`` has a column ``url`` of canonical URLs; repeats and nulls in it do no harm.
    The longest rule that fits decides.  Where none fits, a listed URL is blocked and any
    other allowed.  A null URL, or one without ``://``, has empty host and path, fits no rule
    and is allowed.  Repeated rows are judged each; other columns are ignored.
    """
    listed = listed.select("url").filter("url IS NOT NULL AND url <> ''").distinct()
    blocks = min(MAX_BLOCKS, max(1, listed.count() * BITS_PER_URL // BLOCK_BITS))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("url"))
    probe = rows.select("*", *_bits(F.col("url"), blocks)).join(F.broadcast(bloom_blocks(listed, blocks)), "block", "left")
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"f{k}").bitwiseAND(F.col(f"w{k}")) == F.col(f"w{k}"), F.lit(False)) for k in range(8)])
    probe = probe.select("page_id", "host", "path", "rule", "by_rule", "url", hit.alias("hit"))
    # A page that can't be listed never enters the join.
    missed = probe.filter(~F.col("hit")).withColumn("listed", F.lit(False))
    found = probe.filter("hit").join(listed.withColumn("listed", F.lit(True)), "url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    block = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return missed.unionByName(found).select("page_id", "host", "path", "rule", F.coalesce("by_rule", block).alias("verdict"), "listed")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is drawn from the pages: the canonical URLs of all pages under the hosts in ``LISTED_HOSTS``."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    listed = pages.filter(F.regexp_replace(host, r"^(www|m)\.", "").rlike(f"^({'|'.join(LISTED_HOSTS)})[.]")).select(canonical(host, path).alias("url"))
    return judge_urls(pages, listed, RULES)


QUERIES = {"op7_url_filter": op7_url_filter}

_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_CASE = lambda k: "CASE " + " ".join(f % (r[1] + r[2], r[0])[k] for f, r in zip(_FITS, sorted(RULES, key=lambda r: -len(r[1] + r[2])))) + " END"

ORACLE_SQL = {
    "op7_url_filter": rf"""
        WITH u AS (SELECT page_id,
                          translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
             c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') AS bare FROM u),
             l AS (SELECT DISTINCT bare || regexp_replace(path, '/+$', '') AS url FROM c WHERE regexp_matches(bare, '^({'|'.join(LISTED_HOSTS)})[.]')),
             j AS (SELECT page_id, host, path, {_CASE(0)} AS rule, {_CASE(1)} AS by_rule,
                          bare || regexp_replace(path, '/+$', '') IN (SELECT url FROM l) AS listed FROM c)
        SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""
}
