"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A listed URL sets one bit in each of the eight 64-bit words of one block; a page's URL that
finds all its bits set may be listed, and only such pages go to the exact hash join with the
list, which removes the false positives.  The blocks are broadcast while they are known to
be small, and joined by block number beyond that; pages are read once, and those that a rule
decides, or that have no host, are not tested.

Null URLs, and those without ``://``, have an empty host, path and canonical form; they fit
no rule, are never listed, and so are allowed.  Repeated rows are judged each; a listed URL
may repeat.  An empty list blocks nothing, an empty table of pages
gives no rows, and a very long URL is a key like others.  Other columns are kept unless they have the name
of a result column, which then replaces them.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: (verdict, host, path); fixed values of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
WORDS = 8


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a slash at its end, and the query's parameters in order, without ref and utm_ ones; no scheme, no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("ref=") & ~x.startswith("utm_")))
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    whole = F.concat(bare, F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(bare == "", "").otherwise(whole)


def judged(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks))


def _bits(key: str) -> list[Column]:
    return [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({key}, 2), {6 * i}) & 63 as int))") for i in range(WORDS)]


def bloom(listed: DataFrame, n_blocks: int, key: str = "canonical") -> DataFrame:
    """The filter's blocks that hold a bit: (block, w0 ... w7)."""
    rows = listed.select(_block(F.col(key), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def apply(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], bits_per_url: int = 12, broadcast_bytes: int = 8_000_000) -> DataFrame:
    """pages with host, path, canonical, rule and verdict.  listed: a column ``canonical`` of listed canonical URLs."""
    listed = cut(listed.where("canonical IS NOT NULL AND canonical <> ''").select("canonical").distinct(), "urls")
    n_blocks = max(1, math.ceil(listed.count() * bits_per_url / (64 * WORDS)))
    blocks = bloom(listed, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    own = pages.drop("host", "path", "canonical", "rule", "verdict")
    own = own.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    own = own.withColumn("_judged", judged(rules, F.col("host"), F.col("path")))
    # What needs no test has keys that nothing joins, spread over all tasks.
    nowhere = -1 - F.pmod(F.xxhash64("url", "canonical", F.monotonically_increasing_id()), F.lit(1 << 20))
    own = own.withColumn("_open", F.col("_judged").isNull() & (F.col("canonical") != "")).withColumn("_nowhere", nowhere)
    own = own.withColumn("_block", F.when(F.col("_open"), _block(F.col("canonical"), n_blocks)).otherwise(F.col("_nowhere")))
    words = blocks.withColumnRenamed("block", "_block").withColumnsRenamed({f"w{i}": f"_w{i}" for i in range(WORDS)})
    every = reduce(and_, [F.col(f"_w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits("canonical"))])
    tested = own.join(words, "_block", "left").withColumn("_maybe", F.col("_open") & F.coalesce(every, F.lit(False)))
    tested = tested.withColumn("_key", F.when(F.col("_maybe"), F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.col("_nowhere").cast("string"))))
    found = listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("_listed"))
    got = tested.join(found, "_key", "left")
    verdict = F.coalesce(F.col("_judged.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    kept = [c for c in own.columns if c not in ("_judged", "_open", "_nowhere", "_block")]
    return got.select(*kept, F.col("_judged.rule").alias("rule"), verdict.alias("verdict"))


def thin(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The list of the query: canonical URLs under which a page of less than ``least`` bytes was met."""
    return pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) < least).select(canonical(F.col("url")).alias("canonical"))


def query(pages: DataFrame) -> DataFrame:
    return apply(pages.select("page_id", "url"), thin(pages), RULES).select("page_id", "host", "path", "rule", "verdict", "canonical")


SQL = r"""
WITH parts AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda x: x <> '' AND NOT starts_with(x, 'ref=') AND NOT starts_with(x, 'utm_'))) AS kept
  FROM pages),
bare AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') AS bare FROM parts),
own AS (
  SELECT *, CASE WHEN bare = '' THEN '' ELSE bare || regexp_replace(path, '/+$', '') ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM bare),
listed AS (SELECT DISTINCT canonical FROM own WHERE coalesce(strlen(html), 0) < 1000 AND canonical <> ''),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT o.page_id, o.host, o.path, o.canonical,
    (SELECT max_by(struct_pack(rule := r.h || r.p, verdict := r.verdict), length(r.h || r.p)) FROM rules r
     WHERE (o.host = r.h OR ends_with(o.host, '.' || r.h)) AND starts_with(o.path, r.p)) AS j
  FROM own o)
SELECT g.page_id, g.host, g.path, j.rule AS rule,
  coalesce(j.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, g.canonical
FROM judged g LEFT JOIN listed l ON l.canonical = g.canonical
"""
