"""URL filters: rules on hosts and paths, and a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

#: (host, path, verdict). A rule fits its host and all subdomains, if the URL's path starts with the rule's; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Hosts with this label, wherever it stands, whose pages' URLs make up the production list.
LISTED_LABEL = "spam-farm"

BITS_PER_URL = 12
WORDS = 8  # of 32 bits in a block; a URL sets one bit in each
#: A filter of up to so many bytes is broadcast; a larger one is joined by its block number.
BROADCAST_BYTES = 8 << 20
#: A list of up to so many URLs is broadcast for the exact join too.
SMALL_LIST = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without a leading www. or m., path without trailing slashes, query without utm_ parameters; no scheme, no fragment. Null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    bare = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(bare, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (host and path together), else nulls. rules is a small list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(bits: Column) -> list[Column]:
    """The bit that a URL sets in each word of its block, from a hash of the URL: five bits of the hash choose each."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 5 * w).bitwiseAND(F.lit(31).cast("long")).cast("int")) for w in range(WORDS)]


def build_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter: (block, w0 .. w7) of every block that holds a URL. Partial ORs are joined per block, so no group meets whole."""
    return (
        listed.select(_block(F.col(url), blocks).alias("block"), F.xxhash64(url, F.lit(1)).alias("bits"))
        .select("block", *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("bits")))))
        .groupBy("block")
        .agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)))
    )


def url_verdicts(pages: DataFrame, listed: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed of every row of pages.

    The verdict is that of the longest fitting rule; else block if the canonical URL is one of ``listed`` (a column canonical_url), else allow.
    A blocked Bloom filter of the list (12 bits a URL; a URL sets one bit in each of the eight words of one block) lets through all listed URLs and few others; only these
    meet the list in an exact join. A list of up to SMALL_LIST URLs and BROADCAST_BYTES goes to all tasks, so that pages are read once and not shuffled; of a longer one only the rows that the
    filter lets through are shuffled, and a URL that very many pages have is split by Spark's skew join.
    Null or unparsable URLs: empty host and path, no rule, allow. Repeated rows are each judged; nulls and repeats in the list count once; an empty
    list lists nothing, an empty table of pages gives an empty one. Other columns are ignored. The list is written to the shared folder.
    """
    known = shared.written(listed.select(F.col("canonical_url").cast("string").alias("canonical_url")).filter("canonical_url is not null").distinct(), "url-list")
    held = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("canonical_url")), F.lit(0)).alias("bytes")).first()
    count, small = held["n"], held["n"] <= SMALL_LIST and held["bytes"] <= BROADCAST_BYTES
    blocks = max(1, -(-count * BITS_PER_URL // (32 * WORDS)))
    bloom = build_filter(known, "canonical_url", blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    rows = shared.picked(pages, page_id=page_id, url=url).withColumn("url", F.col("url").cast("string"))
    u = F.col("url")
    rows = rows.select("page_id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical_url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    c = F.col("canonical_url")
    # pages without a canonical URL are spread over the blocks, so that a join by block doesn't gather them
    rows = rows.withColumns({"block": F.coalesce(_block(c, blocks), F.pmod(F.xxhash64("page_id"), F.lit(blocks))), "bits": F.xxhash64(c, F.lit(1))})
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("bits")))])
    probed = rows.join(bloom, "block", "left").withColumn("maybe", c.isNotNull() & F.coalesce(hit, F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "ruled", "canonical_url"]
    exact = known.select(F.col("canonical_url").alias("found"))
    if small:
        met = probed.join(F.broadcast(exact), F.when(F.col("maybe"), c) == F.col("found"), "left")
    else:
        met = probed.filter("maybe").join(exact, c == F.col("found"), "left").unionByName(probed.filter("not maybe").withColumn("found", F.lit(None).cast("string")))
    out = met.select(*columns, F.col("found").isNotNull().alias("listed"))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "canonical_url", "listed"
    )


def listed_urls(pages: DataFrame, url: str = "url", label: str = LISTED_LABEL) -> DataFrame:
    """canonical_url of every page whose host has the label, behind www., m. or any other subdomain too. May be empty."""
    u = F.col("url")
    rows = shared.picked(pages, url=url).select(u.cast("string"))
    return rows.filter(host(u).rlike(rf"(^|[.@]){re.escape(label)}([.:]|$)")).select(canonical(u).alias("canonical_url"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; listed are the URLs of pages on hosts with LISTED_LABEL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, listed_urls(pages))


_SQL_PARTS = r"""
 p AS (SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path,
        array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS query
      FROM pages),
 c AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
        regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
      FROM p)"""

OP6_SQL = f"""
WITH {_SQL_PARTS.strip()},
 l AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '(^|[.@]){LISTED_LABEL}([.:]|$)') AND canonical_url IS NOT NULL),
 r(h, q, v) AS (VALUES {", ".join(str(x) for x in RULES)}),
 best AS (SELECT page_id, host, path, arg_max(h || q, length(h) + length(q)) AS rule, arg_max(v, length(h) + length(q)) AS v
      FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.v, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  c.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN best ON c.page_id = best.page_id AND c.host = best.host AND c.path = best.path LEFT JOIN l ON c.canonical_url = l.canonical_url
"""
