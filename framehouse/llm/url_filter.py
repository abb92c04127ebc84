"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, no canonical form and the
verdict allow. Repeated rows are judged alike, each in its own row. Only the columns named by ``page_id`` and ``url``
are read, so extra columns of any name are ignored. An empty listing blocks nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host and path prefix of each rule of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
WORDS, BITS_PER_KEY = 4, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without www., m. or default port, path without index page or end slash, query without tracking; null for no host."""
    query = F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), r"^[^?]*\?(.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&+", "")
    bare = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    page = F.regexp_replace(path, r"(/index\.html?|/)$", "")
    return F.when(host != "", F.concat(bare, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null for none. Rules are a short configured list, tried longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    """Two bits in each word of the key's block."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, n).bitwiseAND(63).cast("int"))
    return [bit(12 * w).bitwiseOR(bit(12 * w + 6)) for w in range(WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each block of 256 bits that holds a key: block, w0..w3. Bits meet by bit_or, before the shuffle as well."""
    block = F.pmod(F.xxhash64("canon"), F.lit(n_blocks)).alias("block")
    words = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canon")))]
    return listed.select(block, *words).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_hits(urls: DataFrame, listed: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Rows of urls(canon, ...) whose canon is in listed(canon): possible hits by the Bloom filter, then an exact join.

    The filter is broadcast only while its size, known from the count of keys, is within broadcast_bytes; else it is
    joined by block. The exact join has no such bound and is never hinted.
    """
    listed = listed.where(F.col("canon").isNotNull()).distinct()
    n_blocks = max(1, -(-listed.count() * BITS_PER_KEY // 256))
    bloom = bloom_filter(listed, n_blocks)
    if n_blocks * 64 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    probes = urls.where(F.col("canon").isNotNull()).withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(n_blocks)))
    set_bits = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canon")))]
    possible = probes.join(bloom, "block").where(reduce(Column.__and__, set_bits)).select(urls.columns)
    return possible.join(listed, "canon", "left_semi").select(urls.columns)


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canon, listed of each row.

    listed: a table with a column url. Without one, the listing is the urls of pages that a blocking rule judges, so
    that other spellings of a blocked page are blocked with it.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = named.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), canonical(F.col("url"), F.col("host"), F.col("path")).alias("canon"))
    if listed is None:
        block_list = judged.where(F.col("verdict") == "block").select("canon")
    else:
        host, path = host_and_path(F.col("url"))
        block_list = listed.select(F.col("url").cast("string").alias("url")).select(canonical(F.col("url"), host, path).alias("canon"))
    ruled, free = judged.where(F.col("rule").isNotNull()), judged.where(F.col("rule").isNull())
    # The few canonical forms that hit come back to all their pages; both sides of that join are by canonical URL.
    hits = listed_hits(free.select("canon").distinct(), block_list).withColumn("listed", F.lit(True))
    judged_free = free.join(hits, "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = ["page_id", "host", "path", "rule", "verdict", "canon", "listed"]
    return ruled.withColumn("listed", F.lit(None).cast("boolean")).select(out).unionByName(
        judged_free.withColumn("verdict", F.when(F.col("listed"), "block").otherwise("allow")).select(out))
