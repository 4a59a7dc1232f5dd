"""URL filters: host/path rules first, then listed URLs through a blocked Bloom filter.

A page's canonical URL and the roots of its host and parent domains are probed
against a blocked Bloom filter of the listed entries: one 64-bit word per
block, a few bits per entry, so a probe touches one word. Only possible hits
reach the exact hash join, which removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, let, table

#: Fixed values: (verdict, host, path) of the rules; the longest that fits wins.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: The default list, as fixed values: widely known advertising and tracking sites, and a few listed pages of sites that are
#: fine as a whole. Callers bring their own list.
LISTED = [
    "doubleclick.net", "googlesyndication.com", "adnxs.com", "taboola.com", "outbrain.com", "criteo.com", "scorecardresearch.com",
    "https://example.com/ads?id=1", "http://www.example.org/spam/", "example.net/tracking/pixel.gif",
]
#: Sites in the zones reserved for examples, so that the query has something to find in tables that use no others.
LISTED_NAMES = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]
LISTED_ZONES = ["example.com", "example.net", "example.org"]
#: Query parameters that do not change what a URL names.
TRACKING = r"^(?:utm_[a-z]+|ref|gclid|fbclid)="
#: Blocks of the filter, 16 bytes a row, that are broadcast at most: 16 MB. A larger filter is joined by block.
MAX_BLOCKS = 1 << 20
#: Entries for a block of 64 bits, and bits that each sets.
LOAD, BITS = 4, 4


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(rest, upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """``host/path?query``: no scheme, ``www.``, port, tracking parameters, fragment or last slash."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":\d*$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("/"))


def canonical_entry(entry: Column) -> Column:
    """What an entry of a list stands for: a URL, or one without its scheme, in the form of :func:`canonical`.

    A bare host, ``host`` or ``host/``, is a whole site with its subdomains; anything with a path or a
    query is that one page. Null and blank entries, and those without a host, are null.
    """
    flat = F.trim(entry)
    found = canonical(F.when(F.contains(flat, F.lit("://")), flat).otherwise(F.concat(F.lit("http://"), flat)))
    return F.when(~found.rlike("^[/?]") & (found != ""), found)


def listed_sites(spark: SparkSession) -> DataFrame:
    """The default list."""
    return spark.createDataFrame([(x,) for x in LISTED + [f"{name}.{zone}" for name in LISTED_NAMES for zone in LISTED_ZONES]], "entry string")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, word)``: the non-empty blocks of the filter, at most ``blocks`` rows."""
    return listed.groupBy(_block(F.col("entry"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("entry"))).alias("word"))


def _rule_columns(host: Column, path: Column) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # a later, longer rule goes on top
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Verdict for every row of ``pages(page_id, url)`` against ``listed(entry)``.

    Entries are in any of the forms of :func:`canonical_entry`. A null URL, or one without ``://``,
    has an empty host and path, fits no rule and is allowed. Rows are kept one for one, repeated and
    null ids included; other columns of ``pages`` are ignored. An empty list or table is fine.

    Returns page_id, host, path, rule, verdict, listed (the canonical entry hit, the longest if
    several, else null).
    """
    listed = hold(listed.select(canonical_entry(F.col("entry")).alias("entry")).where("entry is not null").distinct())
    # 16 bits for each entry, however many there are.
    blocks = max(64, -(-listed.count() // LOAD))
    host, path = F.col("host"), F.col("path")
    rule, verdict = _rule_columns(host, path)
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    # What a page may be listed under: its canonical URL, its host and each parent domain.
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    roots = let(labels, lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.concat(F.array_join(F.slice(a, i, F.size(a)), "."), F.lit("/"))))
    open_ = judged.where(F.col("rule").isNull() & (F.col("host") != ""))
    probes = open_.select("url", F.explode(F.array_distinct(F.array_union(F.array(canonical(F.col("url"))), roots))).alias("entry"))
    probes = probes.select("url", "entry", _block(F.col("entry"), blocks).alias("block"), _mask(F.col("entry")).alias("mask"))
    # Broadcast where its size, known here, allows it; else both sides are dealt by block, which is a hash, so evenly.
    words = bloom(listed, blocks)
    possible = probes.join(F.broadcast(words) if blocks <= MAX_BLOCKS else words, "block")
    hits = possible.where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("url", "entry").distinct()
    exact = hits.join(listed, "entry").groupBy("url").agg(F.max_by("entry", F.struct(F.length("entry"), "entry")).alias("listed"))
    return judged.join(exact, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("listed")).alias("listed"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), listed_sites(spark))


def _canonical(url: str) -> str:
    """The canonical form in SQL."""
    host = f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = f"regexp_replace(regexp_replace({host}, ':[0-9]*$', ''), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')))"
    return f"({host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '/' END)"


_fits = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP9_SQL = f"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
entries AS (
  SELECT unnest([{", ".join(f"'{x if '://' in x else 'http://' + x}'" for x in LISTED)}]) AS url
  UNION ALL
  SELECT 'http://' || name || '.' || zone
  FROM (SELECT unnest([{", ".join(f"'{n}'" for n in LISTED_NAMES)}]) AS name),
       (SELECT unnest([{", ".join(f"'{z}'" for z in LISTED_ZONES)}]) AS zone)),
listed AS (SELECT DISTINCT {_canonical("url")} AS entry FROM entries),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _by_length)} END AS rule,
         CASE {" ".join(f"WHEN {_fits.format(h=h, p=p)} THEN '{v}'" for v, h, p in _by_length)} END AS by_rule,
         regexp_replace(host, ':[0-9]*$', '') AS bare, {_canonical("url")} AS canon
  FROM parts),
hit AS (
  SELECT r.*, CASE WHEN host <> '' THEN (SELECT arg_max(entry, (length(entry), entry)) FROM listed l
                   WHERE l.entry = r.canon OR l.entry = bare || '/' OR ends_with('.' || bare || '/', '.' || l.entry)) END AS found
  FROM ruled r)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN found END AS listed
FROM hit
"""
QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": OP9_SQL}
