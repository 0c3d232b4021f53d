"""URL filter: host and path rules first, then a list of URLs behind a blocked Bloom filter.

A rule names a host, with all its subdomains, and the start of a path; the longest rule
that fits decides. URLs without a rule are blocked if their canonical form is on the list:
a blocked Bloom filter (blocks of eight 64-bit words, one bit set in each word) passes
possible hits, and a hash join on the canonical URL itself removes those that aren't
listed. The filter's size follows the counted list; up to ``MOST_BLOCKS`` it is broadcast,
above it is joined by block. Only URLs without a rule meet the filter, and only possible
hits the list; a URL or block with many rows is dealt out (``dealt_join``), so that one
URL that is a third of all rows meets no single task.

Canonical: no scheme, no ``www.`` or ``m.``, host in lower case, path without ``.html`` and
trailing slashes, no query or fragment.

A URL that is null or has no ``://`` has an empty host and path; it has no rule, no
canonical form, and is allowed. Repeated rows and null ids stay. An empty table or list
gives no error. Other columns are kept by ``judged``, but for those named as one that it makes
(``MADE``): they are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dealt_join

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

BITS_PER_URL, WORDS = 16, 8
#: Columns that ``judged`` makes.
MADE = ("host", "path", "rule", "verdict", "possible", "listed")
#: Blocks up to which the filter is broadcast: about 20 MB.
MOST_BLOCKS = BROADCAST_ROWS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null for an empty host."""
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html$", "")
    return F.when(host != "", F.concat(host, path))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bit of each word."""
    h = F.xxhash64(url, F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """_block, w0 ... w7 of the distinct URLs in column ``listed``."""
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("listed")))]
    return listed.select(_block(F.col("listed"), blocks).alias("_block"), *words).groupBy("_block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, possible (the filter passed it) and listed. ``listed``: canonical URLs in the column of that name."""
    rows = pages.select(F.struct(*[c for c in pages.columns if c not in MADE]).alias("_row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict, "_url": canonical(F.col("host"), F.col("path"))})
    listed = listed.where("listed is not null").select("listed").distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    table = bloom(listed, blocks)
    asked = F.col("rule").isNull() & F.col("_url").isNotNull()
    probe = rows.where(asked).withColumn("_block", _block(F.col("_url"), blocks))
    spread = F.monotonically_increasing_id()
    probe = probe.join(F.broadcast(table), "_block", "left") if blocks <= MOST_BLOCKS else dealt_join(probe, table, "_block", spread, "left")
    every = F.lit(True)
    for i, b in enumerate(_bits(F.col("_url"))):
        every = every & (F.getbit(F.col(f"w{i}"), b) == 1)
    possible = F.coalesce(every, F.lit(False))
    hits = dealt_join(probe.where(possible), listed.select(F.col("listed").alias("_url"), F.lit(True).alias("_on")), "_url", spread, "left")

    def told(part: DataFrame, passed: bool, on: Column) -> DataFrame:
        last = F.coalesce("_verdict", F.when(on, "block").otherwise("allow"))
        return part.select("_row.*", "host", "path", "rule", last.alias("verdict"), F.lit(passed).alias("possible"), on.alias("listed"))

    no = F.lit(False)
    return told(rows.where(~asked), False, no).union(told(probe.where(~possible), False, no)).union(told(hits, True, F.coalesce("_on", no)))


def reported(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of every page whose id is divisible by 20."""
    return pages.where("page_id % 20 = 0").select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("listed"))


SQL = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
c as (
  select *, case when host != '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') end as url from p),
rules(h, pre, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
l as (select distinct url from c where page_id % 20 = 0 and url is not null)
select c.page_id, c.host, c.path,
  (select h || pre from rules where (c.host = h or ends_with(c.host, '.' || h)) and starts_with(c.path, pre) order by length(h || pre) desc limit 1) as rule,
  coalesce((select v from rules where (c.host = h or ends_with(c.host, '.' || h)) and starts_with(c.path, pre) order by length(h || pre) desc limit 1),
    case when c.url in (select url from l) then 'block' else 'allow' end) as verdict
from c
"""
