"""URL verdicts: host and path rules, then a list of canonical URLs.

The list can be large. It is folded into a blocked Bloom filter: ``blocks`` words
of 64 bits, where a URL sets four bits of one word. The filter has a fixed number
of rows, so broadcasting it is bounded whatever the list holds; a page whose bits
are not all set is surely not listed and never shuffled. Possible hits go to an
exact hash join with the list, which removes false positives. A very common URL
among the hits is a skewed key of that join, which adaptive execution splits.

A null URL has an empty host and path, fits no rule and is allowed. Every row gets
a verdict, repeated ones too; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the registered query, (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name a page.
TRACKING = r"(?:utm_[^=&]*|ref)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without ending slashes, and query without tracking parameters."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}", ""), "^&", "")
    page = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(query == "", page).otherwise(F.concat(page, F.lit("?"), query))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, name in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        own_host, slash, own_path = name.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The word of a key and the bits it sets there."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for k in range(4):
        place = F.shiftrightunsigned(h, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return h.bitwiseAND(F.lit(blocks - 1)), mask


def blocked_bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``block`` and ``word`` for the non-empty words; ``blocks`` is a power of two and bounds the rows."""
    block, mask = _bits(F.col("listed_url"), blocks)
    return listed.groupBy(block.alias("block")).agg(F.bit_or(mask).alias("word"))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    blocks: int = BLOCKS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Host, path, rule and verdict of every page. ``listed`` has the URLs to block in its column ``url``."""
    urls = (
        listed.select(canonical(F.col("url").cast("string")).alias("listed_url"))
        .where(F.col("listed_url").isNotNull())
        .distinct()
    )
    url = F.col("url_text")
    seen = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url_text"))
    seen = seen.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("page_url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    block, mask = _bits(F.col("page_url"), blocks)
    seen = (
        seen.withColumn("rule", rule)
        .withColumn("said", verdict)
        .withColumn("block", F.when(F.col("rule").isNull(), block))
        .withColumn("mask", mask)
        .join(F.broadcast(blocked_bloom(urls, blocks)), "block", "left")
        .withColumn("possible", F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    )
    columns = [id_col, "host", "path", "rule"]
    clear = seen.where(~F.col("possible")).select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict"))
    hits = seen.where("possible").join(urls, F.col("page_url") == F.col("listed_url"), "left")
    hits = hits.select(*columns, F.when(F.col("listed_url").isNull(), "allow").otherwise("block").alias("verdict"))
    return clear.unionByName(hits)


#: Fixed value: host labels whose pages make up the list of the registered query.
LISTED_HOSTS = r"(^|[.-])(spam|casino|pills|adult|xxx|warez|torrent)([.-]|$)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(host_of(F.col("url")).rlike(LISTED_HOSTS))
    return judge(pages, listed)


def _rules_sql(what: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[1])):
        own_host, slash, own_path = rule[1].partition("/")
        cases.append(
            f"when (host = '{own_host}' or ends_with(host, '.{own_host}')) and starts_with(path, '{slash + own_path}')"
            f" then '{rule[what]}'"
        )
    return f"case {' '.join(cases)} end"


ORACLE = rf"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path,
         regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '(^|&){TRACKING}', '', 'g'), '^&', '') q
  from pages),
c as (select *, host || regexp_replace(path, '/+$', '') || case when q = '' then '' else '?' || q end page_url,
             {_rules_sql(1)} rule, {_rules_sql(0)} said from u)
select page_id, host, path, rule,
       coalesce(said, case when page_url in (select page_url from c where regexp_matches(host, '{LISTED_HOSTS}') and page_url is not null)
                           then 'block' else 'allow' end) verdict
from c
"""
