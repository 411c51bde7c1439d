"""Crawl planning over the pages' URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import lexicons as lx
from leadloom.operators import crawl as C
from leadloom.plans.inputs import as_of, sql_list, table, with_ctes
from leadloom.plans.registry import query

# cached copies: every page once, those of a scheme a second time and earlier
_SQL_CACHE = """cache AS (
  SELECT url, page_id AS version,
    TIMESTAMP '2024-07-01' - INTERVAL 1 HOUR * (page_id % 48) AS stored_at FROM pages
  UNION ALL SELECT url, -page_id, TIMESTAMP '2024-06-20' FROM pages
  WHERE starts_with(url, 'https'))"""


def _cache(spark, d) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    n = F.col("page_id")
    recent = p.select("url", n.alias("version"), (
        as_of() - F.make_dt_interval(hours=(n % 48).cast("int"))).alias("stored_at"))
    old = p.filter(F.col("url").startswith("https")).select(
        "url", (-n).alias("version"), (as_of() - F.make_dt_interval(days=F.lit(11)))
        .alias("stored_at"))
    return recent.unionByName(old)


_FRESH = "stored_at + INTERVAL 1 DAY >= TIMESTAMP '2024-07-01'"


@query("w14_latest_fresh", with_ctes(_SQL_CACHE, select=f"""
SELECT url, max_by(version, stored_at) AS version FROM cache WHERE {_FRESH} GROUP BY url"""))
def latest(spark, d):
    newest = C.latest(_cache(spark, d))
    return newest.filter(C.is_fresh(F.col("stored_at"), as_of(), C.CRAWL_TTL_SECONDS)).select(
        "url", "version")


@query("j03_cache_hits", with_ctes(_SQL_CACHE, select=f"""
SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM cache WHERE {_FRESH})"""))
def hits(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    return C.cache_hits(urls, _cache(spark, d), as_of())


@query("j04_cache_misses", with_ctes(_SQL_CACHE, select=f"""
SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM cache WHERE {_FRESH})"""))
def misses(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    return C.cache_misses(urls, _cache(spark, d), as_of())


@query("j15_unprocessed_urls", """
SELECT session_id, url FROM (SELECT 's' || (page_id % 5) AS session_id, url FROM pages
  UNION ALL SELECT 's' || (page_id % 3), url FROM pages)
EXCEPT ALL SELECT DISTINCT 's' || (page_id % 3), url FROM pages WHERE page_id % 3 <> page_id % 5
EXCEPT ALL SELECT 's' || (page_id % 3), url FROM (SELECT page_id, url FROM pages
  UNION ALL SELECT page_id, url FROM pages) WHERE page_id % 3 = page_id % 5""")
def unprocessed(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    session = lambda m: F.concat(F.lit("s"), F.col("page_id") % m).alias("session_id")
    asked = p.select(session(5), "url").unionByName(p.select(session(3), "url"))
    return C.unprocessed(asked, p.select(session(3), "url"))


def _sql_expand(n: int) -> str:
    return f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, url) AS k,
    first_value(url) OVER (PARTITION BY host ORDER BY page_id, url) AS first_url
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)),
filled AS (SELECT *, list_filter(list_transform({sql_list(lx.SIGNAL_PATHS)},
    lambda p: 'https://' || host || p), lambda c: c <> first_url)[1:{n - 1}] AS fill FROM ranked),
placed AS (
  SELECT page_id AS ordinal, k + CASE WHEN k = 1 THEN 0 ELSE len(fill) END AS slot, url,
    false AS injected FROM filled
  UNION ALL SELECT page_id, 1 + i, fill[i], true FROM filled, range(1, {n}) t(i)
  WHERE k = 1 AND i <= len(fill))
SELECT ordinal, CAST(slot AS INTEGER) AS slot, url, injected FROM placed WHERE slot <= {n}"""


def _expand(name: str, n: int) -> None:
    @query(name, _sql_expand(n))
    def run(spark, d):
        urls = table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), "url")
        return C.expand_domains(urls, n)


_expand("w05_expand_domains", 3)
_expand("w05_expand_domains_wide", 8)
