"""Crawl planning: cache split, freshness, per-domain expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.functions import lexicons as lx, urls as U
from leadloom.operators.scoring import top_n

CRAWL_TTL_SECONDS = 86_400
LEAD_TTL_SECONDS = 7 * 86_400


def latest(entries: DataFrame, key: str = "url", at: str = "stored_at") -> DataFrame:
    """Newest entry per key."""
    rest = [c for c in entries.columns if c != key]
    tie = [F.col(at)] + [F.col(c) for c in rest if c != at]
    return entries.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*tie)).alias("e")).select(key, "e.*")


def is_fresh(at: Column, now: Column, ttl_seconds: int) -> Column:
    return now <= at + F.make_dt_interval(secs=F.lit(ttl_seconds))


def cache_hits(urls: DataFrame, cache: DataFrame, now: Column, ttl: int = CRAWL_TTL_SECONDS,
               at: str = "stored_at") -> DataFrame:
    """URLs that a fresh cached page serves."""
    fresh = cache.filter(is_fresh(F.col(at), now, ttl)).select("url").distinct()
    return urls.join(fresh, "url", "left_semi")


def cache_misses(urls: DataFrame, cache: DataFrame, now: Column, ttl: int = CRAWL_TTL_SECONDS,
                 at: str = "stored_at") -> DataFrame:
    """URLs that must be fetched."""
    fresh = cache.filter(is_fresh(F.col(at), now, ttl)).select("url").distinct()
    return urls.join(fresh, "url", "left_anti")


def unprocessed(urls: DataFrame, processed: DataFrame) -> DataFrame:
    """URLs a session has not handled yet."""
    return urls.join(processed.select("session_id", "url").distinct(), ["session_id", "url"], "left_anti")


def expand_domains(urls: DataFrame, per_domain: int, paths: list[str] = lx.SIGNAL_PATHS,
                   max_urls: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """At most ``per_domain`` URLs per host, filled up with the host's signal pages.

    A host's list is its first URL, then the signal pages other than that URL, then its
    further URLs; the whole keeps the order of ``ordinal``. Only the first ``per_domain``
    URLs of a host can appear, so a hot host is cut before anything is sorted.
    """
    host = U.authority("url")
    by = [*keys, "host"]
    ranked = top_n(urls.withColumn("host", host), by, [F.asc("ordinal"), F.asc("url")],
                   per_domain, "k")
    base = F.concat(F.lit("https://"), "host")
    # joining a path with a host-only base; a relative path would resolve below the root
    candidates = F.transform(
        F.lit(paths),
        lambda p: F.concat(base, F.when(p.startswith("/"), p).otherwise(
            F.concat(F.lit("/"), p))))
    first_url = F.first("url").over(W.partitionBy(*by).orderBy("k"))
    listed = ranked.withColumn("fill", F.slice(
        F.array_except(candidates, F.array(first_url)), 1, max(per_domain - 1, 1))
        if per_domain > 1 else F.array().cast("array<string>"))
    placed = listed.select(
        *keys, "ordinal", "host",
        F.posexplode(F.when(F.col("k") == 1, F.concat(F.array("url"), "fill"))
                     .otherwise(F.array("url"))).alias("i", "url"),
        "k", F.size("fill").alias("n_fill"))
    out = placed.withColumn("slot", F.when(F.col("k") == 1, F.col("i") + 1).otherwise(
        F.col("k") + F.col("n_fill"))).filter(F.col("slot") <= per_domain).withColumn(
        "injected", F.col("i") > 0).select(*keys, "ordinal", "slot", "url", "injected")
    if max_urls is None:
        return out
    order = [F.asc("ordinal"), F.asc("slot"), F.asc("url")]
    return top_n(out, list(keys), order, max_urls) if keys else \
        out.orderBy(*order).limit(max_urls)
