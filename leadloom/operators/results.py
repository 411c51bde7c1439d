"""Search-result fusion: filters, de-duplication, ranking and per-call statistics.

Grouping keys here (a URL, a provider, a query) may hold a large share of all rows, so every
step aggregates on the map side and none gathers a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import lexicons as lx, urls as U
from leadloom.functions.numbers import rounded_sum
from leadloom.operators.scoring import top_n

# "first" must not depend on the order in which calls came back
FIRST_ORDER = ["query", "provider", "rank", "href"]


def drop_junk(results: DataFrame, hosts: list[str] = lx.JUNK_HOSTS, href: str = "href"
              ) -> DataFrame:
    return results.filter(~U.host_in(F.col(href), hosts, mode="substring"))


def drop_skipped(results: DataFrame, domains: list[str] = lx.SKIP_DOMAINS, href: str = "href",
                 mode: str = "suffix") -> DataFrame:
    return results.filter(~U.host_in(F.col(href), domains, mode))


def restrict_domains(results: DataFrame, include: list[str] | None = None,
                     exclude: list[str] | None = None) -> DataFrame:
    out = results
    if include:
        out = out.filter(U.host_in(F.col("href"), include))
    if exclude:
        out = out.filter(~U.host_in(F.col("href"), exclude))
    return out


def _first(df: DataFrame, order: list[str]) -> Column:
    return F.min_by(F.struct(*df.columns), F.struct(*order))


def first_per_url(results: DataFrame, order: list[str] = FIRST_ORDER) -> DataFrame:
    """One result per normalised URL, the first by ``order``."""
    keyed = results.withColumn("norm_url", U.normalize_url("href"))
    return keyed.groupBy("norm_url").agg(_first(results, order).alias("r")).select(
        "norm_url", "r.*")


def merge_and_rank(results: DataFrame, order: list[str] = FIRST_ORDER) -> DataFrame:
    """One row per normalised URL: first result, distinct providers, mean rank, best first."""
    return _merged(results, order).orderBy(F.desc("providers"), "mean_rank", "norm_url")


def _merged(results: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    # per provider first: a URL reported a million times still reaches the second step as
    # one row per provider
    per_provider = results.withColumn("norm_url", U.normalize_url("href")).groupBy(
        *keys, "norm_url", "provider").agg(
        _first(results, order).alias("r"), F.sum("rank").alias("s"), F.count("*").alias("n"))
    sort_key = F.struct(*[F.col(f"r.{c}") for c in order])
    return per_provider.groupBy(*keys, "norm_url").agg(
        F.min_by("r", sort_key).alias("r"), F.count("*").alias("providers"),
        (F.sum("s") / F.sum("n")).alias("mean_rank"), F.sum("n").alias("hits"),
    ).select(*keys, "norm_url", *[F.col(f"r.{c}").alias(c) for c in results.columns
                                  if c not in keys],
             "providers", "mean_rank", "hits")


def cross_provider_hits(results: DataFrame, min_providers: int = 2) -> DataFrame:
    return _merged(results, FIRST_ORDER).filter(F.col("providers") >= min_providers)


def domain_frequency(results: DataFrame, *keys: str) -> DataFrame:
    return results.filter(F.col("domain") != "").groupBy(*keys, "domain").agg(
        F.count("*").alias("results"))


def provider_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, success share, total and extreme latency per provider."""
    return calls.groupBy(*keys, "provider").agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("succeeded"),
        F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"),
        rounded_sum("latency_ms", 1).alias("latency_ms"),
        F.sum("total_results").alias("results"),
    )


def session_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """Success rate (0.0 without calls), total latency, slowest and fastest provider."""
    lat = lambda desc: F.struct(  # noqa: E731 - ties go to the first name
        F.col("latency_ms") * (-1 if desc else 1), F.col("provider"))
    agg = [
        F.coalesce(F.round(F.avg(F.col("success").cast("int")), 4), F.lit(0.0))
        .alias("success_rate"),
        F.coalesce(rounded_sum("latency_ms", 1), F.lit(0.0)).alias("total_latency_ms"),
        F.min_by("provider", lat(True)).alias("slowest"),
        F.min_by("provider", lat(False)).alias("fastest"),
    ]
    return calls.groupBy(*keys).agg(*agg) if keys else calls.agg(*agg)


def results_by_provider(results: DataFrame, call: str) -> DataFrame:
    """Results of each provider's last call per query, laid out by provider.

    One row per result rather than one list per provider: a provider has no bounded size.
    """
    last = results.groupBy("query", "provider").agg(F.max(call).alias(call))
    return results.join(last, ["query", "provider", call], "left_semi")


def query_report(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Report per query as (query, section, item, value, detail) rows.

    Sections: session, provider, domain, result. Rows instead of nested lists, so a query
    with any number of results can be reported.
    """
    def rows(df: DataFrame, section: str, item: str, value: Column, detail: Column) -> DataFrame:
        return df.select(
            "query", F.lit(section).alias("section"), F.col(item).alias("item"),
            value.cast("double").alias("value"), detail.cast("string").alias("detail"))

    totals = session_totals(calls, "query").withColumn("item", F.lit("success_rate"))
    return (
        rows(totals, "session", "item", F.col("success_rate"), F.col("slowest"))
        .unionByName(rows(provider_summary(calls, "query"), "provider", "provider",
                          F.col("latency_ms"), F.col("calls")))
        .unionByName(rows(domain_frequency(results, "query"), "domain", "domain",
                          F.col("results"), F.lit(None)))
        .unionByName(rows(_merged(results, FIRST_ORDER, ("query",)), "result", "norm_url",
                          F.col("mean_rank"), F.col("providers")))
    )


def limit_per_call(results: DataFrame, call_keys: list[str], n: int) -> DataFrame:
    return top_n(results, call_keys, [F.asc("rank"), F.asc("href")], n)


def page_of(results: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The ``page``-th page (from 1) of an ordered result table."""
    return results.orderBy(*order).offset((page - 1) * size).limit(size)


def select_urls(urls: DataFrame, keys: list[str], max_urls: int,
                skip: list[str] = lx.SKIP_DOMAINS, prefer: list[str] = lx.PREFER_DOMAINS,
                mode: str = "suffix", url: str = "href") -> DataFrame:
    """Skip unwanted hosts, put preferred hosts first, keep ``max_urls`` per key.

    ``urls`` carries ``ordinal``, its order of discovery.
    """
    flagged = urls.filter(~U.host_in(F.col(url), skip, mode)).withColumn(
        "is_preferred", U.host_in(F.col(url), prefer, mode))
    return top_n(flagged, keys, [F.desc("is_preferred"), F.asc("ordinal"), F.asc(url)], max_urls,
                 "position")
