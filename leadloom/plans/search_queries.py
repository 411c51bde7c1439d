"""Payload normalisers and search-result fusion over calls derived from pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import urls as U
from leadloom.operators import results as R
from leadloom.plans.inputs import (
    SQL_K, SQL_RESULTS, event_k, search_results, sql_domain, sql_list, sql_normalize, table,
    with_ctes,
)
from leadloom.plans.registry import query
from leadloom.sources import payloads as PL

# -- payloads: each page gives one landed call with a few items ----------------------


def _calls(spark, d, provider: str, body, search_type="web", max_results: int = 10,
           as_text: bool = False) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select(
        "page_id", F.lit(provider).alias("provider"),
        F.concat(F.lit("q"), F.col("page_id") % 7).alias("query"),
        (search_type if not isinstance(search_type, str) else F.lit(search_type))
        .alias("search_type"),
        F.lit(max_results).alias("max_results"),
        (body if as_text else F.to_json(body)).alias("payload"))


_KIND = lambda: F.when(F.col("page_id") % 4 == 0, "news").otherwise("web")
_SQL_KIND = "CASE WHEN page_id % 4 = 0 THEN 'news' ELSE 'web' END"


def _item(**fields):
    return F.struct(*[
        (v if not isinstance(v, (str, int, float)) else F.lit(v)).alias(k)
        for k, v in fields.items()])


def _t(prefix: str):
    return F.concat(F.lit(prefix), F.col("page_id"))


def _core(df: DataFrame, *meta) -> DataFrame:
    return df.select("page_id", "title", "href", "body", "domain", "rank", "search_type", *meta)


def _sql_from(t: str, h: str, b: str, r: str, rest: str, where: str = "true") -> str:
    return (f"SELECT page_id, {t} AS title, {h} AS href, {b} AS body, {sql_domain(h)} AS domain,"
            f" CAST({r} AS INTEGER) AS rank, {rest} FROM pages WHERE {where}")


_JUNK = "https://www.youtube.com/watch"


@query("s02_build_results", """
SELECT page_id, trim(' R' || page_id || ' ') AS title, url AS href, 'b' AS body, """
       + sql_domain("url") + """ AS domain, CAST(page_id % 10 + 1 AS INTEGER) AS rank FROM pages""")
def build(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", "url", F.lit("x").alias("provider"), F.lit("q").alias("query"),
        F.lit("web").alias("search_type"))
    return PL.build_results(
        p, F.concat(F.lit(" R"), "page_id", F.lit(" \n")), F.col("url"), F.lit("\tb "),
        F.col("page_id") % 10 + 1, keep=["page_id"]).select(
        "page_id", "title", "href", "body", "domain", "rank")


@query("s03_serper", _sql_from(
    "'A' || page_id", "url", "'s1'", "7", f"{_SQL_KIND} AS search_type, '2024-01-01' AS "
    "published_date, 'L' || page_id || '=' || url AS links, 'rel' AS related, '99' AS total")
    + "\nUNION ALL " + _sql_from(
    "'B' || page_id", "url || '/b'", "''", "2", f"{_SQL_KIND}, '', '', 'rel', '99'"))
def serper(spark, d):
    items = F.array(
        _item(title=_t(" A"), link=F.col("url"), snippet="s1 ", position=7, date="2024-01-01",
              sitelinks=F.array(_item(title=_t("L"), link=F.col("url")))),
        _item(title="junk", link=_JUNK, snippet="", position=1, date="",
              sitelinks=F.array(_item(title="", link="")).cast(
                  "array<struct<title:string,link:string>>")),
        _item(title=_t("B"), link=F.concat("url", F.lit("/b")),
              snippet=F.lit(None).cast("string"), position=F.lit(None).cast("int"),
              date=F.lit(None).cast("string"),
              sitelinks=F.lit(None).cast("array<struct<title:string,link:string>>")))
    other = F.lit(None).cast(items_type(spark, d, items))
    body = F.struct(
        F.when(_KIND() == "news", other).otherwise(items).alias("organic"),
        F.when(_KIND() == "news", items).otherwise(other).alias("news"),
        _item(totalResults="99").alias("searchInformation"),
        F.array(_item(query="rel")).alias("relatedSearches"))
    out = PL.normalize_payloads(_calls(spark, d, "serper", body, _KIND()), "serper", ["page_id"])
    m = F.col("metadata")
    return _core(
        out, m["published_date"].alias("published_date"),
        F.array_join(F.transform(m["site_links"], lambda s: F.concat(
            s["title"], F.lit("="), s["href"])), ";").alias("links"),
        F.array_join(m["related_searches"], ",").alias("related"),
        m["total_results"].alias("total"))


def items_type(spark, d, col):
    return table(spark, d, "pages").select(col.alias("c")).schema["c"].dataType


@query("s04_tavily", _sql_from(
    "'T' || page_id", "url", "'c'", "2", "'web' AS search_type, 0.5::DOUBLE AS score, "
    "'raw' || page_id AS raw"))
def tavily(spark, d):
    body = F.struct(F.array(
        _item(title="junk", url=_JUNK, content="x", score=0.1, raw_content=""),
        _item(title=_t("T"), url=F.col("url"), content="c", score=0.5, raw_content=_t("raw")),
    ).alias("results"))
    out = PL.normalize_payloads(_calls(spark, d, "tavily", body), "tavily", ["page_id"])
    m = F.col("metadata")
    return _core(out, m["score"].alias("score"), m["raw_content"].alias("raw"))


@query("s05_google", _sql_from(
    "'G' || page_id", "url", "'s'", "2", "'web' AS search_type, 'http://i/' || page_id AS image, "
    "'1,000' AS total") + "\nUNION ALL " + _sql_from(
    "'H' || page_id", "url || '/2'", "'s'", "3", "'web', '', '1,000'"))
def google(spark, d):
    pm = F.to_json(F.struct(F.array(_item(src=_t("http://i/"))).alias("cse_image")))
    # the third kept item is over the cap of two
    body = F.concat(
        F.lit('{"searchInformation":{"formattedTotalResults":"1,000"},"items":['),
        F.to_json(_item(title="junk", link=_JUNK, snippet="s")), F.lit(","),
        F.concat(F.lit('{"title":"G'), "page_id", F.lit('","snippet":"s","link":"'), "url",
                 F.lit('","pagemap":'), pm, F.lit("}")), F.lit(","),
        F.to_json(_item(title=_t("H"), link=F.concat("url", F.lit("/2")), snippet="s")),
        F.lit(","), F.to_json(_item(title="over", link="http://o", snippet="s")), F.lit("]}"))
    out = PL.normalize_payloads(
        _calls(spark, d, "google", body, max_results=2, as_text=True), "google", ["page_id"])
    m = F.col("metadata")
    return _core(out, m["image_url"].alias("image"), m["total_results"].alias("total"))


@query("s06_bing", _sql_from(
    "'N' || page_id", "url", "CASE WHEN page_id % 4 = 0 THEN 'desc' ELSE 'snip' END", "1",
    f"{_SQL_KIND} AS search_type, CASE WHEN page_id % 4 = 0 THEN '2024-02-02' ELSE '2024-03-03' "
    "END AS published_date, CASE WHEN page_id % 4 = 0 THEN '' ELSE '12' END AS total"))
def bing(spark, d):
    web = F.array(_item(name=_t("N"), url=F.col("url"), snippet="snip",
                        dateLastCrawled="2024-03-03", datePublished="2024-02-02"))
    news = F.array(_item(name=_t("N"), url=F.col("url"), description="desc", dateLastCrawled="",
                         datePublished="2024-02-02"))
    body = F.struct(
        F.when(_KIND() == "web", F.struct(web.alias("value"), F.lit(12).alias(
            "totalEstimatedMatches"))).alias("webPages"),
        F.when(_KIND() == "news", news).alias("value"))
    out = PL.normalize_payloads(_calls(spark, d, "bing", body, _KIND()), "bing", ["page_id"])
    m = F.col("metadata")
    return _core(out, m["published_date"].alias("published_date"),
                 m["total_results"].alias("total"))


@query("s07_searchapi", _sql_from(
    "'S' || page_id", "url", "'x'", "1", "'web' AS search_type, 'D' AS link"))
def searchapi(spark, d):
    body = F.struct(F.array(
        _item(title="junk", link=_JUNK, snippet="x", displayed_link="J"),
        _item(title=_t("S"), link=F.col("url"), snippet="x", displayed_link="D"),
        _item(title="over", link="http://o", snippet="x", displayed_link="O"),
    ).alias("organic_results"))
    out = PL.normalize_payloads(
        _calls(spark, d, "searchapi", body, max_results=1), "searchapi", ["page_id"])
    return _core(out, F.col("metadata.displayed_link").alias("link"))


# pages with a fragment have no detail record, those with a query only a bare one
_CASE = "CASE WHEN contains(url, '#') THEN 'none' WHEN contains(url, '?') THEN 'bare' ELSE 'full' END"
_GH = f"""SELECT page_id, CASE kind WHEN 'full' THEN 'Org ' || page_id ELSE 'org' || page_id
  END AS title, CASE kind WHEN 'full' THEN 'https://blog' || page_id || '.io'
  WHEN 'bare' THEN 'https://github.com/detail/org' || page_id
  ELSE 'https://github.com/org' || page_id END AS href,
  CASE kind WHEN 'bare' THEN 'bio' ELSE '' END AS body,
  CASE kind WHEN 'full' THEN '5' ELSE '0' END AS repos
FROM (SELECT page_id, {_CASE} AS kind FROM pages)"""


def _github(spark, d):
    body = F.struct(F.array(F.struct(_t("org").alias("login"))).alias("items"))
    p = table(spark, d, "pages").select("page_id", F.expr(_CASE).alias("kind"))
    full, none = F.col("kind") == "full", F.lit(None)
    details = p.filter("kind <> 'none'").select(
        _t("org").alias("login"), F.when(full, _t("Org ")).alias("name"),
        F.when(full, F.concat(F.lit("blog"), "page_id", F.lit(".io"))).alias("blog"),
        F.concat(F.lit("https://github.com/detail/org"), "page_id").alias("html_url"),
        none.cast("string").alias("description"), F.when(~full, "bio").alias("bio"),
        none.cast("string").alias("location"), F.when(full, 5).alias("public_repos"),
        none.cast("int").alias("followers"), none.cast("string").alias("created_at"))
    out = PL.normalize_github(_calls(spark, d, "github", body), details, ["page_id"])
    return out.select("page_id", "title", "href", "body",
                      F.col("metadata.attributes")["public_repos"].alias("repos"))


query("s08_github", _GH)(_github)
query("j16_items_with_details", _GH)(_github)


@query("s09_crunchbase", _sql_from(
    "'C' || page_id", "CASE WHEN page_id % 2 = 0 THEN url ELSE "
    "'https://www.crunchbase.com/organization/c' || page_id END", "'short'", "1",
    "'web' AS search_type, 'Paris' AS location"))
def crunchbase(spark, d):
    site = F.when(F.col("page_id") % 2 == 0, F.struct(F.col("url").alias("value")))
    one = F.struct(F.struct(
        _item(permalink=_t("c"), value=_t("C")).alias("identifier"),
        F.lit("short").alias("short_description"), site.alias("website"),
        F.array(_item(value="Paris"), _item(value="Rome")).alias("location_identifiers"),
    ).alias("properties"))
    none = F.struct(F.struct(
        _item(permalink="", value="nobody").alias("identifier"),
        F.lit("short").alias("short_description"),
        F.lit(None).cast("struct<value:string>").alias("website"),
        F.lit(None).cast("array<struct<value:string>>").alias("location_identifiers"),
    ).alias("properties"))
    out = PL.normalize_payloads(
        _calls(spark, d, "crunchbase", F.struct(F.array(one, none).alias("entities"))),
        "crunchbase", ["page_id"])
    return _core(out, F.col("metadata.attributes")["location"].alias("location"))


@query("s10_producthunt", _sql_from(
    "'P' || page_id", "url", "'tag'", "2", "'web' AS search_type, CAST(page_id AS VARCHAR) "
    "AS votes"))
def producthunt(spark, d):
    node = lambda **f: F.struct(_item(**f).alias("node"))
    edges = F.array(
        node(name="none", tagline="x", website="", votesCount=F.col("page_id").cast("int")),
        node(name=_t("P"), tagline="tag", website=F.col("url"),
             votesCount=F.col("page_id").cast("int")))
    body = F.struct(F.struct(F.struct(edges.alias("edges")).alias("posts")).alias("data"))
    out = PL.normalize_payloads(_calls(spark, d, "producthunt", body), "producthunt", ["page_id"])
    return _core(out, F.col("metadata.attributes")["votes"].alias("votes"))


@query("s11_wellfound", _sql_from(
    "'W' || page_id", "'https://wellfound.com/company/' || page_id", "'w'", "2",
    "'web' AS search_type"))
def wellfound(spark, d):
    body = F.struct(F.array(
        _item(title="other", link=F.col("url"), snippet="w"),
        _item(title=_t("W"), link=_t("https://wellfound.com/company/"), snippet="w"),
    ).alias("organic"))
    return _core(PL.normalize_payloads(
        _calls(spark, d, "wellfound", body), "wellfound", ["page_id"]))


_TWO = ("https://m.youtube.com/", "https://netflix.com/", "https://sub.x.com:80/")
_SQL_LINKS = """SELECT page_id, url AS href FROM pages
  UNION ALL SELECT page_id, 'https://m.youtube.com/' || page_id FROM pages
  UNION ALL SELECT page_id, 'https://netflix.com/' || page_id FROM pages
  UNION ALL SELECT page_id, 'https://sub.x.com:80/' || page_id FROM pages"""


def _links(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", F.explode(F.array(
        "url", *[F.concat(F.lit(u), "page_id") for u in _TWO])).alias("href"))


@query("p01_junk_urls", f"""
SELECT page_id, href FROM ({_SQL_LINKS}) WHERE NOT contains(href, 'youtube.com')""")
def junk(spark, d):
    return R.drop_junk(_links(spark, d))


_SQL_HOST = "lower(split_part(regexp_extract(href, '^[a-z]+://([^/?#]*)', 1), ':', 1))"


@query("p02_skip_domains", f"""
SELECT l.page_id, l.href, len(list_filter({sql_list(R.lx.SKIP_DOMAINS)}, lambda s:
    contains(href, s))) = 0 AS also_by_substring
FROM ({_SQL_LINKS}) AS l WHERE len(list_filter({sql_list(R.lx.SKIP_DOMAINS)},
  lambda s: {_SQL_HOST} = s OR ends_with({_SQL_HOST}, '.' || s))) = 0""")
def skipped(spark, d):
    kept = R.drop_skipped(_links(spark, d))
    return kept.withColumn("also_by_substring", ~U.host_in(
        F.col("href"), R.lx.SKIP_DOMAINS, "substring"))


@query("p03_include_exclude", f"""
SELECT page_id, href FROM ({_SQL_LINKS}) WHERE (ends_with({_SQL_HOST}, '.example.com')
  OR {_SQL_HOST} = 'example.com') AND NOT ends_with({_SQL_HOST}, '.tionsh.example.com')
  AND {_SQL_HOST} <> 'tionsh.example.com'""")
def include_exclude(spark, d):
    return R.restrict_domains(_links(spark, d), ["example.com"], ["tionsh.example.com"])


# -- fusion -------------------------------------------------------------------------

_KEYED = f"keyed AS (SELECT *, {sql_normalize('href')} AS norm_url FROM results)"
_FIRSTS = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_url
  ORDER BY query, provider, rank, href) AS rn FROM keyed) WHERE rn = 1)"""


@query("w01_first_result_per_url", with_ctes(SQL_RESULTS, _KEYED, _FIRSTS, select="""
SELECT norm_url, page_id, href, provider, query, rank FROM firsts"""))
def first_per_url(spark, d):
    return R.first_per_url(search_results(spark, d)).select(
        "norm_url", "page_id", "href", "provider", "query", "rank")


@query("j01_page_with_result", with_ctes(SQL_RESULTS, _KEYED, _FIRSTS, select="""
SELECT p.page_id, f.provider, f.query, f.rank FROM pages p JOIN firsts f ON p.url = f.href"""))
def page_with_result(spark, d):
    first = R.first_per_url(search_results(spark, d)).select(
        F.col("href").alias("url"), "provider", "query", "rank")
    return table(spark, d, "pages").select("page_id", "url").join(first, "url").drop("url")


_MERGED = """merged AS (SELECT norm_url, count(DISTINCT provider) AS providers,
  round(avg(rank), 4) AS mean_rank, min_by(href, {'q': query, 'p': provider, 'r': rank, 'h': href})
    AS href FROM keyed GROUP BY norm_url)"""


@query("a02_merge_and_rank", with_ctes(SQL_RESULTS, _KEYED, _MERGED, select="""
SELECT norm_url, href, providers, mean_rank FROM merged"""))
def merge_and_rank(spark, d):
    return R.merge_and_rank(search_results(spark, d)).select(
        "norm_url", "href", "providers", F.round("mean_rank", 4).alias("mean_rank"))


@query("a03_cross_provider_hits", with_ctes(SQL_RESULTS, _KEYED, _MERGED, select="""
SELECT norm_url, href FROM merged WHERE providers >= 2"""))
def cross_hits(spark, d):
    return R.cross_provider_hits(search_results(spark, d)).select("norm_url", "href")


@query("a01_domain_frequency", with_ctes(SQL_RESULTS, select="""
SELECT domain, count(*) AS results FROM results WHERE domain <> '' GROUP BY domain"""))
def domain_frequency(spark, d):
    return R.domain_frequency(search_results(spark, d)).orderBy(F.desc("results"), "domain")


_SQL_CALLS = f"""calls AS (SELECT event_id, 'q' || user_id AS query, event_type AS provider,
  value AS latency_ms, value >= 50 AS success, {SQL_K} AS total_results FROM events)"""


def _provider_calls(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("q"), "user_id").alias("query"),
        F.col("event_type").alias("provider"), F.col("value").alias("latency_ms"),
        (F.col("value") >= 50).alias("success"), event_k().alias("total_results"))


_SUMMARY = """count(*) AS calls, count(*) FILTER (success) AS succeeded,
  round(avg(CAST(success AS INTEGER)), 4) AS success_rate,
  CAST(round(sum(CAST(latency_ms AS DECIMAL(18, 6))), 1) AS DOUBLE) AS latency_ms, CAST(sum(total_results) AS BIGINT) AS results"""


@query("a04_provider_summary", with_ctes(_SQL_CALLS, select=f"""
SELECT provider, {_SUMMARY} FROM calls GROUP BY provider"""))
def provider_summary(spark, d):
    return R.provider_summary(_provider_calls(spark, d))


_SQL_TOTALS = """SELECT query, round(avg(CAST(success AS INTEGER)), 4) AS success_rate,
  CAST(round(sum(CAST(latency_ms AS DECIMAL(18, 6))), 1) AS DOUBLE) AS total_latency_ms,
  min_by(provider, {'l': -latency_ms, 'p': provider}) AS slowest,
  min_by(provider, {'l': latency_ms, 'p': provider}) AS fastest FROM calls GROUP BY query"""


@query("a05_slowest_fastest", with_ctes(_SQL_CALLS, select=_SQL_TOTALS))
def slow_fast(spark, d):
    return R.session_totals(_provider_calls(spark, d), "query")


@query("a06_results_by_provider", with_ctes(SQL_RESULTS, select="""
SELECT provider, query, search_type, rank, href FROM (SELECT *, max(search_type) OVER (
  PARTITION BY query, provider) AS last FROM results) WHERE search_type = last"""))
def by_provider(spark, d):
    return R.results_by_provider(search_results(spark, d), "search_type").select(
        "provider", "query", "search_type", "rank", "href")


@query("a22_query_report", with_ctes(SQL_RESULTS, _KEYED, _SQL_CALLS, select=f"""
SELECT query, 'session' AS section, 'success_rate' AS item, success_rate AS value,
  slowest AS detail FROM ({_SQL_TOTALS})
UNION ALL SELECT query, 'provider', provider, latency_ms, CAST(calls AS VARCHAR)
  FROM (SELECT query, provider, {_SUMMARY} FROM calls GROUP BY query, provider)
UNION ALL SELECT query, 'domain', domain, CAST(count(*) AS DOUBLE), NULL FROM results
  WHERE domain <> '' GROUP BY query, domain
UNION ALL SELECT query, 'result', norm_url, round(avg(rank), 4),
  CAST(count(DISTINCT provider) AS VARCHAR) FROM keyed GROUP BY query, norm_url"""))
def report(spark, d):
    r = R.query_report(search_results(spark, d), _provider_calls(spark, d))
    return r.withColumn("value", F.round("value", 4))


@query("w02_position_rank", with_ctes(SQL_RESULTS, select="""
SELECT page_id, CAST(1 AS INTEGER) AS rank, url AS href FROM pages
UNION ALL SELECT page_id, 2, url || '#2' FROM pages
UNION ALL SELECT page_id, 3, url || '#3' FROM pages"""))
def position(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(F.array(
        "url", F.concat("url", F.lit("#2")), F.concat("url", F.lit("#3")))).alias("i", "href"))
    return p.select("page_id", (F.col("i") + 1).alias("rank"), "href")


_SELECT_CTE = """candidates AS (SELECT query, page_id AS ordinal,
  CASE WHEN page_id % 11 = 0 THEN 'https://www.crunchbase.com/' || page_id
    WHEN page_id % 13 = 0 THEN 'https://x.com/' || page_id ELSE href END AS href
  FROM firsts)"""


def _candidates(spark, d):
    n = F.col("page_id")
    return R.first_per_url(search_results(spark, d)).select(
        "query", n.alias("ordinal"),
        F.when(n % 11 == 0, F.concat(F.lit("https://www.crunchbase.com/"), n))
        .when(n % 13 == 0, F.concat(F.lit("https://x.com/"), n))
        .otherwise(F.col("href")).alias("href"))


@query("w06_preferred_first", with_ctes(SQL_RESULTS, _KEYED, _FIRSTS, _SELECT_CTE, select=f"""
SELECT query, href, position FROM (SELECT query, href, CAST(row_number() OVER (PARTITION BY query
  ORDER BY is_pref DESC, ordinal, href) AS INTEGER) AS position FROM (SELECT query, href, ordinal,
    len(list_filter({sql_list(R.lx.PREFER_DOMAINS)}, lambda s: {_SQL_HOST} = s
      OR ends_with({_SQL_HOST}, '.' || s))) > 0 AS is_pref FROM candidates
  WHERE len(list_filter({sql_list(R.lx.SKIP_DOMAINS)}, lambda s: {_SQL_HOST} = s
      OR ends_with({_SQL_HOST}, '.' || s))) = 0)) WHERE position <= 50"""))
def preferred_first(spark, d):
    return R.select_urls(_candidates(spark, d), ["query"], 50).select(
        "query", "href", "position")


@query("u01_union_of_results", with_ctes(SQL_RESULTS, select="""
SELECT provider, query, count(*) AS n, count(DISTINCT href) AS links FROM results
GROUP BY provider, query"""))
def union_all(spark, d):
    # distinct links of a (provider, query) pair are counted in two steps, not gathered
    return search_results(spark, d).groupBy("provider", "query", "href").agg(
        F.count("*").alias("c")).groupBy("provider", "query").agg(
        F.sum("c").alias("n"), F.count("*").alias("links"))


@query("u02_ordered_difference", with_ctes(SQL_RESULTS, _KEYED, _FIRSTS, _SELECT_CTE, select=f"""
SELECT query, ordinal, href FROM candidates
WHERE NOT {_SQL_HOST} IN ('crunchbase.com', 'www.crunchbase.com')"""))
def difference(spark, d):
    c = _candidates(spark, d)
    preferred = c.filter(U.host_in(F.col("href"), R.lx.PREFER_DOMAINS)).select("query", "href")
    return c.join(preferred, ["query", "href"], "left_anti").orderBy("query", "ordinal")


@query("t05_limit_per_call", with_ctes(SQL_RESULTS, select="""
SELECT provider, query, href, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY provider, query ORDER BY rank, href) AS rn FROM results) WHERE rn <= 10"""))
def limit_per_call(spark, d):
    return R.limit_per_call(search_results(spark, d), ["provider", "query"], 10).select(
        "provider", "query", "href", "rank")


@query("t07_pagination", with_ctes(SQL_RESULTS, select="""
SELECT href, provider, rank FROM results ORDER BY rank, href, provider LIMIT 10 OFFSET 20"""))
def pagination(spark, d):
    return R.page_of(search_results(spark, d).select("href", "provider", "rank"),
                     [F.asc("rank"), F.asc("href"), F.asc("provider")], 3, 10)
