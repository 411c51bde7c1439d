"""Landed API responses (one JSON text per call) to one search-result schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import schemas
from leadloom.functions import lexicons as lx, text as X, urls as U

_META = {f.name: f.dataType for f in schemas.SEARCH_METADATA.fields}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(*cs: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def is_junk(url: Column, hosts: list[str] = lx.JUNK_HOSTS) -> Column:
    return X.any_keyword(url, hosts)


@dataclass(frozen=True)
class Provider:
    """How one provider's response maps to search results.

    ``items`` picks the result array from the parsed response, the other functions take one
    item. ``rank`` is ``position`` (the item's own, else a running number over kept items) or
    ``index`` (place in the response, dropped items counted).
    """

    schema: str
    items: Callable[[Column, Column], Column]
    title: Callable[[Column], Column]
    href: Callable[[Column], Column]
    body: Callable[[Column], Column]
    keep: Callable[[Column], Column] = lambda href: ~is_junk(href)
    rank: str = "index"
    capped: bool = False
    metadata: Callable[[Column, Column], dict[str, Column]] = field(
        default=lambda response, item: {})


PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def get_provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}, choose one of {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def build_results(df: DataFrame, title: Column, href: Column, body: Column, rank: Column,
                  metadata: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Core fields of a result: stripped texts, domain from the link, UTC fetch time."""
    fetched = F.coalesce(F.col("fetched_at"), F.current_timestamp()) \
        if "fetched_at" in df.columns else F.current_timestamp()
    return df.select(
        *(keep or []),
        X.strip(_text(title)).alias("title"), href.alias("href"),
        X.strip(_text(body)).alias("body"), U.extract_domain(href).alias("domain"),
        rank.cast("int").alias("rank"), "provider", "query", "search_type",
        fetched.alias("fetched_at"),
        (metadata if metadata is not None else F.lit(None).cast(schemas.SEARCH_METADATA))
        .alias("metadata"),
    )


def _metadata_struct(known: dict[str, Column]) -> Column:
    extra = {k: v for k, v in known.items() if k not in _META}
    cols = dict(known)
    if extra:  # provider-specific facts travel as text attributes
        cols["attributes"] = F.map_from_arrays(
            F.array(*[F.lit(k) for k in extra]),
            F.array(*[v.cast("string") for v in extra.values()]))
    return F.struct(*[
        cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in _META.items()
    ])


def normalize_payloads(raw: DataFrame, provider: str, keep: list[str] | None = None) -> DataFrame:
    """Search results of one provider's calls. A response that is no JSON gives no rows.

    The array work is per response, which an API bounds, so calls never need a shuffle.
    """
    p = get_provider(provider)
    parsed = raw.withColumn("_r", F.from_json("payload", p.schema))
    items = F.transform(
        p.items(F.col("_r"), F.col("search_type")),
        lambda x, i: F.struct(x.alias("item"), (i + 1).alias("idx")))
    kept = F.filter(items, lambda e: p.keep(_text(p.href(e["item"]))))
    if p.capped:
        kept = F.slice(kept, F.lit(1), F.greatest(F.col("max_results"), F.lit(1)))
    rows = parsed.select(
        "*", F.posexplode(F.coalesce(kept, F.array().cast(_array_of(parsed, kept)))).alias("_n", "_e"))
    item = F.col("_e.item")
    rank = F.col("_e.idx")
    if p.rank == "position":
        rank = F.coalesce(item["position"], F.col("_n") + 1)
    return build_results(
        rows, p.title(item), _text(p.href(item)), p.body(item), rank,
        _metadata_struct(p.metadata(F.col("_r"), item)), keep)


def _array_of(df: DataFrame, c: Column):
    return df.select(c.alias("c")).schema["c"].dataType


_LINKS = "array<struct<title:string,link:string>>"


def _site_links(links: Column, title: str, href: str) -> Column:
    return F.transform(
        links, lambda s: F.struct(_text(s[title]).alias("title"), _text(s[href]).alias("href")))


def _no_links() -> Column:
    return F.array().cast("array<struct<title:string,href:string>>")


_SERPER_ITEM = (
    "title:string,link:string,snippet:string,position:int,date:string,imageUrl:string,"
    f"displayedLink:string,attributes:map<string,string>,sitelinks:{_LINKS}"
)
register("serper", Provider(
    schema=f"organic array<struct<{_SERPER_ITEM}>>, news array<struct<{_SERPER_ITEM}>>, "
           "searchInformation struct<totalResults:string>, answerBox string, "
           "knowledgeGraph string, relatedSearches array<struct<query:string>>",
    items=lambda r, kind: F.when(kind == "news", r["news"]).otherwise(r["organic"]),
    title=lambda i: i["title"], href=lambda i: i["link"], body=lambda i: i["snippet"],
    rank="position",
    metadata=lambda r, i: {
        "published_date": _text(i["date"]), "image_url": _text(i["imageUrl"]),
        "displayed_link": _text(i["displayedLink"]),
        "attributes": F.coalesce(i["attributes"], F.create_map().cast("map<string,string>")),
        "site_links": F.coalesce(_site_links(i["sitelinks"], "title", "link"), _no_links()),
        "answer_box": F.coalesce(r["answerBox"], F.lit("{}")),
        "knowledge_graph": F.coalesce(r["knowledgeGraph"], F.lit("{}")),
        "related_searches": F.coalesce(
            F.array_compact(r["relatedSearches"]["query"]), F.array().cast("array<string>")),
        "total_results": _text(r["searchInformation"]["totalResults"]),
    }))

register("tavily", Provider(
    schema="results array<struct<title:string,url:string,content:string,score:double,"
           "published_date:string,raw_content:string>>",
    items=lambda r, kind: r["results"],
    title=lambda i: i["title"], href=lambda i: i["url"], body=lambda i: i["content"],
    metadata=lambda r, i: {
        "score": F.coalesce(i["score"], F.lit(0.0)),
        "published_date": _text(i["published_date"]), "raw_content": _text(i["raw_content"]),
    }))

register("google", Provider(
    schema="items array<struct<title:string,link:string,snippet:string,displayLink:string,"
           "pagemap:string>>, searchInformation struct<formattedTotalResults:string>",
    items=lambda r, kind: r["items"],
    title=lambda i: i["title"], href=lambda i: i["link"], body=lambda i: i["snippet"],
    capped=True,
    metadata=lambda r, i: {
        "displayed_link": _text(i["displayLink"]),
        "page_map": F.coalesce(i["pagemap"], F.lit("{}")),
        "image_url": _text(F.get_json_object(i["pagemap"], "$.cse_image[0].src")),
        "total_results": _text(r["searchInformation"]["formattedTotalResults"]),
    }))

_BING_ITEM = (
    "name:string,url:string,snippet:string,description:string,dateLastCrawled:string,"
    "datePublished:string,displayUrl:string,deepLinks:array<struct<name:string,url:string>>,"
    "image:struct<thumbnail:struct<contentUrl:string>>"
)
register("bing", Provider(
    schema=f"webPages struct<value:array<struct<{_BING_ITEM}>>,totalEstimatedMatches:string>, "
           f"value array<struct<{_BING_ITEM}>>",
    items=lambda r, kind: F.when(kind == "news", r["value"]).otherwise(r["webPages"]["value"]),
    title=lambda i: i["name"], href=lambda i: i["url"],
    body=lambda i: _or(i["snippet"], i["description"]),
    metadata=lambda r, i: {
        "published_date": _or(i["dateLastCrawled"], i["datePublished"]),
        "displayed_link": _text(i["displayUrl"]),
        "site_links": F.coalesce(_site_links(i["deepLinks"], "name", "url"), _no_links()),
        "total_results": F.when(F.col("search_type") == "news", "").otherwise(
            _text(r["webPages"]["totalEstimatedMatches"])),
        "image_url": _text(i["image"]["thumbnail"]["contentUrl"]),
    }))

register("searchapi", Provider(
    schema="organic_results array<struct<title:string,link:string,snippet:string,position:int,"
           f"date:string,displayed_link:string,sitelinks:struct<list:{_LINKS}>>>, "
           "search_information struct<total_results:string>",
    items=lambda r, kind: r["organic_results"],
    title=lambda i: i["title"], href=lambda i: i["link"], body=lambda i: i["snippet"],
    rank="position", capped=True,
    metadata=lambda r, i: {
        "published_date": _text(i["date"]), "displayed_link": _text(i["displayed_link"]),
        "site_links": F.coalesce(_site_links(i["sitelinks"]["list"], "title", "link"),
                                 _no_links()),
        "total_results": _text(r["search_information"]["total_results"]),
    }))

register("crunchbase", Provider(
    schema="entities array<struct<properties:struct<identifier:struct<permalink:string,"
           "value:string>,short_description:string,website:struct<value:string>,"
           "location_identifiers:array<struct<value:string>>,funding_stage:string,"
           "num_employees_enum:string>>>",
    items=lambda r, kind: r["entities"]["properties"],
    title=lambda i: i["identifier"]["value"],
    href=lambda i: _or(i["website"]["value"], _crunchbase_url(i)),
    body=lambda i: i["short_description"],
    keep=lambda href: href != "", capped=True,
    metadata=lambda r, i: {
        "crunchbase_url": _crunchbase_url(i),
        "cb_permalink": _text(i["identifier"]["permalink"]),
        "location": _text(F.get(i["location_identifiers"], 0)["value"]),
        "funding_stage": _text(i["funding_stage"]),
        "employee_count": _text(i["num_employees_enum"]),
    }))


def _crunchbase_url(i: Column) -> Column:
    slug = _text(i["identifier"]["permalink"])
    return F.when(
        slug != "", F.concat(F.lit("https://www.crunchbase.com/organization/"), slug)
    ).otherwise("")


register("producthunt", Provider(
    schema="data struct<posts:struct<edges:array<struct<node:struct<name:string,tagline:string,"
           "website:string,votesCount:int>>>>>",
    items=lambda r, kind: r["data"]["posts"]["edges"]["node"],
    title=lambda i: i["name"], href=lambda i: i["website"], body=lambda i: i["tagline"],
    keep=lambda href: href != "", capped=True,
    metadata=lambda r, i: {"votes": F.coalesce(i["votesCount"], F.lit(0))}))

register("wellfound", Provider(
    schema="organic array<struct<title:string,link:string,snippet:string>>",
    items=lambda r, kind: r["organic"],
    title=lambda i: i["title"], href=lambda i: i["link"], body=lambda i: i["snippet"],
    keep=lambda href: F.contains(href, F.lit("wellfound.com")), capped=True,
    metadata=lambda r, i: {"source": F.lit("wellfound")}))

_GITHUB_ITEMS = "items array<struct<login:string,html_url:string>>"


def normalize_github(raw: DataFrame, details: DataFrame, keep: list[str] | None = None
                     ) -> DataFrame:
    """Organisation search: items joined with the organisation details by login.

    A missing detail falls back to the item. ``details`` holds login, name, blog, html_url,
    description, bio, location, public_repos, followers, created_at.
    """
    items = F.slice(F.from_json("payload", _GITHUB_ITEMS)["items"], F.lit(1),
                    F.greatest(F.col("max_results"), F.lit(1)))
    rows = raw.select("*", F.posexplode(items).alias("_n", "_i")).select(
        *raw.columns, (F.col("_n") + 1).alias("_rank"), _text(F.col("_i.login")).alias("login"),
        F.coalesce(F.col("_i.html_url"),
                   F.concat(F.lit("https://github.com/"), _text(F.col("_i.login"))))
        .alias("_profile"))
    d = details.select("login", F.struct(
        *[c for c in details.columns if c != "login"]).alias("_d"))
    j = rows.join(d, "login", "left")
    home = _or(F.col("_d.blog"), F.coalesce(F.col("_d.html_url"), F.col("_profile")))
    href = F.when((home != "") & ~home.startswith("http"), F.concat(F.lit("https://"), home)) \
        .otherwise(_or(home, F.col("_profile")))
    meta = _metadata_struct({
        "github_org": F.col("login"), "github_url": F.col("_profile"),
        "location": _text(F.col("_d.location")),
        "public_repos": F.coalesce(F.col("_d.public_repos"), F.lit(0)),
        "followers": F.coalesce(F.col("_d.followers"), F.lit(0)),
        "created_at": _text(F.col("_d.created_at")),
    })
    return build_results(j, _or(F.col("_d.name"), F.col("login")), href,
                         _or(F.col("_d.description"), F.col("_d.bio")), F.col("_rank"), meta,
                         keep)
