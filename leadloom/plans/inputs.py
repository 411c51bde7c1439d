"""How the given tables stand in for the engine's inputs, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom import schemas
from leadloom.functions import urls as U
from leadloom.session import spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, spread over the cores when they come as one small file."""
    return spread_small(table(spark, sf_dir, "documents"))


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_avg(c: str, digits: int) -> str:
    """Mean rounded half up, in whole numbers (sums of millionths)."""
    unit = 10 ** (6 - digits)
    micros = f"CAST(sum(CAST({c} AS DECIMAL(18, 6))) * 1000000 AS HUGEINT)"
    return (f"CAST((({micros} * 2 + count({c}) * {unit}) // (2 * count({c}) * {unit})) AS DOUBLE)"
            f" / {10 ** digits}")


AS_OF = "2024-07-01 00:00:00+00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


SQL_DOMAIN = (
    r"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1),"
    r" '^www\.', '')"
)


def sql_domain(u: str) -> str:
    return SQL_DOMAIN.replace("{u}", u)


# -- search results: every page is reported by two calls --------------------------

def published_date(n: Column) -> Column:
    """Text date by number: some NULL, some without a zone."""
    day = F.date_sub(F.lit("2024-06-30").cast("date"), F.pmod(n, F.lit(500)).cast("int"))
    return F.when(n % 5 != 0, F.concat(
        day.cast("string"), F.when(n % 7 == 0, "").otherwise("T00:00:00Z")))


def sql_published_date(n: str) -> str:
    return (
        f"CASE WHEN {n} % 5 <> 0 THEN strftime(DATE '2024-06-30' - CAST({n} % 500 AS INTEGER),"
        f" '%Y-%m-%d') || CASE WHEN {n} % 7 = 0 THEN '' ELSE 'T00:00:00Z' END END"
    )


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id")

    def call(providers: int, rank_step: int, href: Column) -> DataFrame:
        return pages.select(
            n,
            F.concat(F.lit("Result "), n).alias("title"),
            href.alias("href"),
            F.concat(F.lit("About "), "url").alias("body"),
            U.extract_domain(href).alias("domain"),
            (F.floor(n / rank_step) % 10 + 1).cast("int").alias("rank"),
            F.concat(F.lit("p"), n % providers).alias("provider"),
            F.concat(F.lit("q"), n % 7).alias("query"),
            F.when(n % 4 == 0, "news").otherwise("web").alias("search_type"),
            published_date(n).alias("published_date"),
        )

    tagged = F.concat(
        "url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"),
        F.lit("utm_source=feed2"))
    return call(3, 7, F.col("url")).unionByName(call(2, 3, tagged))


def _sql_call(providers: int, rank_step: int, href: str) -> str:
    return f"""
SELECT page_id, 'Result ' || page_id AS title, {href} AS href, 'About ' || url AS body,
  {sql_domain(href)} AS domain, CAST((page_id // {rank_step}) % 10 + 1 AS INTEGER) AS rank,
  'p' || (page_id % {providers}) AS provider, 'q' || (page_id % 7) AS query,
  CASE WHEN page_id % 4 = 0 THEN 'news' ELSE 'web' END AS search_type,
  {sql_published_date('page_id')} AS published_date
FROM pages"""


_TAGGED = "(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed2')"
SQL_RESULTS = (
    "results AS (" + _sql_call(3, 7, "url") + "\nUNION ALL" + _sql_call(2, 3, _TAGGED) + ")"
)


def sql_normalize(u: str) -> str:
    """SQL form of the URL key for URLs with a lower-case scheme."""
    from leadloom.functions.lexicons import TRACKING_PARAMS

    base = f"regexp_replace(rtrim({u}, '/'), '#.*$', '')"
    query = f"regexp_extract({base}, '\\?(.*)$', 1)"
    return f"""(
  SELECT b || CASE WHEN q2 = '' THEN '' ELSE '?' || q2 END FROM (
    SELECT regexp_replace({base}, '\\?.*$', '') AS b,
      array_to_string(flatten(list_transform(
        list_filter(ks, lambda k, i: list_position(ks, k) = i),
        lambda k: list_transform(list_filter(ps, lambda p: p[1] = k), lambda p:
          replace(url_encode(p[1]), '%20', '+') || '=' || replace(url_encode(p[2]), '%20', '+'))
      )), '&') AS q2
    FROM (SELECT ps, list_transform(ps, lambda p: p[1]) AS ks FROM (
      SELECT list_filter(list_transform(
          list_filter(string_split({query}, '&'), lambda x: regexp_matches(x, '^[^=]*=.')),
          lambda x: [url_decode(replace(split_part(x, '=', 1), '+', ' ')),
                     url_decode(replace(substr(x, position('=' IN x) + 1), '+', ' '))]),
        lambda p: NOT list_contains({sql_list(TRACKING_PARAMS)}, p[1])) AS ps))))"""


# -- pages with text: documents ----------------------------------------------------

def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = documents(spark, sf_dir)
    url = F.concat(F.lit("http://"), "source", F.lit(".example.org/"), "doc_id")
    return doc.select(
        "doc_id",
        url.alias("url"),
        url.alias("final_url"),
        F.concat("source", F.lit(".example.org")).alias("domain"),
        F.concat("source", F.lit(" - "), "lang").alias("title"),
        F.col("text").alias("text_content"),
        F.lit(True).alias("success"),
        published_date(F.col("doc_id")).alias("published_date"),
    )


SQL_TEXT_PAGES = f"""text_pages AS (
  SELECT doc_id, 'http://' || source || '.example.org/' || doc_id AS url,
    source || '.example.org' AS domain, source || ' - ' || lang AS title,
    text AS text_content, lower(text) AS tl, {sql_published_date('doc_id')} AS published_date
  FROM documents)"""

# -- customer profiles: words that occur in the texts -------------------------------

_PROFILES = [
    dict(
        icp_id="tech", original_query="teams on thering and avec",
        target_company=dict(industries=["Edthat", "dans"], size=["startup"]),
        locations=dict(countries=["Nicht"], cities=["leaux"]),
        technologies=dict(required=["thering", "Avec"], preferred=["go", "blest"]),
        buyer_persona=dict(titles=["ention"]),
        engagement=dict(models=["devops"]),
    ),
    dict(
        icp_id="hiring", original_query="firms that hire sre",
        target_company=dict(industries=["para"], size=["enterprise", "mid_market"]),
        signals=dict(hiring_signals=["sre hiring"]),
        buyer_persona=dict(titles=["CTO", "unge"]),
    ),
    dict(icp_id="open", original_query="any company"),
]


def profiles(spark: SparkSession) -> DataFrame:
    """Three customer profiles: technology-heavy, hiring-focused, without constraints."""
    def fill(schema, value):
        if value is None:
            from pyspark.sql import types as T
            if isinstance(schema, T.StructType):
                return tuple(fill(f.dataType, None) for f in schema.fields)
            return [] if isinstance(schema, T.ArrayType) else None
        if isinstance(value, dict):
            return tuple(fill(f.dataType, value.get(f.name)) for f in schema.fields)
        return value

    rows = [fill(schemas.ICP, p) for p in _PROFILES]
    return spark.createDataFrame(rows, schemas.ICP)


SQL_PROFILES = """profiles(icp_id, techs, industries, locations, titles, sizes, wt, wh, wp) AS (
  VALUES
  ('tech', ['avec', 'blest', 'go', 'thering'], ['dans', 'edthat'], ['leaux', 'nicht'],
   ['ention'], ['startup'], 0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE),
  ('hiring', []::VARCHAR[], ['para'], []::VARCHAR[], ['cto', 'unge'],
   ['enterprise', 'mid_market'], 0.25::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE),
  ('open', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[],
   0.4::DOUBLE, 0.35::DOUBLE, 0.25::DOUBLE))"""

_WORDS = ["thering", "avec", "nicht", "blest", "dans", "sur", "ment", "mit", "von", "inble", "hent",
          "go"]


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for every customer, with the columns that scoring reads."""
    k, words = F.col("c_custkey"), F.lit(_WORDS)
    word = lambda n: F.get(words, F.pmod(n, F.lit(len(_WORDS))).cast("int"))
    none = F.array().cast("array<string>")
    some = lambda when, *items: F.when(when, F.array(*items)).otherwise(none)
    strings = lambda *items: F.array(*items)
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("icp_id"),
        F.struct(
            some(k % 2 == 0, F.initcap("c_mktsegment"), F.upper(word(F.floor(k / 7)))).alias("industries"),
            some(k % 5 < 2, F.when(k % 5 == 0, "startup").otherwise("enterprise")).alias("size"),
        ).alias("target_company"),
        F.struct(some(k % 3 > 0, word(F.col("c_nationkey").cast("long"))).alias("countries"),
                 none.alias("cities"), none.alias("regions")).alias("locations"),
        F.struct(some(k % 4 == 1, F.lit("sre hiring")).alias("hiring_signals")).alias("signals"),
        F.struct(some(F.pmod(F.floor("c_acctbal"), F.lit(3)) == 0, word(k), word(F.floor(k / 3)))
                 .alias("required"), some(k % 7 == 0, word(k + 5)).alias("preferred"))
        .alias("technologies"),
        F.struct(strings(F.lit("CTO"), word(F.floor(k / 5))).alias("titles")).alias("buyer_persona"))


def _sql_customer_profiles() -> str:
    words = sql_list(_WORDS)
    word = lambda n: f"{words}[({n}) % {len(_WORDS)} + 1]"
    some = lambda when, *items: (
        f"CASE WHEN {when} THEN [{', '.join(items)}] ELSE []::VARCHAR[] END")
    sets = lambda x: f"list_sort(list_distinct({x}))"
    k, required = "c_custkey", "(floor(c_acctbal)::BIGINT % 3 + 3) % 3 = 0"
    techs = f"list_concat({some(required, word(k), word(k + ' // 3'))}, {some('c_custkey % 7 = 0', word(k + ' + 5'))})"
    split = lambda a, b, c, d: (
        f"CASE WHEN {required} THEN {a} WHEN c_custkey % 4 = 1 THEN {b} "
        f"WHEN c_custkey % 2 = 0 THEN {c} ELSE {d} END::DOUBLE")
    return f"""profiles(icp_id, techs, industries, locations, titles, sizes, wt, wh, wp) AS (
  SELECT c_name, {sets(techs)},
    {sets(some("c_custkey % 2 = 0", "lower(c_mktsegment)", word(k + " // 7")))},
    {some("c_custkey % 3 > 0", word("c_nationkey"))},
    {sets(f"['cto', {word(k + ' // 5')}]")},
    {some("c_custkey % 5 < 2", "CASE WHEN c_custkey % 5 = 0 THEN 'startup' ELSE 'enterprise' END")},
    {split(0.5, 0.25, 0.3, 0.4)}, {split(0.3, 0.5, 0.25, 0.35)}, {split(0.2, 0.25, 0.45, 0.25)}
  FROM customer)"""


SQL_CUSTOMER_PROFILES = _sql_customer_profiles()

# -- events ------------------------------------------------------------------------

EVENT_NAMES = {
    "click": "CrawlCompleted", "purchase": "LeadScored", "error": "CrawlFailed",
    "signup": "SessionCreated", "view": "SearchCompleted",
}
SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def sessions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.concat(F.lit("query of "), F.first("user_id")).alias("query"),
        F.min("ts").alias("created_at"), F.max("ts").alias("completed_at"),
        F.count_if(F.col("event_type") == "purchase").alias("total_leads"),
    )
