"""Profile scoring, ranking and tiers over documents (as text pages) and raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import lexicons as lx, scores as SC, text as X
from leadloom.operators import pages as P, scoring as S
from leadloom.plans.inputs import (
    SQL_CUSTOMER_PROFILES, SQL_PROFILES, SQL_TEXT_PAGES, as_of, customer_profiles, profiles,
    published_date, sql_list,
    sql_published_date, text_pages, with_ctes,
)
from leadloom.plans.page_queries import SQL_PARSED, parsed_pages
from leadloom.plans.registry import query

_JOIN = lambda c: F.array_join(c, "|")
_SIZES = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in lx.SIZE_WORDS.items()) + "}"


def sql_leads(pages: str, key: str) -> str:
    """Scores of every (page, profile) pair, written out in plain SQL."""
    among = lambda words, c="tl": (
        f"list_filter({sql_list(sorted(set(words)))}, lambda k: contains({c}, k))")
    return f"""
signals AS (
  SELECT {key}, url, domain, title, tl, published_date,
    {among(lx.TECH_KEYWORDS)} AS page_tech, {among(lx.HIRING_KEYWORDS)} AS hiring_signals,
    {among(lx.OUTSOURCING_KEYWORDS)} AS outsourcing_signals,
    {among(lx.FUNDING_KEYWORDS + lx.BUSINESS_EVENT_KEYWORDS)} AS business_events,
    {among(X.decision_maker_role_words())} AS roles,
    CASE WHEN published_date IS NULL OR NOT ends_with(published_date, 'Z') THEN 0.85::DOUBLE
      WHEN DATE '2024-07-01' - CAST(substr(published_date, 1, 10) AS DATE) < 30 THEN 1.0
      WHEN DATE '2024-07-01' - CAST(substr(published_date, 1, 10) AS DATE) < 90 THEN 0.9
      WHEN DATE '2024-07-01' - CAST(substr(published_date, 1, 10) AS DATE) < 365 THEN 0.75
      ELSE 0.5 END AS freshness
  FROM {pages} WHERE length(tl) > 0),
matched AS (
  SELECT *, list_sort(list_distinct(list_concat(page_tech,
      list_filter(techs, lambda k: contains(tl, k))))) AS tech_stack,
    list_filter(industries, lambda k: contains(tl, k)) AS industry_signals,
    list_sort(list_distinct(list_concat(list_filter(titles, lambda k: contains(tl, k)), roles)))
      AS hints,
    len(list_filter(locations, lambda k: contains(tl, k))) > 0 AS loc_hit,
    len(list_filter(sizes, lambda z: len(list_filter(map_extract({_SIZES}, z)[1],
      lambda k: contains(tl, k))) > 0)) > 0 AS size_hit
  FROM signals, profiles),
component AS (
  SELECT *, CASE WHEN len(techs) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE,
      len(list_intersect(tech_stack, techs))::DOUBLE / len(techs)) END AS tech_score,
    least(1.0::DOUBLE, len(hiring_signals)::DOUBLE / 5) AS hiring_score,
    CASE WHEN len(industries) + len(locations) + len(sizes) = 0 THEN 0.5::DOUBLE ELSE
      least(1.0::DOUBLE, (CASE WHEN len(industries) > 0 THEN 0.5::DOUBLE *
          (len(industry_signals)::DOUBLE / len(industries)) ELSE 0.0::DOUBLE END
        + CASE WHEN len(locations) > 0 AND loc_hit THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN len(sizes) > 0 AND size_hit THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
      / (CASE WHEN len(industries) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN len(locations) > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN len(sizes) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) END AS profile_score
  FROM matched),
all_pairs AS (
  SELECT *, least(1.0::DOUBLE, (wt * tech_score + wh * hiring_score + wp * profile_score)
    * freshness) AS composite FROM component),
leads AS (
  SELECT *, round(composite, 4) AS score, CASE WHEN round(composite, 4) >= 0.65 THEN 'hot'
    WHEN round(composite, 4) >= 0.35 THEN 'warm' ELSE 'cold' END AS tier
  FROM all_pairs WHERE composite >= 0.15)"""


_CTES = (SQL_TEXT_PAGES, SQL_PROFILES, sql_leads("text_pages", "doc_id"))


def _sql(select: str) -> str:
    return with_ctes(*_CTES, select=select)


def doc_leads(spark, d, min_score: float = lx.MIN_LEAD_SCORE) -> DataFrame:
    pages = P.usable(text_pages(spark, d))
    return S.enrich(pages, profiles(spark), as_of(), min_score)


@query("j02_score_pages_by_profiles", _sql("""
SELECT doc_id, icp_id, round(tech_score, 4) AS tech, round(hiring_score, 4) AS hiring,
  round(profile_score, 4) AS profile, round(composite, 4) AS score FROM all_pairs"""))
def score_all(spark, d):
    r = lambda c, n: F.round(c, 4).alias(n)
    return doc_leads(spark, d, 0.0).select(
        "doc_id", "icp_id", r("tech_score", "tech"), r("hiring_score", "hiring"),
        r("profile_score", "profile"), F.col("icp_relevance_score").alias("score"))


def _component(name: str, column: str) -> None:
    @query(name, _sql(f"SELECT doc_id, icp_id, round({column}, 4) AS score FROM leads"))
    def run(spark, d):
        return doc_leads(spark, d).select(
            "doc_id", "icp_id", F.round(column, 4).alias("score"))


_component("x40_score_tech", "tech_score")
_component("x41_score_hiring", "hiring_score")
_component("x42_score_profile", "profile_score")
_component("x45_composite", "composite")


@query("x43_weights", with_ctes(SQL_CUSTOMER_PROFILES, select="""
SELECT icp_id, array_to_string(techs, '|') AS techs, len(industries) AS industries,
  wt AS tech, wh AS hiring, wp AS profile FROM profiles"""))
def weights(spark, d):
    return S.profile_terms(customer_profiles(spark, d)).select(
        "icp_id", _JOIN("techs").alias("techs"), F.size("industries").cast("long").alias("industries"),
        "weights.*")


@query("j02_customer_profiles", with_ctes(
    SQL_TEXT_PAGES, SQL_CUSTOMER_PROFILES, sql_leads("text_pages", "doc_id"), select="""
SELECT icp_id, count(*) AS leads, count(*) FILTER (tier = 'hot') AS hot,
  count(*) FILTER (tier = 'warm') AS warm, round(max(composite), 9) AS best_score,
  arg_min(doc_id, doc_id - round(composite * 1000000000) * 1000000) AS best_doc
FROM leads GROUP BY icp_id"""))
def customer_leads(spark, d):
    pages = P.usable(text_pages(spark, d)).select("doc_id", "text_content", "published_date")
    leads = S.tiered(S.enrich(pages, customer_profiles(spark, d), as_of(), max_snippets=0))
    score, tier = F.col("composite"), F.col("lead_tier")
    place = F.col("doc_id") - F.round(score * 1000000000) * 1000000
    return leads.groupBy("icp_id").agg(
        F.count("*").alias("leads"), F.count_if(tier == "hot").alias("hot"),
        F.count_if(tier == "warm").alias("warm"), F.round(F.max(score), 9).alias("best_score"),
        F.min_by("doc_id", place).alias("best_doc"))


@query("x44_freshness", with_ctes(SQL_TEXT_PAGES, SQL_PROFILES,
                                  sql_leads("text_pages", "doc_id"), select="""
SELECT doc_id, freshness FROM signals"""))
def freshness(spark, d):
    return text_pages(spark, d).select(
        "doc_id", SC.freshness(F.col("published_date"), as_of()).alias("freshness"))


@query("x46_tier", _sql("SELECT doc_id, icp_id, tier FROM leads"))
def tier(spark, d):
    return S.tiered(doc_leads(spark, d)).select(
        "doc_id", "icp_id", F.col("lead_tier").alias("tier"))


@query("x47_decision_makers", _sql("""
SELECT doc_id, icp_id, array_to_string(list_transform(hints, lambda h: h || '=' ||
  CASE WHEN list_contains(titles, h) THEN '0.9' ELSE '0.5' END), '|') AS makers
FROM leads WHERE len(hints) > 0"""))
def makers(spark, d):
    dm = SC.decision_makers(F.col("decision_maker_hints"), F.col("icp_titles"))
    leads = doc_leads(spark, d).filter(F.size("decision_maker_hints") > 0)
    return leads.select("doc_id", "icp_id", _JOIN(F.transform(dm, lambda m: F.concat(
        m["title"], F.lit("="), m["confidence"]))).alias("makers"))


@query("x48_merge_titles", _sql("""
SELECT doc_id, icp_id, array_to_string(list_concat(list_transform(hints, lambda h: h || '=' ||
    CASE WHEN list_contains(titles, h) THEN '0.9' ELSE '0.5' END),
  list_transform(list_filter(['CTO', 'Head of ' || domain, 'Ention'], lambda t:
    NOT list_contains(hints, lower(t))), lambda t: t || '=0.7')), '|') AS makers FROM leads"""))
def merged_makers(spark, d):
    dm = SC.merge_titles(
        SC.decision_makers(F.col("decision_maker_hints"), F.col("icp_titles")),
        F.array(F.lit("CTO"), F.concat(F.lit("Head of "), "domain"), F.lit("Ention"),
                F.concat(F.lit("HEAD of "), "domain")))
    return doc_leads(spark, d).select("doc_id", "icp_id", _JOIN(F.transform(
        dm, lambda m: F.concat(m["title"], F.lit("="), m["confidence"]))).alias("makers"))


@query("p05_min_score", _sql("SELECT icp_id, count(*) AS leads FROM leads GROUP BY icp_id"))
def min_score(spark, d):
    return doc_leads(spark, d).groupBy("icp_id").agg(F.count("*").alias("leads"))


@query("t01_leads_by_score", _sql("""
SELECT icp_id, doc_id, domain, score FROM leads ORDER BY score DESC, domain, doc_id, icp_id"""))
def by_score(spark, d):
    return doc_leads(spark, d).select(
        "icp_id", "doc_id", "domain", F.col("icp_relevance_score").alias("score")
    ).orderBy(*S.best_first("domain", "doc_id", "icp_id", score="score"))


@query("w03_top_leads", _sql("""
SELECT icp_id, doc_id, score, rk AS rank FROM (SELECT *, CAST(row_number() OVER (
  PARTITION BY icp_id ORDER BY score DESC, domain, doc_id) AS INTEGER) AS rk FROM leads)
WHERE rk <= 20"""))
def top_leads(spark, d):
    leads = doc_leads(spark, d).select(
        "icp_id", "domain", "doc_id", F.col("icp_relevance_score").alias("score"))
    return S.top_n(leads, ["icp_id"], S.best_first("domain", "doc_id", score="score"), 20,
                   "rank").drop("domain")


@query("w04_two_step_top_k", _sql("""
SELECT icp_id, doc_id, tier, score, array_to_string(hints, '|') AS makers
FROM (SELECT *, row_number() OVER (PARTITION BY icp_id ORDER BY score DESC, domain, doc_id) AS rk
  FROM leads) WHERE rk <= 10"""))
def two_step(spark, d):
    out = S.final_leads(doc_leads(spark, d), "icp_id", ["domain", "doc_id"], k=10)
    return out.select(
        "icp_id", "doc_id", F.col("lead_tier").alias("tier"),
        F.col("icp_relevance_score").alias("score"),
        _JOIN(F.col("decision_makers.title")).alias("makers"))


@query("u04_wanted_tech_found", _sql("""
SELECT doc_id, icp_id, CAST(len(list_intersect(tech_stack, techs)) AS INTEGER) AS n
FROM leads WHERE len(list_intersect(tech_stack, techs)) > 0"""))
def wanted_tech(spark, d):
    terms = S.profile_terms(profiles(spark)).select("icp_id", "techs")
    # three profiles: the term table is as small as the profile table
    leads = doc_leads(spark, d).select("doc_id", "icp_id", "tech_stack")
    n = F.size(F.array_intersect("tech_stack", "techs"))
    return leads.join(terms, "icp_id").select("doc_id", "icp_id", n.alias("n")).filter("n > 0")


@query("u05_event_keyword_union", with_ctes(SQL_TEXT_PAGES, select=f"""
SELECT keyword, count(*) AS pages FROM (SELECT unnest(list_filter(
  {sql_list(sorted({*lx.FUNDING_KEYWORDS, *lx.BUSINESS_EVENT_KEYWORDS, 'thering', 'the'}))},
  lambda k: contains(tl, k))) AS keyword FROM text_pages) GROUP BY keyword"""))
def event_union(spark, d):
    words = sorted({*lx.FUNDING_KEYWORDS, *lx.BUSINESS_EVENT_KEYWORDS, "thering", "the"})
    return text_pages(spark, d).select(F.explode(
        X.keyword_hits(F.lower("text_content"), words)).alias("keyword")
    ).groupBy("keyword").agg(F.count("*").alias("pages"))


_EVIDENCE_WORDS = ["thering", "avec", "nicht", "blest", "the", "dans", "para"]


@query("w12_evidence", with_ctes(SQL_TEXT_PAGES, select=rf"""
SELECT doc_id, array_to_string(r.out, ' ## ') AS evidence FROM (
  SELECT doc_id, list_reduce(hits, lambda s, h: CASE
      WHEN len(s.out) >= 5 OR len(list_filter(s.taken, lambda p: abs(p - h.pos) < 120)) > 0 THEN s
      ELSE {{'taken': list_append(s.taken, h.pos), 'out': CASE WHEN h.snip = '' THEN s.out
        ELSE list_append(s.out, '...' || h.snip || '...') END, 'pos': 0, 'snip': ''}} END,
    {{'taken': []::INTEGER[], 'out': []::VARCHAR[], 'pos': 0, 'snip': ''}}) AS r
  FROM (SELECT doc_id, list_transform(list_filter({sql_list(_EVIDENCE_WORDS)},
      lambda k: contains(tl, k)), lambda k: {{'taken': []::INTEGER[], 'out': []::VARCHAR[],
        'pos': CAST(instr(tl, k) - 1 AS INTEGER), 'snip': regexp_replace(replace(
          substr(text_content, greatest(0, instr(tl, k) - 61) + 1, instr(tl, k) - 1
            + length(k) + 60 - greatest(0, instr(tl, k) - 61)), chr(10), ' '),
          '^\s+|\s+$', '', 'g')}}) AS hits FROM text_pages)
  WHERE len(hits) > 0)"""))
def evidence(spark, d):
    ev = X.extract_evidence("text_content", X.strings(_EVIDENCE_WORDS))
    return text_pages(spark, d).select("doc_id", ev.alias("e")).filter(
        F.size("e") > 0).select("doc_id", F.array_join("e", " ## ").alias("evidence"))


@query("a08_tier_counts", _sql("""
SELECT icp_id, count(*) FILTER (tier = 'hot') AS hot, count(*) FILTER (tier = 'warm') AS warm,
  count(*) FILTER (tier = 'cold') AS cold, count(*) AS total FROM leads GROUP BY icp_id"""))
def tier_counts(spark, d):
    tiers = S.tiered(doc_leads(spark, d)).groupBy("icp_id").pivot(
        "lead_tier", ["hot", "warm", "cold"]).count().na.fill(0)
    return tiers.withColumn("total", F.expr("hot + warm + cold"))


@query("a11_domains_by_best_score", _sql("""
SELECT icp_id, domain, max(score) AS best FROM leads GROUP BY icp_id, domain"""))
def domains_by_score(spark, d):
    return doc_leads(spark, d).groupBy("icp_id", "domain").agg(
        F.max("icp_relevance_score").alias("best")).orderBy(F.desc("best"), "domain", "icp_id")


@query("p16_scored_lead_record", _sql("""
SELECT doc_id, icp_id, tier, 'tech=' || round(tech_score, 4) || ' hiring='
  || round(hiring_score, 4) AS breakdown,
  array_to_string(tech_stack, '|') AS tech, array_to_string(hiring_signals, '|') AS hiring,
  array_to_string(business_events, '|') AS events, trim(split_part(title, ' - ', 1)) AS company
FROM leads"""))
def record(spark, d):
    leads = S.tiered(doc_leads(spark, d)).withColumns({
        "meta": F.struct(
            F.array().cast("array<string>").alias("json_ld"), F.lit("").alias("og_site_name"),
            F.array().cast("array<string>").alias("emails"),
            F.array().cast("array<string>").alias("phone_numbers"),
            F.create_map().cast("map<string,string>").alias("social_links")),
        "decision_makers": SC.decision_makers(
            F.col("decision_maker_hints"), F.col("icp_titles")),
        "source_url": F.col("final_url"),
    })
    named = S.name_companies(leads)
    out = S.scored_lead_record(named)
    b = F.col("score_breakdown")
    return out.select(
        F.substring_index("source_url", "/", -1).cast("long").alias("doc_id"), "icp_id",
        F.col("lead_tier").alias("tier"),
        F.concat(F.lit("tech="), F.round(b["technology"], 4), F.lit(" hiring="),
                 F.round(b["hiring"], 4)).alias("breakdown"),
        _JOIN("tech_stack").alias("tech"), _JOIN("hiring_signals").alias("hiring"),
        _JOIN("business_events").alias("events"), F.col("company_name").alias("company"))


_HTML_PAGES = (
    "html_pages AS (SELECT page_id, url, domain, title, lower(text_content) AS tl, "
    + sql_published_date("page_id") + " AS published_date FROM parsed)"
)


def html_leads(spark, d) -> DataFrame:
    pages = P.usable(parsed_pages(spark, d)).select(
        "page_id", "url", "domain", "title", "text_content",
        published_date(F.col("page_id")).alias("published_date"))
    return S.enrich(pages, profiles(spark), as_of())


@query("w03_top_domains_from_html", with_ctes(
    SQL_PARSED, _HTML_PAGES, SQL_PROFILES, sql_leads("html_pages", "page_id"), select="""
SELECT * FROM (SELECT icp_id, domain, max(score) AS score, count(*) AS pages,
  CAST(row_number() OVER (PARTITION BY icp_id ORDER BY max(score) DESC, domain) AS INTEGER)
    AS rank FROM leads GROUP BY icp_id, domain) WHERE rank <= 20"""))
def top_domains(spark, d):
    per_domain = html_leads(spark, d).groupBy("icp_id", "domain").agg(
        F.max("icp_relevance_score").alias("score"), F.count("*").alias("pages"))
    return S.top_n(per_domain, ["icp_id"], S.best_first("domain", score="score"), 20, "rank")
