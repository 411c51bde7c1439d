"""Research, contacts and refinement over documents (one company per source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import lexicons as lx, text as X
from leadloom.operators import companies as C, pages as P, scoring as S
from leadloom.plans.inputs import (
    SQL_PROFILES, SQL_TEXT_PAGES, profiles, sql_list, text_pages, with_ctes,
)
from leadloom.plans.registry import query
from leadloom.plans.scoring_queries import doc_leads, sql_leads

_LEADS = (SQL_TEXT_PAGES, SQL_PROFILES, sql_leads("text_pages", "doc_id"))


def pages(spark, d) -> DataFrame:
    return text_pages(spark, d).withColumn("ordinal", F.col("doc_id"))


def pages_with_meta(spark, d) -> DataFrame:
    p = pages(spark, d)
    return p.withColumn("meta", F.struct(
        X.keyword_hits(F.lower("text_content"), lx.TECH_KEYWORDS).alias("tech_signals")))


_BLOCKS = """chunks AS (SELECT domain, doc_id, url, chunk, coalesce(sum(length(chunk)) OVER (
    PARTITION BY domain ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS used FROM (SELECT domain, doc_id, url, substr(text_content, 1, 2000) AS chunk
      FROM text_pages WHERE length(text_content) > 0)),
blocks AS (SELECT domain, string_agg('[PAGE: ' || url || ']' || chr(10)
    || substr(chunk, 1, CAST(8000 - used AS BIGINT)), chr(10) || chr(10) ORDER BY doc_id) AS text_block,
  count(*) AS pages_used FROM chunks WHERE used < 8000 GROUP BY domain)"""


@query("w09_research_text", with_ctes(SQL_TEXT_PAGES, _BLOCKS, select="""
SELECT domain, text_block, pages_used FROM blocks"""))
def research_text(spark, d):
    return C.research_text(pages(spark, d)).select("domain", "text_block", "pages_used")


@query("j09_leads_with_pages", with_ctes(SQL_TEXT_PAGES, _BLOCKS, select="""
SELECT l.domain, coalesce(p.pages, 0) AS pages, b.pages_used, length(b.text_block) AS chars
FROM (SELECT DISTINCT domain FROM text_pages
  UNION SELECT lang || '.example.org' FROM documents) l
LEFT JOIN (SELECT domain, count(*) AS pages FROM text_pages GROUP BY domain) p USING (domain)
LEFT JOIN blocks b USING (domain)"""))
def leads_with_pages(spark, d):
    p = pages(spark, d)
    langs = p.select(F.concat(F.substring_index("title", " - ", -1), F.lit(".example.org"))
                     .alias("domain"))
    leads = p.select("domain").unionByName(langs).distinct()
    return C.with_pages(leads, p).select(
        "domain", "pages", "pages_used", F.length("text_block").cast("long").alias("chars"))


@query("a18_company_profile", with_ctes(SQL_TEXT_PAGES, select=f"""
SELECT domain, min_by(title, doc_id) AS company_name,
  'Company at ' || domain || '. Research requires LLM.' AS description,
  array_to_string(list_sort(list_distinct(flatten(list(list_filter(
    {sql_list(sorted(lx.TECH_KEYWORDS))}, lambda k: contains(tl, k)))))), '|') AS tech_stack
FROM text_pages GROUP BY domain"""))
def company_profile(spark, d):
    return C.fallback_profile(pages_with_meta(spark, d)).select(
        "domain", "company_name", "description",
        F.array_join("tech_stack", "|").alias("tech_stack"))


_NAMED = ("text || ' Write to sales@' || source || '.example.org or LinkedIn.com/in/' || lang"
          " || '-' || doc_id || ' soon'")


def _named_pages(spark, d) -> DataFrame:
    """Pages that name an own address and a profile."""
    p = pages(spark, d).withColumnRenamed("text_content", "text").withColumns({
        "source": F.substring_index("domain", ".", 1),
        "lang": F.substring_index("title", " - ", -1)})
    return p.withColumn("text_content", F.expr(_NAMED))


@query("x24_link_contacts", f"""
SELECT doc_id, 'sales@' || source || '.example.org' AS own,
  'https://' || regexp_extract(t, '(?i)linkedin\\.com/in/[\\w\\-]+') AS linkedin_url, 0.3::DOUBLE AS confidence
FROM (SELECT doc_id, source, {_NAMED} AS t FROM documents)""")
def link_contacts(spark, d):
    c = C.link_contacts(_named_pages(spark, d))
    return c.select(F.col("ordinal").alias("doc_id"), F.col("email").alias("own"),
                    "linkedin_url", "confidence")


# one contact per document: titles repeat within a domain in different case
_SQL_CONTACTS = """contacts AS (SELECT domain, doc_id, CASE WHEN doc_id % 2 = 0
    THEN upper(title) ELSE title END || ' ' || (doc_id % 23) AS title,
  round((doc_id % 10) / 10.0, 1) AS confidence FROM text_pages)"""


def _contacts(spark, d) -> DataFrame:
    p, n = pages(spark, d), F.col("doc_id")
    return p.select("domain", "ordinal", "url", F.concat(
        F.when(n % 2 == 0, F.upper("title")).otherwise(F.col("title")), F.lit(" "), n % 23)
        .alias("title"), F.round((n % 10) / 10.0, 1).alias("confidence"),
        F.lit(0).alias("contact_no"))


@query("w10_pick_contacts", with_ctes(SQL_TEXT_PAGES, _SQL_CONTACTS, select="""
SELECT domain, title, confidence, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY domain ORDER BY confidence DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY domain, lower(title) ORDER BY doc_id) AS rn FROM contacts) WHERE rn = 1)
WHERE rank <= 10"""))
def pick_contacts(spark, d):
    return C.pick_contacts(_contacts(spark, d)).select(
        "domain", "title", F.col("confidence").cast("double").alias("confidence"), "rank")


_QUOTA = """quota AS (SELECT *, row_number() OVER (PARTITION BY icp_id
    ORDER BY score DESC, domain, doc_id) AS rk FROM leads {where})"""


@query("w13_research_quota", with_ctes(
    *_LEADS, _QUOTA.format(where="WHERE score >= 0.4"), select="""
SELECT icp_id, doc_id, domain FROM quota WHERE rk <= 5"""))
def research_quota(spark, d):
    # 0.4 as the hot line: the invented texts seldom reach the default
    leads = S.tiered(doc_leads(spark, d), hot=0.4)
    return C.research_quota(leads, pages(spark, d), "icp_id", ["domain", "doc_id"]).select(
        "icp_id", "doc_id", "domain")


@query("w13_contact_quota", with_ctes(*_LEADS, _QUOTA.format(where=""), select="""
SELECT icp_id, doc_id, domain FROM quota WHERE rk <= 10 AND len(hints) = 0"""))
def contact_quota(spark, d):
    leads = doc_leads(spark, d).withColumnRenamed("decision_maker_hints", "decision_makers")
    return C.contact_quota(leads, pages(spark, d), "icp_id", ["domain", "doc_id"]).select(
        "icp_id", "doc_id", "domain")


def _hot(spark, d) -> DataFrame:
    return S.tiered(doc_leads(spark, d), hot=0.3).filter("lead_tier = 'hot'")


_SQL_COMMON = """common AS (SELECT *, row_number() OVER (PARTITION BY icp_id, kind
    ORDER BY n DESC, term) AS rn FROM (SELECT icp_id, kind, term, count(*) AS n FROM (
      SELECT icp_id, 'tech' AS kind, unnest(tech_stack) AS term FROM leads WHERE score >= 0.3
      UNION ALL SELECT icp_id, 'industry', unnest(industry_signals) FROM leads
      WHERE score >= 0.3) GROUP BY icp_id, kind, term))"""


@query("a16_top_tech", with_ctes(*_LEADS, _SQL_COMMON, select="""
SELECT icp_id, term, n FROM common WHERE kind = 'tech' AND rn <= 5
  AND NOT (icp_id = 'tech' AND term IN ('avec', 'thering'))"""))
def top_tech(spark, d):
    return C.top_tech(profiles(spark), _hot(spark, d)).select("icp_id", "term", "n")


@query("a17_top_industries", with_ctes(*_LEADS, _SQL_COMMON, select="""
SELECT icp_id, term, n FROM common WHERE kind = 'industry' AND rn <= 3"""))
def top_industries(spark, d):
    return C.top_industries(_hot(spark, d)).select("icp_id", "term", "n")


@query("u06_refined_profiles", with_ctes(*_LEADS, _SQL_COMMON, select="""
SELECT p.icp_id, array_to_string(list_sort(list_distinct(list_concat(
    CASE WHEN p.icp_id = 'tech' THEN ['go', 'blest'] ELSE []::VARCHAR[] END,
    coalesce(list(c.term) FILTER (c.term IS NOT NULL), []::VARCHAR[])))), '|') AS preferred,
  CASE p.icp_id WHEN 'tech' THEN 'Edthat|dans' WHEN 'hiring' THEN 'para' ELSE '' END AS industries
FROM profiles p LEFT JOIN (SELECT icp_id, term FROM common WHERE kind = 'tech' AND rn <= 5
  AND NOT (icp_id = 'tech' AND term IN ('avec', 'thering'))) c USING (icp_id)
GROUP BY p.icp_id"""))
def refined(spark, d):
    r = C.refine(profiles(spark), _hot(spark, d))
    return r.select("icp_id", F.array_join(F.array_sort("technologies.preferred"), "|")
                    .alias("preferred"),
                    F.array_join("target_company.industries", "|").alias("industries"))


_LISTED = lambda label, c: (
    f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}, ', ') END")


@query("p17_scoring_prompt", with_ctes(*_LEADS, select=f"""
SELECT icp_id, doc_id, 'profile' || chr(10) || CASE icp_id
    WHEN 'tech' THEN 'target company.industries: Edthat, dans' || chr(10)
      || 'locations.countries: Nicht' || chr(10)
      || 'technologies.required: thering, Avec' || chr(10)
      || 'technologies.preferred: go, blest' || chr(10)
      || 'buyer persona.titles: ention' || chr(10) || 'engagement.models: devops'
    WHEN 'hiring' THEN 'target company.industries: para' || chr(10)
      || 'buyer persona.titles: CTO, unge' ELSE 'nothing' END
  || chr(10) || chr(10) || 'lead ' || trim(split_part(title, ' - ', 1)) || ', ' || domain
  || ', ' || url || ', score ' || printf('%.2f', round(score, 2)) || chr(10)
  || coalesce(nullif(concat_ws(chr(10),
    {_LISTED('tech stack', 'tech_stack')}, {_LISTED('hiring signals', 'hiring_signals')},
    {_LISTED('outsourcing signals', 'outsourcing_signals')},
    {_LISTED('business events', 'business_events')},
    {_LISTED('industry signals', 'industry_signals')},
    {_LISTED('decision maker hints', 'hints')}), ''), 'nothing') AS prompt
FROM leads"""))
def scoring_prompt(spark, d):
    leads = doc_leads(spark, d).withColumns({
        "company_name": F.substring_index("title", " - ", 1), "source_url": F.col("final_url"),
        "emails": F.array().cast("array<string>"),
        "icp_relevance_score": F.round("icp_relevance_score", 2)})
    p = C.scoring_prompt(leads, profiles(spark))
    # quoted evidence is checked by w12_evidence
    return p.select("icp_id", "doc_id", F.regexp_replace(
        "prompt", r"(?s)\n(?:> .*)?$", "").alias("prompt"))


@query("p17_research_prompt", with_ctes(SQL_TEXT_PAGES, _BLOCKS, select="""
SELECT domain, 'Company domain: ' || domain || chr(10) || chr(10) || 'Web pages content:'
  || chr(10) || text_block AS prompt FROM blocks"""))
def research_prompt(spark, d):
    return C.research_prompt(C.research_text(pages(spark, d))).select("domain", "prompt")


@query("p17_contact_prompt", with_ctes(SQL_TEXT_PAGES, select="""
SELECT doc_id, 'Company domain: ' || domain || chr(10) || chr(10) || 'Page text:' || chr(10)
  || text_content AS prompt FROM text_pages WHERE length(text_content) > 100"""))
def contact_prompt(spark, d):
    return C.contact_prompt(pages(spark, d)).select("doc_id", "prompt")
