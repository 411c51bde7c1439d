"""Upserts, purge, checks, reports, lookups and sinks over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import urls as U
from leadloom.operators import store as ST
from leadloom.plans.inputs import SQL_K, event_k, sql_avg, sql_domain, table, with_ctes
from leadloom.plans.registry import query
from leadloom.session import fresh_path
from leadloom.sources import files

_J = lambda c: F.array_join(c, "|")
_NOW = lambda: F.to_timestamp(F.lit("2024-07-01 00:00:00"))
_DAY = lambda c: F.col(c).cast("string").alias(c)

# -- companies: http pages are stored, https pages come in -----------------------------

_LANG = r"regexp_extract(url, '[.]example[.][a-z]+/([a-z]{2})/', 1)"
_TLD = r"regexp_extract(url, '[.]example[.]([a-z]+)', 1)"


def stored_companies(spark, d) -> DataFrame:
    p = table(spark, d, "pages").filter(F.col("url").startswith("http:"))
    p = p.select("page_id", "url", U.extract_domain("url").alias("domain"),
                 F.expr(_LANG).alias("lang"), F.expr(_TLD).alias("tld"))
    return p.groupBy("domain").agg(
        F.concat(F.lit("Old "), F.min("page_id")).alias("company_name"),
        F.array_sort(F.collect_set("lang")).alias("tech_stack"),
        F.array_sort(F.collect_set("tld")).alias("industry_tags"),
        F.min("url").alias("website"),
        F.when(F.min("page_id") % 2 == 0, F.concat(F.lit("L"), F.min("page_id")))
        .alias("linkedin_url"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("discovered_at"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"))


def incoming_companies(spark, d) -> DataFrame:
    n = F.col("page_id")
    return table(spark, d, "pages").filter(F.col("url").startswith("https:")).select(
        n.alias("ordinal"), U.extract_domain("url").alias("domain"),
        F.concat(F.lit("New "), n).alias("company_name"),
        F.array(F.expr(_LANG), F.concat(F.lit("t"), n % 5)).alias("tech_stack"),
        F.array().cast("array<string>").alias("industry_tags"),
        F.when(n % 3 != 0, F.col("url")).alias("website"),
        F.when(n % 4 == 0, F.concat(F.lit("N"), n)).alias("linkedin_url"))


_SQL_COMPANIES = f"""stored_co AS (SELECT {sql_domain('url')} AS domain,
  'Old ' || min(page_id) AS company_name, list_sort(list_distinct(list({_LANG}))) AS tech_stack,
  list_sort(list_distinct(list({_TLD}))) AS industry_tags, min(url) AS website,
  CASE WHEN min(page_id) % 2 = 0 THEN 'L' || min(page_id) END AS linkedin_url
  FROM pages WHERE starts_with(url, 'http:') GROUP BY 1),
incoming_co AS (SELECT {sql_domain('url')} AS domain,
  max_by('New ' || page_id, page_id) AS company_name,
  list_sort(list_distinct(flatten(list([{_LANG}, 't' || (page_id % 5)])))) AS tech_stack,
  max_by(url, page_id) FILTER (page_id % 3 <> 0) AS website,
  max_by('N' || page_id, page_id) FILTER (page_id % 4 = 0) AS linkedin_url
  FROM pages WHERE starts_with(url, 'https:') GROUP BY 1),
companies AS (SELECT domain, coalesce(n.company_name, s.company_name) AS company_name,
  list_sort(list_distinct(list_concat(coalesce(s.tech_stack, []), coalesce(n.tech_stack, []))))
    AS tech_stack, s.industry_tags AS industry_tags, coalesce(n.website, s.website) AS website,
  coalesce(n.linkedin_url, s.linkedin_url) AS linkedin_url,
  CASE WHEN n.domain IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-07-01 00:00:00' END
    AS updated_at,
  CASE WHEN s.domain IS NULL THEN '2024-07-01 00:00:00' ELSE '2024-01-01 00:00:00' END
    AS discovered_at
  FROM stored_co s FULL JOIN incoming_co n USING (domain))"""

_COMPANY_ROWS = """SELECT domain, company_name, array_to_string(tech_stack, '|') AS tech_stack,
  array_to_string(industry_tags, '|') AS industry_tags, website, linkedin_url, updated_at,
  discovered_at FROM companies"""


def merged_companies(spark, d) -> DataFrame:
    return ST.upsert_companies(stored_companies(spark, d), incoming_companies(spark, d), _NOW())


def _company_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "domain", "company_name", _J("tech_stack").alias("tech_stack"),
        _J("industry_tags").alias("industry_tags"), "website", "linkedin_url",
        _DAY("updated_at"), _DAY("discovered_at"))


@query("j10_company_upsert", with_ctes(_SQL_COMPANIES, select=_COMPANY_ROWS))
def company_upsert(spark, d):
    return _company_rows(merged_companies(spark, d))


@query("k03_publish_tables", with_ctes(_SQL_COMPANIES, select=_COMPANY_ROWS))
def publish_tables(spark, d):
    root = fresh_path(spark, "companies")
    ST.publish(spark, stored_companies(spark, d), root)
    # the merge reads the first version while the second is written beside it
    merged = ST.upsert_companies(ST.current(spark, root), incoming_companies(spark, d), _NOW())
    ST.publish(spark, merged, root)
    return _company_rows(ST.current(spark, root))


@query("u03_tag_union", with_ctes(_SQL_COMPANIES, select="""
SELECT domain, array_to_string(tech_stack, '|') AS tech_stack FROM companies"""))
def tag_union(spark, d):
    return merged_companies(spark, d).select("domain", _J("tech_stack").alias("tech_stack"))


@query("p08_companies_by_tag", with_ctes(_SQL_COMPANIES, select="""
SELECT domain, company_name FROM companies WHERE list_contains(tech_stack, 'fr')
UNION ALL SELECT domain, company_name FROM companies WHERE list_contains(industry_tags, 'net')"""))
def by_tag(spark, d):
    c = merged_companies(spark, d)
    return ST.companies_with(c, "tech_stack", "fr").unionByName(
        ST.companies_with(c, "industry_tags", "net")).select("domain", "company_name")


@query("p09_yc_companies", with_ctes(_SQL_COMPANIES, select="""
SELECT domain, 'W' || (length(domain) % 3) AS yc_batch FROM companies
WHERE list_contains(tech_stack, 'en') AND length(domain) % 3 = 1"""))
def yc(spark, d):
    c = merged_companies(spark, d).withColumns({
        "is_yc_company": F.array_contains("tech_stack", "en"),
        "yc_batch": F.concat(F.lit("W"), F.length("domain") % 3)})
    return ST.yc_companies(c, "W1").select("domain", "yc_batch")


# -- leads: views and clicks are stored, other events come in --------------------------

def _leads(spark, d, stored: bool) -> DataFrame:
    k = event_k()
    score = F.round(F.least(F.lit(1.0), F.col("value") / 200), 6)
    e = table(spark, d, "events")
    kinds = F.col("event_type").isin("view", "click")
    return e.filter(kinds if stored else ~kinds).select(
        F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("d"), k, F.lit(".example.com")).alias("domain"),
        F.when(k % 9 != 0, F.concat(F.lit("Company "), k)).alias("company_name"),
        score.alias("icp_relevance_score"),
        F.when(score >= 0.65, "hot").when(score >= 0.35, "warm").otherwise("cold")
        .alias("lead_tier"))


def stored_leads(spark, d) -> DataFrame:
    return ST.best_per_key(_leads(spark, d, True)).drop("ordinal").withColumns({
        "company_summary": F.lit("old"),
        "created_at": F.to_timestamp(F.lit("2024-01-01 00:00:00"))})


_SCORE = "round(least(1.0::DOUBLE, value / 200), 6)"
_SQL_LEADS = f"""lead_events AS (SELECT event_id AS ordinal,
  CAST(user_id AS VARCHAR) AS session_id, 'd' || {SQL_K} || '.example.com' AS domain,
  CASE WHEN {SQL_K} % 9 <> 0 THEN 'Company ' || {SQL_K} END AS company_name, {_SCORE} AS score,
  CASE WHEN {_SCORE} >= 0.65 THEN 'hot' WHEN {_SCORE} >= 0.35 THEN 'warm' ELSE 'cold' END AS tier,
  event_type IN ('view', 'click') AS is_stored FROM events),
ranked_leads AS (SELECT *, row_number() OVER (PARTITION BY is_stored, session_id, domain
  ORDER BY score DESC, ordinal) AS rn, row_number() OVER (PARTITION BY is_stored, session_id,
  domain ORDER BY ordinal DESC) AS last_rn FROM lead_events),
stored_leads AS (SELECT * FROM ranked_leads WHERE is_stored AND rn = 1)"""


def _sql_merged_leads(pick: str) -> str:
    return f"""leads AS (SELECT coalesce(n.session_id, s.session_id) AS session_id,
  coalesce(n.domain, s.domain) AS domain,
  CASE WHEN n.domain IS NULL THEN s.company_name ELSE n.company_name END AS company_name,
  coalesce(n.score, s.score) AS score, coalesce(n.tier, s.tier) AS tier,
  CASE WHEN s.domain IS NOT NULL THEN 'old' END AS company_summary,
  CASE WHEN s.domain IS NULL THEN '2024-07-01 00:00:00' ELSE '2024-01-01 00:00:00' END
    AS created_at
  FROM stored_leads s FULL JOIN (SELECT * FROM ranked_leads WHERE NOT is_stored AND {pick} = 1) n
  ON s.session_id = n.session_id AND s.domain = n.domain)"""


_SQL_MERGED = (_SQL_LEADS, _sql_merged_leads("rn"))
_LEAD_ROWS = """SELECT session_id, domain, company_name, score, tier, company_summary, created_at
FROM leads"""


def merged_leads(spark, d, keep: str = "best") -> DataFrame:
    return ST.upsert_leads(stored_leads(spark, d), _leads(spark, d, False), _NOW(), keep)


def _lead_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "domain", "company_name", F.col("icp_relevance_score").alias("score"),
        F.col("lead_tier").alias("tier"), "company_summary", _DAY("created_at"))


@query("j11_lead_upsert", with_ctes(*_SQL_MERGED, select=_LEAD_ROWS))
def lead_upsert(spark, d):
    return _lead_rows(merged_leads(spark, d))


@query("j11_lead_upsert_last", with_ctes(
    _SQL_LEADS, _sql_merged_leads("last_rn"), select=_LEAD_ROWS))
def lead_upsert_last(spark, d):
    return _lead_rows(merged_leads(spark, d, "last"))


def _lead_view(df: DataFrame) -> DataFrame:
    return df.select("session_id", "domain", F.col("icp_relevance_score").alias("score"),
                     F.col("lead_tier").alias("tier"))


@query("p06_equality_filters", with_ctes(*_SQL_MERGED, select="""
SELECT session_id, domain, score, tier FROM leads WHERE tier = 'hot' AND company_name IS NULL"""))
def equality(spark, d):
    return _lead_view(ST.where(merged_leads(spark, d), lead_tier="hot", company_name=None))


@query("p07_leads_of_session", with_ctes(*_SQL_MERGED, select="""
SELECT session_id, domain, score, tier FROM leads WHERE session_id = '7' AND tier = 'warm'
ORDER BY score DESC, domain LIMIT 50"""))
def leads_of_session(spark, d):
    return _lead_view(ST.leads_of_session(merged_leads(spark, d), "7", "warm"))


@query("w03_top_by_session", with_ctes(*_SQL_MERGED, select="""
SELECT session_id, domain, score, tier FROM (SELECT *, row_number() OVER (
  PARTITION BY session_id ORDER BY score DESC, domain) AS rk FROM leads) WHERE rk <= 20"""))
def top_by_session(spark, d):
    return _lead_view(ST.top_by_session(merged_leads(spark, d)))


@query("t06_best_hot_and_warm", with_ctes(*_SQL_MERGED, select="""
SELECT session_id, domain, score, tier FROM leads WHERE tier IN ('hot', 'warm')
ORDER BY score DESC, session_id, domain LIMIT 10"""))
def best_hot_and_warm(spark, d):
    return _lead_view(ST.best_hot_and_warm(merged_leads(spark, d)))


# -- decision makers: customers are stored, orders come in -----------------------------

_MAIL = "CASE WHEN key % 3 = 0 THEN concat('c', key, '@d.com') END"
_LINK = "CASE WHEN key % 3 = 1 THEN concat('in/', key) END"


def stored_makers(spark, d) -> DataFrame:
    c = table(spark, d, "customer").withColumn("key", F.col("c_custkey"))
    return c.select(
        F.col("key").alias("id"), F.concat(F.lit("d"), F.col("key") % 100).alias("domain"),
        F.concat(F.lit("s"), "c_nationkey").alias("session_id"),
        F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("title"),
        F.expr(_MAIL).alias("email"), F.expr(_LINK).alias("linkedin_url"),
        F.round(F.abs("c_acctbal") / 20000, 3).alias("confidence"))


def incoming_makers(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("key", F.col("o_custkey"))
    n = F.col("o_orderkey")
    urgent = F.col("o_orderpriority").startswith("1")
    return o.select(
        n.alias("ordinal"), F.concat(F.lit("d"), F.col("key") % 100).alias("domain"),
        F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise(F.col("o_orderpriority"))
        .alias("title"),
        F.when(urgent, F.concat(F.lit("new"), n, F.lit("@d.com"))).otherwise(F.expr(_MAIL))
        .alias("email"),
        F.expr(_LINK).alias("linkedin_url"), F.concat(F.lit("Name "), n).alias("full_name"),
        F.round((n % 90) / 100, 2).alias("confidence"),
        F.concat(F.lit("r"), n % 5).alias("session_id"))


_SQL_MAKERS = f"""stored_dm AS (SELECT key AS id, 'd' || (key % 100) AS domain,
  's' || c_nationkey AS session_id, c_name AS full_name, c_mktsegment AS title, {_MAIL} AS email,
  {_LINK} AS linkedin_url, round(abs(c_acctbal) / 20000, 3) AS confidence
  FROM (SELECT *, c_custkey AS key FROM customer)),
incoming_dm AS (SELECT *, CASE WHEN email IS NOT NULL THEN 'email' WHEN linkedin_url IS NOT NULL
    THEN 'linkedin_url' ELSE 'title' END AS kind, coalesce(email, linkedin_url, title) AS val
  FROM (SELECT o_orderkey AS ordinal, 'd' || (key % 100) AS domain,
    CASE WHEN o_orderstatus = 'F' THEN 'BUILDING' ELSE o_orderpriority END AS title,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'new' || o_orderkey || '@d.com'
      ELSE {_MAIL} END AS email, {_LINK} AS linkedin_url, 'Name ' || o_orderkey AS full_name,
    round((o_orderkey % 90) / 100.0::DOUBLE, 2) AS confidence, 'r' || (o_orderkey % 5) AS session_id
    FROM (SELECT *, o_custkey AS key FROM orders))),
one_dm AS (SELECT domain, kind, val, min_by(title, ordinal) AS title,
  arg_min_null(email, ordinal) AS email, arg_min_null(linkedin_url, ordinal) AS linkedin_url,
  max_by(full_name, ordinal) AS full_name, max_by(confidence, ordinal) AS confidence,
  max_by(session_id, ordinal) AS session_id, min(ordinal) AS first FROM incoming_dm GROUP BY domain, kind, val),
keyed_dm AS (SELECT domain, kind, val, count(*) AS hits, min(id) AS id FROM (
    SELECT id, domain, 'email' AS kind, email AS val FROM stored_dm WHERE email IS NOT NULL
    UNION ALL SELECT id, domain, 'linkedin_url', linkedin_url FROM stored_dm
      WHERE linkedin_url IS NOT NULL
    UNION ALL SELECT id, domain, 'title', title FROM stored_dm) GROUP BY domain, kind, val),
met_dm AS (SELECT o.*, k.hits, k.id FROM one_dm o LEFT JOIN keyed_dm k USING (domain, kind, val)),
found_dm AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, val) AS rn
  FROM met_dm WHERE hits = 1),
upd_dm AS (SELECT * FROM found_dm WHERE rn = 1),
all_new_dm AS (SELECT *, EXISTS (SELECT 1 FROM stored_dm s WHERE s.domain = m.domain
  AND s.linkedin_url = m.linkedin_url) AS clash FROM met_dm m WHERE hits IS NULL),
new_dm AS (SELECT *, NOT clash AND linkedin_url IS NOT NULL AND row_number() OVER (
  PARTITION BY domain, linkedin_url, clash ORDER BY first) > 1 AS beaten FROM all_new_dm)"""


@query("j12_decision_maker_upsert", with_ctes(_SQL_MAKERS, select="""
SELECT s.id, s.domain, s.title, s.email, s.linkedin_url,
  coalesce(u.full_name, s.full_name) AS full_name,
  coalesce(u.confidence, s.confidence) AS confidence,
  coalesce(u.session_id, s.session_id) AS session_id
FROM stored_dm s LEFT JOIN upd_dm u ON u.id = s.id
UNION ALL SELECT NULL, domain, title, email, linkedin_url, full_name, confidence, session_id
FROM new_dm WHERE NOT clash AND NOT beaten"""))
def maker_upsert(spark, d):
    t, _ = ST.upsert_decision_makers(stored_makers(spark, d), incoming_makers(spark, d))
    return t.select("id", "domain", "title", "email", "linkedin_url", "full_name", "confidence",
                    "session_id")


@query("j12_decision_maker_rejects", with_ctes(_SQL_MAKERS, select="""
SELECT domain, title, email, linkedin_url, full_name, 'ambiguous' AS reason FROM met_dm
WHERE hits > 1 UNION ALL SELECT domain, title, email, linkedin_url, full_name, 'duplicate link'
FROM new_dm WHERE clash
UNION ALL SELECT domain, title, email, linkedin_url, full_name, 'repeated in batch'
FROM found_dm WHERE rn > 1 UNION ALL SELECT domain, title, email, linkedin_url, full_name,
  'repeated in batch' FROM new_dm WHERE beaten"""))
def maker_rejects(spark, d):
    _, r = ST.upsert_decision_makers(stored_makers(spark, d), incoming_makers(spark, d))
    return r.select("domain", "title", "email", "linkedin_url", "full_name", "reason")


@query("t04_makers_by_confidence", with_ctes(_SQL_MAKERS, select="""
SELECT domain, id, confidence FROM stored_dm ORDER BY domain, confidence DESC, id"""))
def by_confidence(spark, d):
    return ST.makers_by_confidence(stored_makers(spark, d)).select("domain", "id", "confidence")


# -- sessions and telemetry: one session per user ----------------------------------------

def stored_sessions(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.groupBy(F.col("user_id").cast("string").alias("id")).agg(
        F.concat(F.lit("old "), F.min("event_id")).alias("query"),
        F.lit("created").alias("status"),
        F.min(F.col("ts").cast("timestamp")).alias("created_at"),
        F.max(F.col("ts").cast("timestamp")).alias("updated_at"),
        F.lit(0).cast("long").alias("total_leads"), F.lit(0).cast("long").alias("hot_count"),
        F.lit(0).cast("long").alias("warm_count"), F.lit(0).cast("long").alias("cold_count"))


_SQL_SESSIONS = """stored_s AS (SELECT CAST(user_id AS VARCHAR) AS id,
  'old ' || min(event_id) AS query, min(ts) AS created_at FROM events
  WHERE event_type = 'signup' GROUP BY user_id),
runs AS (SELECT CAST(user_id AS VARCHAR) AS id, 'run ' || max(event_id) AS query,
  count(*) FILTER (value >= 100) AS hot, count(*) FILTER (value >= 50 AND value < 100) AS warm,
  count(*) FILTER (value < 50) AS cold FROM events WHERE event_type = 'purchase'
  GROUP BY user_id)"""


def _runs(spark, d) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").filter("event_type = 'purchase'").groupBy(
        F.col("user_id").cast("string").alias("session_id")).agg(
        F.concat(F.lit("run "), F.max("event_id")).alias("query"),
        F.count_if(v >= 100).alias("hot"), F.count_if((v >= 50) & (v < 100)).alias("warm"),
        F.count_if(v < 50).alias("cold"))


_SQL_MERGED_SESSIONS = """merged_s AS (SELECT coalesce(s.id, r.id) AS id,
  coalesce(s.query, r.query) AS query,
  CASE WHEN r.id IS NULL THEN 'created' ELSE 'completed' END AS status,
  coalesce(r.hot + r.warm + r.cold, 0) AS total_leads, coalesce(r.hot, 0) AS hot_count,
  coalesce(r.warm, 0) AS warm_count, coalesce(r.cold, 0) AS cold_count,
  coalesce(s.created_at, TIMESTAMP '2024-07-01') AS created_at
  FROM stored_s s FULL JOIN runs r ON s.id = r.id)"""


def merged_sessions(spark, d) -> DataFrame:
    return ST.upsert_sessions(stored_sessions(spark, d), _runs(spark, d), _NOW())


@query("j13_session_upsert", with_ctes(_SQL_SESSIONS, _SQL_MERGED_SESSIONS, select="""
SELECT id, query, status, total_leads, hot_count, warm_count, cold_count FROM merged_s"""))
def session_upsert(spark, d):
    return merged_sessions(spark, d).select(
        "id", "query", "status", "total_leads", "hot_count", "warm_count", "cold_count")


@query("p15_run_status", with_ctes(_SQL_SESSIONS, _SQL_MERGED_SESSIONS, select="""
SELECT id AS session_id, status, total_leads, hot_count, warm_count, cold_count FROM merged_s
WHERE id = '12'"""))
def run_status(spark, d):
    return ST.run_status(merged_sessions(spark, d), "12")


@query("t03_recent_sessions", with_ctes(_SQL_SESSIONS, _SQL_MERGED_SESSIONS, select="""
SELECT id, query FROM merged_s ORDER BY created_at DESC, id LIMIT 20"""))
def recent(spark, d):
    return ST.recent_sessions(merged_sessions(spark, d)).select("id", "query")


def _telemetry(spark, d) -> dict[str, DataFrame]:
    e = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"),
        "event_type", F.col("value").alias("latency_ms"), event_k().alias("k"))
    kind = lambda *t: e.filter(F.col("event_type").isin(*t))
    return {
        "search_queries": kind("view"), "crawl_history": kind("click", "error"),
        "agent_runs": kind("purchase", "signup").select(
            "id", "session_id", F.concat(F.lit("agent"), F.col("k") % 4).alias("agent_name"),
            "latency_ms", F.when(F.col("k") % 5 != 0, F.col("k")).alias("prompt_tokens"),
            (F.col("k") * 2).alias("output_tokens")),
    }


_SQL_SUMMARY = """SELECT s.id, s.status, s.total_leads, coalesce(q.n, 0) AS search_queries_issued,
  coalesce(c.n, 0) AS urls_crawled, coalesce(a.n, 0) AS agent_runs,
  CAST(coalesce(a.ms, 0) AS DOUBLE) AS total_llm_ms FROM merged_s s
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events
  WHERE event_type = 'view' GROUP BY 1) q ON q.id = s.id
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events
  WHERE event_type IN ('click', 'error') GROUP BY 1) c ON c.id = s.id
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n,
  sum(CAST(value AS DECIMAL(18, 6))) AS ms FROM events
  WHERE event_type IN ('purchase', 'signup') GROUP BY 1) a ON a.id = s.id"""


@query("j05_session_summary", with_ctes(_SQL_SESSIONS, _SQL_MERGED_SESSIONS,
                                        select=_SQL_SUMMARY))
def session_summary(spark, d):
    t = _telemetry(spark, d)
    return ST.session_summary(
        merged_sessions(spark, d), t["search_queries"], t["crawl_history"], t["agent_runs"]
    ).select("id", "status", "total_leads", "search_queries_issued", "urls_crawled",
             "agent_runs", "total_llm_ms")


@query("a19_distinct_children", """
SELECT CAST(user_id AS VARCHAR) AS session_id,
  count(DISTINCT event_id) FILTER (event_type = 'view') AS searches,
  count(DISTINCT event_id) FILTER (event_type IN ('click', 'error')) AS crawls,
  count(DISTINCT event_id) FILTER (event_type IN ('purchase', 'signup')) AS runs
FROM events GROUP BY user_id""")
def distinct_children(spark, d):
    e = table(spark, d, "events")
    which = lambda *t: F.count_distinct(
        F.when(F.col("event_type").isin(*t), F.col("event_id")))
    return e.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        which("view").alias("searches"), which("click", "error").alias("crawls"),
        which("purchase", "signup").alias("runs"))


_SQL_AGENTS = f"""SELECT 'agent' || ({SQL_K} % 4) AS agent_name, count(*) AS runs,
  {sql_avg('value', 1)} AS avg_latency_ms,
  CAST(coalesce(sum({SQL_K}) FILTER ({SQL_K} % 5 <> 0), 0) AS BIGINT) AS total_prompt_tokens,
  CAST(coalesce(sum({SQL_K} * 2), 0) AS BIGINT) AS total_output_tokens"""


@query("a13_agent_stats", f"""{_SQL_AGENTS}, CAST(user_id AS VARCHAR) AS session_id FROM events
WHERE event_type IN ('purchase', 'signup') GROUP BY ALL""")
def agent_stats(spark, d):
    return ST.agent_stats(_telemetry(spark, d)["agent_runs"], "session_id")


def _view_companies(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("d"), "s_suppkey", F.lit(".example.com")).alias("domain"),
        F.array(F.concat(F.lit("n"), "s_nationkey")).alias("tech_stack"),
        F.concat(F.lit("in/"), "s_suppkey").alias("linkedin_url"),
        F.lit("W24").alias("yc_batch"), F.lit("seed").alias("funding_stage"))


@query("j06_top_leads", with_ctes(*_SQL_MERGED, select="""
SELECT l.session_id, l.domain, l.tier AS lead_tier, l.score AS icp_relevance_score,
  'n' || s.s_nationkey AS tech, 'in/' || s.s_suppkey AS linkedin_url,
  coalesce(m.n, 0) AS decision_maker_count
FROM leads l LEFT JOIN supplier s ON l.domain = 'd' || s.s_suppkey || '.example.com'
LEFT JOIN (SELECT 'd' || (c_custkey % 40) || '.example.com' AS domain, count(*) AS n
  FROM customer GROUP BY 1) m ON m.domain = l.domain"""))
def top_leads(spark, d):
    makers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(
        F.lit("d"), F.col("c_custkey") % 40, F.lit(".example.com")).alias("domain"))
    out = ST.top_leads(merged_leads(spark, d), _view_companies(spark, d), makers)
    return out.select("session_id", "domain", "lead_tier", "icp_relevance_score",
                      F.get("tech_stack", 0).alias("tech"), "linkedin_url",
                      "decision_maker_count")


def _gone_sessions(spark, d) -> DataFrame:
    return merged_sessions(spark, d).filter(F.col("id").endswith("3")).select("id")


@query("j17_purge_sessions", with_ctes(
    *_SQL_MERGED, _SQL_SESSIONS, _SQL_MERGED_SESSIONS, _SQL_MAKERS, """gone AS (
  SELECT id FROM merged_s WHERE ends_with(id, '3'))""", select="""
SELECT 'sessions' AS tab, id AS session_id, count(*) AS n FROM merged_s
  WHERE id NOT IN (SELECT id FROM gone) GROUP BY id
UNION ALL SELECT 'leads', session_id, count(*) FROM leads
  WHERE session_id NOT IN (SELECT id FROM gone) GROUP BY session_id
UNION ALL SELECT 'decision_makers', CASE WHEN substr(session_id, 2) IN (SELECT id FROM gone)
  THEN NULL ELSE substr(session_id, 2) END, count(*) FROM stored_dm GROUP BY 2"""))
def purge_sessions(spark, d):
    makers = stored_makers(spark, d).withColumn(
        "session_id", F.expr("substr(session_id, 2)"))
    kept = ST.purge_sessions(
        {"sessions": merged_sessions(spark, d), "leads": merged_leads(spark, d),
         "decision_makers": makers}, _gone_sessions(spark, d))
    rows = [df.select(F.lit(n).alias("tab"), F.col("id" if n == "sessions" else "session_id")
                      .alias("session_id")) for n, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(
        "tab", "session_id").agg(F.count("*").alias("n"))


@query("j17_purge_companies", with_ctes(*_SQL_MERGED, _SQL_MAKERS, select="""
SELECT 'companies' AS tab, 'd' || s_suppkey || '.example.com' AS domain, 1 AS n FROM supplier
  WHERE s_nationkey <> 4
UNION ALL SELECT 'leads', CASE WHEN domain IN (SELECT 'd' || s_suppkey || '.example.com'
  FROM supplier WHERE s_nationkey = 4) THEN NULL ELSE domain END, count(*) FROM leads GROUP BY 2
UNION ALL SELECT 'decision_makers', domain || '.example.com', count(*) FROM stored_dm
  WHERE domain || '.example.com' NOT IN (SELECT 'd' || s_suppkey || '.example.com' FROM supplier
    WHERE s_nationkey = 4) GROUP BY 2"""))
def purge_companies(spark, d):
    companies = _view_companies(spark, d)
    gone = companies.filter(F.array_contains("tech_stack", "n4"))
    makers = stored_makers(spark, d).withColumn(
        "domain", F.concat("domain", F.lit(".example.com")))
    kept = ST.purge_companies({"companies": companies, "leads": merged_leads(spark, d),
                               "decision_makers": makers}, gone)
    rows = [df.select(F.lit(n).alias("tab"), "domain") for n, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("tab", "domain").agg(
        F.count("*").alias("n"))


@query("p19_quality_rejects", """
SELECT 'role' AS broken, CAST(conv_id AS VARCHAR) || '/' || turn AS key, 1::BIGINT AS copies
FROM conversations WHERE turn = 7
UNION ALL SELECT 'score', CAST(event_id AS VARCHAR), 1 FROM events WHERE value / 200 > 1
UNION ALL SELECT 'unique', user_id || '/' || json_extract_string(props, '$.k'), count(*)
FROM events GROUP BY user_id, json_extract_string(props, '$.k') HAVING count(*) > 1""")
def quality(spark, d):
    turns = table(spark, d, "conversations").withColumn(
        "role", F.when(F.col("turn") == 7, "tool").otherwise(F.col("role")))
    _, bad_role = ST.check_values(turns, {
        "role": F.col("role").isin("user", "assistant", "system")})
    e = table(spark, d, "events").withColumns({"score": F.col("value") / 200, "k": event_k()})
    _, bad_score = ST.check_values(e, {"score": F.col("score").between(0, 1)})
    twice = ST.check_unique(e, ["user_id", "k"])
    one = F.lit(1).cast("long").alias("copies")
    return bad_role.select(F.explode("broken").alias("broken"), F.concat(
        "conv_id", F.lit("/"), "turn").alias("key"), one).unionByName(
        bad_score.select(F.explode("broken").alias("broken"),
                         F.col("event_id").cast("string").alias("key"), one)).unionByName(
        twice.select(F.lit("unique").alias("broken"),
                     F.concat("user_id", F.lit("/"), "k").alias("key"), "copies"))


# -- run numbers ---------------------------------------------------------------------

@query("a09_crawl_success_rate", """
SELECT user_id, round(avg(CAST(event_type = 'click' AS INTEGER)), 4) AS success_rate FROM events
WHERE event_type IN ('click', 'error') GROUP BY user_id""")
def crawl_success(spark, d):
    pages = table(spark, d, "events").filter(F.col("event_type").isin("click", "error")) \
        .withColumn("success", F.col("event_type") == "click")
    return ST.crawl_success_rate(pages, "user_id").withColumn(
        "success_rate", F.round("success_rate", 4))


def _stages(spark, d, *names: str) -> list[ST.Stage]:
    """Stages of a run, written one after the other."""
    e, root = table(spark, d, "events"), fresh_path(spark, "run")
    crawled = e.filter(F.col("event_type").isin("click", "error"))
    made = {
        "plan": (e.filter("event_type = 'signup'"), {}),
        "search": (e.filter("event_type = 'view'").withColumn("k", event_k()), {}),
        "crawl": (crawled.withColumn("success", F.col("event_type") == "click"),
                  ST.CRAWL_NUMBERS),
        "leads": (_leads(spark, d, False), ST.LEAD_NUMBERS),
    }
    return [ST.write_stage(made[n][0], f"{root}/{n}", **made[n][1]) for n in names]


@query("a10_run_summary", """
SELECT count(*) FILTER (event_type = 'signup') AS planned_queries,
  count(*) FILTER (event_type = 'view') AS total_results,
  count(*) FILTER (event_type IN ('click', 'error')) AS crawled_pages,
  round(avg(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 END), 2)
    AS crawl_success_rate,
  count(*) FILTER (event_type NOT IN ('view', 'click')) AS leads,
  round(max(least(1.0::DOUBLE, value / 200)) FILTER (event_type NOT IN ('view', 'click')), 3)
    AS top_lead_score FROM events""")
def run_summary(spark, d):
    return ST.run_summary(spark, *_stages(spark, d, "plan", "search", "crawl", "leads"))


_SQL_STAGES = """stages AS (
  SELECT 0 AS ordinal, 'search' AS stage, count(*) FILTER (event_type = 'signup') AS items_in,
    count(*) FILTER (event_type = 'view') AS items_out, 0::BIGINT AS error_count FROM events
  UNION ALL SELECT 1, 'merge', count(*), count(DISTINCT json_extract_string(props, '$.k')), 0
    FROM events WHERE event_type = 'view'
  UNION ALL SELECT 2, 'crawl', count(*), count(*) FILTER (event_type = 'click'),
    count(*) FILTER (event_type = 'error') FROM events WHERE event_type IN ('click', 'error'))"""


def _stage_rows(spark, d) -> DataFrame:
    plan, found, crawled = _stages(spark, d, "plan", "search", "crawl")
    merged = ST.write_stage(found.rows.select("k").distinct(), fresh_path(spark, "merged"))
    usable = ST.write_stage(crawled.rows.filter("success"), fresh_path(spark, "usable"))
    return ST.stage_metrics(spark, [
        ("search", plan, found, 0), ("merge", found, merged, 0),
        ("crawl", crawled, usable, crawled.numbers["items"] - crawled.numbers["successes"])])


@query("a12_stage_metrics", with_ctes(_SQL_STAGES, select="SELECT * FROM stages"))
def stage_metrics(spark, d):
    return _stage_rows(spark, d)


@query("k04_append_stage_metrics", with_ctes(_SQL_STAGES, select="""
SELECT stage, CAST(items_in AS INTEGER) AS items_in, CAST(items_out AS INTEGER) AS items_out,
  run AS session_id FROM stages, (VALUES ('r1'), ('r2')) t(run)"""))
def append_stage_metrics(spark, d):
    path = fresh_path(spark, "stage-metrics")
    for run in ("r1", "r2"):
        files.append(_stage_rows(spark, d).withColumn("session_id", F.lit(run)),
                     "pipeline_metrics", path)
    return files.read_stored(spark, "pipeline_metrics", path).select(
        "stage", "items_in", "items_out", "session_id")


@query("k05_append_telemetry", """
SELECT 'search' AS tab, event_id AS id, CAST(user_id AS VARCHAR) AS session_id, value AS latency
FROM events WHERE event_type = 'view'
UNION ALL SELECT 'agent', event_id, CAST(user_id AS VARCHAR), value FROM events
WHERE event_type IN ('purchase', 'signup')
UNION ALL SELECT 'crawl', event_id, CAST(user_id AS VARCHAR), value FROM events
WHERE event_type IN ('click', 'error')
UNION ALL SELECT 'outreach', event_id, CAST(user_id AS VARCHAR), length('To ' || props) FROM events
WHERE event_type = 'purchase'
UNION ALL SELECT 'message', turn, CAST(conv_id AS VARCHAR), length(text) FROM conversations""")
def append_telemetry(spark, d):
    root, t = fresh_path(spark, "telemetry"), _telemetry(spark, d)
    turns = table(spark, d, "conversations").select(
        F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), "role",
        F.col("text").alias("content"))
    files.append(t["search_queries"], "search_queries", f"{root}/search")
    files.append(t["agent_runs"], "agent_runs", f"{root}/agent")
    files.append(t["crawl_history"], "crawl_history", f"{root}/crawl")
    outreach = table(spark, d, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"),
        F.lit("email").alias("channel"), F.concat(F.lit("To "), "props").alias("subject_line"))
    files.append(outreach, "outreach_suggestions", f"{root}/outreach")
    files.append(turns, "session_conversations", f"{root}/message")
    read = lambda name, sub: files.read_stored(spark, name, f"{root}/{sub}")
    part = lambda df, tab, v: df.select(
        F.lit(tab).alias("tab"), "id", "session_id", v.cast("double").alias("latency"))
    return part(read("search_queries", "search"), "search", F.col("latency_ms")).unionByName(
        part(read("agent_runs", "agent"), "agent", F.col("latency_ms"))).unionByName(
        part(read("crawl_history", "crawl"), "crawl", F.col("latency_ms"))).unionByName(
        part(read("outreach_suggestions", "outreach"), "outreach", F.length("subject_line"))).unionByName(
        part(read("session_conversations", "message"), "message", F.length("content")))


# -- lead files ----------------------------------------------------------------------

def lead_records(spark, d) -> DataFrame:
    """Nested output records of the stored leads."""
    none = F.array().cast("array<string>")
    return merged_leads(spark, d).select(
        F.concat(F.lit("query "), "session_id").alias("query"), "domain",
        F.coalesce("company_name", F.lit("")).alias("company_name"), "lead_tier",
        "icp_relevance_score", F.array(F.lit("go"), F.lit("k8s")).alias("tech_stack"),
        none.alias("hiring_signals"), F.array(F.lit("vendor")).alias("outsourcing_signals"),
        F.lit('says "hi", twice').alias("company_summary"), F.lit("").alias("why_this_lead"),
        F.struct(F.array(F.concat(F.lit("a@"), "domain")).alias("emails"),
                 F.lit(None).cast("string").alias("linkedin_url")).alias("contact_info"),
        F.array(F.struct(F.lit("CTO").alias("title"), F.lit(0.9).alias("confidence")))
        .alias("decision_makers"),
        F.array(F.struct(F.concat(F.lit("To "), "domain").alias("subject_line"),
                         F.lit("Hello").alias("opening_hook"))).alias("outreach_suggestions"),
        F.concat(F.lit("https://"), "domain").alias("source_url"),
        F.array(F.lit("...seen...")).alias("evidence"))


@query("k01_leads_json", with_ctes(*_SQL_MERGED, select="""
SELECT 'query ' || session_id AS query, domain, score, 'go|k8s' AS tech, 'CTO' AS makers,
  false AS has_evidence, total_leads FROM leads
JOIN (SELECT session_id, count(*) AS total_leads FROM leads GROUP BY session_id) USING (session_id)
"""))
def leads_json(spark, d):
    path = fresh_path(spark, "leads-json")
    records = lead_records(spark, d)
    files.write_leads_json(records, path, include_evidence=False)
    schema = records.drop("evidence").schema
    back = spark.read.schema(schema).json(path)
    header = files.leads_header(back, _NOW(), F.lit(12.345)).select("query", "total_leads")
    return back.join(header, "query").select(
        "query", "domain", F.col("icp_relevance_score").alias("score"),
        _J("tech_stack").alias("tech"), _J("decision_makers.title").alias("makers"),
        F.lit("evidence" in back.columns).alias("has_evidence"), "total_leads")


@query("k02_leads_csv", with_ctes(*_SQL_MERGED, select="""
SELECT domain, coalesce(company_name, '') AS company_name, tier AS lead_tier, CAST(round(CAST(score AS DECIMAL(18, 6)), 3) AS DOUBLE) AS score,
  'go; k8s' AS tech_stack, 'vendor' AS outsourcing_signals, 'says "hi", twice' AS company_summary,
  'a@' || domain AS emails, 'CTO' AS decision_makers, 'To ' || domain AS outreach_subject FROM leads"""))
def leads_csv(spark, d):
    path = fresh_path(spark, "leads-csv")
    files.write_leads_csv(lead_records(spark, d), path)
    names = files.lead_csv_rows(lead_records(spark, d)).schema.names
    schema = ", ".join(f"{n} {'double' if n == 'icp_relevance_score' else 'string'}"
                       for n in names)
    back = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return back.select(
        "domain", F.coalesce("company_name", F.lit("")).alias("company_name"), "lead_tier",
        F.col("icp_relevance_score").alias("score"), "tech_stack", "outsourcing_signals",
        "company_summary", "emails", "decision_makers", "outreach_subject")
