"""Explicit schemas of the input and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings() -> T.ArrayType:
    return T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()

RANGE = _struct(min=I, max=I)
LOCATIONS = _struct(countries=_strings(), regions=_strings(), cities=_strings())
KEYWORDS = _struct(required=_strings(), optional=_strings(), excluded=_strings())

ICP = _struct(
    icp_id=S,
    original_query=S,
    target_company=_struct(
        industries=_strings(), size=_strings(), ownership=_strings(),
        employee_range=RANGE, revenue_range=RANGE, maturity_stage=_strings(),
    ),
    locations=LOCATIONS,
    opportunities=_struct(project_types=_strings(), technologies=_strings(), complexity=S),
    signals=_struct(
        hiring_signals=_strings(), technology_changes=_strings(),
        business_events=_strings(), pain_points=_strings(),
    ),
    technologies=_struct(
        required=_strings(), preferred=_strings(), excluded=_strings(),
        migrating_from=_strings(), migrating_to=_strings(),
    ),
    buyer_persona=_struct(titles=_strings(), departments=_strings(), personas=_strings()),
    discovery=_struct(focus=S, result_limit=I),
    engagement=_struct(models=_strings()),
    outsource=_struct(
        likelihood=S, engagement_models=_strings(), outsourcing_signals=_strings(),
        known_vendors=_strings(), preferred_locations=LOCATIONS, contract_keywords=KEYWORDS,
    ),
    keywords=KEYWORDS,
    missing_information=_strings(),
    confidence=D,
)

SEARCH_METADATA = _struct(
    published_date=S, score=D, raw_content=S, image_url=S, displayed_link=S,
    site_links=T.ArrayType(_struct(title=S, href=S)),
    attributes=T.MapType(S, S), page_map=S, rating=D, rating_count=I, address=S, phone=S,
    answer_box=S, knowledge_graph=S, related_searches=_strings(), total_results=S,
)

SEARCH_RESULT = _struct(
    title=S, href=S, body=S, domain=S, rank=I, provider=S, query=S, search_type=S,
    fetched_at=TS, metadata=SEARCH_METADATA,
)

# one landed API response per row
RAW_PAYLOAD = _struct(
    provider=S, query=S, search_type=S, max_results=I, payload=S, fetched_at=TS
)

DIRECTORY_COMPANY = _struct(
    name=S, slug=S, url=S, one_liner=S, long_description=S, tags=_strings(), batch=S,
    team_size=S, location=S, status=S, is_hiring=B,
)

JOB_BOARD_A = _struct(
    slug=S, jobs=T.ArrayType(_struct(title=S, content=S))
)
JOB_BOARD_B = _struct(slug=S, text=S, categories=_struct(team=S))

EVENT = _struct(event_type=S, session_id=S, timestamp=TS, payload=S)

# event type -> payload fields, in their declared order (fixed values)
EVENT_FIELDS = {
    "PipelineStarted": "query string, provider_count int",
    "PipelineCompleted": "query string, total_leads int, hot_count int, warm_count int, "
                         "cold_count int, pipeline_ms double",
    "PipelineFailed": "query string, error string, stage string",
    "IcpParsed": "query string, confidence double, industries array<string>, "
                 "technologies array<string>",
    "QueryPlanned": "query_count int, signal_types array<string>",
    "SearchStarted": "query_string string, provider string",
    "SearchCompleted": "query_string string, provider string, result_count int, "
                       "latency_ms double, success boolean, error string",
    "CrawlStarted": "url string, crawler_type string, using_proxy boolean",
    "CrawlCompleted": "url string, success boolean, status_code int, latency_ms double, "
                      "word_count int, tech_signals int, from_cache boolean",
    "CrawlFailed": "url string, error string, attempt int",
    "ProxyAcquired": "proxy_host string, provider string",
    "ProxyRotated": "old_proxy string, new_proxy string, reason string, provider string",
    "ProxyFailed": "proxy_host string, error string, provider string",
    "LeadEnriched": "domain string, company_name string, icp_score double, tech_count int, "
                    "hiring_count int",
    "LeadScored": "domain string, company_name string, tier string, icp_score double, "
                  "llm_model string",
    "LeadSkipped": "domain string, reason string",
    "CacheHit": "cache_key string, cache_type string",
    "CacheMiss": "cache_key string, cache_type string",
    "SessionCreated": "query string",
    "SessionResumed": "query string, leads_already_found int",
    "MemoryEvicted": "cache_type string, key string, reason string",
    "ContextCompressed": "turns_compacted int, summary_preview string, new_summary_chars int",
    "LlmCacheHit": "model string, agent_role string",
}

STORED_TABLES = {
    "sessions": _struct(
        id=S, query=S, parsed_icp=ICP, status=S, created_at=TS, updated_at=TS, completed_at=TS,
        total_leads=I, hot_count=I, warm_count=I, cold_count=I, pipeline_ms=D,
        provider_count=I, crawled_count=I, search_results_count=I, error=S, metadata=S,
    ),
    "session_conversations": _struct(
        id=L, session_id=S, role=S, content=S, tokens=I, agent_name=S, model_name=S,
        created_at=TS,
    ),
    "search_queries": _struct(
        id=L, session_id=S, query_string=S, signal_type=S, search_type=S, provider=S,
        result_count=I, latency_ms=D, success=B, error=S, executed_at=TS,
    ),
    "crawl_history": _struct(
        id=L, session_id=S, url=S, domain=S, success=B, status_code=I, latency_ms=D,
        word_count=I, from_cache=B, crawler_type=S, proxy_used=B, proxy_provider=S, error=S,
        crawled_at=TS,
    ),
    "companies": _struct(
        domain=S, company_name=S, description=S, founding_year=I, employee_range=S,
        revenue_range=S, headquarters=S, website=S, linkedin_url=S, twitter_url=S,
        github_url=S, crunchbase_url=S, angellist_url=S, yc_batch=S, is_yc_company=B,
        funding_stage=S, total_funding_usd=L, last_funding_at=DT, tech_stack=_strings(),
        industry_tags=_strings(), sic_codes=_strings(), business_model=S, ownership=S,
        maturity_stage=S, source_urls=_strings(), discovered_at=TS, updated_at=TS,
    ),
    "leads": _struct(
        id=L, session_id=S, domain=S, company_name=S, lead_tier=S, icp_relevance_score=D,
        tech_score=D, hiring_score=D, profile_score=D, tech_stack=_strings(),
        hiring_signals=_strings(), outsourcing_signals=_strings(), business_events=_strings(),
        industry_signals=_strings(), company_summary=S, why_this_lead=S, source_url=S,
        source_provider=S, evidence=_strings(), llm_scored=B, llm_model_used=S, created_at=TS,
    ),
    "decision_makers": _struct(
        id=L, domain=S, session_id=S, full_name=S, title=S, department=S, seniority=S, email=S,
        linkedin_url=S, twitter_url=S, phone=S, confidence=D, source=S, verified=B,
        discovered_at=TS,
    ),
    "outreach_suggestions": _struct(
        id=L, lead_id=L, session_id=S, domain=S, channel=S, subject_line=S, opening_hook=S,
        key_talking_points=_strings(), personalization=_strings(), created_at=TS,
    ),
    "agent_runs": _struct(
        id=L, session_id=S, agent_name=S, model_name=S, provider=S, prompt_tokens=I,
        output_tokens=I, latency_ms=D, success=B, fallback_used=B, error=S, input_summary=S,
        output_summary=S, executed_at=TS,
    ),
    "pipeline_metrics": _struct(
        id=L, session_id=S, stage=S, items_in=I, items_out=I, error_count=I, latency_ms=D,
        cache_hits=I, cache_misses=I, recorded_at=TS,
    ),
    "linked_source_results": _struct(
        id=L, session_id=S, source=S, external_id=S, domain=S, company_name=S, description=S,
        founded_year=I, tags=_strings(), location=S, funding_info=S, raw_data=S, result_url=S,
        fetched_at=TS,
    ),
}
