"""Event counters and folds over the given events, as batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.operators import events as E
from leadloom.plans.inputs import SQL_K, event_k, sql_avg, table, with_ctes
from leadloom.plans.registry import query
from leadloom.session import fresh_path
from leadloom.streaming import jobs

_KIND = """CASE event_type
  WHEN 'click' THEN CASE WHEN k % 10 = 3 THEN 'LeadEnriched' ELSE 'CrawlCompleted' END
  WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'PipelineCompleted' ELSE 'LeadScored' END
  WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN 'PipelineFailed' WHEN k % 10 = 1 THEN 'ProxyFailed'
    WHEN k % 10 = 2 THEN 'ProxyRotated' ELSE 'CrawlFailed' END
  WHEN 'signup' THEN CASE WHEN k < 50 THEN 'SessionCreated' ELSE 'PipelineStarted' END
  ELSE CASE WHEN k % 10 = 1 THEN 'CacheMiss' WHEN k % 10 = 2 THEN 'CacheHit'
    ELSE 'SearchCompleted' END END"""
_TIER = "CASE WHEN value >= 60 THEN 'hot' WHEN value >= 20 THEN 'warm' ELSE 'cold' END"


def as_pipeline_events(events: DataFrame) -> DataFrame:
    """The given events as pipeline events; works on batch and streaming input."""
    e = events.select("*", event_k().alias("k"), F.col("user_id").cast("string").alias("sid"))
    e = e.withColumn("kind", F.expr(_KIND))
    k, v, is_a = F.col("k"), F.col("value"), lambda *t: F.col("kind").isin(*t)
    given = lambda cond, c, n: F.when(cond, c).alias(n)  # noqa: E731 - to_json drops NULLs
    payload = F.to_json(F.struct(
        F.col("sid").alias("session_id"),
        given(is_a("CrawlCompleted", "CrawlFailed"), F.concat(F.lit("http://h/"), k), "url"),
        given(is_a("CrawlCompleted", "SearchCompleted"), v >= 50, "success"),
        given(is_a("CrawlCompleted", "SearchCompleted"), v, "latency_ms"),
        given(is_a("CrawlCompleted"), F.lit(200), "status_code"),
        given(is_a("CrawlCompleted"), F.col("event_id") % 4 == 0, "from_cache"),
        given(is_a("SearchCompleted"), k, "result_count"),
        given(is_a("SearchCompleted", "ProxyFailed", "ProxyRotated"),
              F.concat(F.lit("p"), k % 3), "provider"),
        given(is_a("LeadScored"), F.expr(_TIER), "tier"),
        given(is_a("LeadScored", "LeadEnriched"), F.concat(F.lit("d"), k, F.lit(".com")),
              "domain"),
        given(is_a("LeadScored", "LeadEnriched"), F.concat(
            F.lit("It's a company with quite a long name no "), k), "company_name"),
        given(is_a("LeadScored", "LeadEnriched"), k / 100, "icp_score"),
        given(is_a("PipelineCompleted"), v, "pipeline_ms"),
        given(is_a("PipelineCompleted"), k, "total_leads"),
        given(is_a("PipelineCompleted"), (k % 3).cast("int"), "hot_count"),
        given(is_a("CacheHit", "CacheMiss"), F.when(k % 4 < 2, "crawl").otherwise("lead"),
              "cache_type"),
        given(is_a("PipelineFailed", "CrawlFailed", "ProxyFailed"),
              F.concat(F.lit("error "), k), "error"),
        given(is_a("SessionCreated", "PipelineStarted", "PipelineFailed"),
              F.concat(F.lit("q"), k), "query"),
    ))
    return e.select(
        F.col("kind").alias("event_type"), F.col("sid").alias("session_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), payload.alias("payload"), "event_id")


_SQL_EVENTS = f"""e AS (SELECT *, {_KIND} AS kind, CAST(user_id AS VARCHAR) AS session_id,
  {_TIER} AS tier FROM (SELECT *, {SQL_K} AS k FROM events))"""


def _events(spark, d) -> DataFrame:
    return as_pipeline_events(table(spark, d, "events"))


def _stream(spark, d) -> DataFrame:
    return as_pipeline_events(jobs.read_files(spark, d, "events.parquet"))


_N = lambda name, cond: f"count(*) FILTER ({cond}) AS {name}"
_SQL_METRICS = ", ".join([
    _N("search_calls", "kind = 'SearchCompleted'"),
    "CAST(coalesce(sum(k) FILTER (kind = 'SearchCompleted'), 0) AS BIGINT) AS search_results",
    _N("crawl_attempts", "kind = 'CrawlCompleted'"),
    _N("crawl_successes", "kind = 'CrawlCompleted' AND value >= 50"),
    _N("crawl_from_cache", "kind = 'CrawlCompleted' AND event_id % 4 = 0"),
    _N("crawl_failures", "kind = 'CrawlFailed'"), _N("leads_enriched", "kind = 'LeadEnriched'"),
    _N("leads_scored", "kind = 'LeadScored'"),
    *[_N(f"leads_{t}", f"kind = 'LeadScored' AND tier = '{t}'") for t in ("hot", "warm", "cold")],
    _N("proxy_rotations", "kind = 'ProxyRotated'"), _N("proxy_failures", "kind = 'ProxyFailed'"),
    _N("pipeline_runs", "kind = 'PipelineCompleted'"),
    "coalesce(" + sql_avg("CASE WHEN kind = 'PipelineCompleted' THEN value END", 1)
    + ", 0.0) AS avg_pipeline_ms",
    "round(count(*) FILTER (kind = 'CrawlCompleted' AND value >= 50)::DOUBLE / "
    "greatest(count(*) FILTER (kind = 'CrawlCompleted'), 1), 3) AS crawl_success_rate"])
_METRICS = with_ctes(_SQL_EVENTS, select=f"SELECT {_SQL_METRICS} FROM e")


@query("a14_event_metrics", _METRICS)
def metrics(spark, d):
    return E.metrics(_events(spark, d))


@query("a14_event_metrics_by_session", with_ctes(
    _SQL_EVENTS, select=f"SELECT session_id, {_SQL_METRICS} FROM e GROUP BY session_id"))
def metrics_by_session(spark, d):
    return E.metrics(_events(spark, d), "session_id")


@query("r01_live_metrics", _METRICS)
def live_metrics(spark, d):
    return jobs.last_batch(jobs.drain(spark, E.metrics(_stream(spark, d)), "metrics",
                                      "complete"))


_BUCKET = "CASE " + " ".join(
    f"WHEN value / 1000 <= {b} THEN '{b}'" for b in E.LATENCY_BUCKETS) + " ELSE '+Inf' END"


@query("a15_histograms", with_ctes(_SQL_EVENTS, select=f"""
SELECT metric, label, bucket, count(*) AS count FROM (
  SELECT 'leads_total' AS metric, tier AS label, '' AS bucket FROM e WHERE kind = 'LeadScored'
  UNION ALL SELECT 'crawl_latency_seconds', '', {_BUCKET} FROM e
    WHERE kind = 'CrawlCompleted' AND event_id % 4 <> 0
  UNION ALL SELECT 'search_latency_seconds', 'p' || (k % 3), {_BUCKET} FROM e
    WHERE kind = 'SearchCompleted'
  UNION ALL SELECT 'pipeline_runs_total', '', '' FROM e WHERE kind = 'PipelineCompleted'
  UNION ALL SELECT 'cache_hits_total', CASE WHEN k % 4 < 2 THEN 'crawl' ELSE 'lead' END, ''
    FROM e WHERE kind = 'CacheHit') GROUP BY ALL"""))
def histograms(spark, d):
    return E.histograms(_events(spark, d))


@query("a21_cache_hit_rate", with_ctes(_SQL_EVENTS, select="""
SELECT CASE WHEN k % 4 < 2 THEN 'crawl' ELSE 'lead' END AS cache_type,
  count(*) FILTER (kind = 'CacheHit') AS hits, count(*) FILTER (kind = 'CacheMiss') AS misses,
  round(count(*) FILTER (kind = 'CacheHit')::DOUBLE / count(*), 3) AS hit_rate
FROM e WHERE kind IN ('CacheHit', 'CacheMiss') GROUP BY 1"""))
def hit_rate(spark, d):
    return E.cache_hit_rate(_events(spark, d))


@query("s15_event_source", with_ctes(_SQL_EVENTS, select="""
SELECT kind AS event_type, session_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n
FROM e GROUP BY ALL"""))
def event_source(spark, d):
    path = fresh_path(spark, "events")
    e = _events(spark, d)
    data = F.concat(
        F.lit('{"timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        F.lit('",'), F.expr("substr(payload, 2)"))
    # both envelopes, with end marks and broken lines between them
    sse = F.concat(F.lit('data: {"type":"'), "event_type", F.lit('","data":'), data, F.lit("}"))
    hook = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","data":'), data, F.lit("}"))
    line = F.when(F.col("event_id") % 2 == 0, F.array(sse, F.lit('data: {"type":"done"}'))) \
        .otherwise(F.array(hook, F.lit("{broken")))
    e.select(F.explode(line).alias("value")).write.text(path)
    parsed = E.parse_events(spark.read.text(path))
    return parsed.groupBy(
        "event_type", "session_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("minute")).agg(
        F.count("*").alias("n"))


_PICK = "SELECT event_id, kind AS event_type FROM e WHERE "


def _picked(df: DataFrame) -> DataFrame:
    return df.select("event_id", "event_type")


@query("r02_session_stream", with_ctes(_SQL_EVENTS, select=_PICK + "session_id = '7'"))
def session_stream(spark, d):
    return _picked(jobs.drain(spark, E.of_session(_stream(spark, d), "7"), "session"))


_TYPES = ["LeadScored", "CrawlFailed"]


@query("r03_type_stream", with_ctes(
    _SQL_EVENTS, select=_PICK + "kind IN ('LeadScored', 'CrawlFailed')"))
def type_stream(spark, d):
    return _picked(jobs.drain(spark, E.of_types(_stream(spark, d), _TYPES), "types"))


@query("r04_hot_lead_alerts", with_ctes(_SQL_EVENTS, select="""
SELECT session_id, 'd' || k || '.com' AS domain, tier, k / 100.0::DOUBLE AS icp_score FROM e
WHERE kind = 'LeadScored' AND tier = 'hot'"""))
def alerts(spark, d):
    return jobs.drain(spark, E.hot_leads(_stream(spark, d)), "alerts").select(
        "session_id", "domain", "tier", "icp_score")


_SQL_LINE = r"""'[event] ' || kind || ' {session_id=''' || session_id || ''', ' || CASE
  WHEN kind IN ('LeadScored', 'LeadEnriched') THEN 'domain=''d' || k || '.com'', company_name="'
    || substr(nm, 1, 40) || '", ' || CASE kind WHEN 'LeadScored' THEN 'tier=''' || tier || ''', icp_score='
    || k / 100.0::DOUBLE ELSE 'icp_score=' || k / 100.0::DOUBLE || ', tech_count=None' END
  WHEN kind = 'CrawlFailed' THEN 'url=''http://h/' || k || ''', error=''error ' || k || ''', attempt=None'
  WHEN kind = 'CrawlCompleted' THEN 'url=''http://h/' || k || ''', success=' || CASE WHEN value >= 50
    THEN 'True' ELSE 'False' END || ', status_code=200, latency_ms=' || value
  WHEN kind = 'SessionCreated' THEN 'query=''q' || k || ''''
  WHEN kind = 'PipelineStarted' THEN 'query=''q' || k || ''', provider_count=None'
  WHEN kind = 'PipelineCompleted' THEN 'query=None, total_leads=' || k || ', hot_count=' || (k % 3)
    || ', warm_count=None'
  WHEN kind = 'PipelineFailed' THEN 'query=''q' || k || ''', error=''error ' || k || ''', stage=None'
  WHEN kind = 'ProxyFailed' THEN 'proxy_host=None, error=''error ' || k || ''', provider=''p' || (k % 3) || ''''
  WHEN kind = 'ProxyRotated' THEN 'old_proxy=None, new_proxy=None, reason=None, provider=''p' || (k % 3) || ''''
  WHEN kind = 'SearchCompleted' THEN 'query_string=None, provider=''p' || (k % 3) || ''', result_count='
    || k || ', latency_ms=' || value
  WHEN kind IN ('CacheHit', 'CacheMiss') THEN 'cache_key=None, cache_type=''' || CASE WHEN k % 4 < 2
    THEN 'crawl' ELSE 'lead' END || '''' END || '}'"""


@query("r05_event_log_lines", with_ctes(_SQL_EVENTS, select=f"""
SELECT session_id, CASE WHEN kind IN ('LeadScored', 'LeadEnriched', 'SessionCreated', 'PipelineStarted',
    'PipelineCompleted', 'PipelineFailed', 'ProxyFailed', 'ProxyRotated') THEN 'INFO' ELSE 'DEBUG' END
  AS level, {_SQL_LINE} AS line
FROM (SELECT *, 'It''s a company with quite a long name no ' || k AS nm FROM e)"""))
def log_lines(spark, d):
    return jobs.drain(spark, E.log_lines(_stream(spark, d)), "log").select("session_id", "level", "line")


_SQL_STATUS = """st AS (SELECT *, CASE kind WHEN 'SessionCreated' THEN 'created'
    WHEN 'PipelineStarted' THEN 'running' WHEN 'PipelineCompleted' THEN 'completed'
    WHEN 'PipelineFailed' THEN 'failed' END AS status FROM e)"""
_STATUS = with_ctes(_SQL_EVENTS, _SQL_STATUS, select="""
SELECT session_id, max_by(status, ts) AS status, coalesce(max_by(k, ts)
    FILTER (status = 'completed'), 0) AS total_leads,
  coalesce(max_by(CAST(k % 3 AS INTEGER), ts) FILTER (status = 'completed'), 0) AS hot_count,
  CASE WHEN max_by(status, ts) = 'failed' THEN max_by('error ' || k, ts)
    FILTER (status = 'failed') END AS error
FROM st WHERE status IS NOT NULL GROUP BY session_id""")
_STATUS_COLS = ["session_id", "status", "total_leads", "hot_count", "error"]


@query("r08_session_status", _STATUS)
def status(spark, d):
    return E.session_status(_events(spark, d)).select(*_STATUS_COLS)


@query("r08_session_status_stream", _STATUS)
def status_stream(spark, d):
    out = jobs.drain(spark, E.session_status(_stream(spark, d)), "status", "update")
    return jobs.latest_rows(out, "session_id").select(*_STATUS_COLS)


@query("r09_stage_funnel_stream", with_ctes(_SQL_EVENTS, select="SELECT session_id, " + ", ".join(
    f'count(*) FILTER (kind = \'{t}\') AS "{t}"' for t in E.FUNNEL)
    + " FROM e GROUP BY session_id"))
def funnel_stream(spark, d):
    out = jobs.drain(spark, E.funnel(_stream(spark, d)), "funnel", "update")
    return jobs.latest_rows(out, "session_id")


# Events come in six files of five days; some are one or two files behind.
_SQL_FED = f"""fed AS (SELECT *, least(5, (epoch(ts)::BIGINT - 1704067200) // 432000
    + CASE k % 20 WHEN 0 THEN 2 WHEN 10 THEN 1 ELSE 0 END) AS file FROM e),
newest AS (SELECT file, max(ts) AS newest FROM fed GROUP BY file),
passed AS (SELECT f.file, max(n.newest) - INTERVAL 1 DAY AS mark FROM newest f
  LEFT JOIN newest n ON n.file <= f.file - 2 GROUP BY f.file),
judged AS (SELECT fed.*, date_trunc('day', ts) AS day,
    coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late,
    coalesce(ts <= mark, false) AS behind FROM fed JOIN passed USING (file))"""


def _fed(spark, d) -> DataFrame:
    """The events as a stream of files that come one after the other."""
    path = fresh_path(spark, "feed")
    late = F.when(event_k() % 20 == 0, 2).when(event_k() % 20 == 10, 1).otherwise(0)
    raw = table(spark, d, "events")
    days = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 432000)
    raw = raw.withColumn("file", F.least(F.lit(5), days + late))
    schema = as_pipeline_events(raw).schema
    for i in range(6):
        # all tasks read and parse; one writes the file of this arrival
        as_pipeline_events(raw.filter(F.col("file") == i)).repartition(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@query("r09_funnel_windows", with_ctes(_SQL_EVENTS, _SQL_FED, select="SELECT session_id, "
       "strftime(day, '%Y-%m-%d') AS day, " + ", ".join(
           f'count(*) FILTER (kind = \'{t}\') AS "{t}"' for t in E.FUNNEL)
       + " FROM judged WHERE NOT late GROUP BY session_id, day "
       "HAVING day + INTERVAL 1 DAY <= (SELECT max(newest) - INTERVAL 1 DAY FROM newest)"))
def funnel_windows(spark, d):
    out = jobs.drain(spark, jobs.funnel_windows(_fed(spark, d), lateness="1 day"), "windows")
    return out.withColumn("day", F.date_format("window.start", "yyyy-MM-dd")).drop("window", "batch")


@query("r09_late_events", with_ctes(
    _SQL_EVENTS, _SQL_FED, select="SELECT event_id, kind AS event_type, file AS batch, late FROM judged"))
def late_events(spark, d):
    out = jobs.marked_late(spark, _fed(spark, d), "late", lateness="1 day")
    return out.select("event_id", "event_type", F.col("batch").cast("long").alias("batch"), "late")


@query("r08_status_event_time", with_ctes(
    _SQL_EVENTS, _SQL_FED, _SQL_STATUS.replace("FROM e)", "FROM judged WHERE NOT behind)"),
    select=_STATUS[_STATUS.rindex("SELECT session_id"):]))
def status_event_time(spark, d):
    with jobs.rocksdb(spark):
        out = jobs.drain(spark, jobs.session_states(_fed(spark, d), 365 * 86_400, "1 day"),
                         "states", "update")
    return jobs.status_of(out).select(*_STATUS_COLS)


@query("r10_first_seen_stream", """
WITH RECURSIVE keyed AS (SELECT user_id || '/'
    || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS url,
  epoch_us(ts) // 1000 AS ms FROM events),
seen(url, ms) AS (SELECT url, min(ms) FROM keyed GROUP BY url
  UNION ALL SELECT s.url, (SELECT min(k.ms) FROM keyed k WHERE k.url = s.url
    AND k.ms > s.ms + 86400000) AS nxt FROM seen s WHERE s.ms IS NOT NULL)
SELECT url, ms FROM seen WHERE ms IS NOT NULL""")
def first_seen_stream(spark, d):
    e = jobs.read_files(spark, d, "events.parquet")
    keyed = e.select(
        F.concat("user_id", F.lit("/"), event_k() % 5).alias("url"),
        F.col("ts").cast("timestamp").alias("timestamp"))
    with jobs.rocksdb(spark):
        out = jobs.drain(spark, jobs.first_seen(keyed), "first-seen")
    return out.select("url", F.unix_millis("timestamp").alias("ms"))
