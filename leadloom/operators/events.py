"""Pipeline events: parsing, counters, histograms, session folds. Batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import schemas
from leadloom.functions.numbers import rounded_avg

# the payload fields that counters read, whatever the event type
_COUNTED = (
    "result_count int, latency_ms double, success boolean, from_cache boolean, tier string, "
    "pipeline_ms double, provider string, cache_type string, error string, total_leads int, "
    "hot_count int, warm_count int, cold_count int"
)

# Events that are logged at INFO, the others at DEBUG
INFO_EVENTS = [
    "PipelineStarted", "PipelineCompleted", "PipelineFailed", "IcpParsed", "QueryPlanned",
    "LeadScored", "LeadEnriched", "SessionCreated", "SessionResumed", "ProxyFailed",
    "ProxyRotated",
]

# Upper bounds of latency buckets in seconds (the usual client defaults)
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

FUNNEL = ["PipelineStarted", "QueryPlanned", "SearchCompleted", "CrawlCompleted", "LeadEnriched",
          "LeadScored", "PipelineCompleted"]


#: The events that tell a session's status.
STATUS_EVENTS = ["SessionCreated", "PipelineStarted", "PipelineCompleted", "PipelineFailed"]


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Event rows from JSON text lines, in either envelope, with or without ``data:`` prefix.

    Lines that hold no event (end marks, broken text) are left out.
    """
    body = F.regexp_replace(column, r"^data:\s*", "")
    e = raw.select(F.from_json(body, "type string, event_type string, data string").alias("e"))
    data = F.col("e.data")
    return e.filter(data.isNotNull()).select(
        F.coalesce("e.event_type", "e.type").alias("event_type"),
        F.get_json_object(data, "$.session_id").alias("session_id"),
        F.try_to_timestamp(F.get_json_object(data, "$.timestamp")).alias("timestamp"),
        data.alias("payload"))


def typed(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with their payload fields as columns."""
    if event_type not in schemas.EVENT_FIELDS:
        raise ValueError(f"unknown event type {event_type!r}, choose one of "
                         f"{sorted(schemas.EVENT_FIELDS)}")
    return events.filter(F.col("event_type") == event_type).select(
        "session_id", "timestamp",
        F.from_json("payload", schemas.EVENT_FIELDS[event_type]).alias("p")
    ).select("session_id", "timestamp", "p.*")


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    return events.filter(F.col("event_type").isin(types))


def of_session(events: DataFrame, session_id: str) -> DataFrame:
    """Events of one session; events that belong to no session pass as well."""
    return events.filter(F.col("session_id").isNull() | (F.col("session_id") == session_id))


def hot_leads(events: DataFrame) -> DataFrame:
    return typed(events, "LeadScored").filter("tier = 'hot'")


def _counted(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", _COUNTED))


def metrics(events: DataFrame, *keys: str) -> DataFrame:
    """Counters over the event types, one row (or one per key)."""
    is_a = lambda t: F.col("event_type") == t
    p = lambda c: F.col("p")[c]
    n = lambda name, cond: F.count_if(cond).alias(name)
    crawled, scored = is_a("CrawlCompleted"), is_a("LeadScored")
    aggs = [
        n("search_calls", is_a("SearchCompleted")),
        F.coalesce(F.sum(F.when(is_a("SearchCompleted"), p("result_count"))), F.lit(0))
        .alias("search_results"),
        n("crawl_attempts", crawled), n("crawl_successes", crawled & p("success")),
        n("crawl_from_cache", crawled & p("from_cache")),
        n("crawl_failures", is_a("CrawlFailed")), n("leads_enriched", is_a("LeadEnriched")),
        n("leads_scored", scored),
        *[n(f"leads_{t}", scored & (p("tier") == t)) for t in ("hot", "warm", "cold")],
        n("proxy_rotations", is_a("ProxyRotated")), n("proxy_failures", is_a("ProxyFailed")),
        n("pipeline_runs", is_a("PipelineCompleted")),
        F.coalesce(rounded_avg(F.when(is_a("PipelineCompleted"), p("pipeline_ms")), 1),
                   F.lit(0.0)).alias("avg_pipeline_ms"),
    ]
    e = _counted(events)
    out = e.groupBy(*keys).agg(*aggs) if keys else e.agg(*aggs)
    return out.withColumn("crawl_success_rate", F.round(
        F.col("crawl_successes") / F.greatest(F.col("crawl_attempts"), F.lit(1)), 3))


def _bucket(seconds: Column) -> Column:
    """Upper bound of the latency bucket as text."""
    below = F.size(F.filter(F.lit(LATENCY_BUCKETS), lambda b: b < seconds))
    return F.get(F.lit([*map(str, LATENCY_BUCKETS), "+Inf"]), below)


def histograms(events: DataFrame) -> DataFrame:
    """Counter and histogram rows (metric, label, bucket, count)."""
    names = {
        "LeadScored": "leads_total", "CrawlCompleted": "crawl_latency_seconds",
        "SearchCompleted": "search_latency_seconds", "PipelineCompleted": "pipeline_runs_total",
        "CacheHit": "cache_hits_total",
    }
    kind = F.col("event_type")
    metric = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind]
    label = F.when(kind == "LeadScored", F.col("p.tier")).when(
        kind == "SearchCompleted", F.col("p.provider")).when(
        kind == "CacheHit", F.col("p.cache_type")).otherwise("")
    timed = kind.isin("CrawlCompleted", "SearchCompleted")
    from_cache = (kind == "CrawlCompleted") & F.coalesce(F.col("p.from_cache"), F.lit(False))
    return _counted(of_types(events, list(names))).filter(~from_cache).groupBy(
        metric.alias("metric"), label.alias("label"),
        F.when(timed, _bucket(F.col("p.latency_ms") / 1000)).otherwise("").alias("bucket"),
    ).agg(F.count("*").alias("count"))


def cache_hit_rate(events: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("event_type") == "CacheHit")
    return _counted(of_types(events, ["CacheHit", "CacheMiss"])).groupBy(
        F.col("p.cache_type").alias("cache_type")).agg(
        hit.alias("hits"), (F.count("*") - hit).alias("misses"),
        F.round(hit / F.count("*"), 3).alias("hit_rate"))


def _quoted(s: Column) -> Column:
    """Text in quotes: single ones unless the text holds only those."""
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _shown(values: Column, field: Column) -> Column:
    """``name=value`` as a log line shows it, long values cut to 40 characters."""
    raw, kind = values[field["name"]], field["kind"]
    listed = F.replace(F.replace(raw, F.lit('","'), F.lit("', '")), F.lit('"'), F.lit("'"))
    text = F.when(kind == "boolean", F.initcap(raw)).when(
        kind.startswith("array"), listed).otherwise(raw)
    value = F.when(F.length(text) > 40, _quoted(F.substring(text, 1, 40))).when(
        kind == "string", _quoted(text)).otherwise(text)
    return F.concat(field["name"], F.lit("="), F.coalesce(value, F.lit("None")))


def _first_fields() -> Column:
    """Map event type -> its first five fields in declared order."""
    entries = []
    for name, ddl in schemas.EVENT_FIELDS.items():
        fields = [tuple(f.strip().split(" ", 1)) for f in ddl.split(",")]
        if name != "MemoryEvicted":
            fields.insert(0, ("session_id", "string"))
        entries += [F.lit(name), F.array(*[
            F.struct(F.lit(f).alias("name"), F.lit(k).alias("kind")) for f, k in fields[:5]])]
    return F.create_map(*entries)


def log_lines(events: DataFrame) -> DataFrame:
    """One text line per event: level by type, at most five fields."""
    level = F.when(F.col("event_type").isin(INFO_EVENTS), "INFO").otherwise("DEBUG")
    values = F.from_json("payload", "map<string,string>")
    shown = F.array_join(F.transform(
        F.col("_fields"), lambda f: _shown(F.col("_values"), f)), ", ")
    return events.withColumns({
        "_values": values, "_fields": _first_fields()[F.col("event_type")]}).select(
        "timestamp", "session_id", level.alias("level"), F.concat(
            F.lit("[event] "), "event_type", F.lit(" {"), shown, F.lit("}")).alias("line"))


def session_status(events: DataFrame) -> DataFrame:
    """Status of each session by its latest status event, with the counters of a finished run."""
    status = F.when(F.col("event_type") == "SessionCreated", "created").when(
        F.col("event_type") == "PipelineStarted", "running").when(
        F.col("event_type") == "PipelineCompleted", "completed").when(
        F.col("event_type") == "PipelineFailed", "failed")
    e = _counted(events).withColumn("status", status).filter("status IS NOT NULL")
    at = F.struct("timestamp", "event_type")
    done = F.when(F.col("status") == "completed", F.struct(
        F.col("p.total_leads"), F.col("p.hot_count"), F.col("p.warm_count"),
        F.col("p.cold_count")))
    return e.groupBy("session_id").agg(
        F.max_by("status", at).alias("status"), F.max("timestamp").alias("updated_at"),
        F.max(F.when(F.col("status") == "completed", F.col("timestamp"))).alias("completed_at"),
        F.max_by(done, F.when(done.isNotNull(), at)).alias("c"),
        F.max_by(F.col("p.error"), F.when(F.col("status") == "failed", at)).alias("last_error"),
    ).select(
        "session_id", "status", "updated_at", "completed_at",
        *[F.coalesce(F.col(f"c.{n}"), F.lit(0)).alias(n)
          for n in ("total_leads", "hot_count", "warm_count", "cold_count")],
        F.when(F.col("status") == "failed", F.col("last_error")).alias("error"))


def funnel(events: DataFrame, *more: Column) -> DataFrame:
    """Events per stage and session (and ``more`` keys)."""
    return events.groupBy("session_id", *more).agg(*[
        F.count_if(F.col("event_type") == t).alias(t) for t in FUNNEL])
