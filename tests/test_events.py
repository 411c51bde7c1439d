import datetime as dt
import json

from leadloom.operators import events as E
from leadloom.streaming import jobs
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows of (type, session, minute, payload)"""
    return spark.createDataFrame(
        [(t, s, T0 + dt.timedelta(minutes=m), json.dumps({"session_id": s, **p}))
         for t, s, m, p in rows],
        "event_type string, session_id string, timestamp timestamp, payload string")


ROWS = [
    ("SessionCreated", "a", 0, {"query": "q"}), ("PipelineStarted", "a", 1, {}),
    ("PipelineCompleted", "a", 5, {"total_leads": 3, "hot_count": 1, "pipeline_ms": 10.25}),
    ("PipelineCompleted", "a", 2, {"total_leads": 9, "hot_count": 9, "pipeline_ms": 10.0}),
    ("SessionCreated", "b", 0, {}), ("PipelineFailed", "b", 3, {"error": "boom"}),
    ("CrawlCompleted", "b", 2, {"success": True, "from_cache": True, "latency_ms": 4.0}),
    ("CrawlCompleted", "b", 2, {"success": False, "latency_ms": 5.0}),
    ("LeadScored", "a", 4, {"tier": "hot", "domain": "d"}),
    ("LeadScored", "a", 4, {"tier": "odd"}), ("CrawlFailed", "b", 4, {"error": "x"}),
]


def test_metrics_and_empty_metrics(spark):
    m = E.metrics(frame(spark, ROWS)).head()
    assert (m.crawl_attempts, m.crawl_successes, m.crawl_from_cache) == (2, 1, 1)
    assert (m.leads_scored, m.leads_hot, m.leads_cold) == (2, 1, 0)
    assert (m.avg_pipeline_ms, m.crawl_success_rate) == (10.1, 0.5)
    e = E.metrics(frame(spark, ROWS).limit(0)).head()
    assert (e.search_results, e.avg_pipeline_ms, e.crawl_success_rate) == (0, 0.0, 0.0)


def test_session_status_takes_the_latest(spark):
    got = {r.session_id: r for r in E.session_status(frame(spark, ROWS)).collect()}
    assert (got["a"].status, got["a"].total_leads, got["a"].hot_count) == ("completed", 3, 1)
    assert (got["b"].status, got["b"].error, got["b"].total_leads) == ("failed", "boom", 0)


def test_log_lines(spark):
    rows = [
        ("LeadScored", "s", 0, {"domain": "d", "company_name": "It's " + "x" * 50,
                                "tier": "hot", "icp_score": 0.5, "llm_model": "m"}),
        ("IcpParsed", "s", 0, {"query": 'say "hi"', "confidence": 0.3, "industries": ["a", "b"],
                               "technologies": []}),
        ("CrawlStarted", "s", 0, {"url": "u", "crawler_type": "r", "using_proxy": False}),
        ("MemoryEvicted", None, 0, {"cache_type": "page", "key": "k", "reason": "lru"}),
    ]
    got = {r.line.split()[1]: (r.level, r.line) for r in E.log_lines(frame(spark, rows)).collect()}
    assert got["LeadScored"] == ("INFO", "[event] LeadScored {session_id='s', domain='d', "
                                 "company_name=\"It's " + "x" * 35 + "\", tier='hot', "
                                 "icp_score=0.5}")
    assert got["IcpParsed"][1] == (
        "[event] IcpParsed {session_id='s', query='say \"hi\"', confidence=0.3, "
        "industries=['a', 'b'], technologies=[]}")
    assert got["CrawlStarted"] == (
        "DEBUG", "[event] CrawlStarted {session_id='s', url='u', crawler_type='r', "
        "using_proxy=False}")
    assert got["MemoryEvicted"][1] == (
        "[event] MemoryEvicted {cache_type='page', key='k', reason='lru'}")


def test_parse_both_envelopes(spark):
    data = {"session_id": "s", "url": "u", "timestamp": "2024-01-01T00:00:00+00:00"}
    lines = ["data: " + json.dumps({"type": "CrawlStarted", "data": data}),
             json.dumps({"event_type": "CrawlFailed", "data": data}),
             'data: {"type":"done"}', "junk", ""]
    rows = E.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.event_type, r.session_id) for r in rows] == [
        ("CrawlStarted", "s"), ("CrawlFailed", "s")]
    assert E.typed(frame(spark, ROWS), "PipelineFailed").head().error == "boom"


def test_session_filter_lets_global_events_pass(spark):
    rows = ROWS + [("MemoryEvicted", None, 0, {"key": "k"})]
    got = E.of_session(frame(spark, rows), "a")
    assert {r.session_id for r in got.collect()} == {"a", None}


def in_pieces(spark, tmp_path, rows, n):
    for i in range(n):
        frame(spark, rows[i::n]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}.parquet"))
    schema = frame(spark, rows).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in/*.parquet"))


def test_streams_in_pieces_equal_batch(spark, tmp_path):
    stream = in_pieces(spark, tmp_path, ROWS, 3)
    batch = frame(spark, ROWS)
    status = jobs.latest_rows(
        jobs.drain(spark, E.session_status(stream), "status", "update"), "session_id")
    want = E.session_status(batch)
    assert sorted(map(str, status.select(want.columns).collect())) == \
        sorted(map(str, want.collect()))
    metrics = jobs.last_batch(jobs.drain(spark, E.metrics(stream), "metrics", "complete"))
    assert metrics.head() == E.metrics(batch).head()
    funnel = jobs.latest_rows(
        jobs.drain(spark, E.funnel(stream), "funnel", "update"), "session_id")
    assert sorted(map(str, funnel.collect())) == sorted(map(str, E.funnel(batch).collect()))


def test_seen_again_within_the_time_to_live(spark, tmp_path):
    minute = [("k", 0), ("k", 30), ("x", 31), ("k", 60), ("k", 61), ("k", 90), ("k", 1500),
              ("x", 4000), ("k", 4000), ("k", 4030)]
    for i, (k, m) in enumerate(minute):
        spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m))],
                              "url string, timestamp timestamp").coalesce(1).write.parquet(
            str(tmp_path / f"in/{i}.parquet"))
    stream = spark.readStream.schema("url string, timestamp timestamp").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*.parquet"))
    with jobs.rocksdb(spark):
        out = jobs.drain(spark, jobs.first_seen(stream, ttl_seconds=3600), "seen").collect()
    got = sorted((r.url, int((r.timestamp - T0).total_seconds() // 60)) for r in out)
    assert got == [("k", 0), ("k", 61), ("k", 1500), ("k", 4000), ("x", 31), ("x", 4000)]


def fed(spark, tmp_path, batches):
    """A stream of files, one a batch; rows of (type, session, minute, payload)."""
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"fed/{i}.parquet"))
    return spark.readStream.schema(frame(spark, ROWS).schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "fed/*.parquet"))


def test_late_events_and_windows_make_up_all_events(spark, tmp_path):
    hour = 60
    batches = [[("LeadScored", "a", m, {})] for m in (0, 3 * hour, 9 * hour)]
    batches += [[("LeadScored", "a", 10, {}), ("CrawlCompleted", "a", 9 * hour + 1, {}),
                 ("LeadScored", "b", 20 * hour, {})],
                [("LeadScored", "a", 8 * hour, {}), ("LeadScored", "b", 20 * hour + 1, {})],
                [("LeadScored", "b", 40 * hour, {}), ("LeadScored", "a", 11, {})]]
    stream = fed(spark, tmp_path, batches)
    marked = jobs.marked_late(spark, stream, "late", "1 hour", "1 hour")
    late = sorted((r.session_id, int((r.timestamp - T0).total_seconds() // 60))
                  for r in marked.filter("late").collect())
    assert late == [("a", 10), ("a", 11)] and marked.count() == sum(map(len, batches))

    q = jobs.start(jobs.funnel_windows(stream, "1 hour", "1 hour"), str(tmp_path / "windows"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "windows/out"))
    given = {(r.session_id, int((r.window.start - T0).total_seconds() // 3600)): r.LeadScored
             for r in out.collect()}
    # The last window of all waits for a watermark that never comes.
    assert given == {("a", 0): 1, ("a", 3): 1, ("a", 9): 1, ("a", 8): 1, ("b", 20): 2}
    held = jobs.state_rows(q)
    assert max(held) > held[-1] == 1


def test_quiet_sessions_leave_the_state(spark, tmp_path):
    day = 1440
    batches = [[("SessionCreated", "a", 0, {}), ("PipelineStarted", "b", 5, {})],
               [("PipelineCompleted", "a", 10, {"total_leads": 4}), ("PipelineCompleted", "a", 9, {"total_leads": 9})],
               [("PipelineFailed", "c", 2 * day, {"error": "x"})], [("PipelineStarted", "d", 9 * day, {})],
               [("CrawlFailed", "d", 9 * day + 1, {})], [("PipelineCompleted", "b", 20 * day, {"hot_count": 2})],
               [("PipelineStarted", "e", 20 * day + 5, {})]]
    with jobs.rocksdb(spark):
        q = jobs.start(jobs.session_states(fed(spark, tmp_path, batches), 5 * 86_400), str(tmp_path / "s"), "update")
        q.awaitTermination()
    path = str(tmp_path / "s/out")
    got = {r.session_id: (r.status, r.total_leads, r.hot_count, r.error, r.expired)
           for r in jobs.status_of(spark.read.option("basePath", path).parquet(path)).collect()}
    assert got == {"a": ("completed", 4, 0, None, True), "b": ("completed", 0, 2, None, False),
                   "c": ("failed", 0, 0, "x", True), "d": ("running", 0, 0, None, True),
                   "e": ("running", 0, 0, None, False)}
    held = jobs.state_rows(q)
    assert max(held) > held[-1]


def test_state_holds_buckets_of_sessions(spark, tmp_path):
    batches = [[("SessionCreated", f"s{i}", i, {}) for i in range(40)],
               [("PipelineStarted", f"s{i}", 50 + i, {}) for i in range(0, 40, 2)]]
    with jobs.rocksdb(spark):
        q = jobs.start(jobs.session_states(fed(spark, tmp_path, batches), buckets=4), str(tmp_path / "s"), "update")
        q.awaitTermination()
    path = str(tmp_path / "s/out")
    got = {r.session_id: r.status
           for r in jobs.status_of(spark.read.option("basePath", path).parquet(path)).collect()}
    assert got == {f"s{i}": "created" if i % 2 else "running" for i in range(40)}
    assert jobs.state_rows(q)[-1] < 40
