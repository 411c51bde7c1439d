import datetime as dt

from leadloom import schemas
from leadloom.operators import companies as CO, store as ST
from leadloom.sources import files
from pyspark.sql import functions as F


def now():
    return F.to_timestamp(F.lit("2024-07-01 00:00:00"))


def test_company_upsert(spark):
    cols = ("domain string, company_name string, tech_stack array<string>, website string, "
            "updated_at timestamp, discovered_at timestamp")
    old = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame(
        [("a", "A", ["z", "b"], "w", old, old), ("b", "B", None, None, old, old)], cols)
    incoming = spark.createDataFrame(
        [(1, "a", None, ["c"], None), (2, "a", "A2", ["b"], None), (3, "c", "C", [], "x"),
         (4, "b", "B2", None, None)],
        "ordinal int, domain string, company_name string, tech_stack array<string>, "
        "website string")
    got = {r.domain: r for r in ST.upsert_companies(stored, incoming, now()).collect()}
    assert got["a"].company_name == "A2" and got["a"].website == "w"
    assert got["a"].tech_stack == ["b", "c", "z"]
    assert got["a"].updated_at == dt.datetime(2024, 7, 1) and got["a"].discovered_at == old
    assert got["b"].company_name == "B2" and got["b"].tech_stack is None
    assert got["c"].discovered_at == dt.datetime(2024, 7, 1)
    again = ST.upsert_companies(ST.upsert_companies(stored, incoming, now()), incoming, now())
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_lead_upsert_best_and_last(spark):
    cols = ("session_id string, domain string, company_name string, "
            "icp_relevance_score double")
    stored = spark.createDataFrame([("s", "a", "old", 0.9, dt.datetime(2024, 1, 1))],
                                   cols + ", created_at timestamp")
    incoming = spark.createDataFrame(
        [("s", "a", "x", 0.5, 1), ("s", "a", None, 0.4, 2), ("t", "a", "n", 0.1, 3)],
        cols + ", ordinal int")
    best = {r.session_id: r for r in ST.upsert_leads(stored, incoming, now()).collect()}
    last = {r.session_id: r for r in ST.upsert_leads(stored, incoming, now(), "last").collect()}
    assert (best["s"].company_name, best["s"].icp_relevance_score) == ("x", 0.5)
    # fields given as NULL replace too
    assert (last["s"].company_name, last["s"].icp_relevance_score) == (None, 0.4)
    assert best["s"].created_at == dt.datetime(2024, 1, 1) and len(best) == 2


def test_decision_makers(spark):
    cols = ("id long, domain string, title string, email string, linkedin_url string, "
            "full_name string, confidence double, session_id string")
    stored = spark.createDataFrame([
        (1, "a", "CTO", "c@a", None, "C", .1, "s0"), (2, "a", "CEO", None, "in/2", "E", .1, "s0"),
        (3, "a", "VP", None, None, "V", .1, "s0"), (4, "a", "Dev", None, None, "D", .1, "s0"),
        (5, "a", "Dev", None, "in/5", "D2", .1, "s0")], cols)
    incoming = spark.createDataFrame([
        (1, "a", "New title", "c@a", "in/9", "C2", .9, "s1"), (2, "a", "x", None, "in/2", "E2", .8, "s1"),
        (3, "a", "VP", None, None, "V2", .7, "s1"), (4, "a", "Dev", None, None, "D3", .6, "s1"),
        (5, "a", "CFO", "f@a", "in/2", "F", .5, "s1"), (6, "a", "COO", "o@a", None, "O", .5, "s1"),
        (7, "a", "COO", "o@a", None, "O2", .4, "s1"), (8, "b", "CTO", "c@a", None, "B", .3, "s1")],
        "ordinal int, domain string, title string, email string, linkedin_url string, "
        "full_name string, confidence double, session_id string")
    table, rejects = ST.upsert_decision_makers(stored, incoming)
    rows = {(r.domain, r.full_name): r for r in table.collect()}
    assert set(rows) == {("a", "C2"), ("a", "E2"), ("a", "V2"), ("a", "D"), ("a", "D2"),
                         ("a", "O2"), ("b", "B")}
    # identity stays, the other fields are taken over
    assert rows["a", "C2"].title == "CTO" and rows["a", "C2"].linkedin_url is None
    assert rows["a", "C2"].id == 1 and rows["a", "O2"].id is None
    assert {(r.full_name, r.reason) for r in rejects.collect()} == {
        ("D3", "ambiguous"), ("F", "duplicate link")}


def test_purge(spark):
    s = spark.createDataFrame([("1",), ("2",)], "id string")
    leads = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")],
                                  "session_id string, domain string")
    kept = ST.purge_sessions({"sessions": s, "leads": leads, "decision_makers": leads},
                             s.filter("id = '1'"))
    assert [r.id for r in kept["sessions"].collect()] == ["2"]
    assert {(r.session_id, r.domain) for r in kept["leads"].collect()} == {("2", "b"), (None, "c")}
    assert {(r.session_id, r.domain) for r in kept["decision_makers"].collect()} == {
        (None, "a"), ("2", "b"), (None, "c")}


def test_session_summary_does_not_multiply(spark):
    s = spark.createDataFrame([("1",), ("2",)], "id string")
    child = spark.createDataFrame([("1", 10.0), ("1", 5.5)], "session_id string, latency_ms double")
    rows = {r.id: r for r in ST.session_summary(s, child, child, child).collect()}
    assert (rows["1"].search_queries_issued, rows["1"].agent_runs, rows["1"].total_llm_ms) == (
        2, 2, 15.5)
    assert (rows["2"].urls_crawled, rows["2"].total_llm_ms) == (0, 0.0)


def test_checks(spark):
    df = spark.createDataFrame([("user", 0.5), ("bot", 2.0), (None, 0.0)],
                               "role string, score double")
    good, bad = ST.check_values(df, {"role": F.col("role").isin("user"),
                                     "score": F.col("score").between(0, 1)})
    assert good.count() == 1
    assert sorted(r.broken for r in bad.collect()) == [["role"], ["role", "score"]]
    keys = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x")],
                                 "domain string, email string")
    assert [(r.domain, r.copies) for r in ST.check_unique(keys, ["domain", "email"]).collect()] \
        == [("b", 2)]


def test_publish_keeps_old_versions_readable(spark, tmp_path):
    root = str(tmp_path / "t")
    ST.publish(spark, spark.range(3), root)
    first = ST.current(spark, root)
    ST.publish(spark, first.filter("id > 0"), root)
    assert first.count() == 3 and ST.current(spark, root).count() == 2


def test_append_uses_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "m")
    for i in range(2):
        files.append(spark.createDataFrame([("s", i)], "stage string, items_in long"),
                     "pipeline_metrics", path)
    back = files.read_stored(spark, "pipeline_metrics", path)
    assert back.schema == schemas.STORED_TABLES["pipeline_metrics"] and back.count() == 2


def test_empty_rates(spark):
    none = spark.createDataFrame([], "success boolean")
    assert ST.crawl_success_rate(none).head().success_rate == 0.0


def test_research_budget(spark):
    pages = spark.createDataFrame(
        [("d", i, f"u{i}", True, "x" * n) for i, n in enumerate([3000, 1500, 2000, 0, 1900, 1500])],
        "domain string, ordinal int, url string, success boolean, text_content string")
    r = CO.research_text(pages).head()
    parts = r.text_block.split("\n\n")
    assert [len(p.split("\n")[1]) for p in parts] == [2000, 1500, 2000, 1900, 600]
    assert parts[0].startswith("[PAGE: u0]\n")


def test_fallback_and_empty_profile(spark):
    pages = spark.createDataFrame(
        [("d", 2, "u2", True, "Late", (["b"],)), ("d", 1, "u1", True, "", (["a", "c"],)),
         ("d", 0, "u0", False, "Failed", (["z"],))],
        "domain string, ordinal int, url string, success boolean, title string, "
        "meta struct<tech_signals:array<string>>")
    r = CO.fallback_profile(pages).head()
    assert (r.company_name, r.tech_stack) == ("d", ["a", "b", "c"])
    e = CO.empty_profile(pages.select("domain").distinct()).head()
    assert (e.company_name, e.tech_stack) == ("d", [])


def test_json_leads_and_their_header(spark, tmp_path):
    leads = spark.createDataFrame(
        [("find labs", "a.co", "x"), ("find labs", "b.co", "y")],
        "query string, domain string, evidence string")
    header = files.leads_header(leads, F.lit("2024-01-01T00:00:00"), F.lit(12.34))
    files.write_leads_json(leads, f"{tmp_path}/leads", include_evidence=False, header=header)
    got = spark.read.json(f"{tmp_path}/leads")
    assert sorted(got.columns) == ["domain", "query"] and got.count() == 2
    top = spark.read.json(f"{tmp_path}/leads-header").collect()
    assert [(r.query, r.pipeline_ms, r.total_leads) for r in top] == [("find labs", 12.3, 2)]


def test_stages_are_counted_while_they_are_written(spark, tmp_path):
    """One evaluation per stage: an accumulator counts how often a row is made."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pages = spark.range(40).selectExpr("id", "id % 4 > 0 AS success", "id / 100 AS icp_relevance_score")
    pages = pages.repartition(3).mapInArrow(seen, pages.schema)
    crawl = ST.write_stage(pages, str(tmp_path / "crawl"), **ST.CRAWL_NUMBERS)
    usable = ST.write_stage(crawl.rows.filter("success"), str(tmp_path / "usable"), **ST.LEAD_NUMBERS)
    none = ST.write_stage(pages.limit(0), str(tmp_path / "none"), **ST.LEAD_NUMBERS, **ST.CRAWL_NUMBERS)
    rows = ST.stage_metrics(spark, [("crawl", crawl, usable, 10), ("none", usable, none, 0)])
    assert [tuple(r) for r in rows.collect()] == [(0, "crawl", 40, 30, 10), (1, "none", 30, 0, 0)]
    assert tuple(ST.run_summary(spark, none, crawl, crawl, usable).head()) == (0, 40, 40, 0.75, 30, 0.39)
    assert tuple(ST.run_summary(spark, none, none, none, none).head()) == (0, 0, 0, 0.0, 0, 0.0)
    assert made.value == 40 and crawl.rows.count() == 40
