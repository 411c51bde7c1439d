import json
import random

import pytest

from leadloom.operators import crawl as C, matching as M, results as R
from leadloom.sources import payloads as PL
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "query string, provider string, rank int, href string")


ROWS = [
    ("q1", "b", 1, "http://a.com/x?utm_source=f"), ("q1", "a", 3, "http://a.com/x/"),
    ("q1", "a", 5, "http://a.com/x#top"), ("q2", "c", 2, "http://a.com/y"),
    ("q0", "c", 9, "http://b.com/"), ("q1", "a", 1, "http://b.com"),
]


def test_merge_and_rank(spark):
    got = [(r.norm_url, r.href, r.provider, r.providers, r.mean_rank)
           for r in R.merge_and_rank(frame(spark, ROWS)).collect()]
    assert got == [
        ("http://a.com/x", "http://a.com/x/", "a", 2, 3.0),
        ("http://b.com", "http://b.com/", "c", 2, 5.0),
        ("http://a.com/y", "http://a.com/y", "c", 1, 2.0)]
    assert {r.norm_url for r in R.cross_provider_hits(frame(spark, ROWS)).collect()} == {
        "http://a.com/x", "http://b.com"}


def test_first_does_not_depend_on_order(spark):
    base = frame(spark, ROWS)
    want = sorted(map(tuple, R.first_per_url(base).collect()))
    for n in (1, 3, 7):
        assert sorted(map(tuple, R.first_per_url(
            base.orderBy(F.desc("href")).repartition(n)).collect())) == want


def test_hot_url(spark):
    rows = spark.range(9_000).select(
        F.lit("q").alias("query"), F.concat(F.lit("p"), F.col("id") % 5).alias("provider"),
        (F.col("id") % 10 + 1).cast("int").alias("rank"),
        F.when(F.col("id") % 3 == 0, "http://hot.com/").otherwise(
            F.concat(F.lit("http://h/"), "id")).alias("href"))
    top = R.merge_and_rank(rows).head()
    assert (top.norm_url, top.providers, top.hits) == ("http://hot.com", 5, 3000)


def test_empty_calls(spark):
    empty = spark.createDataFrame(
        [], "provider string, latency_ms double, success boolean, total_results int")
    r = R.session_totals(empty).head()
    assert (r.success_rate, r.total_latency_ms, r.slowest, r.fastest) == (0.0, 0.0, None, None)
    assert R.provider_summary(empty).count() == 0


def raw(spark, provider, payload, kind="web", cap=10):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame(
        [(provider, "q", kind, cap, text)],
        "provider string, query string, search_type string, max_results int, payload string")


def test_serper_running_rank_and_defaults(spark):
    rows = PL.normalize_payloads(raw(spark, "serper", {"organic": [
        {"link": "http://m.youtube.com/1"}, {"link": "http://a.com", "title": " A "},
        {"link": "http://b.com", "position": 9}, {}]}), "serper").orderBy("rank").collect()
    assert [(r.rank, r.href, r.title) for r in rows] == [
        (1, "http://a.com", "A"), (3, "", ""), (9, "http://b.com", "")]
    assert rows[0].metadata.answer_box == "{}" and rows[0].metadata.site_links == []
    assert rows[0].fetched_at is not None


@pytest.mark.parametrize("payload", ["not json", "[]", "{}", "", '{"organic": null}'])
def test_unusable_payloads_give_no_rows(spark, payload):
    assert PL.normalize_payloads(raw(spark, "serper", payload), "serper").count() == 0


def test_google_cap_counts_kept_items(spark):
    items = [{"link": "http://youtube.com/1"}] + [
        {"link": f"http://a.com/{i}", "pagemap": {"cse_image": [{"src": f"i{i}"}]}}
        for i in range(4)]
    rows = PL.normalize_payloads(
        raw(spark, "google", {"items": items}, cap=2), "google").collect()
    assert [(r.rank, r.metadata.image_url) for r in rows] == [(2, "i0"), (3, "i1")]


def test_unknown_provider_names_the_choices(spark):
    with pytest.raises(ValueError, match="bing.*serper"):
        PL.normalize_payloads(raw(spark, "x", "{}"), "x")


def expand_by_hand(urls, n, paths):
    from urllib.parse import urljoin, urlparse

    out, seen = [], {}
    for url in urls:
        host = urlparse(url).netloc
        if seen.get(host, 0) < n:
            out.append(url)
            seen[host] = seen.get(host, 0) + 1
        for p in paths:
            target = urljoin(f"https://{host}", p)
            if seen.get(host, 0) < n and target != url and target not in out:
                out.append(target)
                seen[host] = seen.get(host, 0) + 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
def test_expand_domains_by_hand(spark, n):
    urls = ["https://a.com/about", "http://b.com/1", "https://a.com/x", "https://a.com/",
            "http://b.com/2", "http://b.com/3", "https://c.com/careers"] + [
            f"http://hot.com/{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "ordinal int, url string")
    got = C.expand_domains(df, n).orderBy("ordinal", "slot").collect()
    assert [r.url for r in got] == expand_by_hand(urls, n, ["/", "/about", "/careers",
                                                            "/technology"])
    capped = C.expand_domains(df, n, max_urls=4).orderBy("ordinal", "slot").collect()
    assert [r.url for r in capped] == [r.url for r in got][:4]


def directory_by_hand(companies, query, k):
    tokens = {t for t in query.lower().split() if len(t) > 2}
    scored = []
    for c in companies:
        name, one = c["name"].lower(), c["one_liner"].lower()
        every = f"{name} {one} {c['long_description'].lower()} {' '.join(c['tags']).lower()}"
        score = sum(4 if t in name else 2 if t in one else 1 if t in every else 0 for t in tokens)
        score += bool(c["is_hiring"]) + (c["status"] == "Active")
        if score:
            scored.append((-score, c["slug"]))
    return [(s, -x) for x, s in sorted(scored)[:k]]


@pytest.mark.parametrize("per_pass", [2, 100, 1 << 20])
def test_directory_match_by_hand(spark, per_pass):
    words = ["data", "cloud", "health", "pay", "robot", "ai"]
    companies = [dict(
        name=f"{words[i % 6]}{i}", slug=f"s{i:02}", url="", one_liner=words[(i * 5 + 1) % 6],
        long_description=words[(i * 7) % 6] + "ware", tags=[words[(i // 6) % 6]], batch="W1",
        team_size="1", location="", status="Active" if i % 3 else "Dead", is_hiring=i % 4 == 0)
        for i in range(40)]
    df = spark.createDataFrame(companies, "name string, slug string, url string, "
                               "one_liner string, long_description string, tags array<string>, "
                               "batch string, team_size string, location string, status string, "
                               "is_hiring boolean")
    asked = ["Data cloud", "zzz", "pay health robot", "ai", "of"]
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    for k in (3, 12):
        got = M.directory_match(df, q, k, key="query", shard_bytes=per_pass)
        by_query = {}
        for r in got.orderBy("rank").collect():
            by_query.setdefault(r.query, []).append((r.slug, r.score))
        assert by_query == {x: directory_by_hand(companies, x, k) for x in asked}


def test_job_match_shards_agree(spark):
    posts = spark.createDataFrame(
        [("a", 1, "Data engineer", "spark"), ("a", 2, "Chef", "data"), ("b", 3, "Chef", "pans"),
         ("c", 4, "SRE", "On call data")],
        "slug string, posting_id int, title string, content string")
    q = spark.createDataFrame([(1, "data ENGINEER"), (2, "pilot")], "query_id int, query string")
    text = F.concat("title", F.lit(" "), "content")
    rows = [{r.slug: (r.relevant, r.total_postings, r.hiring_roles, r.body) for r in
             M.job_match(posts, q, text, "title", shard_bytes=n).collect()} for n in (1, 1 << 20)]
    assert rows[0] == rows[1] == {
        "a": (2, 2, ["Data engineer", "Chef"], "Data engineer, Chef"),
        "c": (1, 1, ["SRE"], "SRE")}


def test_matching_brings_no_queries_to_the_driver(spark, monkeypatch):
    """Many shards: no rows are collected for the plan, which stays one scan however many they are."""
    from pyspark.sql import DataFrame

    df = spark.createDataFrame(
        [(f"data{i}", f"s{i:02}", "", "cloud", "", ["x"], "W1", "1", "", "Active", True)
         for i in range(20)], "name string, slug string, url string, one_liner string, "
        "long_description string, tags array<string>, batch string, team_size string, "
        "location string, status string, is_hiring boolean")
    q = spark.range(50).selectExpr("id AS query_id", "concat('data', id, ' of cloud') AS query")
    posts = spark.range(300).selectExpr("'hot' AS slug", "id AS posting_id", "'r' AS title",
                                        "concat('cloud data', id % 60) AS content")
    real = DataFrame.collect

    def refused(self):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "collect", refused)
    best = M.directory_match(df, q, 2, shard_bytes=5)
    jobs = M.job_match(posts, q, F.col("content"), "title", shard_bytes=5)
    for out in (best, jobs):
        assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString().replace(
            "Union false, false", "", 1)
    monkeypatch.setattr(DataFrame, "collect", real)
    top = {r.query_id: (r.slug, r.score) for r in best.filter("rank = 1").collect()}
    assert top == {i: (f"s{i:02}", 8) if i in range(10, 20) else
                   ("s00" if i > 19 or not i else f"s{i:02}", 4 if i > 19 else 8)
                   for i in range(50)}
    assert {(r.query_id, r.slug, r.relevant, r.total_postings, len(r.hiring_roles))
            for r in jobs.collect()} == {(i, "hot", 300, 300, 5) for i in range(50)}


def company_rows(rng, n):
    words = ["data", "cloud", "health", "pay", "robot", "ai", "metadata", "of", "x" * 400, "düne"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
    return [dict(name=some() + f" n{i % 7}", slug=f"s{i:04}", url="", one_liner=some(),
                 long_description="every " + some(), tags=[some()], batch="", team_size="",
                 location="", status=rng.choice(["Active", "Dead", None]),
                 is_hiring=rng.choice([True, False, None])) for i in range(n)]


COMPANY = ("name string, slug string, url string, one_liner string, long_description string, "
           "tags array<string>, batch string, team_size string, location string, status string, "
           "is_hiring boolean")


@pytest.mark.parametrize("k", [1, 5, 40])
def test_directory_lists_stop_early_without_loss(spark, k):
    """Parts of words, one word in all texts, ties, equal word sets, null fields, no words."""
    rng = random.Random(k)
    companies = company_rows(rng, 90)
    asked = ["every", "data ata every", "every data ata", "cloud ai every pay", "dün every robot", "of",
             "", "every xxx", "zzz every", "n3 data", "the data every cloud health robot"]
    df = spark.createDataFrame(companies, COMPANY)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    by_query = {}
    for r in M.directory_match(df, q, k, shard_bytes=500).orderBy("rank").collect():
        by_query.setdefault(r.query_id, []).append((r.slug, r.score))
    for c in companies:
        c["tags"] = c["tags"] or []
    assert by_query == {i: directory_by_hand(companies, x, k) for i, x in enumerate(asked)}


def test_jobs_with_one_word_in_all_texts(spark):
    rng = random.Random(3)
    posts = [(f"c{rng.randrange(9)}", i, rng.choice(["SRE", "Chef", None]),
              "all " + " ".join(rng.choice("abcdef") for _ in range(3))) for i in range(200)]
    posts += [(None, 900, "lost", "all a"), ("c1", 901, "void", None)]
    asked = ["all", "a zz", "b c", "zz", "", "A"]
    df = spark.createDataFrame(posts, "slug string, posting_id int, title string, content string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = {}
    for i, x in enumerate(asked):
        for slug, p, title, content in sorted(posts, key=lambda r: r[1]):
            if slug and content and set(x.lower().split()) & set(content.split()):
                relevant, roles = want.get((i, slug), (0, []))
                want[i, slug] = relevant + 1, (roles + [title])[:5]
    out = M.job_match(df, q, F.col("content"), "title", shard_bytes=300)
    got = {(r.query_id, r.slug): (r.relevant, r.hiring_roles) for r in out.collect()}
    assert got == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    few = M.job_match(df, q, F.col("content"), "title", max_slugs=2, shard_bytes=300).collect()
    first = {key for i in range(len(asked)) for key in sorted(k for k in want if k[0] == i)[:2]}
    assert {(r.query_id, r.slug): (r.relevant, r.hiring_roles) for r in few} == {
        key: want[key] for key in first}


def test_matching_shuffles_texts_once(spark):
    """Three sizes of queries and texts: what comes out of the deal grows as their sum."""
    moved = []
    for times in (1, 2, 4):
        df = spark.createDataFrame(company_rows(random.Random(1), 50 * times), COMPANY)
        sets = M.word_sets(spark.range(40 * times).selectExpr(
            "id AS query_id", "concat('word', id, ' data') AS query"), "query_id", "query", 3)
        texts = df.select(F.col("slug").alias("_c"))
        moved.append(M._met(texts, sets, "query_id", ["_c"], 4).count())
    assert moved == [50 * t + 4 * 40 * t for t in (1, 2, 4)]
