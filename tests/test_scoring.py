import random

from leadloom.functions import lexicons as lx
from leadloom.operators import discovery as D, scoring as S
from leadloom.plans.inputs import profiles
from leadloom.session import fresh_path
from pyspark.sql import functions as F

def now():
    return F.to_timestamp(F.lit("2024-07-01 00:00:00+00:00"))

VOCAB = ["thering", "avec", "google", "blest", "dans", "edthat", "nicht", "leaux", "startup",
         "sre", "cto", "data engineer", "vendor", "expansion", "enterprise", "para", "ention",
         "unge", "founded", "k8s", "word", "more"]


def some_pages(n=60, seed=3):
    rnd = random.Random(seed)
    dates = [None, "2024-06-20T00:00:00Z", "2024-05-01T00:00:00Z", "2022-01-01T00:00:00Z",
             "2024-06-20"]
    return [(i, f"http://h{i % 7}.com/{i}", f"h{i % 7}.com",
             " ".join(rnd.choices(VOCAB, k=rnd.randint(0, 12))).title(), rnd.choice(dates))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "n int, url string, domain string, text_content string, published_date string")


def score_by_hand(text, date, p):
    """Composite of one page and one profile, step by step."""
    t = text.lower()
    hits = lambda ws: {w for w in ws if w in t}
    techs = {x.lower() for x in p.technologies.required + p.technologies.preferred}
    inds = {x.lower() for x in p.target_company.industries}
    locs = {x.lower() for x in p.locations.countries + p.locations.cities + p.locations.regions}
    found = hits(lx.TECH_KEYWORDS) | hits(techs)
    tech = min(1, len(found & techs) / len(techs)) if techs else 0.5
    hiring = min(1, len(hits(lx.HIRING_KEYWORDS)) / 5)
    got = total = 0.0
    if inds:
        total += 0.5
        got += 0.5 * len(hits(inds)) / len(inds)
    if locs:
        total += 0.3
        got += 0.3 if hits(locs) else 0
    if p.target_company.size:
        total += 0.2
        got += 0.2 if any(hits(lx.SIZE_WORDS[s]) for s in p.target_company.size) else 0
    profile = min(1, got / total) if total else 0.5
    w = ((.5, .3, .2) if p.technologies.required else (.25, .5, .25) if p.signals.hiring_signals
         else (.3, .25, .45) if inds else (.4, .35, .25))
    fresh = {None: .85, "2024-06-20T00:00:00Z": 1, "2024-05-01T00:00:00Z": .9,
             "2022-01-01T00:00:00Z": .5, "2024-06-20": .85}[date]
    return min(1.0, (w[0] * tech + w[1] * hiring + w[2] * profile) * fresh)


def test_scores_by_hand(spark):
    rows = some_pages()
    icps = profiles(spark)
    got = {(r.n, r.icp_id): r.composite
           for r in S.enrich(frame(spark, rows), icps, now(), 0.0).collect()}
    want = {(n, p.icp_id): score_by_hand(text, date, p)
            for n, _, _, text, date in rows for p in icps.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def key(r):
    return (r.n, r.icp_id, r.icp_relevance_score, tuple(r.tech_stack), tuple(r.evidence))


def test_passes_and_partitions_do_not_matter(spark):
    df, icps = frame(spark, some_pages()), profiles(spark)
    base = sorted(map(key, S.enrich(df, icps, now()).collect()))
    for how in (dict(block=1), dict(block=1, broadcast_bytes=0), dict(dictionary_bytes=300)):
        assert base == sorted(map(key, S.enrich(df, icps, now(), **how).collect()))
    assert base == sorted(map(key, S.enrich(df.repartition(7), icps, now()).collect()))


def test_min_score_is_inclusive(spark):
    # open profile, no signals: (.4*.5 + .25*.5) * .85
    df = frame(spark, [(1, "u", "d", "word", None)])
    open_profile = profiles(spark).filter("icp_id = 'open'")
    score = (0.4 * 0.5 + 0.35 * 0.0 + 0.25 * 0.5) * 0.85
    assert S.enrich(df, open_profile, now(), score).count() == 1
    assert S.enrich(df, open_profile, now(), score + 1e-6).count() == 0


def test_evidence_comes_from_the_text(spark):
    df = frame(spark, [(1, "u", "d", "We say Thering here, and Avec" + " x" * 80 + " blest", None)])
    r = S.enrich(df, profiles(spark).filter("icp_id = 'tech'"), now(), 0.0).head()
    # terms in sorted order: avec, then blest; thering is no longer among the first three
    assert r.evidence == evidence("We say Thering here, and Avec" + " x" * 80 + " blest",
                                    ["avec", "blest", "go", "dans", "edthat"])


def evidence(text, words):
    from test_text import evidence_by_hand
    return evidence_by_hand(text, words)


def test_hot_domain_top_n_is_exact(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 500))
        .alias("domain"), "id", ((F.col("id") * 7919) % 1000 / 1000).alias("icp_relevance_score"))
    top = S.top_n(rows, ["domain"], S.best_first("id"), 3, "rank")
    hot = [r.id for r in top.filter("domain = 'hot'").orderBy("rank").collect()]
    every = sorted(((-(i * 7919 % 1000), i) for i in range(0, 20_000, 3)))[:3]
    assert hot == [i for _, i in every]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # hot keys are cut before the shuffle


def test_results_join_and_domain_fallback(spark):
    results = spark.createDataFrame(
        [("http://a.com/1", "a.com", 2, "p", "x"), ("http://a.com/2", "a.com", 1, "q", "y")],
        "url string, domain string, rank int, provider string, published_date string")
    pages = spark.createDataFrame(
        [("http://a.com/1", "a.com"), ("http://a.com/about", "a.com"), ("http://b.com/", "b.com")],
        "url string, domain string")
    assert [r.url for r in D.with_results(pages, results).collect()] == ["http://a.com/1"]
    both = {r.url: r.provider for r in D.with_results(pages, results, "domain").collect()}
    assert both == {"http://a.com/1": "p", "http://a.com/about": "q"}


def test_merge_titles(one):
    from leadloom.functions import scores as SC
    makers = F.array(F.struct(F.lit("Cto").alias("title"), F.lit(0.9).alias("confidence")))
    got = one(SC.merge_titles(makers, F.lit(["CTO", "COO", "coo"])))
    assert [(m.title, m.confidence) for m in got] == [("Cto", 0.9), ("COO", 0.7)]


def test_pages_without_a_result_take_that_of_their_domain(spark):
    from leadloom.operators import discovery
    from leadloom.plans import inputs

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html")
    results = inputs.search_results(spark, sf)
    args = results, inputs.profiles(spark), inputs.as_of()
    signal = pages.withColumn("url", F.concat("url", F.lit("/team")))

    def leads(of, **more):
        found = discovery.discover(of, *args, min_score=0.0, top=10_000, **more)
        return {(r.icp_id, r.source_url) for r in found.select("icp_id", "source_url").collect()}

    bare, plain = leads(signal), leads(pages)
    assert plain and not bare
    extra = leads(pages.unionByName(signal), fallback="domain")
    assert plain <= extra and any(url.endswith("/team") for _, url in extra)


def test_pages_are_read_once_for_any_number_of_profiles(spark):
    """One scan and one search for terms in the plan; the profiles come as a table."""
    df = frame(spark, some_pages())
    many = profiles(spark).select("*", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("i")
                                  ).withColumn("icp_id", F.concat("icp_id", F.lit("-"), "i")).drop("i")
    for icps, how in ((profiles(spark), {}), (many, {}), (many, dict(broadcast_bytes=0))):
        out = S.enrich(df, icps, now(), 0.0, **how)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
        assert out.count() == 60 * icps.count()
    assert S.enrich(df, profiles(spark).limit(0), now(), 0.0).count() == 0


def test_pairs_look_up_what_the_page_has_of_a_set(spark):
    """Term sets are compared once for a page and a block, whatever profiles share them."""
    base = profiles(spark)
    sizes = F.array(F.lit(None).cast("string"), F.lit("startup"))
    odd = base.filter("icp_id = 'tech'").withColumn("icp_id", F.lit("odd")).withColumn(
        "target_company", F.col("target_company").withField("size", sizes))
    icps = base.unionByName(base.withColumn("icp_id", F.concat("icp_id", F.lit("2")))).unionByName(odd)
    rows = some_pages()
    out = S.enrich(frame(spark, rows), icps, now(), 0.1).select("n", "icp_id", "composite")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    kept = [x for x in plan.splitlines() if " Filter " in x and "0.1)" in x]
    assert kept and not any("array_intersect" in x or "arrays_overlap" in x for x in kept)
    got = {(r.n, r.icp_id): r.composite for r in out.collect()}
    people = {p.icp_id: p for p in base.collect()}
    people |= {f"{k}2": p for k, p in people.items()} | {"odd": people["tech"]}
    want = {(n, k): s for n, _, _, text, date in rows for k, p in people.items()
            if (s := score_by_hand(text, date, p)) >= 0.1}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_first_leads_are_those_of_all_leads(spark):
    """Ties, null places and profiles that come twice; details as without ``first``."""
    rows = some_pages(90)
    rows += [(100 + i, None, None, t, d) for i, (_, _, _, t, d) in enumerate(rows[:5])]
    base = profiles(spark)
    icps = base.unionByName(base.filter("icp_id = 'open'"))
    tie = ["domain", "url", "n"]
    for least in (lx.MIN_LEAD_SCORE, 0.0):
        every = S.enrich(frame(spark, rows), icps, now(), least)
        want = S.top_n(every, ["icp_id"], S.best_first(*tie), 7)
        got = S.enrich(frame(spark, rows), icps, now(), least, first=7, tie=tie)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    slim = S.enrich(frame(spark, rows), icps.limit(0), now(), first=7, tie=tie)
    assert slim.count() == 0


def test_dealt_profiles_are_never_broadcast(spark):
    """However small Spark takes them to be: it goes by files, not by packed and copied blocks."""
    path = fresh_path(spark, "profiles")
    S.profile_terms(profiles(spark)).write.parquet(path)
    icps = spark.read.parquet(path)
    facts = S._facts(S.page_signals(frame(spark, some_pages()), S.dictionary(icps)), [], now())
    dealt = S._met(facts, icps, 3, 1 << 40, 1, 0)
    join = [x for x in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(join) == 1 and "SortMergeJoin" in join[0]
    both = [sorted((r.n, r.p.icp_id) for r in met.select("n", "p").collect())
            for met in (dealt, S._met(facts, icps, 3, 0, 1, 1))]
    assert both[0] == both[1] and len(both[0]) == 60 * 3


def test_ranking_does_not_broadcast_dealt_profiles(spark):
    """Nor the best pairs or what is joined to them; the leads are those of broadcast blocks."""
    path = fresh_path(spark, "profiles")
    profiles(spark).write.parquet(path)
    icps, df = spark.read.parquet(path), frame(spark, some_pages())
    how = dict(first=3, tie=["n"])
    dealt = S.enrich(df, icps, now(), block=1, broadcast_bytes=0, **how)
    plan = dealt._jdf.queryExecution().executedPlan().toString().splitlines()
    for on in ("_block", "_profile", "_page"):
        meeting = [x for x in plan if f"Join [{on}#" in x]
        assert len(meeting) == 1 and "SortMergeJoin" in meeting[0], on
    want = sorted(map(key, S.enrich(df, icps, now(), **how).collect()))
    assert sorted(map(key, dealt.collect())) == want and want
