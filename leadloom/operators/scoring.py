"""Score pages against customer profiles, rank and tier the leads.

Text is read once per page, whatever the number of profiles: ``page_signals`` finds every term of
the dictionary (the lexicons and the terms of all profiles) on the page, and the profiles, a table
of term sets in blocks, are joined to that short list of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.functions import lexicons as lx, scores as SC, text as X
from leadloom.session import fresh_path, spread_small

# What scoring reads of a profile: a term set of each kind. Profiles share many of them.
_SETS = ["techs", "industries", "locations", "sizes"]

# Profiles of a block; a page's signals meet one block at a time.
BLOCK_PROFILES = 2_000
# Profiles up to this size go to all tasks as they are.
BROADCAST_BYTES = 8 << 20
# Beyond that: tasks for each core, and pairs of a block and a share of the pages for each task
# (fewer where a few large blocks would be copied more often than there are tasks).
DEALT_TASKS, DEALT_CELLS = 4, 8
# Terms that a task looks for at once. More of them are looked for one part after the other.
DICTIONARY_BYTES = 32 << 20

_FIXED_TERMS = sorted({
    *lx.HIRING_KEYWORDS, *lx.OUTSOURCING_KEYWORDS, *lx.FUNDING_KEYWORDS,
    *lx.BUSINESS_EVENT_KEYWORDS, *(w for ws in lx.SIZE_WORDS.values() for w in ws),
})


def _lower_set(*lists: Column) -> Column:
    parts = [F.coalesce(c, F.array().cast("array<string>")) for c in lists]
    lowered = F.transform(F.concat(*parts), lambda s: F.lower(s))
    return F.array_sort(F.array_distinct(F.filter(lowered, lambda s: s != "")))


def profile_terms(icps: DataFrame) -> DataFrame:
    """The part of each profile that scoring reads: lower-cased term sets and weights."""
    c = F.col
    return icps.select(
        "icp_id",
        _lower_set(c("technologies.required"), c("technologies.preferred")).alias("techs"),
        _lower_set(c("target_company.industries")).alias("industries"),
        _lower_set(c("locations.countries"), c("locations.cities"),
                   c("locations.regions")).alias("locations"),
        _lower_set(c("buyer_persona.titles")).alias("titles"),
        F.coalesce(c("target_company.size"), F.array().cast("array<string>")).alias("sizes"),
        SC.weights(
            F.coalesce(c("technologies.required"), F.array().cast("array<string>")),
            F.coalesce(c("signals.hiring_signals"), F.array().cast("array<string>")),
            F.coalesce(c("target_company.industries"), F.array().cast("array<string>")),
        ).alias("weights"),
    )


def _terms() -> Column:
    return F.concat("techs", "industries", "locations", "titles")


def dictionary(profiles: DataFrame, parts: int = 1) -> Iterator[list[str]]:
    """The different terms of all profiles (of ``profile_terms``), in ``parts`` lists."""
    terms = profiles.select(F.explode(_terms()).alias("t")).distinct()
    for i in range(parts):
        some = terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == i)
        yield sorted(r.t for r in some.collect())


def page_signals(pages: DataFrame, parts: Iterator[list[str]],
                 tech: list[str] = lx.TECH_KEYWORDS, window: int = 120) -> DataFrame:
    """Replace the text by what scoring needs: the terms found and a snippet for each.

    ``parts`` are lists of terms. Pages are read (and parsed) once; with several lists, what was
    read is written to the shared folder, and each list is a pass over that.
    """
    fixed = sorted({*tech, *_FIXED_TERMS})
    none = F.array().cast("array<string>")
    found = pages.withColumns({
        "_lower": F.lower("text_content"), "hits": none, "_quoted": none})
    for i, terms in enumerate(parts):
        if i:
            path = fresh_path(pages.sparkSession, "signals")
            found.write.parquet(path)
            found = pages.sparkSession.read.schema(found.schema).parquet(path)
        got = X.bulk_keyword_hits(F.col("_lower"), sorted({*terms, *fixed}))
        # evidence is only ever drawn from profile terms and hiring words
        silent = sorted(set(fixed) - set(terms) - set(lx.HIRING_KEYWORDS))
        found = found.withColumn("_got", got).withColumns({
            "hits": F.array_sort(F.array_union("hits", "_got")) if i else F.col("_got"),
            "_quoted": F.array_union("_quoted", F.array_except("_got", X.strings(silent)))
        }).drop("_got")
    return found.withColumn("spots", X.locate(
        F.col("text_content"), F.col("_lower"), F.array_sort("_quoted"), window)
    ).drop("_lower", "_quoted", "text_content")


def _met(signals: DataFrame, profiles: DataFrame, n: int, size: int, block: int,
         broadcast_bytes: int) -> DataFrame:
    """Each page's signals with each profile ``p``; the signals are worked out once.

    Profiles are packed in blocks. A page first meets a block's different term sets (``_in_techs``
    and so on hold what it has of each); the profiles know the places of their sets.
    Up to ``broadcast_bytes`` the blocks go to the signals; beyond that both are dealt by block
    and by a share of the pages, so that no block waits for one task. A block is copied for each
    share: the more blocks there are, the fewer shares it takes to keep all tasks busy. Dealt
    blocks are merged with the signals and never broadcast: Spark knows their size only by the
    files that the profiles came from, before terms are made, packed and copied.
    """
    blocks = max(1, ceil(n / block))
    packed = profiles.groupBy(F.pmod(F.xxhash64("icp_id"), F.lit(blocks)).cast("int").alias(
        "_block")).agg(F.collect_list(F.struct(*profiles.columns)).alias("_profiles"), *[
            F.collect_set(c).alias(f"_all_{c}") for c in _SETS])
    packed = packed.withColumns({
        "_terms": F.array_distinct(F.flatten(F.transform("_profiles", lambda p: F.concat(
            p["techs"], p["industries"], p["locations"], p["titles"])))),
        "_profiles": F.transform("_profiles", lambda p: F.struct(
            *[p[c].alias(c) for c in profiles.columns],
            *[(F.array_position(f"_all_{c}", p[c]) - 1).cast("int").alias(f"_{c}") for c in _SETS])),
    })
    each = signals.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    on = ["_block"]
    if size <= broadcast_bytes:
        packed = F.broadcast(packed)
    else:
        on.append("_share")
        spark = signals.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                    DEALT_TASKS * spark.sparkContext.defaultParallelism)
        shares = min(tasks, ceil(DEALT_CELLS * tasks / blocks))
        # only plain columns: a filter on what the text gave would have it searched twice
        named = [c for c, kind in signals.dtypes if "<" not in kind and kind != "variant"]
        each = each.withColumn("_share", F.pmod(F.xxhash64(*named), F.lit(shares)).cast("int"))
        packed = packed.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        # a fixed number of tasks: small files of signals still mean many pairs
        each, packed = each.repartition(tasks, *on), packed.repartition(tasks, *on).hint("merge")
    # what the block asks for and the page holds: once for all its profiles
    met = each.join(packed, on).withColumn("_asked", F.array_intersect("hits", "_terms"))
    count = lambda s: F.size(F.array_intersect(s, F.col("_asked")))
    met = met.withColumns({
        "_in_techs": F.transform("_all_techs", count),
        "_in_industries": F.transform("_all_industries", count),
        "_in_locations": F.transform("_all_locations", lambda s: F.arrays_overlap(s, F.col("_asked"))),
        "_in_sizes": F.transform("_all_sizes", _size_hit),
    }).drop("_terms", *[f"_all_{c}" for c in _SETS])
    return met.withColumn("p", F.explode("_profiles")).drop(*on, "_profiles")


def _size_hit(sizes: Column) -> Column:
    return F.coalesce(F.arrays_overlap(sizes, F.col("_sizes")), F.lit(False))


def _facts(signals: DataFrame, tech: list[str], as_of: Column) -> DataFrame:
    """What all profiles want to know of a page."""
    hits = F.col("hits")
    among = lambda words: F.array_intersect(hits, X.strings(sorted(set(words))))
    return signals.select(
        "*",
        among(tech).alias("page_tech"),
        among(lx.HIRING_KEYWORDS).alias("hiring_signals"),
        among(lx.OUTSOURCING_KEYWORDS).alias("outsourcing_signals"),
        among(lx.FUNDING_KEYWORDS + lx.BUSINESS_EVENT_KEYWORDS).alias("business_events"),
        among(X.decision_maker_role_words()).alias("_roles"),
        F.array_compact(F.array(*[
            F.when(F.arrays_overlap(hits, X.strings(words)), size)
            for size, words in lx.SIZE_WORDS.items()
        ])).alias("_sizes"),
        SC.freshness(F.col("published_date"), as_of).alias("freshness"),
    )


def _scores(pairs: DataFrame, techs: Column, industries: Column, location_hit: Column,
            size_hit: Column) -> DataFrame:
    """Adds the scores, from what the page has of each set of the profile ``p``."""
    p = F.col("p")
    return pairs.select(
        "*",
        SC.score_tech(techs, F.size(p["techs"])).alias("tech_score"),
        SC.score_hiring(F.col("hiring_signals")).alias("hiring_score"),
        SC.score_profile(
            industries, F.size(p["industries"]), location_hit, F.size(p["locations"]) > 0,
            size_hit, F.size(p["sizes"]) > 0,
        ).alias("profile_score"),
    ).withColumn(
        "composite",
        SC.composite(p["weights"], F.col("tech_score"), F.col("hiring_score"),
                     F.col("profile_score"), F.col("freshness")),
    )


def _scored(pairs: DataFrame, min_score: float) -> DataFrame:
    """Scores of the pairs of ``_met``, low ones dropped."""
    # no lambdas or strings here: they would keep Spark from compiling what every pair goes through
    found = [F.get(F.col(f"_in_{c}"), F.col("p")[f"_{c}"]) for c in _SETS]
    return _scores(pairs, *found).drop(*[f"_in_{c}" for c in _SETS]).filter(
        F.col("composite") >= min_score)


def _detailed(scored: DataFrame, max_snippets: int, window: int) -> DataFrame:
    """Leads with what their page has of the profile's terms."""
    asked, p = F.col("_asked"), F.col("p")
    among = lambda c: F.array_intersect(p[c], asked)
    scored = scored.withColumns({
        "tech_stack": F.array_sort(F.array_union("page_tech", among("techs"))),
        "industry_signals": among("industries"),
        "decision_maker_hints": F.array_sort(F.array_union(among("titles"), "_roles")),
    })

    wanted = F.concat(
        F.slice(p["techs"], 1, 3), F.slice(p["industries"], 1, 2),
        F.slice("hiring_signals", 1, 2),
    )
    ordered = F.flatten(
        F.transform(wanted, lambda k: F.filter("spots", lambda s: s["term"] == k))
    )
    return scored.select(
        F.col("p.icp_id").alias("icp_id"), "*",
        F.round("composite", 4).alias("icp_relevance_score"),
        X.pick_evidence(ordered, window, max_snippets).alias("evidence"),
        F.col("p.titles").alias("icp_titles"),
    ).drop("p", "hits", "spots", "page_tech", "_roles", "_sizes", "_asked")


def _first_pairs(signals: DataFrame, profiles: DataFrame, first: int, tie: list[str],
                 min_score: float, *meeting: int) -> DataFrame:
    """Scored pairs of each profile's ``first`` best pages.

    Signals and profiles are written and numbered. Only numbers and scores of the pairs are
    ranked; what else a pair carries is joined to the chosen ones.
    """
    spark = signals.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # numbers go by the order of ``tie``
    pages = written(signals.orderBy(*tie).withColumn("_page", F.monotonically_increasing_id()), "signals")
    icps = written(profiles.withColumn("_profile", F.monotonically_increasing_id()), "profiles")
    slim = pages.select("_page", "hits", "hiring_signals", "_sizes", "freshness")
    pairs = _scored(_met(spread_small(slim), icps, *meeting), min_score).select(
        F.col("p.icp_id").alias("icp_id"), F.col("p._profile").alias("_profile"), "_page",
        F.round("composite", 4).alias("_score"))
    best = top_n(pairs, ["icp_id"], best_first("_page", "_profile", score="_score"), first)
    # merged: Spark takes the best for small, going by the files of slim signals, and would broadcast
    # them, or all profiles; profiles come first, as pages are the wider rows
    profile = icps.select("_profile", F.struct(*icps.columns).alias("p"))
    met = best.select("_page", "_profile").join(profile.hint("merge"), "_profile").join(
        pages.hint("merge"), "_page").select(
        *[c for c in pages.columns if c != "_page"], "p", F.col("hits").alias("_asked"))
    count = lambda c: F.size(F.array_intersect(F.col("p")[c], F.col("hits")))
    return _scores(met, count("techs"), count("industries"),
                   F.arrays_overlap(F.col("p.locations"), F.col("hits")), _size_hit(F.col("p.sizes")))


def enrich(pages: DataFrame, icps: DataFrame, as_of: Column,
           min_score: float = lx.MIN_LEAD_SCORE, tech: list[str] = lx.TECH_KEYWORDS,
           max_snippets: int = 5, window: int = 120,
           results: DataFrame | None = None, block: int = BLOCK_PROFILES,
           broadcast_bytes: int = BROADCAST_BYTES,
           dictionary_bytes: int = DICTIONARY_BYTES, first: int | None = None,
           tie: list[str] | None = None) -> DataFrame:
    """Leads: every usable page scored against every profile, low scores dropped.

    ``pages`` has ``text_content`` next to its identifying columns, all of which are carried
    along, and ``published_date`` unless ``results`` (url, published_date, ...) brings it.
    Results are joined after the text has been reduced to its signals, so page texts never
    move; without them nothing is shuffled as long as the profiles are few. However many there
    are, each page is read and parsed once. The driver learns how many profiles there are and
    holds a part of their different terms, up to ``dictionary_bytes``, at a time.

    With ``first``, only that many leads of each profile come back: the best scores, equal ones by
    the pages' columns ``tie``. They are chosen before the pairs get their other columns.
    """
    every = profile_terms(icps)
    terms = F.aggregate(_terms(), F.lit(0).cast("long"),
                        lambda n, t: n + F.octet_length(t) + F.lit(16))
    size = every.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(terms + F.lit(200)), F.lit(0)).alias("bytes")).head()
    parts = max(1, ceil(size["bytes"] / dictionary_bytes))
    signals = page_signals(pages, dictionary(every, parts), tech, window)
    if results is not None:
        signals = signals.join(results, "url")
    facts, meeting = _facts(signals, tech, as_of), (size["n"], size["bytes"], block, broadcast_bytes)
    if first is None:
        scored = _scored(_met(facts, every, *meeting), min_score)
    else:
        scored = _first_pairs(facts, every, first, tie or [], min_score, *meeting)
    return _detailed(scored, max_snippets, window)


def name_companies(leads: DataFrame) -> DataFrame:
    meta = F.col("meta")
    return leads.withColumn("company_name", X.company_name(
        F.coalesce(meta["json_ld"], F.array().cast("array<string>")),
        meta["og_site_name"], F.coalesce("title", F.lit("")), F.col("domain")))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """Best ``n`` rows per key. ``order`` must be total, so reruns pick the same rows.

    Spark keeps only ``n`` rows per key and map task before the shuffle, so hot keys are cheap.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def best_first(*tie: str, score: str = "icp_relevance_score") -> list[Column]:
    return [F.desc(score), *[F.asc(t) for t in tie]]


def tiered(leads: DataFrame, hot: float = lx.TIER_HOT, warm: float = lx.TIER_WARM) -> DataFrame:
    return leads.withColumn("lead_tier", SC.tier(F.col("icp_relevance_score"), hot, warm))


def final_leads(leads: DataFrame, key: str, tie: list[str], k: int = 20, score_fn=None,
                **thresholds: float) -> DataFrame:
    """Two-step top-k: 2k by rule score, tier (and optionally model-score) them, keep k."""
    first = top_n(leads, [key], best_first(*tie), 2 * k)
    scored = tiered(first, **thresholds).withColumn(
        "decision_makers", SC.decision_makers(F.col("decision_maker_hints"), F.col("icp_titles"))
    )
    if score_fn:
        scored = score_fn(scored)
    return top_n(scored, [key], best_first(*tie), k)


def scored_lead_record(leads: DataFrame) -> DataFrame:
    """The nested output record of a lead."""
    link = lambda name: F.col("meta.social_links")[name].alias(f"{name}_url")
    contact = F.struct(
        X.valid_emails(F.col("meta.emails")).alias("emails"),
        F.col("meta.phone_numbers").alias("phone_numbers"),
        link("linkedin"), link("github"), link("twitter"), link("crunchbase"),
        link("angellist"), F.col("source_url").alias("website"),
    )
    breakdown = F.struct(
        F.col("tech_score").alias("technology"), F.col("hiring_score").alias("hiring"),
        F.col("profile_score").alias("profile"), F.col("composite").alias("composite"),
    )
    return leads.select(
        "icp_id", "domain", "company_name", "source_url", "icp_relevance_score", "lead_tier",
        breakdown.alias("score_breakdown"), contact.alias("contact_info"), "decision_makers",
        "tech_stack", "hiring_signals", "outsourcing_signals", "business_events",
        "industry_signals",
        F.coalesce(F.col("company_summary"), F.lit("")).alias("company_summary")
        if "company_summary" in leads.columns else F.lit("").alias("company_summary"),
        F.coalesce(F.col("why_this_lead"), F.lit("")).alias("why_this_lead")
        if "why_this_lead" in leads.columns else F.lit("").alias("why_this_lead"),
        "evidence",
    )
