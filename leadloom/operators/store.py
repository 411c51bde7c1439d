"""Stored tables: upserts, purge, checks, reports and lookups.

An upsert is a full outer join of the stored snapshot with the incoming rows, both reduced to
one row per key first. Snapshots are written to a new place and then published, never over
the files a plan still reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from leadloom.functions.numbers import exact_sum, rounded_avg
from leadloom.operators.scoring import best_first, top_n

TAGS = ["tech_stack", "industry_tags"]


def _suffixed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("n"))


def _last_value(column: str, order: Column) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


def upsert_companies(stored: DataFrame, incoming: DataFrame, now: Column,
                     order: str = "ordinal") -> DataFrame:
    """Tags become the sorted union; other given fields replace stored ones when not NULL.

    ``incoming`` may hold a domain many times; ``order`` says which row is the later one.
    """
    keys = ["domain"]
    tags = [t for t in TAGS if t in incoming.columns]
    plain = [c for c in incoming.columns if c not in (*keys, *tags, order)]
    place = F.struct(F.col(order))
    one = incoming.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[_last_value(c, place) for c in plain])
    for t in tags:  # tag rows, not lists of lists: a popular domain stays small
        union = incoming.select("domain", F.explode(t).alias("_t")).groupBy("domain").agg(
            F.array_sort(F.collect_set("_t")).alias(t))
        one = one.join(union, "domain", "left")
    is_new, has_new = F.col("_stored").isNull(), F.col("n").isNotNull()
    j = stored.withColumn("_stored", F.lit(True)).join(_suffixed(one, keys), keys, "full_outer")
    none = F.array().cast("array<string>")

    def value(c: str) -> Column:
        if c in tags:
            return F.when(F.size(F.coalesce(f"n.{c}", none)) > 0, F.array_sort(F.array_union(
                F.coalesce(c, none), f"n.{c}"))).otherwise(F.col(c))
        if c in plain:
            return F.coalesce(F.col(f"n.{c}"), F.col(c))
        if c == "updated_at":
            return F.when(has_new, now).otherwise(F.col(c))
        if c == "discovered_at":
            return F.when(is_new, now).otherwise(F.col(c))
        return F.col(c)

    return j.select(*[value(c).alias(c) for c in stored.columns])


def best_per_key(leads: DataFrame, keep: str = "best", order: str = "ordinal") -> DataFrame:
    """One lead per session and domain: the best score, or the last one written."""
    keys = ["session_id", "domain"]
    rest = [c for c in leads.columns if c not in keys]
    place = F.struct(F.col(order)) if keep == "last" else \
        F.struct(F.col("icp_relevance_score"), -F.col(order))
    return leads.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("r")).select(
        *keys, "r.*")


def upsert_leads(stored: DataFrame, incoming: DataFrame, now: Column, keep: str = "best",
                 order: str = "ordinal") -> DataFrame:
    """Incoming fields replace the stored ones, NULLs too; other stored fields stay."""
    keys = ["session_id", "domain"]
    one = best_per_key(incoming, keep, order).drop(order)
    given = [c for c in one.columns if c not in keys]
    j = stored.withColumn("_stored", F.lit(True)).join(_suffixed(one, keys), keys, "full_outer")
    has_new, is_new = F.col("n").isNotNull(), F.col("_stored").isNull()

    def value(c: str) -> Column:
        if c in given:
            return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(c))
        if c == "created_at":
            return F.when(is_new, now).otherwise(F.col(c))
        return F.col(c)

    return j.select(*[value(c).alias(c) for c in stored.columns])


_MAKER_FIELDS = ["full_name", "confidence", "session_id"]


def upsert_decision_makers(stored: DataFrame, incoming: DataFrame, order: str = "ordinal"
                           ) -> tuple[DataFrame, DataFrame]:
    """Match on e-mail, else profile link, else title within a domain: (table, rejects).

    A matched row keeps its identity and takes the incoming name, confidence and session. A
    row that matches several stored rows, that would repeat a stored link, or that another row
    of the batch beats to its stored row or link, is rejected with a reason. Rows of one key
    are one row. ``stored`` has a unique ``id``.
    """
    kind = F.when(F.coalesce("email", F.lit("")) != "", "email").when(
        F.coalesce("linkedin_url", F.lit("")) != "", "linkedin_url").otherwise("title")
    value = F.when(kind == "email", F.col("email")).when(
        kind == "linkedin_url", F.col("linkedin_url")).otherwise(F.col("title"))
    key = ["domain", "_kind", "_value"]
    identity = ["title", "email", "linkedin_url"]
    keyed = incoming.withColumns({"_kind": kind, "_value": value}).groupBy(*key).agg(
        F.min_by(F.struct(*identity), order).alias("who"),
        F.max_by(F.struct(*_MAKER_FIELDS), order).alias("what"), F.min(order).alias("_first"))
    # each stored row under its three possible keys, counted per key
    under = stored.select("id", "domain", F.explode(F.array(*[
        F.struct(F.lit(k).alias("_kind"), F.col(k).alias("_value")) for k in
        ("email", "linkedin_url", "title")])).alias("k")).select("id", "domain", "k.*").filter(
        F.coalesce("_value", F.lit("")) != "").groupBy(*key).agg(
        F.count("*").alias("_hits"), F.min("id").alias("_id"))
    matched = keyed.join(under, key, "left")
    # two incoming keys can point to one stored row; the e-mail match decides
    found = matched.filter("_hits = 1").withColumn("_turn", F.row_number().over(
        W.partitionBy("_id").orderBy("_kind", "_value")))
    updates = found.filter("_turn = 1").select("_id", "what")
    fresh = matched.filter("_hits IS NULL").select("domain", "who.*", "what.*", "_first")
    taken_link = stored.filter("linkedin_url IS NOT NULL").select("domain", "linkedin_url")
    clash = fresh.join(taken_link, ["domain", "linkedin_url"], "left_semi")
    # rows without a link cannot repeat one; of several with the same link the first is stored
    free = fresh.join(taken_link, ["domain", "linkedin_url"], "left_anti").withColumn(
        "_own", F.coalesce(F.nullif("linkedin_url", F.lit("")), F.concat(F.lit("\x01"), "_first")))
    free = free.withColumn("_turn", F.row_number().over(
        W.partitionBy("domain", "_own").orderBy("_first")))
    inserts = free.filter("_turn = 1").drop("_own", "_turn", "_first")
    beaten = found.filter("_turn > 1").select("domain", "who.*", "what.*").unionByName(
        free.filter("_turn > 1").drop("_own", "_turn", "_first"))
    updated = stored.join(updates, stored["id"] == updates["_id"], "left").select(*[
        F.when(F.col("what").isNotNull(), F.col(f"what.{c}")).otherwise(F.col(c)).alias(c)
        if c in _MAKER_FIELDS else F.col(c) for c in stored.columns])
    table = updated.unionByName(inserts, allowMissingColumns=True)
    rejects = matched.filter("_hits > 1").select(
        "domain", "who.*", "what.*").withColumn("reason", F.lit("ambiguous")).unionByName(
        clash.drop("_first").withColumn("reason", F.lit("duplicate link"))).unionByName(
        beaten.withColumn("reason", F.lit("repeated in batch")))
    return table, rejects


def upsert_sessions(stored: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Completed runs (session_id, query, hot, warm, cold) into the session table."""
    counts = runs.select(F.col("session_id").alias("id"), F.struct(
        "query", "hot", "warm", "cold").alias("n"))
    j = stored.withColumn("_stored", F.lit(True)).join(counts, "id", "full_outer")
    ran, is_new = F.col("n").isNotNull(), F.col("_stored").isNull()
    fresh = {
        "status": F.lit("completed"), "total_leads": F.expr("n.hot + n.warm + n.cold"),
        "hot_count": F.col("n.hot"), "warm_count": F.col("n.warm"),
        "cold_count": F.col("n.cold"), "updated_at": now,
    }
    first_only = {"query": F.col("n.query"), "created_at": now}

    def value(c: str) -> Column:
        if c in fresh:
            return F.when(ran, fresh[c]).otherwise(F.col(c))
        if c in first_only:
            return F.when(is_new, first_only[c]).otherwise(F.col(c))
        return F.col(c)

    return j.select(*[value(c).alias(c) for c in stored.columns])


def purge_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Delete sessions: child rows go too, decision makers lose only the reference."""
    keys = gone.select(F.col("id").alias("session_id")).distinct()
    out = {}
    for name, df in tables.items():
        if name == "sessions":
            out[name] = df.join(keys, df["id"] == keys["session_id"], "left_anti")
        elif name == "decision_makers":
            out[name] = _clear(df, "session_id", keys)
        else:
            # a NULL reference belongs to no session and stays
            out[name] = df.join(keys, "session_id", "left_anti")
    return out


def purge_companies(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Delete companies and their decision makers; leads lose the domain reference."""
    keys = gone.select("domain").distinct()
    out = dict(tables)
    for name in ("companies", "decision_makers"):
        if name in out:
            out[name] = out[name].join(keys, "domain", "left_anti")
    if "leads" in out:
        out["leads"] = _clear(out["leads"], "domain", keys)
    return out


def _clear(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    marked = df.join(keys.withColumn("_gone", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(
        *df.columns)


# -- checks --------------------------------------------------------------------------

def check_values(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``broken``, the names of the rules they break)."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(
        F.size("broken") > 0)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a NULL key part never clash."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


# -- reports -------------------------------------------------------------------------

def session_summary(sessions: DataFrame, searches: DataFrame, crawls: DataFrame,
                    agent_runs: DataFrame) -> DataFrame:
    """Sessions with the number of searches, crawls and agent runs and the model time.

    Each child is aggregated before its join, so the sums are true sums.
    """
    def per_session(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy(F.col("session_id").alias("id")).agg(*aggs)

    out = sessions
    for child in (
        per_session(searches, F.count("*").alias("search_queries_issued")),
        per_session(crawls, F.count("*").alias("urls_crawled")),
        per_session(agent_runs, F.count("*").alias("agent_runs"),
                    exact_sum("latency_ms").alias("total_llm_ms")),
    ):
        out = out.join(child, "id", "left")
    return out.na.fill(0, ["search_queries_issued", "urls_crawled", "agent_runs"]).na.fill(
        0.0, ["total_llm_ms"])


def top_leads(leads: DataFrame, companies: DataFrame, makers: DataFrame) -> DataFrame:
    """Leads with company facts and the number of known decision makers, best first."""
    n = makers.groupBy("domain").agg(F.count("id").alias("decision_maker_count"))
    c = companies.select("domain", "tech_stack", "linkedin_url", "yc_batch", "funding_stage")
    return leads.select(
        "session_id", "domain", "company_name", "lead_tier", "icp_relevance_score"
    ).join(c, "domain", "left").join(n, "domain", "left").na.fill(
        0, ["decision_maker_count"]).orderBy(*best_first("session_id", "domain"))


def agent_stats(runs: DataFrame, *keys: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return runs.groupBy(*keys, "agent_name").agg(
        F.count("*").alias("runs"),
        F.coalesce(rounded_avg("latency_ms", 1), F.lit(0.0)).alias("avg_latency_ms"),
        total("prompt_tokens"), total("output_tokens"))


@dataclass(frozen=True)
class Stage:
    """The rows of a stage as they were written, and the numbers taken on the way."""

    rows: DataFrame
    numbers: dict


def write_stage(df: DataFrame, path: str, **numbers: str) -> Stage:
    """Write a stage's rows to ``path`` and count them on the way (``items`` and any other
    aggregates, as expressions), so that nothing is worked out again for the sake of its numbers.

    The numbers come from the tasks that write, one finished attempt of each.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("items"), *[F.expr(x).alias(n) for n, x in numbers.items()]
               ).write.mode("overwrite").parquet(path)
    return Stage(df.sparkSession.read.schema(df.schema).parquet(path), seen.get)


def stage_metrics(spark: SparkSession, stages: list[tuple[str, Stage, Stage, int]]) -> DataFrame:
    """One row per stage: rows in, rows out, errors.

    ``stages`` holds (name, input, output, failed rows). A stage's input is the output of the one
    before it, so the numbers of a run join up.
    """
    return spark.createDataFrame(
        [(i, name, source.numbers["items"], result.numbers["items"], errors)
         for i, (name, source, result, errors) in enumerate(stages)],
        "ordinal int, stage string, items_in long, items_out long, error_count long")


#: What a run summary wants to know of a stage, beside the rows.
CRAWL_NUMBERS = {"successes": "count_if(success)", "tried": "count(success)"}
LEAD_NUMBERS = {"best": "max(icp_relevance_score)"}


def run_summary(spark: SparkSession, plan: Stage, results: Stage, pages: Stage, leads: Stage
                ) -> DataFrame:
    """One row about a run: sizes of its stages, crawl success, best score.

    ``pages`` was written with ``CRAWL_NUMBERS``, ``leads`` with ``LEAD_NUMBERS``.
    """
    tried, best = pages.numbers["tried"], leads.numbers["best"]
    row = spark.createDataFrame(
        [(plan.numbers["items"], results.numbers["items"], pages.numbers["items"],
          pages.numbers["successes"] / tried if tried else 0.0, leads.numbers["items"],
          best if best is not None else 0.0)],
        "planned_queries long, total_results long, crawled_pages long, crawl_success_rate double, "
        "leads long, top_lead_score double")
    return row.withColumns({"crawl_success_rate": F.round("crawl_success_rate", 2),
                            "top_lead_score": F.round("top_lead_score", 3)})


def crawl_success_rate(pages: DataFrame, *keys: str) -> DataFrame:
    rate = F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_rate")
    return pages.groupBy(*keys).agg(rate) if keys else pages.agg(rate)


# -- lookups -------------------------------------------------------------------------

def where(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal all given values."""
    for c, v in equal.items():
        df = df.filter(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return df


def leads_of_session(leads: DataFrame, session_id: str, tier: str | None = None,
                     limit: int | None = 50) -> DataFrame:
    out = where(leads, session_id=session_id, **({"lead_tier": tier} if tier else {}))
    out = out.orderBy(*best_first("domain"))
    return out.limit(limit) if limit else out


def companies_with(companies: DataFrame, column: str, tag: str) -> DataFrame:
    return companies.filter(F.array_contains(column, tag))


def yc_companies(companies: DataFrame, batch: str | None = None) -> DataFrame:
    out = companies.filter("is_yc_company")
    return out.filter(F.col("yc_batch") == batch) if batch else out


def run_status(sessions: DataFrame, session_id: str) -> DataFrame:
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sessions.filter(F.col("id") == session_id).select(
        F.col("id").alias("session_id"), "status", n("total_leads"), n("hot_count"),
        n("warm_count"), n("cold_count"))


def recent_sessions(sessions: DataFrame, n: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.asc("id")).limit(n)


def makers_by_confidence(makers: DataFrame) -> DataFrame:
    return makers.orderBy("domain", F.desc("confidence"), "id")


def best_hot_and_warm(leads: DataFrame, n: int = 10) -> DataFrame:
    return leads.filter(F.col("lead_tier").isin("hot", "warm")).orderBy(
        *best_first("session_id", "domain")).limit(n)


def top_by_session(leads: DataFrame, n: int = 20) -> DataFrame:
    return top_n(leads, ["session_id"], best_first("domain"), n)


# -- snapshots -----------------------------------------------------------------------

def publish(spark: SparkSession, df: DataFrame, root: str) -> str:
    """Write a table version beside the older ones, then log it as the current one."""
    version = uuid.uuid4().hex
    path = f"{root}/version={version}"
    df.write.parquet(path)
    # the log entry is one committed row: readers see the old version or the new one
    spark.range(1).select(
        F.lit(path).alias("path"), F.current_timestamp().alias("published_at")
    ).write.mode("append").parquet(f"{root}/log")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    newest = spark.read.parquet(f"{root}/log").orderBy(F.desc("published_at")).limit(1)
    return spark.read.parquet(newest.head().path)
