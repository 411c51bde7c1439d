"""User-supplied models on leads and pages.

A model is a plain function from prompt text to a dict. It runs in the tasks, one call per
distinct prompt; a failing call fills the row's ``error`` and the rule-based value stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from leadloom.functions import scores as SC, text as X, urls as U
from leadloom.operators import companies as C
from leadloom.operators.crawl import is_fresh

Model = Callable[[str], dict]

# Seconds an answer stays valid, by task
ANSWER_TTL = {
    "icp_parser": 3_600, "lead_scorer": 86_400, "research": 86_400, "contact_finder": 86_400,
    "enricher": 3_600,
}

SCORE_ANSWER = (
    "tier string, company_summary string, why_reach_out string, channel string, "
    "subject_line string, opening_hook string, talking_points array<string>, "
    "personalization_hooks array<string>, decision_maker_titles array<string>"
)
CONTACT_ANSWER = (
    "contacts array<struct<name:string,title:string,email:string,linkedin_url:string,"
    "confidence:double>>"
)
PROFILE_ANSWER = (
    "company_name string, description string, tech_stack array<string>, "
    "outsourcing_readiness string, pitch_angle string"
)


def call_model(prompts: DataFrame, fn: Model, prompt: str = "prompt") -> DataFrame:
    """Add ``answer`` (JSON text) and ``error``."""
    schema = T.StructType(
        prompts.schema.fields + T.StructType.fromDDL("answer string, error string").fields)
    place = prompts.columns.index(prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for text in b.iloc[:, place]:
                try:
                    answers.append(json.dumps(fn(text), ensure_ascii=False))
                    errors.append(None)
                except Exception as exc:  # one bad prompt must not fail the job
                    answers.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield b.assign(answer=pd.Series(answers, index=b.index, dtype=object),
                           error=pd.Series(errors, index=b.index, dtype=object))

    return prompts.mapInPandas(run, schema)


def _answers(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(
            "key string, answer string, error string, answered_at timestamp").parquet(store)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":  # nothing stored yet
            return None
        raise


def ask(df: DataFrame, fn: Model, model: str, store: str, task: str = "lead_scorer",
        now: Column | None = None, prompt: str = "prompt") -> DataFrame:
    """Answers to the prompts of ``df``, each distinct prompt asked once.

    Fresh answers in ``store`` are used again. New ones are written there before they are
    joined back, so a lost executor never makes the model answer twice.
    """
    spark = df.sparkSession
    now = now if now is not None else F.current_timestamp()
    keyed = df.withColumn("key", U.response_key(F.lit(model), F.col(prompt)))
    wanted = keyed.groupBy("key").agg(F.first(prompt).alias(prompt))
    stored = _answers(spark, store)
    if stored is not None:
        fresh = stored.filter(F.col("error").isNull() & is_fresh(
            F.col("answered_at"), now, ANSWER_TTL[task]))
        wanted = wanted.join(fresh.select("key").distinct(), "key", "left_anti")
    call_model(wanted, fn, prompt).select(
        "key", "answer", "error", now.alias("answered_at")).write.mode("append").parquet(store)
    valid = _answers(spark, store).filter(is_fresh(F.col("answered_at"), now, ANSWER_TTL[task]))
    newest = valid.groupBy("key").agg(
        F.max_by(F.struct("answer", "error"), "answered_at").alias("a")).select("key", "a.*")
    return keyed.join(newest, "key", "left")


def score_with_model(leads: DataFrame, fn: Model, model: str, store: str,
                     now: Column | None = None) -> DataFrame:
    """Model tier, texts and suggested titles on tiered leads that carry ``prompt``.

    Where the model fails the rule tier stays and the texts are empty.
    """
    asked = ask(leads, fn, model, store, "lead_scorer", now)
    a = F.col("a")
    ok = a["tier"].isin("hot", "warm", "cold")
    text = lambda c: F.coalesce(F.when(ok, a[c]), F.lit(""))
    many = lambda c: F.coalesce(a[c], F.array().cast("array<string>"))
    outreach = F.array(F.struct(
        F.coalesce(a["channel"], F.lit("linkedin")).alias("channel"),
        a["subject_line"].alias("subject_line"),
        F.coalesce(a["opening_hook"], F.lit("")).alias("opening_hook"),
        many("talking_points").alias("key_talking_points"),
        many("personalization_hooks").alias("personalization_hooks")))
    out = asked.withColumn("a", F.from_json("answer", SCORE_ANSWER)).withColumns({
        "lead_tier": F.when(ok, a["tier"]).otherwise(F.col("lead_tier")),
        "company_summary": text("company_summary"), "why_this_lead": text("why_reach_out"),
        "outreach_suggestions": F.when(ok, outreach).otherwise(F.slice(outreach, 1, 0)),
        "decision_makers": SC.merge_titles(
            F.col("decision_makers"), F.when(ok, many("decision_maker_titles")).otherwise(
                F.array().cast("array<string>"))),
        "model_error": F.when(ok, F.lit(None)).otherwise(
            F.coalesce(F.col("error"), F.lit("answer without a valid tier"))),
    })
    return out.drop("a", "answer", "error", "key")


def contacts_with_model(pages: DataFrame, fn: Model, model: str, store: str,
                        order: str = "ordinal", now: Column | None = None) -> DataFrame:
    """Contacts per page: those a model names, completed by addresses found in the text.

    A page without model contacts still gives its minimal contact, if it names one.
    """
    asked = ask(C.contact_prompt(pages), fn, model, store, "contact_finder", now)
    own = F.get(X.domain_emails(X.emails("text_content", None), F.col("domain")), F.lit(0))
    link = F.get(X.profile_links("text_content"), F.lit(0))
    named = asked.select(
        "domain", order, "url", own.alias("_mail"), link.alias("_link"),
        F.posexplode(F.filter(
            F.from_json("answer", CONTACT_ANSWER)["contacts"],
            lambda c: F.coalesce(c["title"], F.lit("")) != "")).alias("contact_no", "c"))
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    by_model = named.select(
        "domain", order, "url", filled(F.col("c.email"), F.col("_mail")).alias("email"),
        filled(F.col("c.linkedin_url"), F.col("_link")).alias("linkedin_url"),
        F.col("c.title").alias("title"),
        F.nullif(F.col("c.name"), F.lit("")).alias("name"),
        F.col("c.confidence").alias("confidence"), "contact_no")
    minimal = C.link_contacts(pages, order).join(
        by_model.select("domain", order, "url"), ["domain", order, "url"], "left_anti")
    return by_model.unionByName(minimal.select(*by_model.columns))


def profiles_with_model(pages: DataFrame, fn: Model, model: str, store: str,
                        order: str = "ordinal", now: Column | None = None) -> DataFrame:
    """Company profiles by a model over the research text, rule-based where it fails."""
    asked = ask(C.research_prompt(C.research_text(pages, order)), fn, model, store, "research",
                now)
    a = F.from_json("answer", PROFILE_ANSWER)
    said = asked.select("domain", F.when(a["company_name"].isNotNull(), a).alias("a"))
    rules = C.fallback_profile(pages, order)
    pick = lambda c: F.when(F.col("a").isNotNull(), F.col("a")[c]).otherwise(
        F.col(c)).alias(c)
    return rules.join(said, "domain", "left").select(
        "domain", pick("company_name"), pick("description"), pick("tech_stack"),
        pick("outsourcing_readiness"), F.col("a").isNotNull().alias("by_model"))
