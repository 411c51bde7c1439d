"""Company research, contacts and profile refinement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import text as X
from leadloom.operators.groups import within_budget
from leadloom.operators.pages import usable
from leadloom.operators.scoring import best_first, top_n


def research_text(pages: DataFrame, order: str = "ordinal", per_page: int = 2000,
                  budget: int = 8000) -> DataFrame:
    """Labelled page texts per domain, pages in order until the budget is used up."""
    cut = usable(pages).select(
        "domain", order, "url", F.substring("text_content", 1, per_page).alias("chunk"))
    kept = within_budget(cut, ["domain"], [F.asc(order), F.asc("url")], F.length("chunk"),
                         budget, ["url"], inclusive=False)
    left = F.lit(budget) - F.col("used")
    block = F.concat(F.lit("[PAGE: "), "url", F.lit("]\n"),
                     F.substring(F.col("chunk"), F.lit(1), left.cast("int")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("url").alias("u"),
                                                 block.alias("t"))))
    return kept.groupBy("domain").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text_block"),
        F.count("*").alias("pages_used"))


def with_pages(leads: DataFrame, pages: DataFrame, order: str = "ordinal") -> DataFrame:
    """Leads with the research text of their domain's successful pages, NULL without any."""
    counted = pages.filter("success").groupBy("domain").agg(F.count("*").alias("pages"))
    facts = counted.join(research_text(pages, order), "domain", "left")
    return leads.join(facts, "domain", "left").withColumn(
        "pages", F.coalesce("pages", F.lit(0)))


def fallback_profile(pages: DataFrame, order: str = "ordinal") -> DataFrame:
    """Rule-based company profile: technologies (sorted) and the first page's title."""
    base = pages.filter("success").groupBy("domain").agg(
        F.min_by("title", F.struct(order, "url")).alias("title"))
    # one row per (domain, technology): bounded by the lexicon, however many pages there are
    tech = pages.filter("success").select(
        "domain", F.explode("meta.tech_signals").alias("t")).groupBy("domain").agg(
        F.array_sort(F.collect_set("t")).alias("tech_stack"))
    none = F.array().cast("array<string>")
    return base.join(tech, "domain", "left").select(
        "domain",
        F.coalesce(F.nullif("title", F.lit("")), F.col("domain")).alias("company_name"),
        F.concat(F.lit("Company at "), "domain", F.lit(". Research requires LLM."))
        .alias("description"),
        F.coalesce("tech_stack", none).alias("tech_stack"),
        F.lit("unknown").alias("outsourcing_readiness"))


def empty_profile(domains: DataFrame) -> DataFrame:
    return domains.select(
        "domain", F.col("domain").alias("company_name"),
        F.lit("No pages available for research.").alias("description"),
        F.array().cast("array<string>").alias("tech_stack"),
        F.lit("unknown").alias("outsourcing_readiness"))


def link_contacts(pages: DataFrame, order: str = "ordinal") -> DataFrame:
    """Minimal contact of a page that names only an own e-mail or a personal profile."""
    found = X.domain_emails(X.emails("text_content", None), F.col("domain"))
    links = X.profile_links("text_content")
    return usable(pages).select(
        "domain", order, "url", F.get(found, F.lit(0)).alias("email"),
        F.get(links, F.lit(0)).alias("linkedin_url"),
    ).filter("email IS NOT NULL OR linkedin_url IS NOT NULL").withColumns({
        "title": F.lit("Contact"), "name": F.lit(None).cast("string"),
        "confidence": F.lit(0.3), "contact_no": F.lit(0)})


def pick_contacts(contacts: DataFrame, n: int = 10, order: str = "ordinal") -> DataFrame:
    """First contact per title (case-folded) and domain, best ``n`` by confidence."""
    place = F.struct(order, "url", "contact_no")
    rest = [c for c in contacts.columns if c != "domain"]
    first = contacts.groupBy("domain", F.lower("title").alias("_t")).agg(
        F.min_by(F.struct(*rest), place).alias("c")).select("domain", "c.*")
    return top_n(first, ["domain"], [F.desc("confidence"), F.asc(order), F.asc("url"),
                                     F.asc("contact_no")], n, "rank")


def research_quota(leads: DataFrame, pages: DataFrame, key: str, tie: list[str], n: int = 5
                   ) -> DataFrame:
    """Of the first ``n`` hot leads, those that have pages."""
    hot = top_n(leads.filter("lead_tier = 'hot'"), [key], best_first(*tie), n)
    return hot.join(pages.filter("success").select("domain").distinct(), "domain", "left_semi")


def contact_quota(leads: DataFrame, pages: DataFrame, key: str, tie: list[str], n: int = 10
                  ) -> DataFrame:
    """Of the first ``n`` leads, those with pages and without decision makers."""
    first = top_n(leads, [key], best_first(*tie), n).filter(F.size("decision_makers") == 0)
    return first.join(pages.filter("success").select("domain").distinct(), "domain", "left_semi")


def _most_common(leads: DataFrame, values: str, n: int) -> DataFrame:
    counts = leads.select("icp_id", F.explode(values).alias("term")).groupBy(
        "icp_id", "term").agg(F.count("*").alias("n"))
    return top_n(counts, ["icp_id"], [F.desc("n"), F.asc("term")], n)


def top_tech(icps: DataFrame, hot_leads: DataFrame, n: int = 5) -> DataFrame:
    """Most common technologies of hot leads that the profile does not require yet."""
    required = icps.select("icp_id", F.explode("technologies.required").alias("r")).select(
        "icp_id", F.lower("r").alias("low")).distinct()
    common = _most_common(hot_leads, "tech_stack", n).withColumn("low", F.lower("term"))
    return common.join(required, ["icp_id", "low"], "left_anti").drop("low")


def top_industries(hot_leads: DataFrame, n: int = 3) -> DataFrame:
    return _most_common(hot_leads, "industry_signals", n)


def refine(icps: DataFrame, hot_leads: DataFrame) -> DataFrame:
    """Profiles enriched by what their hot leads have in common."""
    tech = top_tech(icps, hot_leads).groupBy("icp_id").agg(
        F.collect_list("term").alias("_tech"))
    industries = top_industries(hot_leads).groupBy("icp_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("term")))),
                    lambda s: s["term"]).alias("_inds"))
    out = icps.join(tech, "icp_id", "left").join(industries, "icp_id", "left")
    none = F.array().cast("array<string>")
    own = F.coalesce("target_company.industries", none)
    return out.withColumns({
        "technologies": F.when(
            F.size(F.coalesce("_tech", none)) > 0,
            F.col("technologies").withField("preferred", F.array_sort(F.array_union(
                F.coalesce("technologies.preferred", none), "_tech")))
        ).otherwise(F.col("technologies")),
        "target_company": F.when(
            F.size(own) == 0,
            F.col("target_company").withField("industries", F.coalesce("_inds", none))
        ).otherwise(F.col("target_company")),
    }).drop("_tech", "_inds")


# -- prompt texts --------------------------------------------------------------------

#: What a prompt may name of a profile and of a lead: columns, each with how many values (all).
WANTED = {"target_company.industries": None, "locations.countries": None,
          "technologies.required": None, "technologies.preferred": None,
          "buyer_persona.titles": None, "engagement.models": None,
          "outsource.engagement_models": None}
FOUND = {"tech_stack": None, "hiring_signals": None, "outsourcing_signals": None,
         "business_events": None, "industry_signals": None, "decision_maker_hints": None,
         "emails": None}
TEMPLATE = ("profile\n{wanted}\n\nlead {company_name}, {domain}, {source_url}, "
            "score {score}\n{found}\n{evidence}")


def _lines(columns: dict[str, int | None]) -> Column:
    """A line per column that has values: its name, then the values."""
    def line(c: str, n: int | None) -> Column:
        v = F.coalesce(F.slice(c, 1, n) if n else F.col(c), F.array().cast("array<string>"))
        return F.when(F.size(v) > 0, F.concat(F.lit(c.replace("_", " ") + ": "),
                                              F.array_join(v, ", ")))

    return F.coalesce(F.nullif(F.concat_ws("\n", *[line(*x) for x in columns.items()]),
                               F.lit("")), F.lit("nothing"))


def scoring_prompt(leads: DataFrame, icps: DataFrame, template: str = TEMPLATE,
                   wanted: dict[str, int | None] = WANTED, found: dict[str, int | None] = FOUND,
                   quotes: int | None = None) -> DataFrame:
    """A user's template filled per lead: what is wanted, what was found, quoted evidence."""
    asked = icps.select("icp_id", _lines(wanted).alias("_wanted"))
    cited = F.slice("evidence", 1, quotes) if quotes else F.col("evidence")
    slots = {
        "wanted": F.col("_wanted"), "found": _lines(found),
        "score": F.format_string("%.2f", "icp_relevance_score"),
        "evidence": F.coalesce(F.array_join(F.transform(
            cited, lambda e: F.concat(F.lit("> "), e)), "\n"), F.lit("")),
        **{c: F.coalesce(c, F.lit("")) for c in ("company_name", "domain", "source_url")}}
    parts = re.split(r"\{(\w+)\}", template)
    prompt = F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return leads.join(asked, "icp_id").withColumn("prompt", prompt).drop("_wanted")


def research_prompt(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("prompt", F.concat(
        F.lit("Company domain: "), "domain", F.lit("\n\nWeb pages content:\n"), "text_block"))


def contact_prompt(pages: DataFrame, chars: int | None = None, min_chars: int = 100) -> DataFrame:
    """Pages with more than ``min_chars`` characters and the text a contact model reads.

    The whole text unless ``chars`` cuts it.
    """
    text = F.substring("text_content", 1, chars) if chars else F.col("text_content")
    return usable(pages).filter(F.length("text_content") > min_chars).withColumn(
        "prompt", F.concat(F.lit("Company domain: "), "domain", F.lit("\n\nPage text:\n"), text))
