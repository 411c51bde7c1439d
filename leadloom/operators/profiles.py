"""Query text to customer profiles, and profiles to planned search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leadloom import schemas
from leadloom.functions import lexicons as lx, text as X

_NONE = lambda: F.array().cast("array<string>")


# -- query text --------------------------------------------------------------------

def sanitise_queries(queries: DataFrame, column: str = "query") -> DataFrame:
    """Add ``clean`` and ``rejected_by`` (the injection rule a text trips, else NULL)."""
    text = X.sanitise_query(column)
    return queries.withColumn("rejected_by", X.injection_rule(text)).withColumn(
        "clean", X.strip(text))


def accepted(sanitised: DataFrame) -> DataFrame:
    return sanitised.filter(F.col("rejected_by").isNull())


def rejected(sanitised: DataFrame) -> DataFrame:
    return sanitised.filter(F.col("rejected_by").isNotNull())


def parse_queries(queries: DataFrame, key: str = "query_id", column: str = "query") -> DataFrame:
    """Keyword form of a free-text query as a profile row (see ``schemas.ICP``)."""
    q = F.lower(column)
    # lexicon order, as the lists are written
    named = lambda words: F.array_intersect(X.strings(words), X.keyword_hits(q, words))
    parsed = queries.select(
        F.col(key).cast("string").alias("icp_id"), F.col(column).alias("original_query"),
        named(lx.QUERY_LOCATIONS).alias("countries"), named(lx.QUERY_TECH).alias("tech"),
        named(lx.QUERY_TITLES).alias("titles"),
        named(lx.QUERY_INDUSTRIES).alias("industries"),
        F.array_compact(F.array(*[
            F.when(X.any_keyword(q, ws), size) for size, ws in lx.QUERY_SIZE_WORDS.items()
        ])).alias("sizes"),
        F.slice(F.filter(
            F.split(X.strip(q), r"(?U)\s+"),
            lambda w: (F.length(w) > 3) & ~w.isin(lx.QUERY_STOP_WORDS)), 1, 8).alias("required"),
    )
    some = lambda c, v: F.when(F.size(c) > 0, v).otherwise(0.0)
    confidence = F.least(
        F.lit(0.3) + some("tech", 0.1) + some("titles", 0.1) + some("industries", 0.1)
        + some("countries", 0.05), F.lit(0.6))
    filled = {
        "target_company": {"industries": F.col("industries"), "size": F.col("sizes")},
        "locations": {"countries": F.col("countries")},
        "technologies": {"required": F.col("tech")},
        "buyer_persona": {"titles": F.col("titles")},
        "discovery": {"focus": F.lit("find_companies"), "result_limit": F.lit(50)},
        "keywords": {"required": F.col("required")},
    }
    top = {
        "icp_id": F.col("icp_id"), "original_query": F.col("original_query"),
        "missing_information": F.array(F.lit("keyword parse: results may be less precise")),
        "confidence": confidence,
    }
    return parsed.select(*[
        _default(f, filled.get(f.name, {}), top.get(f.name)).alias(f.name)
        for f in schemas.ICP.fields
    ])


def _default(field, filled: dict, value: Column | None) -> Column:
    """Empty lists and NULL scalars wherever a profile field is not given."""
    from pyspark.sql import types as T

    if value is not None:
        return value.cast(field.dataType)
    if isinstance(field.dataType, T.StructType):
        return F.struct(*[_default(f, {}, filled.get(f.name)).alias(f.name)
                          for f in field.dataType.fields])
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    return F.lit(None).cast(field.dataType)


# -- planning ----------------------------------------------------------------------

def _join(*parts: Column | str) -> Column:
    """Non-blank parts with one blank between them."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(" ", *[F.nullif(X.strip(F.coalesce(c, F.lit(""))), F.lit(""))
                              for c in cols])


def _planned(text: Column, signal: str, priority: int, search_type: str = "web",
             domains: list[str] | None = None, time_range: str | None = None) -> Column:
    return F.struct(
        text.alias("query_string"), F.lit(signal).alias("signal_type"),
        F.lit(search_type).alias("search_type"), F.lit(priority).alias("priority"),
        X.strings(domains or []).alias("include_domains"),
        F.lit(time_range).cast("string").alias("time_range"),
    )


def _list(path: str) -> Column:
    return F.coalesce(F.col(path), _NONE())


def _or_default(values: Column, default: list[str]) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(X.strings(default))


def _head(values: Column, default: str = "") -> Column:
    return F.coalesce(F.get(values, 0), F.lit(default))


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def _each(values: Column, n: int, fn) -> Column:
    return F.transform(F.slice(values, 1, n), fn)


def _industries() -> Column:
    return _list("target_company.industries")


def _countries() -> Column:
    return _list("locations.countries")


def _techs() -> Column:
    return F.when(F.size(_list("technologies.required")) > 0, _list("technologies.required")) \
        .otherwise(_list("technologies.preferred"))


def plan_company_profile(n: int = 5) -> Column:
    terms = F.create_map(*[F.lit(x) for kv in lx.PLAN_SIZE_TERMS.items() for x in kv])
    sizes = F.array_join(F.array_distinct(F.transform(
        _list("target_company.size"), lambda s: F.coalesce(terms[s], s))), " ")
    places = F.array_join(F.slice(_countries(), 1, 2), " ")
    stage = _spaced(_head(_list("target_company.maturity_stage")))
    keep = lambda c: F.nullif(c, F.lit(""))
    return _each(
        _or_default(_industries(), ["software"]), n,
        lambda i: _planned(F.concat_ws(
            " ", keep(i), F.lit("company"), keep(sizes), keep(places), keep(stage)),
            "company_profile", 1))


def plan_technology(n: int = 5) -> Column:
    ind = _head(_industries())
    per_tech = F.flatten(_each(_techs(), n, lambda t: F.array(
        _planned(_join(F.concat(F.lit("company using "), t), ind, "hiring engineers"),
                 "technology_stack", 2),
        _planned(F.concat(t, F.lit(" "), ind, F.lit(" tech stack")), "technology_stack", 3,
                 domains=lx.STACK_DOMAINS))))
    old, new = _list("technologies.migrating_from"), _list("technologies.migrating_to")
    moves = F.transform(
        F.slice(old, F.lit(1), F.least(F.size(old), F.size(new))),
        lambda a, i: _planned(_join(
            F.concat(F.lit("migrating from "), a, F.lit(" to "), F.get(new, i)), ind),
            "technology_stack", 3))
    return F.slice(F.concat(per_tech, moves), 1, n)


def plan_hiring(n: int = 5) -> Column:
    ind, loc = _head(_industries()), _head(_countries())
    return F.slice(F.concat(
        _each(_techs(), 3, lambda t: _planned(
            _join(F.concat(F.lit("hiring "), t, F.lit(" engineer")), ind, loc, "job opening"),
            "hiring_signals", 2, domains=lx.JOB_BOARD_DOMAINS)),
        _each(_list("signals.hiring_signals"), 2, lambda k: _planned(
            _join(k, ind, loc), "hiring_signals", 3)),
        _each(_list("opportunities.project_types"), 2, lambda p: _planned(
            _join(_spaced(p), "engineer hiring", ind), "hiring_signals", 3)),
    ), 1, n)


def plan_outsourcing(n: int = 5) -> Column:
    ind, kind = _head(_industries(), "software"), "outsourcing_signals"
    return F.slice(F.concat(
        F.array(_planned(_join(ind, "company outsource software development vendor"), kind, 3)),
        _each(_list("outsource.engagement_models"), 2, lambda m: _planned(
            _join(_spaced(m), ind, "company"), kind, 4)),
        _each(_list("outsource.outsourcing_signals"), 2, lambda s: _planned(
            _join(_spaced(s), ind), kind, 4)),
    ), 1, n)


def plan_business_events(n: int = 5) -> Column:
    ind, loc = _head(_industries(), "software"), _head(_countries())
    templates = F.create_map(*[F.lit(x) for kv in lx.PLAN_EVENT_TEMPLATES.items() for x in kv])
    news = dict(search_type="news", time_range="qdr:m")

    def fill(event: Column) -> Column:
        values = {"{industry}": ind, "{location}": loc, "{event}": _spaced(event)}
        return X.strip(reduce(
            lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), values.items(),
            F.coalesce(templates[event], F.lit(lx.PLAN_OTHER_EVENT_TEMPLATE))))

    return F.slice(F.concat(
        _each(_list("signals.business_events"), n, lambda e: _planned(
            fill(e), "business_events", 3, **news)),
        F.array(_planned(_join(ind, "startup funding raised", loc), "business_events", 4,
                         **news)),
    ), 1, n)


def plan_decision_makers(n: int = 5) -> Column:
    ind, titles = _head(_industries()), _list("buyer_persona.titles")
    quote = F.lit('"')
    by_title = _each(titles, n, lambda t: _planned(
        _join(F.concat(quote, t, quote), ind, "company"), "decision_makers", 4,
        domains=["linkedin.com"]))
    by_department = _each(_list("buyer_persona.departments"), 2, lambda x: _planned(
        _join(F.concat(x, F.lit(" department head")), ind, "company"), "decision_makers", 5))
    return F.slice(F.when(F.size(titles) > 0, by_title).otherwise(by_department), 1, n)


BUILDERS = {
    "company_profile": plan_company_profile, "technology_stack": plan_technology,
    "hiring_signals": plan_hiring, "outsourcing_signals": plan_outsourcing,
    "business_events": plan_business_events, "decision_makers": plan_decision_makers,
}


def plan_queries(icps: DataFrame, per_signal: int = 5, signals: list[str] | None = None
                 ) -> DataFrame:
    """Planned queries of every profile, ``ordinal`` giving the order of the plan.

    A profile's plan is at most ``per_signal`` queries per signal, so each profile expands
    within its own row.
    """
    arrays = [BUILDERS[s](per_signal) for s in signals or BUILDERS]
    return icps.select("icp_id", F.posexplode(F.concat(*arrays)).alias("ordinal", "q")).select(
        "icp_id", "ordinal", "q.*")


def by_priority(plan: DataFrame) -> DataFrame:
    return plan.orderBy("priority", "icp_id", "ordinal")


def of_type(plan: DataFrame, search_type: str) -> DataFrame:
    return plan.filter(F.col("search_type") == search_type)


def by_signal(plan: DataFrame) -> DataFrame:
    """Query texts per profile and signal; a plan holds a handful per signal."""
    return plan.groupBy("icp_id", "signal_type").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "query_string"))),
        lambda q: q["query_string"]).alias("queries"))
