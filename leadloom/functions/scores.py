"""Score expressions of a page against one customer profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions import lexicons as lx


def score_tech(hits: Column, n: Column) -> Column:
    """Share of ``n`` wanted technologies that were detected; 0.5 when none is wanted."""
    return F.when(n == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), hits / F.greatest(n, F.lit(1))))


def score_hiring(signals: Column) -> Column:
    return F.least(F.lit(1.0), F.size(signals) / F.lit(5))


def score_profile(found_industries: Column, n_industries: Column, location_hit: Column,
                  has_locations: Column, size_hit: Column, has_sizes: Column) -> Column:
    """Industry (found of all), location and size match, normalised by the parts the profile names."""
    named = n_industries > 0
    share = found_industries / F.greatest(n_industries, F.lit(1))
    score = (
        F.when(named, 0.5 * share).otherwise(0.0)
        + F.when(has_locations & location_hit, 0.3).otherwise(0.0)
        + F.when(has_sizes & size_hit, 0.2).otherwise(0.0)
    )
    total = (
        F.when(named, 0.5).otherwise(0.0)
        + F.when(has_locations, 0.3).otherwise(0.0)
        + F.when(has_sizes, 0.2).otherwise(0.0)
    )
    # total is 0 only for a profile that names nothing
    return F.when(
        named | has_locations | has_sizes,
        F.least(F.lit(1.0), score / F.when(total > 0, total).otherwise(1.0)),
    ).otherwise(F.lit(0.5))


def weights(tech_required: Column, hiring_signals: Column, industries: Column) -> Column:
    """(technology, hiring, profile) weights by what the profile stresses."""
    def w(t: float, h: float, p: float) -> Column:
        return F.struct(F.lit(t).alias("tech"), F.lit(h).alias("hiring"), F.lit(p).alias("profile"))

    return (
        F.when(F.size(tech_required) > 0, w(0.50, 0.30, 0.20))
        .when(F.size(hiring_signals) > 0, w(0.25, 0.50, 0.25))
        .when(F.size(industries) > 0, w(0.30, 0.25, 0.45))
        .otherwise(w(0.40, 0.35, 0.25))
    )


_ZONED = r"(?:[Zz]|[+\-]\d{2}:?\d{2})$"


def freshness(published_date: Column, as_of: Column) -> Column:
    """Age factor of an ISO-8601 text date; unknown, bad or zone-less dates give 0.85."""
    zoned = published_date.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*" + _ZONED)
    at = F.when(zoned, F.try_to_timestamp(published_date))
    # whole days elapsed, rounded down as for negative ages too
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000))
    return (
        F.when(at.isNull(), 0.85)
        .when(days < 30, 1.0)
        .when(days < 90, 0.9)
        .when(days < 365, 0.75)
        .otherwise(0.5)
    )


def composite(w: Column, tech: Column, hiring: Column, profile: Column, fresh: Column) -> Column:
    return F.least(
        F.lit(1.0),
        (w["tech"] * tech + w["hiring"] * hiring + w["profile"] * profile) * fresh,
    )


def tier(score: Column, hot: float = lx.TIER_HOT, warm: float = lx.TIER_WARM) -> Column:
    return F.when(score >= hot, "hot").when(score >= warm, "warm").otherwise("cold")


def decision_makers(hints: Column, icp_titles_lower: Column) -> Column:
    """Title structs; a title the profile asks for has confidence 0.9, others 0.5."""
    return F.transform(
        hints,
        lambda h: F.struct(
            h.alias("title"),
            F.when(F.array_contains(icp_titles_lower, F.lower(h)), 0.9)
            .otherwise(0.5).alias("confidence"),
        ),
    )


def merge_titles(makers: Column, suggested: Column) -> Column:
    """Append suggested titles that are not there yet (case-folded), confidence 0.7."""
    start = F.struct(
        F.transform(makers, lambda m: F.lower(m["title"])).alias("seen"),
        makers.alias("out"),
    )

    def step(state: Column, title: Column) -> Column:
        return F.when(F.array_contains(state["seen"], F.lower(title)), state).otherwise(
            F.struct(
                F.concat(state["seen"], F.array(F.lower(title))).alias("seen"),
                F.concat(
                    state["out"],
                    F.array(F.struct(title.alias("title"), F.lit(0.7).alias("confidence"))),
                ).alias("out"),
            )
        )

    return F.aggregate(suggested, start, step, lambda s: s["out"])
