"""URL and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions import lexicons as lx
from leadloom.functions.text import strip

# scheme, authority with its slashes, path, query, fragment
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _form_decode(c: Column) -> Column:
    # a % that starts no escape is kept as it is, so protect it from the decoder
    return F.url_decode(F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25"))


def _form_encode(c: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def clean_query_string(query: Column, drop: list[str] = lx.TRACKING_PARAMS) -> Column:
    """Drop tracking and blank parameters, bring repeated keys together, re-encode."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.")),
        lambda p: F.struct(
            _form_decode(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"),
            _form_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(drop))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    grouped = F.transform(
        keys,
        lambda k: F.transform(
            F.filter(kept, lambda p: p["k"] == k),
            lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"])),
        ),
    )
    return F.array_join(F.flatten(grouped), "&")


def normalize_url(url: Column | str, drop: list[str] = lx.TRACKING_PARAMS) -> Column:
    """Stable key of a URL: no tracking parameters, fragment or trailing slash.

    Host, ``www`` and path are left alone. A host with unbalanced brackets cannot be
    parsed, so such a URL is returned unchanged.
    """
    raw = _as_col(url)
    u = F.regexp_replace(raw, "/+$", "")
    part = lambda i: F.regexp_extract(u, _URL, i)
    scheme = F.lower(part(1))
    authority = part(2)
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
                    authority, part(3))
    query = F.when(part(4) != "", clean_query_string(part(4), drop)).otherwise("")
    rebuilt = F.concat(head, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return (
        F.when(F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]")), raw)
        # the regex work is skipped for the plain majority of URLs
        .when(~u.rlike("[?#]") & u.rlike("^(?:[a-z][a-z0-9+.\\-]*:)?//[^/]"), u)
        .otherwise(rebuilt)
    )


def authority(url: Column | str) -> Column:
    """``host[:port]`` of a URL, '' when it has none."""
    return F.regexp_extract(_as_col(url), _AUTHORITY, 1)


def extract_domain(url: Column | str) -> Column:
    """Authority without a leading ``www.``; '' when the URL has none."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def normalise_domain(value: Column | str, prefixes: list[str] = lx.HOST_PREFIXES) -> Column:
    """Canonical bare domain of a URL or domain string."""
    s = F.lower(strip(value))
    host = F.when(
        F.contains(s, F.lit("://")), F.coalesce(F.nullif(authority(s), F.lit("")), s)
    ).otherwise(s)
    host = F.substring_index(host, ":", 1)
    one_prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"
    return F.regexp_replace(F.regexp_replace(host, one_prefix, ""), r"^\.+|\.+$", "")


def extract_root_domain(value: Column | str) -> Column:
    """Registrable part: two labels, or three when the second last is short (co.uk)."""
    # leftmost alternative wins: three labels if the middle one is short, else two, else all
    return F.regexp_extract(
        normalise_domain(value), r"([^.]*\.[^.]{0,3}\.[^.]*|[^.]*\.[^.]*|[^.]*)$", 0
    )


def sanitise_domain(value: Column | str) -> Column:
    """Host part of user input: scheme, path and query cut off."""
    s = F.regexp_replace(F.lower(strip(value)), "(?s)^.*?://", "")
    return F.substring_index(F.substring_index(s, "/", 1), "?", 1)


def domains_match(a: Column | str, b: Column | str) -> Column:
    return normalise_domain(a) == normalise_domain(b)


def host_in(url: Column | str, domains: list[str], mode: str = "suffix") -> Column:
    """True when the URL belongs to one of the domains.

    ``suffix`` compares the host (``x.com`` does not match ``netflix.com``);
    ``substring`` looks anywhere in the URL.
    """
    if mode == "substring":
        u = _as_col(url)
        tests = [F.contains(u, F.lit(d)) for d in domains]
    else:
        host = F.substring_index(F.lower(authority(url)), ":", 1)
        tests = [(host == d) | host.endswith("." + d) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _digest(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def crawl_key(url: Column | str) -> Column:
    return F.concat(F.lit("crawl:"), _digest(_as_col(url), 24))


def memory_key(text: Column | str) -> Column:
    return F.concat(F.lit("mem:text:"), _digest(_as_col(text), 16))


def search_key(provider: Column, query: Column, max_results: Column, *more: Column) -> Column:
    """Cache key of a search call; ``more`` holds the settings that change its results."""
    parts = [provider, query, max_results.cast("string"), *[c.cast("string") for c in more]]
    # a NULL setting must not vanish from the key
    return F.concat(F.lit("search:"),
                    _digest(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 20))


def response_key(model: Column, prompt: Column) -> Column:
    return F.concat(F.lit("llm_resp:"), _digest(F.concat(model, F.lit("|"), prompt), 24))
