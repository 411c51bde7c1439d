"""Text expressions: contacts, keyword signals, names, snippets, conversation lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

from leadloom.functions import lexicons as lx


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_SEP = "\x01"


def strings(values: list[str]) -> Column:
    """A constant array<string>. Split from one literal: lists of words stay cheap to plan."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEP.join(values)), _SEP)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def unicode_spaces(pattern: str) -> str:
    """The pattern with \\s for white space of every kind, as the patterns are meant."""
    return pattern.replace(r"[^\"'\s>]", r"[^\"'>\s\x1c-\x1f\x85\p{Z}]").replace(
        r"[\s", r"[\s\x1c-\x1f\x85\p{Z}").replace(r"\s+", r"[\s\x1c-\x1f\x85\p{Z}]+").replace(
        r"\s*", r"[\s\x1c-\x1f\x85\p{Z}]*")


def emails(text: Column | str, limit: int | None = None) -> Column:
    """Distinct e-mail addresses in first-seen order, the first ``limit`` of them if given."""
    t = _as_col(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(lx.EMAIL_PATTERN), 0))
    # most texts have no @ and skip the regex
    out = F.when(F.contains(t, F.lit("@")), found).otherwise(F.array().cast("array<string>"))
    return F.slice(out, 1, limit) if limit else out


def phones(text: Column | str, limit: int | None = None) -> Column:
    """Distinct phone numbers; groups may be parted by any kind of white space."""
    t = _as_col(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(unicode_spaces(lx.PHONE_PATTERN)), 0))
    out = F.when(t.rlike(unicode_spaces(r"\d{3}[\s\-]\d{3}")), found).otherwise(
        F.array().cast("array<string>")
    )
    return F.slice(out, 1, limit) if limit else out


def social_links(text: Column | str, patterns: dict[str, str] = lx.SOCIAL_PATTERNS) -> Column:
    """Map platform -> first profile link in the text; platforms without a hit are absent."""
    t = _as_col(text)
    entries = [
        F.struct(
            F.lit(name).alias("key"),
            F.regexp_extract(t, "(?i)" + unicode_spaces(pattern), 0).alias("value"),
        )
        for name, pattern in patterns.items()
    ]
    hits = F.filter(F.array(*entries), lambda e: e["value"] != "")
    found = F.map_from_entries(F.transform(
        hits, lambda e: F.struct(e["key"], F.concat(F.lit("https://"), e["value"]))))
    # every pattern has a literal ".com/" or ".co/"; texts without one skip the regexes
    return F.when(F.lower(t).rlike(r"\.com?/"), found).otherwise(
        F.create_map().cast("map<string,string>"))


def social_links_from_hrefs(links: Column) -> Column:
    """The same map looked up in extracted href links instead of visible text."""
    return social_links(F.array_join(links, " "))


def is_valid_email(email: Column | str) -> Column:
    e = F.lower(strip(email))
    host = F.regexp_extract(e, "(?s)^[^@]*@(.*)$", 1)
    junk = reduce(lambda a, b: a | b,
                  [host.rlike("(?i)" + p) for p in lx.JUNK_EMAIL_HOST_PATTERNS])
    return e.rlike("^" + lx.EMAIL_PATTERN + "$") & ~host.isin(lx.DISPOSABLE_EMAIL_HOSTS) & ~junk


def valid_emails(addresses: Column | str) -> Column:
    """Lower-cased, valid, distinct addresses in their order."""
    cleaned = F.transform(_as_col(addresses), lambda e: F.lower(strip(e)))
    return F.filter(F.array_distinct(cleaned), is_valid_email)


def _prefix_tree_pattern(words: list[str], end: str = "") -> str:
    """Regex for the longest of ``words`` at a position, common prefixes shared.

    ``end`` must match after a word; where it does not, a shorter word may.
    """
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        kids = [re.escape(ch) + build(node[ch]) for ch in sorted(k for k in node if k)]
        if "" in node:  # longer words first, then the word that ends here
            kids.append(end)
        return kids[0] if len(kids) == 1 else "(?:" + "|".join(kids) + ")"

    return build(tree)


def _widened(longest: Column, words: list[str], also: Callable[[str, str], bool]) -> Column:
    """Found words and the words that are found wherever they are, sorted."""
    shorter = {w: [v for v in words if also(w, v)] for w in words}
    nested = [w for w in words if len(shorter[w]) > 1]
    if not nested:
        return F.array_sort(longest)
    widen = F.create_map(*[x for w in nested for x in (F.lit(w), strings(shorter[w]))])
    return F.array_sort(F.array_distinct(F.flatten(
        F.transform(longest, lambda m: F.coalesce(widen[m], F.array(m))))))


def _hits_by_prefix_tree(text_lower: Column, words: list[str]) -> Column:
    # One pass however many words there are: a zero-width look-ahead reports the longest word
    # at every position, and the other words that start there are prefixes of it.
    pattern = f"(?=({_prefix_tree_pattern(words)}))"
    longest = F.array_distinct(F.regexp_extract_all(text_lower, F.lit(pattern), 1))
    return _widened(longest, words, lambda w, v: w.startswith(v))


NOT_INSIDE = r"(?!\w)"


def _whole_words(text_lower: Column, words: list[str]) -> Column:
    # the same pass, only between word edges; a prefix counts if it ends at an edge inside
    pattern = rf"(?U)(?<!\w)(?=({_prefix_tree_pattern(words, end=NOT_INSIDE)}))"
    longest = F.array_distinct(F.regexp_extract_all(text_lower, F.lit(pattern), 1))
    return _widened(longest, words, lambda w, v: w == v or (
        w.startswith(v) and not re.match(r"\w", w[len(v)])))


def keyword_hits(text_lower: Column | str, lexicon: list[str] | Column,
                 word_boundary: bool = False) -> Column:
    """Sorted distinct keywords that occur in the lower-cased text.

    Substrings count by default ("go" in "google"); ``word_boundary=True`` wants whole words.
    """
    t = _as_col(text_lower)
    if isinstance(lexicon, list):
        words = sorted(set(lexicon))
        if word_boundary:
            return _whole_words(t, words)
        if len(words) > 8:
            return _hits_by_prefix_tree(t, words)
        return bound(t, lambda x: F.filter(strings(words), lambda k: F.contains(x, k)))
    words = F.array_sort(F.array_distinct(lexicon))
    if word_boundary:
        edged = lambda k: F.concat(
            F.lit(r"(?U)(?<!\w)\Q"), k, F.lit(r"\E(?!\w)"))
        return bound(t, lambda x: F.filter(
            words, lambda k: F.contains(x, k) & F.rlike(x, edged(k))))
    return bound(t, lambda x: F.filter(words, lambda k: F.contains(x, k)))


#: Texts that a search turns into Python strings at once.
_TEXTS = 256


def bulk_keyword_hits(text_lower: Column, words: list[str]) -> Column:
    """``keyword_hits`` for large lexicons: one automaton pass per text, Arrow-batched.

    Needs the library pyahocorasick on all executors. A task builds the automaton once.
    """
    lexicon = sorted(set(words))

    @F.arrow_udf("array<string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in lexicon:
            automaton.add_word(w, w)
        automaton.make_automaton()
        kind = pa.list_(pa.string())
        for texts in batches:  # a batch's texts become Python strings a few at a time
            found = [pa.array([None if t is None else sorted(
                {w for _, w in automaton.iter(t)} if lexicon else ())
                for t in texts.slice(at, _TEXTS).to_pylist()], kind)
                for at in range(0, len(texts), _TEXTS)]
            yield pa.concat_arrays(found) if found else pa.array([], kind)

    return scan(text_lower)


def any_keyword(text_lower: Column | str, words: list[str]) -> Column:
    t = _as_col(text_lower)
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words], F.lit(False))


def decision_maker_role_words() -> list[str]:
    return [k for k in lx.HIRING_KEYWORDS if "cto" in k or "vp" in k]


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_as_col(text), F.lit(r"(?U)\S+"))


def company_name(json_ld: Column, og_site_name: Column, title: Column, domain: Column) -> Column:
    """JSON-LD organisation name, else site name, else head of the title, else domain."""
    def org_name(item: Column) -> Column:
        kind = F.get_json_object(item, "$.@type")
        name = F.coalesce(
            F.nullif(F.get_json_object(item, "$.name"), F.lit("")),
            F.nullif(F.get_json_object(item, "$.legalName"), F.lit("")),
        )
        return F.when(kind.isin("Organization", "Corporation"), name)

    from_ld = F.get(F.filter(F.transform(json_ld, org_name), lambda n: n.isNotNull()), 0)
    head = reduce(
        lambda rest, sep: F.when(
            F.contains(title, F.lit(sep)), strip(F.substring_index(title, sep, 1))
        ).otherwise(rest),
        reversed(lx.TITLE_SEPARATORS),
        F.coalesce(F.nullif(strip(title), F.lit("")), domain),
    )
    return F.coalesce(from_ld, F.nullif(og_site_name, F.lit("")), head)


def company_page_fields(title: Column, description: Column, text: Column) -> Column:
    """Struct of the facts a company profile page states in plain words."""
    industry_line = F.get(
        F.filter(
            F.transform(F.split(text, r"\r\n|\r|\n"), strip),
            lambda s: s.rlike(r"(?i)\b(industry|sector)\b"),
        ),
        0,
    )
    specialties = F.regexp_extract(text, r"(?i)specialt(?:y|ies)[:\s]+([^\n]{10,200})", 1)
    return F.struct(
        strip(F.substring_index(F.coalesce(title, F.lit("")), "|", 1)).alias("company_name"),
        F.coalesce(description, F.lit("")).alias("tagline"),
        F.coalesce(industry_line, F.lit("")).alias("industry"),
        F.regexp_extract(
            text, r"(?i)(\d[\d,]*)\s*(?:to|-)\s*(\d[\d,]*)\s*employees", 0
        ).alias("employee_count"),
        F.regexp_extract(text, r"(?i)founded\s*[:\-]?\s*(\d{4})", 1).alias("founded"),
        strip(
            F.regexp_extract(text, r"(?i)headquartered?\s+(?:in\s+)?([A-Z][^,\n]{2,40})", 1)
        ).alias("headquarters"),
        F.filter(
            F.transform(F.split(specialties, "[,·|]"), strip), lambda s: s != "",
        ).alias("specialties"),
    )


def profile_links(text: Column | str) -> Column:
    """Personal profile links named in the text."""
    t = _as_col(text)
    found = F.regexp_extract_all(t, F.lit(r"(?i)linkedin\.com/in/[\w\-]+"), 0)
    return F.transform(found, lambda m: F.concat(F.lit("https://"), m))


def domain_emails(addresses: Column, domain: Column) -> Column:
    """Addresses that contain the company's domain."""
    base = F.regexp_replace(domain, r"^www\.", "")
    return F.filter(addresses, lambda e: F.contains(F.lower(e), base))


def extractive_summary(text: Column | str, max_chars: int = 400) -> Column:
    """First and last sentence of a text."""
    t = _as_col(text)
    sentences = F.filter(
        F.transform(F.split(t, r"\."), lambda s: strip(s)), lambda s: s != ""
    )
    n = F.size(sentences)
    return (
        F.when(n == 0, F.substring(t, 1, max_chars))
        .when(n <= 2, F.array_join(sentences, ". "))
        .otherwise(
            F.concat(F.get(sentences, F.lit(0)), F.lit(". … "),
                     F.get(sentences, n - 1), F.lit("."))
        )
    )


# every white-space character of Unicode, not only the blank
_WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(_as_col(c), F.lit(_WHITE))


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_as_col(text)) / 4).cast("int"))


def speaker(role: Column | str) -> Column:
    r = _as_col(role)
    out = r
    for name, label in lx.SPEAKERS.items():
        out = F.when(r == name, label).otherwise(out)
    return out


def speaker_line(role: Column | str, content: Column | str) -> Column:
    return F.concat(speaker(role), F.lit(": "), _as_col(content))


def truncate(text: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis when something was cut."""
    t = _as_col(text)
    return F.when(F.length(t) <= n, t).otherwise(
        F.concat(F.substring(t, 1, n - 1), F.lit("…"))
    )


def snippet(text: Column, pos: Column, keyword: Column, window: int = 120) -> Column:
    """``...context...`` around a hit at 0-based ``pos``; NULL when the context is blank."""
    start = F.greatest(F.lit(0), pos - window // 2)
    end = pos + F.length(keyword) + window // 2
    cut = F.substring(text, start + 1, end - start)
    flat = strip(F.replace(cut, F.lit("\n"), F.lit(" ")))
    return F.when(flat != "", F.concat(F.lit("..."), flat, F.lit("...")))


def pick_evidence(hits: Column, window: int = 120, max_snippets: int = 5) -> Column:
    """Fold ordered ``(pos, snip)`` hits into non-overlapping snippets.

    A hit closer than ``window`` characters to an earlier pick is skipped.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("taken"),
        F.array().cast("array<string>").alias("out"),
    )

    def step(state: Column, hit: Column) -> Column:
        overlaps = F.exists(state["taken"], lambda p: F.abs(hit["pos"] - p) < window)
        full = F.size(state["out"]) >= max_snippets
        return F.when(overlaps | full, state).otherwise(
            F.struct(
                F.concat(state["taken"], F.array(hit["pos"])).alias("taken"),
                F.concat(
                    state["out"],
                    F.filter(F.array(hit["snip"]), lambda s: s.isNotNull()),
                ).alias("out"),
            )
        )

    return F.aggregate(hits, start, step, lambda s: s["out"])


def locate(text: Column, text_lower: Column, keywords: Column, window: int = 120) -> Column:
    """``(term, pos, snip)`` of the first hit of each keyword, in keyword order."""
    present = F.filter(keywords, lambda k: F.contains(text_lower, k))
    placed = F.transform(
        present,
        lambda k: F.struct(k.alias("term"), (F.instr(text_lower, k) - 1).alias("pos")),
    )
    return F.transform(
        placed,
        lambda h: F.struct(
            h["term"].alias("term"),
            h["pos"].alias("pos"),
            snippet(text, h["pos"], h["term"], window).alias("snip"),
        ),
    )


def extract_evidence(text: Column | str, keywords: Column, window: int = 120,
                     max_snippets: int = 5) -> Column:
    t = _as_col(text)
    return bound(F.lower(t), lambda low: pick_evidence(
        locate(t, low, keywords, window), window, max_snippets))


# -- query text -----------------------------------------------------------------

def strip_controls(text: Column | str) -> Column:
    return F.regexp_replace(_as_col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def sanitise_query(text: Column | str, max_chars: int = lx.MAX_QUERY_CHARS) -> Column:
    """Cleaned query text before the injection test (which looks at the untrimmed form)."""
    return F.substring(strip_controls(text), 1, max_chars)


def injection_rule(text: Column) -> Column:
    """First injection pattern that the text matches, NULL when clean."""
    return F.coalesce(*[
        F.when(text.rlike("(?i)" + unicode_spaces(p)), F.lit(p)) for p in lx.INJECTION_PATTERNS
    ])
