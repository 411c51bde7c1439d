"""URL, domain, e-mail, keyword and text functions over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import lexicons as lx, text as X, urls as U
from leadloom.plans.inputs import documents, sql_domain, sql_list, sql_normalize, table
from leadloom.plans.registry import query

_JOIN = lambda c: F.array_join(c, "|")

# every page URL with more parameters: repeated, blank, tracking and encoded ones
_RICH = (
    "url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=' || page_id"
    " || '&a=&utm_term=z&b=x%20y%2Fz&c=~+q&page=9'"
)


@query("x01_normalize_url", f"""
SELECT page_id, {sql_normalize('u')} AS norm_url, {sql_normalize('url')} AS norm_plain
FROM (SELECT page_id, url, {_RICH} AS u FROM pages)""")
def normalize(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.expr(_RICH).alias("u"))
    return p.select("page_id", U.normalize_url("u").alias("norm_url"),
                    U.normalize_url("url").alias("norm_plain"))


@query("x02_extract_domain", f"""
SELECT page_id, {sql_domain('url')} AS domain FROM pages""")
def domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.extract_domain("url").alias("domain"))


_SQL_NORM_DOMAIN = """trim(regexp_replace(
  split_part(CASE WHEN contains(s, '://')
    THEN split_part(split_part(split_part(split_part(s, '://', 2), '/', 1), '?', 1), '#', 1)
    ELSE s END, ':', 1),
  '^(www|mail|app|jobs|careers|blog|shop|help|support|api)[.]', ''), '.')"""
# full URLs, upper case with a port, and bare host/path forms
_SQL_DOMAIN_FORMS = """
  SELECT page_id, 'url' AS form, lower(trim(url)) AS s FROM pages
  UNION ALL SELECT page_id, 'port', lower(replace(url, '.example.', '.EXAMPLE.'))
    || ':8080' FROM pages
  UNION ALL SELECT page_id, 'bare', lower(regexp_replace(url, '^[a-z]+://', '')) FROM pages"""


def _domain_forms(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return (
        p.select("page_id", F.lit("url").alias("form"), F.col("url").alias("s"))
        .unionByName(p.select("page_id", F.lit("port").alias("form"), F.concat(
            F.replace("url", F.lit(".example."), F.lit(".EXAMPLE.")), F.lit(":8080")).alias("s")))
        .unionByName(p.select("page_id", F.lit("bare").alias("form"),
                              F.regexp_replace("url", "^[a-z]+://", "").alias("s")))
    )


@query("x03_normalise_domain", f"""
SELECT page_id, form, {_SQL_NORM_DOMAIN} AS domain FROM ({_SQL_DOMAIN_FORMS})""")
def norm_domain(spark, d):
    return _domain_forms(spark, d).select(
        "page_id", "form", U.normalise_domain("s").alias("domain"))


@query("x04_extract_root_domain", f"""
SELECT page_id, form, CASE
    WHEN len(ps) >= 3 AND length(ps[len(ps) - 1]) <= 3
      THEN array_to_string(ps[len(ps) - 2:len(ps)], '.')
    WHEN len(ps) >= 2 THEN array_to_string(ps[len(ps) - 1:len(ps)], '.')
    ELSE dom END AS root
FROM (SELECT page_id, form, dom, string_split(dom, '.') AS ps
  FROM (SELECT page_id, form, {_SQL_NORM_DOMAIN} AS dom FROM ({_SQL_DOMAIN_FORMS})))""")
def root_domain(spark, d):
    return _domain_forms(spark, d).select(
        "page_id", "form", U.extract_root_domain("s").alias("root"))


@query("x05_sanitise_domain", """
SELECT page_id, split_part(split_part(regexp_replace(lower(trim(url)), '^[a-z]+://', ''),
  '/', 1), '?', 1) AS host FROM pages""")
def host(spark, d):
    return table(spark, d, "pages").select("page_id", U.sanitise_domain("url").alias("host"))


@query("x06_cache_keys", """
SELECT page_id, 'crawl:' || substr(sha256(url), 1, 24) AS crawl_key,
  'mem:text:' || substr(sha256(url), 1, 16) AS memory_key,
  'search:' || substr(sha256('p' || (page_id % 3) || ':' || url || ':10:web:'), 1, 20)
    AS search_key
FROM pages""")
def cache_keys(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.crawl_key("url").alias("crawl_key"),
        U.memory_key("url").alias("memory_key"),
        U.search_key(F.concat(F.lit("p"), F.col("page_id") % 3), F.col("url"), F.lit(10),
                     F.lit("web"), F.lit(None).cast("string")).alias("search_key"))


_SQL_EMAILS = f"""list_filter(em, lambda e, i: list_position(em, e) = i) AS es
FROM (SELECT doc_id, regexp_extract_all(text, '{lx.EMAIL_PATTERN}') AS em FROM documents)"""


@query("x10_emails", f"""
SELECT doc_id, array_to_string(es, '|') AS emails FROM (
  SELECT doc_id, {_SQL_EMAILS}) WHERE len(es) > 0""")
def emails(spark, d):
    return documents(spark, d).select("doc_id", X.emails("text").alias("e")).filter(
        F.size("e") > 0).select("doc_id", _JOIN(F.col("e")).alias("emails"))


@query("x11_phones", f"""
SELECT doc_id, array_to_string(ps, '|') AS phones FROM (
  SELECT doc_id, list_filter(ph, lambda e, i: list_position(ph, e) = i) AS ps
  FROM (SELECT doc_id, regexp_extract_all(text, '{lx.PHONE_PATTERN}') AS ph FROM documents))
WHERE len(ps) > 0""")
def phones(spark, d):
    return documents(spark, d).select("doc_id", X.phones("text").alias("p")).filter(
        F.size("p") > 0).select("doc_id", _JOIN(F.col("p")).alias("phones"))


# the texts name no profiles, so every other kind of mention is built around the host
_SOCIAL_TEXT = (
    "text || ' see LinkedIn.com/company/' || source || ' or github.com/' || lang"
    " || '/' || doc_id || ', x.com/' || source || '>'"
)


@query("x12_social_links", f"""
SELECT doc_id,
  'https://' || regexp_extract(t, '(?i)linkedin\\.com/(?:company|in)/[^"''\\s>]+') AS linkedin,
  'https://' || regexp_extract(t, '(?i)github\\.com/[^"''\\s>]+') AS github,
  'https://' || regexp_extract(t, '(?i)(?:twitter|x)\\.com/[^"''\\s>]+') AS twitter,
  NULL AS crunchbase
FROM (SELECT doc_id, {_SOCIAL_TEXT} AS t FROM documents)""")
def social(spark, d):
    docs = documents(spark, d).select("doc_id", F.expr(_SOCIAL_TEXT).alias("t"))
    links = docs.select("doc_id", X.social_links("t").alias("m"))
    return links.select("doc_id", *[F.col("m")[k].alias(k) for k in
                                    ("linkedin", "github", "twitter", "crunchbase")])


# addresses of every kind per customer: plain, upper case, disposable, junk, image, broken
_SQL_ADDRESSES = """list_value(
  lower(replace(c_name, '#', '.')) || '@corp' || c_nationkey || '.io',
  upper(replace(c_name, '#', '.')) || '@CORP' || c_nationkey || '.IO ',
  'a' || c_custkey || '@mailinator.com', 'b@example.org', 'logo@2x.png',
  'x' || c_custkey || '@sub.' || lower(c_mktsegment) || '.com', 'no-at.com', 'c@d')"""


@query("x13_valid_emails", f"""
SELECT c_custkey, array_to_string(list_filter(es, lambda e, i: list_position(es, e) = i), '|')
  AS valid
FROM (SELECT c_custkey, list_filter(
    list_transform({_SQL_ADDRESSES}, lambda e: lower(trim(e))),
    lambda e: regexp_matches(e, '^{lx.EMAIL_PATTERN}$')
      AND NOT list_contains({sql_list(lx.DISPOSABLE_EMAIL_HOSTS)}, split_part(e, '@', 2))
      AND NOT regexp_matches(split_part(e, '@', 2), '\\.(png|jpg|gif|css|js|svg|ico)$')
      AND NOT regexp_matches(split_part(e, '@', 2), 'example\\.(com|org|net)$')) AS es
  FROM customer)""")
def valid_emails(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", _JOIN(X.valid_emails(
        F.expr(_SQL_ADDRESSES.replace("list_value", "array")))).alias("valid"))


def _sql_hits(words: list[str], text: str = "tl") -> str:
    return (f"list_sort(list_filter({sql_list(sorted(set(words)))}, "
            f"lambda k: contains({text}, k)))")


_PROSE_WORDS = ["thering", "avec", "nicht", "para", "blest", "ention", "the", "thereth", "ther",
                "dans", "edthat", "queen"]


_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
_SQL_WHOLE = "concat_ws('|', " + ", ".join(
    f"CASE WHEN regexp_matches(tl, '(^|{_EDGE}){w}($|{_EDGE})') THEN '{w}' END"
    for w in sorted(_PROSE_WORDS)) + ")"


@query("x14_keyword_hits", f"""
SELECT doc_id, array_to_string({_sql_hits(_PROSE_WORDS)}, '|') AS hits,
  {_SQL_WHOLE} AS whole_words
FROM (SELECT doc_id, lower(text) AS tl FROM documents)""")
def keyword_hits(spark, d):
    docs = documents(spark, d).select("doc_id", F.lower("text").alias("t"))
    return docs.select(
        "doc_id", _JOIN(X.keyword_hits("t", _PROSE_WORDS)).alias("hits"),
        _JOIN(X.keyword_hits("t", _PROSE_WORDS, word_boundary=True)).alias("whole_words"))


def _register_lexicon(name: str, words: list[str]) -> None:
    @query(name, f"""
SELECT doc_id, array_to_string(hs, '|') AS hits FROM (
  SELECT doc_id, {_sql_hits(words)} AS hs
  FROM (SELECT doc_id, lower(CASE WHEN doc_id % 7 = 0 THEN text || ' We ' || {sql_list(words)}[
    (doc_id // 7) % {len(words)} + 1] ELSE text END) AS tl FROM documents)) WHERE len(hs) > 0""")
    def run(spark, d):
        # the prose holds few of these words, so some texts say one more
        said = F.get(F.lit(words), F.pmod(F.floor(F.col("doc_id") / 7), F.lit(len(words))).cast("int"))
        docs = documents(spark, d).withColumn("text", F.when(
            F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" We "), said)).otherwise(F.col("text")))
        return docs.select("doc_id", X.keyword_hits(F.lower("text"), words).alias("h")).filter(
            F.size("h") > 0).select("doc_id", _JOIN(F.col("h")).alias("hits"))


_register_lexicon("x15_tech_stack", lx.TECH_KEYWORDS + ["thering", "avec"])
_register_lexicon("x16_hiring_signals", lx.HIRING_KEYWORDS)
_register_lexicon("x17_outsourcing_signals", lx.OUTSOURCING_KEYWORDS)
_register_lexicon("x18_business_events", lx.FUNDING_KEYWORDS + lx.BUSINESS_EVENT_KEYWORDS)
_register_lexicon("x19_decision_maker_hints", ["ention", "unge"] + X.decision_maker_role_words())
_register_lexicon("x20_industry_signals", ["dans", "edthat", "para"])

@query("x21_company_name", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Org ' || doc_id
  WHEN doc_id % 5 = 1 THEN 'Legal ' || doc_id
  WHEN doc_id % 5 = 2 THEN 'Site ' || source
  WHEN doc_id % 5 = 3 THEN trim(split_part(CASE WHEN contains(t, ' | ') THEN
    split_part(t, ' | ', 1) ELSE t END, ' - ', 1))
  ELSE source || '.org' END AS company_name
FROM (SELECT doc_id, source, source || ' - ' || lang || CASE WHEN lang = 'en' THEN ' | x'
  ELSE '' END AS t FROM documents)""")
def company_name(spark, d):
    docs = documents(spark, d)
    n = F.col("doc_id") % 5
    person = F.lit('{"@type":"Person","name":"Nobody"}')
    ld = F.when(n == 0, F.array(person, F.concat(
        F.lit('{"@type":"Organization","name":"Org '), "doc_id", F.lit('"}')))).when(
        n == 1, F.array(person, F.concat(
            F.lit('{"@type":"Corporation","name":"","legalName":"Legal '), "doc_id",
            F.lit('"}')))).otherwise(F.array(person))
    title = F.when(n == 4, " ").otherwise(F.concat(
        "source", F.lit(" - "), "lang", F.when(F.col("lang") == "en", " | x").otherwise("")))
    # the first separator in list order wins, so "a - b | x" is cut at the bar
    name = X.company_name(
        ld, F.when(n == 2, F.concat(F.lit("Site "), "source")).otherwise(""), title,
        F.concat("source", F.lit(".org")))
    return docs.select("doc_id", F.when(
        n == 3, F.trim(F.substring_index(name, " - ", 1))).otherwise(name).alias("company_name"))


@query("x22_word_count", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents""")
def words(spark, d):
    return documents(spark, d).select("doc_id", X.word_count("text").alias("words"))


_PROFILE_TEXT = (
    "text || chr(10) || ' Industry: ' || source || ' sector ' || chr(10) || 'Has 1,0' || lang"
    " || ' 50 to 2,' || doc_id || '00 employees. Founded: 19' || right('0' || doc_id, 2)"
    " || '. Headquartered in Port ' || lang || ', far' || chr(10) || 'Specialties: ' || source"
    " || ', ' || lang || ' | data work · ' || doc_id"
)


@query("x23_company_page_fields", f"""
SELECT doc_id, trim(split_part(source || ' | Network', '|', 1)) AS company_name,
  'Industry: ' || source || ' sector' AS industry,
  regexp_extract(t, '(?i)(\\d[\\d,]*)\\s*(?:to|-)\\s*(\\d[\\d,]*)\\s*employees') AS employees,
  regexp_extract(t, '(?i)founded\\s*[:\\-]?\\s*(\\d{{4}})', 1) AS founded,
  trim(regexp_extract(t, '(?i)headquartered?\\s+(?:in\\s+)?([A-Z][^,\\n]{{2,40}})', 1)) AS hq,
  source || ';' || lang || ';data work;' || doc_id AS specialties
FROM (SELECT doc_id, source, lang, {_PROFILE_TEXT} AS t FROM documents)""")
def company_page_fields(spark, d):
    docs = documents(spark, d).select(
        "doc_id", "source", F.expr(_PROFILE_TEXT).alias("t"))
    f = X.company_page_fields(
        F.concat("source", F.lit(" | Network")), F.lit(""), F.col("t"))
    return docs.select("doc_id", f.alias("f")).select(
        "doc_id", "f.company_name", "f.industry", F.col("f.employee_count").alias("employees"),
        "f.founded", F.col("f.headquarters").alias("hq"),
        F.array_join("f.specialties", ";").alias("specialties"))


@query("x25_extractive_summary", r"""
SELECT doc_id, CASE WHEN len(ss) = 0 THEN substr(text, 1, 400)
  WHEN len(ss) <= 2 THEN array_to_string(ss, '. ')
  ELSE ss[1] || '. … ' || ss[len(ss)] || '.' END AS summary
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, '.'),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM documents)
""")
def summary(spark, d):
    return documents(spark, d).select(
        "doc_id", X.extractive_summary("text").alias("summary"))


@query("x26_estimate_tokens", """
SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents""")
def tokens(spark, d):
    return documents(spark, d).select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query("x27_speaker_line", """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant'
  WHEN 'system' THEN 'System' ELSE role END || ': ' || text AS line FROM conversations""")
def speaker_line(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.speaker_line("role", "text").alias("line"))


@query("x28_truncate", """
SELECT page_id, CASE WHEN length(url) <= 40 THEN url ELSE substr(url, 1, 39) || '…' END AS short
FROM pages""")
def truncate(spark, d):
    return table(spark, d, "pages").select("page_id", X.truncate("url", 40).alias("short"))


@query("x29_snippet", r"""
SELECT doc_id, CASE WHEN sn <> '' THEN '...' || sn || '...' END AS snippet FROM (
  SELECT doc_id, regexp_replace(replace(substr(text, greatest(0, pos - 60) + 1,
    pos + 3 + 60 - greatest(0, pos - 60)), chr(10), ' '), '^\s+|\s+$', '', 'g') AS sn
  FROM (SELECT doc_id, text, instr(lower(text), 'the') - 1 AS pos FROM documents)
  WHERE pos >= 0)""")
def snippet(spark, d):
    docs = documents(spark, d).select(
        "doc_id", "text", (F.instr(F.lower("text"), "the") - 1).alias("pos"))
    return docs.filter("pos >= 0").select(
        "doc_id", X.snippet(F.col("text"), F.col("pos"), F.lit("the")).alias("snippet"))


@query("p14_domain_emails", f"""
SELECT c_custkey, array_to_string(list_filter({_SQL_ADDRESSES},
  lambda e: contains(lower(e), 'corp' || c_nationkey || '.io')), '|') AS own FROM customer""")
def domain_emails(spark, d):
    return table(spark, d, "customer").select("c_custkey", _JOIN(X.domain_emails(
        F.expr(_SQL_ADDRESSES.replace("list_value", "array")),
        F.concat(F.lit("www.corp"), "c_nationkey", F.lit(".io")))).alias("own"))


@query("u07_ordered_distinct", """
SELECT doc_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ')
  AS words
FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)""")
def ordered_distinct(spark, d):
    return documents(spark, d).select(
        "doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))
