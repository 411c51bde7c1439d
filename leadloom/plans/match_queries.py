"""Directory, job-posting and domain matching over parts, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.functions import urls as U
from leadloom.operators import matching as M
from leadloom.plans.inputs import documents, table
from leadloom.plans.registry import query
from leadloom.session import fresh_path
from leadloom.sources import files

_SQL_DIRECTORY = """directory AS (SELECT p_partkey, 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
    AS slug, p_name AS name, p_type AS one_liner, 'made by ' || p_brand AS long_description,
    p_brand AS tag, p_size % 2 = 0 AS active, p_retailprice > 1000 AS is_hiring FROM part),
asked AS (SELECT DISTINCT p_name || ' ' || lower(p_brand) || ' of' AS query FROM part)"""


def directory(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_name").alias("name"),
        F.concat(F.lit("c"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("slug"),
        F.lit("").alias("url"), F.col("p_type").alias("one_liner"),
        F.concat(F.lit("made by "), "p_brand").alias("long_description"),
        F.array("p_brand").alias("tags"), F.lit("W24").alias("batch"),
        F.col("p_size").cast("string").alias("team_size"), F.lit("").alias("location"),
        F.when(F.col("p_size") % 2 == 0, "Active").otherwise("Inactive").alias("status"),
        (F.col("p_retailprice") > 1000).alias("is_hiring"))


def directory_queries(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.concat(
        "p_name", F.lit(" "), F.lower("p_brand"), F.lit(" of")).alias("query")).distinct()


_SQL_BEST = f"""WITH {_SQL_DIRECTORY},
words AS (SELECT query, unnest(list_distinct(list_filter(string_split(lower(query), ' '),
  lambda w: length(w) > 2))) AS word FROM asked),
scored AS (SELECT query, slug, CAST(sum(CASE WHEN contains(lower(name), word) THEN 4
    WHEN contains(lower(one_liner), word) THEN 2
    WHEN contains(lower(long_description || ' ' || tag), word) THEN 1 ELSE 0 END)
    + CAST(any_value(active) AS INTEGER) + CAST(any_value(is_hiring) AS INTEGER) AS BIGINT)
    AS score FROM words, directory GROUP BY query, slug),
best AS (SELECT query, slug, score, CAST(row_number() OVER (PARTITION BY query
  ORDER BY score DESC, slug) AS INTEGER) AS rank FROM scored WHERE score > 0)
"""


@query("j07_directory_match", _SQL_BEST + """
SELECT query, slug, score, rank FROM best WHERE rank <= 10""")
def directory_match(spark, d):
    asked = directory_queries(spark, d)
    return M.directory_match(directory(spark, d), asked, 10, key="query").select(
        "query", "slug", "score", "rank")


@query("s12_company_directory", _SQL_BEST + """
SELECT query, rank, name AS title, 'https://' || slug || '.com' AS href,
  one_liner || ' | Tags: ' || tag || ' | YC W24' AS body
FROM best JOIN directory USING (slug) WHERE rank <= 3""")
def company_directory(spark, d):
    path = fresh_path(spark, "directory")
    directory(spark, d).write.json(path)
    landed = files.read_directory(spark, path)
    best = M.directory_match(landed, directory_queries(spark, d), 3, key="query")
    return M.directory_result(best).select("query", "rank", "title", "href", "body")


# job boards: every document is a posting of its source's company
_SQL_JOBS = """WITH posted AS (SELECT source AS slug, doc_id AS posting_id, lang AS role,
    list_distinct(string_split(regexp_replace(lower({text}), '\\s+', ' ', 'g'), ' ')) AS ws
  FROM documents),
asked AS (SELECT item_id AS query_id, unnest(list_distinct(string_split(
    regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' '))) AS word FROM benchmark),
rel AS (SELECT DISTINCT query_id, slug, posting_id, role FROM
  (SELECT slug, posting_id, role, unnest(ws) AS word FROM posted) JOIN asked USING (word)),
totals AS (SELECT slug, count(*) AS total_postings FROM posted GROUP BY slug)
SELECT query_id, slug, count(*) AS relevant, any_value(total_postings) AS total_postings,
  array_to_string(list(role ORDER BY posting_id)[1:5], ',') AS roles,
  slug || ' — ' || count(*) || ' {label}' AS title FROM rel JOIN totals USING (slug)
GROUP BY query_id, slug"""


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _jobs(out: DataFrame) -> DataFrame:
    return out.select("query_id", "slug", "relevant", "total_postings",
                      F.array_join("hiring_roles", ",").alias("roles"), "title")


@query("j08_job_match", _SQL_JOBS.replace("{text}", "lang || ' ' || text").replace(
    "{label}", "open engineering roles"))
def job_match(spark, d):
    posted = documents(spark, d).select(
        F.col("source").alias("slug"), F.col("doc_id").alias("posting_id"), "lang", "text")
    return _jobs(M.job_match(posted, _asked(spark, d),
                             F.concat("lang", F.lit(" "), "text"), "lang"))


@query("s13_job_board_a", _SQL_JOBS.replace("{text}", "lang || ' ' || text").replace(
    "{label}", "open engineering roles"))
def job_board_a(spark, d):
    path = fresh_path(spark, "board-a")
    table(spark, d, "documents").select(
        F.col("source").alias("slug"), F.col("doc_id").alias("posting_id"),
        F.array(F.struct(F.col("lang").alias("title"), F.col("text").alias("content")))
        .alias("jobs")).write.json(path)
    jobs = files.read_job_board_a(spark, path, "posting_id long")
    return _jobs(M.job_match(jobs, _asked(spark, d),
                             F.concat("title", F.lit(" "), "content"), "title"))


@query("s14_job_board_b", _SQL_JOBS.replace("{text}", "text || ' ' || lang").replace(
    "{label}", "hiring engineering roles").replace("' — ' || count(*) || ' hiring e",
                                                   "' — hiring ' || count(*) || ' e")
       .replace("lang AS role", "lang AS role"))
def job_board_b(spark, d):
    path = fresh_path(spark, "board-b")
    table(spark, d, "documents").select(
        F.col("source").alias("slug"), F.col("doc_id").alias("posting_id"), "text",
        F.struct(F.col("lang").alias("team")).alias("categories")).write.json(path)
    posts = files.read_job_board_b(spark, path, "posting_id long").withColumn(
        "team", F.col("categories.team"))
    out = M.job_match(posts, _asked(spark, d), F.concat("text", F.lit(" "), "team"), "team")
    return _jobs(out.withColumn("title", F.concat(
        "slug", F.lit(" — hiring "), "relevant", F.lit(" engineering roles"))))


@query("j14_domain_match", r"""
WITH norm AS (SELECT page_id, url, regexp_replace(split_part(regexp_extract(lower(url),
  '^[a-z]+://([^/?#]*)', 1), ':', 1),
  '^(www|mail|app|jobs|careers|blog|shop|help|support|api)[.]', '') AS dom FROM pages)
SELECT l.page_id, l.dom AS match_domain, r.company, r.spellings
FROM norm l LEFT JOIN (SELECT dom, min(page_id) AS company, count(*) AS spellings FROM norm
  WHERE starts_with(url, 'https') GROUP BY dom) r USING (dom)""")
def domain_match(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    known = p.filter(F.col("url").startswith("https")).select(
        "page_id", F.upper(U.authority("url")).alias("site"))
    return M.match_domains(p, "url", known, "site", "page_id").select(
        "page_id", "match_domain", "company", "spellings")
