"""Conversation windows and compaction over the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.operators import conversations as CV
from leadloom.plans.inputs import table, with_ctes
from leadloom.plans.registry import query
from leadloom.session import fresh_path
from leadloom.streaming import conversations as SC, jobs

# the given conversations are short, so the limits are small as well
_LIMITS = dict(max_tokens=150, max_turns=4, chunk=2)


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
        F.col("text").alias("content"))


_SQL_TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role,
  text AS content, greatest(1, length(text) // 4) AS tokens FROM conversations)"""


@query("w08_last_turns", with_ctes(_SQL_TURNS, select="""
SELECT session_id, turn, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY turn DESC) AS rn FROM turns) WHERE rn <= 3"""))
def last_turns(spark, d):
    return CV.last_turns(turns(spark, d), 3).select("session_id", "turn", "content")


@query("w11_bounded_history", with_ctes(_SQL_TURNS, select="""
SELECT session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY turn DESC) AS rn FROM turns) WHERE rn <= 50"""))
def bounded(spark, d):
    return CV.last_turns(turns(spark, d), 50).select("session_id", "turn", "role")


@query("x27_transcript", with_ctes(_SQL_TURNS, select="""
SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant'
  WHEN 'system' THEN 'System' ELSE role END || ': ' || content, chr(10) ORDER BY turn) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM turns)
WHERE rn <= 4 GROUP BY session_id"""))
def transcript(spark, d):
    return CV.transcript(turns(spark, d), 4)


_LABEL = "CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant' ELSE role END"


@query("w07_context_window", with_ctes(_SQL_TURNS, select=f"""
SELECT session_id, string_agg({_LABEL} || ': ' || content, chr(10) ORDER BY turn) AS context
FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC) AS used FROM turns)
WHERE used <= 300 GROUP BY session_id"""))
def context_window(spark, d):
    return CV.context_text(turns(spark, d), 300)


@query("r07_append_note", r"""
SELECT doc_id, right(regexp_replace(text || chr(10) || text, '^\s+|\s+$', '', 'g'), 2000)
  AS summary FROM documents""")
def append_note(spark, d):
    return table(spark, d, "documents").select("doc_id", CV.append_note(
        F.col("text"), F.col("text")).alias("summary"))


_SUMMARY = r"""(SELECT CASE WHEN len(ss) = 0 THEN substr(ct, 1, 400)
    WHEN len(ss) <= 2 THEN array_to_string(ss, '. ') ELSE ss[1] || '. … ' || ss[len(ss)] || '.' END
  FROM (SELECT list_filter(list_transform(string_split(ct, '.'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss))"""
# one turn after the other: h is the first held turn, s the rolling summary
_SQL_WALK = rf"""lists AS (SELECT session_id, list(tokens ORDER BY turn) AS toks,
  list(role || ': ' || content ORDER BY turn) AS lines FROM turns GROUP BY session_id),
walk(session_id, i, h, s, text, fired) AS (
  SELECT session_id, 0, 0, '', NULL::VARCHAR, false FROM lists
  UNION ALL
  SELECT session_id, i + 1, CASE WHEN fire THEN h1 + 2 ELSE h1 END,
    CASE WHEN fire THEN right(regexp_replace(s || chr(10) || {_SUMMARY}, '^\s+|\s+$', '', 'g'), 4000)
      ELSE s END, CASE WHEN fire THEN {_SUMMARY} END, fire
  FROM (SELECT session_id, i, s, h1, array_to_string(lines[h1 + 1:h1 + 2], chr(10)) AS ct,
      list_sum(toks[h1 + 1:i + 1]) > 150 AND i + 1 - h1 >= 2 AS fire
    FROM (SELECT w.session_id, w.i, w.s, greatest(w.h, w.i + 1 - 4) AS h1, l.toks, l.lines
      FROM walk w JOIN lists l USING (session_id) WHERE w.i < len(l.toks))))"""


def _recursive(*ctes: str, select: str) -> str:
    return with_ctes(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


_SQL_EVENTS = _recursive(_SQL_TURNS, _SQL_WALK, select="""
SELECT session_id, CAST(i - 1 AS BIGINT) AS pos, 2 AS turns_compacted,
  substr(text, 1, 120) AS summary_preview, CAST(length(s) AS INTEGER) AS new_summary_chars
FROM walk WHERE fired""")
_SQL_STATE = _recursive(_SQL_TURNS, _SQL_WALK, select="""
SELECT session_id, CAST(i - h AS INTEGER) AS turns_in_buffer,
  CAST(coalesce(list_sum(toks[h + 1:i]), 0) AS BIGINT) AS estimated_tokens, s <> '' AS has_summary,
  CAST(length(s) AS INTEGER) AS summary_chars, s AS rolling_summary
FROM walk JOIN lists USING (session_id) WHERE i = len(toks)""")


@query("r06_compaction_events", _SQL_EVENTS)
def compaction_events(spark, d):
    # blocks of four turns, so that the longer sessions span several
    return CV.compact(turns(spark, d), **_LIMITS, block=4)[0]


@query("a20_conversation_stats", _SQL_STATE)
def stats(spark, d):
    return CV.compact(turns(spark, d), **_LIMITS)[1].select(
        "session_id", "turns_in_buffer", "estimated_tokens", "has_summary", "summary_chars",
        "rolling_summary")


def _streamed(spark, d) -> DataFrame:
    source = jobs.read_files(spark, d, "conversations.parquet").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
        F.col("text").alias("content"))
    with jobs.rocksdb(spark):
        out = jobs.drain(spark, SC.compact_stream(spark, source, **_LIMITS), "compaction",
                         "update")
    return SC.rolling_summaries(out, ["batch", "turn"])


@query("r06_compaction_stream", _SQL_EVENTS)
def compaction_stream(spark, d):
    return _streamed(spark, d).filter("kind = 'compacted'").select(
        "session_id", F.col("turn").alias("pos"), "turns_compacted", "summary_preview",
        "new_summary_chars")


# Sessions start at one of ten times; turns come 0, 60 or 120 minutes after they were said, so those
# of a session arrive out of order, in files of 200 minutes each. The last two hours still wait.
_SQL_SAID = _SQL_TURNS.replace(
    "turns AS (SELECT", "said AS (SELECT conv_id % 10 * 100 + turn * 10 AS minute,", 1)
_SQL_SETTLED = "turns AS (SELECT * FROM said WHERE minute < (SELECT max(minute) FROM said) - 120)"


def _fed(spark, d) -> DataFrame:
    minute = F.col("session_id").cast("long") % 10 * 100 + F.col("turn") * 10
    delay = (F.col("session_id").cast("long") + F.col("turn") * 7) % 3 * 60
    said = turns(spark, d).withColumns({
        "timestamp": F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60),
        "file": F.floor((minute + delay) / 200)})
    path = fresh_path(spark, "feed")
    for i in range(6):
        said.filter(F.col("file") == i).repartition(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@query("r06_compaction_event_time", _recursive(
    _SQL_SAID, _SQL_SETTLED, _SQL_WALK, select=_SQL_EVENTS[_SQL_EVENTS.rindex("SELECT session_id"):]))
def compaction_event_time(spark, d):
    with jobs.rocksdb(spark):
        out = jobs.drain(spark, SC.compact_by_time(_fed(spark, d), **_LIMITS, lateness="2 hours"),
                         "compaction", "update")
    return SC.rolling_summaries(out.filter("kind = 'compacted'"), ["batch", "turn"]).select(
        "session_id", F.col("turn").alias("pos"), "turns_compacted", "summary_preview",
        "new_summary_chars")


@query("w07_context_with_summary", _recursive(
    _SQL_TURNS, _SQL_WALK, """ended AS (SELECT session_id, s, CASE WHEN s = '' THEN 0 ELSE
    greatest(1, (length(s) + 41) // 4) END AS taken
  FROM walk JOIN lists USING (session_id) WHERE i = len(toks))""", select=f"""
SELECT session_id, concat_ws(chr(10), CASE WHEN s <> '' THEN '[Context summary]' || chr(10) || s
    || chr(10) || chr(10) || '[Recent conversation]' END, recent) AS context
FROM ended LEFT JOIN (SELECT session_id, string_agg({_LABEL} || ': ' || content, chr(10)
    ORDER BY turn) AS recent FROM (SELECT t.*, taken, sum(tokens) OVER (PARTITION BY session_id
      ORDER BY turn DESC) AS used FROM turns t JOIN ended USING (session_id))
  WHERE used <= 300 - taken GROUP BY session_id) USING (session_id)"""))
def context_with_summary(spark, d):
    t = turns(spark, d)
    return CV.context_text(t, 300, CV.compact(t, **_LIMITS)[1])
