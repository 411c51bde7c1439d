"""Conversation windows and compaction.

A session may hold any number of turns. Windows that keep few rows cut each group before it
is shuffled. Compaction is sequential by nature, yet the only thing that carries over from one
turn to the next is how many turns are held (0..max_turns). A block of turns therefore acts as
a small table "held before -> held after"; blocks are worked out independently, the tables are
chained, and each block is then replayed from its known start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import text as X
from leadloom.operators.groups import dense_positions, running_sum, within_budget
from leadloom.operators.scoring import top_n

KEY = "session_id"
MAX_TOKENS, MAX_TURNS, CHUNK = 6_000, 40, 10
SUMMARY_CHARS, NOTE_CHARS, PREVIEW_CHARS = 4_000, 2_000, 120


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` turns of each session."""
    return top_n(turns, [KEY], [F.desc("turn")], n)


def transcript(turns: DataFrame, n: int = 10) -> DataFrame:
    """Speaker lines of the last ``n`` turns as one text per session, oldest first."""
    lines = F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("t"), X.speaker_line("role", "content").alias("line"))))
    return last_turns(turns, n).groupBy(KEY).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def _label_line() -> Column:
    # the window labels only these two, any other role stands as it is
    label = F.when(F.col("role") == "user", "Human").when(
        F.col("role") == "assistant", "Assistant").otherwise(F.col("role"))
    return F.concat(label, F.lit(": "), "content")


def summary_prefix(summary: Column) -> Column:
    return F.concat(F.lit("[Context summary]\n"), summary, F.lit("\n\n[Recent conversation]"))


def budget_turns(turns: DataFrame, budget: int = MAX_TOKENS, summaries: DataFrame | None = None
                 ) -> DataFrame:
    """Newest turns whose tokens fit the budget that the rolling summary leaves."""
    left = F.lit(budget)
    if summaries is not None:
        turns = turns.join(summaries.select(KEY, "rolling_summary"), KEY, "left")
        has = F.coalesce(F.col("rolling_summary"), F.lit("")) != ""
        left = F.lit(budget) - F.when(
            has, X.estimate_tokens(summary_prefix(F.col("rolling_summary")))).otherwise(0)
    return within_budget(turns, [KEY], [F.desc("turn")], X.estimate_tokens("content"), left,
                         ["turn"])


def context_text(turns: DataFrame, budget: int = MAX_TOKENS, summaries: DataFrame | None = None
                 ) -> DataFrame:
    """The context string of each session: summary first, then the turns, oldest first."""
    kept = budget_turns(turns, budget, summaries)
    lines = F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("t"), _label_line().alias("line"))))
    text = kept.groupBy(KEY).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("recent"))
    if summaries is None:
        return text.withColumnRenamed("recent", "context")
    has = F.coalesce(F.col("rolling_summary"), F.lit("")) != ""
    return text.join(summaries.select(KEY, "rolling_summary"), KEY, "full_outer").select(
        KEY, F.concat_ws("\n", F.when(has, summary_prefix(F.col("rolling_summary"))),
                         "recent").alias("context"))


def append_note(summary: Column, note: Column, chars: int = NOTE_CHARS) -> Column:
    """Rolling summary with a note added, the last ``chars`` characters kept."""
    joined = X.strip(F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), note))
    return F.right(joined, F.lit(chars))


def safe_summarizer(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """Column form of a user's text -> summary function; a failing call leaves a note."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                return fn(t)
            except Exception:  # one bad text must not fail the job
                return f"[{t.count(chr(10)) + 1} turns summarized]"
        return texts.map(one)
    return run


# -- compaction ----------------------------------------------------------------------

def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[dict]:
    """Whole (session, block) groups out of sorted batches, as arrays by column."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        new = (b[KEY] != b[KEY].shift()) | (b["b"] != b["b"].shift())
        starts = new.to_numpy().nonzero()[0]
        arrays = {c: b[c].to_numpy() for c in columns}
        for low, high in zip(starts[:-1], starts[1:]):
            yield {c: a[low:high] for c, a in arrays.items()}
        rest = b.iloc[starts[-1]:]
    if rest is not None:
        yield {c: rest[c].to_numpy() for c in columns}


def _in_blocks(shared: DataFrame) -> DataFrame:
    return shared.repartition(KEY, "b").sortWithinPartitions(KEY, "b", "pos")


def _block_table(tokens: np.ndarray, first_own: int, max_tokens: int, max_turns: int,
                 chunk: int) -> np.ndarray:
    """Turns held after the block, for every number held before it."""
    run = np.concatenate([[0], np.cumsum(tokens)])
    held = np.arange(max_turns + 1)
    for i in range(first_own, len(tokens)):
        now = np.minimum(held + 1, max_turns)
        low = np.maximum(i + 1 - now, 0)
        held = now - chunk * ((run[i + 1] - run[low] > max_tokens) & (now >= chunk))
    return held


def _chained(tables: DataFrame, keys: list[str], index: str, start: Column) -> DataFrame:
    """(keys, index, start): the held count before each block, by chaining the tables."""
    def step(state: Column, t: Column) -> Column:
        return F.struct(
            F.get(t["moves"], state["held"]).alias("held"),
            F.concat(state["out"], F.array(F.struct(
                t["i"].alias("i"), state["held"].alias("start")))).alias("out"))

    grouped = tables.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "moves"))).alias("ts"),
        F.first(start).alias("s0"))
    begin = F.struct(F.col("s0").alias("held"),
                     F.array().cast("array<struct<i:bigint,start:int>>").alias("out"))
    starts = F.aggregate("ts", begin, step, lambda s: s["out"])
    return grouped.select(*keys, F.explode(starts).alias("x")).select(
        *keys, F.col("x.i").alias(index), "x.start")


def _composed(tables: DataFrame, keys: list[str], index: str, max_turns: int) -> DataFrame:
    """One table per key: its blocks' tables applied one after the other."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "moves")))
    return tables.groupBy(*keys).agg(F.aggregate(
        ordered, F.sequence(F.lit(0), F.lit(max_turns)),
        lambda acc, t: F.transform(acc, lambda s: F.get(t["moves"], s))).alias("moves"))


def compaction_steps(turns: DataFrame, max_tokens: int = MAX_TOKENS, max_turns: int = MAX_TURNS,
                     chunk: int = CHUNK, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(compactions, last states) of all sessions, as numbers only.

    Compactions: session_id, pos (place of the turn that set it off), compacted (turn numbers).
    Last states: session_id, pos (last place), held, held_tokens.
    """
    block = max(block, max_turns)  # a block looks back on the one before it only
    slim = dense_positions(
        turns.select(KEY, "turn", X.estimate_tokens("content").alias("tokens")), [KEY], "turn",
        total="n")
    own = F.floor(F.col("pos") / block)
    # the last max_turns turns of a block are also what the next block looks back on
    shared = slim.withColumn("b", F.explode(F.when(
        (F.col("pos") % block >= block - max_turns) & ((own + 1) * block < F.col("n")),
        F.array(own, own + 1)).otherwise(F.array(own))))

    def tables_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for g in _groups(batches, [KEY, "b", "pos", "tokens"]):
            first = int((g["pos"] // block < g["b"]).sum())
            held = _block_table(g["tokens"], first, max_tokens, max_turns, chunk)
            rows.append((g[KEY][0], g["b"][0], held.tolist()))
        yield pd.DataFrame(rows, columns=[KEY, "b", "moves"], dtype=object)

    # sessions of a single block, most of them, start empty and need no table
    tables = _in_blocks(shared.filter(F.col("n") > block)).mapInPandas(
        tables_of, f"{KEY} string, b long, moves array<int>").withColumn(
        "bb", F.floor(F.col("b") / block))
    # two levels: a session of a million blocks still chains about a thousand tables at a time
    upper = _chained(_composed(tables, [KEY, "bb"], "b", max_turns), [KEY], "bb", F.lit(0))
    starts = _chained(tables.join(upper, [KEY, "bb"]), [KEY, "bb"], "b", F.col("start"))
    started = shared.join(starts.drop("bb"), [KEY, "b"], "left").withColumn(
        "start", F.coalesce("start", F.lit(0)))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for g in _groups(batches, [KEY, "b", "pos", "turn", "tokens", "start"]):
            key, pos, turn = g[KEY][0], g["pos"].tolist(), g["turn"].tolist()
            held, run = int(g["start"][0]), [0, *np.cumsum(g["tokens"]).tolist()]
            for i in range(int((g["pos"] // block < g["b"]).sum()), len(pos)):
                now = min(held + 1, max_turns)
                low = i + 1 - now
                if run[i + 1] - run[low] > max_tokens and now >= chunk:
                    rows.append((key, pos[i], turn[low:low + chunk], None, None))
                    now -= chunk
                held = now
            rows.append((key, pos[-1], None, held, run[-1] - run[len(pos) - held]))
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows = []
        yield pd.DataFrame(rows, columns=names, dtype=object)

    names = [KEY, "pos", "compacted", "held", "held_tokens"]
    replayed = _in_blocks(started).mapInPandas(
        replay, f"{KEY} string, pos long, compacted array<long>, held int, held_tokens long")
    ends = replayed.filter("held IS NOT NULL").groupBy(KEY).agg(
        F.max_by(F.struct("pos", "held", "held_tokens"), "pos").alias("e")).select(KEY, "e.*")
    return replayed.filter("compacted IS NOT NULL").select(KEY, "pos", "compacted"), ends


def compact(turns: DataFrame, max_tokens: int = MAX_TOKENS, max_turns: int = MAX_TURNS,
            chunk: int = CHUNK, summarizer: Callable[[Column], Column] = X.extractive_summary,
            block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(compaction events, final state) per session; turns have session_id, turn, role, content.

    When the tokens of the held turns pass ``max_tokens`` and ``chunk`` turns are held, the
    oldest ``chunk`` are replaced by a summary. At most ``max_turns`` are held.
    """
    turns = turns.withColumn(KEY, F.col(KEY).cast("string"))
    steps, ends = compaction_steps(turns, max_tokens, max_turns, chunk, block)
    lines = turns.select(KEY, F.col("turn").alias("p"),
                         F.concat("role", F.lit(": "), "content").alias("line"))
    wanted = steps.select(KEY, "pos", F.explode("compacted").alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "line")))
    summaries = wanted.join(lines, [KEY, "p"]).groupBy(KEY, "pos").agg(F.array_join(
        F.transform(ordered, lambda x: x["line"]), "\n").alias("chunk_text")).withColumn(
        "summary", summarizer(F.col("chunk_text"))).drop("chunk_text")
    chars = F.length("summary") + 1
    events = running_sum(summaries, [KEY], "pos", chars, "_run").select(
        KEY, "pos", F.lit(chunk).alias("turns_compacted"),
        F.substring("summary", 1, PREVIEW_CHARS).alias("summary_preview"),
        F.least(F.col("_run") - 1, F.lit(SUMMARY_CHARS)).cast("int").alias("new_summary_chars"))
    # only the newest summaries can still be part of the rolling one
    recent = within_budget(summaries, [KEY], [F.desc("pos")], chars, SUMMARY_CHARS + 1, ["pos"],
                           inclusive=False)
    rolling = recent.groupBy(KEY).agg(F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "summary"))), F.lit(""),
        lambda acc, s: append_note(acc, s["summary"], SUMMARY_CHARS)).alias("rolling_summary"))
    state = ends.join(rolling, KEY, "left").select(
        KEY, (F.col("pos") + 1).alias("turns"), F.col("held").alias("turns_in_buffer"),
        F.col("held_tokens").alias("estimated_tokens"),
        F.coalesce("rolling_summary", F.lit("")).alias("rolling_summary")).withColumns({
            "has_summary": F.col("rolling_summary") != "",
            "summary_chars": F.length("rolling_summary")})
    return events, state
