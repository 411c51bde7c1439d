import random

import pytest

from leadloom.operators import conversations as CV
from leadloom.streaming import conversations as SC, jobs
from pyspark.sql import functions as F


def summary_by_hand(text):
    parts = [p.strip() for p in text.split(".") if p.strip()]
    if not parts:
        return text[:400]
    return ". ".join(parts) if len(parts) <= 2 else f"{parts[0]}. … {parts[-1]}."


def compact_by_hand(turns, max_tokens, max_turns, chunk):
    """Turn by turn: (events, held, tokens, summary) of one session."""
    size = lambda t: max(1, len(t[1]) // 4)
    held, summary, events = [], "", []
    for pos, turn in enumerate(turns):
        held = (held + [turn])[-max_turns:]
        if sum(map(size, held)) > max_tokens and len(held) >= chunk:
            old, held = held[:chunk], held[chunk:]
            text = summary_by_hand("\n".join(f"{r}: {c}" for r, c in old))
            summary = f"{summary}\n{text}".strip()[-4000:]
            events.append((pos, text[:120], len(summary)))
    return events, len(held), sum(map(size, held)), summary


def sessions(seed, n=12):
    rnd = random.Random(seed)
    out = {}
    for s in range(n):
        length = 150 if s == 0 else rnd.randint(1, 30)  # one long session
        out[f"s{s}"] = [
            (rnd.choice(["user", "assistant"]),
             ". ".join("w" * rnd.randint(1, 30) for _ in range(rnd.randint(1, 4))))
            for _ in range(length)]
    return out


def frame(spark, data, gap=1):
    rows = [(s, i * gap, r, c) for s, ts in data.items() for i, (r, c) in enumerate(ts)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "session_id string, turn long, role string, content string")


@pytest.mark.parametrize("limits,block", [
    ((60, 8, 3), 8), ((60, 8, 3), 1024), ((100, 5, 5), 11), ((30, 4, 10), 16)])
def test_compaction_by_hand(spark, limits, block):
    data = sessions(5)
    names = dict(zip(("max_tokens", "max_turns", "chunk"), limits))
    events, state = CV.compact(frame(spark, data, gap=3), **names, block=block)
    got_events = {}
    for r in events.orderBy("pos").collect():
        got_events.setdefault(r.session_id, []).append(
            (r.pos, r.summary_preview, r.new_summary_chars))
    got = {r.session_id: (r.turns_in_buffer, r.estimated_tokens, r.rolling_summary)
           for r in state.collect()}
    for s, turns in data.items():
        want_events, held, tokens, summary = compact_by_hand(turns, *limits)
        assert got_events.get(s, []) == want_events
        assert got[s] == (held, tokens, summary)


def test_rolling_summary_is_cut(spark):
    data = {"s": [("user", f"{i} " + "x" * 390) for i in range(60)]}
    _, state = CV.compact(frame(spark, data), 200, 10, 2, block=16)
    events, held, tokens, summary = compact_by_hand(data["s"], 200, 10, 2)
    r = state.head()
    assert (r.rolling_summary, r.summary_chars) == (summary, 4000)


def test_stream_in_pieces_equals_batch(spark, tmp_path):
    data = sessions(9, 6)
    turns = frame(spark, data)
    for part in range(3):  # turns of a session arrive in order over three files
        turns.filter((F.col("turn") >= part * 10) & (
            (F.col("turn") < (part + 1) * 10) | F.lit(part == 2))).coalesce(1).write.parquet(
            str(tmp_path / f"in/{part}.parquet"))
    limits = dict(max_tokens=60, max_turns=8, chunk=3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema(turns.schema).option(
            "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*.parquet"))
        out = jobs.drain(spark, SC.compact_stream(spark, stream, **limits), "t", "update")
        got = {}
        for r in SC.rolling_summaries(out, ["batch", "turn"]).orderBy("turn").collect():
            got.setdefault(r.session_id, []).append(
                (r.turn, r.summary_preview, r.new_summary_chars))
        assert out.select("batch").distinct().count() == 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {s: compact_by_hand(ts, 60, 8, 3)[0] for s, ts in data.items()}
    assert got == {s: e for s, e in want.items() if e}


def said(spark, tmp_path, files):
    """A stream of files, one a batch; rows of (session, minute, turn, words)."""
    schema = "session_id string, minute long, turn long, role string, content string"
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(s, m, t, "user", c) for s, m, t, c in rows], schema)
        df.withColumn("timestamp", F.timestamp_seconds(F.col("minute") * 60 + 1_704_067_200)).coalesce(
            1).write.parquet(str(tmp_path / f"said/{i}.parquet"))
    return spark.readStream.schema(schema + ", timestamp timestamp").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "said/*.parquet"))


def written(spark, stream, path):
    q = jobs.start(stream, path, "update")
    q.awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out"), jobs.state_rows(q)


def test_turns_out_of_order_give_the_batch_result(spark, tmp_path):
    data = {s: ts[:30] for s, ts in sessions(11, 6).items()}
    rows = [(s, 10 * i + 3 * k, i, c) for k, (s, ts) in enumerate(data.items())
            for i, (_, c) in enumerate(ts)]
    rnd = random.Random(2)
    files = [[] for _ in range(5)]
    for r in rows:  # up to 100 minutes behind
        files[min(3, (r[1] + rnd.randint(0, 100)) // 100)].append(r)
    for f in files:
        rnd.shuffle(f)
    files[4] = [("end", 10_000, 0, "w")]  # moves the watermark past all turns
    with jobs.rocksdb(spark):
        out, held = written(spark, SC.compact_by_time(
            said(spark, tmp_path, files), 60, 8, 3, lateness="100 minutes", ttl_ms=3_600_000),
            str(tmp_path / "o"))
    got = {}
    for r in SC.rolling_summaries(out.filter("kind = 'compacted'"), ["batch", "turn"]).orderBy(
            "turn").collect():
        got.setdefault(r.session_id, []).append((r.turn, r.summary_preview, r.new_summary_chars))
    want = {s: compact_by_hand([("user", c) for _, c in ts], 60, 8, 3) for s, ts in data.items()}
    assert got == {s: w[0] for s, w in want.items() if w[0]}
    assert out.filter("kind = 'late'").count() == 0
    # all sessions but the last have been quiet for an hour: told once, then forgotten
    ends = {r.session_id: (r.turns_in_buffer, r.estimated_tokens)
            for r in out.filter("kind = 'expired'").collect()}
    assert ends == {s: w[1:3] for s, w in want.items()}
    assert max(held) > held[-1]


def test_turns_behind_the_watermark_come_out_as_late(spark, tmp_path):
    word = "w" * 40
    files = [[("a", 0, 0, word), ("a", 20, 2, word), (None, 5, 0, word)], [("b", 200, 0, word)],
             [("b", 201, 1, None)], [("a", 10, 1, "lost. ever"), ("a", 210, 3, word)],
             [("b", 500, 2, word), ("b", 499, 2, word)], [("b", 501, 3, word)]]
    with jobs.rocksdb(spark):
        out, held = written(spark, SC.compact_by_time(
            said(spark, tmp_path, files), 25, 8, 3, lateness="30 minutes"), str(tmp_path / "o"))
    rows = [(r.session_id, r.kind, r.turn, r.summary) for r in out.filter("kind <> 'state'").collect()]
    assert sorted(rows, key=str) == [
        ("a", "compacted", 3, f"user: {word}\nuser: {word}\nuser: {word}"),
        ("a", "late", 1, "user: lost. ever")]
    state = jobs.latest_rows(out.filter("kind = 'state'"), "session_id")
    assert {r.session_id: (r.turn, r.turns_in_buffer) for r in state.collect()} == {
        None: (0, 1), "a": (3, 0), "b": (1, 2)}


@pytest.mark.parametrize("budget,kept", [(3, 1), (4, 2), (5, 2), (100, 3), (1, 0)])
def test_context_budget(spark, budget, kept):
    df = spark.createDataFrame(
        [("s", 0, "user", "x" * 8), ("s", 1, "system", "y" * 8), ("s", 2, "assistant", "z" * 10)],
        "session_id string, turn int, role string, content string")
    rows = CV.context_text(df, budget).collect()
    lines = rows[0].context.split("\n") if rows else []
    assert lines == ["Human: " + "x" * 8, "system: " + "y" * 8, "Assistant: " + "z" * 10][3 - kept:]


def test_summarizer_failure_leaves_a_note(spark):
    def bad(text):
        raise RuntimeError
    df = spark.createDataFrame([("a\nb\nc",)], "t string")
    assert df.select(CV.safe_summarizer(bad)(F.col("t")).alias("s")).head().s == \
        "[3 turns summarized]"


def test_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    made = spark.range(6).selectExpr("id % 2 AS conv_id", "id AS turn")
    made.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    made.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "file/conversations.parquet")
    for where in ("folder", "file"):
        made.write.mode("overwrite").parquet(f"{tmp_path}/{where}/other.parquet")
        for pattern in ("conversations.parquet", "conv*.parquet"):
            stream = jobs.read_files(spark, f"{tmp_path}/{where}", pattern)
            read = jobs.drain(spark, stream, "read")
            assert sorted(r.turn for r in read.collect()) == list(range(6))


def test_bounded_history_keeps_fifty_turns(spark, tmp_path):
    from leadloom.plans.conversation_queries import bounded

    spark.range(60).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "'x' AS text").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert sorted(r.turn for r in bounded(spark, str(tmp_path)).collect()) == list(range(10, 60))
