import datetime as dt

from leadloom.operators import hooks as H
from pyspark.sql import functions as F


def at(hours):
    return F.lit(dt.datetime(2024, 7, 1) + dt.timedelta(hours=hours))


def test_answers_live_as_long_as_their_task_says(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(prompt):
        with open(calls, "a") as f:  # local mode: the tasks share this file system
            f.write(prompt + "\n")
        if prompt == "bad":
            raise RuntimeError("no answer")
        return {"said": prompt}

    def asked():
        return sorted(calls.read_text().split()) if calls.exists() else []

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "bad")], "n int, prompt string")
    store = str(tmp_path / "store")
    rows = {r.n: r for r in H.ask(df, model, "m", store, "icp_parser", at(0)).collect()}
    assert asked() == ["a", "b", "bad"]
    assert rows[1].answer == rows[2].answer == '{"said": "a"}' and rows[1].error is None
    assert rows[4].answer is None and "no answer" in rows[4].error
    # within the hour only the failed prompt is asked again
    H.ask(df, model, "m", store, "icp_parser", at(0.5)).collect()
    assert asked() == ["a", "b", "bad", "bad"]
    # afterwards every prompt is, and so is one for another model
    H.ask(df, model, "m", store, "icp_parser", at(2)).collect()
    assert asked() == ["a", "a", "b", "b", "bad", "bad", "bad"]
    H.ask(df.filter("n = 1"), model, "other", store, "icp_parser", at(2)).collect()
    assert asked().count("a") == 3


def test_rule_tier_stays_when_the_answer_is_no_tier(spark, tmp_path):
    df = spark.createDataFrame(
        [("p1", "warm", [("CTO", 0.9)]), ("p2", "cold", [])],
        "prompt string, lead_tier string, "
        "decision_makers array<struct<title:string,confidence:double>>")
    model = lambda p: {"tier": "hot" if p == "p1" else "lukewarm",
                       "decision_maker_titles": ["cto", "VP"], "subject_line": "Hi"}
    rows = {r.prompt: r for r in H.score_with_model(
        df, model, "m", str(tmp_path / "s"), at(0)).collect()}
    assert rows["p1"].lead_tier == "hot" and rows["p1"].model_error is None
    assert [m.title for m in rows["p1"].decision_makers] == ["CTO", "VP"]
    assert rows["p1"].outreach_suggestions[0].subject_line == "Hi"
    assert rows["p2"].lead_tier == "cold" and rows["p2"].outreach_suggestions == []
    assert rows["p2"].decision_makers == [] and "valid tier" in rows["p2"].model_error
