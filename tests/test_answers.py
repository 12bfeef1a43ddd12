"""Labels from an answering model through a store of answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import answers, graph

SCHEMA = "record_id long, title string, abstract string"


def counted(log, closed=False):
    """Answers by what the text says, and writes down each call."""
    path = str(log)

    def ask(stage, asked):
        import json

        if closed:
            raise RuntimeError("nobody answers")
        with open(path, "a") as f:
            f.write(json.dumps([stage, asked]) + "\n")
        if "odd" in asked:
            return "I can't {tell"
        said = {"is_scientific": "non_scientific" if "news" in asked else "scientific", "is_empirical": "non_empirical" if "essay" in asked else "Empirical", "methodology": "mixed" if "both" in asked else "vague"}[stage]
        return 'Well, {"label": "%s", "confidence": 0.%d} I think' % (said, 5 + len(asked) % 5)

    return ask


def calls_of(log):
    return [tuple(json.loads(line)) for line in log.read_text().splitlines()] if log.exists() else []


def test_parsed():
    assert answers.parsed('x {"label": "Mixed", "confidence": "0.5"} y') == ("mixed", 0.5)
    assert answers.parsed('{"label": "review"}') == ("review", 0.0) and answers.parsed('{"label": "a", "confidence": "much"}') == ("a", 0.0)
    assert [answers.parsed(x) for x in (None, "", "none", "{oh", "{}", '{"confidence": 1}')] == [("uncertain", 0.0)] * 6


def test_each_prompt_is_asked_once(spark, tmp_path):
    rows = [(1, "a", "trial of both"), (2, "a", "trial of both"), (3, "b", "news"), (4, "c", "essay"), (5, None, None), (6, "", ""), (None, "d", "odd"), (None, "d", "odd"), (9, "e", "long " * 50_000)]
    ask = counted(tmp_path / "log")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("open", F.lit(1))
    got = answers.answered(df, ask, str(tmp_path / "store"), "m").collect()
    assert len(got) == len(rows)
    one = {r["record_id"]: (r["is_scientific"], r["is_empirical"], r["methodology"]) for r in got}
    assert one == {1: (True, True, "mixed"), 2: (True, True, "mixed"), 3: (False, None, None), 4: (True, False, None), 5: (True, True, None), 6: (True, True, None), None: (False, None, None), 9: (True, True, None)}
    assert {r["cls_confidence"] for r in got if r["record_id"] is None} == {0.0} and {r["cls_backend"] for r in got} == {"answers:m"}
    calls = calls_of(tmp_path / "log")
    assert len(calls) == len(set(calls)) and sorted(s for s, _ in calls) == ["is_empirical"] * 4 + ["is_scientific"] * 6 + ["methodology"] * 3
    # a replay calls nothing; new rows and another model's name do
    again = answers.answered(df, counted(tmp_path / "none", closed=True), str(tmp_path / "store"), "m").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    more = df.drop("open").unionByName(spark.createDataFrame([(10, "f", "news")], SCHEMA))
    answers.answered(more, ask, str(tmp_path / "store"), "m").count()
    assert len(calls_of(tmp_path / "log")) == len(calls) + 1
    with pytest.raises(Exception, match="nobody answers"):
        answers.answered(df, counted(tmp_path / "none", closed=True), str(tmp_path / "store"), "other").count()


def test_answers_of_empty_tables_and_of_prompts_that_most_share(spark, tmp_path, monkeypatch):
    ask = counted(tmp_path / "log")
    assert answers.answered(spark.createDataFrame([], SCHEMA), ask, str(tmp_path / "s"), "m").count() == 0 and calls_of(tmp_path / "log") == []
    monkeypatch.setattr(graph, "ROWS_A_TASK", 20)
    df = spark.range(300).select(F.col("id").alias("record_id"), F.lit("t").alias("title"), F.when(F.col("id") % 3 > 0, "both").otherwise(F.concat(F.lit("news "), F.col("id"))).alias("abstract"))
    got = answers.answered(df, ask, str(tmp_path / "s"), "m").groupBy("is_scientific", "methodology").count().collect()
    assert {tuple(r) for r in got} == {(True, "mixed", 200), (False, None, 100)} and len(calls_of(tmp_path / "log")) == 103
