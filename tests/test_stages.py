import pytest
from pyspark.sql import functions as F

from lectern.operators import stages


def test_settings(monkeypatch):
    for name, value in (("A", "Yes"), ("B", "0"), ("C", "12"), ("D", "x"), ("E", " "), ("G", "0.5")):
        monkeypatch.setenv(name, value)
    got = [stages.setting(n, d) for n, d in (("A", False), ("B", True), ("C", 3), ("D", 3), ("E", "z"), ("G", 1.0), ("MISSING_ONE", 7))]
    assert got == [True, False, 12, 3, "z", 0.5, 7]


def test_stage_times_add_up(spark):
    ticks = iter([0.0, 1.0, 5.0, 5.5, 6.0, 8.0])
    t = stages.StageTimes(lambda: next(ticks))
    with t.stage("plan"):
        pass
    with pytest.raises(ValueError), t.stage("dense"):
        raise ValueError
    with t.stage("plan"):
        pass
    assert {r["stage"]: r["ms"] for r in t.table(spark, "run").collect()} == {"plan": 3000.0, "dense": 500.0}


def test_escalation(spark):
    kind = "struct<text:string,confidence:double>"

    def first(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [{"text": t.upper(), "confidence": 0.9 if "sure" in t else None if "none" in t else 0.3} for t in texts]

    def second(texts):
        return [None if "hopeless" in t else {"text": f"second {t}", "confidence": 0.8} for t in texts]

    df = spark.createDataFrame([(1, "sure"), (2, "weak"), (3, "none"), (4, "hopeless"), (5, "boom"), (6, None)], "id int, t string").withColumn("out_model_", F.lit("x"))
    got = {r["id"]: (r["out"] and r["out"]["text"], r["out_model"]) for r in stages.with_escalation(df, "t", first, second, kind, "out", rows=1, tries=1).collect()}
    assert got == {1: ("SURE", "first"), 2: ("second weak", "second"), 3: ("second none", "second"), 4: ("HOPELESS", "first"), 5: ("second boom", "second"), 6: ("second ", "second")}


def test_paragraphs_judgement_and_prompt(spark):
    df = spark.createDataFrame([("One.\n\nTwo\nlines.", "ask"), ("A line\nthat ends.\nAnother\nopen", "quiz"), (" ".join(["w"] * 95) + "\nmore", "x"), (None, None), ("", "ask")], "t string, m string")
    got = [r[0] for r in df.select(stages.paragraphs(F.col("t"))).collect()]
    assert got[0] == ["One.", "Two\nlines."] and got[1] == ["A line that ends.", "Another open"] and [len(x.split()) for x in got[2]] == [95, 1] and got[3] == got[4] == []
    j = spark.createDataFrame([('x {"faithfulness": 12, "relevance": 5, "completeness": -1} y',), ("none",), (None,), ('{"faithfulness": 1, "overall": 7}',)], "a string").select(stages.judged(F.col("a")).alias("j")).collect()
    assert tuple(j[0]["j"]) == (1.0, 0.5, 0.0, 0.5) and j[1]["j"] is None and j[2]["j"] is None and j[3]["j"]["overall"] == 0.7
    p = [r[0] for r in df.select(stages.answer_prompt(F.col("m"), F.lit("Why?"), F.when(F.col("t") != "", "[1] so"), F.col("m"))).collect()]
    assert p[0].startswith(stages.PROMPTS["ask"]) and "Conversation so far:\nask" in p[0] and p[1].startswith(stages.PROMPTS["quiz"]) and p[3] == p[4] == stages.NOTHING_FOUND
