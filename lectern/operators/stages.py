"""Stage timings, job records, settings from the environment, and models that hand over to a stronger one."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.boundary import call_model


def setting(name: str, default: bool | int | float | str) -> bool | int | float | str:
    """A setting of the environment in the type of its default; blank and unreadable ones are the default. True is any of 1, true, yes, on."""
    got = os.environ.get(name, "").strip()
    if not got:
        return default
    if isinstance(default, bool):
        return got.lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(got)
    except ValueError:
        return default


class StageTimes:
    """Milliseconds spent in named stages of one run; a stage entered again adds to its time."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.taken = clock, {}

    @contextmanager
    def stage(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            self.taken[name] = self.taken.get(name, 0.0) + (self.clock() - began) * 1000

    def table(self, spark: SparkSession, run: str) -> DataFrame:
        """``run, stage, ms``: to be appended to the table that latency statistics are taken of."""
        return spark.createDataFrame([(run, k, float(v)) for k, v in self.taken.items()], "run string, stage string, ms double")


def planner_share(planner_ms: Column, total_ms: Column) -> Column:
    """The planner's part of all time, at most 1; 0 where no time was taken."""
    return F.when(total_ms > 0, F.least(planner_ms / total_ms, F.lit(1.0))).otherwise(0.0)


def with_escalation(df: DataFrame, column: str, first: Callable[[list[str]], list], second: Callable[[list[str]], list], kind: str, out: str, threshold: float = 0.75, **kw) -> DataFrame:
    """``out`` (a struct of ``kind`` with ``confidence``) from the first model, and from the second where the first failed or is less sure than ``threshold``.

    Adds ``out``, ``<out>_error`` and ``<out>_model`` ('first' or 'second'). Each row goes to the second model once at most; its answer holds if it has one.
    """
    tried = call_model(df, column, first, kind, out, **kw).withColumn("__again", F.col(out).isNull() | F.coalesce(F.col(f"{out}.confidence") < threshold, F.lit(True)))
    sure = tried.where(~F.col("__again")).withColumn(f"{out}_model", F.lit("first"))
    again = call_model(tried.where("__again").withColumnRenamed(out, "__first").withColumnRenamed(f"{out}_error", "__first_error"), column, second, kind, out, **kw)
    again = again.withColumn(f"{out}_model", F.when(F.col(out).isNotNull(), "second").otherwise("first")).withColumn(out, F.coalesce(out, "__first")).drop("__first", "__first_error")
    return sure.unionByName(again).drop("__again")


def judged(answer: Column) -> Column:
    """A judge's scores from its JSON text: each of faithfulness, relevance and completeness in tenths, the overall one as given or their mean, all within 0 and 1; null without JSON."""
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    x = F.from_json(F.when(inner != "", inner), "faithfulness double, relevance double, completeness double, overall double")
    part = lambda c: F.least(F.greatest(F.coalesce(x[c], F.lit(0.0)) / 10, F.lit(0.0)), F.lit(1.0))
    mean = (part("faithfulness") + part("relevance") + part("completeness")) / 3
    return F.when(x.isNotNull(), F.struct(F.round(part("faithfulness"), 4).alias("faithfulness"), F.round(part("relevance"), 4).alias("relevance"), F.round(part("completeness"), 4).alias("completeness"), F.round(F.when(x["overall"].isNotNull(), part("overall")).otherwise(mean), 4).alias("overall")))


#: What an answering model is told, by mode; a question without context is answered by the last text.
PROMPTS = {
    "ask": "Answer the question from the numbered sources alone and cite them as [n].",
    "quiz": "Write quiz questions with answers from the numbered sources alone.",
    "summarize": "Summarise what the numbered sources say on the subject, under headings.",
}
NOTHING_FOUND = "Nothing on this was found in the course material."


def answer_prompt(mode: Column, question: Column, context: Column, memory: Column) -> Column:
    """The text a model is asked with: task of the mode, conversation so far, sources, question; the fixed answer where there are no sources."""
    task = F.lit(PROMPTS["ask"])
    for name, text in PROMPTS.items():
        task = F.when(mode == name, text).otherwise(task)
    told = F.when(F.coalesce(memory, F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), memory))
    return F.when(F.coalesce(context, F.lit("")) == "", NOTHING_FOUND).otherwise(F.concat_ws("\n\n", task, told, F.concat(F.lit("Sources:\n"), context), F.concat(F.lit("Question: "), question)))


def paragraphs(text: Column, most_words: int = 90) -> Column:
    """Paragraphs by blank lines; a text of one paragraph is put together from its lines instead, each up to a sentence end or ``most_words`` words."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, line: Column) -> Column:
        joined = F.when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit(" "), line))
        full = joined.rlike(r"[.!?:]$") | (F.size(F.split(joined, r"\s+")) >= most_words)
        return F.struct(F.when(full, F.concat(s["done"], F.array(joined))).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    merged = F.aggregate(lines, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.size(parts) == 1, merged).otherwise(parts)
