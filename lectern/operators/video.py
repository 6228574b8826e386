"""Chunks of video transcripts: snippets in order are packed to a target number of words, chapter by chapter, or at sentence ends where a video has no chapters.

The fold depends on order, so a video is one sequence; it is read as a stream of sorted rows with a state of one open and one finished chunk, never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?]\s")


@dataclass
class Sizes:
    """Words of a chunk, words and snippets that begin the next, fewest words of a last chunk, characters around the target where a sentence end is looked for."""

    target: int = 300
    carry: int = 40
    snippets: int = 3
    least: int = 80
    near: int = 80


@dataclass
class Chunk:
    chapter: int
    title: str
    text: str
    first: float
    last: float


@dataclass
class VideoFold:
    """The state along one video. ``add`` takes a snippet, ``close_chapter`` what is left of a chapter; both give finished chunks."""

    sizes: Sizes
    by_chapter: bool
    chapter: int = -1
    title: str = "Unknown"
    words: list = field(default_factory=list)
    spans: list = field(default_factory=list)
    waiting: Chunk | None = None

    def add(self, text: str, start: float, end: float) -> Iterator[Chunk]:
        self.words += text.split()
        self.spans.append((start, end))
        if len(self.words) >= self.sizes.target:
            yield from self._finish(self._cut(" ".join(self.words)))
            self.words = self.words[-self.sizes.carry :]
            self.spans = self.spans[-self.sizes.snippets :]

    def _cut(self, whole: str) -> str:
        """The text of a full chunk: all of it, or up to the last sentence end near the target."""
        if self.by_chapter:
            return whole
        about = int(len(whole) * (self.sizes.target / len(self.words)))
        low = max(0, about - self.sizes.near)
        ends = [m.end() for m in SENTENCE_END.finditer(whole[low : about + self.sizes.near])]
        return whole[: low + ends[-1]].strip() if ends else whole

    def _finish(self, text: str) -> Iterator[Chunk]:
        if self.waiting is not None:
            yield self.waiting
        self.waiting = Chunk(self.chapter, self.title, text, self.spans[0][0], self.spans[-1][1])

    def close_chapter(self) -> Iterator[Chunk]:
        """A rest of enough words is a chunk; a shorter one joins the chunk before, and is lost only where the video has none."""
        if self.words:
            rest = " ".join(self.words)
            if len(self.words) >= self.sizes.least:
                yield from self._finish(rest)
            elif self.waiting is not None:
                self.waiting.text += " " + rest
                if self.by_chapter:
                    self.waiting.last = self.spans[-1][1]
        self.words, self.spans = [], []

    def close(self) -> Iterator[Chunk]:
        yield from self.close_chapter()
        if self.waiting is not None:
            yield self.waiting
            self.waiting = None


def _fold(sizes: Sizes):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, number = None, None, 0

        def row(c: Chunk):
            nonlocal number
            number += 1
            return (video, number - 1, c.chapter, c.title, c.first, c.last, len(c.text.split()), c.text)

        columns = ["video_id", "chunk_no", "chapter_index", "chapter_title", "start_sec", "end_sec", "words", "text"]
        for pdf in batches:
            rows = []
            for v, chapter, title, start, end, text in zip(pdf["video_id"], pdf["chapter"], pdf["title"], pdf["start"], pdf["end"], pdf["text"]):
                if state is None or v != video:
                    rows += [row(c) for c in state.close()] if state is not None else []
                    video, state, number = v, VideoFold(sizes, chapter >= 0), 0
                elif chapter != state.chapter:
                    rows += [row(c) for c in state.close_chapter()]
                state.chapter, state.title = int(chapter), title
                rows += [row(c) for c in state.add(text or "", start, end)]
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([row(c) for c in state.close()] if state is not None else [], columns=columns)

    return fold


def chapter_of(chapters: Column, at: Column) -> tuple[Column, Column]:
    """(number, title) of the last chapter that begins at or before ``at``; before the first the first; (-1, 'Unknown') without chapters."""
    ordered = F.array_sort(F.filter(chapters, lambda c: c["start_sec"].isNotNull()), lambda a, b: F.when(a["start_sec"] < b["start_sec"], -1).when(a["start_sec"] > b["start_sec"], 1).otherwise(0))
    n = F.greatest(F.size(F.filter(ordered, lambda c: c["start_sec"] <= at)), F.lit(1))
    some = F.coalesce(F.size(ordered) > 0, F.lit(False))
    return F.when(some, n - 1).otherwise(-1), F.when(some, F.coalesce(F.get(ordered, n - 1)["title"], F.lit("Unknown"))).otherwise("Unknown")


def pack_snippets(snippets: DataFrame, videos: DataFrame, sizes: Sizes | None = None, salts: int = 16) -> DataFrame:
    """``video_id, chunk_no, chapter_index, chapter_title, start_sec, end_sec, words, text`` from ``video_id, start, end, text, tie`` and ``videos`` (video_id, chapters).

    Snippets are taken in order of chapter, start, tie; those without a start are left out, null texts have no words, videos that ``videos`` does not know have no
    chapters. A null end is the start. An empty table gives no chunks. One video is one sorted sequence read by one task in batches, so a stream with a third of all
    snippets takes its time but no memory.
    """
    known = videos.groupBy("video_id").agg(F.max_by("chapters", F.size("chapters")).alias("chapters"))
    x = snippets.where(F.col("video_id").isNotNull() & F.col("start").isNotNull() & ~F.isnan("start")).withColumn("salt", F.pmod(F.hash("tie"), F.lit(salts)))
    x = x.join(known.select("video_id", "chapters", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).hint("merge"), ["video_id", "salt"], "left")
    number, title = chapter_of(F.col("chapters"), F.col("start"))
    x = x.select("video_id", number.alias("chapter"), title.alias("title"), F.col("start").cast("double").alias("start"), F.coalesce(F.when(~F.isnan("end"), F.col("end")), "start").cast("double").alias("end"), "text", "tie")
    ordered = x.repartition("video_id").sortWithinPartitions("video_id", "chapter", "start", "tie").drop("tie")
    return ordered.mapInPandas(_fold(sizes or Sizes()), "video_id string, chunk_no int, chapter_index int, chapter_title string, start_sec double, end_sec double, words int, text string")
