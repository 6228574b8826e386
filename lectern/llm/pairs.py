"""Broken prompt and response pairs: empty, truncated, refusal, copies_question, other_language, dangling_citation.

Refusals are revealed by recurrence, in whatever words: openings of responses are clustered by verified MinHash (``neardup``); a cluster, or a run of five words, that
recurs over unrelated messages and takes up nothing of them is a template, and so is an opening put together from such runs. Short templates may be sound
answers ("Option B") and are refusals only where they stand without sources clearly more often than answers do. Copy, language,
termination and citation checks give the other types.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.languages import LANGS, SENTENCE, WORD, Scorer
from lectern.llm.neardup import near_duplicates
from lectern.session import materialize

#: Answers that say nothing, courtesies after the answer, requests for a language.
NOTHING = {"none", "null", "nil", "n a", "na", "nan", "undefined", "tbd", "no answer", "no response"}
COURTESY = re.compile(r"\b(?:please|rephras\w+|anything else|instructor|contact|try again|por favor|bitte|veuillez|something else)\b", re.I)
ASKED = re.compile(r"\b(?:(?:answer|reply|respond|response|write|translate\w*(?: your answer)?|antworte\w*|responde\w*|répond\w*|responda\w*)\b[^.?!]{0,40}?\b(?:in|into|auf|en|em)\s+)(\w+)", re.I)
ASKED_NAMES = {
    "en": ["english", "englisch", "anglais", "inglés", "inglês"], "de": ["german", "deutsch", "allemand", "alemán", "alemão"], "es": ["spanish", "spanisch", "espagnol", "español", "castellano", "espanhol"],
    "fr": ["french", "französisch", "français", "francés", "francês"], "pt": ["portuguese", "portugiesisch", "portugais", "portugués", "português"],
}
LANG_OF_NAME = {n: lang for lang, names in ASKED_NAMES.items() for n in names}
CODE = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]+`")
CITED = re.compile(r"(?<![\w\]])\[\s*(\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*)\s*\]|(?<=\])\[\s*(\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*)\s*\]")
ASIDE = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|\[[^\]\n]*\]")
MARKS = frozenset("\"“«[")
SPEAKS_FIRST = re.compile(r"^\s*(?:q|question|you asked|your question(?: was)?|frage|pregunta|pergunta|vous avez demandé)\s*:?\s*", re.I)


STATEMENT = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def is_empty(response: str) -> bool:
    t = html.unescape(re.sub(r"<[^<>]*>", " ", response))
    ws = _words(t)
    return not ws or " ".join(ws) in NOTHING


def copies(message: str, response: str) -> bool:
    """Nothing but the words of the message, once or more, after words that introduce a question."""
    m = _words(message)
    for r in (response, SPEAKS_FIRST.sub("", response.lstrip(" \"'“*>"))):
        w = _words(r)
        if m and w and len(w) % len(m) == 0 and w == m * (len(w) // len(m)):
            return True
    return False


def is_truncated(response: str) -> bool:
    """Ends within a code block, list item, bracket or sentence. Short answers without a verb phrase need no full stop."""
    t = response.rstrip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    t = re.sub(r"(?:\s*\[\s*\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\s*\])+$", "", t).rstrip()
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d{1,3}[.)])$", t) or t.endswith((",", ":", ";", "[", "(", "{")):
        return True
    tail = t[max(t.rfind("\n"), 0) :]
    if tail.count("[") > tail.count("]") or tail.count("(") > tail.count(")"):
        return True
    last = re.sub(r"[\"'”’»)\]*_]+$", "", t)
    if last.endswith((".", "!", "?", "…")):
        return False
    if t.endswith(")") and re.search(r"[.!?\]]\s*\([^()]*\)$", t):
        return False
    if re.match(r"\s*(?:[-*•]|\d{1,3}[.)])\s+\S", tail.strip("\n")):
        return False
    sentences = [s for s in SENTENCE.split(t) if s.strip()]
    return len(sentences) > 1 or len(t.split()) >= 6


def cited_numbers(response: str) -> set[int]:
    out = set()
    for m in CITED.finditer(CODE.sub(" ", response)):
        for part in re.split(r"[,;]", m[1] or m[2]):
            ends = [int(x) for x in re.findall(r"\d+", part)]
            out |= set(range(ends[0], ends[-1] + 1)) if len(ends) == 2 and ends[0] <= ends[1] else set(ends)
    return out


def source_numbers(sources: str | None) -> set[int]:
    """Citation numbers of the sources; of malformed JSON those that can be read."""
    if not sources:
        return set()
    try:
        got = json.loads(sources)
        items = got.get("items") if isinstance(got, dict) else got
        return {int(i["citation"]) for i in items or [] if isinstance(i, dict) and str(i.get("citation")).isdigit()}
    except (ValueError, TypeError, AttributeError):
        return {int(x) for x in re.findall(r'"citation"\s*:\s*"?(\d+)', sources)}


def _plain_sentences(text: str) -> list[str]:
    """Without code, quoted terms and what stands in brackets."""
    if "`" in text:
        text = CODE.sub(" ", text)
    if not MARKS.isdisjoint(text):
        text = ASIDE.sub(" ", text)
    return SENTENCE.split(text)


def _language(like: np.ndarray, words: np.ndarray, least: float) -> tuple[int | None, int]:
    """The language of most words, or None where the evidence is short of ``least``; and the number of words."""
    total, n = like.sum(axis=0), int(words.sum())
    if n < 3:
        return None, n
    by = np.bincount(like.argmax(axis=1), weights=words, minlength=len(LANGS))
    if by.max() < n:
        return int(by.argmax()), n
    gap = np.sort(total)[::-1]
    return (int(total.argmax()) if gap[0] - gap[1] >= least else None), n


LISTED = re.compile(r"(?m)^\s*(?:[-*•]|\d{1,3}[.)])\s|```")


def _features(shared):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for pdf in batches:
            rows, texts, asked_of = [], [], {}
            for i, message, response, sources in zip(pdf["id"], pdf["message"], pdf["response"], pdf["sources"]):
                message, response = message or "", response or ""
                found, opening, bare = [], "", False
                numbers = source_numbers(sources)
                if is_empty(response):
                    found.append("empty")
                elif copies(message, response):
                    found.append("copies_question")
                else:
                    sentences = [s for s in STATEMENT.split(response.strip()) if WORD.search(s)]
                    opening = sentences[0] if sentences else ""
                    bare = not LISTED.search(response) and not any(not COURTESY.search(s) and len(_words(s)) >= 4 for s in sentences[1:])
                    if is_truncated(response):
                        found.append("truncated")
                    asked = ASKED.search(message)
                    want = LANG_OF_NAME.get(asked[1].lower()) if asked else None
                    asked_of[len(rows)] = (want, len(texts))
                    texts += [_plain_sentences(response), _plain_sentences(message[: asked.start()] if want else message)]
                    if "[" in response and cited_numbers(response) - numbers:
                        found.append("dangling_citation")
                said = _words(message)
                long = {w for w in said if len(w) >= 5}
                taken = len(long & set(_words(response))) if opening else 0
                # messages of the same content words are one, in whatever order and with whatever numbers
                about = " ".join(sorted(w for w in long if not w.isdigit())) or " ".join(said)
                rows.append((i, found, re.sub(r"\d+", "0", " ".join(_words(opening))), bare, taken, not numbers, int.from_bytes(hashlib.blake2b(about.encode(), digest_size=8).digest(), "big", signed=True)))
            like, words = score.sentences([s for t in texts for s in t])
            cut = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(int)
            for row, (want, at) in asked_of.items():
                got, _ = _language(like[cut[at] : cut[at + 1]], words[cut[at] : cut[at + 1]], 4.0)
                mine, _ = _language(like[cut[at + 1] : cut[at + 2]], words[cut[at + 1] : cut[at + 2]], 2.0)
                if got is not None and LANGS[got] != want and (want is not None or (mine is not None and got != mine)):
                    rows[row][1].append("other_language")
            yield pd.DataFrame(rows, columns=["id", "found", "opening", "bare", "taken", "unsourced", "message"])

    return features


def pair_defects(pairs: DataFrame, model: np.ndarray, least_messages: int = 3, least_words: int = 6, idle_share: float = 0.5, clearly: float = 2.5, salts: int = 16) -> DataFrame:
    """``id, defect``: one row per defect of each pair (``id, message, response, sources``; one row per id).

    Null texts are empty ones; an empty response has no further defect, nor has one that only repeats its message. Null,
    empty and malformed sources hold no citation numbers. ``least_messages`` is the number of unrelated messages (of different content words) over
    which an opening must recur to be a template, by itself, in its cluster, or run by run of five words; ``idle_share`` the share of its uses, in all answers, that
    say no more than it and take up no word of five letters or more of the message. A template of less than ``least_words`` words is a refusal only if its answers stand without
    sources ``clearly`` (standard deviations) more often than all answers. An answer that goes on to something else is no refusal; a refusal in words that
    recur nowhere is not found. Very long responses are read whole. Extra columns are ignored.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, found array<string>, opening string, bare boolean, taken int, unsourced boolean, message bigint"
    rows = materialize(pairs.select("id", "message", "response", "sources").mapInPandas(_features(shared), schema), "pairs")
    fixed = rows.select("id", F.explode("found").alias("defect"))

    said = rows.where(F.col("opening") != "").withColumn("idle", F.col("bare") & (F.col("taken") == 0))
    openings = materialize(said.groupBy("opening").agg(F.count("*").alias("n"), F.count_if("idle").alias("idle"), F.count_if(F.col("bare") & F.col("unsourced")).alias("unsourced"), F.count_if("bare").alias("bare")), "openings")
    uses = materialize(said.where("idle").select("opening", "message").distinct(), "uses")

    # runs of five words (a shorter opening is one run) over unrelated messages
    w = F.split("opening", " ")
    run = F.when(F.size(w) < 5, F.array("opening")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.array_join(F.slice(w, i + 1, 5), " ")))
    every = openings.select("n", "idle", F.explode(F.array_distinct(run)).alias("run"))
    openings = openings.where("idle > 0")
    every = every.groupBy("run").agg(F.sum("n").alias("n"), F.sum("idle").alias("idle")).where(F.col("idle") >= F.col("n") * idle_share).select("run")
    runs_of = openings.select("opening", F.explode(F.array_distinct(run)).alias("run"))
    spread = runs_of.join(uses, "opening").select("run", "message").distinct().groupBy("run").agg(F.count("*").alias("messages")).where(F.col("messages") >= least_messages)
    good = every.join(spread, "run").select("run", F.lit(1).alias("good"))
    composed = runs_of.join(good, "run", "left").groupBy("opening").agg(F.count("*").alias("all"), F.count("good").alias("good")).where("all = good").select("opening")

    # clusters of openings over unrelated messages
    members, links = near_duplicates(openings.select(F.col("opening").alias("id"), F.col("opening").alias("text")), "id", k=5, threshold=0.8, bands=20, rows=6)
    members = members.withColumnRenamed("id", "opening")
    both = links.select("cls_a", "cls_b").unionByName(links.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"))).unionByName(members.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")).distinct())
    sized = members.join(openings, "opening")
    count = uses.groupBy("opening").agg(F.count("*").alias("messages"))
    often = count.where(F.col("messages") >= least_messages).select("opening").join(members, "opening").select(F.col("cls").alias("cls_b")).distinct()
    # an opening that recurs by itself makes its cluster one that recurs; of the others, each has a few messages at most, and these are counted exactly
    seldom = uses.join(count.where(F.col("messages") < least_messages).select("opening"), "opening").join(members, "opening").select(F.col("cls").alias("cls_b"), "message")
    often = both.join(often, "cls_b").select(F.col("cls_a").alias("cls"))
    seldom = both.join(seldom, "cls_b").groupBy("cls_a").agg(F.count_distinct("message").alias("messages")).where(F.col("messages") >= least_messages).select(F.col("cls_a").alias("cls"))
    # an answer puts words of the message into the same frame time and again, a refusal does not
    idle = both.join(sized.groupBy(F.col("cls").alias("cls_b")).agg(F.sum("n").alias("n"), F.sum("idle").alias("idle")), "cls_b").groupBy(F.col("cls_a").alias("cls")).agg(F.sum("n").alias("n"), F.sum("idle").alias("idle"))
    clustered = members.join(often.unionByName(seldom).distinct().join(idle.where(F.col("idle") >= F.col("n") * idle_share), "cls"), "cls").select("opening")

    # short templates: whether their answers lack sources more often than answers do
    p = rows.agg(F.avg(F.col("unsourced").cast("double"))).first()[0] or 0.0
    z = (F.col("unsourced") - F.col("bare") * p) / F.sqrt(F.greatest(F.col("bare") * (p * (1 - p)), F.lit(1e-9)))
    template = openings.join(composed.unionByName(clustered).distinct(), "opening")
    revealed = template.where((F.size(w) >= least_words) | (z >= clearly)).select("opening")
    # one refusal may be the opening of a third of all answers
    salted = said.where(F.col("bare") & (F.col("taken") <= 1)).select("id", "opening", F.pmod(F.hash("id"), F.lit(salts)).alias("salt"))
    refusals = salted.join(revealed.select("opening", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["opening", "salt"]).select("id", F.lit("refusal").alias("defect"))
    return fixed.unionByName(refusals)
