"""Subject areas of documents: complement naive Bayes, refined by expectation-maximisation, calibrated per subject.

Words go to a fixed number of buckets, so the model's size does not depend on the data. The first model is counted on labelled documents;
then all documents, labelled or not, are mixtures of subjects: their sentences' posteriors (within a document, by expectation-
maximisation of its proportions) are the weights of the next count. A sentence without evidence belongs to no subject. The share of a
document's words that a subject holds is calibrated on labelled documents, subject by subject, and the calibrated posterior decides, at the
threshold with the best F1 on them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

#: Function words by which the language of a sentence is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it with for as are this not when whether from which by your you how",
    "de": "der die das und ist nicht den dem ein eine mit von wir zu auf für auch sie im wie man dass wenn",
    "es": "el la los las que una con por para es no del en lo se como cuando sobre hoy más antes hay entre",
    "fr": "le la les des que une avec pour est ne pas du en dans sur et qui nous on ce au vous comme entre",
    "pt": "o a os as que uma com por para é não do da em no na se como quando sobre hoje há um ao entre",
}
#: Each language has its own buckets and is normalised by itself: else its function words lean to whatever subject has most of its texts.
BLOCK = 1 << 14
BUCKETS = BLOCK * len(FUNCTION_WORDS)
TELLS = {}
for _i, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws.split():
        TELLS.setdefault(_w, []).append(_i)
WORD = re.compile(r"[^\W\d_]{2,}")
WORD_OR_LETTER = re.compile(r"[^\W\d_]+")
SPLIT = re.compile(r"[.!?;\n]+")


class Parser:
    """Bucket numbers of the words of a batch of texts, sentence by sentence, in the block of each sentence's language.

    Sentences over ``2 * width`` words are cut into runs of ``width``. A sentence's language is the one most of its function words tell; where it ties with the
    language of the whole text, or none tells, that is taken. Words are looked up once per task and forgotten beyond ``most``.
    """

    TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+")

    def __init__(self, width: int = 14, most: int = 500_000):
        self.width, self.most = width, most
        self.clear()

    def clear(self) -> None:
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                n = self[piece] = outer.add(piece)
                return n

        # what stands between white space is taken apart once: piece -> stretch of ``codes``
        self.pieces, self.begin, self.size, self.codes = Pieces(), [], [], []
        self.words, self.buckets, self.tells = {}, [], []

    def add(self, piece: str) -> int:
        self.begin.append(len(self.codes))
        self.codes += [self.code(w) for w in self.TOKEN.findall(piece)]
        self.size.append(len(self.codes) - self.begin[-1])
        return len(self.begin) - 1

    def code(self, w: str) -> int:
        """0 for what ends a sentence; words count from 1. Single letters have no bucket but may tell a language."""
        if w[0] in ".!?;\n":
            return 0
        n = self.words.get(w)
        if n is None:
            self.buckets.append(zlib.crc32(w.encode()) % BLOCK if len(w) > 1 else -1)
            self.tells.append(sum(1 << j for j in TELLS.get(w, ())))
            n = self.words[w] = len(self.buckets)
        return n

    def parse(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the buckets of its words and the lengths of its sentences."""
        if len(self.pieces) > self.most:
            self.clear()
        look = self.pieces.__getitem__
        parts = [np.fromiter(map(look, (t.lower().replace("\n", " . ") + " .").split()), np.int64) if t else np.array([look(".")]) for t in texts]
        piece = np.concatenate(parts) if parts else np.empty(0, np.int64)
        size = np.array(self.size)[piece]
        at = np.arange(int(size.sum())) + np.repeat(np.array(self.begin)[piece] - (np.cumsum(size) - size), size)
        code = np.array(self.codes, np.int64)[at]
        doc = np.repeat(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), size)
        is_word = code > 0
        sentence = np.cumsum(~is_word)[is_word]
        code, doc = code[is_word] - 1, doc[is_word]
        if not len(code):
            return [np.empty(0, np.int32)] * len(texts), [np.empty(0, np.int32)] * len(texts)
        # runs: a sentence, or each ``width`` words of a long one
        new = np.concatenate(([True], sentence[1:] != sentence[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(code)])))
        within = np.arange(len(code)) - np.repeat(first, size)
        new |= np.repeat(size > 2 * self.width, size) & (within % self.width == 0)
        run = np.cumsum(new) - 1
        runs, langs = int(run[-1]) + 1, len(FUNCTION_WORDS)
        told = np.array(self.tells)[code]
        hits = np.flatnonzero(told)
        votes = np.stack([np.bincount(run[hits], (told[hits] >> j) & 1, runs) for j in range(langs)], axis=1)
        run_doc = doc[new]
        overall = np.stack([np.bincount(run_doc, votes[:, j], len(texts)) for j in range(langs)], axis=1)
        common = overall.argmax(axis=1)[run_doc]
        best = votes.max(axis=1)
        lang = np.where(votes[np.arange(runs), common] == best, common, votes.argmax(axis=1))
        bucket = np.array(self.buckets)[code]
        kept = bucket >= 0
        ids = (bucket + lang[run] * BLOCK)[kept].astype(np.int32)
        lens = np.bincount(run[kept], minlength=runs)
        words_of, full = np.bincount(doc[kept], minlength=len(texts)), lens > 0
        runs_of = np.bincount(run_doc[full], minlength=len(texts))
        return np.split(ids, np.cumsum(words_of)[:-1]), np.split(lens[full].astype(np.int32), np.cumsum(runs_of)[:-1])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parser = Parser()
    for pdf in batches:
        ids, lens = [], []
        for low in range(0, len(pdf), 1000):
            i, n = parser.parse(list(pdf["text"][low : low + 1000]))
            ids += i
            lens += n
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": ids, "lens": lens})


def weights(counts: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """Complement naive Bayes: minus the log probability of a bucket outside each subject, centred over the subjects.

    The last column is no subject (notices and the like); before any count of it, it has no evidence for or against.
    """
    if not counts[:, -1].any():
        return np.concatenate([weights(np.concatenate([counts[:, :-1], np.full((len(counts), 1), 1e-9)], axis=1), alpha)[:, :-1], np.zeros((len(counts), 1), np.float32)], axis=1)
    outside = (counts.sum(axis=1, keepdims=True) - counts + alpha).reshape(-1, BLOCK, counts.shape[1])
    w = -np.log(outside / outside.sum(axis=1, keepdims=True)).reshape(counts.shape)
    w = w - w.mean(axis=1, keepdims=True)
    # a bucket seen only a few times tells little
    seen = counts.sum(axis=1, keepdims=True)
    return (w * seen / (seen + 2.0)).astype(np.float32)


def posteriors(ids: list, lens: list, w: np.ndarray, prior: np.ndarray, none: float, rounds: int = 6):
    """Of a batch: sentence posteriors ``[sentence, subject + none]``, the sentence of each word, the document of each sentence, lengths."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64)
    n = np.concatenate([np.asarray(x, np.int64) for x in lens]) if len(lens) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(lens)), [len(x) for x in lens])
    if len(n) == 0:
        return np.empty((0, w.shape[1])), flat, doc, doc, n
    # sentences from the longest on, so that the first word of all is added, then the second of those that have one, and so on
    order = np.argsort(-n, kind="stable")
    starts, falling = (np.cumsum(n) - n)[order], -n[order]
    like = np.zeros((len(n), w.shape[1]))
    sums = w[flat[starts]].astype(np.float64)
    for j in range(1, int(-falling[0])):
        some = starts[: np.searchsorted(falling, -j, "left")]
        sums[: len(some)] += w[flat[some + j]]
    like[order] = sums
    like[:, -1] += none
    # likelihoods against each sentence's best, once; every round then only multiplies
    like -= like.max(axis=1, keepdims=True)
    e = np.exp(np.maximum(like, -300.0))
    theta = prior.copy()
    total = np.bincount(doc, n, len(lens))[:, None] + 1e-9
    held = np.flatnonzero(np.bincount(doc, minlength=len(lens)))
    begin = np.searchsorted(doc, held)
    weight = n[:, None].astype(np.float64)
    for _ in range(rounds):
        r = e * (theta[doc] + 1e-12)
        r /= r.sum(axis=1, keepdims=True)
        mass = np.zeros_like(theta)
        mass[held] = np.add.reduceat(r * weight, begin, axis=0)
        theta = 0.8 * mass / total + 0.2 * prior
    return r, flat, np.repeat(np.arange(len(n)), n), doc, n


def _prior(labels, subjects: list[str]) -> np.ndarray:
    k = len(subjects)
    p = np.full((len(labels), k + 1), 0.9 / k)
    p[:, k] = 0.1
    at = {s: i for i, s in enumerate(subjects)}
    for d, x in enumerate(labels):
        own = [at[s] for s in x if s in at] if x is not None else []
        if own:
            p[d] *= 0.3
            p[d, own] += 0.7 / len(own)
    return p


def _count(subjects: list[str], shared, none: float):
    k = len(subjects) + 1

    def count(batches):
        total = np.zeros((k, BUCKETS))
        for pdf in batches:
            if shared is None:
                for ids, label in zip(pdf["ids"], pdf["label"]):
                    for s in label:
                        if s in subjects:
                            np.add.at(total[subjects.index(s)], ids, 1 / len(label))
            else:
                for low in range(0, len(pdf), 1000):
                    part = pdf[low : low + 1000]
                    r, flat, sentence, _, _ = posteriors(list(part["ids"]), list(part["lens"]), shared.value, _prior(part["label"], subjects), none)
                    for j, own in enumerate(np.ascontiguousarray(r.T) if len(flat) else ()):
                        total[j] += np.bincount(flat, own[sentence], BUCKETS)
        at = np.nonzero(total.sum(axis=0) > 1e-6)[0]
        yield pd.DataFrame({"bucket": at, **{f"c{j}": total[j, at] for j in range(k)}})

    return count


def _collect(parsed: DataFrame, subjects: list[str], shared, none: float) -> np.ndarray:
    """Expected counts ``[bucket, subject]``: at most ``BUCKETS`` rows come to the driver, whatever the data."""
    schema = "bucket long, " + ", ".join(f"c{j} double" for j in range(len(subjects) + 1))
    got = parsed.mapInPandas(_count(subjects, shared, none), schema).groupBy("bucket").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(len(subjects) + 1)]).toPandas()
    counts = np.zeros((BUCKETS, len(subjects) + 1))
    counts[got["bucket"].to_numpy(np.int64)] = got[[f"c{j}" for j in range(len(subjects) + 1)]].to_numpy(float)
    return counts


def _shares(subjects: list[str], shared, none: float):
    k = len(subjects)

    def shares(batches):
        for pdf in batches:
            labels = [None] * len(pdf)
            r, _, _, doc, n = posteriors(list(pdf["ids"]), list(pdf["lens"]), shared.value, _prior(labels, subjects), none)
            held = np.stack([np.bincount(doc, r[:, j] * n, len(pdf)) for j in range(k)], axis=1) if len(n) else np.zeros((len(pdf), k))
            words = np.bincount(doc, n, len(pdf)) if len(n) else np.zeros(len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "words": words.astype(np.int64), "shares": list(held / np.maximum(words, 1)[:, None])})

    return shares


def calibrate(shares: np.ndarray, is_label: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Slope and offset of a logistic posterior from the logit of the share, per subject (Newton steps, slightly regularised)."""
    out = np.zeros((shares.shape[1], 2))
    x = np.log((shares + 0.02) / (1.02 - shares))
    for j in range(shares.shape[1]):
        a = np.stack([x[:, j], np.ones(len(x))], axis=1)
        b = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            g = a.T @ (is_label[:, j] - p) - 0.5 * (b - [1.0, 0.0])
            h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
            step = np.linalg.solve(h, g)
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        out[j] = b
    return out


def best_threshold(posterior: np.ndarray, is_label: np.ndarray, slack: float = 0.001) -> float:
    """The highest threshold (in hundredths) whose F1 on labelled documents is within ``slack`` of the best."""
    steps = np.arange(5, 96) / 100
    f1 = np.array([2 * (is_label * (posterior >= t)).sum() / max(is_label.sum() + (posterior >= t).sum(), 1) for t in steps])
    return float(steps[f1 >= f1.max() - slack].max())


MOST_SUBJECTS = 1000


def subject_shares(docs: DataFrame, labels: DataFrame, examples: DataFrame, rounds: int = 3, unseen: float = 1.0, none: float = 0.0, sample: int = 20_000) -> DataFrame:
    """``doc_id, words, subject, share, posterior, holds``: one row per document and subject.

    ``docs``: doc_id, text; ``labels``: doc_id, subject (several rows per document allowed, some may be wrong; unknown subjects and
    documents are ignored); ``examples``: subject, example_terms (the subjects that exist; more than ``MOST_SUBJECTS`` rows are an error). ``holds``
    is whether the calibrated posterior reaches the threshold chosen on the labelled documents (0.28 where there are none). Null, empty and wordless
    texts have share 0 throughout and hold no subject. Whole texts are read. Calibration and threshold are fitted on at most ``sample`` labelled
    documents, the ones with the lowest hashes of their ids; everything else is counted over all documents.
    """
    spark = docs.sparkSession
    terms = examples.limit(MOST_SUBJECTS + 1).collect()
    if len(terms) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} rows of subjects")
    subjects = sorted({r["subject"] for r in terms if r["subject"]})
    own = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("label"))
    joined = docs.select("doc_id", "text").join(own, "doc_id", "left").select("doc_id", F.coalesce("label", F.array().cast("array<string>")).alias("label"), "text")
    parsed = materialize(joined.mapInPandas(_parse, "doc_id bigint, label array<string>, ids array<int>, lens array<int>"), "subject-words")
    counts = _collect(parsed.where(F.size("label") > 0), subjects, None, none)
    for r in terms:
        for term in r["example_terms"] or []:
            for w in WORD.findall((term or "").lower()):
                if r["subject"] in subjects:
                    counts[zlib.crc32(w.encode()) % BLOCK, subjects.index(r["subject"])] += 3
    for i in range(rounds):
        # at first a sentence needs evidence for a subject; then notices have words of their own
        counts = _collect(parsed, subjects, spark.sparkContext.broadcast(weights(counts)), none if i else unseen)
    model = spark.sparkContext.broadcast(weights(counts))
    found = materialize(parsed.mapInPandas(_shares(subjects, model, none), "doc_id bigint, label array<string>, words long, shares array<double>"), "subject-shares")
    fit = found.where(F.size("label") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if len(fit):
        told = np.array([[s in set(x) for s in subjects] for x in fit["label"]], float)
        held = np.stack(fit["shares"].to_numpy())
        line = calibrate(held, told)
        least = best_threshold(1 / (1 + np.exp(-(np.log((held + 0.02) / (1.02 - held)) * line[:, 0] + line[:, 1]))), told)
    else:
        line, least = np.tile([1.0, 0.0], (len(subjects), 1)), 0.28
    per = F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.col("shares")[j].alias("share"), F.lit(float(line[j, 0])).alias("a"), F.lit(float(line[j, 1])).alias("b")) for j, s in enumerate(subjects)])).alias("x")
    out = found.select("doc_id", "words", per).select("doc_id", "words", "x.*")
    z = F.col("a") * F.log((F.col("share") + 0.02) / (1.02 - F.col("share"))) + F.col("b")
    posterior = 1 / (1 + F.exp(-z))
    return out.select("doc_id", "words", "subject", F.least("share", F.lit(1.0)).alias("share"), posterior.alias("posterior"), ((posterior >= least) & (F.col("words") > 0)).alias("holds"))


def subjects_of(shares: DataFrame) -> DataFrame:
    """``doc_id, subject, share, posterior`` of the subjects each document is about, by the calibrated posterior."""
    return shares.where("holds").select("doc_id", "subject", "share", "posterior")
