"""Missing or wrong language labels: languages of records and of the parts of mixed ones.

A character n-gram model per language is counted over labelled records, at most ``sample`` of them (most labels are right; n-grams go to a fixed
number of buckets, so the model's size does not depend on the data). Each document is a mixture: expectation-maximisation estimates
the proportions of its languages from the likelihoods of its sentences; the set of languages is the one with the best
penalised likelihood. Sentences are then assigned within that set, with a price for each change, and runs are the pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ["en", "de", "es", "fr", "pt"]
BUCKETS = 1 << 16
#: Names and codes of the languages.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês"], "de": ["de", "deu", "ger", "german", "deutsch"], "es": ["es", "spa", "spanish", "español", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français"], "pt": ["pt", "por", "portuguese", "português"],
}
HESITATION = re.compile(r"u+h+m*|u+m+|e+r+m*|a+h+|ä+h+m*|ö+h+m*|e+u+h+|e+h+m*|h+m+|m+h*m*")
SOUNDS = re.compile(r"\[[^\[\]\n]*\]|\{[^{}\n]*\}|<[^<>\n]*>|\*[^*\n]+\*|[♪♫]|\((?:inaudible|unclear|laugh\w*|sigh\w*|cough\w*|applause|music|noise|\d{1,2}:\d\d)[^()\n]*\)", re.I)
PLAIN = frozenset("[{(<*♪♫\"“«„")
TIMES = re.compile(r"\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?\s*(?:-->|-)?")
QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|„[^“”\n]{1,80}[“”]")
LABEL = re.compile(r"(?:^|\n|>>|--)\s*(?:(?:speaker|spk)[\s_#-]*\d+|(?:dr|prof)\.\s+\w+\s\w+)\s*(?::|\s-\s)", re.I)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n{2,}")
MARKED = re.compile(r"(?:<|&lt;)/?[a-zA-Z]|\\[a-z]+\*?\{|```|~~~|\$\$|(?m:^#{1,6}\s*\w|^={2,})")


def canonical(label: Column) -> Column:
    """en, de, es, fr or pt for any spelling of a label; null for none and unusable ones."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}]+)*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(key.isin(names), F.lit(lang)).otherwise(out)
    return out


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [zlib.crc32(w.encode()) % BUCKETS]


def _spoken(s: str) -> bool:
    """Whether a sentence holds a word that is no hesitation."""
    ws = WORD.findall(s)
    return len(ws) > 6 or any(not HESITATION.fullmatch(w.lower()) for w in ws)


def speech_sentences(text: str) -> list[str]:
    """Sentences of a spoken segment without labels, times, sounds and quoted terms; hesitations are passed over word by word."""
    t = text
    if ":" in t or " - " in t:
        t = TIMES.sub(" ", LABEL.sub("\n\n", t))
    if not PLAIN.isdisjoint(t):
        t = QUOTED.sub(" ", SOUNDS.sub(" ", t))
    return [s for s in SENTENCE.split(t) if _spoken(s)]


def page_sentences(text: str) -> list[str]:
    """Sentences of a scanned page; titles, headers, page numbers, code and formulas are none."""
    if MARKED.search(text):
        from lectern.llm.markup import convert

        text = re.sub(r"```[\s\S]*?```|(?m:^# .*$)|\$[^$\n]*\$|(?m:^.* \| .*$)", "", convert(text)[0])
    lines, out = text.split("\n"), []
    widest = max((len(x) for x in lines), default=0)
    for i, line in enumerate(lines):
        s = line.strip()
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        title = s and not re.search(r"[.!?,;:]$", s) and (len(s) < 0.8 * widest or i == 0) and (not after or after[0].isupper() or not after[0].isalpha()) and not re.search(r"[-‐‑¬­]$", s)
        out.append("" if title else s)
    t = re.sub(r"\s?[-‐‑¬­]\n(?=\w)", "", "\n".join(out))
    return [s for s in SENTENCE.split(QUOTED.sub(" ", t)) if WORD.search(s)]


def caption_sentences(text: str) -> list[str]:
    """As for speech; text without punctuation falls into runs of 15 words."""
    out = []
    for s in speech_sentences(text):
        ws = s.split()
        out += [" ".join(ws[i : i + 15]) for i in range(0, len(ws), 15)]
    return out


SENTENCES = {"speech": speech_sentences, "page": page_sentences, "caption": caption_sentences}


def train(records: DataFrame, sample: int = 40_000) -> np.ndarray:
    """Log probabilities ``[bucket, language]`` from labelled records (``rec_key, kind, text, lang``).

    Records without a label are passed over. All others are counted up to ``sample``; of more, those with the lowest hashes of their keys, about ``sample`` in number. Records
    whose label is unusable or whose text is null are no examples.
    """
    labelled = records.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("rec_key", "text"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        words = {x: Counter() for x in LANGS}
        for pdf in batches:
            for lang, kind, text in zip(pdf["lang"], pdf["kind"], pdf["text"]):
                for s in SENTENCES[kind](text):
                    words[lang].update(w for w in WORD.findall(s.lower()) if w not in UNCOUNTED)
        for lang, found in words.items():
            buckets = np.zeros(BUCKETS, np.int64)
            for w, k in found.items():
                g = grams.get(w)
                if g is None:
                    g = grams[w] = np.array(_grams(w))
                np.add.at(buckets, g, k)
            at = np.nonzero(buckets)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": buckets[at]})

    counted = labelled.select("kind", "text", "lang").mapInPandas(count, "lang string, bucket long, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((BUCKETS, len(LANGS)), 0.2)
    n[got["bucket"].to_numpy(np.int64), got["lang"].map(LANGS.index).to_numpy(np.int64)] += got["n"].to_numpy(float)
    return np.log(n / n.sum(axis=0)).astype(np.float32)


#: Hesitations that are words in one of the languages tell nothing about a language.
UNCOUNTED = frozenset(["um", "er", "uh", "ah", "eh", "erm", "uhm", "hmm", "mm", "hm", "euh", "äh"])


class Scorer:
    """Log likelihoods of sentences. Words are scored once and remembered, up to ``most`` of them; hesitations count nothing."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors, self.counts = np.zeros((1024, len(LANGS))), np.zeros(1024)

    def _index(self, w: str) -> int:
        i = len(self.known)
        if i == len(self.counts):
            self.vectors, self.counts = np.concatenate([self.vectors, np.zeros_like(self.vectors)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        if not (w in UNCOUNTED or HESITATION.fullmatch(w)):
            g = self.model[_grams(w)]
            # n-grams overlap: they count as about two independent ones a word
            self.vectors[i], self.counts[i] = 2.0 * (g - g.max(axis=1, keepdims=True)).mean(axis=0), 1
        self.known[w] = i
        return i

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``[sentence, language]`` and the number of words of each."""
        if len(self.known) > self.most:
            self.clear()
        known, ids, lens = self.known, [], []
        for s in texts:
            ws = WORD.findall(s.lower())
            ids += [known[w] if w in known else self._index(w) for w in ws]
            lens.append(len(ws))
        like, words = np.zeros((len(texts), len(LANGS))), np.zeros(len(texts), np.int64)
        lens = np.array(lens)
        full = np.nonzero(lens)[0]
        if len(full):
            starts = np.concatenate(([0], np.cumsum(lens[full])[:-1]))
            flat = np.array(ids)
            like[full] = np.add.reduceat(self.vectors[flat], starts, axis=0)
            words[full] = np.add.reduceat(self.counts[flat], starts).astype(np.int64)
        return like, words

    def sentence(self, s: str) -> tuple[np.ndarray, int]:
        like, words = self.sentences([s])
        return like[0], int(words[0])


def _mixture(like: np.ndarray, weight: np.ndarray, langs: tuple[int, ...], rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the given languages by expectation-maximisation, and the log likelihood reached."""
    x = like[:, langs]
    top = x.max(axis=1, keepdims=True)
    e = np.exp(x - top)
    p = np.full(len(langs), 1 / len(langs))
    for _ in range(rounds):
        r = e * p
        r /= r.sum(axis=1, keepdims=True) + 1e-300
        p = (r * weight[:, None]).sum(axis=0) / weight.sum()
    return p, float((top[:, 0] + np.log(e @ p + 1e-300)).sum())


def infer(like: np.ndarray, words: np.ndarray, penalty: float, change: float) -> tuple[list[int], np.ndarray]:
    """Language of each sentence, and the document's posterior proportions over all languages."""
    proportions = np.zeros(like.shape[1])
    sums = like.sum(axis=0)
    best = (int(sums.argmax()),)
    score = float(sums.max())
    # no mixture is likelier than each sentence in its own best language
    if len(like) > 1 and like.max(axis=1).sum() - score >= penalty:
        gain = np.maximum(like - like[:, best[0]][:, None], 0).sum(axis=0)
        able = [j for j in range(like.shape[1]) if j == best[0] or gain[j] >= penalty / 2]
        for size in range(2, len(able) + 1):
            options = [(c, *_mixture(like, words, c)) for c in combinations(able, size) if set(best) <= set(c)]
            if not options:
                break
            c, p, ll = max(options, key=lambda o: o[2])
            if ll - score < penalty:
                break
            best, score = c, ll
    if len(best) == 1:
        e = np.exp((sums - sums.max()) / max(1.0, np.sqrt(len(like))))
        return [best[0]] * len(like), e / e.sum()
    p, _ = _mixture(like, words, best)
    proportions[list(best)] = p
    x = like[:, best] + np.log(p + 1e-9)
    v, back = x[0], []
    for row in x[1:]:
        step = v[:, None] - change * (1 - np.eye(len(best)))
        back.append(step.argmax(axis=0))
        v = step.max(axis=0) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [best[i] for i in reversed(path)], proportions


def _detect(shared, penalty: float, change: float):
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(shared.value)
        for pdf in batches:
            texts = [SENTENCES[kind](text) if text else [] for kind, text in zip(pdf["kind"], pdf["text"])]
            like_all, words_all = score.sentences([s for t in texts for s in t])
            at, found = 0, []
            for t in texts:
                like, words = like_all[at : at + len(t)], words_all[at : at + len(t)]
                at += len(t)
                if not words.all():
                    like, words = like[words > 0], words[words > 0]
                if not len(words):
                    found.append((None, None, [], None))
                    continue
                path, posterior = infer(like, words, penalty, change)
                count = np.bincount(path, weights=words, minlength=len(LANGS))
                main = int(count.argmax())
                runs = []
                for lang, n in zip(path, words):
                    if runs and runs[-1]["lang"] == LANGS[lang]:
                        runs[-1]["words"] += int(n)
                    else:
                        runs.append({"lang": LANGS[lang], "words": int(n)})
                confidence = float(posterior[main]) if len(runs) == 1 else float(count[main] / count.sum())
                found.append((LANGS[main], confidence, runs, count.astype(int).tolist()))
            out = pdf.drop(columns=["text", "kind"])
            yield out.assign(main=[f[0] for f in found], confidence=[f[1] for f in found], pieces=[f[2] for f in found], counts=[f[3] for f in found])

    return detect


def detect_languages(records: DataFrame, model: np.ndarray, penalty: float = 7.0, change: float = 2.0) -> DataFrame:
    """Adds ``main, confidence, pieces`` (runs of sentences: lang, words) and ``counts`` (words by language) to ``records``.

    ``records`` has ``kind`` ('speech', 'page' or 'caption'), ``text`` and any further columns, which are kept. A text
    that is null, blank or without words has null ``main`` and no pieces. Equal word counts go to the language first in
    ``LANGS``. Texts of any length are read whole.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name not in ("text", "kind")]
    schema = ", ".join([*kept, "main string", "confidence double", "pieces array<struct<lang:string,words:int>>", "counts array<bigint>"])
    return records.mapInPandas(_detect(shared, penalty, change), schema)
