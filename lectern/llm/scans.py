"""Noise of scanned pages: running headers, page numbers, words divided at line ends, misrecognised characters.

The lines of a page are labelled header, body, break or page number by a hidden Markov model over layout features (place on
the page, page-number shape and agreement with the document's numbering, repetition of the line on other pages of the document,
a word model of headers learnt from lines that do repeat). Its transitions and the weights of its features are estimated over all pages, with lines that repeat and numbers
that agree as weak labels, and fixed priors for where the corpus says little. Divided words and misread words are decided against word counts of the
whole corpus. Paragraphs are then put together again from body lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

SALTS, WORD_BUCKETS, FILTER_BITS = 16, 4096, 1 << 24
BLANK, HEADER, BODY, NUMBER = 0, 1, 2, 3
ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
SHAPES = [
    ("marked", re.compile(rf"^\s*(?:page|pg|p|seite|s|página|pág|folha|hoja)\.?\s*(\d{{1,4}}|{ROMAN})(?:\s*(?:of|/|von|de|sur)\s*\d{{1,4}})?\s*$", re.I)),
    ("marked", re.compile(rf"^\s*(\d{{1,4}}|{ROMAN})\s*[|/]\s*(?:page|pg|seite|página|\d{{1,4}})\s*$", re.I)),
    ("marked", re.compile(rf"^\s*([-–—\[(])\s*(\d{{1,4}}|{ROMAN})\s*[-–—\])]\s*$", re.I)),
    ("roman", re.compile(rf"^\s*({ROMAN})\s*$", re.I)),
    ("bare", re.compile(r"^\s*(\d{1,4})\s*$")),
]
IN_HEADER = re.compile(rf"^\s*(\d{{1,4}}|{ROMAN})\s{{2,}}\S|\S\s{{2,}}(\d{{1,4}}|{ROMAN})\s*$", re.I)
DIVIDED = re.compile(r"([^\W\d_]{2,})\s?[-‐‑¬­]\s*$")
CONTINUES = re.compile(r"^\s*([^\W\d_]+)")
TOKEN = re.compile(r"[^\W_]+(?:[@!|+$€][^\W_]+)*|[@!|+$€][^\W_]{2,}(?:[@!|+$€][^\W_]+)*")
#: What a recogniser makes of characters, and what they may have been.
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("7", "t"), ("8", "b"), ("9", "g"), ("2", "z"),
    ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("+", "t"), ("$", "s"), ("€", "e"),
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ii", "n"), ("iii", "in"), ("iii", "ni"), ("iii", "m"), ("li", "h"), ("ri", "n"), ("c", "e"), ("n", "ri"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("e", "c"),
]


def scan_lines(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Both kinds of record as pages: ``rec_kind, doc, page, parts`` with parts in page order (``pos, rec_id, text, type``)."""
    b = blocks.select(
        F.lit("block").alias("rec_kind"), F.coalesce(F.col("document_id"), F.concat(F.lit("?"), F.col("block_uid").cast("string"))).alias("doc"), F.col("page").cast("long").alias("page"),
        F.struct(F.col("block_id").cast("long").alias("pos"), F.col("block_uid").cast("long").alias("rec_id"), F.coalesce(F.col("raw_text"), F.col("text"), F.lit("")).alias("text"), F.coalesce("block_type", F.lit("")).alias("type")).alias("part"),
    )
    b = b.groupBy("rec_kind", "doc", "page").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    p = pages.select(
        F.lit("page").alias("rec_kind"), F.coalesce(F.col("source_file"), F.concat(F.lit("?"), F.col("page_id").cast("string"))).alias("doc"), F.col("page_number").cast("long").alias("page"),
        F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("page_id").cast("long").alias("rec_id"), F.coalesce(F.col("transcript"), F.lit("")).alias("text"), F.lit("page").alias("type"))).alias("parts"),
    )
    return b.unionByName(p)


def _number(s: str) -> int:
    if s.isdigit():
        return int(s)
    total, before = 0, 0
    for c in reversed(s.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        total, before = (total - v, before) if v < before else (total + v, v)
    return total


def number_shape(line: str) -> tuple[str, int]:
    """Kind of the page-number shape that a whole line has ('' for none) and its number; no such line has more than four words."""
    if len(line.split(None, 4)) <= 4:
        for kind, r in SHAPES:
            if m := r.match(line):
                n = m[m.lastindex]
                return (kind, _number(n)) if n else ("", 0)
    return "", 0


def shape_of(line: str) -> tuple[str, int]:
    """As ``number_shape``, and 'inside' for a line with a number set off at one of its ends."""
    kind, n = number_shape(line)
    if kind:
        return kind, n
    m = IN_HEADER.search(line)
    return ("inside", _number(m[1] or m[2])) if m else ("", 0)


def header_key(line: str) -> str:
    """A line without numbers and numerals at its ends, case and punctuation."""
    s = re.sub(rf"^\s*(?:\d{{1,4}}|{ROMAN})\s{{2,}}|\s{{2,}}(?:\d{{1,4}}|{ROMAN})\s*$", " ", line, flags=re.I)
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


def _lines(parts) -> list[tuple[int, int, str, str, int]]:
    """(record, line number, text, block type, lines in block) of a page in order."""
    out = []
    for p in parts:
        ls = p["text"].split("\n")
        full = sum(1 for x in ls if x.strip())
        out += [(p["rec_id"], i + 1, x, p["type"], full) for i, x in enumerate(ls)]
    return out


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What repetition and numbering are counted from: the top line of each page and the numbers at its ends."""
    for pdf in batches:
        rows = []
        for kind, doc, page, parts in zip(pdf["rec_kind"], pdf["doc"], pdf["page"], pdf["parts"]):
            ls = [x for x in _lines(parts) if x[2].strip()]
            top = ls[0][2] if ls else ""
            key = header_key(top)[:200] if len(top) <= 120 or shape_of(top)[0] == "inside" else ""
            offset = None
            for x in (ls[-1][2], top) if ls else ():
                s, n = shape_of(x)
                if s and page == page and page is not None and s != "roman":
                    offset = n - int(page)
                    break
            rows.append((kind, doc, page, key, offset))
        yield pd.DataFrame(rows, columns=["rec_kind", "doc", "page", "key", "offset"]).astype({"offset": "Int64", "page": "Int64"})


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_BUCKETS


#: Features of a first or last line that speak for or against a running header: pattern, prior shares in headers and in body lines.
LAYOUT = [
    ("inside", None, 0.2, 0.01), ("set off", re.compile(r"\S\s{3,}\S| · "), 0.12, 0.01), ("sentence", re.compile(r"[.!?]\s*$"), 0.01, 0.55),
    ("long", None, 0.02, 0.4), ("markup", re.compile(r"\s*(?:[#=<\\*|$]|&(?:amp;)*lt;|\d+[.)]\s)"), 0.005, 0.1),
]
LETTERS = re.compile(r"[^\W\d_]{2}")
PRIOR_PAGES = 200.0
TRANSITIONS = np.array([  # from blank, header, body, number to the same
    [0.25, 0.01, 0.70, 0.04], [0.30, 0.01, 0.68, 0.01], [0.15, 0.003, 0.80, 0.047], [0.40, 0.10, 0.45, 0.05],
])
START = np.array([0.02, 0.48, 0.48, 0.02])


def layout(line: str, shape: str, words: int) -> list[int]:
    """Which of ``LAYOUT`` a line has; a line over ten words is long, one between counts in part through its words."""
    return [i for i, (name, r, _, _) in enumerate(LAYOUT) if (shape == "inside" if name == "inside" else words > 10 if name == "long" else r.match(line) if name == "markup" else r.search(line))]


class LineModel:
    """What labels lines: log odds of word buckets, weights of layout features, log probabilities of starts and transitions."""

    def __init__(self, odds: np.ndarray, weight: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.odds, self.weight, self.start, self.step = odds, weight, start, step


def line_model(info: DataFrame, repeated: DataFrame) -> LineModel:
    """Counted over all pages (``info``: page, parts, repeats, offset); a fixed, small number of counts comes to the driver.

    Weak labels: a first line that stands on other pages of its document too is a header, a number that agrees with the document's numbering a page number, a line of
    blanks a break, all other lines body. The counts are added to ``PRIOR_PAGES`` pages of the priors.
    """

    def weak(batches):
        for pdf in batches:
            words, other = np.zeros(WORD_BUCKETS, np.int64), np.zeros(64, np.int64)
            known: dict[str, int] = {}
            for parts, page, repeats, offset in zip(pdf["parts"], pdf["page"], pdf["repeats"], pdf["offset"]):
                before, met = -1, 0
                agreed = int(page + offset) if page == page and page is not None and offset == offset and offset is not None else None
                for _, _, x, _, _ in _lines(parts):
                    state = BODY
                    if not x.strip():
                        state = BLANK
                    else:
                        met += 1
                        if met > 1 or not repeats >= 2:
                            shape, n = number_shape(x)
                            if shape and n == agreed:
                                state = NUMBER
                        else:
                            state = HEADER
                        if met > 1:
                            for w in WORDS.findall(x.lower()):
                                b = known.get(w)
                                if b is None:
                                    if len(known) > 500_000:
                                        known.clear()
                                    b = known[w] = _bucket(w)
                                words[b] += 1
                        if met <= 2 and (state == HEADER or met == 2) and state != NUMBER:
                            at = 28 if state == HEADER else 36
                            other[at] += 1
                            for i in layout(x, shape_of(x)[0], len(WORDS.findall(x))):
                                other[at + 1 + i] += 1
                    other[state if before < 0 else 4 + before * 4 + state] += 1
                    before = state
            at, more = np.nonzero(words)[0], np.nonzero(other)[0]
            yield pd.DataFrame({"bucket": np.concatenate((at, WORD_BUCKETS + more)), "n": np.concatenate((words[at], other[more]))})

    heads = repeated.where((F.col("pages") >= 3) & (F.col("pages") >= 0.5 * F.col("of"))).select(F.explode(F.split("key", " ")).alias("w"), "pages")
    heads = heads.groupBy(F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(WORD_BUCKETS)).alias("bucket")).agg(F.sum("pages").alias("n"))
    a, b = np.zeros(WORD_BUCKETS), np.zeros(WORD_BUCKETS + 64)
    for r in heads.collect():
        a[r["bucket"]] = r["n"]
    for r in info.select("parts", "page", "repeats", "offset").mapInPandas(weak, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        b[r["bucket"]] = r["n"]
    b, other = b[:WORD_BUCKETS], b[WORD_BUCKETS:]
    odds = np.log((a + 0.5) / (a.sum() + 0.5 * WORD_BUCKETS)) - np.log((b + 0.5) / (b.sum() + 0.5 * WORD_BUCKETS)) if a.sum() else np.zeros(WORD_BUCKETS)
    start = other[:4] + PRIOR_PAGES * START
    step = other[4:20].reshape(4, 4) + PRIOR_PAGES * TRANSITIONS
    in_header, in_body = np.array([x[2] for x in LAYOUT]), np.array([x[3] for x in LAYOUT])
    in_header = (other[29 : 29 + len(LAYOUT)] + PRIOR_PAGES * in_header) / (other[28] + PRIOR_PAGES)
    in_body = (other[37 : 37 + len(LAYOUT)] + PRIOR_PAGES * in_body) / (other[36] + PRIOR_PAGES)
    return LineModel(odds, np.log(in_header) - np.log(in_body), np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)))


WORDS = re.compile(r"[^\W_]+")
OUT = -60.0


def line_scores(ls: list[tuple[int, int, str, str, int]], repeats: int, offset: int | None, page: int | None, model: LineModel) -> list[tuple[float, float, float, float]]:
    """Log emission scores of a page's lines, for blank, header, body, number."""
    full = [i for i, x in enumerate(ls) if x[2].strip()]
    top, bottom = (full[0], full[-1]) if full else (-1, -1)
    out = []
    for i, (_, _, x, kind, alone) in enumerate(ls):
        if not x.strip():
            out.append((0.0, OUT, OUT, OUT))
            continue
        shape, n = number_shape(x)
        header = number = OUT
        if i in (top, bottom) and not shape and LETTERS.search(x):
            shape = shape_of(x)[0]
            ws = WORDS.findall(x.lower())
            s = min(max(float(sum(model.odds[_bucket(w)] for w in ws)) / len(ws) * 2.5, -6.0), 6.0) if ws else -6.0
            s += (1.0 + 1.5 * min(repeats - 2, 2)) if i == top and repeats >= 2 and len(ws) >= 2 else 0
            s += sum(model.weight[j] for j in layout(x, shape, len(ws)))
            # a line much longer than any header counts as body the more, the longer it is, unless a number is set off in it
            s -= max(len(x) - 120, 0) / 20 if shape != "inside" else 0
            header = s - (5 if i != top else 0) - (5 if kind in ("code", "list_item") else 0)
        elif shape:
            agrees = offset is not None and page is not None and n == page + offset
            number = {"marked": 7.0, "roman": 4.0, "bare": 1.5}[shape] + (5.0 if agrees else 0)
            if i not in (top, bottom):
                number -= 5.0
            if shape == "bare":
                if offset is not None and not agrees:
                    number -= 6.0
                if kind == "table_cell":
                    number -= 5.0
                elif alone == 1 or (i and not ls[i - 1][2].strip()):
                    number += 3.0
            if kind == "code":
                number -= 4.0
        out.append((OUT, header, 0.0, number))
    return out


def label_pages(scores: list[list[tuple[float, float, float, float]]], model: LineModel) -> list[list[int]]:
    """The likeliest states of the lines of many pages (Viterbi, all pages at once, line by line)."""
    lens = np.array([len(x) for x in scores])
    flat = np.array([y for x in scores for y in x]).reshape(-1, 4)
    order = np.argsort(-lens, kind="stable")
    begin = (np.cumsum(lens) - lens)[order]
    falling = -lens[order]
    m = int(np.searchsorted(falling, 0, "left"))
    if not m:
        return [[] for _ in scores]
    back = np.zeros((len(flat), 4), np.int8)
    v = model.start + flat[begin[:m]]
    longest = int(-falling[0])
    for t in range(1, longest):
        some = int(np.searchsorted(falling, -t, "left"))
        step = v[:some, :, None] + model.step
        back[begin[:some] + t] = step.argmax(axis=1)
        v[:some] = step.max(axis=1) + flat[begin[:some] + t]
    states = np.zeros(len(flat), np.int8)
    state = v.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        some = int(np.searchsorted(falling, -t, "left"))
        at = begin[:some] + t
        states[at] = state[:some]
        state[:some] = back[at, state[:some]]
    return [x.tolist() for x in np.split(states, np.cumsum(lens)[:-1])]


def fixes_of(word: str) -> list[str]:
    """Words that one confusion would have turned into ``word`` (symbols and digits: all their occurrences)."""
    out = set()
    for wrong, right in CONFUSED:
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    out.discard(word)
    return [w for w in out if len(w) >= 2 and w.isalpha()]


class Flags(dict):
    """Whether a word may be a misread one, by a filter of bits; remembered per task, forgotten beyond ``most`` words."""

    def __init__(self, bits: bytes, most: int = 1_000_000):
        self.bits, self.most = bits, most

    def __missing__(self, word: str) -> bool:
        if len(self) > self.most:
            self.clear()
        at = zlib.crc32(word.encode()) % FILTER_BITS
        held = self[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return held


HYPHENS = frozenset("-‐‑¬\u00ad")


def _labelled(model: LineModel, bits: bytes):
    def label(batches):
        """Noise of each page: kinds decided here, and divided or possibly misread words to be looked up."""
        suspect = Flags(bits)
        for whole in batches:
            for low in range(0, len(whole), 500):
                pdf = whole[low : low + 500]
                pages, scores = [], []
                for kind, page, parts, repeats, offset in zip(pdf["rec_kind"], pdf["page"], pdf["parts"], pdf["repeats"], pdf["offset"]):
                    ls = _lines(parts)
                    page = None if page is None or page != page else int(page)
                    offset = None if offset is None or offset != offset else int(offset)
                    pages.append((kind, ls))
                    scores.append(line_scores(ls, 0 if repeats != repeats or repeats is None else int(repeats), offset, page, model))
                rows = []
                for (kind, ls), states in zip(pages, label_pages(scores, model)):
                    _page_noise(kind, ls, states, suspect, rows)
                yield pd.DataFrame(rows, columns=["rec_kind", "rec_id", "line_no", "noise", "a", "b", "at"])

    return label


def _page_noise(kind: str, ls: list[tuple[int, int, str, str, int]], states: list[int], suspect: Flags, rows: list) -> None:
    body = [i for i, s in enumerate(states) if s == BODY]
    for i, s in enumerate(states):
        if s == HEADER:
            rows.append((kind, ls[i][0], ls[i][1], "running_header", "", "", 0))
            if shape_of(ls[i][2])[0] == "inside":
                rows.append((kind, ls[i][0], ls[i][1], "page_number", "", "", 0))
        elif s == NUMBER:
            rows.append((kind, ls[i][0], ls[i][1], "page_number", "", "", 0))
    skip_first = False
    for j, i in enumerate(body):
        text, code = ls[i][2], ls[i][3] == "code"
        words = TOKEN.findall(text.lower())
        if skip_first and words:
            words = words[1:]
        skip_first = False
        if not code and j + 1 < len(body) and text.rstrip()[-1:] in HYPHENS and (m := DIVIDED.search(text)) and (c := CONTINUES.match(ls[body[j + 1]][2])) and (c[1][0].islower() or m[1].isupper()):
            rows.append((kind, ls[i][0], ls[i][1], "hyphenation", m[1].lower(), c[1].lower(), 0))
            joined = m[1].lower() + c[1].lower()
            words = words[:-1] if words else words
            if suspect[joined]:
                rows.append((kind, ls[i][0], ls[i][1], "misread", joined, str(ls[body[j + 1]][1]) if ls[body[j + 1]][0] == ls[i][0] else "", len(m[1])))
            skip_first = True
        if not code:
            for w in dict.fromkeys(words):
                if suspect[w]:
                    rows.append((kind, ls[i][0], ls[i][1], "misread", w, "", 0))


def corpus_words(text: DataFrame) -> DataFrame:
    """``word, n`` over whole texts: words (lower case), hyphenated compounds, and words with symbols or digits in them."""
    pattern = r"[\p{L}\p{N}]+(?:[@!|+$€][\p{L}\p{N}]+)*|[@!|+$€][\p{L}\p{N}]{2,}(?:[@!|+$€][\p{L}\p{N}]+)*"
    low = F.lower("text")
    plain = text.select(F.explode(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))).alias("word"))
    compound = text.select(F.explode(F.regexp_extract_all(low, F.lit(r"\p{L}{2,}-\p{L}{2,}"), F.lit(0))).alias("word"))
    return plain.unionByName(compound).groupBy("word").agg(F.count("*").alias("n"))


def misread_words(vocabulary: DataFrame, least: int = 8, ratio: int = 10) -> DataFrame:
    """``word, fix``: words for which one confusion leads to a word at least ``ratio`` times as frequent, seen ``least`` times.

    A word with a digit or symbol among its letters is no word itself: a fix seen twice, and twice as often, is enough.
    """

    @F.pandas_udf("array<string>")
    def fixes(ws: pd.Series) -> pd.Series:
        return ws.map(fixes_of)

    plain = vocabulary.where(~F.col("word").contains("-") & (F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    tried = plain.select("word", "n", F.explode(fixes("word")).alias("fix"))
    seen = vocabulary.where(F.col("n") >= 2).select(F.col("word").alias("fix"), F.col("n").alias("m"))
    odd = ~F.col("word").rlike(r"^\p{L}+$")
    enough = F.when(odd, F.col("m") >= F.col("n") * 2).otherwise((F.col("m") >= least) & (F.col("m") >= F.col("n") * ratio))
    return tried.join(seen, "fix").where(enough & (F.length("fix") >= 3)).groupBy("word").agg(F.max_by("fix", "m").alias("fix"))


def scan_noise(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, line_no, noise, a, b`` of every noisy line; ``a`` and ``b`` are the parts of a divided word, or the misread word and its repair.

    ``blocks``: block_uid, document_id, page, block_id, block_type, raw_text, text; ``pages``: page_id, source_file, page_number,
    transcript; one row per record, further columns ignored. A null raw_text is replaced by text; null and empty texts have no
    noise; a record without document is a document of its own. Lines are counted from 1, blank ones too.
    """
    held = materialize(scan_lines(blocks, pages), "scan-pages")
    ends = materialize(held.mapInPandas(_ends, "rec_kind string, doc string, page long, key string, offset long"), "scan-ends")
    size = ends.groupBy("rec_kind", "doc").agg(F.count_distinct("page").alias("of"))
    repeated = ends.where(F.col("key") != "").groupBy("rec_kind", "doc", "key").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
    # a running header stands on a good part of its document's pages; a heading comes again now and then
    repeated = repeated.join(size, ["rec_kind", "doc"]).where(F.col("pages") >= 0.3 * F.col("of"))
    offsets = ends.where(F.col("offset").isNotNull()).groupBy("rec_kind", "doc", "offset").agg(F.count("*").alias("n")).where("n >= 2")
    offsets = offsets.groupBy("rec_kind", "doc").agg(F.max_by("offset", "n").alias("offset"))
    # a document may hold a third of all pages: both joins are salted
    salt = F.pmod(F.hash("page"), F.lit(SALTS)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    top = ends.select("rec_kind", "doc", "page", "key", salt).join(repeated.select("*", salts), ["rec_kind", "doc", "key", "salt"]).select("rec_kind", "doc", "page", "pages")
    top = top.groupBy("rec_kind", "doc", "page").agg(F.max("pages").alias("repeats"))
    info = held.select("*", salt).join(offsets.select("*", salts), ["rec_kind", "doc", "salt"], "left").drop("salt")
    info = materialize(info.join(top, ["rec_kind", "doc", "page"], "left").select("rec_kind", "page", "parts", "repeats", "offset"), "scan-info")
    model = line_model(info, repeated)

    vocabulary = materialize(corpus_words(held.select(F.explode("parts.text").alias("text"))), "scan-words")
    wrong = materialize(misread_words(vocabulary), "scan-misread")
    # a filter of fixed size: where very many words are suspect it lets more pass, and the join below still decides exactly
    at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(FILTER_BITS)) + 1
    pieces = wrong.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for r in pieces.collect():
        bits[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = r["bits"]
    rows = info.mapInPandas(_labelled(model, bytes(bits)), "rec_kind string, rec_id long, line_no int, noise string, a string, b string, at int")
    rows = materialize(rows, "scan-lines")

    sure = rows.where(F.col("noise").isin("running_header", "page_number")).select("rec_kind", "rec_id", "line_no", "noise", "a", "b")
    split = rows.where(F.col("noise") == "hyphenation")
    forms = split.select(F.concat("a", F.lit("-"), "b").alias("word"), F.concat("a", "b").alias("joined")).distinct()
    known = vocabulary.select("word", "n")
    kept = forms.join(known, "word").select("word", "joined", "n").join(known.select(F.col("word").alias("joined"), F.col("n").alias("m")), "joined", "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select(F.col("word").alias("compound"))
    hyphens = split.withColumn("compound", F.concat("a", F.lit("-"), "b")).join(kept, "compound", "left_anti").select("rec_kind", "rec_id", "line_no", "noise", "a", "b")
    mis = rows.where(F.col("noise") == "misread").select("rec_kind", "rec_id", "line_no", F.col("a").alias("word"), "b", "at").join(wrong, "word")
    mis = mis.select("rec_kind", "rec_id", F.when((F.col("at") > 0) & (F.col("b") != "") & (F.length(first_difference(F.col("word"), F.col("fix"))) >= F.col("at")), F.expr("try_cast(b as int)")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("noise"), F.col("word").alias("a"), F.col("fix").alias("b"))
    return sure.unionByName(hyphens).unionByName(mis)


def first_difference(a: Column, b: Column) -> Column:
    """The common beginning of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))


COMPOUND = re.compile(r"[^\W\d_]{2}[-‐‑]$")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = []
        for text, noise in zip(pdf["text"], pdf["noise"]):
            lines = text.split("\n")
            drop, divided, fixes = set(), set(), {}
            for x in noise if noise is not None else ():
                if x["noise"] in ("running_header", "page_number"):
                    drop.add(x["line_no"])
                elif x["noise"] == "hyphenation":
                    divided.add(x["line_no"])
                else:
                    fixes[x["a"]] = x["b"]
            out, glue = [], False
            last = max((i for i, line in enumerate(lines, 1) if i not in drop and line.strip()), default=0)
            for i, line in enumerate(lines, 1):
                if i in drop:
                    continue
                s = line.strip()
                if i in divided and i < last:  # a word that goes on in the next record keeps its hyphen
                    s = re.sub(r"\s?[-‐‑¬­]\s*$", "", s)
                if not s:
                    if not glue:
                        out.append("\n\n")
                    continue
                out.append(s if glue or not out or out[-1] == "\n\n" else (" " + s))
                # a compound keeps its hyphen and goes on without a blank
                glue = i in divided or COMPOUND.search(s) is not None
            t = re.sub(r"\n{2,}", "\n\n", "".join(out)).strip()
            for a, b in fixes.items():
                t = re.sub(rf"(?i)(?<![^\W_]){re.escape(a)}(?![^\W_])", lambda m, b=b: b.capitalize() if m[0][0].isupper() else b, t)
            done.append(t)
        yield pdf[["rec_kind", "rec_id"]].assign(text=done)


def repair_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, text``: each record as continuous paragraphs, separated by blank lines, without the noise found."""
    noise = scan_noise(blocks, pages).groupBy("rec_kind", "rec_id").agg(F.collect_list(F.struct("line_no", "noise", "a", "b")).alias("noise"))
    records = scan_lines(blocks, pages).select("rec_kind", F.explode("parts").alias("p")).select("rec_kind", F.col("p.rec_id").alias("rec_id"), F.col("p.text").alias("text"))
    return records.join(noise, ["rec_kind", "rec_id"], "left").mapInPandas(_repaired, "rec_kind string, rec_id long, text string")
