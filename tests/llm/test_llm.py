"""Edge cases, brute force and round trips of the operators for training data."""

import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import languages, markup, mixing, neardup, packing, pairs, scans, subjects, turns

T0 = dt.datetime(2025, 1, 1)
SEG = "lecture_id string, segment_index int, start_seconds double, speaker string, language string, text string, is_unclear boolean, ingested_at timestamp, extra string, shard int"


def seg(rows):
    return [(l, i, s, sp, "en", t, False, T0 + dt.timedelta(seconds=n), "x", 1) for n, (l, i, s, sp, t) in enumerate(rows)]


def found(spark, rows, **kw):
    lec = spark.createDataFrame([("L", ["Dr. Hale Zandrik", "Speaker 1", "Speaker 12"])], "lecture_id string, speakers array<string>")
    out = turns.speaker_turns(spark.createDataFrame(rows, SEG), lec, **kw)
    return {(r["lecture_id"], r["first_segment"], r["last_segment"], r["speaker"]): r["text"] for r in out.collect()}


def test_turns(spark):
    rows = seg([
        ("L", 0, 0.0, "zandirk, Hale", "Hello uh, hello there. [applause]"), ("L", 1, 5.0, None, "Going on."), ("L", 2, 9.0, "S1", "{crosstalk} um..."), ("L", 3, 11.0, "H. Zandrik", "Third  third part."),
        ("L", 4, 20.0, "SPEAKER_01", "One. \n>> Speaker 12: Two."), ("L", 5, 30.0, "unknown", "[Speaker 12] (0:30) Three."), ("L", 6, 40.0, "?", None), ("L", 7, 41.0, "Spk 1", ""), ("L", 8, 50.0, "speaker-1", "draft"), ("L", 8, 50.0, "Speaker #1", "Final."),
        ("M", 0, 1.0, "Speaker 1", "No roster."), (None, 0, 1.0, "Speaker 1", "No lecture."),
    ])
    want = {("L", 0, 3, "Dr. Hale Zandrik"), ("L", 4, 4, "Speaker 1"), ("L", 4, 5, "Speaker 12"), ("L", 8, 8, "Speaker 1"), ("M", 0, 0, None)}
    for seconds in (1800, 7):  # one shard, many shards
        got = found(spark, rows, shard_seconds=seconds)
        assert set(got) == want
        assert got["L", 0, 3, "Dr. Hale Zandrik"] == "Hello there. Going on. Third part." and got["L", 8, 8, "Speaker 1"] == "Final."
    assert found(spark, []) == {}


def test_turns_are_the_same_for_any_shard(spark):
    rnd = random.Random(5)
    rows = seg([("L", i, i * 3.0, rnd.choice(["Speaker 1", "S12", None, "Zandrik"]), rnd.choice(["Words here.", "[music]", "uh"])) for i in range(120)])
    assert set(found(spark, rows, shard_seconds=10)) == set(found(spark, rows, shard_seconds=100_000))


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(90)]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 6, 25):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t).upper())
    texts += ["", None, "too short", "one two three"]
    rows = [(f"d{i}", t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string, cls int")
    members, links = neardup.near_duplicates(df, "id", k=3, threshold=0.5, bands=80, rows=4)
    got = {(r[0], r[1]) for r in neardup.expand_pairs(members, links).collect()}
    sh = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sh[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    ids = sorted(sh)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sh[a] and sh[b] and 2 * len(sh[a] & sh[b]) >= len(sh[a] | sh[b])}
    assert got <= want and len(got) >= 0.99 * len(want)
    none = spark.createDataFrame([], "id string, text string")
    assert neardup.expand_pairs(*neardup.near_duplicates(none, "id", k=3, threshold=0.5)).count() == 0


def test_groups_are_connected_components(spark):
    rnd = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    links = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "cls_a long, cls_b long")
    root = list(range(1000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r["cls"]: r["root"] for r in neardup.components(links).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    members = spark.createDataFrame([(f"m{c}", c) for c in (0, 1, 60, 100, 900)] + [("copy", 900), ("alone", 901)], "id string, cls long")
    assert {r["id"]: r["group"] for r in neardup.groups(members, links).collect()} == {"m0": "m0", "m1": "m0", "m60": "m0", "m900": "copy", "copy": "copy"}
    assert neardup.groups(members.where("false"), links.where("false")).count() == 0


def test_least_matches_rise_with_evidence():
    least = neardup.least_matches(0.5, 1e-4, [64, 128, 320])
    assert 30 < least[0] < 48 and least[0] / 64 < least[1] / 128 < least[2] / 320 < 0.75


MARKUP = [
    ("# A\n\ntext $x<1$\n\n- one\n  - two\n\n```\n# no\n- no\n```\n", ["heading", "formula", "list_item", "list_item", "code_block"]),
    ("Title\n=====\n\n---\n\nIt costs $40 and $12.\n\n1. a\n2. b\n\n| a | b |\n|---|---|\n| 1 | 2 |", ["heading", "list_item", "list_item", "table"]),
    ("== H ==\n\n* a\n** b\n# c\n\n<math>x</math>\n\n{|\n|-\n| 1\n|}\n\n<syntaxhighlight lang=\"c\">\n== no ==\n</syntaxhighlight>", ["heading", "list_item", "list_item", "list_item", "formula", "table", "code_block"]),
    ("<h2\n id=\"a\">T</h3><p>x, y <code>c</code></p><ul><li>a<li>b</ul><pre><code>if a &lt; b: # <h1></code></pre><table><tr><td><li>1</td></tr></table>", ["heading", "list_item", "list_item", "code_block", "table"]),
    ("&lt;h1&gt;T&lt;/h1&gt;\n\n&amp;lt;p&amp;gt;x\n\n&lt;ul&gt;&lt;li&gt;a&lt;/li&gt;&lt;/ul&gt;", ["heading", "list_item"]),
    ("\\section{\\textbf{A}}\n\nx~\\cite{r} \\(y\\)\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\begin{equation}\nz\n\\end{equation}\n% note\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n\\begin{tabular}{l}\n1 \\\\\n\\end{tabular}", ["heading", "formula", "list_item", "list_item", "formula", "code_block", "table"]),
    ("```\nunclosed\n# no", ["code_block"]),
    ("<h2 title='" + "long " * 200 + "'>T</h2><p>$" + "x + " * 300 + "y$ and <b", ["heading", "formula"]),
    ("plain text with 3 < 5 and 5 - 10 percent, R&D, C# and draft_note.\n- 33 -", []),
    ("", []), (None, []),
]


@pytest.mark.parametrize("text,kinds", MARKUP)
def test_markup_elements(text, kinds):
    assert [k for k, _, _ in markup.convert(text)[1]] == kinds


def test_markup_keeps_structure_and_drops_link_lists(spark):
    page = "<div><a href='/1'>Home page of the site</a> <a href='/2'>Another page of the site</a></div><div><h1>Title</h1><p>" + "A long paragraph, with commas, and words. " * 8 + "</p></div>"
    clean, elements = markup.convert(page)
    assert "# Title" in clean and "long paragraph" in clean and "Home page" not in clean and elements == [("heading", "Title", True)]
    df = spark.createDataFrame([(1, "# A", None, 5), (2, "", "x" * 200_000, 6), (None, None, None, 7)], "id long, a string, b string, field int")
    got = markup.markup_to_text(df, "id", ["a", "b"]).collect()
    assert len(got) == 6 and max(len(r["clean_text"]) for r in got) == 200_000
    assert markup.markup_to_text(df.where("false"), "id", ["a"]).count() == 0


@pytest.mark.parametrize("sign", ["**a ", "~~a ", "[a](", "[", "{{", "a <b ", "$ x ", "`a ", "<!--", "| a ", "&amp;", "<li>"])
def test_markup_reading_is_linear(sign):
    began = time.process_time()
    markup.convert(sign * 30_000)
    assert time.process_time() - began < 15


def test_markup_scoring_decides():
    body = "<p>" + "The cell divides, grows, and divides again in the wall. " * 6 + "</p>"
    page = f"<body><nav><a href='/'>Home</a></nav><div class='content'><h2>Cells</h2>{body}<div>A short remark.</div><div class='sidebar'>Subscribe to our mailing list for news.</div><ul><li>one</li></ul></div><div id='newsletter'><p>Never miss a post, join today and tell a friend.</p></div><footer>All rights, all wrongs.</footer></body>"
    clean, elements = markup.convert(page)
    assert "# Cells" in clean and "divides again" in clean and "A short remark." in clean and "- one" in clean
    assert not any(x in clean for x in ("mailing list", "Never miss", "rights", "Home"))
    # a longer, comma-rich container wins over a shorter one of the same kind
    two = "<div><div class='widget'><p>Buy this, now.</p></div><div class='widget'>" + body + "</div></div>"
    assert "Buy this" not in markup.convert(two)[0] and "divides again" in markup.convert(two)[0]
    text = "# A\n\nFirst part, with words.\n\n## B\n\n" + "Long, long, long text of the part. " * 5 + "\n\n## Links\n\n[one page of it](http://x) [another page of it](http://y)\n\n# C\n\n```\ncode\n```"
    clean, elements = markup.convert(text)
    assert "First part" in clean and "# B" in clean and "code" in clean and "another page" not in clean
    assert [k for k, _, kept in elements if not kept] == ["heading"]


def blocks(spark, rows):
    return spark.createDataFrame(rows, "block_uid long, document_id string, page int, block_id int, block_type string, raw_text string, text string, line_no int")


def test_scan_noise(spark):
    rows, uid = [], 0
    body = "The mitochondrion of the whole cell is a first-order kind of thing here.\nEvery student knows the mitochondrion and the question of the cell well."
    for doc in ("a", "b"):
        for page in range(1, 9):
            uid += 1
            rows.append((uid, doc, page, 0, "heading", "Reader of Cells 4   Part II" if doc == "a" else f"Other Course {'READER' if page % 2 else 'Reader'}", None, 0))
            uid += 1
            rows.append((uid, doc, page, 1, "paragraph", body if page > 1 or doc == "b" else "We see the mito-\nchondrion and a first-\norder questi0n here.", None, 0))
            uid += 1
            rows.append((uid, doc, page, 2, "unknown", f"{page + 20}", None, 0))
    rows += [(900, None, None, None, None, None, None, 0), (901, "c", 1, 0, "table_cell", "12\n55\n7", None, 0), (902, "c", 1, 1, "paragraph", "x" * 50_000, None, 0)]
    pages = spark.createDataFrame([(1, None, None, None), (2, "f", 1, "")], "page_id long, source_file string, page_number int, transcript string")
    got = {(r["rec_id"], r["line_no"], r["noise"]) for r in scans.scan_noise(blocks(spark, rows), pages).collect()}
    assert {(u, 1, "running_header") for u in range(1, 49, 3)} <= got and {(u, 1, "page_number") for u in range(3, 49, 3)} <= got
    assert (2, 1, "hyphenation") in got and (2, 3, "misread") in got and (2, 2, "hyphenation") not in got
    assert not {x for x in got if x[0] in (900, 901, 902)}
    text = {r["rec_id"]: r["text"] for r in scans.repair_pages(blocks(spark, rows), pages).where("rec_kind = 'block'").collect()}
    assert text[2] == "We see the mitochondrion and a first-order question here." and text[1] == "" and text[3] == ""
    none = blocks(spark, [])
    assert scans.scan_noise(none, pages.where("false")).count() == 0


def test_page_numbers_in_long_headers(spark):
    title = "Ostwick University – Structures and Proof III"
    long = "Proceedings of the Ostwick Summer School " + "on Structures, Proof, Algebra, Topology and Logic " * 2
    body = "The mitochondrion of the whole cell is a kind of thing here.\nEvery student knows the question of the cell well."
    rows = []
    for page in range(1, 9):
        head = f"{page + 20}    {title.upper()}" if page % 2 else f"{title}    {page + 20}"
        rows.append((page, "a", page, f"{head}\n\n{body}"))
        rows.append((100 + page, "b", page, f"{title}\n\n{body}"))  # the numeral belongs to the title
        rows.append((200 + page, "c", page, f"{long}   {page + 3}\n\n{body}"))
    assert len(long) > 120
    pages = spark.createDataFrame(rows, "page_id long, source_file string, page_number int, transcript string")
    got = {(r["rec_id"], r["line_no"], r["noise"]) for r in scans.scan_noise(blocks(spark, []), pages).collect()}
    assert {x for x in got if x[2] == "page_number"} == {(d + p, 1, "page_number") for d in (0, 200) for p in range(1, 9)}
    assert {x for x in got if x[2] == "running_header"} == {(d + p, 1, "running_header") for d in (0, 100, 200) for p in range(1, 9)}


WORDS = {
    "en": "the of and this is not with they have which would there house water people always never because",
    "de": "der die und das ist nicht mit sie haben welche würde dort haus wasser leute immer niemals weil",
    "es": "el los y esto es no con ellos tienen cual sería allí casa agua gente siempre nunca porque",
    "fr": "le les et ceci est pas avec ils ont lequel serait là maison eau gens toujours jamais parce",
    "pt": "o os e isto é não com eles têm qual seria ali casa água pessoas sempre nunca porquê",
}


def sentence(lang, rnd, n=9):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [("speech", " ".join(sentence(x, rnd) for _ in range(6)), x) for x in WORDS for _ in range(40)]
    rows += [("speech", "I am sorry but I have to pass on this request. I'm unable to draw it in words. Please ask your instructor.", "en")] * 20
    rows += [("speech", sentence("en", rnd), "de")] * 3 + [("speech", None, "en")]
    return languages.train(spark.createDataFrame(rows, "kind string, text string, lang string").withColumn("rec_key", F.monotonically_increasing_id().cast("string")))


def test_languages(spark, model):
    rnd = random.Random(4)
    rows = [(x, "speech", sentence(x, rnd)) for x in WORDS]
    rows += [("mix", "speech", f"{sentence('en', rnd)} {sentence('en', rnd)} {sentence('de', rnd)} {sentence('en', rnd)}"), ("noise", "speech", "[music] um... ♪"), ("null", "speech", None), ("empty", "page", ""), ("quoted", "speech", sentence("en", rnd) + ' The "der die das nicht" is left with the water.'), ("page", "page", "Der Kopf und die\n" + sentence("fr", rnd) + "\n12")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key string, kind string, text string, main_ int")
    got = {r["key"]: (r["main"], [p["lang"] for p in r["pieces"]]) for r in languages.detect_languages(df, model).collect()}
    for x in WORDS:
        assert got[x] == (x, [x])
    assert got["mix"] == ("en", ["en", "de", "en"]) and got["noise"] == got["null"] == got["empty"] == (None, []) and got["quoted"] == ("en", ["en"])
    assert got["page"][0] == "fr"
    assert languages.detect_languages(df.where("false"), model).count() == 0
    labels = spark.createDataFrame([("en_GB",), ("DEU",), ("pt-BR",), (" ",), (None,), ("string",), ("Spanish",)], "l string")
    assert [r[0] for r in labels.select(languages.canonical(F.col("l"))).collect()] == ["en", "de", "pt", None, None, None, "es"]


@pytest.mark.parametrize("response,cut", [("Yes.", False), ("Option B", False), ("It is so. And then the", True), ("It is so. [1", True), ("It is so. [1][2]", False), ("It is so. For example:", True), ("A.\n1. First\n2.", True), ("x\n```\ncode", True), ("x.\n```\ncode\n```", False), ("Points:\n- a\n- b", False), ("It is so. (optional)", False), ("One two three four five six", True)])
def test_truncation(response, cut):
    assert pairs.is_truncated(response) is cut


def test_pair_defects(spark, model):
    rnd = random.Random(6)
    good = lambda x: sentence(x, rnd) + " " + sentence(x, rnd)
    src = '{"items": [{"citation": 1}]}'
    rows = [("e", "What is it?", "<br>", src), ("n", "What is it?", None, None), ("c", "What is the house?", "**what is the house**", src), ("t", sentence("en", rnd), "It is. This is the", src), ("d", sentence("en", rnd), good("en") + " [1, 7]", src), ("d2", sentence("en", rnd), good("en") + " [1]", "{bad"), ("o", sentence("en", rnd), good("de"), src), ("asked", "They have the water. Answer in German please.", good("de"), src), ("ok", sentence("fr", rnd), good("fr") + " [1]", src), ("turn", sentence("en", rnd), "I'm unable to draw it, but in words: " + good("en"), src)]
    rows += [(f"r{i}", sentence("en", rnd), "I'm sorry, but I have to pass on this request. Please ask your instructor.", src) for i in range(5)]
    got = {(r["id"], r["defect"]) for r in pairs.pair_defects(spark.createDataFrame([(*r, 1) for r in rows], "id string, message string, response string, sources string, found int"), model).collect()}
    assert got == {("e", "empty"), ("n", "empty"), ("c", "copies_question"), ("t", "truncated"), ("d", "dangling_citation"), ("d2", "dangling_citation"), ("o", "other_language")} | {(f"r{i}", "refusal") for i in range(5)}
    assert pairs.pair_defects(spark.createDataFrame([], "id string, message string, response string, sources string"), model).count() == 0


def test_refusals_by_recurrence(spark, model):
    src = '{"items": [{"citation": 1}]}'
    asked = lambda i: f"What is the {['house', 'river', 'engine', 'planet'][i % 4]} of number {i}?"
    framed = ["house", "river", "engine", "planet"]
    rows = [(f"x{i}", asked(i), "Matters of this sort are not covered by the tutor today.", src) for i in range(4)]  # no listed phrase
    near = ["Matters of that kind belong to the people in the registry office and are never taken up by the tutor in a chat."] * 2 + ["Matters of that kind belong to the people in the registry office and are never taken up by the tutor in this chat."]
    rows += [(f"y{i}", asked(i), t, src) for i, t in enumerate(near)]  # recur only as a cluster
    rows += [("o0", asked(0), "Requests like yours go to the registry office on the ground floor.", src), ("o1", asked(0), "Requests like yours go to the registry office on the ground floor.", src), ("o2", asked(0), "Requests like yours go to the registry office on the ground floor.", src)]  # one message
    rows += [(f"s{i}", asked(i), "No, only the second one.", src) for i in range(5)]  # short and sound
    rows += [(f"f{i}", asked(i), f"Chapter 7 shows in detail and with many examples what everybody should know of it, as the {framed[i % 4]}.", src) for i in range(8)]  # sound, in one frame
    rows += [("d", asked(0), "Leider kann ich diese Frage nicht beantworten.", src)]  # declines, but once: nothing recurs, so nothing is revealed
    rows += [(f"p{i}", asked(i), "I have to decline." if i % 2 else "I have to decline. Ask them, please.", None) for i in range(12)]  # short, and without sources
    parts = [f"{a}, {b} {c}." for a in ("As a tutor for this course", "On behalf of the whole team", "After a look at the rules") for b in ("nothing can be said here about it", "we leave this to the people in charge", "such things stay out of the chat") for c in ("for the time being", "until the term ends again", "as you may well know")]
    rows += [(f"k{i}", asked(i), t, src) for i, t in enumerate(parts)]  # each once, put together from parts that recur
    got = pairs.pair_defects(spark.createDataFrame(rows, "id string, message string, response string, sources string"), model).where("defect = 'refusal'").collect()
    assert {r["id"] for r in got} == {f"x{i}" for i in range(4)} | {f"y{i}" for i in range(3)} | {f"p{i}" for i in range(12)} | {f"k{i}" for i in range(27)}


def test_packing_is_whole_and_never_overfull(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 1, 5, 30, 64, 100, 130, 257, rnd.randint(1, 99)])) for i in range(800)] + [(5000, None)]
    df = spark.createDataFrame(rows, "item long, size long").repartition(5)
    out = packing.pack_documents(df, {"s": 64, "l": 100}, open_bins=6)
    held = out.toPandas()
    for w, c in (("s", 64), ("l", 100)):
        x = held[held["window"] == w]
        assert x.groupby("container")["size"].sum().max() <= c
        assert x.groupby("item")["size"].sum().to_dict() == {str(i): n for i, n in rows if n}
        assert (x[x["size"] < c].groupby("item").size() == 1).all()
    report = {r["window"]: r["fill"] for r in packing.fill_report(out, {"s": 64, "l": 100}).collect()}
    assert report["s"] > 0.9 and report["l"] > 0.9
    assert packing.pack_documents(df.where("false"), {"s": 64}).count() == 0


def test_open_bins_take_the_fullest_that_fits():
    b = packing.OpenBins(10, 2)
    b.hold(0, 4)
    b.hold(1, 7)
    assert b.place(3) == (0, None)
    b.hold(0, 1)
    assert b.place(9) == (None, 0)


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|> x",)], "text string")
    n = [r["tokens"] for r in packing.token_counts(df, packing.default_tokenizer()).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 2


def test_token_counts_by_pieces_equal_whole_texts():
    rnd, t = random.Random(3), packing._tokenizer(packing.default_tokenizer())
    counts = packing.PieceCounts(t, most=500)
    letters = " \n\t\r\u00a0\u3000 abcX'\u2019s1\u0662%&\u00e9\u65e5\x0b\x0c\x1c\x85\u200b\ufeff\u180e\u00f1."
    for _ in range(5000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        assert counts.of(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    x = "It's a  long text,\n\n with 12 words.\t " * 40_000
    assert counts.of(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_mixing(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("aaab"), rnd.choice(["en", None]), rnd.choice(["x", "y"]), rnd.randint(20, 200)) for i in range(3000)] + [(9000, None, "en", "x", 5), (9001, "z", "en", "x", 5), (9002, "a", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    out, shares, margins = mixing.mix_sources(docs, targets, shard_rows=500)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["share"] - 5 / 9) < 0.01 and abs(s["b"]["share"] - 4 / 9) < 0.01 and s["none"]["tokens"] == 0
    assert s["a"]["most_copies"] == 1 and s["b"]["most_copies"] == 2
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"a", "b"}
    assert mixing.mix_sources(docs.where("false"), targets)[0].count() == 0


def test_mixing_to_given_margins(spark):
    rnd = random.Random(19)
    rows = [(i, rnd.choice("ab"), rnd.choice(["en", "en", "en", "de"]), rnd.choice(["x", "y"]), rnd.randint(20, 200)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    _, _, margins = mixing.mix_sources(docs, targets, lang_targets={"en": 0.65, "de": 0.35, "xx": 0.2}, topic_targets=lambda own: {k: 0.5 for k in own}, size=0.5, shard_rows=500)
    got = {(r["dimension"], r["value"]): (r["target_share"], r["share"]) for r in margins.collect()}
    assert set(got) == {("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "de"), ("topic", "x"), ("topic", "y")}
    assert abs(got["lang", "de"][0] - 0.35) < 1e-6 and abs(got["source", "a"][1] - 0.5) < 0.005 and got["lang", "de"][1] > 0.3 and abs(got["topic", "x"][1] - 0.5) < 0.02
    assert abs(sum(mixing.smoothed({"a": 0.9, "b": 0.1}).values()) - 1) < 1e-9 and mixing.smoothed({"a": 0.9, "b": 0.1})["b"] > 0.1


def test_raking_meets_marginals():
    tokens, k, j = np.array([10.0, 20, 30, 40]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = mixing.rake(tokens, [k, j], [np.array([0.5, 0.5]), np.array([0.3, 0.7])], np.full(4, 9.0), 100)
    assert np.allclose(np.bincount(k, tokens * w), [50, 50], atol=1e-6) and np.allclose(np.bincount(j, tokens * w), [30, 70], atol=1)


def test_subject_threshold_is_the_highest_of_the_best():
    p, y = np.array([[0.1, 0.9], [0.2, 0.7], [0.6, 0.05]]), np.array([[0, 1], [0, 1], [1, 0]])
    assert subjects.best_threshold(p, y) == 0.6


def test_subject_words_by_sentence_and_language():
    ids, lens = subjects.Parser().parse(["The law is the law. A b c. Die Katze und der Hund; 12", None, "", "x " * 60 + "the of and", "one two" * 3])
    law, cat = ids[0][:5], ids[0][5:]
    assert list(lens[0]) == [5, 5] and law[0] == law[3] and (law < subjects.BLOCK).all() and ((cat >= subjects.BLOCK) & (cat < 2 * subjects.BLOCK)).all()
    assert len(ids[1]) == len(ids[2]) == 0 and lens[3].sum() == len(ids[3]) == 3


def test_subjects_held_out(spark):
    rnd = random.Random(10)
    terms = {"law": ["court", "verdict", "statute", "appeal", "plaintiff"], "sport": ["marathon", "sprint", "referee", "goalkeeper", "relay"], "physics": ["torque", "wave", "lens", "voltage", "pendulum"]}
    say = lambda s: f"The {rnd.choice(terms[s])} depends on the {rnd.choice(terms[s])} and this is what you see."
    docs, truth, labels = [], {}, []
    for i in range(400):
        s = rnd.choice(list(terms))
        t = [say(s) for _ in range(rnd.randint(2, 9))]
        truth[i] = {s}
        if i % 10 == 0:
            o = rnd.choice([x for x in terms if x != s])
            t += [say(o) for _ in range(len(t))]
            truth[i] = {s, o}
        if i % 10 == 1:
            t, truth[i] = ["Please bring your card to desk 3.", "The canteen opens at noon."], set()
        elif i % 4 == 0:
            labels.append((i, s if rnd.random() > 0.05 else "law", "staff"))
        docs.append((i, " ".join(t), "en", 1))
    docs += [(1000, None, None, 1), (1001, "", "en", 1), (1002, " ".join(say("law") for _ in range(2000)), "en", 1)]
    truth |= {1000: set(), 1001: set(), 1002: {"law"}}
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, share int")
    l = spark.createDataFrame([*labels, (77777, "law", "x"), (3, "unknown", "x"), (None, "law", "x")], "doc_id long, subject string, labelled_by string")
    e = spark.createDataFrame([(k, v[:2]) for k, v in terms.items()], "subject string, example_terms array<string>")
    shares = subjects.subject_shares(d, l, e)
    got: dict = {i: set() for i in truth}
    for r in subjects.subjects_of(shares).collect():
        got[r["doc_id"]].add(r["subject"])
    held_out = [i for i in truth if i not in {x[0] for x in labels}]
    assert np.mean([got[i] == truth[i] for i in held_out]) > 0.97
    assert subjects.subjects_of(subjects.subject_shares(d.where("false"), l, e)).count() == 0
