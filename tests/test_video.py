import random

from pyspark.sql import functions as F

from lectern.operators.video import Sizes, pack_snippets

ROW = "video_id string, start double, end double, text string, tie string"
META = "video_id string, chapters array<struct<title string, start_sec double>>"


def plain(snippets, chapters, target, carry, least):
    """By the definition, over whole lists: chapters in turn; words up to the target; a short rest joins the chunk before."""
    starts = sorted((s, t) for t, s in chapters)
    place = lambda at: max(sum(s <= at for s, _ in starts) - 1, 0) if starts else -1
    out = []
    for ch in sorted({place(s[0]) for s in snippets}):
        own = sorted(s for s in snippets if place(s[0]) == ch)
        held, first = [], 0
        for i, (_, _, text) in enumerate(own):
            held += text.split()
            if len(held) >= target:
                out.append([ch, own[first][0], own[i][1], list(held)])
                held, first = held[-carry:], max(first, i - 2)
        if held:
            if len(held) >= least:
                out.append([ch, own[first][0], own[-1][1], held])
            elif out:
                out[-1][3] += held
                out[-1][2] = own[-1][1]
    return [(ch, a, b, " ".join(w)) for ch, a, b, w in out]


def test_chapters_in_turn(spark):
    rnd = random.Random(4)
    chapters = {"v": [("One", 0.0), ("Two", 90.0), ("Three", 300.0)], "w": [("Late", 50.0)]}
    snippets = {v: [(float(i * 7), float(i * 7 + 6), " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 30)))) for i in range(60)] for v in chapters}
    rows = [(v, *s, f"{i:03}") for v, ss in snippets.items() for i, s in enumerate(ss)]
    rnd.shuffle(rows)
    meta = spark.createDataFrame([(v, [(t, s) for t, s in c][::-1]) for v, c in chapters.items()], META)
    got = pack_snippets(spark.createDataFrame(rows, ROW).repartition(5), meta, Sizes(target=60, carry=10, least=25)).orderBy("video_id", "chunk_no").collect()
    for v, ss in snippets.items():
        assert [(r["chapter_index"], r["start_sec"], r["end_sec"], r["text"]) for r in got if r["video_id"] == v] == plain(ss, chapters[v], 60, 10, 25)
    assert {r["chapter_title"] for r in got} == {"One", "Two", "Three", "Late"}


def test_without_chapters_cuts_at_sentence_ends(spark):
    text = "This is a sentence of seven words. "
    rows = [("s", float(i), None if i % 2 else float("nan"), text * 5, f"{i:03}") for i in range(30)] + [("s", None, 1.0, "no start", "x"), (None, 1.0, 2.0, "no video", "y"), ("e", 1.0, 2.0, None, "z"), ("t", 1.0, 2.0, "too short", "q")]
    df = spark.createDataFrame(rows, ROW).withColumn("chapter_index", F.lit(7))
    got = pack_snippets(df, spark.createDataFrame([("s", None)], META)).orderBy("chunk_no").collect()
    assert {r["video_id"] for r in got} == {"s"} and [r["chunk_no"] for r in got] == [0, 1, 2, 3]
    assert all(r["chapter_index"] == -1 and r["chapter_title"] == "Unknown" and r["text"].endswith(".") for r in got)
    assert all(270 < r["words"] < 330 for r in got[:3])
    assert pack_snippets(df.where("false"), spark.createDataFrame([("s", None)], META)).count() == 0
