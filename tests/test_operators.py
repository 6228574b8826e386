import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import slug, time_label, video_id
from lectern.operators.chunking import concept_boundaries, heading_segments, timed_chunks, title_chunks, token_chunks, word_windows
from lectern.operators.retrieval import dense_topk, keep_newest, metadata_filter, mmr_select
from lectern.operators.sequence import ordinals, previous, sliding_windows


def test_dense_topk_is_exact_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(180, 8))
    m[7] = 0
    m[9] = m[11]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in dense_topk(df, df.where("id % 20 = 0"), 5, block_rows=17, query_rows=3).collect()}
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(0, 180, 20):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        want = sorted(range(180), key=lambda i: (-s[i], i))[:5]
        assert [got[q, r] for r in range(1, 6)] == want


def test_sequence_helpers_match_plain_windows(spark):
    rows = [("a", i, f"x{i}") for i in range(0, 60, 3)] + [("b", 5, "y"), ("a", None, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {(r["k"], r["v"]): (r["ordinal"], r["previous"]) for r in previous(ordinals(df, "k", ["o"], 10), "k", ["o"], 10, F.col("v")).collect()}
    assert got["a", "n"] == (0, None) and got["a", "x0"] == (1, "n") and got["a", "x57"] == (20, "x54") and got["b", "y"] == (0, None)


@pytest.mark.parametrize("n,expected", [(1, 1), (6, 1), (7, 2), (10, 2), (11, 3)])
def test_sliding_windows_end_rule(spark, n, expected):
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("ordinal"))
    w = sliding_windows(df, "k", "ordinal", 6, 2).groupBy("window_index").agg(F.max("ordinal").alias("m")).collect()
    assert len(w) == expected and max(r["m"] for r in w) == n - 1


def test_word_windows_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "id int, t string")
    got = [(r["id"], r["window_index"], r["window_text"]) for r in word_windows(df, "t", 3, 1).orderBy("id", "window_index").collect()]
    assert got == [(1, 0, "a b c"), (1, 1, "c d e")]


def test_folds():
    assert heading_segments("") == [] and len(heading_segments("A" * 100 + "\n\n" + "b\n\n" + "C" * 100)) == 2
    long = " ".join(f"Sentence number {i} ends here." for i in range(200))
    assert all(len(c) <= 2600 for c in heading_segments(long))
    assert timed_chunks("few words") == [] and " ".join(timed_chunks(long, carry=0)) == long
    assert len(token_chunks(long)) > 1 and token_chunks(" ") == []
    assert all(len(c) <= 3300 for c in title_chunks("x" * 9000)) and title_chunks("") == []


def test_filter_translator(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert [r["n"] for r in df.where(metadata_filter({"n": {"$gte": 2}, "s": {"$in": ["b"]}})).collect()] == [2]
    with pytest.raises(ValueError):
        metadata_filter({"n": {"$near": 1}})


def test_keep_newest_and_mmr(spark):
    e = spark.createDataFrame([("c", i % 3, i) for i in range(300)], "b string, t int, id int")
    assert {r["id"] for r in keep_newest(e, ["b"], "t", "id", 4).collect()} == {299, 296, 293, 290}
    c = spark.createDataFrame([(1, i, 1 - i / 10, "f" if i < 3 else f"g{i}", i) for i in range(6)], "query_id int, id int, score double, file string, position int")
    # by hand: after 0 the gains are -.325, -.355, -.28, -.24, -.2; after 5 the best left is 4
    assert [r["id"] for r in mmr_select(c, 3, lam=0.3).orderBy("pick").collect()] == [0, 5, 4]
    assert [r["id"] for r in mmr_select(c, 9).orderBy("pick").collect()] == [0, 1, 2, 3, 4, 5]


def test_scalars(spark):
    df = spark.createDataFrame([(3661.5, "https://x/w?v=abcdefghijk", "Waves & Fields I"), (None, "abcdefghijk", "x"), (59.9, "nope", "y" * 80)], "s double, u string, t string")
    r = df.select(time_label(F.col("s")), video_id(F.col("u")), slug(F.col("t"), "course")).collect()
    assert [x[0] for x in r] == ["01:01:01", "00:00", "00:59"] and [x[1] for x in r] == ["abcdefghijk", "abcdefghijk", None]
    assert r[0][2].startswith("course-waves-fields-i-") and all(len(x[2]) <= 45 for x in r)


def test_sources_and_store(spark, tmp_path):
    from lectern.sources.files import binary_files, parsed_pages, pipeline_of, plain_text, split_rejects
    from lectern.sources.store import VectorTable, dump_json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ftwo")
    (tmp_path / "in" / "b.md").write_text("not read")
    (tmp_path / "in" / "c.xyz").write_text("no")

    def parse(path, content):
        if path.endswith(".md"):
            raise ValueError("bad")
        return plain_text(path, content)

    pages, rejects = parsed_pages(binary_files(spark, str(tmp_path / "in"), "document"), parse)
    assert [(r["page_no"], r["text"]) for r in pages.orderBy("page_no").collect()] == [(1, "one"), (2, "two")]
    assert [r["error"] for r in rejects.collect()] == ["ValueError: bad"]
    p = spark.createDataFrame([("x.PDF",), ("y.wav",), ("https://youtu.be/x",), ("z.exe",), (None,)], "p string")
    assert [r[0] for r in p.select(pipeline_of(F.col("p"))).collect()] == ["document", "audio", "youtube", None, None]
    good, bad = split_rejects(spark.createDataFrame([(1, 0.5), (-1, 2.0), (None, 0.1)], "n int, c double"), {"n": F.col("n") >= 0, "c": F.col("c").between(0, 1)})
    assert good.count() == 1 and sorted(r["failed"] for r in bad.collect()) == [["n"], ["n", "c"]]

    t = VectorTable(spark, str(tmp_path / "table"))
    rec = "id string, index_name string, namespace string, raw_text string, updated_at int"
    t.upsert(spark.createDataFrame([("a", "i", "n", "old", 1), ("b", "i", "n", "keep", 1), ("c", "j", "n", "x" * 9000, 1)], rec))
    t.upsert(spark.createDataFrame([("a", "i", "n", "new", 2), ("a", "i", "n", "newer", 3)], rec))
    got = {r["id"]: r["raw_text"] for r in t.read().collect()}
    assert got["a"] == "newer" and got["b"] == "keep" and len(got["c"]) == 8000
    assert {tuple(r) for r in t.stats().collect()} >= {(None, None, 3), ("i", "n", 2)}
    assert t.invalidate("j") == 1 and t.read().count() == 2
    dump_json(t.read(), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_relational(spark):
    from lectern.operators.relational import choose_transcript, clamped, delete_cascade, insert_new

    t = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(insert_new(t, spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "e")], "k int, v string"), ["k"]).select("k").toPandas()["k"].fillna(-1).tolist()) == [-1, 1, 2]
    child = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, fk int")
    left = delete_cascade(t, "k", F.col("k") == 1, {"child": (child, "fk")})
    assert left[""].count() == 0 and {r["id"] for r in left["child"].collect()} == {2, 3}
    v = spark.createDataFrame([("x", "de", True), ("x", "fr", False), ("x", "en", False), ("y", "pt", True), ("y", None, None)], "video_id string, language string, is_generated boolean")
    assert {r["video_id"]: r["language"] for r in choose_transcript(v, ["en", "de"]).collect()} == {"x": "en", "y": "pt"}
    c = spark.createDataFrame([(99, None), (-1, 0.5)], "dense_k int, w double")
    assert [tuple(r) for r in clamped(c, {"dense_k": (2, 20), "w": (0.6, 1)}).collect()] == [(20, None), (2, 0.6)]


def test_materialized_tables_can_be_dropped(spark):
    from lectern.session import drop_materialized, latest, materialize

    drop_materialized(spark)
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, None), (None, "x", 1)], "k int, v string, ingested_at int")
    assert {r["k"]: r["v"] for r in latest(df, ["k"], ["v"]).collect()} == {1: "b", 2: None, None: "x"}
    assert materialize(df, "t").count() == 4 and drop_materialized(spark) == 1


def whole_lecture_runs(texts, names, least=4, most=12, look=4):
    def seen(i):
        ahead = " ".join((t or "").lower() for t in texts[i : i + look])
        counts = [ahead.count(n.lower()) for n in names]
        return names[counts.index(max(counts))] if counts and max(counts) else None

    starts = [0]
    topic = [seen(0)]
    for i in range(1, len(texts)):
        since, now = i - starts[-1], seen(i)
        if since >= (most if names else least) or (names and since >= least and now and now != topic[-1]):
            starts.append(i)
            topic.append(now)
    return [(s, e - 1, t or "") for s, e, t in zip(starts, [*starts[1:], len(texts)], topic)]


def test_concept_boundaries_are_those_of_one_fold(spark):
    rng = np.random.default_rng(3)
    lectures = {"long": (700, ["Graph", "Tree", "Heap"]), "edge": (480, ["Graph", "Tree"]), "plain": (500, []), "null": (250, None), "short": (1, ["Graph"])}
    texts = {k: [None if rng.random() < 0.05 else " ".join(rng.choice(["graph", "tree", "heap", "so", "and", "well"], 3, p=[0.1, 0.1, 0.1, 0.3, 0.2, 0.2])) for _ in range(n)] for k, (n, _) in lectures.items()}
    rows = [(k, i, t, lectures[k][1]) for k, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, o int, t string, names array<string>").repartition(3)
    want = {(k, *r) for k, ts in texts.items() for r in whole_lecture_runs(ts, lectures[k][1] or [])}
    for shard in (240, 3):
        got = [tuple(r) for r in concept_boundaries(df, "k", "o", "t", "names", shard=shard).collect()]
        assert len(got) == len(want) and set(got) == want


def test_dense_topk_joins_nothing_and_compares_billionths(spark):
    # id 0 is less alike than the others by 5e-13 only, so it ties and comes first
    near = [1.0, 1e-6]
    rows = [(i, near if i == 0 else [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = spark.createDataFrame([(200, [2.0, 0.0]), (7, [1.0, 0.0]), (201, [0.0, 0.0])], "id bigint, vector array<double>")
    got = dense_topk(df, asked, 3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {q: [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (200, 7, 201)} == {200: [0, 1, 2], 7: [0, 1, 2], 201: [0, 1, 2]}
    # one bucket or many: the same
    many = dense_topk(df, asked, 3, block_rows=5, query_rows=1)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, got.collect()))


def test_texts_asked_by_many_are_searched_once_and_leave_out_their_own_asker(spark):
    from lectern.operators.retrieval import dense_topk_of_texts

    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(6)], "id bigint, vector array<double>")
    asked = spark.createDataFrame([(0, "a"), (1, "a"), (50, "a")], "query_id bigint, text string")
    got = dense_topk_of_texts(df, asked, 2, lambda x: x.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))))
    assert {(r["query_id"], r["rank"]): r["id"] for r in got.collect()} == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (50, 1): 0, (50, 2): 1}


def test_bm25_by_shards_is_exact(spark):
    import math
    import re
    from collections import Counter

    from lectern.operators.retrieval import bm25_topk

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    docs = [("x" if i % 4 else "y", i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(160)] + [("x", 500, None), ("y", 501, "")]
    asks = [(1, "x", "w1 w2 w2"), (2, "y", "w3 w4"), (3, "x", "w5 unknown"), (4, "z", "w1"), (5, "x", None)]
    want = set()
    for q, g, text in asks:
        own = {i: re.findall(r"\S+", t or "") for h, i, t in docs if h == g}
        df = Counter(w for t in own.values() for w in set(t))
        idf = {w: math.log((len(own) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        mean, avg = sum(idf.values()) / max(len(idf), 1), sum(map(len, own.values())) / max(len(own), 1)
        raw = {}
        for w, n in Counter((text or "").split()).items():
            for i, t in own.items():
                if f := t.count(w):
                    raw[i] = raw.get(i, 0) + n * (idf[w] if idf[w] >= 0 else 0.25 * mean) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        scored = sorted((-round(r / (max(raw.values()) if max(raw.values()) > 0 else 1), 6), i) for i, r in raw.items())
        want |= {(q, i, k) for k, (_, i) in enumerate(scored[:7], 1)}
    d, a = spark.createDataFrame(docs, "grp string, id bigint, text string"), spark.createDataFrame(asks, "query_id bigint, grp string, text string")
    for rows in (3, 4096):
        got = bm25_topk(d, a, 7, shard_rows=rows)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_retrieve_answers_equal_queries_once_and_none_if_nobody_asks(spark):
    from lectern import session
    from lectern.operators.retrieve import retrieve

    rows = [(i, "qna" if i % 3 else "documents", f"cell wall of leaf {i % 7} and root {i % 5}", f"f{i % 4}", i) for i in range(40)]
    records = spark.createDataFrame(rows, "id bigint, source_key string, text string, source_file string, position int")
    asked = [(100, "leaf 3", "ask"), (101, "leaf 3", "ask"), (102, "leaf 3", "quiz"), (3, "leaf 3", "ask"), (103, None, None), (104, None, None)]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, mode string")
    got = retrieve(records, queries)
    held = {n: spark.read.parquet([p for p in session._WRITTEN if f"lectern-{n}-" in p][-1]) for n in ("query-vectors", "dense-found")}
    # 3 is a record, so it leaves itself out and has a list of its own
    assert sorted(r["id"] for r in held["query-vectors"].collect()) == [3, 100, 102, 103]
    assert "text" not in held["dense-found"].columns
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["source_key"], r["rrf"], r["methods"])
    assert set(by) == {q for q, _, _ in asked} and all(sorted(x) == list(range(1, 9)) for x in by.values())
    assert by[100] == by[101] and by[103] == by[104]
    assert 3 not in {x[0] for x in by[3].values()} and 3 in {x[0] for x in by[100].values()}
    assert retrieve(records, queries.where("false")).count() == 0


def test_diversity_lists_across_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(f"q{q}", q * 100 + i, float(rng.random()), f"f{rng.integers(3)}", int(rng.integers(20))) for q in range(30) for i in range(1 + q % 12)]
    c = spark.createDataFrame(rows, "query_id string, id bigint, score double, file string, position int")
    whole = sorted(map(tuple, mmr_select(c, 5).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, mmr_select(c, 5).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [len([r for r in whole if r[0] == f"q{q}"]) for q in range(30)] == [min(5, 1 + q % 12) for q in range(30)]
    alone = [tuple(r) for q in (7, 23) for r in mmr_select(c.where(f"query_id = 'q{q}'"), 5).collect()]
    assert set(alone) <= set(whole)
