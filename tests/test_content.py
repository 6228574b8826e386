import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.labels import code_language, infer_source, is_section_title, metadata_boost, page_label
from lectern.operators import images
from lectern.operators.boundary import call_model, hashed_embedding, json_answer
from lectern.operators.clusters import centroid_clusters, keep_distinct
from lectern.operators.planning import category_of, plan_budgets, source_boost, valid_budgets


def page(angle=0.0):
    a = np.full((200, 300), 235, np.uint8)
    for y in range(20, 180, 16):
        for x in list(range(20, 130)) + list(range(170, 280)):
            yy = int(round(y + x * np.tan(np.radians(angle))))
            if x % 7 < 5 and 0 <= yy < 196:
                a[yy : yy + 4, x] = 30
    return a


def test_image_stages():
    a = page()
    assert (images.decode_pgm(images.encode_pgm(a)) == a).all()
    assert images.normalise(255 - a).mean() > 120
    assert images.skew_angle(a) == 0 and abs(images.skew_angle(page(2.0)) - 2.0) <= 0.5
    b, found = images.prepare(page(1.5))
    assert set(np.unique(b)) <= {0, 255} and found["columns"] == 2 and 0.02 < found["ink"] < 0.4
    noisy = a.copy()
    noisy[100, 150] = 0
    assert images.denoise(noisy)[100, 150] > 200 and images.crop_border(np.pad(a, 10)).shape == a.shape


def test_image_operator_keeps_errors(spark):
    df = spark.createDataFrame([(1, bytearray(images.encode_pgm(page()))), (2, bytearray(b"no image")), (3, None)], "id int, content binary")
    got = {r["id"]: r for r in images.prepare_images(df, "id", "content").collect()}
    assert got[1]["error"] is None and got[1]["columns"] == 2 and got[2]["image"] is None and "PGM" in got[2]["error"] and got[3]["error"]


def test_planner(spark):
    q = spark.createDataFrame([(1, "What is the difference of a and b?", "quiz"), (2, None, "odd")], "query_id int, query string, mode string")
    rows = {(r["query_id"], r["source"]): r for r in plan_budgets(q).collect()}
    assert len(rows) == 12 and abs(rows[1, "documents"]["priority_weight"] - 2.34) < 1e-9 and rows[1, "qna"]["dense_k"] == 9 and rows[2, "documents"]["priority_weight"] == 2.2
    good, bad = valid_budgets(plan_budgets(q).withColumn("dense_k", F.when(F.col("source") == "qna", 99).otherwise(F.col("dense_k"))))
    assert good.count() == 10 and bad.count() == 2
    assert q.select(category_of(F.col("query"))).collect()[1][0] == "general"


def test_labels(spark):
    df = spark.createDataFrame([("def f(x):\n    # a\n    return 1", 1, 1, {"video_id": "v", "ingested_at": "t"}), ("hello", 2, 4, {"strategy": "other"}), (None, None, 4, None)], "t string, a int, b int, k map<string,string>")
    r = df.select(code_language(F.col("t")), page_label(F.col("a"), F.col("b")), infer_source(F.col("k")), metadata_boost([(F.col("a") > 1, 2.0), (F.col("b") > 1, 1.5)])).collect()
    assert [tuple(x) for x in r] == [("python", "1", "youtube", 1.0), ("unknown", "2–4", "documents", 3.0), ("unknown", "4", "documents", 1.5)]
    t = spark.createDataFrame([("3.1 Waves",), ("CHAPTER ONE",), ("This is a sentence.",), ("",), (None,), ("lower case words here",), ("Each Word So",), ("Not this One",), ("Slide 4: more",)], "t string")
    assert [x[0] for x in t.select(is_section_title(F.col("t"))).collect()] == [True, True, False, False, False, False, True, False, True]
    h = spark.createDataFrame([("equation", 0.5, True)], "content_type string, confidence double, has_equations boolean")
    assert h.select(F.round(source_boost("handwritten", ("formula",)), 6)).first()[0] == pytest.approx(1.08 * 0.85 * 1.15)


def test_boundary_retries_and_reports(spark):
    calls = []

    def flaky(texts):
        calls.append(1)
        if "bad" in texts:
            raise RuntimeError("429")
        return hashed_embedding(texts, 4)

    df = spark.createDataFrame([("a b",), (None,), ("bad",)], "t string").coalesce(1)
    got = call_model(df, "t", flaky, "array<double>", "v", rows=1, tries=2, pause=0.01).collect()
    assert got[0]["v"] is not None and got[1]["v"] == [0.0] * 4 and got[2]["v"] is None and "429" in got[2]["v_error"]
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('Sure: {"a": 2} done',), ("none",), (None,)], "t string")
    assert [r[0] for r in j.select(json_answer("t", "a int")["a"]).collect()] == [1, 2, None, None]


def test_clusters_and_distinct(spark):
    from lectern.functions.text import tokens

    items = ["red apple pie", "red apple tart", "quantum field theory", "field theory quantum", "red apple pie now"]
    df = spark.createDataFrame([(1, items), (2, []), (3, None)], "id int, items array<string>")
    got = [r["cluster"] for r in centroid_clusters(df, "id", "items", embed=hashed_embedding).orderBy("position").collect()]
    assert got == [0, 0, 1, 1, 0]
    assert df.select(keep_distinct(F.col("items"), tokens)).first()[0] == ["red apple pie", "red apple tart", "quantum field theory"]


def test_seed_union_hashes_whole_texts(spark, tmp_path):
    import hashlib

    from lectern.plans.evaluation_queries import seed_union

    for name, columns in {"youtube_chunks": "chunk_id string, raw_text string", "handwritten_pages": "page_id long, transcript string", "ocr_blocks": "block_uid long, raw_text string"}.items():
        spark.createDataFrame([], columns + ", ingested_at timestamp").write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = {1: "word " * 2000 + "one", 2: "word " * 2000 + "two", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["text_hash"] for r in seed_union(spark, str(tmp_path)).collect()}
    assert got == {f"doc_{i}": hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
