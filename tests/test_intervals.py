import random

from pyspark.sql import functions as F

from lectern.operators.intervals import RunBitmap, periods_and_gaps, whole_units


def brute(rows):
    out = set()
    for v in {r[0] for r in rows}:
        if v is None:
            continue
        merged = []
        for s, e in sorted((s, e) for x, s, e in rows if x == v and s is not None and e is not None and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(v, "period", s, e) for s, e in merged} | {(v, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "v string, s long, e long, kind string, edge int")
    return {tuple(r) for r in periods_and_gaps(df, "v", F.col("s"), F.col("e"), **kw).collect()}


def test_against_brute_force_with_small_shards(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), s, s + rnd.randint(-3, 40)) for s in (rnd.randint(-200, 900) for _ in range(250))]
    rows += [("d", 0, 1000), ("d", 10, 20), ("e", 5, 64), ("e", 64, 70), ("e", 128, 129), (None, 1, 2), ("f", None, 3), ("f", 3, None), ("g", 7, 7)]
    wide = [(*r, "x", 1) for r in rows]  # clashing extra columns
    assert run(spark, wide + wide, shard_bits=6) == brute(rows)
    assert run(spark, wide, shard_bits=22) == brute(rows)


def test_very_long_intervals_cost_a_few_pieces(spark):
    rows = [("a", 5, 10), ("a", 100, 10**15), ("a", 10**15, 10**15 + 7), ("a", 10**15 + 9, 2**52 - 1), ("a", 10**14, 10**14 + 5), ("b", -(10**15), 3), ("b", 4, 10**15), ("c", 0, 5 << 22), ("c", (5 << 22) + 1, 9 << 22), ("c", 3, 4), ("c", 10 << 22, (10 << 22) + 1)]
    assert run(spark, [(*r, "x", 1) for r in rows]) == brute(rows)


def test_many_long_and_short_intervals_against_brute_force(spark):
    rnd = random.Random(17)
    rows = [(rnd.choice("abcdef"), s, s + rnd.choice([1, 5, 30, 200, 700])) for s in (rnd.randint(-4000, 9000) for _ in range(150))]
    assert run(spark, [(*r, "x", 1) for r in rows], shard_bits=5) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_whole_units(spark):
    df = spark.createDataFrame([(1.0004,), (0.1 + 0.2,), (None,), (float("nan"),), (float("inf"),), (-1.5,)], "s double")
    assert [r[0] for r in df.select(whole_units(F.col("s"))).collect()] == [1000, 300, None, None, None, -1500]


def test_run_bitmap_round_trip():
    import numpy as np

    b = RunBitmap.of(np.array([5, 1, 6, 20]), np.array([7, 5, 9, 2**32]))
    assert b.starts.tolist() == [1, 20] and b.ends.tolist() == [9, 2**32]
    c = RunBitmap.from_bytes(b.to_bytes())
    assert c.starts.tolist() == b.starts.tolist() and c.ends.tolist() == b.ends.tolist()
    assert len(RunBitmap.from_bytes(RunBitmap.of(np.array([]), np.array([])).to_bytes()).starts) == 0
