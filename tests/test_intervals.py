"""Interval merge over rows and interval functions within a row, against brute force."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.operators.intervals import merge_spans, span_ms

SCHEMA = "e string, q string, s bigint, t bigint, kind string, k0 int"


def brute(rows):
    by = {}
    for e, q, s, t in rows:
        if s is not None and t is not None and s < t:
            by.setdefault((e, q), set()).add((s, t))
    out = []
    for key, spans in by.items():
        merged = []
        for s, t in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
                merged[-1][2] += 1
            else:
                merged.append([s, t, 1])
        out += [(*key, "period", *m) for m in merged]
        out += [(*key, "gap", a[1], b[0], 0) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_brute_force_with_a_hot_entity(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(3000):
        e, q = (("hot", "1") if rnd.random() < 0.5 else (rnd.choice([None, "a", "b"]), rnd.choice([None, "1", "2"])))
        s = rnd.randrange(100_000)
        rows.append((e, q, s if rnd.random() > 0.02 else None, s + rnd.choice([0, 1, 5, 40, 400 if seed == 1 else 5]) if rnd.random() > 0.02 else None))
    rows += rows[:50]  # repeated rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)  # extra columns with clashing names
    got = merge_spans(df, ["e", "q"], "s", "t").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_merge_one_island_over_all_partitions(spark):
    rows = [("a", "1", i, i + 2) for i in range(5000)] + [("a", "1", 0, 4000)]
    got = merge_spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), ["e", "q"], "s", "t").collect()
    assert [tuple(r) for r in got] == [("a", "1", "period", 0, 5001, 5001)]


def test_many_copies_of_one_span_count_once(spark):
    rows = [("a", "1", 5, 9)] * 4000 + [("a", "1", 9, 12)] * 3 + [("a", "1", 20, 21)] * 2000 + [("b", "1", 5, 9)] * 2
    got = merge_spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(9), ["e", "q"], "s", "t").collect()
    assert sorted(tuple(r) for r in got) == [("a", "1", "gap", 12, 20, 0), ("a", "1", "period", 5, 12, 2), ("a", "1", "period", 20, 21, 1), ("b", "1", "period", 5, 9, 1)]


def test_merge_of_an_empty_table(spark):
    assert merge_spans(spark.createDataFrame([], SCHEMA), ["e", "q"], "s", "t").collect() == []


def test_span_ms(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 1.5), (-3.0, 0.5, 0.0), (5.0, 5.0, None), (None, 1.0, None), (math.nan, 1.0, None), (90.0, 120.0, 100.0), (1e300, 0.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, d double").select(span_ms(F.col("a"), F.col("b"), F.col("d")).alias("x"))
    got = [None if r.x is None else tuple(r.x) for r in df.collect()]
    assert got[:7] == [(1000, 2000), (1000, 1500), (0, 500), None, None, None, (90000, 100000)]
    assert got[7][0] == 0 and got[7][1] > 10**15


def pairs(spark, *spans):
    return spark.createDataFrame([Row(iv=[Row(start=float(a), end=float(b)) for a, b in spans])], "iv array<struct<start:double,end:double>>")


CASES = [
    ([(10, 15), (1, 3)], 100, [(1, 3), (10, 15)]),
    ([(-5, 3), (90, 120)], 100, [(0, 3), (90, 100)]),
    ([(10, 5)], 100, [(5, 10)]),
    ([(1, 5), (4, 8)], 100, [(1, 8)]),
    ([(10, 15), (15, 20)], 100, [(10, 20)]),
    ([(10, 15), (16, 20)], 100, [(10, 15), (16, 20)]),
    ([(5, 5), (1, 3)], 100, [(1, 3)]),
    ([], 100, []),
]


@pytest.mark.parametrize("spans,duration,want", CASES)
def test_normalize(spark, spans, duration, want):
    got = pairs(spark, *spans).select(iv.normalize(F.col("iv"), F.lit(float(duration))).alias("m")).first().m
    assert [(x.start, x.end) for x in got] == [(float(a), float(b)) for a, b in want]


def test_point_hits_only_in_the_tolerant_reading(spark):
    df = pairs(spark, (1, 9)).withColumn("p", F.array(iv.span(F.lit(5.0), F.lit(5.0))))
    r = df.select(iv.hits(F.col("p"), F.col("iv")).alias("tolerant"), iv.hits_strict(F.col("p"), F.col("iv")).alias("strict")).first()
    assert r.tolerant and not r.strict


def test_set_iou_is_symmetric_and_bounded(spark):
    rnd = random.Random(3)
    rows = [([(a := rnd.random() * 50, a + rnd.random() * 20) for _ in range(3)], [(a := rnd.random() * 50, a + rnd.random() * 20) for _ in range(2)]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<struct<start:double,end:double>>, b array<struct<start:double,end:double>>")
    for r in df.select(iv.set_iou(F.col("a"), F.col("b")).alias("x"), iv.set_iou(F.col("b"), F.col("a")).alias("y"), iv.set_iou(F.col("a"), F.col("a")).alias("z")).collect():
        assert abs(r.x - r.y) < 1e-9 and 0 <= r.x <= 1 and abs(r.z - 1) < 1e-9
