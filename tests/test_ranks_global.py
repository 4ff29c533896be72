"""Places, percentiles and rolling windows against brute force, with a hot group."""

import random

from pyspark.sql import functions as F

from strandline.operators.ranks import percentiles, ranked, rolling


def rows_of(seed, n=3000):
    rnd = random.Random(seed)
    return [(("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])), i, rnd.choice([None, *map(float, range(40))])) for i in range(n)]


def test_places_with_a_hot_group(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(6)
    got = {r.i: r.p for r in ranked(df, ["k"], ["i"], "p").collect()}
    seen = {}
    for k, i, _ in rows:
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1
    whole = {r.i: r.p for r in ranked(df, [], ["i"], "p").collect()}
    assert whole == {i: i for i in range(len(rows))}
    assert ranked(df.limit(0), ["k"], ["i"], "p").collect() == []


def test_percentiles(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "k string, i int, v double")
    want = df.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)") for p in (0.0, 0.5, 0.9, 1.0)]).first()
    got = percentiles(df, "v", {"low": 0.0, "median": 0.5, "p90": 0.9, "high": 1.0}).first()
    assert tuple(got)[1:] == tuple(want) and got.n == sum(v is not None for _, _, v in rows)
    assert tuple(percentiles(df.limit(0), "v", {"median": 0.5}).first()) == (0, None)


def test_rolling_window_over_partition_bounds(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(7)
    got = {r.i: r for r in rolling(df, "k", ["i"], "i", "v", 20).collect()}
    past = {}
    for k, i, v in rows:
        past.setdefault(k, []).append(v)
        mine = sorted(x for x in past[k][-20:] if x is not None)
        r = got[i]
        if not mine:
            assert r.median is None and r.top is None
        else:
            assert r.median == mine[(len(mine) - 1) // 2] and r.top == mine[-1] and abs(r.mean - sum(mine) / len(mine)) < 1e-9
    assert rolling(df.limit(0), "k", ["i"], "i", "v", 20).collect() == []
