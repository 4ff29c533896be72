"""Readers on good, odd and broken files; calls; streams; joins by range; nearest vectors."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.range_join import overlapping, points_in_intervals
from strandline.operators.runner import call, distinct_call
from strandline.operators.vectors import top_matches
from strandline.sources import readers, writers
from strandline.streaming import flows


def put(tmp_path, text, name="f.json"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_json_array_needs_an_array(spark, tmp_path):
    assert [r.a for r in readers.json_array(spark, put(tmp_path, '[{"a": 1},\n {"a": 2}]'), "a int").collect()] == [1, 2]
    with pytest.raises(readers.BadSource):
        readers.json_array(spark, put(tmp_path, '{"a": 1}', "g.json"), "a int")


@pytest.mark.parametrize("text,want", [('[{"a": 1}]', [1]), ('{"a": 1}\n{"a": 2}\n', [1, 2]), ('{"results": [{"a": 3}]}', [3]), ('{"a": 4}', [4]), ("", []), (" \n", [])])
def test_json_or_jsonl(spark, tmp_path, text, want):
    assert sorted(r.a for r in readers.json_or_jsonl(spark, put(tmp_path, text), "a int").collect()) == want


def test_tolerant_lines_keep_the_last(spark, tmp_path):
    path = put(tmp_path, '{"k": "a", "n": 1}\nbroken\n{"k": "a", "n": 2}\n{"n": 3}\n{"k": "b", "n": 1}\n')
    rows, skipped = readers.jsonl_tolerant(spark, path, "k string, n int", ["k"], "n")
    assert sorted((r.k, r.n) for r in rows.collect()) == [("a", 2), ("b", 1)] and len(skipped.collect()) == 2


def test_required_columns(spark, tmp_path):
    path = put(tmp_path, 'a,b\n"x, y",2\n', "f.csv")
    assert [tuple(r) for r in readers.csv_required(spark, path, ["a"]).collect()] == [("x, y", "2")]
    with pytest.raises(readers.BadSource):
        readers.csv_required(spark, path, ["c"])


def test_json_array_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "é\n"), (1, None)], "a int, b string")
    writers.json_array(df, str(tmp_path / "o"), ["a"])
    assert [tuple(r) for r in readers.json_array(spark, str(tmp_path / "o"), "a int, b string").orderBy("a").collect()] == [(1, None), (2, "é\n")]


def test_calls_keep_errors_as_rows(spark):
    def make():
        def client(p):
            if p == "bad":
                raise ValueError("no")
            return (p or "").upper()

        return client

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, p string")
    assert sorted(tuple(r) for r in call(df, "id", "p", make).collect()) == [(1, "ok", "A", 1), (2, "error", "ValueError: no", 1), (3, "ok", "", 1)]
    again = call(df, "id", "p", make, attempts=3, sleep=lambda s: None)
    assert sorted(tuple(r) for r in again.collect()) == [(1, "ok", "A", 1), (2, "error", "ValueError: no", 3), (3, "ok", "", 1)]
    twice = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, p string")
    assert sorted((r.id, r.out) for r in distinct_call(twice, "p", make, "out").collect()) == [(1, "A"), (2, "A"), (3, None)]


def test_range_joins_equal_brute_force(spark):
    rnd = random.Random(2)
    iv = [(rnd.choice("ab"), i, (s := rnd.random() * 100), s + rnd.random() * 30 - 2) for i in range(60)]
    pt = [(rnd.choice("ab"), i, rnd.random() * 120) for i in range(80)]
    a = spark.createDataFrame(iv, "k string, i int, s double, e double")
    p = spark.createDataFrame(pt, "k string, j int, t double")
    got = points_in_intervals(p, a, ["k"], "t", "s", "e", 7.0)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for k, i, s, e in iv for m, j, t in pt if k == m and s <= t <= e)
    b = a.select("k", F.col("i").alias("i2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = overlapping(a, b, ["k"], "s", "e", "s2", "e2", 7.0)
    assert sorted((r.i, r.i2) for r in got.collect()) == sorted((x[1], y[1]) for x in iv for y in iv if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[3] >= y[2] and x[2] <= y[3])


def test_top_matches_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [round(rnd.gauss(0, 1), 1) for _ in range(4)]) for i in range(120)] + [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(3)
    good = [r for r in rows[:120]]
    want = []
    for q, v in good[::40]:
        best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in good if i != q)[:5]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(best)]
    got = top_matches(df.where("id % 40 = 0"), df, "id", "vec", 5, block=2)
    assert sorted((r.query_id, r.id, r.place) for r in got.collect()) == sorted(want)
    assert top_matches(df.where("id < 0"), df.where("id < 0"), "id", "vec", 5).collect() == []


def test_work_log_does_each_task_once(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "k int").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    for run in range(2):
        tasks = flows.table_stream(spark, str(tmp_path), "t", "k int")
        flows.work_log(tasks, ["k"], str(tmp_path / "log"), str(tmp_path / f"s{run}"), lambda t: t.withColumn("done", F.lit(True))).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2]


def test_keys_are_validated_against_a_template(spark):
    import pytest

    from strandline.sources import readers

    rows = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"b": 2, "c": 3}',)], "t string")
    got = {(r.field, r.kind): r.n_records for r in readers.key_differences(rows, "t", ["a", "b"]).collect()}
    assert got == {("a", "missing"): 1, ("c", "extra"): 1}
    with pytest.raises(readers.BadSource, match="extra c in 1 records; missing a in 1 records"):
        readers.validate_keys(rows, "t", ["a", "b"])
    readers.validate_keys(rows.limit(0), "t", ["a", "b"])
    readers.validate_keys(rows.limit(1), "t", ["b", "a"])


def test_a_long_array_is_one_file_in_order(spark):
    from strandline.session import fresh_dir
    from strandline.sources import readers, writers

    path = fresh_dir(spark, "array")
    writers.json_array(spark.range(5000).selectExpr("id", "'é' AS t").repartition(7), path, ["id"])
    assert [r.id for r in readers.json_array(spark, path, "id bigint, t string").collect()] == list(range(5000))
    empty = fresh_dir(spark, "array")
    writers.json_array(spark.range(0), empty, ["id"])
    assert readers.json_array(spark, empty, "id bigint").collect() == []


def test_failing_calls_are_tried_again():
    from strandline.operators.runner import delay

    assert [delay(k) for k in range(1, 7)] == [2, 4, 8, 16, 30, 30]
