"""The store keeps one copy of each message, whatever comes in whatever batch."""

import random

from pyspark.sql import functions as F

from strandline.operators.message_store import ID, MessageStore, message_id, surplus
from strandline.session import fresh_dir

SCHEMA = "a string, b string, row_id bigint, at bigint, part string, extra string"


def frame(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return df.select(*message_id(F.col("a"), F.col("b")), "row_id", "at", "part", "extra")


def best(rows):
    kept = {}
    for a, b, i, t, _ in rows:
        k = (t is not None, t or 0, i)
        if (a, b) not in kept or k > kept[a, b][0]:
            kept[a, b] = (k, i)
    return sorted(x[1] for x in kept.values())


def test_batches_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), rnd.choice(["1", "2", None]), i, rnd.choice([None, 1, 2, 3]), rnd.choice(["p1", "p2", None])) for i in range(400)]
    store = MessageStore(spark, fresh_dir(spark, "t"), ["at", "row_id"], bucket_rows=2, deltas=1)
    for k in range(3):
        store.merge(frame(spark, rows[k::3]))
        want = best([r for j in range(k + 1) for r in rows[j::3]])
        assert sorted(r.row_id for r in store.winners(frame(spark, rows)).collect()) == want
    lost = surplus(frame(spark, rows), store.winners(frame(spark, rows)), "row_id")
    assert sorted(r.row_id for r in lost.collect()) == sorted(set(range(400)) - set(best(rows)))


def test_only_affected_partitions_are_overwritten(spark):
    store = MessageStore(spark, fresh_dir(spark, "t"), ["at", "row_id"])
    store.merge(frame(spark, [("a", "1", 1, 1, "p1"), ("b", "1", 2, 1, "p2")]))
    before = store.manifest()
    touched = store.merge(frame(spark, [("a", "1", 3, 2, "p9")]))  # a later copy that names another partition
    after = store.manifest()
    assert touched == ["p1"] and after["rows"]["p2"] == before["rows"]["p2"] and after["rows"]["p1"] != before["rows"]["p1"]
    assert sorted(r.row_id for r in store.winners(frame(spark, [])).collect()) == [2, 3]


def test_only_the_buckets_of_the_batch_are_read_and_none_is_rewritten(spark):
    store = MessageStore(spark, fresh_dir(spark, "t"), ["at", "row_id"], bucket_rows=20, deltas=3)
    store.merge(frame(spark, [(f"m{i}", "1", i, 1, "p") for i in range(100)]))
    before = store.manifest()
    assert before["buckets"] == 8 and before["messages"] == 100
    batch = frame(spark, [("m5", "1", 500, 2, "q"), ("new", "1", 501, 1, "q")])
    asked = {int(r.id_a) % 8 for r in batch.select("id_a").collect()}
    read, index = [], store._index
    store._index = lambda m, b: read.extend(b) or index(m, b)
    store.merge(batch)
    after = store.manifest()
    assert set(read) == asked and sum(len(g) for g in after["index"].values()) == sum(len(g) for g in before["index"].values()) + 1
    assert {b: g for b, g in after["index"].items() if int(b) not in asked} == {b: g for b, g in before["index"].items() if int(b) not in asked}
    for k in range(6):  # generations of a bucket are put together again
        store.merge(frame(spark, [(f"n{k}", "1", 600 + k, 1, "q")]))
    assert max(map(len, store.manifest()["index"].values())) <= 4
    assert sorted(r.row_id for r in store.winners(batch).collect()) == sorted({*range(100), 500, 501, *range(600, 606)} - {5})


def test_two_merges_at_once_lose_nothing(spark):
    path = fresh_dir(spark, "t")
    one, two = (MessageStore(spark, path, ["at", "row_id"]) for _ in range(2))
    one.merge(frame(spark, [("a", "1", 1, 1, "p")]))
    first, calls = one.manifest, []

    def overtaken(*version):
        seen = first(*version)
        if not calls:
            calls.append(two.merge(frame(spark, [("a", "1", 2, 2, "p"), ("b", "1", 3, 1, "p")])))
        return seen

    one.manifest = overtaken
    one.merge(frame(spark, [("b", "1", 4, 5, "p"), ("c", "1", 5, 1, "p")]))
    assert sorted(r.row_id for r in two.winners(frame(spark, [])).collect()) == [2, 4, 5] and two.manifest()["version"] == 3


def test_vacuum_leaves_the_last_state(spark):
    store = MessageStore(spark, fresh_dir(spark, "t"), ["at", "row_id"])
    for k in range(3):
        store.merge(frame(spark, [("a", "1", k, k, "p"), (f"b{k}", "1", 10 + k, 1, "q")]))
    gone = store.vacuum()
    assert [g for g in gone if g.startswith("manifest")] == ["manifest-1", "manifest-2"] and sum(g.startswith("rows/") for g in gone) == 2
    assert sorted(r.row_id for r in store.winners(frame(spark, [])).collect()) == [2, 10, 11, 12] and store.vacuum() == []


def test_repeated_rows_and_empty_batches(spark):
    rows = [("a", "1", 5, 1, "p")] * 3 + [("b", "1", 6, 1, "p")]
    store = MessageStore(spark, fresh_dir(spark, "t"), ["at", "row_id"])
    store.merge(frame(spark, []))
    store.merge(frame(spark, rows))
    store.merge(frame(spark, []))
    assert sorted(r.row_id for r in store.winners(frame(spark, rows)).collect()) == [5, 6]
    assert [r.row_id for r in surplus(frame(spark, rows), store.winners(frame(spark, rows)), "row_id").collect()] == [5, 5]


def test_null_is_no_value(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), (None, "x")], "a string, b string").select(*message_id(F.col("a"), F.col("b")))
    assert df.distinct().count() == 3 and df.columns == ID
