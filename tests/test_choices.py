"""Wrong choices drawn from other answers."""

import __spark_entry__
from strandline.plans.questions import negative_choices


def test_every_question_gets_other_answers_of_its_type(spark):
    rows = [(i, "many", f"m{i % 9}") for i in range(300)] + [(300 + i, "few", f"f{i % 3}") for i in range(9)] + [(400, None, "n"), (401, "many", None), (402, "few", "m1")]
    df = spark.createDataFrame(rows, "row_id bigint, kind string, answer string")
    got = {r.row_id: r for r in negative_choices(df, 100, 7).collect()}
    assert sorted(got) == [r[0] for r in rows if r[2] is not None]
    for i, kind, answer in rows:
        if answer is not None:
            r = got[i]
            assert len(r.choices) == len(set(r.choices)) == 5 and r.choices[r.answer_id] == answer
            assert kind != "many" or all(c[0] == "m" for c in r.choices)
    assert {c for i in range(300) for c in got[i].choices} == {f"m{i}" for i in range(9)}
    assert any(c[0] in "mn" for i in range(300, 309) for c in got[i].choices)
    assert len({r.answer_id for r in got.values()}) == 5
    some = {r.row_id: r for r in negative_choices(df.repartition(5), 30, 7).collect()}
    assert 40 < len(some) < 160 and all(got[i] == r for i, r in some.items())


def test_registered_query(spark):
    rows = __spark_entry__.queries()["smp_neg_choices"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(len(set(r.choices)) == len(r.choices) == 5 for r in rows)


def test_fewer_answers_than_choices(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "a")], "row_id bigint, kind string, answer string")
    assert [(r.choices, r.answer_id) for r in negative_choices(df, 100, 0).collect()] == [(["a"], 0)] * 2
