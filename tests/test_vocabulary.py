"""Vocabularies of the reference's size."""

import __spark_entry__


def test_answers_beyond_the_twentieth_are_in_the_vocabulary(spark, tmp_path):
    rows = [(i, "v1", str(i), "q", f"answer {i % 30}", "x", "answer 29", "b", "c", "d", "e") for i in range(60)]
    spark.createDataFrame(rows, "row_id bigint, video_id string, qid string, question string, answer string, type string, a0 string, a1 string, a2 string, a3 string, a4 string").write.parquet(f"{tmp_path}/test.parquet")
    q = __spark_entry__.queries()
    assert [r.id for r in q["agg_vocab_topk"](spark, str(tmp_path)).orderBy("id").collect()] == list(range(30))
    assert q["join_isin_vocab"](spark, str(tmp_path)).count() == 60
    items = {r.row_id: r for r in q["proj_qa_item"](spark, str(tmp_path)).collect()}
    assert items[59].vocab_id == 29 and items[59].choice_id == 0 and items[0].choice_id == -1
