"""Ranks of targets beyond any top k."""

import __spark_entry__


def test_ranks_beyond_ten_are_counted(spark, tmp_path):
    # query 0 scores i with row i; the rows of its label are 100 and 30; row 50 is a query of no label
    rows = [(0, "a", [1.0, 0.0]), *((i, "a" if i in (30, 100) else None if i == 50 else "b", [float(i), 0.0]) for i in range(1, 151))]
    rows = [r if r[0] not in (50, 100, 150) else (r[0], r[1], [float(r[0]), 1.0]) for r in rows]
    spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.target: r for r in __spark_entry__.queries()["agg_retrieval_ranks"](spark, str(tmp_path)).collect()}
    # self: 0 ties with row 1 at ranks 150 and 151; 50, 100 and 150 at 101, 51 and 1
    assert (got["self"].n, got["self"].r1, got["self"].r10, got["self"].r100, got["self"].median_rank) == (5, 0.2, 0.2, 0.4, 101.0)
    # label: 0 finds 100 at 51; 100 finds 30 at 120; 150 finds 149 at 1
    assert (got["label"].n, got["label"].r100, got["label"].median_rank) == (3, 0.666666667, 51.0)
