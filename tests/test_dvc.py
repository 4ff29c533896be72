"""Spans of replies at several thresholds, failed replies included."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.plans import joins


def test_failed_replies_and_earlier_samples_of_a_video(spark, monkeypatch):
    span = lambda a, b: [{"start": a, "end": b}]
    rows = [(1, "v1", span(0.0, 10.0), span(50.0, 60.0)), (2, "v1", span(0.0, 10.0), span(0.0, 4.0)), (3, "v1", span(0.0, 10.0), []), (4, "v2", span(0.0, 10.0), span(0.0, 10.0)), (5, "v3", [], span(0.0, 1.0))]
    spans = "array<struct<start:double,end:double>>"
    df = spark.createDataFrame([(i, v, json.dumps(g), json.dumps(p)) for i, v, g, p in rows], "row_id bigint, video_id string, g string, p string")
    df = df.select("row_id", "video_id", F.from_json("g", spans).alias("evidence_intervals"), F.from_json("p", spans).alias("pred"))
    monkeypatch.setattr(joins, "with_hits", lambda s, d: df)
    got = {r.iou: r for r in joins.agg_dvc(spark, "").collect()}
    assert sorted(got) == [0.1, 0.3, 0.5, 0.7]
    assert all((r.total, r.failed, r.videos) == (4, 1, 2) for r in got.values())
    assert [(got[t].precision, got[t].recall, got[t].f1) for t in (0.1, 0.3, 0.5, 0.7)] == [(0.5, 0.5, 0.5)] * 2 + [(0.25, 0.25, 0.25)] * 2
    assert got[0.1].mean_f1 == pytest.approx(0.375)
