"""Commands as a player would have to accept them, and probe replies of every kind."""

import json

from pyspark.sql import functions as F

from strandline.functions import media as md

SPANS = "array(named_struct('start', 1.0D, 'end', 2.5D), named_struct('start', 4.0D, 'end', 5.0D))"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_freeze_maps_the_last_overlay_and_silences_within_the_graph(spark):
    iv = F.expr(SPANS)
    args = one(spark, md.freeze_command(F.lit("a.mp4"), F.lit("b.mp4"), iv, F.array(F.lit("0.png"), F.lit("1.png")), F.lit(True), F.lit(False)))
    graph = args[args.index("-filter_complex") + 1]
    assert graph == "[0:v][1:v]overlay=x=0:y=0:shortest=1:enable='between(t,1,2.5)'[v1];[v1][2:v]overlay=x=0:y=0:shortest=1:enable='between(t,4,5)'[v2];[0:a]volume=volume=0:enable='between(t,1,2.5)+between(t,4,5)'[aout]"
    assert "-af" not in args and [args[i + 1] for i, a in enumerate(args) if a == "-map"] == ["[v2]", "[aout]"] and args[-1] == "b.mp4"
    kept = one(spark, md.freeze_command(F.lit("a.mp4"), F.lit("b.mp4"), iv, F.array(F.lit("0.png"), F.lit("1.png")), F.lit(True), F.lit(True)))
    assert kept[kept.index("-c:a") + 1] == "copy" and "aout" not in " ".join(kept)


def test_noise_weighs_the_picture_by_alpha(spark):
    graph = one(spark, md.noise_graph(F.expr(SPANS), F.lit(0.05), F.lit(640), F.lit(360), F.lit("25")))
    assert graph.startswith("color=size=640x360:rate=25:color=gray,") and "[0:v][noise]blend=all_mode='normal':all_opacity=0.05:" in graph
    assert [one(spark, md.level(F.lit(a))) for a in (0.0, 1.0, 0.3, 0.0001)] == ["0.0", "1.0", "0.3", "0.0001"]
    assert one(spark, md.blur_filter(F.expr(SPANS), F.lit(1.0))) is None


def test_encoders(spark):
    gpu = one(spark, md.blackout_command(F.lit("a"), F.lit("b"), F.expr(SPANS), F.lit(False), md.Encoder(gpu=True)))
    assert gpu[gpu.index("-c:v") :] == ["-c:v", "h264_nvenc", "-preset", "p5", "-tune", "hq", "-rc", "vbr", "-cq", "19", "-b:v", "0", "-pix_fmt", "yuv420p", "-an", "-movflags", "+faststart", "b"]


def test_probe_replies(spark):
    video = {"codec_type": "video", "width": 640, "height": 360, "r_frame_rate": "30000/1001"}
    replies = [
        json.dumps({"streams": [{"codec_type": "audio"}, video], "format": {"duration": "12.5"}}), json.dumps({"streams": [{"codec_type": "audio"}], "format": {}}), "{cut", None,
        json.dumps({"streams": [video | {"r_frame_rate": "0/0"}], "format": {"duration": "N/A"}}), json.dumps({"streams": [video]}), "[]", "{}",
    ]
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, t string").select("i", md.probe(F.col("t")).alias("p"), md.probe_verdict(md.probe(F.col("t")), F.lit(20.0)).alias("v")).orderBy("i").collect()
    assert [r.p.error for r in rows] == [None, "no video stream", "not JSON", "not JSON", None, None, "no video stream", "no video stream"]
    assert [r.v for r in rows] == ["duration_mismatch", "corrupt", "corrupt", "corrupt", "ok", "duration_mismatch", "corrupt", "corrupt"]
    assert rows[0].p.audio and rows[0].p.width == 640 and abs(rows[0].p.fps - 29.97003) < 1e-5 and not rows[4].p.audio and rows[4].p.fps is None and rows[4].p.duration is None and rows[5].p.duration == 0
