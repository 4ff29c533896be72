"""Free text, vectors and numbers: spans in replies, prompts, schedules, similarity, rolling meters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import sampling as sm
from strandline.functions import text as tx
from strandline.functions import times as tm
from strandline.operators.ranks import rolling
from strandline.operators.vectors import target_ranks, top_matches
from strandline.plans.anchors import ANCHORS_SQL, anchors
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_result").select("row_id", "model_response", "answer", "choices")


@R.add("fn_number_pairs", r"""WITH n AS (SELECT row_id, list_transform(regexp_extract_all(model_response, '\d+(?:\.\d+)?'), lambda x: TRY_CAST(x AS DOUBLE)) AS n FROM eval_result WHERE model_response IS NOT NULL),
p AS (SELECT row_id, unnest(range(0, len(n) // 2)) AS i, n FROM n) SELECT row_id, i, n[2 * i + 1] AS start_s, n[2 * i + 2] AS end_s FROM p""")
def fn_number_pairs(spark, sf_dir):
    rows = replies(spark, sf_dir).select("row_id", F.posexplode(tx.number_pairs(F.col("model_response"))).alias("i", "p"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


@R.add("fn_tvg_format")
def fn_tvg_format(spark, sf_dir):
    """Spans in whole documents by the first reading that gives any."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tm.spans_in_text(F.col("text"))).alias("i", "p"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("i"), F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


@R.add("fn_extract_time_part")
def fn_extract_time_part(spark, sf_dir):
    """One span per line of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.select("doc_id", F.col("i").cast("bigint").alias("i"), tm.time_part(F.col("line")).alias("p")).where("p IS NOT NULL")
    return rows.select("doc_id", "i", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


@R.add("fn_ms_to_s", "SELECT event_id, event_id / 1000.0 AS seconds FROM events")
def fn_ms_to_s(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 1000.0).cast("double").alias("seconds"))


@R.add("fn_parse_ts", r"WITH t AS (SELECT row_id, round(x.start, 2) || '-' || round(x.\"end\", 2) AS ts FROM (SELECT row_id, evidence_intervals[1] AS x FROM cgbench_filtered) WHERE x.start IS NOT NULL AND x.\"end\" IS NOT NULL AND x.start >= 0) SELECT row_id, CAST(floor(CAST(split_part(ts, '-', 1) AS DOUBLE) / 60) AS BIGINT) AS clip, CAST(split_part(ts, '-', 2) AS DOUBLE) AS end_s FROM t WHERE split_part(ts, '-', 2) <> ''".replace('\\"', '"'))
def fn_parse_ts(spark, sf_dir):
    """``a-b`` into the clip of 60 s it starts in and its end."""
    x = F.get("evidence_intervals", F.lit(0))
    rows = table(spark, sf_dir, "cgbench_filtered").select("row_id", x.alias("x")).where("x.start IS NOT NULL AND x.end IS NOT NULL AND x.start >= 0")
    ts = F.concat_ws("-", F.round("x.start", 2).cast("string"), F.round("x.end", 2).cast("string"))
    rows = rows.select("row_id", F.split_part(ts, F.lit("-"), F.lit(1)).alias("a"), F.split_part(ts, F.lit("-"), F.lit(2)).alias("b")).where("b <> ''")
    return rows.select("row_id", F.floor(F.col("a").cast("double") / 60).cast("bigint").alias("clip"), F.col("b").cast("double").alias("end_s"))


@R.add("fn_fmt_g", f"WITH {ANCHORS_SQL}, x AS (SELECT row_id, unnest([d, d * 1000, d / 1e7, -d, d * 1e6]) AS x, unnest(range(5)) AS i FROM anchors WHERE d IS NOT NULL) SELECT row_id, i, format('{{:g}}', x) AS text FROM x")
def fn_fmt_g(spark, sf_dir):
    """Durations in short form, at sizes for which the form changes."""
    d = F.col("d")
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", F.posexplode(F.array(d, d * 1000, d / 1e7, -d, d * 1e6)).alias("i", "x"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), tx.short_number(F.col("x")).alias("text"))


@R.add("fn_parse_alphas", "SELECT row_id, unnest([alpha, 0.05, alpha]) AS alpha FROM eval_result WHERE alpha IS NOT NULL")
def fn_parse_alphas(spark, sf_dir):
    """A comma list of levels, from each row's own; blanks are skipped."""
    text = F.concat(F.lit(" "), F.col("alpha").cast("string"), F.lit(", 0.05,, "), F.col("alpha").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "eval_result").where("alpha IS NOT NULL").select("row_id", F.explode(tx.level_list(text)).alias("alpha"))


@R.add("fn_str2bool", "SELECT row_id, list_contains(['yes', 'True', '1', ' T '], w) AS value FROM (SELECT row_id, ['yes', 'True', '1', 'no', 'F', '0', ' T '][row_id % 7 + 1] AS w FROM test)")
def fn_str2bool(spark, sf_dir):
    words = F.array(*map(F.lit, ("yes", "True", "1", "no", "F", "0", " T ")))
    return table(spark, sf_dir, "test").select("row_id", tx.strict_boolean(F.get(words, (F.col("row_id") % 7).cast("int"))).alias("value"))


@R.add("fn_parse_fps", "SELECT row_id, CASE WHEN fps > 0 THEN fps END AS fps, 30000 / 1001.0 AS ntsc FROM gsub_test")
def fn_parse_fps(spark, sf_dir):
    """Frame rates from text, whole or as a fraction; 0 in the denominator gives null."""
    text = F.when(F.col("fps") > 0, F.col("fps").cast("string"))
    return table(spark, sf_dir, "gsub_test").select("row_id", tx.frame_rate(text).alias("fps"), tx.frame_rate(F.lit("30000/1001")).alias("ntsc"))


@R.add("fn_freeze_ts", f"WITH {ANCHORS_SQL}, f AS (SELECT row_id, unnest(gold) AS g FROM anchors) SELECT row_id, greatest(0, g.start) AS first_s, greatest(0, g.start - 1 / 30.0) AS pre_s FROM f")
def fn_freeze_ts(spark, sf_dir):
    """The frame at a span's start and the one before it, at 30 frames a second."""
    rows = anchors(spark, sf_dir).select("row_id", F.explode("gold").alias("g"))
    return rows.select("row_id", F.greatest(F.lit(0.0), F.col("g.start")).alias("first_s"), F.greatest(F.lit(0.0), F.col("g.start") - 1 / 30.0).alias("pre_s"))


@R.add("fn_get_mask", f"WITH {ANCHORS_SQL} SELECT row_id, list_sum(list_transform(range(8), lambda i: CASE WHEN i < len(gold) THEN 1 ELSE 0 END))::BIGINT AS ones FROM anchors")
def fn_get_mask(spark, sf_dir):
    m = sm.mask(F.size("gold"), F.lit(8))
    return anchors(spark, sf_dir).select("row_id", F.aggregate(m, F.lit(0), lambda a, x: a + x).cast("bigint").alias("ones"))


@R.add("fn_gauss_weight", f"WITH {ANCHORS_SQL}, w AS (SELECT row_id, (greatest(1.0 / evidence_count, 0.01) / 9.0) AS s FROM anchors WHERE evidence_count > 0), x AS (SELECT row_id, i, exp(-power(i / 31.0 - 0.5, 2) / (2 * s * s)) AS y FROM w, range(32) r(i)) SELECT row_id, i, round(y / max(y) OVER (PARTITION BY row_id), 9) AS weight FROM x")
def fn_gauss_weight(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("evidence_count > 0").select("row_id", F.posexplode(sm.gauss_weights(F.lit(0.5), 1.0 / F.col("evidence_count"), F.lit(32))).alias("i", "w"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.round("w", 9).alias("weight"))


@R.add("fn_lr_schedule", "SELECT i AS step, round(CASE WHEN i < 100 THEN 1e-3 * i / 100 ELSE 1e-3 * greatest(0, (1000 - i) / 900.0) END, 12) AS rate FROM range(1001) r(i)")
def fn_lr_schedule(spark, sf_dir):
    """Linear warm-up over 100 of 1,000 steps, then linear decay."""
    i = F.col("id")
    return spark.range(1001).select(i.alias("step"), F.round(F.when(i < 100, 1e-3 * i / 100).otherwise(1e-3 * F.greatest(F.lit(0.0), (1000 - i) / 900.0)), 12).alias("rate"))


@R.add("fn_feature_mapping", "SELECT row_id, video_id, CASE WHEN source_dataset = 'cgbench' THEN substr(video_id, 1, 11) ELSE video_id END AS feature FROM cgbench_filtered")
def fn_feature_mapping(spark, sf_dir):
    t = table(spark, sf_dir, "cgbench_filtered")
    return t.select("row_id", "video_id", F.when(F.col("source_dataset") == "cgbench", F.substring("video_id", 1, 11)).otherwise(F.col("video_id")).alias("feature"))


@R.add("fn_video_id_from_path", "SELECT row_id, 'video_' || regexp_replace(file_name, '\\.[^.]*$', '') AS video_id FROM test_raw")
def fn_video_id_from_path(spark, sf_dir):
    return table(spark, sf_dir, "test_raw").select("row_id", F.concat(F.lit("video_"), tx.stem(F.concat(F.lit("dir/"), "file_name"))).alias("video_id"))


@R.add("fn_extract_description", r"SELECT doc_id, regexp_extract(text, '“([^”]+)”', 1) AS quoted FROM documents WHERE text IS NOT NULL")
def fn_extract_description(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract("text", "“([^”]+)”", 1).alias("quoted"))


@R.add("fn_image_b64", "SELECT row_id, 'data:image/jpeg;base64,' || base64(encode(file_name)) AS url FROM test_raw")
def fn_image_b64(spark, sf_dir):
    return table(spark, sf_dir, "test_raw").select("row_id", F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.encode("file_name", "UTF-8"))).alias("url"))


@R.add("iv_bbox_norm", "SELECT p_partkey, round(10.0 / (p_size + 100), 9) AS x1, round((10.0 + p_size) / (p_size + 100), 9) AS x2, round(p_size * 20.0 / ((p_size + 100) * 50.0), 9) AS area FROM part")
def iv_bbox_norm(spark, sf_dir):
    s = F.col("p_size")
    box = iv.box_relative(F.lit(10.0), F.lit(5.0), 10.0 + s, F.lit(25.0), s + 100, F.lit(50.0))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", F.round(F.get("b", F.lit(0)), 9).alias("x1"), F.round(F.get("b", F.lit(2)), 9).alias("x2"), F.round(F.get("b", F.lit(4)), 9).alias("area"))


# vectors


@R.add("fn_dot_sim", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS sim FROM embeddings v, q")
def fn_dot_sim(spark, sf_dir):
    """Dot product of every vector with the first one (one row, broadcast)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.join(F.broadcast(q)).select("vec_id", F.round(dot, 6).alias("sim"))


NEAR_SQL = """WITH s AS (SELECT q.vec_id AS query_vec_id, q.label AS q_label, v.vec_id, v.label, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS place FROM s)"""


def near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    e = table(spark, sf_dir, "embeddings")
    return top_matches(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", k)


@R.add("agg_retrieval", f"{NEAR_SQL} SELECT query_vec_id, vec_id, round(score, 6) AS score, place FROM r WHERE place <= 10")
def agg_retrieval(spark, sf_dir):
    return near(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@R.add("agg_recall_at_k", f"{NEAR_SQL}, h AS (SELECT query_vec_id, min(place) FILTER (label = q_label) AS first FROM r WHERE place <= 10 GROUP BY ALL) SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 9) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 9) AS r5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 9) AS r10 FROM h")
def agg_recall_at_k(spark, sf_dir):
    """Share of queries with a row of their label among the best 1, 5 and 10."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = near(spark, sf_dir, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_vec_id"), F.col("label").alias("q_label")), "query_vec_id")
    h = rows.groupBy("query_vec_id").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("place"))).alias("first"))
    return h.agg(*[F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 9).alias(f"r{k}") for k in (1, 5, 10)])


@R.add("agg_retrieval_ranks")
def agg_retrieval_ranks(spark, sf_dir):
    """R1, R10, R100 and the median rank of the queries' targets (see ``target_ranks``) among all rows. As in the
    reference, a target that scores the same as other rows takes every rank that they share."""
    e = table(spark, sf_dir, "embeddings")
    ranks = target_ranks(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label")
    ranks = ranks.select("target", F.explode(F.sequence(F.col("n_above") + 1, F.col("n_above") + F.col("n_ties"))).alias("place"))
    recall = [F.round(F.avg((F.col("place") <= k).cast("double")), 9).alias(f"r{k}") for k in (1, 10, 100)]
    return ranks.groupBy("target").agg(F.count(F.lit(1)).alias("n"), *recall, F.percentile("place", 0.5).alias("median_rank"))


@R.add("win_argmax_first", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def win_argmax_first(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("at"))


@R.add("smp_stride_pad", "SELECT vec_id, j, embedding[(j * len(embedding)) // 24 + 1] AS value FROM embeddings, range(24) r(j)")
def smp_stride_pad(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sm.stride_pad(F.col("embedding"), F.lit(24), F.lit(0.0).cast("float"))).alias("j", "value"))
    return rows.select("vec_id", F.col("j").cast("bigint").alias("j"), "value")


@R.add("smp_linspace_feats", "SELECT vec_id, i, embedding[CAST(trunc(i * (len(embedding) - 1) / 15) AS INT) + 1] AS value FROM embeddings, range(16) r(i)")
def smp_linspace_feats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode(sm.line_positions(F.size("embedding"), F.lit(16))).alias("i", "p"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.get("embedding", F.col("p")).alias("value"))


@R.add("smp_clip_slice", "SELECT vec_id, len(embedding[11:21]) AS n, round(list_sum(CAST(embedding[11:21] AS DOUBLE[])), 6) AS total FROM embeddings")
def smp_clip_slice(spark, sf_dir):
    part = sm.clip_slice(F.col("embedding"), F.lit(10), F.lit(20))
    return table(spark, sf_dir, "embeddings").select("vec_id", part.alias("p")).select("vec_id", F.size("p").cast("bigint").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@R.add("scan_h5_npy", "SELECT label, count(*) AS n, min(len(embedding)) AS size, round(avg(embedding[1]), 6) AS first FROM embeddings GROUP BY ALL")
def scan_h5_npy(spark, sf_dir):
    """Features as arrays in Parquet."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("bigint").alias("size"), F.round(F.avg(F.get("embedding", F.lit(0))), 6).alias("first"))


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, att, times): the vector as attention over 64 frames, two seconds apart."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("att"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double") * 2).alias("times"))


for _id, _f in {"iv_find_seg_maxC": tm.best_clip, "iv_find_seg_maxF": tm.best_frame}.items():
    _sql = {
        "iv_find_seg_maxC": """WITH c AS (SELECT vec_id, len(embedding) AS n, list_transform(range(0, (len(embedding) - 1) // 4 + 1), lambda i: list_sum(CAST(embedding[i * 4 + 1:i * 4 + 4] AS DOUBLE[])) / 4) AS m FROM embeddings),
 f AS (SELECT vec_id, n, CASE WHEN list_max(m) > 0 THEN (list_position(m, list_max(m)) - 1) * 4 ELSE 0 END AS a FROM c) SELECT vec_id, 2.0 * a AS start_s, 2.0 * (least(a + 4, n) - 1) AS end_s FROM f""",
        "iv_find_seg_maxF": "SELECT vec_id, 2.0 * (list_position(embedding, list_max(embedding)) - 1) AS start_s, 2.0 * (list_position(embedding, list_max(embedding)) - 1) AS end_s FROM embeddings",
    }.get(_id)

    @R.add(_id, _sql)
    def _segment(spark, sf_dir, f=_f):
        rows = attention(spark, sf_dir).select("vec_id", f(F.col("att"), F.col("times")).alias("m"))
        return rows.select("vec_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("iv_find_seg_ada")
def iv_find_seg_ada(spark, sf_dir):
    """The segment that the scores and their distance to the greatest one hold together."""
    rows = tm.attention_segments(attention(spark, sf_dir), "att", "times", "m")
    return rows.select("vec_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("join_ground_generate")
def join_ground_generate(spark, sf_dir):
    """Segments of the attention joined with the label of the vector."""
    seg = tm.attention_segments(attention(spark, sf_dir), "att", "times", "m")
    return seg.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("smp_seq_blocks", "SELECT vec_id // 16 AS block, count(*) AS n, 16 - count(*) AS padding FROM embeddings GROUP BY ALL")
def smp_seq_blocks(spark, sf_dir):
    """Blocks of 16 that keep their inner order, with what the last one is padded by."""
    g = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("padding", 16 - F.col("n"))


@R.add("win_rolling_median", "WITH w AS (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM events) SELECT event_id, list_sort(v)[(len(v) + 1) // 2] AS median, list_max(v) AS top, round(list_avg(v), 6) AS mean FROM w")
def win_rolling_median(spark, sf_dir):
    """Lower median, maximum and mean of a user's last 20 values; a user's events may lie in many partitions."""
    return rolling(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "value", 20).withColumn("mean", F.round("mean", 6))


@R.add("proj_fallback_key", "SELECT row_id, coalesce(line_text::JSON->>'$.alpha', line_text::JSON->>'$.mask_alpha', line_text::JSON->>'$.meta.alpha', 'UNKNOWN') AS alpha FROM result_lines")
def proj_fallback_key(spark, sf_dir):
    """The first key that has a value."""
    get = lambda p: F.get_json_object("line_text", p)
    return table(spark, sf_dir, "result_lines").select("row_id", F.coalesce(get("$.alpha"), get("$.mask_alpha"), get("$.meta.alpha"), F.lit("UNKNOWN")).alias("alpha"))


#: Names an alpha goes by, and the objects it may stand in; fixed values.
ALPHA_KEYS = ["alpha", "mask_alpha", "evidence_alpha", "perturb_alpha", "perturbation_alpha", "corruption_alpha", "noise_alpha", "partial_alpha"]
ALPHA_HOLDERS = ["metadata", "meta", "config", "perturbation", "ablation"]


@R.add("proj_alpha_key", "WITH p AS (SELECT row_id, line_text::JSON AS j FROM result_lines) SELECT row_id, CASE " + " ".join(f"WHEN json_exists(j, '$.{p}') THEN '{p}'" for p in [*ALPHA_KEYS, *[f"{h}.{k}" for h in ALPHA_HOLDERS for k in ALPHA_KEYS]]) + " ELSE 'UNKNOWN' END AS path FROM p")
def proj_alpha_key(spark, sf_dir):
    """Where a record has its alpha: the first known name that exists, null or not, on top or in a known object."""
    rows = table(spark, sf_dir, "result_lines").select("row_id", F.try_parse_json("line_text").alias("v"))
    out = F.lit("UNKNOWN")
    for p in reversed([*ALPHA_KEYS, *[f"{h}.{k}" for h in ALPHA_HOLDERS for k in ALPHA_KEYS]]):
        out = F.when(F.try_variant_get("v", f"$.{p}", "variant").isNotNull(), p).otherwise(out)
    return rows.select("row_id", out.alias("path"))
