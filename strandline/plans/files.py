"""Readers, writers, media plans, external calls and streams, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import media as md
from strandline.functions import sampling as sm
from strandline.operators import runner
from strandline.plans.anchors import ANCHORS_SQL, anchors
from strandline.plans.registry import Registry
from strandline.session import fresh_dir, table
from strandline.sources import readers, writers
from strandline.streaming import flows

R = Registry()

RESULT = "row_id bigint, video_id string, qid string, alpha double"
RESULT_SQL = "SELECT row_id, video_id, qid, alpha FROM eval_result"
KEYED_SQL = "SELECT row_id, video_id, qid, alpha FROM eval_result QUALIFY row_number() OVER (PARTITION BY video_id, qid ORDER BY row_id DESC) = 1"


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """eval_result's keys as JSON lines in the shared folder."""
    path = fresh_dir(spark, "lines")
    writers.jsonl(table(spark, sf_dir, "eval_result").select("row_id", "video_id", "qid", "alpha"), path)
    return path


@R.add("scan_jsonl_strict", RESULT_SQL)
def scan_jsonl_strict(spark, sf_dir):
    return readers.jsonl_strict(spark, written_lines(spark, sf_dir), RESULT)


@R.add("scan_jsonl_tolerant", KEYED_SQL)
def scan_jsonl_tolerant(spark, sf_dir):
    """The last line of each key, bad lines left out."""
    return readers.jsonl_tolerant(spark, written_lines(spark, sf_dir), RESULT, ["video_id", "qid"], "row_id")[0]


@R.add("sink_jsonl_append", "SELECT count(*) * 2 AS n FROM eval_result")
def sink_jsonl_append(spark, sf_dir):
    path = written_lines(spark, sf_dir)
    writers.jsonl(table(spark, sf_dir, "eval_result").select("row_id", "video_id", "qid", "alpha"), path, "append")
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))


PAIRS_SQL = "SELECT DISTINCT video_id, qid FROM test"


def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test").select("video_id", "qid").distinct()


@R.add("sink_json_pretty", PAIRS_SQL)
def sink_json_pretty(spark, sf_dir):
    """The list of distinct keys as one indented array, read again."""
    path = fresh_dir(spark, "array")
    writers.json_array(pair_list(spark, sf_dir), path, ["video_id", "qid"])
    return readers.json_array(spark, path, "video_id string, qid string")


@R.add("io_save", PAIRS_SQL)
def io_save(spark, sf_dir):
    return sink_json_pretty(spark, sf_dir)


@R.add("scan_json_array", PAIRS_SQL)
def scan_json_array(spark, sf_dir):
    return sink_json_pretty(spark, sf_dir)


@R.add("scan_json_or_jsonl", PAIRS_SQL)
def scan_json_or_jsonl(spark, sf_dir):
    path = fresh_dir(spark, "either")
    writers.jsonl(pair_list(spark, sf_dir).coalesce(1), path)
    return readers.json_or_jsonl(spark, path, "video_id string, qid string")


@R.add("scan_json_object", "SELECT DISTINCT n_name AS \"key\", CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def scan_json_object(spark, sf_dir):
    """A map file with data as keys; nation has 25 rows at every scale."""
    path = fresh_dir(spark, "map")
    n = table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string"))))).alias("value"))
    n.write.text(path)
    return readers.json_object(spark, path, "string")


@R.add("scan_url_manifest", "SELECT DISTINCT n_name AS \"key\", CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def scan_url_manifest(spark, sf_dir):
    return scan_json_object(spark, sf_dir)


@R.add("sink_tsv_pairs", PAIRS_SQL)
def sink_tsv_pairs(spark, sf_dir):
    path = fresh_dir(spark, "pairs")
    writers.pairs(pair_list(spark, sf_dir), path, ["video_id", "qid"])
    return readers.csv_named(spark, path, ["video_id", "qid"], "\t")


@R.add("scan_csv_pandas", PAIRS_SQL)
def scan_csv_pandas(spark, sf_dir):
    return sink_tsv_pairs(spark, sf_dir)


CSV_SQL = "SELECT row_id, frame_count, \"type\", a0 FROM test WHERE a0 <> ''"


@R.add("scan_csv_required", CSV_SQL)
def scan_csv_required(spark, sf_dir):
    """Questions written with a header and read with the columns that must be there."""
    path = fresh_dir(spark, "csv")
    writers.csv(table(spark, sf_dir, "test").where("a0 <> ''").select("row_id", "frame_count", "type", "a0"), path)
    rows = readers.csv_required(spark, path, ["row_id", "frame_count", "type", "a0"], inferSchema="false")
    return rows.withColumn("row_id", F.col("row_id").cast("bigint"))


@R.add("sink_csv_df", CSV_SQL)
def sink_csv_df(spark, sf_dir):
    return scan_csv_required(spark, sf_dir)


@R.add("sink_csv_metrics", "SELECT coalesce(evidence_condition, 'UNKNOWN') AS condition, CAST(count(*) AS VARCHAR) AS n FROM eval_result GROUP BY ALL")
def sink_csv_metrics(spark, sf_dir):
    path = fresh_dir(spark, "metrics")
    writers.csv(table(spark, sf_dir, "eval_result").groupBy(F.coalesce("evidence_condition", F.lit("UNKNOWN")).alias("condition")).agg(F.count(F.lit(1)).alias("n")), path)
    return readers.csv_required(spark, path, ["condition", "n"])


@R.add("sink_per_shard", "SELECT row_id % 4 AS shard, count(*) AS n FROM eval_result GROUP BY ALL")
def sink_per_shard(spark, sf_dir):
    path = fresh_dir(spark, "shards")
    writers.per_shard(table(spark, sf_dir, "eval_result").select("row_id", F.pmod("row_id", F.lit(4)).alias("shard")), path, "shard")
    return spark.read.schema("row_id bigint, shard bigint").json(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@R.add("sink_skipped", "SELECT row_id FROM eval_result WHERE model_response IS NULL")
def sink_skipped(spark, sf_dir):
    """The side list of skipped rows, written anew by each run."""
    path = fresh_dir(spark, "skipped")
    for _ in range(2):
        writers.jsonl(table(spark, sf_dir, "eval_result").where("model_response IS NULL").select("row_id"), path, "overwrite")
    return readers.jsonl_strict(spark, path, "row_id bigint")


@R.add("sink_split_outputs", "SELECT row_id, 'qa' AS part FROM eval_result WHERE answer IS NOT NULL UNION ALL SELECT row_id, 'ground' FROM eval_result WHERE sampled_seconds IS NOT NULL")
def sink_split_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "eval_result")
    path = fresh_dir(spark, "split")
    writers.jsonl(rows.where("answer IS NOT NULL").select("row_id"), f"{path}/part=qa")
    writers.jsonl(rows.where("sampled_seconds IS NOT NULL").select("row_id"), f"{path}/part=ground")
    return spark.read.schema("row_id bigint, part string").json(path)


@R.add("scan_multi_file", "SELECT row_id, 'qa' AS part FROM eval_result WHERE answer IS NOT NULL UNION ALL SELECT row_id, 'ground' FROM eval_result WHERE sampled_seconds IS NOT NULL")
def scan_multi_file(spark, sf_dir):
    """All files of several folders as one table."""
    return sink_split_outputs(spark, sf_dir)


@R.add("scan_json_tree", "SELECT row_id % 4 AS shard, count(*) AS n FROM eval_result GROUP BY ALL")
def scan_json_tree(spark, sf_dir):
    path = fresh_dir(spark, "tree")
    writers.per_shard(table(spark, sf_dir, "eval_result").select("row_id", F.pmod("row_id", F.lit(4)).alias("s"), F.pmod("row_id", F.lit(4)).alias("shard")), path, "s")
    rows = spark.read.schema("row_id bigint, shard bigint").option("recursiveFileLookup", True).json(path)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@R.add("scan_text_lines", "SELECT count(*) AS n, sum(length(rtrim(file_name)))::BIGINT AS chars FROM test_raw")
def scan_text_lines(spark, sf_dir):
    path = fresh_dir(spark, "text")
    table(spark, sf_dir, "test_raw").select("file_name").write.text(path)
    return readers.text_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_dir(spark, "files")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("r")).repartition(2).write.partitionBy("r").csv(path)
    return path


@R.add("scan_dir_recursive", "SELECT true AS complete, 5::BIGINT AS n_folders")
def scan_dir_recursive(spark, sf_dir):
    """Folders of a tree as its file index shows them."""
    files = readers.dir_index(spark, file_tree(spark, sf_dir), "*.csv", recursive=True)
    folder = F.regexp_extract("path", r"/r=(\d+)/", 1)
    return files.agg((F.count_if(folder == "") == 0).alias("complete"), F.countDistinct(folder).alias("n_folders"))


@R.add("scan_dir_index", "SELECT true AS complete")
def scan_dir_index(spark, sf_dir):
    path = fresh_dir(spark, "flat")
    table(spark, sf_dir, "nation").repartition(3).write.csv(path)
    return readers.dir_index(spark, path, "*.csv").agg((F.count(F.lit(1)) == F.countDistinct("stem")).alias("complete"))


@R.add("scan_env_literal", "SELECT unnest(['a.mp4', 'b.mp4']) AS name")
def scan_env_literal(spark, sf_dir):
    return spark.createDataFrame([("a.mp4",), ("b.mp4",)], "name string")


@R.add("scan_zip", "SELECT * FROM (VALUES ('x.zip', 1, 1), ('x.zip', 2, 2), ('x.zip', 10, 3), ('y.zip', 1, 1)) t(archive, chunk, place)")
def scan_zip(spark, sf_dir):
    files = spark.createDataFrame([("x.zip.010",), ("x.zip.002",), ("x.zip.001",), ("y.zip.001",)], "name string")
    return readers.zip_plan(files).select("archive", "chunk", "place")


@R.add("sink_summary_text", "WITH c AS (SELECT question_type AS k, count(*) AS n FROM cgbench_filtered GROUP BY ALL) SELECT 'Anchors by type' || chr(10) || string_agg(k || ': ' || n, chr(10) ORDER BY n DESC, k) AS text FROM c")
def sink_summary_text(spark, sf_dir):
    return writers.report(table(spark, sf_dir, "cgbench_filtered").groupBy("question_type").agg(F.count(F.lit(1)).alias("n")), "question_type", "n", "Anchors by type")


@R.add("sink_place_file", "SELECT row_id, CASE WHEN duration IS NULL OR duration <= 0 THEN 'missing' WHEN fps >= 30 THEN 'skip_exists' ELSE 'dry_run' END AS status FROM gsub_test")
def sink_place_file(spark, sf_dir):
    """What placing each file would do."""
    known = F.coalesce(F.col("duration") > 0, F.lit(False))
    status = F.when(~known, "missing").when(F.coalesce(F.col("fps") >= 30, F.lit(False)), "skip_exists").otherwise("dry_run")
    return table(spark, sf_dir, "gsub_test").select("row_id", status.alias("status"))


@R.add("sink_download", "SELECT unnest([2.0, 4.0, 8.0, 16.0, 30.0, 30.0]::DOUBLE[]) AS delay_s")
def sink_download(spark, sf_dir):
    """Waits of a resumed download between its attempts."""
    return spark.range(1).select(F.explode(md.retry_delays(6)).alias("delay_s"))


# calls


def echo():
    """A deterministic stand-in for a client: fails on empty payloads."""

    def client(payload: str | None) -> str | None:
        if not payload:
            raise ValueError("empty payload")
        return f'{{"label": "ANSWERABLE", "answer": "{"ABCDE"[len(payload) % 5]}"}}'

    return client


CALL_SQL = "SELECT row_id, 'ok' AS status, substr('ABCDE', CAST(length(question) % 5 AS INT) + 1, 1) AS answer FROM test WHERE question <> ''"


@R.add("call_external", CALL_SQL)
def call_external(spark, sf_dir):
    """Every question through the stand-in client."""
    made = runner.call(table(spark, sf_dir, "test").where("question <> ''"), "row_id", "question", echo)
    return made.select("row_id", "status", F.get_json_object("reply", "$.answer").alias("answer"))


@R.add("orch_pool", "SELECT row_id, 'ok' AS status, substr('ABCDE', CAST(length(answer) % 5 AS INT) + 1, 1) AS answer FROM test WHERE answer <> '' UNION ALL SELECT row_id, 'error', NULL FROM test WHERE answer = '' OR answer IS NULL")
def orch_pool(spark, sf_dir):
    """Every answer through the stand-in client, 32 at once in each task; failing calls are rows of their own."""
    made = runner.call(table(spark, sf_dir, "test"), "row_id", "answer", echo, at_once=32)
    return made.select("row_id", "status", F.when(F.col("status") == "ok", F.get_json_object("reply", "$.answer")).alias("answer"))


@R.add("orch_process_pool", "SELECT row_id, substr('ABCDE', CAST(length(question) % 5 AS INT) + 1, 1) AS answer FROM test WHERE question <> ''")
def orch_process_pool(spark, sf_dir):
    """Every distinct question once, by as many processes as there are partitions, joined back to its rows."""
    made = runner.distinct_call(table(spark, sf_dir, "test").where("question <> ''"), "question", echo, "reply")
    return made.select("row_id", F.get_json_object("reply", "$.answer").alias("answer"))


def flaky():
    """A deterministic stand-in that fails as often as its payload's length modulo 4 says before it answers."""
    seen: dict[str, int] = {}

    def client(payload: str) -> str:
        number, _, text = payload.partition("|")
        seen[number] = seen.get(number, 0) + 1
        if seen[number] <= len(text) % 4:
            raise TimeoutError(f"attempt {seen[number]}")
        return text

    return client


@R.add("orch_retry", "SELECT row_id, CASE WHEN length(question) % 4 < 3 THEN 'ok' ELSE 'error' END AS status, least(length(question) % 4 + 1, 3) AS attempts, list_sum(list_transform(range(1, least(length(question) % 4 + 1, 3)), lambda k: least(power(2.0, k), 30)))::DOUBLE AS waited_s FROM test WHERE question <> ''")
def orch_retry(spark, sf_dir):
    """Three attempts for each question with growing waits, which the stand-in does not sit out."""
    rows = table(spark, sf_dir, "test").where("question <> ''").withColumn("p", F.concat(F.col("row_id").cast("string"), F.lit("|"), F.regexp_replace("question", r"\|", " ")))
    made = runner.call(rows, "row_id", "p", flaky, attempts=3, sleep=lambda s: None)
    waits = F.aggregate(F.filter(md.retry_delays(3), lambda x, i: i < F.col("attempts") - 1), F.lit(0.0), lambda a, x: a + x)
    return made.select("row_id", "status", F.col("attempts").cast("bigint").alias("attempts"), F.when(F.col("attempts") > 1, waits).alias("waited_s"))


@R.add("call_judge", "SELECT row_id, CASE WHEN length(question) % 5 < 3 THEN length(question) % 5 ELSE 2 END AS step_1, CASE WHEN length(question) % 5 >= 2 THEN CASE WHEN length(answer) % 5 IN (0, 2, 4) THEN 0 ELSE 1 END END AS step_2 FROM test WHERE question <> '' AND answer <> ''")
def call_judge(spark, sf_dir):
    """Two steps: the text step gives 0, 1 or 2, and only what got 2 goes to the second step."""
    rows = table(spark, sf_dir, "test").where("question <> '' AND answer <> ''")
    first = runner.call(rows, "row_id", "question", echo).select("row_id", F.least(F.instr(F.lit("ABCDE"), F.get_json_object("reply", "$.answer")) - 1, F.lit(2)).cast("bigint").alias("step_1"))
    open_ = rows.join(first.where("step_1 = 2").select("row_id"), "row_id", "left_semi")
    second = runner.call(open_, "row_id", "answer", echo).select("row_id", F.when(F.get_json_object("reply", "$.answer").isin("A", "C", "E"), 0).otherwise(1).alias("step_2"))
    return first.join(second, "row_id", "left")


# streams


@R.add("stream_window_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """Hourly counts of a stream in complete form (an extension)."""
    schema = table(spark, sf_dir, "events").schema
    name = "w" + fresh_dir(spark, "x")[-32:]
    counts = flows.window_counts(flows.table_stream(spark, sf_dir, "events", schema), "ts", "event_type", "value")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("total", F.round("total", 4))


@R.add("stream_once", "SELECT count(*) AS n FROM (SELECT DISTINCT run_id, video_id, qid, alpha FROM eval_result)")
def stream_once(spark, sf_dir):
    """Messages of a stream kept once by their raw identifier."""
    schema = table(spark, sf_dir, "eval_result").schema
    stream = flows.table_stream(spark, sf_dir, "eval_result", schema).select("run_id", "video_id", "qid", "alpha", "delivered_at")
    path = fresh_dir(spark, "once")
    flows.drain(flows.once(stream, ["run_id", "video_id", "qid", "alpha"], "delivered_at", late="3650 days"), f"{path}/rows", f"{path}/state")
    return spark.read.schema("run_id string, video_id string, qid string, alpha double").parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n"))


@R.add("stream_work_log", "SELECT count(*) AS n FROM (SELECT DISTINCT video_id, qid FROM test)")
def stream_work_log(spark, sf_dir):
    """A resumable log: the same tasks twice are worked on once."""
    schema = table(spark, sf_dir, "test").schema
    path = fresh_dir(spark, "log")
    for k in range(2):
        tasks = flows.table_stream(spark, sf_dir, "test", schema).select("video_id", "qid")
        flows.work_log(tasks, ["video_id", "qid"], f"{path}/log", f"{path}/state{k}", lambda t: t.withColumn("status", F.lit("ok"))).awaitTermination()
    return spark.read.parquet(f"{path}/log").agg(F.count(F.lit(1)).alias("n"))


# checks of schemas


@R.add("val_template_keys", "SELECT unnest(json_keys(j)) AS field FROM (SELECT arg_min(line_text, row_id)::JSON AS j FROM result_lines)")
def val_template_keys(spark, sf_dir):
    """The keys of the first record of a template, which is written as a JSON array first."""
    path = fresh_dir(spark, "template")
    first = table(spark, sf_dir, "result_lines").orderBy("row_id").limit(1).select(F.concat(F.lit("["), "line_text", F.lit("]")).alias("value"))
    first.write.text(path)
    return readers.template_keys(spark, path)


@R.add("val_schema", """WITH k AS (SELECT unnest(json_keys(line_text::JSON)) AS field, row_id FROM result_lines), t AS (SELECT field FROM k WHERE row_id = (SELECT min(row_id) FROM result_lines)), n AS (SELECT count(*) AS n FROM result_lines),
h AS (SELECT field, count(DISTINCT row_id) AS c FROM k GROUP BY field) SELECT field, 'missing' AS kind, n - coalesce(c, 0) AS n_records FROM t LEFT JOIN h USING (field), n WHERE n > coalesce(c, 0) UNION ALL SELECT field, 'extra', c FROM h WHERE field NOT IN (SELECT field FROM t)""")
def val_schema(spark, sf_dir):
    """Keys of all records beside those of a template: how many records lack or add each."""
    want = val_template_keys(spark, sf_dir)
    return readers.key_differences(table(spark, sf_dir, "result_lines"), "line_text", [r.field for r in want.collect()])  # as many as a record has keys


@R.add("val_binaries", "SELECT 'ffmpeg' AS tool, true AS checked UNION ALL SELECT 'ffprobe', true")
def val_binaries(spark, sf_dir):
    """Tools a run would need; a plan only names them."""
    return spark.createDataFrame([("ffmpeg", True), ("ffprobe", True)], "tool string, checked boolean")


@R.add("proj_dataset_config", "SELECT * FROM (VALUES ('cgbench', 'cgbench_filtered', true), ('questions', 'test', false)) t(dataset, table_name, has_intervals)")
def proj_dataset_config(spark, sf_dir):
    return spark.createDataFrame([("cgbench", "cgbench_filtered", True), ("questions", "test", False)], "dataset string, table_name string, has_intervals boolean")


@R.add("agg_dvc_topn", "SELECT row_id, least(len(evidence_intervals), 1000) AS n FROM cgbench_filtered WHERE evidence_intervals IS NOT NULL")
def agg_dvc_topn(spark, sf_dir):
    """At most 1,000 predictions per video, which is the feature."""
    return table(spark, sf_dir, "cgbench_filtered").where("evidence_intervals IS NOT NULL").select("row_id", F.size(F.slice("evidence_intervals", 1, 1000)).cast("bigint").alias("n"))


@R.add("smp_rad", None)
def smp_rad(spark, sf_dir):
    """Eight of 32 uniform time stamps in a fixed random order, sorted."""
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", "d", sm.uniform(F.col("d"), F.lit(32)).alias("t"))
    drawn = F.slice(F.array_sort(F.transform("t", lambda x: F.struct(F.xxhash64("row_id", x).alias("h"), x.alias("x")))), 1, 8)
    return rows.select("row_id", F.posexplode(F.array_sort(F.transform(drawn, lambda s: s["x"]))).alias("i", "t"))


@R.add("smp_uniC", f"WITH {ANCHORS_SQL} SELECT row_id, i, CAST(floor(i * floor(d) / 16) AS BIGINT) AS first FROM anchors, range(16) r(i) WHERE d >= 16")
def smp_unic(spark, sf_dir):
    """First frame of each of 16 equal clips."""
    rows = anchors(spark, sf_dir).where("d >= 16").select("row_id", F.posexplode(F.transform(sm.steps(F.lit(16)), lambda i: F.floor(i * F.floor("d") / 16))).alias("i", "first"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("first").cast("bigint").alias("first"))



