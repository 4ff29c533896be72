"""Replies, captions, subtitles, logs and clues read from text, over whole tables and every branch of their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import parsing as ps
from strandline.plans.anchors import ANCHORS_SQL, anchors
from strandline.plans.media import PROBED_SQL, SIZED_SQL, probed, sized_jobs
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, answer, reply): the raw replies; every second one names its answer ``result``, half of these without quotes."""
    rows = table(spark, sf_dir, "eval_result").where("model_response <> ''")
    named = F.when(F.col("row_id") % 2 == 0, F.replace("model_response", F.lit('"answer":'), F.lit('"result":'))).otherwise(F.col("model_response"))
    return rows.select("row_id", "answer", F.when(F.col("row_id") % 4 == 0, F.regexp_replace(named, r'"result": "([A-E])"', '"result": $1')).otherwise(named).alias("reply"))


REPLIES_SQL = r"""r AS (SELECT row_id, answer, CASE WHEN row_id % 2 = 0 THEN replace(model_response, '"answer":', '"result":') ELSE model_response END AS t FROM eval_result WHERE model_response <> ''),
q AS (SELECT row_id, answer, CASE WHEN row_id % 4 = 0 THEN regexp_replace(t, '"result": "([A-E])"', '"result": \1', 'g') ELSE t END AS t FROM r),
b AS (SELECT *, regexp_replace(regexp_extract(t, '(?s)```json(.*?)```', 1), '^\s+|\s+$', '', 'g') AS block, regexp_extract_all(t, '\b[A-H]\b') AS letters FROM q),
j AS (SELECT *, regexp_replace(block, '(:\s)([A-Za-z_]\w*)', '\1"\2"', 'g') AS quoted, CASE WHEN json_valid(block) AND NOT regexp_matches(block, ',\s*[}\]]') THEN block->>'$.result' END AS found FROM b)"""


@R.add("fn_post_process_cg", f"""WITH {REPLIES_SQL} SELECT row_id, CASE WHEN json_valid(quoted) AND NOT regexp_matches(quoted, ',\\s*[}}\\]]') AND json_exists(quoted, '$.result') THEN CASE WHEN json_type(quoted, '$.result') = 'VARCHAR' AND quoted->>'$.result' = answer THEN 1 ELSE 0 END WHEN len(letters) > 0 THEN CAST(list_contains(letters, answer) AS INT) END AS choice,
 coalesce(found, t) AS opened, TRY_CAST(coalesce(found, nullif(regexp_extract(t, '[012]'), '')) AS BIGINT) AS step_1, TRY_CAST(coalesce(found, nullif(regexp_extract(t, '[01]'), '')) AS BIGINT) AS step_2 FROM j""")
def fn_post_process_cg(spark, sf_dir):
    """The result of each reply in the modes choice, open, and both steps of the judge."""
    r = F.col("reply")
    return replies(spark, sf_dir).select("row_id", ps.choice_result(r, F.col("answer")).alias("choice"), ps.open_result(r).alias("opened"), ps.step_result(r, 1).alias("step_1"), ps.step_result(r, 2).alias("step_2"))


def clue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text): an anchor's intervals, below 1,000,000 s, in one of five notations; without signs in the free one."""
    gold = F.filter("gold", lambda x: (F.abs(x["start"]) < 1e6) & (F.abs(x["end"]) < 1e6) & ((F.col("row_id") % 5 != 4) | (x["start"] >= 0) & (x["end"] >= 0)))
    rows = anchors(spark, sf_dir).select("row_id", gold.alias("g"))
    s, e = (lambda x: x["start"].cast("string")), (lambda x: x["end"].cast("string"))
    objects = F.to_json("g")
    forms = [
        objects,
        F.to_json(F.transform("g", lambda x: F.array(x["start"], x["end"]))),
        F.concat(F.lit('{"first": '), objects, F.lit(', "more": {"none": []}}')),
        F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: F.concat(F.lit("("), s(x), F.lit(", "), e(x), F.lit(")"))), ", "), F.lit("]")),
        F.array_join(F.transform("g", lambda x: F.concat(F.lit("from "), s(x), F.lit(" s to "), e(x), F.lit(" s"))), "; "),
    ]
    text = forms[-1]
    for k, form in enumerate(forms[:-1]):
        text = F.when(F.col("row_id") % 5 == k, form).otherwise(text)
    return rows.select("row_id", text.alias("text"))


@R.add("iv_parse_clues", f"""WITH {ANCHORS_SQL}, g AS (SELECT row_id, unnest(gold) AS g FROM anchors) SELECT row_id, g.start AS start_s, g."end" AS end_s FROM g WHERE abs(g.start) < 1e6 AND abs(g."end") < 1e6 AND (row_id % 5 <> 4 OR g.start >= 0 AND g."end" >= 0)""")
def iv_parse_clues(spark, sf_dir):
    """Intervals in objects, pairs, nested objects, Python literals and free text."""
    made = ps.parse_intervals(clue_texts(spark, sf_dir), "row_id", "text").select("row_id", F.explode("spans").alias("p"))
    return made.select("row_id", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, k, text): a caption and the whole seconds of an anchor's first interval in one of four ways of writing."""
    first = F.get("gold", F.lit(0))
    at = lambda x: F.floor(F.greatest(x, F.lit(0.0))).cast("bigint").cast("string")
    rows = anchors(spark, sf_dir).where("size(gold) > 0").select("row_id", (F.col("row_id") % 4).alias("k"), at(first["start"]).alias("a"), at(first["end"]).alias("b"), F.concat(F.lit("clip number "), F.col("row_id").cast("string")).alias("c"))
    forms = {
        0: F.concat("a", F.lit(" - "), "b", F.lit(" seconds, "), "c", F.lit(" 900 - 950.5 seconds, Then other words")),
        1: F.concat(F.lit("Starting time: "), "a", F.lit("s, ending time: "), "b", F.lit("s, description: "), "c"),
        2: F.concat(F.lit("Start time: "), "a", F.lit("; end time: "), "b", F.lit("\n* "), "c"),
        3: F.concat(F.lit("An opening line\nIt moves at "), "a", F.lit(" seconds "), "c"),
    }
    text = forms[3]
    for k in (2, 1, 0):
        text = F.when(F.col("k") == k, forms[k]).otherwise(text)
    return rows.select("row_id", "k", text.alias("text"))


CAPTIONS_SQL = f"""{ANCHORS_SQL}, c AS (SELECT row_id, row_id % 4 AS k, floor(greatest(gold[1].start, 0)) AS a, floor(greatest(gold[1]."end", 0)) AS b, 'clip number ' || row_id AS c FROM anchors WHERE len(gold) > 0),
p AS (SELECT row_id, 0 AS i, a, b, c FROM c WHERE k < 3 UNION ALL SELECT row_id, 1, 900, 950.5, 'then other words' FROM c WHERE k = 0)"""


@R.add("fn_time_paragraph", f"WITH {CAPTIONS_SQL} SELECT row_id, i, a AS start_s, b AS end_s, c AS caption FROM p")
def fn_time_paragraph(spark, sf_dir):
    rows = caption_texts(spark, sf_dir).select("row_id", F.posexplode(ps.time_paragraph(F.col("text"))).alias("i", "x"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("x.start").alias("start_s"), F.col("x.end").alias("end_s"), "x.caption")


@R.add("fn_dvc_format", f"""WITH {CAPTIONS_SQL} SELECT row_id, i, least(a, b) AS start_s, greatest(a, b) AS end_s, c AS caption FROM p
UNION ALL SELECT row_id, 0, CASE WHEN a > 20 THEN a - 20 ELSE a END, CASE WHEN a > 20 THEN a + 20 ELSE a + 40 END, c FROM c WHERE k = 3""")
def fn_dvc_format(spark, sf_dir):
    """Captions of paragraphs, and of lines where a paragraph names no span."""
    rows = caption_texts(spark, sf_dir).select("row_id", F.posexplode(ps.dense_captions(F.col("text"))).alias("i", "x"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("x.start").alias("start_s"), F.col("x.end").alias("end_s"), "x.caption")


@R.add("scan_srt", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'subtitle'), m AS (SELECT doc_id, regexp_extract(line, '^\[(\d+):(\d\d)\] (\S.*)$', ['m', 's', 'c']) AS g FROM l)
SELECT doc_id, (CAST(g.m AS BIGINT) * 60 + CAST(g.s AS BIGINT)) * 1000 AS start_ms, (CAST(g.m AS BIGINT) * 60 + CAST(g.s AS BIGINT)) * 1000 + 2500 AS end_ms, regexp_replace(g.c, '\s+$', '') AS text FROM m WHERE g.m <> ''""")
def scan_srt(spark, sf_dir):
    """The cues of subtitle files, which are written from the time-stamped lines of the documents first."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\[\d+:\d\d\] \S"))
    clock = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    ms = lambda x: (F.regexp_extract(x, r"^\[(\d+):", 1).cast("bigint") * 60 + F.regexp_extract(x, r"^\[\d+:(\d\d)\]", 1).cast("bigint")) * 1000
    cue = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(ms(x)), F.lit(" --> "), clock(ms(x) + 2500), F.lit("\n"), F.regexp_extract(x, r"^\[\d+:\d\d\] (.*)", 1), F.lit("\n"))
    files = table(spark, sf_dir, "documents").where("source = 'subtitle'").select("doc_id", F.array_join(F.transform(lines, cue), "\n").alias("srt"))
    return files.select("doc_id", F.explode(ps.cues(F.col("srt"))).alias("c")).select("doc_id", "c.start_ms", "c.end_ms", "c.text")


@R.add("fn_call_payload", """WITH t AS (SELECT row_id, question, base64(encode(CAST(row_id AS VARCHAR))) AS f, list_filter(sampled_seconds, lambda t: t IS NOT NULL) AS ts FROM eval_result WHERE sampled_seconds IS NOT NULL)
SELECT row_id, 2 * len(ts) + 1 AS n_items, md5(array_to_string(list_append(list_transform(ts, lambda t: 'text:Frame at ' || format('{:.1f}', t) || 's:|image_url:data:image/jpeg;base64,' || f), 'text:' || coalesce(question, '')), '|')) AS content, 0 AS temperature, 512 AS max_tokens FROM t""")
def fn_call_payload(spark, sf_dir):
    """The items of each request, as one sum, with its fixed settings."""
    rows = table(spark, sf_dir, "eval_result").where("sampled_seconds IS NOT NULL")
    rows = rows.select("row_id", "sampled_seconds", F.coalesce("question", F.lit("")).alias("question"), F.transform("sampled_seconds", lambda t: F.base64(F.col("row_id").cast("string").cast("binary"))).alias("frames"))
    made = ps.request_items(rows, "row_id", "sampled_seconds", "frames", "question")
    text = F.array_join(F.transform("items", lambda x: F.concat(x["kind"], F.lit(":"), x["content"])), "|")
    return made.select("row_id", F.size("items").cast("bigint").alias("n_items"), F.md5(text).alias("content"), F.lit(0).alias("temperature"), F.lit(512).alias("max_tokens"))


MEASURED_SQL = f"{SIZED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id, qid ORDER BY start_s) AS i, count(*) OVER (PARTITION BY row_id, qid) AS n FROM merged WHERE video_id IN (SELECT video_id FROM dims))"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, qid, m, found): the spans that are to be frozen, and those that a detector's log tells of.

    No file is there to be measured, so the log is written from the spans; in one row of five the last one is missing.
    """
    rows = sized_jobs(spark, sf_dir).withColumn("seen", F.when(F.col("row_id") % 5 == 0, F.slice("m", F.lit(1), F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m")))
    lines = F.transform("seen", lambda x: F.concat(F.lit("[fd @ 0x1] lavfi.freezedetect.freeze_start: "), x["start"].cast("string"), F.lit("\nlavfi.freezedetect.freeze_duration: 1\nlavfi.freezedetect.freeze_end: "), x["end"].cast("string")))
    return rows.select("row_id", "qid", "m", ps.freeze_segments(F.array_join(lines, "\n")).alias("found"))


@R.add("med_measure", f"WITH {MEASURED_SQL} SELECT row_id, qid, i - 1 AS i, start_s, end_s FROM k WHERE row_id % 5 <> 0 OR i < n")
def med_measure(spark, sf_dir):
    """Frozen segments by the detector's log."""
    rows = measured(spark, sf_dir).select("row_id", "qid", F.posexplode("found").alias("i", "x"))
    return rows.select("row_id", "qid", F.col("i").cast("bigint").alias("i"), F.col("x.start").alias("start_s"), F.col("x.end").alias("end_s"))


@R.add("med_verify", f"WITH {MEASURED_SQL}, v AS ({'WITH ' + PROBED_SQL} SELECT row_id, NOT bad AND abs(coalesce(duration, 0) - coalesce(expected, 0)) <= 0.5 AS ok FROM p) SELECT row_id, qid, ok AS duration_ok, row_id % 5 <> 0 AS frozen_ok, CASE WHEN ok AND row_id % 5 <> 0 THEN 'OK' ELSE 'FAIL' END AS verdict FROM (SELECT DISTINCT row_id, qid FROM k) JOIN v USING (row_id)")
def med_verify(spark, sf_dir):
    """OK where the duration is within half a second of the source's and the middle of every span lies in a frozen segment."""
    near = F.abs(F.coalesce("p.duration", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0))) <= 0.5
    lengths = probed(spark, sf_dir).select("row_id", (F.col("p.error").isNull() & near).alias("duration_ok"))
    frozen = F.forall("m", lambda x: F.exists("found", lambda s: (s["start"] <= (x["start"] + x["end"]) / 2) & ((x["start"] + x["end"]) / 2 <= s["end"])))
    rows = measured(spark, sf_dir).select("row_id", "qid", frozen.alias("frozen_ok")).join(lengths, "row_id")
    return rows.select("row_id", "qid", "duration_ok", "frozen_ok", F.when(F.col("duration_ok") & F.col("frozen_ok"), "OK").otherwise("FAIL").alias("verdict"))
