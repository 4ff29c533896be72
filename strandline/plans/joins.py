"""Joins of anchors, candidates, replies and files; set operations; resumable work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import replies as rp
from strandline.functions.keys import QID_SQL, VIDEO_SQL, qid_key, video_key
from strandline.operators.range_join import overlapping, points_in_intervals
from strandline.plans.anchors import ANCHORS_SQL, anchors, merged_sql
from strandline.operators.ranks import percentiles, ranked
from strandline.plans.registry import Registry
from strandline.plans.replies import HITS_SQL, PAIR_SQL, RESPONSES_SQL, correctness, responses, with_hits
from strandline.session import table

R = Registry()


def last_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, qid, row_id, duration): the last load of each anchor."""
    rows = anchors(spark, sf_dir)
    return rows.groupBy("video_id", "qid").agg(F.max(F.struct("loaded_at", "row_id", "d")).alias("m")).select("video_id", "qid", F.col("m.row_id").alias("row_id"), F.col("m.d").alias("duration"))


LAST_SQL = f"{ANCHORS_SQL}, last AS (SELECT video_id, qid, row_id, d AS duration FROM anchors QUALIFY row_number() OVER (PARTITION BY video_id, qid ORDER BY loaded_at DESC, row_id DESC) = 1)"
CAND_SQL = f"{LAST_SQL}, cand AS (SELECT cand_id, {VIDEO_SQL.format('video_id')} AS video_id, CAST(qid AS VARCHAR) AS qid FROM suff_correct_insuff_wrong), rep AS (SELECT report_id, {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid FROM uniform_coverage_report)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "suff_correct_insuff_wrong").select("cand_id", video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "uniform_coverage_report").select("report_id", video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"))


@R.add("join_candidates", f"WITH {CAND_SQL} SELECT c.cand_id, l.row_id AS anchor_row, l.row_id IS NOT NULL AS found FROM cand c LEFT JOIN last l ON c.video_id = l.video_id AND c.qid = l.qid")
def join_candidates(spark, sf_dir):
    """Candidates with the last load of their anchor; repeated candidates stay, missing anchors are marked."""
    rows = candidates(spark, sf_dir).join(last_anchor(spark, sf_dir), ["video_id", "qid"], "left")
    return rows.select("cand_id", F.col("row_id").alias("anchor_row"), F.col("row_id").isNotNull().alias("found"))


@R.add("limit_preview", f"WITH {CAND_SQL} SELECT c.cand_id FROM cand c LEFT JOIN last l ON c.video_id = l.video_id AND c.qid = l.qid WHERE l.row_id IS NULL ORDER BY c.cand_id LIMIT 10")
def limit_preview(spark, sf_dir):
    return join_candidates(spark, sf_dir).where("NOT found").select("cand_id").orderBy("cand_id").limit(10)  # the warning's head


@R.add("join_manifest_meta", f"WITH {CAND_SQL} SELECT r.report_id, l.row_id AS anchor_row, l.duration FROM rep r JOIN last l ON r.video_id = l.video_id AND r.qid = l.qid")
def join_manifest_meta(spark, sf_dir):
    return reports(spark, sf_dir).join(last_anchor(spark, sf_dir), ["video_id", "qid"]).select("report_id", F.col("row_id").alias("anchor_row"), "duration")


@R.add("join_broken_subset", f"WITH {CAND_SQL} SELECT DISTINCT c.video_id, c.qid, EXISTS (SELECT 1 FROM rep r WHERE r.video_id = c.video_id AND r.qid = c.qid) AS listed FROM cand c WHERE c.video_id IS NOT NULL AND c.qid IS NOT NULL")
def join_broken_subset(spark, sf_dir):
    """Candidate keys and whether the miss list holds them."""
    listed = reports(spark, sf_dir).select("video_id", "qid", F.lit(True).alias("l")).distinct()
    keys = candidates(spark, sf_dir).where("video_id IS NOT NULL AND qid IS NOT NULL").select("video_id", "qid").distinct()
    return keys.join(listed, ["video_id", "qid"], "left").select("video_id", "qid", F.coalesce("l", F.lit(False)).alias("listed"))


@R.add("set_union_distinct", f"WITH {CAND_SQL} SELECT video_id, qid FROM cand UNION SELECT video_id, qid FROM rep")
def set_union_distinct(spark, sf_dir):
    return candidates(spark, sf_dir).select("video_id", "qid").union(reports(spark, sf_dir).select("video_id", "qid")).distinct()


@R.add("set_union_all", f"WITH {CAND_SQL} SELECT 'cand' AS src, count(*) AS n FROM cand UNION ALL SELECT 'rep', count(*) FROM rep")
def set_union_all(spark, sf_dir):
    both = candidates(spark, sf_dir).select(F.lit("cand").alias("src")).unionByName(reports(spark, sf_dir).select(F.lit("rep").alias("src")))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@R.add("set_map_merge", f"WITH {CAND_SQL}, u AS (SELECT video_id, qid, cand_id AS id, 1 AS o FROM cand UNION ALL SELECT video_id, qid, report_id, 2 FROM rep) SELECT video_id, qid, arg_max(id, {{'o': o, 'id': id}}) AS id FROM u GROUP BY ALL")
def set_map_merge(spark, sf_dir):
    """Two keyed lists as one; the later list, and in it the greater id, wins."""
    u = candidates(spark, sf_dir).select("video_id", "qid", F.col("cand_id").alias("id"), F.lit(1).alias("o")).unionByName(reports(spark, sf_dir).select("video_id", "qid", F.col("report_id").alias("id"), F.lit(2).alias("o")))
    return u.groupBy("video_id", "qid").agg(F.max_by("id", F.struct("o", "id")).alias("id"))


@R.add("join_resume_anti", f"WITH {RESPONSES_SQL}, tasks AS (SELECT DISTINCT video_id, qid, alpha_pct FROM responses WHERE evidence_condition = 'partial'), done AS (SELECT DISTINCT video_id, qid, alpha_pct FROM responses WHERE partial_mode = 'freeze' AND json_valid(v)) SELECT video_id, qid, alpha_pct FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.video_id = t.video_id AND d.qid = t.qid AND d.alpha_pct IS NOT DISTINCT FROM t.alpha_pct)")
def join_resume_anti(spark, sf_dir):
    """Work left over: questions and levels without a parsed reply in mode freeze; equal nulls match."""
    rows = responses(spark, sf_dir)
    tasks = rows.where("evidence_condition = 'partial'").select("video_id", "qid", "alpha_pct").distinct()
    done = rows.where("partial_mode = 'freeze' AND v IS NOT NULL").select(F.col("video_id").alias("dv"), F.col("qid").alias("dq"), F.col("alpha_pct").alias("da")).distinct()
    return tasks.join(done, (F.col("video_id") == F.col("dv")) & (F.col("qid") == F.col("dq")) & F.col("alpha_pct").eqNullSafe(F.col("da")), "left_anti")


@R.add("orch_resume", f"WITH {RESPONSES_SQL}, done AS (SELECT DISTINCT video_id, qid FROM responses WHERE json_valid(v)) SELECT count(*) AS tasks, count(*) FILTER (EXISTS (SELECT 1 FROM done d WHERE d.video_id = c.video_id AND d.qid = c.qid)) AS already_done FROM (SELECT {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid FROM cgbench_filtered) c")
def orch_resume(spark, sf_dir):
    done = responses(spark, sf_dir).where("v IS NOT NULL").select("video_id", "qid", F.lit(True).alias("d")).distinct()
    return anchors(spark, sf_dir).select("video_id", "qid").join(done, ["video_id", "qid"], "left").agg(F.count(F.lit(1)).alias("tasks"), F.count("d").alias("already_done"))


@R.add("join_pred_qa", f"{PAIR_SQL}, {CAND_SQL} SELECT c.cand_id, s.ok FROM cand c LEFT JOIN s ON s.video_id = c.video_id AND s.qid = c.qid")
def join_pred_qa(spark, sf_dir):
    """Candidates with the correctness of their reply with full evidence."""
    return candidates(spark, sf_dir).join(correctness(spark, sf_dir, "sufficient"), ["video_id", "qid"], "left").select("cand_id", "ok")


@R.add("join_subset_chain", f"{PAIR_SQL}, p AS (SELECT video_id, qid, bool_or(hit) AS grounded FROM (WITH {HITS_SQL} SELECT video_id, qid, hit FROM hit) GROUP BY ALL) SELECT s.video_id, s.qid FROM s JOIN i ON s.video_id = i.video_id AND s.qid = i.qid JOIN p ON p.video_id = s.video_id AND p.qid = s.qid WHERE s.ok AND NOT i.ok AND grounded")
def join_subset_chain(spark, sf_dir):
    """Questions right with evidence, wrong without, and grounded in some reply."""
    g = with_hits(spark, sf_dir).groupBy("video_id", "qid").agg(F.bool_or("hit").alias("grounded"))
    s, i = correctness(spark, sf_dir, "sufficient").withColumnRenamed("ok", "s"), correctness(spark, sf_dir, "insufficient").withColumnRenamed("ok", "i")
    return s.join(i, ["video_id", "qid"]).join(g, ["video_id", "qid"]).where("s AND NOT i AND grounded").select("video_id", "qid")


@R.add("filt_subset", f"WITH {CAND_SQL} SELECT a.row_id FROM anchors a WHERE EXISTS (SELECT 1 FROM cand c WHERE c.video_id = a.video_id AND c.qid = a.qid)")
def filt_subset(spark, sf_dir):
    return anchors(spark, sf_dir).join(candidates(spark, sf_dir), ["video_id", "qid"], "left_semi").select("row_id")


@R.add("join_subset_positional", f"WITH {CAND_SQL}, pos AS (SELECT DISTINCT cand_id AS p FROM cand), a AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM anchors) SELECT row_id, place FROM a WHERE place IN (SELECT p FROM pos)")
def join_subset_positional(spark, sf_dir):
    """The rows that stand at the positions of a list, counted from 0 in the order of the table."""
    placed = ranked(anchors(spark, sf_dir).select("row_id"), [], ["row_id"], "place")
    return placed.join(candidates(spark, sf_dir).select(F.col("cand_id").alias("place")), "place", "left_semi").select("row_id", "place")


@R.add("sort_restore_input", f"WITH {ANCHORS_SQL} SELECT row_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) AS place FROM anchors")
def sort_restore_input(spark, sf_dir):
    """Input order within each batch."""
    return win_index(spark, sf_dir).select("row_id", (F.col("idx") + 1).alias("place"))


@R.add("win_index", f"WITH {ANCHORS_SQL} SELECT row_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1 AS idx FROM anchors")
def win_index(spark, sf_dir):
    return ranked(anchors(spark, sf_dir).select("row_id", "batch_id"), ["batch_id"], ["row_id"], "idx")


@R.add("join_file_exists", f"WITH {CAND_SQL}, files AS (SELECT DISTINCT video_id || '_' || qid AS stem FROM anchors) SELECT cand_id, coalesce(qid IS NOT NULL AND EXISTS (SELECT 1 FROM files f WHERE f.stem = c.video_id || '_' || c.qid), false) AS present FROM cand c")
def join_file_exists(spark, sf_dir):
    files = anchors(spark, sf_dir).select(F.concat_ws("_", "video_id", "qid").alias("stem"), F.lit(True).alias("p")).distinct()
    rows = candidates(spark, sf_dir).withColumn("stem", F.concat("video_id", F.lit("_"), "qid"))
    return rows.join(files, "stem", "left").select("cand_id", F.coalesce("p", F.lit(False)).alias("present"))


RESOLVE_SQL = f"{CAND_SQL}, files AS (SELECT video_id AS stem, count(DISTINCT batch_id) AS n FROM anchors GROUP BY ALL)"


@R.add("join_resolve_input", f"WITH {RESOLVE_SQL} SELECT cand_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM cand c LEFT JOIN files f ON f.stem = c.video_id")
def join_resolve_input(spark, sf_dir):
    """ok, missing or ambiguous by the number of batches that hold the video."""
    n = anchors(spark, sf_dir).groupBy("video_id").agg(F.countDistinct("batch_id").alias("n"))
    rows = candidates(spark, sf_dir).join(n, "video_id", "left")
    return rows.select("cand_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"))


@R.add("med_preflight", f"WITH {RESOLVE_SQL}, s AS (SELECT DISTINCT c.video_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM cand c LEFT JOIN files f ON f.stem = c.video_id) SELECT status, count(*) AS n_videos FROM s GROUP BY ALL")
def med_preflight(spark, sf_dir):
    n = anchors(spark, sf_dir).groupBy("video_id").agg(F.countDistinct("batch_id").alias("n"))
    ids = candidates(spark, sf_dir).select("video_id").distinct().join(n, "video_id", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "ok").otherwise("ambiguous")
    return ids.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_videos"))


TIER_SQL = f"""{CAND_SQL}, want AS (SELECT DISTINCT video_id, qid FROM cand WHERE video_id IS NOT NULL AND qid IS NOT NULL),
exact AS (SELECT DISTINCT video_id, qid FROM anchors WHERE evidence_condition = 'sufficient'), named AS (SELECT DISTINCT video_id, qid FROM anchors), low AS (SELECT lower(video_id) AS v, count(DISTINCT video_id) AS n FROM anchors GROUP BY ALL)"""


@R.add("join_tiered_locate", f"""WITH {TIER_SQL} SELECT w.video_id, w.qid, CASE WHEN e.video_id IS NOT NULL THEN 'path' WHEN x.video_id IS NOT NULL THEN 'name' WHEN l.n = 1 THEN 'stem' WHEN l.n > 1 THEN 'ambiguous' ELSE 'missing' END AS tier
FROM want w LEFT JOIN exact e ON e.video_id = w.video_id AND e.qid = w.qid LEFT JOIN named x ON x.video_id = w.video_id AND x.qid = w.qid LEFT JOIN low l ON l.v = lower(w.video_id)""")
def join_tiered_locate(spark, sf_dir):
    """The first tier that finds a key: exact, by name, by stem without case; equi-joins only."""
    want = candidates(spark, sf_dir).where("video_id IS NOT NULL AND qid IS NOT NULL").select("video_id", "qid").distinct()
    rows = anchors(spark, sf_dir)
    exact = rows.where("evidence_condition = 'sufficient'").select("video_id", "qid", F.lit(True).alias("e")).distinct()
    named = rows.select("video_id", "qid", F.lit(True).alias("x")).distinct()
    low = rows.groupBy(F.lower("video_id").alias("v")).agg(F.countDistinct("video_id").alias("n"))
    found = want.join(exact, ["video_id", "qid"], "left").join(named, ["video_id", "qid"], "left").withColumn("v", F.lower("video_id")).join(low, "v", "left")
    tier = F.when(F.col("e"), "path").when(F.col("x"), "name").when(F.col("n") == 1, "stem").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return found.select("video_id", "qid", tier.alias("tier"))


@R.add("join_source_lookup", f"WITH {CAND_SQL}, k AS (SELECT video_id, count(*) FILTER (source_dataset = 'cgbench') AS a, count(*) FILTER (source_dataset <> 'cgbench') AS b FROM anchors GROUP BY ALL) SELECT cand_id, CASE WHEN a = 1 THEN 'first' WHEN b = 1 THEN 'second' ELSE 'none' END AS source FROM cand c LEFT JOIN k ON k.video_id = c.video_id")
def join_source_lookup(spark, sf_dir):
    """The first source with exactly one hit."""
    k = anchors(spark, sf_dir).groupBy("video_id").agg(F.count_if(F.col("source_dataset") == "cgbench").alias("a"), F.count_if(F.col("source_dataset") != "cgbench").alias("b"))
    return candidates(spark, sf_dir).join(k, "video_id", "left").select("cand_id", F.when(F.col("a") == 1, "first").when(F.col("b") == 1, "second").otherwise("none").alias("source"))


@R.add("join_id_to_video", f"WITH {CAND_SQL}, m AS (SELECT video_id, min(batch_id) AS alias FROM anchors GROUP BY ALL) SELECT report_id, coalesce(m.alias, r.video_id) AS video FROM rep r LEFT JOIN m ON m.video_id = r.video_id")
def join_id_to_video(spark, sf_dir):
    m = anchors(spark, sf_dir).groupBy("video_id").agg(F.min("batch_id").alias("alias"))
    return reports(spark, sf_dir).join(m, "video_id", "left").select("report_id", F.coalesce("alias", "video_id").alias("video"))


POINT_SQL = f"{RESPONSES_SQL}, {merged_sql(True, False, False)}, gold AS (SELECT a.row_id AS anchor_row, a.video_id, a.qid, m.start_s, m.end_s FROM merged m JOIN anchors a USING (row_id)), pts AS (SELECT row_id, video_id, qid, unnest(sampled_seconds) AS t FROM responses)"


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors(spark, sf_dir).select(F.col("row_id").alias("anchor_row"), "video_id", "qid", F.explode(iv.normalize(F.col("gold"))).alias("m"))
    return rows.select("anchor_row", "video_id", "qid", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("join_subtitle_point", f"WITH {POINT_SQL} SELECT p.row_id, count(*) AS n, min(p.t) AS first_t FROM pts p JOIN gold g ON g.video_id = p.video_id AND g.qid = p.qid AND p.t > g.start_s AND p.t < g.end_s GROUP BY ALL")
def join_subtitle_point(spark, sf_dir):
    """Sampled points strictly inside the spans of the same question, in all loads of it, per reply."""
    pts = responses(spark, sf_dir).select("row_id", "video_id", "qid", F.explode("sampled_seconds").alias("t"))
    hit = points_in_intervals(pts, gold_spans(spark, sf_dir), ["video_id", "qid"], "t", "start_s", "end_s", 60.0, closed=False)
    return hit.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


@R.add("join_subtitle_overlap", f"""WITH {HITS_SQL}, {merged_sql(True, False, False)}, gold2 AS (SELECT a.row_id AS anchor_row, a.video_id, a.qid, m.start_s, m.end_s FROM merged m JOIN anchors a USING (row_id)),
p AS (SELECT row_id, video_id, qid, unnest(pred) AS p FROM hit) SELECT p.row_id, count(*) AS n FROM p JOIN gold2 g ON g.video_id = p.video_id AND g.qid = p.qid AND p.p."end" >= g.start_s AND p.p.start <= g.end_s AND p.p.start <= p.p."end" GROUP BY ALL""")
def join_subtitle_overlap(spark, sf_dir):
    """Predicted spans that overlap or touch the spans of the same question, per reply."""
    pred = with_hits(spark, sf_dir).select("row_id", "video_id", "qid", F.explode("pred").alias("p")).select("row_id", "video_id", "qid", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))
    return overlapping(pred, gold_spans(spark, sf_dir), ["video_id", "qid"], "p_start", "p_end", "start_s", "end_s", 60.0).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("join_meta_frames", f"WITH {CAND_SQL} SELECT r.report_id, i, CAST(trunc(duration * 10 / 4 / 2 + round_even(duration * 10 / 4 * i, 0)) AS BIGINT) AS frame FROM rep r JOIN last l ON r.video_id = l.video_id AND r.qid = l.qid, range(4) t(i) WHERE duration IS NOT NULL")
def join_meta_frames(spark, sf_dir):
    """Four frames at 10 per second for every listed question of known duration."""
    from strandline.functions import sampling as sm

    rows = reports(spark, sf_dir).join(last_anchor(spark, sf_dir), ["video_id", "qid"]).where("duration IS NOT NULL")
    rows = rows.select("report_id", F.posexplode(sm.global_frames(F.col("duration") * 10, F.lit(4))).alias("i", "f"))
    return rows.select("report_id", F.col("i").cast("bigint").alias("i"), F.col("f").cast("bigint").alias("frame"))


@R.add("filt_existing_frames", f"WITH {POINT_SQL} SELECT p.row_id, p.t FROM pts p WHERE EXISTS (SELECT 1 FROM gold g WHERE g.video_id = p.video_id AND g.qid = p.qid AND p.t BETWEEN g.start_s AND g.end_s)")
def filt_existing_frames(spark, sf_dir):
    """Sampled points for which a frame of the evidence exists; equal points of a reply stay apart."""
    pts = responses(spark, sf_dir).select("row_id", "video_id", "qid", F.posexplode("sampled_seconds").alias("p", "t"))
    hit = points_in_intervals(pts, gold_spans(spark, sf_dir), ["video_id", "qid"], "t", "start_s", "end_s", 60.0)
    return hit.select("row_id", "p", "t").distinct().select("row_id", "t")


@R.add("proj_frame_router", f"WITH {ANCHORS_SQL} SELECT row_id, CASE WHEN evidence_condition = 'Hallucination' THEN 'none' WHEN len(gold) > 0 THEN 'clue' ELSE 'global' END AS route FROM anchors")
def proj_frame_router(spark, sf_dir):
    return anchors(spark, sf_dir).select("row_id", F.when(F.coalesce(F.col("evidence_condition") == "Hallucination", F.lit(False)), "none").when(F.size("gold") > 0, "clue").otherwise("global").alias("route"))


# versions of a record


def version_sql(*more: str) -> str:
    body = "question || '|' || coalesce(answer, '') || '|' || coalesce(array_to_string(choices, ';'), '')" + "".join(f" || '|' || coalesce(CAST({c} AS VARCHAR), '')" for c in more)
    return f"""WITH {ANCHORS_SQL}, o AS (SELECT *, {body} AS body, row_number() OVER w AS p FROM anchors WINDOW w AS (PARTITION BY video_id, qid ORDER BY loaded_at, row_id)),
c AS (SELECT *, lag(body) OVER (PARTITION BY video_id, qid ORDER BY p) AS before FROM o)"""


VERSION_SQL = version_sql()


def versions(rows: DataFrame, *more: str) -> DataFrame:
    """(video_id, qid, version, loads): the version rises where question, answer, options or one of ``more`` differs from the load before."""
    body = F.concat_ws("|", "question", F.coalesce("answer", F.lit("")), F.coalesce(F.array_join("choices", ";"), F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in more])
    rows = rows.withColumn("body", F.when(F.col("question").isNotNull(), body))
    w = Window.partitionBy("video_id", "qid").orderBy("loaded_at", "row_id")
    rows = rows.select("video_id", "qid", ((F.row_number().over(w) > 1) & ~F.col("body").eqNullSafe(F.lag("body").over(w))).alias("changed"))
    return rows.groupBy("video_id", "qid").agg(F.count_if("changed").alias("version"), F.count(F.lit(1)).alias("loads"))


@R.add("sink_upsert_versioned", f"{VERSION_SQL} SELECT video_id, qid, sum(CASE WHEN p > 1 AND body IS DISTINCT FROM before THEN 1 ELSE 0 END)::BIGINT AS version, count(*) AS loads FROM c GROUP BY ALL")
def sink_upsert_versioned(spark, sf_dir):
    """Version of each record after all loads: it rises where question, answer or options differ from the load before."""
    return versions(anchors(spark, sf_dir))


@R.add("filt_needs_eval", f"{version_sql('evidence_count')}, v AS (SELECT video_id, qid, sum(CASE WHEN p > 1 AND body IS DISTINCT FROM before THEN 1 ELSE 0 END)::BIGINT AS version FROM c GROUP BY ALL), r AS (SELECT DISTINCT {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid FROM eval_result) SELECT v.video_id, v.qid FROM v LEFT JOIN r ON r.video_id = v.video_id AND r.qid = v.qid WHERE r.video_id IS NULL OR version <> 0")
def filt_needs_eval(spark, sf_dir):
    """Records without a result, or whose version, to which further evidence counts, is not that of the result (0)."""
    done = responses(spark, sf_dir).select("video_id", "qid", F.lit(True).alias("d")).distinct()
    return versions(anchors(spark, sf_dir), "evidence_count").join(done, ["video_id", "qid"], "left").where("d IS NULL OR version <> 0").select("video_id", "qid")


@R.add("sink_result_merge", f"WITH {RESPONSES_SQL} SELECT video_id, qid, count(DISTINCT run_id) AS n_runs, arg_max(v->>'$.label', row_id) AS last_label FROM responses WHERE v->>'$.label' IS NOT NULL GROUP BY ALL")
def sink_result_merge(spark, sf_dir):
    """Results of all runs per record, the last label on top; counted, not gathered."""
    rows = responses(spark, sf_dir).withColumn("label", rp.field(F.col("v"), "label")).where("label IS NOT NULL")
    return rows.groupBy("video_id", "qid").agg(F.countDistinct("run_id").alias("n_runs"), F.max_by("label", "row_id").alias("last_label"))


@R.add("agg_status_counts", f"WITH {HITS_SQL} SELECT CASE WHEN model_response IS NULL THEN 'no_reply' WHEN v IS NULL THEN 'parse_error' ELSE 'ok' END AS status, count(*) AS n FROM hit GROUP BY ALL")
def agg_status_counts(spark, sf_dir):
    status = F.when(F.col("model_response").isNull(), "no_reply").when(F.col("v").isNull(), "parse_error").otherwise("ok")
    return responses(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add("filt_status_in", f"WITH {HITS_SQL} SELECT row_id FROM hit WHERE v IS NOT NULL OR model_response IS NULL")
def filt_status_in(spark, sf_dir):
    return responses(spark, sf_dir).where("v IS NOT NULL OR model_response IS NULL").select("row_id")


@R.add("agg_open_acc", f"WITH {HITS_SQL} SELECT count(*) AS total, count(pred_answer) AS judged, count(*) FILTER (pred_answer = answer) AS correct FROM hit")
def agg_open_acc(spark, sf_dir):
    a = rp.field(F.col("v"), "answer")
    return responses(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count(a).alias("judged"), F.count_if(a == F.col("answer")).alias("correct"))


def judged_choices(rows: DataFrame, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``rows`` (reply, choices, answer as a letter) with ``ok`` and ``failed``.

    In this order, until one is right: ``(X)`` anywhere in the reply; its leading letter, after ``best option:`` and an
    opening bracket, if nothing or one of ``. , )`` and a blank follows; the option that ``similarity`` puts nearest to the reply
    ("(A) text"), the first of equals, also after a wrong letter. A reply failed where no letter was found at all; without
    ``similarity`` the last step is left out.
    """
    size = F.coalesce(F.size("choices"), F.lit(0))
    reply = F.coalesce("reply", F.lit(""))
    gold = F.ascii(F.upper("answer")) - F.ascii(F.lit("A"))
    letter = lambda c: F.when(c != "", F.ascii(F.upper(c)) - F.ascii(F.lit("A")))
    right = lambda at: F.coalesce((at == gold) & (at < size), F.lit(False))
    marked = F.regexp_extract(reply, r"\(([A-Za-z])\)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(reply), r"^best option:", ""), r"^\s*\(*\s*", "")
    leading = F.regexp_extract(bare, r"(?s)^([a-z])(?:$|[., )])", 1)
    alone = (F.length(bare) == 1) | F.substring(bare, 2, 1).isin(".", ",", " ", ")")
    rows = rows.withColumns({"_marked": right(letter(marked)), "_leading": (bare != "") & right(letter(leading)), "_matched": (marked != "") | (bare != "") & alone, "_bare": bare, "_gold": gold})
    ok = F.col("_marked") | F.col("_leading")
    if similarity is not None:
        options = F.transform("choices", lambda o, i: F.concat(F.lit("("), F.char(i + F.ascii(F.lit("A"))), F.lit(") "), o))
        rows = rows.withColumn("_sims", similarity(F.col("_bare"), options))
        nearest = F.array_position("_sims", F.array_max("_sims")) - 1
        ok = ok | (F.col("_bare") != "") & F.coalesce(nearest == F.col("_gold"), F.lit(False))
    failed = ~F.col("_marked") & ((F.col("_bare") == "") | ~F.col("_matched"))
    return rows.withColumns({"ok": ok, "failed": failed}).drop("_marked", "_leading", "_matched", "_bare", "_gold", "_sims")


@R.add("agg_rvq", f"""WITH {HITS_SQL}, r AS (SELECT task, coalesce(pred_answer, model_response, '') AS reply, coalesce(len(choices), 0) AS size, ord(upper(answer)) - 65 AS gold FROM hit),
b AS (SELECT *, regexp_extract(reply, '\\(([A-Za-z])\\)', 1) AS marked, regexp_replace(regexp_replace(lower(reply), '^best option:', ''), '^\\s*\\(*\\s*', '') AS bare FROM r),
l AS (SELECT *, regexp_extract(bare, '(?s)^([a-z])(?:$|[., )])', 1) AS lead_letter, length(bare) = 1 OR substr(bare, 2, 1) IN ('.', ',', ' ', ')') AS alone FROM b),
m AS (SELECT *, coalesce(marked <> '' AND ord(upper(marked)) - 65 = gold AND gold < size, false) AS by_mark, coalesce(lead_letter <> '' AND ord(upper(lead_letter)) - 65 = gold AND gold < size, false) AS by_lead FROM l)
SELECT task, count(*) AS n, round(avg(CASE WHEN by_mark OR by_lead THEN 1.0 ELSE 0 END), 9) AS acc, count(*) FILTER (NOT by_mark AND (bare = '' OR NOT (marked <> '' OR alone))) AS failed FROM m GROUP BY task""")
def agg_rvq(spark, sf_dir, similarity=None):
    """Accuracy per task by the whole chain of ``judged_choices``; the raw reply stands in where none was parsed."""
    rows = responses(spark, sf_dir).select("task", F.coalesce(rp.field(F.col("v"), "answer"), "model_response").alias("reply"), "choices", "answer")
    return judged_choices(rows, similarity).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"), F.count_if("failed").alias("failed"))


@R.add("agg_gvq", f"""WITH {HITS_SQL}, s AS (SELECT pred_answer = answer AS ok, list_max(list_transform(gold, lambda g: greatest(0, coalesce((least(pred[1]."end", g."end") - greatest(pred[1].start, g.start)) / nullif(greatest(pred[1]."end", g."end") - least(pred[1].start, g.start), 0), 0)))) AS iou FROM hit)
SELECT count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS acc, round(sum(CASE WHEN ok THEN coalesce(iou, 0) ELSE 0 END) / count(*), 9) AS rec FROM s""")
def agg_gvq(spark, sf_dir):
    """Accuracy, and the IoU of right answers over all replies."""
    rows = with_hits(spark, sf_dir)
    best = F.coalesce(F.array_max(F.transform(iv.clean(F.col("evidence_intervals")), lambda g: iv.tiou(F.get("pred", F.lit(0)), g))), F.lit(0.0))
    ok = F.coalesce(F.col("pred_answer") == F.col("answer"), F.lit(False))
    return rows.select(ok.alias("ok"), best.alias("iou")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"), F.round(F.sum(F.when(F.col("ok"), F.col("iou")).otherwise(0.0)) / F.count(F.lit(1)), 9).alias("rec"))


@R.add("agg_vhd", f"""WITH {HITS_SQL}, s AS (SELECT TRY_CAST(regexp_extract(model_response, '\\d+(?:\\.\\d+)?') AS DOUBLE) AS t, gold FROM hit WHERE len(gold) > 0) SELECT count(*) AS n, count(*) FILTER (len(list_filter(gold, lambda g: t BETWEEN g.start AND g."end")) > 0) AS hits, count(*) FILTER (t IS NULL) AS failed FROM s""")
def agg_vhd(spark, sf_dir):
    """The first number of the raw reply against the spans."""
    t = F.regexp_extract("model_response", r"\d+(?:\.\d+)?", 0).try_cast("double")
    rows = responses(spark, sf_dir).select(t.alias("t"), iv.clean(F.col("evidence_intervals")).alias("gold")).where("size(gold) > 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.exists("gold", lambda g: iv.point_inside(F.col("t"), g))).alias("hits"), F.count_if(F.col("t").isNull()).alias("failed"))


#: Thresholds of the reference.
DVC_IOUS = (0.1, 0.3, 0.5, 0.7)


_DVC_HIT = """greatest(0, least(p."end", g."end") - greatest(p.start, g.start)) / (least(greatest(p."end", g."end") - least(p.start, g.start), p."end" - p.start + g."end" - g.start) + 1e-8) > iou"""


@R.add("agg_dvc", f"""WITH {HITS_SQL}, r AS (SELECT row_id, video_id, pred[1:1000] AS pred, gold FROM hit WHERE len(gold) > 0), c AS (SELECT count(*) AS total, count(*) FILTER (coalesce(len(pred), 0) = 0) AS failed FROM r),
l AS (SELECT video_id, arg_max({{'pred': pred, 'gold': gold}}, row_id) AS m FROM r WHERE len(pred) > 0 GROUP BY video_id), e AS (SELECT m.pred AS pred, m.gold AS gold, unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS iou FROM l),
s AS (SELECT iou, len(list_filter(pred, lambda p: len(list_filter(gold, lambda g: {_DVC_HIT})) > 0)) / len(pred) AS p, len(list_filter(gold, lambda g: len(list_filter(pred, lambda p: {_DVC_HIT})) > 0)) / len(gold) AS r FROM e),
a AS (SELECT iou, count(*) AS videos, sum(p) / any_value(total) AS p, sum(r) / any_value(total) AS r, any_value(total) AS total, any_value(failed) AS failed FROM s, c GROUP BY iou), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM a)
SELECT iou, total, failed, videos, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, round(sum(f) OVER () / 4, 9) AS mean_f1 FROM f""")
def agg_dvc(spark, sf_dir):
    """Precision, recall and F1 of predicted spans at each threshold, over all replies to questions with evidence.

    Replies without spans failed. Of the others the last of a video counts, with its first 1,000 spans; means over videos
    are scaled by videos per reply, so failed replies lower them. ``mean_f1`` is the mean over the thresholds.
    """
    rows = with_hits(spark, sf_dir).select("row_id", "video_id", F.slice("pred", 1, 1000).alias("pred"), iv.clean(F.col("evidence_intervals")).alias("gold")).where("size(gold) > 0")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(F.size("pred") > 0, F.lit(False))).alias("failed"))
    last = rows.where("size(pred) > 0").groupBy("video_id").agg(F.max_by(F.struct("pred", "gold"), "row_id").alias("m")).select("m.pred", "m.gold")

    def share(of: str, among: str, least: float):
        return F.size(F.filter(of, lambda x: F.exists(among, lambda y: iv.iou_captions(x, y) > least))) / F.size(of)

    sums = [F.sum(share(a, b, t)).alias(f"{n}{i}") for i, t in enumerate(DVC_IOUS) for n, a, b in (("p", "pred", "gold"), ("r", "gold", "pred"))]
    one = counts.crossJoin(last.agg(F.count(F.lit(1)).alias("videos"), *sums))  # one row each
    # the mean over videos times videos / total
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    f1 = lambda i: F.coalesce(F.try_divide(2 * scaled(f"p{i}") * scaled(f"r{i}"), scaled(f"p{i}") + scaled(f"r{i}")), F.lit(0.0))
    at = [F.struct(F.lit(t).alias("iou"), scaled(f"p{i}").alias("p"), scaled(f"r{i}").alias("r"), f1(i).alias("f")) for i, t in enumerate(DVC_IOUS)]
    mean = sum(f1(i) for i in range(len(DVC_IOUS))) / len(DVC_IOUS)
    out = one.select("total", "failed", "videos", mean.alias("mean"), F.explode(F.array(*at)).alias("x"))
    return out.select("x.iou", "total", "failed", "videos", *[F.round(f"x.{c}", 9).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))], F.round("mean", 9).alias("mean_f1"))


@R.add("agg_collect_tables", f"WITH {HITS_SQL}, s AS (SELECT task, sampling, avg(CASE WHEN pred_answer IS NOT DISTINCT FROM answer THEN 1.0 ELSE 0 END) AS acc FROM hit GROUP BY ALL) SELECT task, round(avg(acc), 9) AS mean_acc, round(max(acc) FILTER (sampling = 'uniform'), 9) AS uniform, round(max(acc) FILTER (sampling = 'evidence'), 9) AS evidence FROM s GROUP BY ALL")
def agg_collect_tables(spark, sf_dir):
    """Accuracy per task: mean over the samplings, and one column each."""
    ok = rp.field(F.col("v"), "answer").eqNullSafe(F.col("answer"))
    s = responses(spark, sf_dir).groupBy("task", "sampling").agg(F.avg(ok.cast("double")).alias("acc"))
    of = lambda x: F.round(F.max(F.when(F.col("sampling") == x, F.col("acc"))), 9).alias(x)
    return s.groupBy("task").agg(F.round(F.avg("acc"), 9).alias("mean_acc"), of("uniform"), of("evidence"))


@R.add("agg_weighted_mean", f"WITH {ANCHORS_SQL} SELECT question_type, round(sum(d * evidence_count) / nullif(sum(CASE WHEN d IS NOT NULL THEN evidence_count END), 0), 6) AS mean FROM anchors GROUP BY ALL")
def agg_weighted_mean(spark, sf_dir):
    weight = F.sum(F.when(F.col("d").isNotNull(), F.col("evidence_count"))).cast("double")
    return anchors(spark, sf_dir).groupBy("question_type").agg(F.round(F.try_divide(F.sum(F.col("d") * F.col("evidence_count")), weight), 6).alias("mean"))


@R.add("agg_global_avg_dist", f"WITH {ANCHORS_SQL} SELECT count(d) AS n, round(sum(d), 4) AS total, round(sum(d) / count(d), 6) AS mean FROM anchors")
def agg_global_avg_dist(spark, sf_dir):
    return anchors(spark, sf_dir).agg(F.count("d").alias("n"), F.round(F.sum("d"), 4).alias("total"), F.round(F.sum("d") / F.count("d"), 6).alias("mean"))


@R.add("agg_quantiles", f"WITH {ANCHORS_SQL} SELECT min(d) AS low, max(d) AS high, quantile_disc(d, 0.5) AS median, quantile_disc(d, 0.9) AS p90, quantile_disc(d, 0.99) AS p99 FROM anchors")
def agg_quantiles(spark, sf_dir):
    """Exact percentiles from counted values in global order."""
    return percentiles(anchors(spark, sf_dir).select("d"), "d", {"low": 0.0, "high": 1.0, "median": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")


#: The coverage is looked at over so many first anchors; as in the reference.
COVERAGE_SAMPLE = 200


@R.add("agg_coverage_sample", f"WITH {merged_sql(True, False, False)}, c AS (SELECT m.row_id, least(sum(end_s - start_s) / any_value(a.d), 1) AS r FROM merged m JOIN anchors a USING (row_id) WHERE a.d IS NOT NULL GROUP BY ALL ORDER BY m.row_id LIMIT {COVERAGE_SAMPLE}) SELECT count(*) AS n, round(avg(r), 6) AS mean, round(list_sort(list(r))[count(*) // 2 + 1], 6) AS median, round(min(r), 6) AS low, round(max(r), 6) AS high FROM c")
def agg_coverage_sample(spark, sf_dir):
    """Share of the duration that the evidence covers, over the first 200 anchors that have both: a sampling operator. The median is the upper one."""
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", "d", iv.normalize(F.col("gold")).alias("m")).where("size(m) > 0").orderBy("row_id").limit(COVERAGE_SAMPLE)
    r = F.least(iv.union_length(F.col("m")) / F.col("d"), F.lit(1.0))
    made = rows.select(r.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.sort_array(F.collect_list("r")).alias("all"), F.min("r").alias("low"), F.max("r").alias("high"))
    upper = F.get("all", F.floor(F.col("n") / 2).cast("int"))
    return made.select("n", F.round("mean", 6).alias("mean"), F.round(upper, 6).alias("median"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@R.add("win_best_so_far", f"WITH {RESPONSES_SQL}, b AS (SELECT run_id, alpha_pct, count(*) AS n FROM responses WHERE alpha_pct IS NOT NULL GROUP BY ALL), w AS (SELECT *, max(n) OVER (PARTITION BY run_id ORDER BY alpha_pct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b) SELECT run_id, alpha_pct, n, best IS NULL OR n > best AS kept FROM w")
def win_best_so_far(spark, sf_dir):
    """Whether a level beats all before it, per run; over counts, a hundred levels at most."""
    b = responses(spark, sf_dir).where("alpha_pct IS NOT NULL").groupBy("run_id", "alpha_pct").agg(F.count(F.lit(1)).alias("n"))
    best = F.max("n").over(Window.partitionBy("run_id").orderBy("alpha_pct").rowsBetween(Window.unboundedPreceding, -1))
    return b.select("run_id", "alpha_pct", "n", (best.isNull() | (F.col("n") > best)).alias("kept"))
