"""Metrics over model replies: by condition, by level of degradation, refusals, pairs of conditions, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import replies as rp
from strandline.functions.keys import QID_SQL, VIDEO_SQL, alpha_key, qid_key, video_key
from strandline.operators.ranks import ranked
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_result with tidy keys and the parsed reply as variant ``v``."""
    return table(spark, sf_dir, "eval_result").select(
        "row_id", "run_id", video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"), "answer", "question_type", "evidence_intervals", "video_duration",
        F.coalesce("evidence_condition", F.lit("UNKNOWN")).alias("condition"), "evidence_condition", "task", "sampling", "sampled_seconds", "choices", "question", "model_response",
        rp.parsed(F.col("model_parsed")).alias("v"), alpha_key("alpha").alias("alpha_pct"), "alpha", "partial_mode", "delivered_at",
    )


RESPONSES_SQL = f"""
responses AS (
  SELECT row_id, run_id, {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid, answer, question_type, evidence_intervals, video_duration,
    coalesce(evidence_condition, 'UNKNOWN') AS condition, evidence_condition, task, sampling, sampled_seconds, choices, question, model_response,
    CASE WHEN NOT regexp_matches(model_parsed, '(NaN|Infinity|,\\s*[]}}])') THEN TRY_CAST(model_parsed AS JSON) END AS v, CAST(round(round(alpha, 2) * 100) AS BIGINT) AS alpha_pct, alpha, partial_mode, delivered_at
  FROM eval_result
)
"""
_NUM = "CASE WHEN json_type(x) IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'HUGEINT') {extra} THEN TRY_CAST(x->>'$' AS DOUBLE) END"
HITS_SQL = f"""{RESPONSES_SQL},
typed AS (SELECT *, v->'$.evidence_seconds' AS es, json_type(v, '$.evidence_seconds') AS kind, v->>'$.answer' AS pred_answer, v->>'$.label' AS pred_label,
  list_filter(evidence_intervals, lambda g: g.start IS NOT NULL AND g."end" IS NOT NULL) AS gold FROM responses),
lists AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN CAST(es AS JSON[]) END AS items FROM typed),
numbers AS (SELECT *,
  list_filter(list_transform(items, lambda x: {_NUM.format(extra="OR json_type(x) = 'VARCHAR'")}), lambda n: n IS NOT NULL) AS nums,
  list_transform(items, lambda x: {_NUM.format(extra='')}) AS strict_nums,
  list_filter(list_transform(items, lambda x: {{'start': TRY_CAST(x->>'$.start' AS DOUBLE), 'end': TRY_CAST(x->>'$.end' AS DOUBLE)}}), lambda s: s.start IS NOT NULL AND s."end" IS NOT NULL) AS spans
  FROM lists),
preds AS (SELECT *,
  CASE WHEN kind = 'ARRAY' AND len(list_filter(items, lambda x: json_type(x) = 'OBJECT')) = len(items) THEN spans
    WHEN kind = 'ARRAY' AND len(nums) > 0 THEN [{{'start': list_min(nums), 'end': list_max(nums)}}]
    WHEN kind = 'OBJECT' AND TRY_CAST(es->>'$.start' AS DOUBLE) IS NOT NULL AND TRY_CAST(es->>'$.end' AS DOUBLE) IS NOT NULL THEN [{{'start': TRY_CAST(es->>'$.start' AS DOUBLE), 'end': TRY_CAST(es->>'$.end' AS DOUBLE)}}]
    WHEN kind IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(es->>'$' AS DOUBLE) <> 0 THEN [{{'start': TRY_CAST(es->>'$' AS DOUBLE), 'end': TRY_CAST(es->>'$' AS DOUBLE)}}]
    ELSE [] END AS pred,
  CASE WHEN kind = 'ARRAY' AND len(strict_nums) > 0 AND len(list_filter(strict_nums, lambda n: n IS NULL)) = 0 THEN [{{'start': list_min(strict_nums), 'end': list_max(strict_nums)}}] ELSE [] END AS strict_pred
  FROM numbers),
hit AS (SELECT *,
  coalesce(len(list_filter(pred, lambda p: len(list_filter(gold, lambda g: CASE WHEN p.start = p."end" THEN p.start BETWEEN g.start AND g."end" ELSE greatest(p.start, g.start) < least(p."end", g."end") END)) > 0)) > 0, false) AS hit,
  coalesce(len(list_filter(strict_pred, lambda p: len(list_filter(gold, lambda g: greatest(p.start, g.start) < least(p."end", g."end"))) > 0)) > 0, false) AS strict_hit
  FROM preds)
"""


def with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses with the reply's answer and label, predicted spans and both evidence hits."""
    rows = responses(spark, sf_dir)
    rows = rows.withColumns({"pred_answer": rp.field(F.col("v"), "answer"), "pred_label": rp.field(F.col("v"), "label"), "pred": rp.predicted_spans(F.col("v")), "strict_pred": rp.list_spans(F.col("v"))})
    return rows.withColumns(
        {
            "hit": F.coalesce(iv.hits(F.col("pred"), F.col("evidence_intervals")), F.lit(False)),
            "strict_hit": F.coalesce(iv.hits_strict(F.col("strict_pred"), F.col("evidence_intervals")), F.lit(False)),
        }
    )


def n_if(c):
    return F.count_if(c).cast("bigint")


def rate(n, total):
    return F.coalesce(F.try_divide(n.cast("double"), total.cast("double")), F.lit(0.0))


@R.add("iv_evidence_hit_poly", f"WITH {HITS_SQL} SELECT row_id, len(pred) AS n_spans, hit FROM hit")
def iv_evidence_hit_poly(spark, sf_dir):
    return with_hits(spark, sf_dir).select("row_id", F.size("pred").cast("bigint").alias("n_spans"), "hit")


@R.add("iv_evidence_hit_strict", f"WITH {HITS_SQL} SELECT row_id, strict_hit AS hit FROM hit")
def iv_evidence_hit_strict(spark, sf_dir):
    return with_hits(spark, sf_dir).select("row_id", F.col("strict_hit").alias("hit"))


@R.add("join_pred_gt_intervals", f"""WITH {HITS_SQL}, p AS (SELECT row_id, gold, unnest(pred) AS p FROM hit), g AS (SELECT row_id, p, unnest(gold) AS g FROM p)
SELECT row_id, p.start AS p_start, p."end" AS p_end, g.start AS g_start, g."end" AS g_end FROM g WHERE greatest(p.start, g.start) < least(p."end", g."end")""")
def join_pred_gt_intervals(spark, sf_dir):
    """Each predicted span with each gold span it overlaps; both lists are those of one row."""
    rows = with_hits(spark, sf_dir).select("row_id", F.explode("pred").alias("p"), iv.clean(F.col("evidence_intervals")).alias("gold")).select("row_id", "p", F.explode("gold").alias("g"))
    rows = rows.select("row_id", F.col("p").cast(iv.SPAN).alias("p"), F.col("g").cast(iv.SPAN).alias("g"))
    return rows.where(iv.overlap_open(F.col("p"), F.col("g"))).select("row_id", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), F.col("g.start").alias("g_start"), F.col("g.end").alias("g_end"))


ALPHA_COLS_SQL = """count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (hit) AS evidence_hit, count(*) FILTER (label = 'UNANSWERABLE') AS unanswerable,
  count(*) FILTER (label = 'ANSWERABLE') AS answerable, count(*) FILTER (ok AND NOT hit) AS success_wrong_evidence, count(*) FILTER (NOT ok AND hit) AS wrong_answer_correct_evidence"""
ALPHA_SQL = f"""WITH {HITS_SQL},
judged AS (SELECT *, upper(trim(pred_answer)) IS NOT DISTINCT FROM upper(trim(answer)) AS ok, upper(trim(pred_label)) AS label,
  CASE WHEN alpha_pct IS NULL THEN 'None' ELSE CAST(alpha_pct / 100.0 AS DOUBLE)::VARCHAR END AS alpha_text FROM hit WHERE evidence_condition = 'partial'),
grouped AS (SELECT alpha_text AS alpha, {ALPHA_COLS_SQL} FROM judged GROUP BY ALL)
SELECT *, success / total AS success_rate, evidence_hit / total AS evidence_hit_rate, unanswerable / total AS unanswerable_rate, answerable / total AS answerable_rate,
  success_wrong_evidence / total AS success_wrong_evidence_rate, wrong_answer_correct_evidence / total AS wrong_answer_correct_evidence_rate FROM grouped"""


def alpha_metrics(rows: DataFrame, condition: str | None = "partial") -> DataFrame:
    """Seven counters and six rates per level of alpha (as text; null is its own level), answers and labels compared without case and outer blanks."""
    rows = rows if condition is None else rows.where(F.col("evidence_condition") == condition)
    ok, label = rp.normal_answer(F.col("pred_answer")).eqNullSafe(rp.normal_answer(F.col("answer"))), rp.normal_answer(F.col("pred_label"))
    text = F.coalesce((F.col("alpha_pct") / 100.0).cast("string"), F.lit("None"))
    counted = rows.select(text.alias("alpha"), ok.alias("ok"), label.alias("label"), "hit").groupBy("alpha").agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col("ok")).alias("success"), n_if(F.col("hit")).alias("evidence_hit"), n_if(F.col("label") == "UNANSWERABLE").alias("unanswerable"),
        n_if(F.col("label") == "ANSWERABLE").alias("answerable"), n_if(F.col("ok") & ~F.col("hit")).alias("success_wrong_evidence"), n_if(~F.col("ok") & F.col("hit")).alias("wrong_answer_correct_evidence"),
    )
    names = ["success", "evidence_hit", "unanswerable", "answerable", "success_wrong_evidence", "wrong_answer_correct_evidence"]
    return counted.withColumns({f"{c}_rate": rate(F.col(c), F.col("total")) for c in names})


@R.add("agg_alpha_metrics", ALPHA_SQL)
def agg_alpha_metrics(spark, sf_dir):
    return alpha_metrics(with_hits(spark, sf_dir))


@R.add("sort_alpha_mixed", f"WITH {RESPONSES_SQL}, a AS (SELECT DISTINCT CASE WHEN alpha_pct IS NULL THEN 'None' ELSE CAST(alpha_pct / 100.0 AS DOUBLE)::VARCHAR END AS alpha FROM responses) SELECT alpha, row_number() OVER (ORDER BY TRY_CAST(alpha AS DOUBLE) IS NULL, TRY_CAST(alpha AS DOUBLE), alpha) AS place FROM a")
def sort_alpha_mixed(spark, sf_dir):
    """Levels in report order: numbers ascending, then texts. One row per level, so a global window is small."""
    levels = responses(spark, sf_dir).select(F.coalesce((F.col("alpha_pct") / 100.0).cast("string"), F.lit("None")).alias("alpha")).distinct()
    number = F.col("alpha").try_cast("double")
    return levels.withColumn("place", F.row_number().over(Window.orderBy(number.isNull(), number, "alpha")).cast("bigint"))


@R.add(
    "agg_condition_metrics",
    f"""WITH {HITS_SQL}, judged AS (SELECT condition, pred_answer IS NOT DISTINCT FROM answer AS ok, strict_hit AS h, pred_label FROM hit)
SELECT CASE WHEN grouping(condition) = 1 THEN 'TOTAL' ELSE condition END AS condition, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (h) AS evidence_hit, count(*) FILTER (pred_label = 'UNANSWERABLE') AS unanswerable,
  count(*) FILTER (ok AND NOT h) AS success_wrong_evidence, count(*) FILTER (NOT ok AND h) AS wrong_correct_evidence FROM judged GROUP BY ROLLUP (condition)""",
)
def agg_condition_metrics(spark, sf_dir):
    """Counters per evidence condition and in total; answers and labels compared as they are, two missing answers agree."""
    rows = with_hits(spark, sf_dir).select("condition", F.col("pred_answer").eqNullSafe(F.col("answer")).alias("ok"), F.col("strict_hit").alias("h"), "pred_label")
    return (
        rows.rollup("condition")
        .agg(
            F.grouping("condition").alias("g"), F.count(F.lit(1)).alias("total"), n_if(F.col("ok")).alias("success"), n_if(F.col("h")).alias("evidence_hit"),
            n_if(F.col("pred_label") == "UNANSWERABLE").alias("unanswerable"), n_if(F.col("ok") & ~F.col("h")).alias("success_wrong_evidence"), n_if(~F.col("ok") & F.col("h")).alias("wrong_correct_evidence"),
        )
        .withColumn("condition", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("condition")))
        .drop("g")
    )


@R.add(
    "agg_refusal",
    f"""WITH {HITS_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (pred_label = 'UNANSWERABLE') AS refused, count(*) FILTER (pred_label = 'ANSWERABLE') AS answered,
  count(*) FILTER (pred_label = 'ANSWERABLE' AND pred_answer IS NOT DISTINCT FROM answer) AS answered_correct FROM hit WHERE evidence_condition = 'insufficient')
SELECT *, total - refused - answered AS other, answered - answered_correct AS answered_wrong, refused / total AS refusal_rate, CASE WHEN answered > 0 THEN answered_correct / answered END AS correct_of_answered,
  answered_correct / total AS correct_of_total FROM c""",
)
def agg_refusal(spark, sf_dir):
    """Refusals and answers on questions without evidence, with both denominators."""
    answered = F.col("pred_label") == "ANSWERABLE"
    c = with_hits(spark, sf_dir).where("evidence_condition = 'insufficient'").agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col("pred_label") == "UNANSWERABLE").alias("refused"), n_if(answered).alias("answered"), n_if(answered & F.col("pred_answer").eqNullSafe(F.col("answer"))).alias("answered_correct")
    )
    return c.selectExpr(
        "*", "total - refused - answered AS other", "answered - answered_correct AS answered_wrong", "try_divide(cast(refused AS double), total) AS refusal_rate",
        "try_divide(cast(answered_correct AS double), answered) AS correct_of_answered", "try_divide(cast(answered_correct AS double), total) AS correct_of_total",
    )


def correctness(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """(video_id, qid, ok) of one condition; of repeated replies the last one (by row_id) counts."""
    rows = responses(spark, sf_dir).where(F.col("evidence_condition") == condition)
    ok = rp.field(F.col("v"), "answer").eqNullSafe(F.col("answer"))
    return rows.select("video_id", "qid", "row_id", ok.alias("ok")).groupBy("video_id", "qid").agg(F.max_by("ok", "row_id").alias("ok"))


PAIR_SQL = f"""WITH {RESPONSES_SQL},
one AS (SELECT evidence_condition, video_id, qid, arg_max((v->>'$.answer') IS NOT DISTINCT FROM answer, row_id) AS ok FROM responses WHERE evidence_condition IN ('sufficient', 'insufficient') GROUP BY ALL),
s AS (FROM one WHERE evidence_condition = 'sufficient'), i AS (FROM one WHERE evidence_condition = 'insufficient')"""


@R.add("join_two_results", f"{PAIR_SQL} SELECT coalesce(s.video_id, i.video_id) AS video_id, coalesce(s.qid, i.qid) AS qid, s.ok AS s_ok, i.ok AS i_ok, CASE WHEN i.video_id IS NULL THEN 'only_sufficient' WHEN s.video_id IS NULL THEN 'only_insufficient' ELSE 'both' END AS side FROM s FULL JOIN i ON s.video_id = i.video_id AND s.qid = i.qid")
def join_two_results(spark, sf_dir):
    """Results with and without evidence side by side, with the side a key is found on."""
    s, i = correctness(spark, sf_dir, "sufficient").withColumnRenamed("ok", "s_ok"), correctness(spark, sf_dir, "insufficient").withColumnRenamed("ok", "i_ok")
    side = F.when(F.col("i_ok").isNull(), "only_sufficient").when(F.col("s_ok").isNull(), "only_insufficient").otherwise("both")
    return s.join(i, ["video_id", "qid"], "full_outer").withColumn("side", side)


@R.add("agg_confusion_2x2", f"{PAIR_SQL} SELECT CASE WHEN s.ok AND i.ok THEN 'both_correct' WHEN s.ok THEN 'sufficient_only' WHEN i.ok THEN 'insufficient_only' ELSE 'both_wrong' END AS cell, count(*) AS n FROM s JOIN i ON s.video_id = i.video_id AND s.qid = i.qid GROUP BY ALL")
def agg_confusion_2x2(spark, sf_dir):
    both = join_two_results(spark, sf_dir).where("side = 'both'")
    cell = F.when(F.col("s_ok") & F.col("i_ok"), "both_correct").when(F.col("s_ok"), "sufficient_only").when(F.col("i_ok"), "insufficient_only").otherwise("both_wrong")
    return both.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@R.add("set_intersect", f"{PAIR_SQL} SELECT video_id, qid FROM s INTERSECT SELECT video_id, qid FROM i")
def set_intersect(spark, sf_dir):
    return correctness(spark, sf_dir, "sufficient").select("video_id", "qid").intersect(correctness(spark, sf_dir, "insufficient").select("video_id", "qid"))


@R.add("set_except", f"{PAIR_SQL} SELECT video_id, qid FROM s EXCEPT SELECT video_id, qid FROM i")
def set_except(spark, sf_dir):
    return correctness(spark, sf_dir, "sufficient").select("video_id", "qid").subtract(correctness(spark, sf_dir, "insufficient").select("video_id", "qid"))


@R.add("sort_key_pair", f"{PAIR_SQL} SELECT s.video_id, s.qid, row_number() OVER (ORDER BY s.video_id, TRY_CAST(s.qid AS BIGINT), s.qid) AS place FROM s JOIN i ON s.video_id = i.video_id AND s.qid = i.qid WHERE s.ok AND NOT i.ok ORDER BY place")
def sort_key_pair(spark, sf_dir):
    """The candidates (right with evidence, wrong without) in report order: keys, whole-number qids as numbers and before the others."""
    number = F.col("qid").try_cast("bigint")
    picked = join_two_results(spark, sf_dir).where("s_ok AND NOT i_ok").select("video_id", "qid", number.isNull().alias("text"), number.alias("q"))
    return ranked(picked, [], ["video_id", "text", "q", "qid"], "at").select("video_id", "qid", (F.col("at") + 1).alias("place")).orderBy("place")


@R.add("filt_condition_eq", f"WITH {RESPONSES_SQL} SELECT evidence_condition IS NOT DISTINCT FROM 'partial' AS kept, count(*) AS n FROM responses GROUP BY ALL")
def filt_condition_eq(spark, sf_dir):
    """Rows kept by the condition filter and rows it skips."""
    return responses(spark, sf_dir).groupBy(F.col("evidence_condition").eqNullSafe(F.lit("partial")).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@R.add("proj_condition_for_alpha", f"WITH {RESPONSES_SQL} SELECT row_id, CASE WHEN alpha >= 1 THEN 'C1' WHEN alpha <= 0 THEN 'C3' WHEN alpha IS NOT NULL THEN 'C2' END AS level FROM responses")
def proj_condition_for_alpha(spark, sf_dir):
    return responses(spark, sf_dir).select("row_id", rp.condition_for_alpha(F.col("alpha")).alias("level"))


@R.add("proj_eval_condition", f"WITH {RESPONSES_SQL} SELECT row_id, CASE WHEN alpha IS NOT NULL THEN 'partial' WHEN evidence_condition = 'insufficient' THEN 'insufficient' ELSE evidence_condition END AS eval_condition FROM responses")
def proj_eval_condition(spark, sf_dir):
    c = F.col("evidence_condition")
    return responses(spark, sf_dir).select("row_id", F.when(F.col("alpha").isNotNull(), "partial").when(c == "insufficient", "insufficient").otherwise(c).alias("eval_condition"))


@R.add("fn_alpha_tag", f"WITH {RESPONSES_SQL} SELECT row_id, 'a' || lpad(CAST(CAST(round_even(round(alpha, 2) * 100, 0) AS INT) AS VARCHAR), 3, '0') AS tag FROM responses WHERE alpha IS NOT NULL")
def fn_alpha_tag(spark, sf_dir):
    return responses(spark, sf_dir).where("alpha IS NOT NULL").select("row_id", rp.alpha_tag(F.round("alpha", 2)).alias("tag"))


@R.add("proj_video_file", f"""WITH {RESPONSES_SQL} SELECT row_id, CASE WHEN alpha IS NOT NULL THEN video_id || '_' || qid || '_' || coalesce(partial_mode, 'noise') || '_a' || lpad(CAST(CAST(round_even(round(alpha, 2) * 100, 0) AS INT) AS VARCHAR), 3, '0') || '.mp4'
 WHEN evidence_condition = 'insufficient' THEN video_id || '_' || qid || '.mp4' ELSE video_id || '.mp4' END AS file_name FROM responses""")
def proj_video_file(spark, sf_dir):
    """File name by condition: degraded, without evidence, or whole."""
    key = F.concat_ws("_", "video_id", "qid")
    degraded = F.concat_ws("_", key, F.coalesce("partial_mode", F.lit("noise")), rp.alpha_tag(F.round("alpha", 2)))
    name = F.when(F.col("alpha").isNotNull(), degraded).when(F.col("evidence_condition") == "insufficient", key).otherwise(F.col("video_id"))
    return responses(spark, sf_dir).select("row_id", F.concat(name, F.lit(".mp4")).alias("file_name"))


@R.add("fn_parse_model_json")
def fn_parse_model_json(spark, sf_dir):
    """Raw replies: the JSON object between fences and prose, or the class of the error."""
    rows = responses(spark, sf_dir).select("row_id", rp.model_json(F.col("model_response")).alias("m"))
    return rows.select("row_id", F.col("m.error").alias("error"), F.get_json_object("m.json", "$.label").alias("label"), F.get_json_object("m.json", "$.answer").alias("answer"))


@R.add("fn_normalize_answer", f"WITH {HITS_SQL} SELECT row_id, upper(trim(pred_answer)) AS answer FROM hit")
def fn_normalize_answer(spark, sf_dir):
    return responses(spark, sf_dir).select("row_id", rp.normal_answer(rp.field(F.col("v"), "answer")).alias("answer"))


@R.add("fn_frac", f"WITH {HITS_SQL}, g AS (SELECT condition, count(*) AS total, count(*) FILTER (hit) AS n FROM hit GROUP BY ALL) SELECT condition, CASE WHEN total = 0 THEN '0/0' ELSE n || '/' || total END AS frac, n / total AS rate FROM g")
def fn_frac(spark, sf_dir):
    g = with_hits(spark, sf_dir).groupBy("condition").agg(F.count(F.lit(1)).alias("total"), n_if(F.col("hit")).alias("n"))
    return g.select("condition", F.when(F.col("total") == 0, "0/0").otherwise(F.concat_ws("/", "n", "total")).alias("frac"), rate(F.col("n"), F.col("total")).alias("rate"))


# grounding: the hull of the predicted spans against the gold spans
GROUND_SQL = f"""{HITS_SQL},
hull AS (SELECT row_id, question_type, pred_answer IS NOT DISTINCT FROM answer AS ok, gold, list_min(list_transform(pred, lambda p: least(p.start, p."end"))) AS ps, list_max(list_transform(pred, lambda p: greatest(p.start, p."end"))) AS pe FROM hit WHERE len(pred) > 0 AND len(gold) > 0),
pairs AS (SELECT row_id, question_type, ok, ps, pe, unnest(gold) AS g FROM hull),
scored AS (SELECT row_id, question_type, ok, max(greatest(0, coalesce((least(pe, g."end") - greatest(ps, g.start)) / nullif(greatest(pe, g."end") - least(ps, g.start), 0), 0))) AS iou,
  max(CASE WHEN pe = ps THEN CASE WHEN ps BETWEEN g.start AND g."end" THEN 1.0 ELSE 0.0 END ELSE greatest(0, (least(pe, g."end") - greatest(ps, g.start)) / (pe - ps)) END) AS iop FROM pairs GROUP BY ALL)
"""


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, question_type, ok, iou, iop): best IoU and IoP of the predicted hull over the gold spans; rows without either drop out."""
    rows = with_hits(spark, sf_dir).withColumns({"gold": iv.clean(F.col("evidence_intervals")), "ordered": iv.swap(F.col("pred"))}).where("size(pred) > 0 AND size(gold) > 0")
    hull = iv.span(F.array_min(F.transform("ordered", lambda p: p["start"])), F.array_max(F.transform("ordered", lambda p: p["end"])))
    rows = rows.withColumn("hull", hull)
    return rows.select(
        "row_id", "question_type", F.col("pred_answer").eqNullSafe(F.col("answer")).alias("ok"),
        F.array_max(F.transform("gold", lambda g: iv.tiou(F.col("hull"), g))).alias("iou"), F.array_max(F.transform("gold", lambda g: iv.tiop(F.col("hull"), g))).alias("iop"),
    )


@R.add("iv_tiou_tiop", f"WITH {GROUND_SQL} SELECT row_id, round(iou, 9) AS iou, round(iop, 9) AS iop FROM scored")
def iv_tiou_tiop(spark, sf_dir):
    return grounded(spark, sf_dir).select("row_id", F.round("iou", 9).alias("iou"), F.round("iop", 9).alias("iop"))


@R.add("agg_ground_metrics", f"""WITH {GROUND_SQL} SELECT count(*) AS n, round(100 * avg(iou), 6) AS miou, round(100 * avg(iop), 6) AS miop, round(100 * avg(CASE WHEN iou >= 0.3 THEN 1.0 ELSE 0 END), 6) AS iou_03, round(100 * avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0 END), 6) AS iou_05,
 round(100 * avg(CASE WHEN iop >= 0.3 THEN 1.0 ELSE 0 END), 6) AS iop_03, round(100 * avg(CASE WHEN iop >= 0.5 THEN 1.0 ELSE 0 END), 6) AS iop_05, round(100 * avg(CASE WHEN ok AND iop >= 0.5 THEN 1.0 ELSE 0 END), 6) AS acc_gqa FROM scored""")
def agg_ground_metrics(spark, sf_dir):
    """mIoU, mIoP, their shares at 0.3 and 0.5, and answers right among grounded ones over all; in percent."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return grounded(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), pct(F.col("iou")).alias("miou"), pct(F.col("iop")).alias("miop"), pct(F.col("iou") >= 0.3).alias("iou_03"), pct(F.col("iou") >= 0.5).alias("iou_05"),
        pct(F.col("iop") >= 0.3).alias("iop_03"), pct(F.col("iop") >= 0.5).alias("iop_05"), pct(F.col("ok") & (F.col("iop") >= 0.5)).alias("acc_gqa"),
    )


@R.add("join_gt_pred", f"WITH {GROUND_SQL} SELECT row_id, ps AS pred_start, pe AS pred_end, len(gold) AS n_gold FROM hull")
def join_gt_pred(spark, sf_dir):
    """Predictions with their gold spans; rows without prediction leave the denominator."""
    rows = with_hits(spark, sf_dir).withColumns({"gold": iv.clean(F.col("evidence_intervals")), "ordered": iv.swap(F.col("pred"))}).where("size(pred) > 0 AND size(gold) > 0")
    return rows.select("row_id", F.array_min(F.transform("ordered", lambda p: p["start"])).alias("pred_start"), F.array_max(F.transform("ordered", lambda p: p["end"])).alias("pred_end"), F.size("gold").cast("bigint").alias("n_gold"))


_T = (0.1, 0.2, 0.3, 0.4, 0.5)


@R.add("agg_acc_at_iou", f"WITH {GROUND_SQL} SELECT " + ", ".join(f"round(avg(CASE WHEN ok AND iou >= {t} THEN 1.0 ELSE 0 END), 9) AS acc_{int(t * 10)}, round(avg(CASE WHEN iou >= {t} THEN 1.0 ELSE 0 END), 9) AS rec_{int(t * 10)}" for t in _T) + " FROM scored")
def agg_acc_at_iou(spark, sf_dir):
    """Recall, and accuracy of grounded answers, at IoU 0.1 to 0.5."""
    cols = [F.round(F.avg(c.cast("double")), 9).alias(f"{n}_{int(t * 10)}") for t in _T for n, c in (("acc", F.col("ok") & (F.col("iou") >= t)), ("rec", F.col("iou") >= t))]
    return grounded(spark, sf_dir).agg(*cols)


@R.add("agg_acc_by_type", f"""WITH {HITS_SQL}, j AS (SELECT substr(question_type, 1, 1) AS letter, question_type, pred_answer IS NOT DISTINCT FROM answer AS ok FROM hit WHERE question_type IS NOT NULL)
SELECT coalesce(letter, 'ALL') AS letter, coalesce(question_type, 'ALL') AS question_type, count(*) AS n, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS acc FROM j GROUP BY ROLLUP (letter, question_type)""")
def agg_acc_by_type(spark, sf_dir):
    """Accuracy per type, per first letter of the type, and overall."""
    rows = with_hits(spark, sf_dir).where("question_type IS NOT NULL").select(F.substring("question_type", 1, 1).alias("letter"), "question_type", F.col("pred_answer").eqNullSafe(F.col("answer")).alias("ok"))
    g = rows.rollup("letter", "question_type").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(F.col("ok").cast("double")), 6).alias("acc"))
    return g.select(F.coalesce("letter", F.lit("ALL")).alias("letter"), F.coalesce("question_type", F.lit("ALL")).alias("question_type"), "n", "acc")


@R.add("agg_mc_type_acc", f"WITH {HITS_SQL} SELECT question_type, count(*) AS n, round(avg(CASE WHEN pred_answer IS NOT DISTINCT FROM answer THEN 1.0 ELSE 0 END), 9) AS acc FROM hit GROUP BY ALL")
def agg_mc_type_acc(spark, sf_dir):
    return with_hits(spark, sf_dir).groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pred_answer").eqNullSafe(F.col("answer")).cast("double")), 9).alias("acc"))


@R.add("agg_tvg", f"""WITH {HITS_SQL}, p AS (SELECT row_id, pred[1] AS p, gold[1] AS g FROM hit WHERE len(gold) > 0),
s AS (SELECT greatest(0, coalesce((least(p."end", g."end") - greatest(p.start, g.start)) / nullif(greatest(p."end", g."end") - least(p.start, g.start), 0), 0)) AS iou FROM p)
SELECT count(*) AS n, """ + ", ".join(f"round(avg(CASE WHEN iou >= {t} THEN 1.0 ELSE 0 END), 9) AS f1_{int(t * 10)}" for t in (0.1, 0.3, 0.5, 0.7)) + ", round(avg(iou), 9) AS miou FROM s")
def agg_tvg(spark, sf_dir):
    """First predicted span against the first gold one; a reply without a span counts as 0."""
    rows = with_hits(spark, sf_dir).withColumn("gold", iv.clean(F.col("evidence_intervals"))).where("size(gold) > 0")
    iou = F.coalesce(iv.tiou(F.get("pred", F.lit(0)), F.get("gold", F.lit(0))), F.lit(0.0))
    scored = rows.select(iou.alias("iou"))
    return scored.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("iou") >= t).cast("double")), 9).alias(f"f1_{int(t * 10)}") for t in (0.1, 0.3, 0.5, 0.7)], F.round(F.avg("iou"), 9).alias("miou"))


@R.add("agg_tem", f"""WITH {HITS_SQL}, p AS (SELECT row_id, pred[1] AS p, unnest(gold) AS g FROM hit WHERE len(gold) > 0),
s AS (SELECT row_id, max(greatest(0, coalesce((least(p."end", g."end") - greatest(p.start, g.start)) / nullif(greatest(p."end", g."end") - least(p.start, g.start), 0), 0))) AS iou FROM p GROUP BY ALL)
SELECT count(*) AS n, """ + ", ".join(f"round(avg(CASE WHEN iou >= {t} THEN 1.0 ELSE 0 END), 9) AS r_{int(t * 10)}" for t in (0.1, 0.3, 0.5, 0.7)) + ", round(avg(iou), 9) AS mrec FROM s")
def agg_tem(spark, sf_dir):
    """First predicted span against the best gold one."""
    rows = with_hits(spark, sf_dir).withColumn("gold", iv.clean(F.col("evidence_intervals"))).where("size(gold) > 0")
    best = F.coalesce(F.array_max(F.transform("gold", lambda g: iv.tiou(F.get("pred", F.lit(0)), g))), F.lit(0.0))
    scored = rows.select(best.alias("iou"))
    return scored.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("iou") >= t).cast("double")), 9).alias(f"r_{int(t * 10)}") for t in (0.1, 0.3, 0.5, 0.7)], F.round(F.avg("iou"), 9).alias("mrec"))


@R.add("agg_tal", f"""WITH {HITS_SQL}, base AS (SELECT row_id, pred, gold FROM hit WHERE len(gold) > 0), p AS (SELECT row_id, generate_subscripts(pred, 1) AS pi, unnest(pred) AS p, gold FROM base),
m AS (SELECT row_id, pi, p, generate_subscripts(gold, 1) AS gi, unnest(gold) AS g FROM p), c AS (SELECT row_id, pi, gi, greatest(0, coalesce((least(p."end", g."end") - greatest(p.start, g.start)) / nullif(greatest(p."end", g."end") - least(p.start, g.start), 0), 0)) AS iou FROM m),
rows_ AS (SELECT row_id, pi, max(iou) AS iou FROM c GROUP BY ALL), cols AS (SELECT row_id, gi, max(iou) AS iou FROM c GROUP BY ALL), """
    + ", ".join(f"""f{int(t * 10)} AS (SELECT b.row_id, coalesce((SELECT count(*) FILTER (iou >= {t}) / nullif(count(*), 0) FROM rows_ r WHERE r.row_id = b.row_id), 0) AS p, coalesce((SELECT count(*) FILTER (iou >= {t}) / nullif(count(*), 0) FROM cols c WHERE c.row_id = b.row_id), 0) AS r FROM base b)""" for t in (0.1, 0.3, 0.5, 0.7))
    + " SELECT " + ", ".join(f"(SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) FROM f{int(t * 10)}) AS f1_{int(t * 10)}" for t in (0.1, 0.3, 0.5, 0.7)))
def agg_tal(spark, sf_dir):
    """F1 per reply from the best IoU of every predicted and of every gold span, averaged over all replies."""
    rows = with_hits(spark, sf_dir).withColumn("gold", iv.clean(F.col("evidence_intervals"))).where("size(gold) > 0")
    m = iv.iou_matrix(F.col("pred"), F.col("gold"))
    rows = rows.select("gold", m.alias("m")).select(F.transform("m", lambda r: F.array_max(r)).alias("by_row"), F.transform(F.sequence(F.lit(0), F.size("gold") - 1), lambda k: F.array_max(F.transform("m", lambda r: F.get(r, k)))).alias("by_col"))

    def f1(t: float):
        p = F.coalesce(F.try_divide(F.size(F.filter("by_row", lambda x: x >= t)).cast("double"), F.size("by_row")), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.size(F.filter("by_col", lambda x: x >= t)).cast("double"), F.size("by_col")), F.lit(0.0))
        return F.round(F.avg(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))), 9).alias(f"f1_{int(t * 10)}")

    return rows.agg(*[f1(t) for t in (0.1, 0.3, 0.5, 0.7)])
