"""Anchors: interval algebra, filters with the reasons for rejection, sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import sampling as sm
from strandline.functions import text as tx
from strandline.functions.keys import QID_SQL, VIDEO_SQL, qid_key, video_key
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor row with tidy keys, its usable intervals ``gold`` and the duration ``d`` (null where unknown)."""
    known = F.when(F.col("video_duration") > 0, F.col("video_duration"))
    return table(spark, sf_dir, "cgbench_filtered").withColumns(
        {"video_id": video_key("video_id"), "qid": qid_key("qid"), "gold": F.coalesce(iv.clean(F.col("evidence_intervals")), F.array().cast(f"array<{iv.SPAN}>")), "d": known}
    )


ANCHORS_SQL = f"""
anchors AS (SELECT * EXCLUDE (video_id, qid), {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid,
  coalesce(list_transform(list_filter(evidence_intervals, lambda x: x.start IS NOT NULL AND x."end" IS NOT NULL), lambda x: {{'start': x.start, 'end': x."end"}}), []) AS gold,
  CASE WHEN video_duration > 0 THEN video_duration END AS d FROM cgbench_filtered)
"""


def merged_sql(swap: bool, clip: bool, keep_empty: bool) -> str:
    a, b = ('least(g.start, g."end")', 'greatest(g.start, g."end")') if swap else ("g.start", 'g."end"')
    if clip:
        a, b = f"greatest({a}, 0)", f"least({b}, d)"
    return f"""{ANCHORS_SQL},
flat AS (SELECT row_id, d, unnest(gold) AS g FROM anchors {'WHERE d IS NOT NULL' if clip else ''}),
one AS (SELECT row_id, {a} AS s, {b} AS e FROM flat),
kept AS (SELECT * FROM one {'' if keep_empty else 'WHERE e > s'}),
marked AS (SELECT *, max(e) OVER (PARTITION BY row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM kept),
isles AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
merged AS (SELECT row_id, i, min(s) AS start_s, max(e) AS end_s FROM isles GROUP BY row_id, i)"""


def spans_of(rows: DataFrame, merged) -> DataFrame:
    return rows.select("row_id", F.explode(merged).alias("m")).select("row_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("iv_normalize_clip_merge", f"WITH {merged_sql(True, True, False)} SELECT row_id, start_s, end_s FROM merged")
def iv_normalize_clip_merge(spark, sf_dir):
    """Put in order, cut to the known duration, without empty ones, merged."""
    return spans_of(anchors(spark, sf_dir).where("d IS NOT NULL"), iv.normalize(F.col("gold"), F.col("d")))


@R.add("iv_merge_spans", f"WITH {merged_sql(True, False, True)} SELECT row_id, start_s, end_s FROM merged")
def iv_merge_spans(spark, sf_dir):
    """Put in order and merged; neither cut nor freed of empty ones."""
    return spans_of(anchors(spark, sf_dir), iv.normalize(F.col("gold"), keep_empty=True))


@R.add("iv_merge_noswap", f"WITH {merged_sql(False, False, False)} SELECT row_id, start_s, end_s FROM merged")
def iv_merge_noswap(spark, sf_dir):
    """Merged as they are; reversed and empty intervals drop out."""
    return spans_of(anchors(spark, sf_dir), iv.normalize(F.col("gold"), swapped=False))


@R.add("iv_union_len", f"WITH {merged_sql(True, True, False)} SELECT row_id, round(sum(end_s - start_s), 6) AS union_s FROM merged GROUP BY row_id")
def iv_union_len(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", iv.normalize(F.col("gold"), F.col("d")).alias("m")).where("size(m) > 0")
    return rows.select("row_id", F.round(iv.union_length(F.col("m")), 6).alias("union_s"))


@R.add("iv_norm_et", f'WITH {ANCHORS_SQL}, f AS (SELECT row_id, unnest(gold) AS g FROM anchors) SELECT row_id, g.start AS start_s, g."end" AS end_s FROM f WHERE g."end" > g.start')
def iv_norm_et(spark, sf_dir):
    """Only intervals that end after they start, neither put in order nor merged."""
    return spans_of(anchors(spark, sf_dir), iv.drop_empty(F.col("gold")))


PAIRS_SQL = f"""{ANCHORS_SQL}, f AS (SELECT row_id, generate_subscripts(gold, 1) AS i, unnest(gold) AS g FROM anchors),
pairs AS (SELECT a.row_id, a.i, a.g AS a, b.g AS b FROM f a JOIN f b ON a.row_id = b.row_id AND b.i = a.i + 1)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, i, a, b): each interval with the next one of its row."""
    rows = anchors(spark, sf_dir).select("row_id", "gold", F.posexplode("gold").alias("p", "a"))
    rows = rows.select("row_id", (F.col("p") + 1).cast("bigint").alias("i"), F.col("a").cast(iv.SPAN).alias("a"), F.get("gold", F.col("p") + 1).cast(iv.SPAN).alias("b"))
    return rows.where("b IS NOT NULL")


@R.add("iv_overlap_open", f'WITH {PAIRS_SQL} SELECT row_id, i, greatest(a.start, b.start) < least(a."end", b."end") AS overlap FROM pairs')
def iv_overlap_open(spark, sf_dir):
    return neighbours(spark, sf_dir).select("row_id", "i", iv.overlap_open(F.col("a"), F.col("b")).alias("overlap"))


@R.add("iv_point_in_closed", f'WITH {PAIRS_SQL} SELECT row_id, i, a.start BETWEEN b.start AND b."end" AS inside FROM pairs')
def iv_point_in_closed(spark, sf_dir):
    return neighbours(spark, sf_dir).select("row_id", "i", iv.point_inside(F.col("a.start"), F.col("b")).alias("inside"))


@R.add("iv_iou_dvc", f'WITH {PAIRS_SQL} SELECT row_id, i, round(greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / (least(greatest(a."end", b."end") - least(a.start, b.start), a."end" - a.start + b."end" - b.start) + 1e-8), 6) AS iou FROM pairs WHERE a."end" > a.start AND b."end" > b.start')
def iv_iou_dvc(spark, sf_dir):
    return neighbours(spark, sf_dir).where("a.end > a.start AND b.end > b.start").select("row_id", "i", F.round(iv.iou_captions(F.col("a"), F.col("b")), 6).alias("iou"))


@R.add("iv_iou_batch", f'WITH {PAIRS_SQL} SELECT row_id, i, round(greatest(0, (least(a."end", b."end") - greatest(a.start, b.start) + 1e-10) / (greatest(a."end", b."end") - least(a.start, b.start) + 1e-10)), 6) AS iou FROM pairs')
def iv_iou_batch(spark, sf_dir):
    return neighbours(spark, sf_dir).select("row_id", "i", F.round(iv.iou_smooth(F.col("a"), F.col("b")), 6).alias("iou"))


@R.add("iv_combine", f'WITH {PAIRS_SQL} SELECT row_id, i, least(a.start, b.start) AS hull_start, greatest(a."end", b."end") AS hull_end, CASE WHEN greatest(a.start, b.start) <= least(a."end", b."end") THEN greatest(a.start, b.start) ELSE b.start END AS cut_start, CASE WHEN greatest(a.start, b.start) <= least(a."end", b."end") THEN least(a."end", b."end") ELSE b."end" END AS cut_end FROM pairs')
def iv_combine(spark, sf_dir):
    rows = neighbours(spark, sf_dir).select("row_id", "i", iv.combine_hull(F.col("a"), F.col("b")).alias("h"), iv.combine_cut(F.col("a"), F.col("b")).alias("c"))
    return rows.select("row_id", "i", F.col("h.start").alias("hull_start"), F.col("h.end").alias("hull_end"), F.col("c.start").alias("cut_start"), F.col("c.end").alias("cut_end"))


@R.add("win_lead_gap", f"WITH {merged_sql(True, False, True)} SELECT * FROM (SELECT row_id, end_s, lead(start_s) OVER (PARTITION BY row_id ORDER BY start_s) AS next_start, round(lead(start_s) OVER (PARTITION BY row_id ORDER BY start_s) - end_s, 6) AS gap FROM merged) WHERE next_start IS NOT NULL")
def win_lead_gap(spark, sf_dir):
    """Gap to the next merged span of the row; within the array, so nothing is shuffled."""
    rows = anchors(spark, sf_dir).select("row_id", iv.normalize(F.col("gold"), keep_empty=True).alias("m"))
    rows = rows.select("row_id", F.posexplode(F.transform("m", lambda x, i: F.struct(x["end"].alias("end_s"), F.get("m", i + 1)["start"].alias("next_start")))).alias("p", "x"))
    return rows.where("x.next_start IS NOT NULL").select("row_id", "x.end_s", "x.next_start", F.round(F.col("x.next_start") - F.col("x.end_s"), 6).alias("gap"))


@R.add("iv_longest", f"""WITH {ANCHORS_SQL}, f AS (SELECT row_id, generate_subscripts(gold, 1) AS i, unnest(gold) AS g FROM anchors), o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY g."end" - g.start DESC, i) AS p FROM f)
SELECT row_id, g.start AS start_s, g."end" AS end_s FROM o WHERE p = 1""")
def iv_longest(spark, sf_dir):
    rows = anchors(spark, sf_dir).select("row_id", iv.longest(F.col("gold")).alias("m")).where("m IS NOT NULL")
    return rows.select("row_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


@R.add("iv_vote", f"""WITH {ANCHORS_SQL}, v AS (SELECT row_id, gold, list_transform(gold, lambda x: list_sum(list_transform(gold, lambda y: greatest(0.0::DOUBLE, (least(x."end", y."end") - greatest(x.start, y.start) + 1e-10) / (greatest(x."end", y."end") - least(x.start, y.start) + 1e-10))))) AS votes FROM anchors WHERE len(gold) > 0),
b AS (SELECT row_id, gold[list_position(votes, list_max(votes))] AS m FROM v) SELECT row_id, m.start AS start_s, m."end" AS end_s FROM b""")
def iv_vote(spark, sf_dir):
    """The interval of a row with the greatest summed IoU to all of them."""
    rows = anchors(spark, sf_dir).select("row_id", iv.vote(F.col("gold")).alias("m")).where("m IS NOT NULL")
    return rows.select("row_id", F.col("m.start").alias("start_s"), F.col("m.end").alias("end_s"))


MATRIX_SQL = f"""{ANCHORS_SQL}, f AS (SELECT row_id, generate_subscripts(gold, 1) AS i, unnest(gold) AS g FROM anchors),
cells AS (SELECT a.row_id, a.i - 1 AS i, b.i - 1 AS j, round(greatest(0, coalesce((least(a.g."end", b.g."end") - greatest(a.g.start, b.g.start)) / nullif(greatest(a.g."end", b.g."end") - least(a.g.start, b.g.start), 0), 0)), 6) AS iou FROM f a JOIN f b ON a.row_id = b.row_id)"""


@R.add("iv_temporal_iou_matrix", f"WITH {MATRIX_SQL} SELECT * FROM cells")
def iv_temporal_iou_matrix(spark, sf_dir):
    """IoU of every two intervals of a row, as cells."""
    rows = anchors(spark, sf_dir).select("row_id", F.posexplode(iv.iou_matrix(F.col("gold"), F.col("gold"))).alias("i", "r"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.posexplode("r").alias("j", "iou")).select("row_id", "i", F.col("j").cast("bigint").alias("j"), F.round("iou", 6).alias("iou"))


@R.add("join_iou_pairs", f"WITH {MATRIX_SQL} SELECT * FROM cells WHERE i < j AND iou >= 0.3")
def join_iou_pairs(spark, sf_dir):
    """Pairs of a row's intervals with an IoU of 0.3 or more."""
    return iv_temporal_iou_matrix(spark, sf_dir).where("i < j AND iou >= 0.3")


@R.add("iv_answer_text", f"""WITH {ANCHORS_SQL}, f AS (SELECT row_id, generate_subscripts(gold, 1) AS i, unnest(gold) AS g FROM anchors)
SELECT row_id, string_agg(format('{{:.1f}} - {{:.1f}}', round(g.start, 1), round(g."end", 1)), ' and ' ORDER BY i) || ' seconds' AS text FROM f GROUP BY row_id""")
def iv_answer_text(spark, sf_dir):
    return anchors(spark, sf_dir).where("size(gold) > 0").select("row_id", iv.answer_text(F.col("gold")).alias("text"))


@R.add("iv_enable_expr", f"WITH {merged_sql(True, False, True)} SELECT row_id, string_agg('between(t,' || format('{{:g}}', start_s) || ',' || format('{{:g}}', end_s) || ')', '+' ORDER BY start_s) AS expr FROM merged GROUP BY row_id")
def iv_enable_expr(spark, sf_dir):
    """``between(t,s,e)+...`` over the merged spans, numbers in short form."""
    rows = anchors(spark, sf_dir).select("row_id", iv.normalize(F.col("gold"), keep_empty=True).alias("m")).where("size(m) > 0")
    one = F.array_join(F.transform("m", lambda x: F.concat(F.lit("between(t,"), tx.short_number(x["start"]), F.lit(","), tx.short_number(x["end"]), F.lit(")"))), "+")
    return rows.select("row_id", one.alias("expr"))


@R.add("iv_gauss_prop", "WITH x AS (SELECT row_id, d, 0.5 AS c, evidence_count AS n FROM (SELECT row_id, CASE WHEN video_duration > 0 THEN video_duration END AS d, evidence_count FROM cgbench_filtered) WHERE d IS NOT NULL AND evidence_count > 0) SELECT row_id, round(least(greatest(0.5 - (1.0 / n) / 9.0, 0), 1), 9) AS start_x, round(least(greatest(0.5 + (1.0 / n) / 9.0, 0), 1), 9) AS end_x FROM x")
def iv_gauss_prop(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("d IS NOT NULL AND evidence_count > 0").select("row_id", iv.gauss_window(F.lit(0.5), 1.0 / F.col("evidence_count")).alias("w"))
    return rows.select("row_id", F.round("w.start", 9).alias("start_x"), F.round("w.end", 9).alias("end_x"))


UNIFORM = 128


@R.add("smp_uniform", f"WITH {ANCHORS_SQL} SELECT row_id, i, round((i + 0.5) * d / 8, 6) AS t FROM anchors, range(8) r(i) WHERE d IS NOT NULL")
def smp_uniform(spark, sf_dir):
    """Eight uniform time stamps per row of known duration."""
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", F.posexplode(sm.uniform(F.col("d"), F.lit(8))).alias("i", "t"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.round("t", 6).alias("t"))


@R.add("smp_evidence")
def smp_evidence(spark, sf_dir):
    """32 time stamps, a quarter of them within the evidence."""
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", F.posexplode(sm.evidence(F.col("d"), F.lit(32), iv.drop_empty(iv.swap(F.col("gold"))))).alias("i", "t"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), "t")


COVER_SQL = f"""{ANCHORS_SQL}, cover AS (SELECT row_id, len(gold) = 0 AS no_evidence, d IS NULL AS no_duration,
  coalesce(len(list_filter(gold, lambda g: len(list_filter(range({UNIFORM}), lambda i: (i + 0.5) * d / {UNIFORM} BETWEEN least(g.start, g."end") AND greatest(g.start, g."end"))) > 0)) > 0, false) AS hit FROM anchors)"""


def coverage(spark: SparkSession, sf_dir: str, n: int = UNIFORM) -> DataFrame:
    """Whether any of n uniform time stamps lies in the evidence."""
    hit = F.coalesce(iv.covered(sm.uniform(F.col("d"), F.lit(n)), F.col("gold")), F.lit(False))
    return anchors(spark, sf_dir).select("row_id", (F.size("gold") == 0).alias("no_evidence"), F.col("d").isNull().alias("no_duration"), hit.alias("hit"))


@R.add("iv_coverage_hit", f"WITH {COVER_SQL} SELECT row_id, hit FROM cover WHERE NOT no_evidence AND NOT no_duration")
def iv_coverage_hit(spark, sf_dir):
    return coverage(spark, sf_dir).where("NOT no_evidence AND NOT no_duration").select("row_id", "hit")


@R.add("agg_coverage", f"""WITH {COVER_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (no_evidence) AS skipped_no_evidence, count(*) FILTER (NOT no_evidence AND no_duration) AS skipped_no_duration,
 count(*) FILTER (NOT no_evidence AND NOT no_duration) AS checked, count(*) FILTER (NOT no_evidence AND NOT no_duration AND NOT hit) AS misses FROM cover) SELECT *, round(100.0 * misses / nullif(checked, 0), 6) AS pct FROM c""")
def agg_coverage(spark, sf_dir):
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    c = coverage(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), n("no_evidence", "skipped_no_evidence"), n("NOT no_evidence AND no_duration", "skipped_no_duration"), n("NOT no_evidence AND NOT no_duration", "checked"), n("NOT no_evidence AND NOT no_duration AND NOT hit", "misses"))
    return c.withColumn("pct", F.round(F.try_divide(100.0 * F.col("misses"), F.col("checked").cast("double")), 6))


@R.add("smp_global_frames", f"WITH {ANCHORS_SQL} SELECT row_id, i, CAST(trunc(d * 25 / 16 / 2 + round_even(d * 25 / 16 * i, 0)) AS BIGINT) AS frame FROM anchors, range(16) r(i) WHERE d IS NOT NULL")
def smp_global_frames(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", F.posexplode(sm.global_frames(F.col("d") * 25, F.lit(16))).alias("i", "f"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("f").cast("bigint").alias("frame"))


@R.add("smp_clue_frames")
def smp_clue_frames(spark, sf_dir):
    """32 frames at 1 per second out of the evidence of each row, by the length of its intervals."""
    good = iv.normalize(F.col("gold"), F.col("d"))
    rows = anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", F.posexplode(sm.clue_frames(good, F.lit(1.0), F.lit(32))).alias("i", "f"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("f").cast("bigint").alias("frame"))


@R.add("smp_clips_center", f"WITH {ANCHORS_SQL} SELECT row_id, i, least(CAST(floor(i * (floor(d) / 8) + floor(d) / 16) AS BIGINT), CAST(floor(d) AS BIGINT) - 1) AS frame FROM anchors, range(8) r(i) WHERE d >= 8")
def smp_clips_center(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("d >= 8").select("row_id", F.posexplode(sm.clip_centers(F.floor("d"), F.lit(8))).alias("i", "f"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("f").cast("bigint").alias("frame"))


@R.add("smp_uniF", f"WITH {ANCHORS_SQL} SELECT row_id, i, CAST(trunc(i * (floor(d) - 1) / 31) AS BIGINT) AS frame FROM anchors, range(32) r(i) WHERE d >= 33")
def smp_unif(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("d >= 33").select("row_id", F.posexplode(sm.line_positions(F.floor("d").cast("int"), F.lit(32))).alias("i", "f"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("f").cast("bigint").alias("frame"))


@R.add("smp_frame_to_time", f"WITH {ANCHORS_SQL} SELECT row_id, round_even(evidence_count / 29.97, 4) AS t FROM anchors WHERE evidence_count IS NOT NULL")
def smp_frame_to_time(spark, sf_dir):
    return anchors(spark, sf_dir).where("evidence_count IS NOT NULL").select("row_id", sm.frame_time(F.col("evidence_count"), F.lit(29.97)).alias("t"))


ALPHAS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)


@R.add("cross_alphas", f"WITH {ANCHORS_SQL} SELECT row_id, a.alpha FROM anchors, (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha) a")
def cross_alphas(spark, sf_dir):
    """Every anchor at every level, by an array in the row and not by a join."""
    return anchors(spark, sf_dir).select("row_id", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alpha"))


@R.add("cross_choices", f"WITH {ANCHORS_SQL} SELECT row_id, generate_subscripts(choices, 1) - 1 AS i, unnest(choices) AS choice FROM anchors")
def cross_choices(spark, sf_dir):
    return anchors(spark, sf_dir).select("row_id", F.posexplode("choices").alias("i", "choice")).withColumn("i", F.col("i").cast("bigint"))


# filters: one chain with the first reason, and independent counts


FUNNEL = ["no_question", "no_choices", "unknown_duration", "no_intervals", "length_out_of_range", "coverage_too_high"]
FUNNEL_SQL = f"""{merged_sql(True, False, False)},
lens AS (SELECT row_id, min(end_s - start_s) AS shortest, max(end_s - start_s) AS longest, sum(end_s - start_s) AS covered, min(gap) AS gap, count(*) AS n FROM
  (SELECT row_id, start_s, end_s, lead(start_s) OVER (PARTITION BY row_id ORDER BY start_s) - end_s AS gap FROM merged) GROUP BY row_id),
checks AS (SELECT a.row_id, a.question_type, a.evidence_condition, a.evidence_count, a.video_id, a.qid, trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')) = '' AS c1, coalesce(len(choices), 0) = 0 OR len(list_filter(choices, lambda x: x IS NULL OR trim(x) = '')) > 0 AS c2,
  d IS NULL AS c3, l.n IS NULL AS c4, coalesce(shortest < 3 OR longest > 300, false) AS c5, coalesce(covered / d > 0.6, false) AS c6, coalesce(gap < 3, false) AS close, coalesce(n, 0) AS n
  FROM anchors a LEFT JOIN lens l USING (row_id)),
funnel AS (SELECT *, CASE WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c3 THEN 3 WHEN c4 THEN 4 WHEN c5 THEN 5 WHEN c6 THEN 6 ELSE 7 END AS stage FROM checks)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor with its six checks c1..c6 (true: fails), ``close`` (a gap below 3 s) and the first failing stage (7: none)."""
    rows = anchors(spark, sf_dir).withColumn("m", iv.normalize(F.col("gold")))
    length = F.transform("m", lambda x: x["end"] - x["start"])
    gap = F.transform("m", lambda x, i: F.get("m", i + 1)["start"] - x["end"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns(
        {
            "c1": tx.clean_text(F.coalesce("question", F.lit(""))) == "",
            "c2": (F.coalesce(F.size("choices"), F.lit(0)) <= 0) | yes(F.exists("choices", lambda x: x.isNull() | (F.trim(x) == ""))),
            "c3": F.col("d").isNull(),
            "c4": F.size("m") == 0,
            "c5": yes(F.exists(length, lambda x: (x < 3) | (x > 300))),
            "c6": yes(iv.union_length(F.col("m")) / F.col("d") > 0.6),
            "close": yes(F.array_min(gap) < 3),
            "n": F.size("m").cast("bigint"),
        }
    )
    stage = F.lit(7)
    for k in range(6, 0, -1):
        stage = F.when(F.col(f"c{k}"), k).otherwise(stage)
    return rows.select("row_id", "question_type", "evidence_condition", "evidence_count", "video_id", "qid", *[f"c{k}" for k in range(1, 7)], "close", "n", stage.cast("bigint").alias("stage"))


_REASON_SQL = "CASE stage " + " ".join(f"WHEN {k + 1} THEN '{r}'" for k, r in enumerate(FUNNEL)) + " ELSE 'kept' END"


def reason():
    out = F.lit("kept")
    for k, r in enumerate(FUNNEL):
        out = F.when(F.col("stage") == k + 1, r).otherwise(out)
    return out


@R.add("filt_chain_first_fail", f"WITH {FUNNEL_SQL} SELECT row_id, {_REASON_SQL} AS reason FROM funnel")
def filt_chain_first_fail(spark, sf_dir):
    return checks(spark, sf_dir).select("row_id", reason().alias("reason"))


@R.add("agg_funnel", f"WITH {FUNNEL_SQL} SELECT k AS stage, count(*) FILTER (stage > k) AS n FROM funnel, range(7) r(k) GROUP BY k")
def agg_funnel(spark, sf_dir):
    """Rows left after each stage, from one aggregation."""
    one = checks(spark, sf_dir).agg(*[F.count_if(F.col("stage") > k).alias(f"n{k}") for k in range(7)])
    return one.select(F.posexplode(F.array(*[f"n{k}" for k in range(7)])).alias("stage", "n")).select(F.col("stage").cast("bigint").alias("stage"), "n")


@R.add("agg_reject_reasons", f"WITH {FUNNEL_SQL} SELECT {_REASON_SQL} AS reason, count(*) AS n FROM funnel WHERE stage < 7 GROUP BY ALL")
def agg_reject_reasons(spark, sf_dir):
    return checks(spark, sf_dir).where("stage < 7").groupBy(reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add("agg_indep_fail_counts", f"WITH {FUNNEL_SQL} SELECT " + ", ".join(f"count(*) FILTER (c{k + 1}) AS {r}" for k, r in enumerate(FUNNEL)) + ", count(*) FILTER (close) AS gap_too_small FROM funnel")
def agg_indep_fail_counts(spark, sf_dir):
    return checks(spark, sf_dir).agg(*[F.count_if(F.col(f"c{k + 1}")).alias(r) for k, r in enumerate(FUNNEL)], F.count_if("close").alias("gap_too_small"))


@R.add("filt_independent_fail", f"WITH {FUNNEL_SQL} SELECT row_id FROM funnel WHERE NOT (c3 OR c5 OR c6 OR close)")
def filt_independent_fail(spark, sf_dir):
    return checks(spark, sf_dir).where("NOT (c3 OR c5 OR c6 OR close)").select("row_id")


for _id, _c in {"filt_question_nonempty": "c1", "filt_options_complete": "c2", "filt_duration_valid": "c3", "filt_interval_bounds": "c5", "filt_coverage": "c6", "filt_adjacent_gap": "close"}.items():

    @R.add(_id, f"WITH {FUNNEL_SQL} SELECT row_id FROM funnel WHERE NOT {_c}")
    def _one(spark, sf_dir, c=_c):
        return checks(spark, sf_dir).where(~F.col(c)).select("row_id")


@R.add("filt_clue_count", f"WITH {ANCHORS_SQL} SELECT row_id FROM anchors WHERE len(gold) >= 2")
def filt_clue_count(spark, sf_dir):
    return anchors(spark, sf_dir).where("size(gold) >= 2").select("row_id")


@R.add("filt_min_count_by_task", f"WITH {ANCHORS_SQL} SELECT row_id FROM anchors WHERE len(gold) >= CASE WHEN source_task = 'Hallucination' THEN 1 ELSE 2 END")
def filt_min_count_by_task(spark, sf_dir):
    return anchors(spark, sf_dir).where("size(gold) >= CASE WHEN source_task = 'Hallucination' THEN 1 ELSE 2 END").select("row_id")


@R.add("filt_clue_ratio", f'WITH {ANCHORS_SQL} SELECT row_id FROM anchors WHERE NOT coalesce(round(list_sum(list_transform(gold, lambda g: g."end" - g.start)) / d, 9) > 0.4, false)')
def filt_clue_ratio(spark, sf_dir):
    """Plain sum of the lengths over the duration not above 0.4; unknown durations pass."""
    ratio = F.round(iv.union_length(F.col("gold")) / F.col("d"), 9)
    return anchors(spark, sf_dir).where(~F.coalesce(ratio > 0.4, F.lit(False))).select("row_id")


@R.add("filt_hallucination", f"WITH {ANCHORS_SQL} SELECT row_id, regexp_matches(lower(question_type), 'hallucination|illusion') AS special FROM anchors")
def filt_hallucination(spark, sf_dir):
    return anchors(spark, sf_dir).select("row_id", F.lower("question_type").rlike("hallucination|illusion").alias("special"))


@R.add("filt_english", f"WITH {ANCHORS_SQL} SELECT row_id FROM anchors WHERE length(regexp_replace(question, '[^\\x00-\\x7F]', '', 'g')) / nullif(length(question), 0) >= 0.8")
def filt_english(spark, sf_dir):
    return anchors(spark, sf_dir).where(tx.ascii_share(F.col("question")) >= 0.8).select("row_id")


@R.add("agg_type_dist", f"WITH {ANCHORS_SQL} SELECT question_type, count(*) AS n FROM anchors GROUP BY ALL")
def agg_type_dist(spark, sf_dir):
    return anchors(spark, sf_dir).groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("agg_evidence_bucket", f"WITH {ANCHORS_SQL} SELECT CASE WHEN len(gold) <= 3 THEN CAST(len(gold) AS VARCHAR) ELSE '4+' END AS bucket, count(*) AS n FROM anchors GROUP BY ALL")
def agg_evidence_bucket(spark, sf_dir):
    size = F.size("gold")
    return anchors(spark, sf_dir).groupBy(F.when(size <= 3, size.cast("string")).otherwise("4+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.add("agg_distinct_videos", f"WITH {ANCHORS_SQL} SELECT count(DISTINCT video_id) AS n FROM anchors")
def agg_distinct_videos(spark, sf_dir):
    return anchors(spark, sf_dir).agg(F.countDistinct("video_id").alias("n"))


@R.add("proj_question_type", f"WITH {ANCHORS_SQL} SELECT row_id, CASE WHEN regexp_matches(lower(source_task), 'perception|entity|text') THEN 'Perception' WHEN regexp_matches(lower(source_task), 'cognition|reason') THEN 'Reasoning' ELSE source_task END AS kind FROM anchors")
def proj_question_type(spark, sf_dir):
    kind = tx.keyword_class(F.col("source_task"), [("Perception", ["perception", "entity", "text"]), ("Reasoning", ["cognition", "reason"])], F.col("source_task"))
    return anchors(spark, sf_dir).select("row_id", kind.alias("kind"))


@R.add("proj_anchor_record", f"""WITH {ANCHORS_SQL} SELECT row_id, video_id, qid, coalesce(source_dataset, 'cgbench') AS source_dataset, question, len(choices) AS n_choices, answer, len(gold) AS evidence_count, coalesce(d, 0.0) AS video_duration, question_type, source_task,
 coalesce(evidence_condition, 'sufficient') AS evidence_condition, 'answer' AS expected_behavior FROM anchors""")
def proj_anchor_record(spark, sf_dir):
    """The record of an anchor with defaults for what is missing and the count that its intervals have."""
    return anchors(spark, sf_dir).select(
        "row_id", "video_id", "qid", F.coalesce("source_dataset", F.lit("cgbench")).alias("source_dataset"), "question", F.when(F.col("choices").isNotNull(), F.size("choices")).cast("bigint").alias("n_choices"), "answer",
        F.size("gold").cast("bigint").alias("evidence_count"), F.coalesce("d", F.lit(0.0)).alias("video_duration"), "question_type", "source_task", F.coalesce("evidence_condition", F.lit("sufficient")).alias("evidence_condition"), F.lit("answer").alias("expected_behavior"),
    )


@R.add("proj_anchor_legacy", f"WITH {ANCHORS_SQL} SELECT row_id, video_id, source_dataset, question, answer, len(gold) AS evidence_count, video_duration, question_type, source_task, evidence_condition, expected_behavior FROM anchors")
def proj_anchor_legacy(spark, sf_dir):
    return anchors(spark, sf_dir).select("row_id", "video_id", "source_dataset", "question", "answer", F.size("gold").cast("bigint").alias("evidence_count"), "video_duration", "question_type", "source_task", "evidence_condition", "expected_behavior")


@R.add("fn_join_answer_list", f"WITH {ANCHORS_SQL} SELECT row_id, array_to_string(choices, '; ') AS text FROM anchors WHERE choices IS NOT NULL")
def fn_join_answer_list(spark, sf_dir):
    return anchors(spark, sf_dir).where("choices IS NOT NULL").select("row_id", F.array_join("choices", "; ").alias("text"))


@R.add("val_final_invariants", f"""WITH {ANCHORS_SQL}, k AS (SELECT video_id, qid, count(*) AS n FROM anchors GROUP BY ALL) SELECT (SELECT count(*) FROM anchors WHERE evidence_condition NOT IN ('sufficient', 'Hallucination') OR evidence_condition IS NULL) AS bad_condition,
 (SELECT count(*) FROM anchors WHERE evidence_count IS DISTINCT FROM len(evidence_intervals)) AS bad_count, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys""")
def val_final_invariants(spark, sf_dir):
    """Violations of each invariant; a caller raises where one is not 0."""
    rows = anchors(spark, sf_dir)
    size = F.when(F.col("evidence_intervals").isNotNull(), F.size("evidence_intervals"))
    a = rows.agg(F.count_if(~F.coalesce(F.col("evidence_condition").isin("sufficient", "Hallucination"), F.lit(False))).alias("bad_condition"), F.count_if(~F.col("evidence_count").eqNullSafe(size)).alias("bad_count"))
    b = rows.groupBy("video_id", "qid").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return a.join(F.broadcast(b))  # one row each


@R.add("sort_by_interval_count", f"WITH {ANCHORS_SQL} SELECT row_id, len(gold) AS n FROM anchors ORDER BY n DESC, row_id")
def sort_by_interval_count(spark, sf_dir):
    return anchors(spark, sf_dir).select("row_id", F.size("gold").cast("bigint").alias("n")).orderBy(F.desc("n"), "row_id")


@R.add("limit_head", f"WITH {ANCHORS_SQL} SELECT row_id FROM anchors WHERE row_id % 4 = 1 ORDER BY row_id LIMIT 25")
def limit_head(spark, sf_dir):
    """The first 25 rows of shard 1 of 4: the limit comes after sharding."""
    return anchors(spark, sf_dir).where(F.pmod("row_id", F.lit(4)) == 1).select("row_id").orderBy("row_id").limit(25)


@R.add("orch_shard", f"WITH {ANCHORS_SQL} SELECT row_id % 8 AS shard, count(*) AS n, min(row_id) AS first FROM anchors GROUP BY ALL")
def orch_shard(spark, sf_dir):
    return anchors(spark, sf_dir).groupBy(F.pmod("row_id", F.lit(8)).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


_LAST = f"""WITH {ANCHORS_SQL}, k AS (SELECT row_id, video_id, qid, loaded_at, row_number() OVER (PARTITION BY video_id, qid ORDER BY loaded_at DESC, row_id DESC) AS last, row_number() OVER (PARTITION BY video_id, qid ORDER BY loaded_at, row_id) AS first FROM anchors)"""


@R.add("win_dedup_last", f"{_LAST} SELECT row_id, video_id, qid FROM k WHERE last = 1")
def win_dedup_last(spark, sf_dir):
    """The last load of each key; an aggregation, so a hot key is reduced before the shuffle."""
    return anchors(spark, sf_dir).groupBy("video_id", "qid").agg(F.max(F.struct("loaded_at", "row_id")).alias("m")).select("m.row_id", "video_id", "qid")


@R.add("win_dedup_first", f"{_LAST} SELECT row_id, video_id, qid FROM k WHERE first = 1")
def win_dedup_first(spark, sf_dir):
    return anchors(spark, sf_dir).groupBy("video_id", "qid").agg(F.min(F.struct("loaded_at", "row_id")).alias("m")).select("m.row_id", "video_id", "qid")


@R.add("iv_set_iou", f"""WITH {ANCHORS_SQL}, s AS (SELECT row_id, gold FROM anchors WHERE len(gold) >= 2),
sides AS (SELECT row_id, 'a' AS side, unnest(gold[1:CAST(len(gold) // 2 AS INT)]) AS g FROM s UNION ALL SELECT row_id, 'b', unnest(gold[CAST(len(gold) // 2 AS INT) + 1:]) FROM s),
marked AS (SELECT row_id, side, g.start AS s, g."end" AS e, max(g."end") OVER (PARTITION BY row_id, side ORDER BY g.start, g."end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sides WHERE g."end" > g.start),
isles AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, side ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
m AS (SELECT row_id, side, i, min(s) AS s, max(e) AS e FROM isles GROUP BY ALL), l AS (SELECT row_id, sum(e - s) AS total FROM m GROUP BY ALL),
x AS (SELECT a.row_id, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS inter FROM m a JOIN m b ON a.row_id = b.row_id AND a.side = 'a' AND b.side = 'b' GROUP BY ALL)
SELECT s.row_id, round(CASE WHEN total - coalesce(inter, 0) > 0 THEN coalesce(inter, 0) / (total - coalesce(inter, 0)) ELSE 0 END, 6) AS iou FROM s LEFT JOIN l USING (row_id) LEFT JOIN x USING (row_id)""")
def iv_set_iou(spark, sf_dir):
    """IoU of the first and the second half of a row's intervals as sets."""
    rows = anchors(spark, sf_dir).where("size(gold) >= 2").select("row_id", F.expr("slice(gold, 1, size(gold) div 2)").alias("a"), F.expr("slice(gold, size(gold) div 2 + 1, size(gold))").alias("b"))
    return rows.select("row_id", F.round(iv.set_iou(iv.drop_empty(F.col("a")), iv.drop_empty(F.col("b"))), 6).alias("iou"))


@R.add("iv_frame_mask_f1", f"""WITH {ANCHORS_SQL}, s AS (SELECT row_id, gold FROM anchors WHERE len(gold) >= 2),
f AS (SELECT row_id, 'a' AS side, unnest(gold[1:CAST(len(gold) // 2 AS INT)]) AS g FROM s UNION ALL SELECT row_id, 'b', unnest(gold[CAST(len(gold) // 2 AS INT) + 1:]) FROM s),
cells AS (SELECT DISTINCT row_id, side, unnest(range(greatest(CAST(round_even(g.start, 0) AS BIGINT), 0), least(CAST(round_even(g."end", 0) AS BIGINT), 1000))) AS c FROM f),
n AS (SELECT row_id, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM cells GROUP BY ALL), t AS (SELECT x.row_id, count(*) AS tp FROM cells x JOIN cells y ON x.row_id = y.row_id AND x.c = y.c AND x.side = 'a' AND y.side = 'b' GROUP BY ALL)
SELECT s.row_id, round(coalesce(2.0 * coalesce(tp, 0) / nullif(a + b, 0), 0), 6) AS f1 FROM s LEFT JOIN n USING (row_id) LEFT JOIN t USING (row_id)""")
def iv_frame_mask_f1(spark, sf_dir):
    rows = anchors(spark, sf_dir).where("size(gold) >= 2").select("row_id", F.expr("slice(gold, 1, size(gold) div 2)").alias("a"), F.expr("slice(gold, size(gold) div 2 + 1, size(gold))").alias("b"))
    return rows.select("row_id", F.round(iv.mask_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@R.add("agg_evs", "WITH " + R.sql["iv_frame_mask_f1"][5:].replace("SELECT s.row_id, round(coalesce(2.0", ", f1s AS (SELECT s.row_id, round(coalesce(2.0", 1).replace("GROUP BY ALL)\n, f1s", "GROUP BY ALL), f1s") + ") SELECT count(*) AS n, round(avg(f1), 6) AS f1 FROM f1s")
def agg_evs(spark, sf_dir):
    """Mean mask F1 over the rows that have one."""
    return iv_frame_mask_f1(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1"))
