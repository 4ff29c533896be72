"""Questions with options: text matching, joins to grounding, vocabularies and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sampling as sm
from strandline.functions import text as tx
from strandline.functions.keys import QID_SQL, VIDEO_SQL, qid_key, video_key
from strandline.operators.ranks import ranked, running_sum
from strandline.plans.registry import Registry
from strandline.session import stored, table

R = Registry()
OPTIONS = ["a0", "a1", "a2", "a3", "a4"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test").withColumns({"video_id": video_key("video_id"), "qid": qid_key("qid"), "options": F.array(*OPTIONS)})


QUESTIONS_SQL = f"questions AS (SELECT * EXCLUDE (video_id, qid), {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid, [a0, a1, a2, a3, a4] AS options FROM test)"
_CLEAN = "trim(regexp_replace({0}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_HITS = f"list_filter(list_transform(range(5), lambda i: CASE WHEN lower({_CLEAN.format('options[i + 1]')}) = lower({_CLEAN.format('answer')}) THEN i END), lambda i: i IS NOT NULL)"


@R.add("fn_clean_text", f"WITH {QUESTIONS_SQL} SELECT row_id, {_CLEAN.format('question')} AS text FROM questions")
def fn_clean_text(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", tx.clean_text(F.col("question")).alias("text"))


@R.add("fn_match_answer_index", f"WITH {QUESTIONS_SQL}, h AS (SELECT row_id, {_HITS} AS h FROM questions) SELECT row_id, len(h) AS n, CASE WHEN len(h) = 1 THEN h[1] END AS i FROM h")
def fn_match_answer_index(spark, sf_dir):
    rows = questions(spark, sf_dir).select("row_id", tx.match_options(F.col("answer"), F.col("options")).alias("h"))
    return rows.select("row_id", F.size("h").cast("bigint").alias("n"), F.when(F.size("h") == 1, F.get("h", F.lit(0))).cast("bigint").alias("i"))


@R.add("fn_index_to_letter", f"WITH {QUESTIONS_SQL}, h AS (SELECT row_id, {_HITS} AS h FROM questions) SELECT row_id, CASE WHEN len(h) = 1 THEN chr(CAST(65 + h[1] AS INT)) END AS letter, CASE WHEN len(h) = 1 AND h[1] + 1 <= 4 THEN chr(CAST(66 + h[1] AS INT)) END AS next FROM h")
def fn_index_to_letter(spark, sf_dir):
    """The letter of each question's only matching option, and the one after it; none beyond the fifth."""
    rows = questions(spark, sf_dir).select("row_id", tx.unique_option(F.col("answer"), F.col("options")).alias("i"))
    return rows.select("row_id", tx.letter(F.col("i")).alias("letter"), tx.letter(F.col("i") + 1).alias("next"))


@R.add("fn_resolve_answer", f"WITH {QUESTIONS_SQL}, h AS (SELECT row_id, {_HITS} AS h, {_CLEAN.format('answer')} AS text FROM questions) SELECT row_id, CASE WHEN len(h) = 1 THEN chr(CAST(65 + h[1] AS INT)) ELSE text END AS answer, len(h) = 1 AS matched FROM h")
def fn_resolve_answer(spark, sf_dir):
    rows = questions(spark, sf_dir).select("row_id", "answer", tx.match_options(F.col("answer"), F.col("options")).alias("h"))
    one = F.size("h") == 1
    return rows.select("row_id", F.when(one, tx.letter(F.get("h", F.lit(0)))).otherwise(tx.clean_text(F.col("answer"))).alias("answer"), one.alias("matched"))


@R.add("proj_qsn_type", f"""WITH {QUESTIONS_SQL}, w AS (SELECT row_id, list_filter(regexp_split_to_array(lower(trim(question)), '\\s+'), lambda x: x <> '') AS w FROM questions)
SELECT row_id, CASE WHEN w[1] = 'what' THEN CASE WHEN w[2] IN ('does', 'do', 'did') THEN 'whata' WHEN w[2] IN ('was', 'were', 'is', 'are') THEN 'whatb' ELSE 'whato' END WHEN w[1] = 'how' AND w[2] = 'many' THEN 'howm' WHEN w[1] IN ('who', 'which', 'why', 'how', 'where') THEN w[1] ELSE 'other' END AS kind FROM w""")
def proj_qsn_type(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", tx.question_kind(F.col("question")).alias("kind"))


@R.add("proj_merge_type", f"WITH {QUESTIONS_SQL} SELECT CASE WHEN \"type\" = 'TP' THEN 'TN' ELSE \"type\" END AS kind, count(*) AS n FROM questions GROUP BY ALL")
def proj_merge_type(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(F.when(F.col("type") == "TP", "TN").otherwise(F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add("filt_prefix_D", f"WITH {QUESTIONS_SQL} SELECT row_id FROM questions WHERE NOT starts_with(\"type\", 'D')")
def filt_prefix_d(spark, sf_dir):
    return questions(spark, sf_dir).where(~F.col("type").startswith("D")).select("row_id")


@R.add("filt_type_in", f"WITH {QUESTIONS_SQL} SELECT row_id FROM questions WHERE \"type\" IN ('TN', 'TC', 'TP', 'CW', 'CH')")
def filt_type_in(spark, sf_dir):
    return questions(spark, sf_dir).where(F.col("type").isin("TN", "TC", "TP", "CW", "CH")).select("row_id")


@R.add("filt_contains_blank", f"WITH {QUESTIONS_SQL} SELECT contains(question, '_____') AS has_blank, count(*) AS n FROM questions GROUP BY ALL")
def filt_contains_blank(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(F.col("question").contains("_____").alias("has_blank")).agg(F.count(F.lit(1)).alias("n"))


@R.add("filt_short_strings", f"WITH {QUESTIONS_SQL} SELECT row_id, len(list_filter(options, lambda x: length(x) > 14)) AS n FROM questions")
def filt_short_strings(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", F.size(F.filter("options", lambda x: F.length(x) > 14)).cast("bigint").alias("n"))


@R.add("filt_task_in", "SELECT row_id FROM eval_result WHERE task IN ('classify', 'open')")
def filt_task_in(spark, sf_dir):
    return table(spark, sf_dir, "eval_result").where(F.col("task").isin("classify", "open")).select("row_id")


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, qid, duration, pairs): the last load of each video's grounding, one row per question."""
    g = table(spark, sf_dir, "gsub_test").withColumn("video_id", video_key("video_id"))
    last = g.groupBy("video_id").agg(F.max_by(F.struct("duration", "location", "fps"), F.struct("loaded_at", "row_id")).alias("x"))
    rows = last.select("video_id", "x.duration", F.explode("x.location").alias("qid", "pairs"))
    return rows.select("video_id", qid_key("qid").alias("qid"), "duration", "pairs")


GROUNDING_SQL = f"""{QUESTIONS_SQL}, last AS (SELECT {VIDEO_SQL.format('video_id')} AS video_id, duration, location FROM gsub_test QUALIFY row_number() OVER (PARTITION BY {VIDEO_SQL.format('video_id')} ORDER BY loaded_at DESC, row_id DESC) = 1),
grounding AS (SELECT video_id, {QID_SQL.format('k')} AS qid, duration, pairs FROM (SELECT video_id, duration, unnest(map_keys(location)) AS k, unnest(map_values(location)) AS pairs FROM last))"""


@R.add("join_grounding", f"WITH {GROUNDING_SQL} SELECT q.row_id, g.duration, len(g.pairs) AS n_pairs, g.video_id IS NOT NULL AS found FROM questions q LEFT JOIN grounding g ON q.video_id = g.video_id AND q.qid = g.qid")
def join_grounding(spark, sf_dir):
    """Questions with their grounding, found or not."""
    g = grounding(spark, sf_dir).withColumn("found", F.lit(True))
    return questions(spark, sf_dir).select("row_id", "video_id", "qid").join(g, ["video_id", "qid"], "left").select(
        "row_id", "duration", F.when(F.col("pairs").isNotNull(), F.size("pairs")).cast("bigint").alias("n_pairs"), F.coalesce("found", F.lit(False)).alias("found")
    )


@R.add("join_mapping", f"WITH {GROUNDING_SQL} SELECT row_id, EXISTS (SELECT 1 FROM last l WHERE l.video_id = q.video_id) AS mapped FROM questions q")
def join_mapping(spark, sf_dir):
    known = table(spark, sf_dir, "gsub_test").select(video_key("video_id").alias("video_id"), F.lit(True).alias("m")).distinct()
    return questions(spark, sf_dir).select("row_id", "video_id").join(known, "video_id", "left").select("row_id", F.coalesce("m", F.lit(False)).alias("mapped"))


@R.add("join_coverage_stats", f"""WITH {GROUNDING_SQL}, h AS (SELECT q.*, len({_HITS}) AS n_hits FROM questions q), k AS (SELECT video_id, qid, count(*) AS n FROM questions GROUP BY ALL)
SELECT count(*) AS total, (SELECT sum(n - 1)::BIGINT FROM k) AS duplicates, count(*) FILTER (NOT EXISTS (SELECT 1 FROM grounding g WHERE g.video_id = h.video_id AND g.qid = h.qid)) AS missing_grounding,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM last l WHERE l.video_id = h.video_id)) AS missing_video, count(*) FILTER (n_hits = 0) AS no_match, count(*) FILTER (n_hits > 1) AS several_matches FROM h""")
def join_coverage_stats(spark, sf_dir):
    """Counts of repeated keys, missing grounding and answers that match no or several options."""
    g = join_grounding(spark, sf_dir).join(join_mapping(spark, sf_dir), "row_id").join(fn_match_answer_index(spark, sf_dir), "row_id")
    a = g.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("found")).alias("missing_grounding"), F.count_if(~F.col("mapped")).alias("missing_video"), F.count_if(F.col("n") == 0).alias("no_match"), F.count_if(F.col("n") > 1).alias("several_matches"))
    d = questions(spark, sf_dir).groupBy("video_id", "qid").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("duplicates"))
    return a.join(F.broadcast(d))  # one row each


@R.add("val_multi_interval_example", f"WITH {GROUNDING_SQL} SELECT video_id, qid, len(pairs) AS n FROM grounding WHERE len(pairs) >= 2 ORDER BY video_id, qid LIMIT 1")
def val_multi_interval_example(spark, sf_dir):
    return grounding(spark, sf_dir).where("size(pairs) >= 2").select("video_id", "qid", F.size("pairs").cast("bigint").alias("n")).orderBy("video_id", "qid").limit(1)  # one example


@R.add("agg_required_qids", f"WITH {QUESTIONS_SQL} SELECT video_id, array_to_string(list_transform(list_sort(list_distinct(list({{'text': NOT regexp_full_match(qid, '[0-9]+'), 'n': coalesce(TRY_CAST(qid AS BIGINT), 0), 'q': qid}}))), lambda x: x.q), ',') AS qids FROM questions GROUP BY video_id")
def agg_required_qids(spark, sf_dir):
    """The distinct qids of each video: whole numbers by value, then texts. As long as a video has questions; the pairs are made distinct first."""
    pairs = questions(spark, sf_dir).select("video_id", "qid").distinct()
    key = F.struct((~F.col("qid").rlike("^[0-9]+$")).alias("text"), F.coalesce(F.col("qid").try_cast("bigint"), F.lit(0)).alias("n"), F.col("qid").alias("q"))
    return pairs.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["q"]), ",").alias("qids"))


@R.add("proj_distinct_ids", f"WITH {QUESTIONS_SQL} SELECT DISTINCT video_id FROM questions")
def proj_distinct_ids(spark, sf_dir):
    return questions(spark, sf_dir).select("video_id").distinct()


VOCAB_SQL = f"{QUESTIONS_SQL}, vocab AS (SELECT answer, count(*) AS n, min(row_id) AS first, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS place FROM questions WHERE answer IS NOT NULL GROUP BY answer)"


def vocabulary(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k most common answers with their place; ties go to the one seen first. Counted before anything is ordered."""
    counts = questions(spark, sf_dir).where("answer IS NOT NULL").groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(k)  # the vocabulary's size is the feature
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint"))


#: Size of the reference's vocabulary.
VOCABULARY = 1000


@R.add("agg_vocab_topk", f"WITH {VOCAB_SQL} SELECT answer, n, place - 1 AS id FROM vocab WHERE place <= {VOCABULARY}")
def agg_vocab_topk(spark, sf_dir):
    return vocabulary(spark, sf_dir, VOCABULARY).select("answer", "n", (F.col("place") - 1).alias("id"))


@R.add("topk_k", f"WITH {VOCAB_SQL} SELECT answer, n FROM vocab WHERE place <= 5")
def topk_k(spark, sf_dir):
    return vocabulary(spark, sf_dir, 5).select("answer", "n")


@R.add("win_running_quartile", f"""WITH RECURSIVE {VOCAB_SQL}, c AS (SELECT answer, n, sum(n) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM vocab),
b(i, base) AS (SELECT 0, 0::HUGEINT UNION ALL SELECT i + 1, (SELECT min(upto) FROM c WHERE upto - base >= total / 4.0) FROM b WHERE i < 4 AND base < (SELECT max(total) FROM c))
SELECT answer, n, (SELECT count(*) - 1 FROM b WHERE base < upto)::BIGINT AS bucket FROM c""")
def win_running_quartile(spark, sf_dir):
    """All answers, the most common first, in four buckets: each takes answers until it holds a quarter of all or more.

    A bucket's end is the least running sum a quarter above the last bucket's end: four small aggregations on the
    running sums, which come from a global sort.
    """
    counts = questions(spark, sf_dir).where("answer IS NOT NULL").groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    sums = stored(running_sum(counts.withColumn("less", -F.col("n")), ["less", "first"], "n", "upto"))
    total, ends = sums.agg(F.sum("n")).first()[0] or 0, [0]
    while len(ends) <= 4 and ends[-1] < total:
        ends.append(sums.where((F.col("upto") - ends[-1]) * 4 >= total).agg(F.min("upto")).first()[0] or total)
    bucket = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("upto"))) - 1
    return sums.select("answer", "n", bucket.cast("bigint").alias("bucket"))


@R.add("join_isin_vocab", f"WITH {VOCAB_SQL} SELECT row_id FROM questions q WHERE EXISTS (SELECT 1 FROM vocab v WHERE v.answer = q.answer AND place <= {VOCABULARY})")
def join_isin_vocab(spark, sf_dir):
    return questions(spark, sf_dir).join(F.broadcast(vocabulary(spark, sf_dir, VOCABULARY)), "answer", "left_semi").select("row_id")


@R.add("proj_qa_item", f"WITH {VOCAB_SQL} SELECT q.row_id, coalesce(v.place - 1, -1) AS vocab_id, coalesce(list_position(options, q.answer) - 1, -1) AS choice_id FROM questions q LEFT JOIN vocab v ON v.answer = q.answer AND place <= {VOCABULARY}")
def proj_qa_item(spark, sf_dir):
    v = F.broadcast(vocabulary(spark, sf_dir, VOCABULARY).select("answer", "place"))
    rows = questions(spark, sf_dir).join(v, "answer", "left")
    at = F.array_position("options", F.col("answer")) - 1
    return rows.select("row_id", F.coalesce(F.col("place") - 1, F.lit(-1)).alias("vocab_id"), F.coalesce(at, F.lit(-1)).cast("bigint").alias("choice_id"))


@R.add("agg_majority_vote", f"WITH {QUESTIONS_SQL}, o AS (SELECT qid, answer, count(*) AS n, min(row_id) AS first FROM questions GROUP BY ALL) SELECT qid, arg_max(answer, {{'n': n, 'f': -first}}) AS answer, max(n) AS n FROM o GROUP BY qid")
def agg_majority_vote(spark, sf_dir):
    """The most common answer per qid, the first seen on ties."""
    counts = questions(spark, sf_dir).groupBy("qid", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return counts.groupBy("qid").agg(F.max_by("answer", F.struct("n", -F.col("first"))).alias("answer"), F.max("n").alias("n"))


@R.add("fn_answer_counts", f"WITH {QUESTIONS_SQL} SELECT video_id, answer, count(*) AS n, least(count(*) / 3.0, 1.0) AS score FROM questions GROUP BY ALL")
def fn_answer_counts(spark, sf_dir):
    """Answers per video with their soft score: three or more votes count in full."""
    g = questions(spark, sf_dir).groupBy("video_id", "answer").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("score", F.least(F.col("n") / 3.0, F.lit(1.0)).cast("double"))


@R.add("filt_soft_score", f"WITH {QUESTIONS_SQL}, g AS (SELECT video_id, answer, count(*) AS n FROM questions GROUP BY ALL) SELECT DISTINCT video_id FROM g WHERE n >= 3")
def filt_soft_score(spark, sf_dir):
    """Videos with an answer of three votes or more."""
    return fn_answer_counts(spark, sf_dir).where("n >= 3").select("video_id").distinct()


@R.add("agg_group_sets", f"WITH {QUESTIONS_SQL} SELECT \"type\" AS kind, count(DISTINCT answer) AS n_answers, count(DISTINCT question) AS n_questions FROM questions GROUP BY ALL")
def agg_group_sets(spark, sf_dir):
    """Distinct answers and questions per type, counted without gathering the sets."""
    return questions(spark, sf_dir).groupBy(F.col("type").alias("kind")).agg(F.countDistinct("answer").alias("n_answers"), F.countDistinct("question").alias("n_questions"))


@R.add("agg_major_type", f"WITH {QUESTIONS_SQL}, g AS (SELECT \"type\" AS kind, count(DISTINCT answer) AS n FROM questions GROUP BY ALL) SELECT kind, n FROM g ORDER BY n DESC, kind LIMIT 1")
def agg_major_type(spark, sf_dir):
    g = questions(spark, sf_dir).groupBy(F.col("type").alias("kind")).agg(F.countDistinct("answer").alias("n"))
    return g.orderBy(F.desc("n"), "kind").limit(1)  # the largest is the feature


@R.add("agg_word_stats", f"""WITH {QUESTIONS_SQL}, w AS (SELECT row_id, lower(\"type\") AS t, {_HITS} AS h, unnest(list_distinct(list_filter(regexp_split_to_array(lower(trim(question)), '\\s+'), lambda x: x <> ''))) AS word FROM questions)
SELECT word, count(*) AS n, round(avg(CASE WHEN len(h) = 1 THEN 1.0 ELSE 0 END), 9) AS acc FROM w GROUP BY ALL""")
def agg_word_stats(spark, sf_dir):
    """Share of questions whose answer matches one option, per word of the question."""
    rows = questions(spark, sf_dir).select(tx.unique_option(F.col("answer"), F.col("options")).isNotNull().alias("ok"), F.explode(F.array_distinct(tx.words(F.col("question")))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("acc"))


@R.add("fn_type_ids", f"WITH {QUESTIONS_SQL} SELECT row_id, CASE \"type\" WHEN 'CH' THEN 0 WHEN 'CW' THEN 1 WHEN 'TC' THEN 2 WHEN 'TN' THEN 3 WHEN 'TP' THEN 4 ELSE -1 END AS type_id FROM questions")
def fn_type_ids(spark, sf_dir):
    ids = F.create_map(*[F.lit(x) for pair in (("CH", 0), ("CW", 1), ("TC", 2), ("TN", 3), ("TP", 4)) for x in pair])
    return questions(spark, sf_dir).select("row_id", F.coalesce(F.try_element_at(ids, F.col("type")), F.lit(-1)).cast("bigint").alias("type_id"))


@R.add("fn_question_qmark", f"WITH {QUESTIONS_SQL} SELECT row_id, trim(upper(substr(question, 1, 1)) || lower(substr(question, 2))) || '?' AS text FROM questions")
def fn_question_qmark(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", tx.question_mark(F.col("question")).alias("text"))


@R.add("fn_remove_nonascii", f"WITH {QUESTIONS_SQL} SELECT row_id, regexp_replace(question, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM questions")
def fn_remove_nonascii(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", tx.non_ascii_blank(F.col("question")).alias("text"))


@R.add("fn_strip_trailing_dot", f"WITH {QUESTIONS_SQL} SELECT row_id, regexp_replace(trim(a0), '\\.$', '') AS text FROM questions")
def fn_strip_trailing_dot(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", tx.strip_last_dot(F.col("a0")).alias("text"))


@R.add("fn_strip_option", f"WITH {QUESTIONS_SQL} SELECT row_id, regexp_replace(ltrim(a0), '^(best option:)?\\s*\\(?', '') AS text FROM questions")
def fn_strip_option(spark, sf_dir):
    return questions(spark, sf_dir).select("row_id", F.regexp_replace(F.ltrim("a0"), r"^(best option:)?\s*\(?", "").alias("text"))


_LETTERED = "array_to_string(list_transform(range(len(options)), lambda i: chr(CAST(65 + i AS INT)) || '. ' || options[i + 1]), chr(10))"


def lettered(options):
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


@R.add("fn_build_instruction", f"WITH {QUESTIONS_SQL} SELECT row_id, 'Question: ' || question || chr(10) || 'Options:' || chr(10) || {_LETTERED} || chr(10) || 'Reply with one JSON object that has label, answer, evidence_seconds and reason.' AS prompt FROM questions")
def fn_build_instruction(spark, sf_dir):
    """The text a model is asked with."""
    return questions(spark, sf_dir).select(
        "row_id", F.concat(F.lit("Question: "), "question", F.lit("\nOptions:\n"), lettered(F.col("options")), F.lit("\nReply with one JSON object that has label, answer, evidence_seconds and reason.")).alias("prompt")
    )


@R.add("fn_prompt_frozen", f"WITH {QUESTIONS_SQL} SELECT row_id, generate_subscripts(options, 1) - 1 AS i, 'Question: ' || trim(upper(substr(question, 1, 1)) || lower(substr(question, 2))) || '? Is it ''' || unnest(options) || '''? [MASK].' AS prompt FROM questions")
def fn_prompt_frozen(spark, sf_dir):
    """One prompt per option with a mask for yes or no."""
    rows = questions(spark, sf_dir).select("row_id", "question", F.posexplode("options").alias("i", "o"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), F.concat(F.lit("Question: "), tx.question_mark(F.col("question")), F.lit(" Is it '"), "o", F.lit("'? [MASK].")).alias("prompt"))


@R.add("fn_prompt_cg", f"WITH {GROUNDING_SQL} SELECT q.row_id, 'Spans: ' || coalesce(array_to_string(list_transform(list_filter(g.pairs, lambda p: len(p) > 1 AND p[1] IS NOT NULL AND p[2] IS NOT NULL), lambda p: CAST(round(p[1] * 1000) AS BIGINT) || '-' || CAST(round(p[2] * 1000) AS BIGINT)), ', '), '') || chr(10) || q.question AS prompt FROM questions q JOIN grounding g ON q.video_id = g.video_id AND q.qid = g.qid")
def fn_prompt_cg(spark, sf_dir):
    """Question with its spans in milliseconds in front."""
    rows = questions(spark, sf_dir).join(grounding(spark, sf_dir), ["video_id", "qid"])
    good = F.filter("pairs", lambda p: (F.size(p) > 1) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    spans = F.array_join(F.transform(good, lambda p: F.concat_ws("-", F.round(F.get(p, F.lit(0)) * 1000).cast("bigint"), F.round(F.get(p, F.lit(1)) * 1000).cast("bigint"))), ", ")
    return rows.select("row_id", F.concat(F.lit("Spans: "), F.coalesce(spans, F.lit("")), F.lit("\n"), "question").alias("prompt"))


@R.add("fn_prompt_preview", "SELECT 'Question: what happens?' || chr(10) || 'Options:' || chr(10) || 'A. one' || chr(10) || 'B. two' AS prompt")
def fn_prompt_preview(spark, sf_dir):
    one = spark.range(1).select(F.lit("what happens?").alias("q"), F.array(F.lit("one"), F.lit("two")).alias("o"))
    return one.select(F.concat(F.lit("Question: "), "q", F.lit("\nOptions:\n"), lettered(F.col("o"))).alias("prompt"))


@R.add("fn_result_key", "SELECT row_id, concat_ws('_', 'model', task, sampling, coalesce(evidence_condition, 'UNKNOWN'), CASE WHEN alpha IS NULL THEN 'False' ELSE 'True' END) AS k FROM eval_result")
def fn_result_key(spark, sf_dir):
    t = table(spark, sf_dir, "eval_result")
    return t.select("row_id", F.concat_ws("_", F.lit("model"), "task", "sampling", F.coalesce("evidence_condition", F.lit("UNKNOWN")), F.when(F.col("alpha").isNull(), "False").otherwise("True")).alias("k"))


@R.add("val_csv_profile", f"WITH {QUESTIONS_SQL} SELECT count(*) AS n, count(DISTINCT video_id) AS n_videos, count(*) FILTER (NOT regexp_full_match(qid, '-*[0-9]+')) AS odd_qids, max(length(question)) AS longest_question, count(*) FILTER (question IS NULL) AS null_questions, count(DISTINCT \"type\") AS n_types FROM questions")
def val_csv_profile(spark, sf_dir):
    return questions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("n_videos"), F.count_if(~F.col("qid").rlike(r"^-*[0-9]+$")).alias("odd_qids"), F.max(F.length("question")).cast("bigint").alias("longest_question"),
        F.count_if(F.col("question").isNull()).alias("null_questions"), F.countDistinct("type").alias("n_types"),
    )


@R.add("val_explore", f"WITH {QUESTIONS_SQL} SELECT \"type\" AS kind, count(*) AS n, min(row_id) AS first_row FROM questions GROUP BY ALL")
def val_explore(spark, sf_dir):
    return questions(spark, sf_dir).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


@R.add("val_raw_format", f"""WITH l AS (SELECT unnest(map_values(location)) AS p FROM gsub_test) SELECT CASE WHEN p IS NULL OR len(p) = 0 THEN 'invalid' WHEN len(p) = 1 THEN 'single' ELSE 'multi' END AS shape, count(*) AS n FROM l GROUP BY ALL""")
def val_raw_format(spark, sf_dir):
    rows = table(spark, sf_dir, "gsub_test").select(F.explode("location").alias("q", "p"))
    n = F.coalesce(F.size("p"), F.lit(0))
    return rows.groupBy(F.when(n <= 0, "invalid").when(n == 1, "single").otherwise("multi").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@R.add("split_by_membership", f"WITH {QUESTIONS_SQL} SELECT row_id, EXISTS (SELECT 1 FROM gsub_test g WHERE {VIDEO_SQL.format('g.video_id')} = q.video_id) AS in_a, EXISTS (SELECT 1 FROM test_raw t WHERE split_part(t.raw_line, ',', 1) = q.video_id) AS in_b FROM questions q")
def split_by_membership(spark, sf_dir):
    """Membership in two id lists; not exclusive."""
    a = table(spark, sf_dir, "gsub_test").select(video_key("video_id").alias("video_id"), F.lit(True).alias("a")).distinct()
    b = table(spark, sf_dir, "test_raw").select(F.split_part("raw_line", F.lit(","), F.lit(1)).alias("video_id"), F.lit(True).alias("b")).distinct()
    return questions(spark, sf_dir).select("row_id", "video_id").join(a, "video_id", "left").join(b, "video_id", "left").select("row_id", F.coalesce("a", F.lit(False)).alias("in_a"), F.coalesce("b", F.lit(False)).alias("in_b"))


#: Options of a question, and the share of questions whose distractors are replaced, in hundredths; as in the reference.
CHOICES, REPLACED_PCT = len(OPTIONS), 30


def negative_choices(rows: DataFrame, pct: int, seed: int) -> DataFrame:
    """(row_id, choices, answer_id): new options for a seeded ``pct`` hundredths of ``rows`` (row_id, kind, answer).

    The distractors are drawn from the other distinct answers of the question's kind, or of all kinds where that has fewer
    than are needed; the question's own answer stands among them at a seeded place. Drawn by number: an answer's
    number is its place in its pool, so a question never meets the whole pool. Questions without an answer take no part.
    """
    need = CHOICES - 1
    rows = rows.where("answer IS NOT NULL")
    typed = rows.where("kind IS NOT NULL").select("kind", "answer").distinct()
    index = ranked(typed, ["kind"], ["answer"], "at")
    whole = ranked(rows.select("answer").distinct(), [], ["answer"], "at").withColumn("kind", F.lit(None).cast("string"))
    index = stored(index.unionByName(whole))
    sizes = index.groupBy("kind").agg(F.count(F.lit(1)).alias("m"))
    picked = rows.where(F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(100)) < pct)
    large = sizes.where((F.col("m") > need) & F.col("kind").isNotNull()).select("kind", F.lit(True).alias("enough"))
    picked = picked.join(large, "kind", "left").select("row_id", "answer", F.when(F.col("enough"), F.col("kind")).alias("kind"))
    own = picked.alias("q").join(index.alias("i"), F.col("q.kind").eqNullSafe(F.col("i.kind")) & (F.col("q.answer") == F.col("i.answer"))).select("q.row_id", "q.answer", "q.kind", F.col("i.at").alias("own"))
    sizes = sizes.select(F.col("kind").alias("k"), "m")
    own = own.join(sizes, F.col("kind").eqNullSafe(F.col("k"))).drop("k")

    def draw(taken, j):
        r = F.pmod(F.xxhash64("row_id", F.lit(seed), j), F.col("m") - F.size(taken))
        # the r-th number that is not taken
        return F.concat(taken, F.array(F.aggregate(F.array_sort(taken), r, lambda x, t: F.when(t <= x, x + 1).otherwise(x))))

    turns = sm.steps(F.least(F.lit(need), F.col("m") - 1))
    taken = F.aggregate(turns, F.array("own"), draw)
    drawn = own.select("row_id", "answer", "kind", F.posexplode_outer(F.slice(taken, 2, need)).alias("j", "at"))
    got = drawn.alias("d").join(index.alias("i"), F.col("d.kind").eqNullSafe(F.col("i.kind")) & (F.col("d.at") == F.col("i.at")), "left").select("d.row_id", F.col("d.answer").alias("right"), "d.j", "i.answer")
    sets = got.groupBy("row_id", "right").agg(F.sort_array(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "answer")))).alias("o"))  # at most need
    sets = sets.withColumn("answer_id", F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit("place")), F.size("o") + 1))
    return sets.select("row_id", F.array_insert(F.col("o.answer"), (F.col("answer_id") + 1).cast("int"), F.col("right")).alias("choices"), "answer_id")


def replaced_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_choices(questions(spark, sf_dir).select("row_id", F.col("type").alias("kind"), "answer"), REPLACED_PCT, 0)


@R.add("smp_neg_choices")
def smp_neg_choices(spark, sf_dir):
    """Options of the questions whose distractors are replaced by other answers of their type."""
    return replaced_choices(spark, sf_dir)


@R.add("smp_neg_choices_check", f"""WITH {QUESTIONS_SQL}, p AS (SELECT "type" AS kind, count(DISTINCT answer) AS m FROM questions WHERE answer IS NOT NULL AND "type" IS NOT NULL GROUP BY ALL), a AS (SELECT count(DISTINCT answer) AS m FROM questions)
SELECT p.kind, least({CHOICES}, CASE WHEN p.m > {CHOICES - 1} THEN p.m ELSE a.m END) AS n_choices, 0 AS without_answer, 0 AS repeated, CASE WHEN p.m > {CHOICES - 1} THEN 0 END AS of_other_type FROM p, a""")
def smp_neg_choices_check(spark, sf_dir):
    """Per type: the number of options, and the rows that break a rule (the answer at its place, no option twice, options of the type where it has enough)."""
    rows = questions(spark, sf_dir).where("answer IS NOT NULL AND type IS NOT NULL").select("row_id", F.col("type").alias("kind"), "answer")
    made = replaced_choices(spark, sf_dir).join(rows, "row_id")
    typed = rows.groupBy("kind", F.col("answer").alias("choice")).agg(F.lit(True).alias("own"))
    enough = rows.groupBy("kind").agg((F.countDistinct("answer") > CHOICES - 1).alias("enough"))
    foreign = made.select("kind", F.explode("choices").alias("choice")).groupBy("kind", "choice").agg(F.count(F.lit(1)).alias("n")).join(typed, ["kind", "choice"], "left").groupBy("kind").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)).alias("foreign"))
    per = made.groupBy("kind").agg(
        F.max(F.size("choices")).cast("bigint").alias("n_choices"), F.count_if(F.get("choices", F.col("answer_id").cast("int")) != F.col("answer")).alias("without_answer"), F.count_if(F.size(F.array_distinct("choices")) != F.size("choices")).alias("repeated")
    )
    return per.join(foreign, "kind").join(enough, "kind").select("kind", "n_choices", "without_answer", "repeated", F.when(F.col("enough"), F.col("foreign")).alias("of_other_type"))


@R.add("smp_neg_questions", f"""WITH {QUESTIONS_SQL}, o AS (SELECT video_id, question, min(row_id) AS first FROM questions GROUP BY ALL), r AS (SELECT *, lead(question) OVER (PARTITION BY video_id ORDER BY first) AS other FROM o)
SELECT video_id, question, other FROM r WHERE other IS NOT NULL""")
def smp_neg_questions(spark, sf_dir):
    """Another question of the same video for each distinct question but the last."""
    o = questions(spark, sf_dir).groupBy("video_id", "question").agg(F.min("row_id").alias("first"))
    return o.withColumn("other", F.lead("question").over(Window.partitionBy("video_id").orderBy("first"))).where("other IS NOT NULL").select("video_id", "question", "other")


@R.add("agg_collate_pad", f"WITH {QUESTIONS_SQL}, w AS (SELECT row_id, \"type\" AS kind, list_filter(regexp_split_to_array(lower(trim(question)), '\\s+'), lambda x: x <> '') AS w FROM questions), m AS (SELECT kind, max(len(w)) AS top FROM w GROUP BY ALL) SELECT row_id, len(w) AS n, top AS padded FROM w JOIN m ON w.kind = m.kind")
def agg_collate_pad(spark, sf_dir):
    """Length of each question in words and of the batch it is padded to."""
    rows = questions(spark, sf_dir).select("row_id", F.col("type").alias("kind"), F.size(tx.words(F.col("question"))).cast("bigint").alias("n"))
    return rows.join(F.broadcast(rows.groupBy("kind").agg(F.max("n").alias("padded"))), "kind").select("row_id", "n", "padded")  # as many rows as types
