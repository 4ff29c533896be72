"""Media work as plans over whole tables: commands, filter graphs, probe replies and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.functions import media as md
from strandline.functions import sampling as sm
from strandline.functions.keys import VIDEO_SQL, video_key
from strandline.plans.anchors import ANCHORS_SQL, anchors, merged_sql
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()

G = "format('{{:g}}', {0})"  # a short number in SQL
BETWEEN = f"'between(t,' || {G.format('start_s')} || ',' || {G.format('end_s')} || ')'".replace("{{", "{").replace("}}", "}")
VIDEO_ARGS, SOUND_ARGS, END_ARGS = "-c:v libx264 -crf 18 -preset veryfast -threads 4 -pix_fmt yuv420p", "-c:a aac -b:a 192k", "-movflags +faststart "

JOBS_SQL = f"""{merged_sql(True, False, True)}, m AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY start_s) AS k, {BETWEEN} AS b FROM merged),
e AS (SELECT row_id, string_agg(b, '+' ORDER BY k) AS expr, count(*) AS n FROM m GROUP BY row_id),
j AS (SELECT a.row_id, expr, n, 'videos/' || video_id || '.mp4' AS src, 'out/' || video_id || '_' || qid || '.mp4' AS dst FROM e JOIN anchors a USING (row_id))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, video_id, d, m, source, target): an anchor's merged spans with the files of its degraded version."""
    rows = anchors(spark, sf_dir).select("row_id", "video_id", "qid", "d", iv.normalize(F.col("gold"), keep_empty=True).alias("m"))
    return rows.withColumns({"source": F.concat(F.lit("videos/"), "video_id", F.lit(".mp4")), "target": F.concat(F.lit("out/"), "video_id", F.lit("_"), "qid", F.lit(".mp4"))})


def command(c: Column) -> Column:
    return F.array_join(c, " ")


def either(*values: bool) -> Column:
    return F.explode(F.array(*map(F.lit, values)))


@R.add("med_blackout_cmd", f"""WITH {JOBS_SQL} SELECT row_id, audio, 'ffmpeg -y -i ' || src || ' -vf drawbox=x=0:y=0:w=iw:h=ih:color=black:t=fill:enable=''' || expr || '''' || CASE WHEN audio THEN ' -af volume=volume=0:enable=''' || expr || '''' ELSE '' END
 || ' {VIDEO_ARGS} ' || CASE WHEN audio THEN '{SOUND_ARGS}' ELSE '-an' END || ' {END_ARGS}' || dst AS command FROM j, (SELECT unnest([true, false]) AS audio)""")
def med_blackout_cmd(spark, sf_dir):
    """For files with and without sound."""
    rows = jobs(spark, sf_dir).where("size(m) > 0").withColumn("audio", either(True, False))
    return rows.select("row_id", "audio", command(md.blackout_command(F.col("source"), F.col("target"), F.col("m"), F.col("audio"))).alias("command"))


@R.add("med_freeze_cmd", f"""WITH {JOBS_SQL}, f AS (SELECT row_id, string_agg('-loop 1 -i stills/' || row_id || '_' || (k - 1) || '.png', ' ' ORDER BY k) AS inputs,
 string_agg('[' || CASE WHEN k = 1 THEN '0:v' ELSE 'v' || (k - 1) END || '][' || k || ':v]overlay=x=0:y=0:shortest=1:enable=''' || b || '''[v' || k || ']', ';' ORDER BY k) AS chain FROM m GROUP BY row_id)
SELECT row_id, sound, 'ffmpeg -y -i ' || src || ' ' || inputs || ' -filter_complex ' || chain || CASE WHEN sound = 'mute' THEN ';[0:a]volume=volume=0:enable=''' || expr || '''[aout]' ELSE '' END || ' -map [v' || n || ']'
 || CASE sound WHEN 'mute' THEN ' -map [aout]' WHEN 'keep' THEN ' -map 0:a' ELSE '' END || ' {VIDEO_ARGS} ' || CASE sound WHEN 'mute' THEN '{SOUND_ARGS}' WHEN 'keep' THEN '-c:a copy' ELSE '-an' END || ' {END_ARGS}' || dst AS command
FROM j JOIN f USING (row_id), (SELECT unnest(['mute', 'keep', 'none']) AS sound)""")
def med_freeze_cmd(spark, sf_dir):
    """For files whose sound is silenced, kept, or absent."""
    stills = F.transform("m", lambda x, i: F.concat(F.lit("stills/"), F.col("row_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(".png")))
    rows = jobs(spark, sf_dir).where("size(m) > 0").withColumn("sound", F.explode(F.array(*map(F.lit, ("mute", "keep", "none")))))
    made = md.freeze_command(F.col("source"), F.col("target"), F.col("m"), stills, F.col("sound") != "none", F.col("sound") == "keep")
    return rows.select("row_id", "sound", command(made).alias("command"))


@R.add("med_freeze_extract", f"""WITH {JOBS_SQL} SELECT row_id, before, k - 1 AS i, 'ffmpeg -y -ss ' || {G.format("greatest(0.0::DOUBLE, CASE WHEN before THEN start_s - 1.0::DOUBLE / 30 ELSE start_s END)")} || ' -i ' || src || ' -frames:v 1 -an -update 1 stills/' || row_id || '_' || (k - 1) || '.png' AS command
FROM m JOIN j USING (row_id), (SELECT unnest([true, false]) AS before)""".replace("{{", "{").replace("}}", "}"))
def med_freeze_extract(spark, sf_dir):
    """One still per span, at its start or one frame before it; the rate of these files is not known."""
    rows = jobs(spark, sf_dir).withColumn("before", either(True, False)).select("row_id", "before", "source", F.posexplode("m").alias("i", "x"))
    target = F.concat(F.lit("stills/"), F.col("row_id").cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit(".png"))
    at = md.freeze_time(F.col("x.start"), F.lit(None).cast("double"), F.col("before"))
    return rows.select("row_id", "before", F.col("i").cast("bigint").alias("i"), command(md.still_command(F.col("source"), at, target)).alias("command"))


# files whose size and rate are known

SIZED_SQL = f"""dims AS (SELECT {VIDEO_SQL.format('video_id')} AS video_id, arg_max(TRY_CAST(width AS INT), row_id) AS w, arg_max(TRY_CAST(height AS INT), row_id) AS h FROM test WHERE TRY_CAST(width AS INT) > 0 AND TRY_CAST(height AS INT) > 0 GROUP BY 1),
pairs AS (SELECT row_id, video_id, fps, qid, unnest(p) AS p FROM (SELECT row_id, {VIDEO_SQL.format('video_id')} AS video_id, fps, unnest(map_keys(location)) AS qid, unnest(map_values(location)) AS p FROM gsub_test WHERE fps > 0)),
spans AS (SELECT row_id, video_id, fps, qid, least(p[1], p[2]) AS s, greatest(p[1], p[2]) AS e FROM pairs WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL AND p[1] <> p[2]),
marked AS (SELECT *, max(e) OVER (PARTITION BY row_id, qid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans),
isles AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, qid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
merged AS (SELECT row_id, video_id, fps, qid, min(s) AS start_s, max(e) AS end_s FROM isles GROUP BY row_id, video_id, fps, qid, i),
x AS (SELECT row_id, video_id, fps, qid, string_agg({BETWEEN}, '+' ORDER BY start_s) AS expr FROM merged GROUP BY ALL),
z AS (SELECT row_id, x.video_id, qid, expr, w, h, {G.format('fps')} AS rate FROM x JOIN dims USING (video_id)),
g AS (SELECT *, 'color=size=' || w || 'x' || h || ':rate=' || rate || ':color=gray,format=yuv420p,noise=alls=100:allf=t+u[noise];[0:v][noise]blend=all_mode=''normal'':all_opacity=' || CAST(alpha AS VARCHAR) || ':enable=''' || expr || ''':shortest=1[vout]' AS graph
 FROM z, (SELECT unnest([0.0, 0.05, 0.3, 1.0]::DOUBLE[]) AS alpha))""".replace("{{", "{").replace("}}", "}")


def sized_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, video_id, qid, m, width, height, rate): merged spans of a grounded question with the size and rate of its file."""
    size = lambda c: F.col(c).try_cast("int")
    known = table(spark, sf_dir, "test").where((size("width") > 0) & (size("height") > 0))
    dims = known.groupBy(video_key("video_id").alias("video_id")).agg(F.max_by(F.struct(size("width").alias("w"), size("height").alias("h")), "row_id").alias("s"))
    rows = table(spark, sf_dir, "gsub_test").where("fps > 0").select("row_id", video_key("video_id").alias("video_id"), "fps", F.explode("location").alias("qid", "pairs"))
    spans = F.transform("pairs", lambda p: iv.span(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    rows = rows.join(dims, "video_id").withColumn("m", iv.normalize(spans)).where("size(m) > 0")
    return rows.select("row_id", "video_id", "qid", "m", F.col("s.w").alias("width"), F.col("s.h").alias("height"), md.short_number(F.col("fps")).alias("rate"))


def at_levels(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.3, 1.0)))))


def graph() -> Column:
    return md.noise_graph(F.col("m"), F.col("alpha"), F.col("width"), F.col("height"), F.col("rate"))


@R.add("med_noise_graph", f"WITH {SIZED_SQL} SELECT row_id, qid, alpha, graph FROM g")
def med_noise_graph(spark, sf_dir):
    return at_levels(sized_jobs(spark, sf_dir)).select("row_id", "qid", "alpha", graph().alias("graph"))


@R.add("med_partial_cmd", f"""WITH {SIZED_SQL}, a AS (SELECT *, unnest([true, false]) AS audio, 'videos/' || video_id || '.mp4' AS src, 'out/' || video_id || '_' || qid || '_' || CAST(alpha AS VARCHAR) || '.mp4' AS dst FROM g),
e AS (SELECT *, '{VIDEO_ARGS} ' || CASE WHEN audio THEN '-c:a copy' ELSE '-an' END || ' {END_ARGS}' || dst AS tail FROM a)
SELECT row_id, qid, alpha, audio, 'noise' AS mode, 'ffmpeg -y -i ' || src || ' -filter_complex ' || graph || ' -map [vout]' || CASE WHEN audio THEN ' -map 0:a' ELSE '' END || ' ' || tail AS command FROM e
UNION ALL SELECT row_id, qid, alpha, audio, 'blur', 'ffmpeg -y -i ' || src || CASE WHEN alpha < 1 THEN ' -vf gblur=sigma=' || {G.format("18.0 * (1 - alpha)").replace("{{", "{").replace("}}", "}")} || ':enable=''' || expr || '''' ELSE '' END || ' ' || tail FROM e""")
def med_partial_cmd(spark, sf_dir):
    """Both ways of degrading, at each level, with and without sound."""
    rows = at_levels(sized_jobs(spark, sf_dir)).withColumn("audio", either(True, False))
    source = F.concat(F.lit("videos/"), "video_id", F.lit(".mp4"))
    target = F.concat(F.lit("out/"), "video_id", F.lit("_"), "qid", F.lit("_"), md.level(F.col("alpha")), F.lit(".mp4"))
    ways = {"noise": md.partial_command(source, target, F.col("audio"), graph=graph()), "blur": md.partial_command(source, target, F.col("audio"), simple=md.blur_filter(F.col("m"), F.col("alpha")))}
    both = [rows.select("row_id", "qid", "alpha", "audio", F.lit(mode).alias("mode"), command(c).alias("command")) for mode, c in ways.items()]
    return both[0].unionByName(both[1])


@R.add("med_blur_vf", f"WITH {JOBS_SQL} SELECT row_id, alpha, CASE WHEN alpha < 1 THEN 'gblur=sigma=' || {G.format('18.0 * (1 - alpha)')} || ':enable=''' || expr || '''' END AS filter FROM j, (SELECT unnest([0.3, 1.0]::DOUBLE[]) AS alpha)".replace("{{", "{").replace("}}", "}"))
def med_blur_vf(spark, sf_dir):
    rows = jobs(spark, sf_dir).where("size(m) > 0").select("row_id", "m", F.explode(F.array(F.lit(0.3), F.lit(1.0))).alias("alpha"))
    return rows.select("row_id", "alpha", md.blur_filter(F.col("m"), F.col("alpha")).alias("filter"))


@R.add("med_compress", """SELECT row_id, 'ffmpeg -y -i videos/' || video_id || '.mp4 -filter:v scale=''if(gt(a,1),trunc(oh*a/2)*2,224)'':''if(gt(a,1),224,trunc(ow*a/2)*2)'' -map 0:v -r 3 small/' || video_id || '.mp4' AS command FROM gsub_test""")
def med_compress(spark, sf_dir):
    file = lambda folder: F.concat(F.lit(folder), "video_id", F.lit(".mp4"))
    return table(spark, sf_dir, "gsub_test").select("row_id", command(md.compress_command(file("videos/"), file("small/"))).alias("command"))


@R.add("med_extract_frames", f"WITH {ANCHORS_SQL} SELECT row_id, i, 'ffmpeg -nostdin -y -ss ' || CAST(round((i + 0.5) * d / 4, 6) AS VARCHAR) || ' -i videos/' || video_id || '.mp4 -frames:v 1 -vf scale=336:-2 -q:v 3 frame_' || lpad(i::VARCHAR, 4, '0') || '.jpg' AS command FROM anchors, range(4) r(i) WHERE d IS NOT NULL")
def med_extract_frames(spark, sf_dir):
    """Four uniform frames of every file of known duration."""
    rows = jobs(spark, sf_dir).where("d IS NOT NULL").select("row_id", "source", F.posexplode(sm.uniform(F.col("d"), F.lit(4))).alias("i", "t"))
    target = F.concat(F.lit("frame_"), F.lpad(F.col("i").cast("string"), 4, "0"), F.lit(".jpg"))
    return rows.select("row_id", F.col("i").cast("bigint").alias("i"), command(md.frame_command(F.col("source"), F.round("t", 6), target)).alias("command"))


STATUS_SQL = f"{ANCHORS_SQL}, per AS (SELECT video_id, count(DISTINCT batch_id) AS n FROM anchors GROUP BY ALL), st AS (SELECT a.row_id, CASE WHEN len(gold) = 0 THEN 'skip_no_intervals' WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN d IS NULL THEN 'skip_exists' ELSE 'dry_run' END AS status FROM anchors a LEFT JOIN per p ON p.video_id = a.video_id)"


@R.add("med_process_level", f"WITH {STATUS_SQL} SELECT row_id, status FROM st")
def med_process_level(spark, sf_dir):
    """Status of each job, with the number of batches that hold the video as the number of inputs."""
    rows = anchors(spark, sf_dir)
    n = rows.groupBy("video_id").agg(F.countDistinct("batch_id").alias("n"))
    return rows.join(n, "video_id", "left").select("row_id", md.build_status(F.col("gold"), F.col("n"), F.col("d").isNull(), True).alias("status"))


@R.add("orch_dryrun", f"WITH {STATUS_SQL} SELECT status, count(*) AS n FROM st GROUP BY ALL")
def orch_dryrun(spark, sf_dir):
    return med_process_level(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@R.add("med_nonevidence_pick", f"WITH {ANCHORS_SQL} SELECT row_id, list_filter([5.0::DOUBLE, d / 2, d * 0.8, d * 0.3], lambda t: len(list_filter(gold, lambda g: t >= g.start - 1 AND t <= g.\"end\" + 1)) = 0)[1] AS at_s FROM anchors WHERE d IS NOT NULL")
def med_nonevidence_pick(spark, sf_dir):
    return anchors(spark, sf_dir).where("d IS NOT NULL").select("row_id", md.outside_time(F.col("d"), F.col("gold")).alias("at_s"))


# probes

PROBED_SQL = f"""dims AS (SELECT {VIDEO_SQL.format('video_id')} AS video_id, arg_max(TRY_CAST(width AS INT), row_id) AS w, arg_max(TRY_CAST(height AS INT), row_id) AS h FROM test WHERE TRY_CAST(width AS INT) > 0 AND TRY_CAST(height AS INT) > 0 GROUP BY 1),
last AS (SELECT {VIDEO_SQL.format('video_id')} AS video_id, arg_max(duration, {{'l': loaded_at, 'r': row_id}}) AS expected FROM gsub_test WHERE duration > 0 GROUP BY 1),
p AS (SELECT g.row_id, g.row_id % 7 = 3 OR coalesce(g.fps, 0) <= 0 AS bad, g.duration, g.fps, w, h, expected, g.row_id % 3 > 0 AS sound FROM gsub_test g LEFT JOIN dims d ON d.video_id = {VIDEO_SQL.format('g.video_id')} LEFT JOIN last l ON l.video_id = {VIDEO_SQL.format('g.video_id')})"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, p, expected): what a probe's reply says of each loaded file, and its video's duration as loaded last.

    No file is there to be probed, so the replies are written from the tables: whole ones, one in seven cut short, and
    those of files without a rate as if they had no video stream; two in three have sound.
    """
    size = lambda c: F.col(c).try_cast("int")
    known = table(spark, sf_dir, "test").where((size("width") > 0) & (size("height") > 0))
    dims = known.groupBy(video_key("video_id").alias("video_id")).agg(F.max_by(F.struct(size("width").alias("w"), size("height").alias("h")), "row_id").alias("s"))
    files = table(spark, sf_dir, "gsub_test").withColumn("video_id", video_key("video_id"))
    last = files.where("duration > 0").groupBy("video_id").agg(F.max_by("duration", F.struct("loaded_at", "row_id")).alias("expected"))
    rows = files.join(dims, "video_id", "left").join(last, "video_id", "left")
    none = F.lit(None).cast("string")
    video = F.struct(F.lit("video").alias("codec_type"), F.col("s.w").alias("width"), F.col("s.h").alias("height"), F.concat(F.col("fps").cast("decimal(20,6)").cast("string"), F.lit("/1")).alias("r_frame_rate"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), none.alias("r_frame_rate"))
    streams = F.concat(F.when(F.col("row_id") % 3 > 0, F.array(sound)).otherwise(F.array().cast("array<struct<codec_type string, width int, height int, r_frame_rate string>>")), F.when(F.col("fps") > 0, F.array(video)).otherwise(F.array().cast("array<struct<codec_type string, width int, height int, r_frame_rate string>>")))
    text = F.to_json(F.struct(streams.alias("streams"), F.struct(F.coalesce(F.col("duration").cast("string"), F.lit("N/A")).alias("duration")).alias("format")))
    reply = F.when(F.col("row_id") % 7 == 3, F.substring(text, 1, 20)).otherwise(text)
    return rows.select("row_id", md.probe(reply).alias("p"), "expected")


for _name, _field, _sql in (("duration", "duration", "duration"), ("audio", "audio", "sound"), ("fps", "fps", "round(fps, 6)")):

    @R.add(f"med_probe_{_name}", f"WITH {PROBED_SQL} SELECT row_id, CASE WHEN NOT bad THEN {_sql} END AS {_name} FROM p")
    def _probe(spark, sf_dir, name=_name, field=_field):
        made = F.col(f"p.{field}")
        return probed(spark, sf_dir).select("row_id", (F.round(made, 6) if field == "fps" else made).alias(name))


@R.add("med_probe_dims", f"WITH {PROBED_SQL} SELECT row_id, CASE WHEN NOT bad THEN w END AS width, CASE WHEN NOT bad THEN h END AS height FROM p")
def med_probe_dims(spark, sf_dir):
    return probed(spark, sf_dir).select("row_id", "p.width", "p.height")


@R.add("med_check", f"WITH {PROBED_SQL} SELECT row_id, CASE WHEN bad THEN 'corrupt' WHEN expected > 0 AND abs(duration - expected) > 2 THEN 'duration_mismatch' ELSE 'ok' END AS verdict FROM p")
def med_check(spark, sf_dir):
    """The probe's verdict on each loaded file against its video's duration as loaded last."""
    return probed(spark, sf_dir).select("row_id", md.probe_verdict(F.col("p"), F.col("expected")).alias("verdict"))
