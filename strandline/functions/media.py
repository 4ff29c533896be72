"""Plans for media work as columns: commands, filter graphs, probe replies, statuses. Nothing is executed here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.replies import parsed
from strandline.functions.text import frame_rate, short_number


@dataclass(frozen=True)
class Encoder:
    """Settings of the written files; the defaults are fixed values of the reference."""

    crf: int = 18
    preset: str = "veryfast"
    threads: int = 4
    audio_bitrate: str = "192k"
    gpu: bool = False
    gpu_preset: str = "p5"
    gpu_quality: int = 19

    def video(self) -> Column:
        if self.gpu:
            args = ["-c:v", "h264_nvenc", "-preset", self.gpu_preset, "-tune", "hq", "-rc", "vbr", "-cq", str(self.gpu_quality), "-b:v", "0"]
        else:
            args = ["-c:v", "libx264", "-crf", str(self.crf), "-preset", self.preset, "-threads", str(self.threads)]
        return words(*args, "-pix_fmt", "yuv420p")

    def sound(self) -> Column:
        return words("-c:a", "aac", "-b:a", self.audio_bitrate)


ENCODER = Encoder()


def words(*args: str | Column) -> Column:
    """An argument list."""
    return F.array(*[F.lit(a) if isinstance(a, str) else a for a in args])


def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def when(condition: Column, then: Column) -> Column:
    """An argument list that is empty where the condition does not hold."""
    return F.when(F.coalesce(condition, F.lit(False)), then).otherwise(F.array().cast("array<string>"))


def _finish(target: Column) -> Column:
    return words("-movflags", "+faststart", target)


def enable(iv: Column) -> Column:
    """``between(t,a,b)+...`` of merged spans."""
    return F.array_join(F.transform(iv, lambda x: joined("between(t,", short_number(x["start"]), ",", short_number(x["end"]), ")")), "+")


def blackout_filter(iv: Column) -> Column:
    return joined("drawbox=x=0:y=0:w=iw:h=ih:color=black:t=fill:enable='", enable(iv), "'")


def mute_filter(iv: Column) -> Column:
    return joined("volume=volume=0:enable='", enable(iv), "'")


def blackout_command(source: Column, target: Column, iv: Column, audio: Column, encoder: Encoder = ENCODER) -> Column:
    """The spans black and, where there is sound, silent."""
    return F.concat(
        words("ffmpeg", "-y", "-i", source, "-vf", blackout_filter(iv)), when(audio, words("-af", mute_filter(iv))), encoder.video(),
        F.when(audio, encoder.sound()).otherwise(words("-an")), _finish(target),
    )


def freeze_graph(iv: Column, mute: Column) -> Column:
    """Overlays of one still per span, chained; each ends with its input. The sound is silenced within the graph."""
    label = lambda i: i.cast("string")
    step = lambda x, i: joined(
        "[", F.when(i == 0, "0:v").otherwise(joined("v", label(i))), "][", label(i + 1), ":v]overlay=x=0:y=0:shortest=1:enable='between(t,",
        short_number(x["start"]), ",", short_number(x["end"]), ")'[v", label(i + 1), "]",
    )
    chain = F.array_join(F.transform(iv, step), ";")
    return F.concat(chain, F.when(mute, joined(";[0:a]", mute_filter(iv), "[aout]")).otherwise(""))


def freeze_command(source: Column, target: Column, iv: Column, stills: Column, audio: Column, keep_audio: Column, encoder: Encoder = ENCODER) -> Column:
    """The spans under a still each; sound silenced, kept as it is, or absent."""
    mute = audio & ~keep_audio
    inputs = F.flatten(F.transform(stills, lambda s: words("-loop", "1", "-i", s)))
    sound = F.when(mute, encoder.sound()).when(audio, words("-c:a", "copy")).otherwise(words("-an"))
    return F.concat(
        words("ffmpeg", "-y", "-i", source), inputs, words("-filter_complex", freeze_graph(iv, mute), "-map", joined("[v", F.size(iv).cast("string"), "]")),
        when(audio, words("-map", F.when(mute, "[aout]").otherwise("0:a"))), encoder.video(), sound, _finish(target),
    )


def freeze_time(start: Column, fps: Column, before: Column) -> Column:
    """The time of a span's still: its start, or one frame ``before`` it (at 30 a second where the rate is unknown)."""
    step = 1.0 / F.when(fps > 0, fps).otherwise(F.lit(30.0))
    return F.greatest(F.lit(0.0), F.when(before, start - step).otherwise(start))


def still_command(source: Column, time: Column, target: Column) -> Column:
    return words("ffmpeg", "-y", "-ss", short_number(time), "-i", source, "-frames:v", "1", "-an", "-update", "1", target)


def level(alpha: Column) -> Column:
    """A number of four decimals at most, with one at least."""
    text = F.regexp_replace(F.round(alpha, 4).cast("decimal(20,4)").cast("string"), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def noise_graph(iv: Column, alpha: Column, width: Column, height: Column, rate: Column) -> Column:
    """The picture blended with noise on a grey source of its size and rate. The picture is the first input, so alpha is
    its weight: at 0 nothing of it is left within the spans."""
    return joined(
        "color=size=", width.cast("string"), "x", height.cast("string"), ":rate=", rate, ":color=gray,format=yuv420p,noise=alls=100:allf=t+u[noise];",
        "[0:v][noise]blend=all_mode='normal':all_opacity=", level(alpha), ":enable='", enable(iv), "':shortest=1[vout]",
    )


def blur_filter(iv: Column, alpha: Column, strongest: float = 18.0) -> Column:
    """Blur by what alpha takes away; null where it takes nothing."""
    sigma = strongest * (1 - alpha)
    return F.when(sigma > 0, joined("gblur=sigma=", short_number(sigma), ":enable='", enable(iv), "'"))


def partial_command(source: Column, target: Column, audio: Column, graph: Column | None = None, simple: Column | None = None, encoder: Encoder = ENCODER) -> Column:
    """Degraded spans by a noise ``graph`` that ends in [vout], or by a ``simple`` filter, none where that is null; the sound is copied."""
    start = words("ffmpeg", "-y", "-i", source)
    if graph is not None:
        picture = F.concat(words("-filter_complex", graph, "-map", "[vout]"), when(audio, words("-map", "0:a")))
    else:
        picture = when(simple.isNotNull(), words("-vf", simple))
    return F.concat(start, picture, encoder.video(), F.when(audio, words("-c:a", "copy")).otherwise(words("-an")), _finish(target))


def compress_command(source: Column, target: Column, side: int = 224, fps: int = 3) -> Column:
    """The shorter side to ``side``, the other to an even length, without sound."""
    scale = f"scale='if(gt(a,1),trunc(oh*a/2)*2,{side})':'if(gt(a,1),{side},trunc(ow*a/2)*2)'"
    return words("ffmpeg", "-y", "-i", source, "-filter:v", scale, "-map", "0:v", "-r", str(fps), target)


def frame_command(source: Column, time: Column, target: Column, width: int = 336) -> Column:
    return words("ffmpeg", "-nostdin", "-y", "-ss", time.cast("string"), "-i", source, "-frames:v", "1", "-vf", f"scale={width}:-2", "-q:v", "3", target)


PROBE = "streams array<struct<codec_type string, width int, height int, r_frame_rate string>>, format struct<duration string>"


def probe(text: Column) -> Column:
    """struct(error, duration, audio, width, height, fps, rate) of a probe's JSON reply.

    ``error`` is null, "not JSON" (also for a null reply) or "no video stream", and all else null with it. A reply without duration has 0, one
    that is no number null; the rate counts as unknown where it is no number or divides by 0.
    """
    got = F.from_json(text, PROBE)
    streams = F.coalesce(got["streams"], F.array().cast("array<struct<codec_type string, width int, height int, r_frame_rate string>>"))
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    error = F.when(text.isNull() | parsed(text).isNull(), "not JSON").when(video.isNull(), "no video stream")
    good = lambda c, name: F.when(error.isNull(), c).alias(name)
    duration = F.when(got["format"]["duration"].isNull(), F.lit(0.0)).otherwise(got["format"]["duration"].try_cast("double"))
    audio = F.exists(streams, lambda s: s["codec_type"] == "audio")
    return F.struct(
        error.alias("error"), good(duration, "duration"), good(audio, "audio"), good(video["width"], "width"), good(video["height"], "height"),
        good(frame_rate(video["r_frame_rate"]), "fps"), good(video["r_frame_rate"], "rate"),
    )


def probe_verdict(probed: Column, expected: Column, tolerance: float = 2.0) -> Column:
    """``corrupt``, ``duration_mismatch`` (both durations known and further apart than the tolerance) or ``ok``."""
    apart = (expected > 0) & (F.abs(probed["duration"] - expected) > tolerance)
    return F.when(probed["error"].isNotNull(), "corrupt").when(F.coalesce(apart, F.lit(False)), "duration_mismatch").otherwise("ok")


def build_status(spans: Column, hits: Column, exists: Column, dry: bool) -> Column:
    """What would happen to a job: no spans, no or several inputs, already there, planned only, to be run."""
    return (
        F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, "skip_no_intervals")
        .when(F.coalesce(hits, F.lit(0)) == 0, "missing")
        .when(hits > 1, "ambiguous")
        .when(exists, "skip_exists")
        .otherwise("dry_run" if dry else "run")
    )


def outside_time(duration: Column, iv: Column, margin: float = 1.0) -> Column:
    """The first of 5 s, the middle, 80 % and 30 % that lies outside of every span by the margin."""
    candidates = F.array(F.lit(5.0), duration / 2, duration * 0.8, duration * 0.3)
    free = F.filter(candidates, lambda t: ~F.exists(iv, lambda x: (t >= x["start"] - margin) & (t <= x["end"] + margin)))
    return F.get(free, F.lit(0))


def retry_delays(attempts: int, most: int = 30) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda k: F.least(F.pow(F.lit(2.0), k), F.lit(float(most))))
