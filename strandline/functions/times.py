"""Time spans in free text, as arrays of struct(start, end) in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.intervals import SPAN, span
from strandline.functions.text import hms_seconds

#: Words that make a sentence a candidate for a lone number; fixed values.
TIME_WORDS = ["starts", "ends", "happens in", "start time", "end time", "start", "end", "happen"]
NUMBER = r"(\d+\.*\d*)"


def _numbered(text: Column, pattern: str) -> Column:
    a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    both = F.zip_with(a, b, lambda x, y: span(x.try_cast("double"), y.try_cast("double")))
    return F.filter(both, lambda s: s["start"].isNotNull() & s["end"].isNotNull())


def _paired(values: Column) -> Column:
    n = F.size(values)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), lambda i: span(F.get(values, i), F.get(values, i + 1)))).otherwise(none)


def _ordered(iv: Column) -> Column:
    return F.transform(iv, lambda x: span(F.least(x["start"], x["end"]), F.greatest(x["start"], x["end"])))


def spans_in_text(c: Column) -> Column:
    """The first reading that gives any span: ``a - b``; ``a to b``; the first number of each sentence with a time word,
    two by two; the same with h:mm:ss. Spans are put in order; null where there is none."""
    text = F.lower(c)
    sentences = F.filter(F.split(text, r"[!?\n]"), lambda s: s.rlike("|".join(TIME_WORDS)))
    dash, to = _numbered(text, NUMBER + r"\s*-\s*" + NUMBER), _numbered(text, NUMBER + r"\s* to \s*" + NUMBER)

    def firsts(pattern: str, value) -> Column:
        found = F.transform(sentences, lambda s: F.regexp_extract(s, pattern, 1))
        return _paired(F.transform(F.filter(found, lambda x: x != ""), value))

    lone = firsts(r"\b(\d+\.\d+\b|\b\d+)\b", lambda x: x.try_cast("double"))
    clock = firsts(r"\b(\d{1,2}:\d{2}:\d{2})\b", hms_seconds)
    made = F.when(F.size(dash) > 0, dash).when(F.size(to) > 0, to).when(F.size(lone) > 0, lone).when(F.size(clock) > 0, clock)
    return _ordered(made)


def time_part(c: Column, radius: float = 20.0) -> Column:
    """One span of a short text: ``a - b``; two clock times m:ss; one clock time or one number with ``radius`` around it
    (from it on for 2 * radius where it lies below); two numbers. Null otherwise."""

    def around(t: Column) -> Column:
        return F.when(t > radius, span(t - radius, t + radius)).otherwise(span(t, t + 2 * radius))

    dash = _numbered(c, NUMBER + r"\s*-\s*" + NUMBER)
    clocks = F.transform(F.regexp_extract_all(c, F.lit(r"\d+:\d+"), F.lit(0)), hms_seconds)
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    return (
        F.when(F.size(dash) > 0, F.get(dash, F.lit(0)))
        .when(F.size(clocks) == 2, span(F.get(clocks, F.lit(0)), F.get(clocks, F.lit(1))))
        .when(F.size(clocks) == 1, around(F.get(clocks, F.lit(0))))
        .when(F.size(numbers) == 1, around(F.get(numbers, F.lit(0))))
        .when(F.size(numbers) == 2, span(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))))
    )


def attention_segments(df: DataFrame, att: str, times: str, out: str, reach: float = 10.0, factor: float = 1.3) -> DataFrame:
    """``df`` with the segment around the greatest of the attention scores as ``out``.

    Scores are scaled to [0, 1]; from the maximum one walks both ways and keeps positions whose score, divided by
    1 + distance / reach, is at least ``factor`` times the mean; a miss beyond ``reach`` ends the walk. The walk to the
    left never takes position 0. Kept and missed are settled per position first, so that each walk is one scan.
    """
    low, high = F.array_min(att), F.array_max(att)
    df = df.withColumn("_scaled", F.transform(att, lambda x: (x - low) / (high - low + 1e-12)))
    df = df.withColumns({"_top": F.array_position("_scaled", F.array_max("_scaled")).cast("int") - 1, "_need": F.aggregate("_scaled", F.lit(0.0), lambda s, x: s + x) / F.size("_scaled") * factor})
    df = df.withColumn("_at", F.get(times, F.col("_top")))

    def state(i: Column) -> Column:
        away = F.abs(F.get(times, i) - F.col("_at"))
        kept = F.get("_scaled", i) / (1 + away / reach) >= F.col("_need")
        return F.when(kept, 1).when(away > reach, -1).otherwise(0)

    df = df.withColumn("_state", F.transform(F.sequence(F.lit(0), F.size("_scaled") - 1), state))
    nothing = F.array().cast("array<int>")
    left = F.when(F.col("_top") >= 2, F.sequence(F.col("_top") - 1, F.lit(1), F.lit(-1))).otherwise(nothing)
    right = F.when(F.col("_top") + 1 < F.size("_scaled"), F.sequence(F.col("_top") + 1, F.size("_scaled") - 1)).otherwise(nothing)
    df = df.withColumns({"_left": left, "_right": right})

    def walk(positions: str) -> Column:
        start = F.struct(F.col("_top").alias("last"), F.lit(False).alias("done"))

        def step(acc: Column, p: Column) -> Column:
            s = F.get("_state", p)
            return F.struct(F.when(~acc["done"] & (s == 1), p).otherwise(acc["last"]).alias("last"), (acc["done"] | (s == -1)).alias("done"))

        return F.aggregate(positions, start, step)["last"]

    df = df.withColumns({"_a": walk("_left"), "_b": walk("_right")}).withColumn(out, span(F.get(times, F.col("_a")), F.get(times, F.col("_b"))))
    return df.drop("_scaled", "_top", "_need", "_at", "_state", "_left", "_right", "_a", "_b")


def best_clip(att: Column, times: Column, width: int = 4) -> Column:
    """The clip of ``width`` scores with the greatest mean, the first on ties; the first of all where no mean is above 0."""
    clips = F.sequence(F.lit(0), F.floor((F.size(att) - 1) / width).cast("int"))
    means = F.transform(clips, lambda i: F.aggregate(F.slice(att, i * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x) / width)
    first = F.when(F.array_max(means) > 0, F.array_position(means, F.array_max(means)).cast("int") - 1).otherwise(0) * width
    return span(F.get(times, first), F.get(times, F.least(first + width, F.size(times)) - 1))


def best_frame(att: Column, times: Column) -> Column:
    at = F.array_position(att, F.array_max(att)).cast("int") - 1
    return span(F.get(times, at), F.get(times, at))
