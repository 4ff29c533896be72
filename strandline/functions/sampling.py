"""Time stamps and positions to sample, as arrays of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(n: Column) -> Column:
    """0 .. n - 1; an empty array for n <= 0 (``sequence`` alone would count down)."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def uniform(duration: Column, n: Column) -> Column:
    """Midpoints of n equal parts of [0, duration]."""
    return F.transform(steps(n), lambda i: (i + F.lit(0.5)) * duration / n)


def evidence(duration: Column, n: Column, iv: Column, share: float = 0.25) -> Column:
    """A share of the points as midpoints within the intervals by their length (at least one each), the rest over the
    whole; rounded to hundredths, made distinct, sorted, then cut to [0, duration - 0.01]. Without intervals uniform."""
    inside = F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    around = F.greatest(F.lit(0), n.cast("int") - inside)
    total = F.aggregate(iv, F.lit(0.0), lambda a, x: a + x["end"] - x["start"])

    def of(x: Column) -> Column:
        seg = x["end"] - x["start"]
        k = F.greatest(F.lit(1), F.bround(inside * seg / total).cast("int"))
        return F.transform(steps(k), lambda j: x["start"] + (j + F.lit(0.5)) * seg / k)

    points = F.when(total <= 0, F.transform(iv, lambda x: x["start"])).otherwise(F.flatten(F.transform(iv, of)))
    points = F.concat(points, F.transform(steps(around), lambda i: (i + F.lit(0.5)) * duration / F.greatest(around, F.lit(1))))
    rounded = F.array_sort(F.array_distinct(F.transform(points, lambda t: F.bround(t, 2))))
    top = F.greatest(duration - 0.01, F.lit(0.0))
    planned = F.transform(rounded, lambda t: F.least(F.greatest(t, F.lit(0.0)), top))
    return F.when(F.size(iv) > 0, planned).otherwise(uniform(duration, n))


def global_frames(last: Column, n: Column) -> Column:
    """Frame numbers at the middle of n equal parts of 0 .. last."""
    seg = last.cast("double") / n
    return F.transform(steps(n), lambda i: (seg / 2 + F.bround(seg * i)).cast("int"))


def clue_frames(iv: Column, fps: Column, n: Column) -> Column:
    """Frame numbers within the intervals, by their share of the length; all frames where there are no more than n."""
    frames = F.transform(iv, lambda x: F.struct((x["start"] * fps).cast("int").alias("a"), (x["end"] * fps).cast("int").alias("b")))
    total = F.aggregate(frames, F.lit(0), lambda s, x: s + F.greatest(x["b"] - x["a"], F.lit(0)))

    def some(x: Column) -> Column:
        k = F.greatest(F.lit(1), (n * (x["b"] - x["a"]) / F.greatest(total, F.lit(1))).cast("int"))
        seg = (x["b"] - x["a"]).cast("double") / k
        return F.transform(steps(k), lambda i: x["a"] + (seg / 2 + F.bround(seg * i)).cast("int"))

    whole = F.flatten(F.transform(frames, lambda x: F.transform(steps(x["b"] - x["a"]), lambda i: x["a"] + i)))
    return F.when(n >= total, whole).otherwise(F.flatten(F.transform(frames, some)))


def clip_centers(frames: Column, clips: Column) -> Column:
    """Centre frame of each of equal clips."""
    width = frames.cast("double") / clips
    return F.transform(steps(clips), lambda i: F.least(F.floor(i * width + width / 2).cast("int"), frames.cast("int") - 1))


def line_positions(n: Column, most: Column) -> Column:
    """``most`` whole positions from 0 to n - 1, evenly spaced and truncated; all where n is not above ``most``."""
    return F.when(n <= most, steps(n)).otherwise(F.transform(steps(most), lambda i: (i * (n - 1) / F.greatest(most - 1, F.lit(1))).cast("int")))


def stride_pad(values: Column, most: Column, pad: Column) -> Column:
    """At most ``most`` values at positions j * size div most, padded to ``most`` at the end."""
    size = F.size(values)
    taken = F.transform(steps(most), lambda j: F.get(values, (j.cast("bigint") * size / most).cast("int")))
    padded = F.concat(values, F.array_repeat(pad, F.greatest(most - size, F.lit(0))))
    return F.when(size > most, taken).otherwise(padded)


def mask(length: Column, size: Column) -> Column:
    """1 up to length, then 0, ``size`` long."""
    return F.transform(steps(size), lambda i: (i < length).cast("int"))


def gauss_weights(center: Column, width: Column, size: Column, sigma: float = 9.0, floor: float = 1e-2) -> Column:
    """Bell curve over ``size`` points of [0, 1], scaled to a maximum of 1."""
    w = F.greatest(width, F.lit(floor)) / sigma
    raw = F.transform(steps(size), lambda i: F.exp(-F.pow(i / F.greatest(size - 1, F.lit(1)) - center, F.lit(2.0)) / (2 * w * w)))
    return F.transform(raw, lambda x: x / F.array_max(raw))


def frame_time(index: Column, fps: Column) -> Column:
    return F.bround(F.try_divide(index.cast("double"), fps), 4)


def clip_slice(values: Column, first: Column, last: Column) -> Column:
    """values[first .. last], both included, counted from 0; what lies outside drops out."""
    low = F.greatest(first, F.lit(0))
    return F.slice(values, low + 1, F.greatest(F.least(last, F.size(values) - 1) - low + 1, F.lit(0)))
