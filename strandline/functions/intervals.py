"""Interval algebra on arrays of struct(start, end) within a row; seconds as double.

All functions take and return columns, stay in the JVM and pass nulls through. For intervals spread over rows see
``operators.intervals``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:double,end:double>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def clean(iv: Column) -> Column:
    """Without null intervals and those with a null or NaN endpoint, as plain spans."""
    whole = F.filter(iv, lambda x: x["start"].isNotNull() & x["end"].isNotNull() & ~F.isnan(x["start"]) & ~F.isnan(x["end"]))
    return F.transform(whole, lambda x: span(x["start"], x["end"]))


def swap(iv: Column) -> Column:
    return F.transform(iv, lambda x: span(F.least(x["start"], x["end"]), F.greatest(x["start"], x["end"])))


def clip(iv: Column, low: Column, high: Column) -> Column:
    return F.transform(iv, lambda x: span(F.greatest(x["start"], low), F.least(x["end"], high)))


def drop_empty(iv: Column) -> Column:
    return F.filter(iv, lambda x: x["end"] > x["start"])


def merge(iv: Column) -> Column:
    """Sorted by start; an interval that starts at or before the end of the last one extends it."""
    none = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(x["start"] <= last["end"], F.lit(False)), F.concat(head, F.array(span(last["start"], F.greatest(last["end"], x["end"]))))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(iv), none, add)


def normalize(iv: Column, duration: Column | None = None, *, swapped: bool = True, keep_empty: bool = False) -> Column:
    """Clean, put in order, cut to [0, duration], drop what has no length, merge; each step by its flag."""
    out = clean(iv)
    if swapped:
        out = swap(out)
    if duration is not None:
        out = clip(out, F.lit(0.0), duration)
    if not keep_empty:
        out = drop_empty(out)
    return merge(out)


def union_length(merged: Column) -> Column:
    return F.aggregate(merged, F.lit(0.0), lambda a, x: a + x["end"] - x["start"])


def overlap_open(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def point_inside(t: Column, x: Column) -> Column:
    return (t >= x["start"]) & (t <= x["end"])


def hits(pred: Column, gold: Column) -> Column:
    """Any predicted span meets any gold span: open overlap, for a point of no length the closed test."""
    gold = clean(gold)
    return F.exists(pred, lambda p: F.exists(gold, lambda g: F.when(p["start"] == p["end"], point_inside(p["start"], g)).otherwise(overlap_open(p, g))))


def hits_strict(pred: Column, gold: Column) -> Column:
    """As :func:`hits` by open overlap alone: a two-element point never hits."""
    gold = clean(gold)
    return F.exists(pred, lambda p: F.exists(gold, lambda g: overlap_open(p, g)))


def covered(times: Column, gold: Column) -> Column:
    gold = swap(clean(gold))
    return F.exists(times, lambda t: F.exists(gold, lambda g: point_inside(t, g)))


def intersection_length(a: Column, b: Column) -> Column:
    """Summed pairwise intersection of two merged lists."""
    return F.aggregate(
        a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda r, y: r + F.greatest(F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])))
    )


def set_iou(a: Column, b: Column) -> Column:
    """IoU of two interval sets; 0 where the union has no length."""
    a, b = merge(clean(a)), merge(clean(b))
    inter = intersection_length(a, b)
    union = union_length(a) + union_length(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def tiou(a: Column, b: Column) -> Column:
    """Intersection over the hull; for a pair of spans, at least 0."""
    inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(inter, hull), F.lit(0.0)))


def tiop(pred: Column, gold: Column) -> Column:
    """Intersection over the length of the prediction; a point is 1 inside and 0 outside."""
    inter = F.least(pred["end"], gold["end"]) - F.greatest(pred["start"], gold["start"])
    length = pred["end"] - pred["start"]
    return F.when(length == 0, point_inside(pred["start"], gold).cast("double")).otherwise(F.greatest(F.lit(0.0), F.try_divide(inter, length)))


def iou_captions(a: Column, b: Column) -> Column:
    """Intersection over the smaller of hull and summed length, plus 1e-8."""
    inter = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    both = a["end"] - a["start"] + b["end"] - b["start"]
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return inter / (F.least(hull, both) + 1e-8)


def iou_smooth(a: Column, b: Column) -> Column:
    """(intersection + 1e-10) / (hull + 1e-10), at least 0."""
    inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.greatest(F.lit(0.0), (inter + 1e-10) / (hull + 1e-10))


def iou_matrix(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: tiou(x, y)))


def mask_cells(iv: Column, cells: int = 1000) -> Column:
    """Whole seconds that the spans cover, bounds rounded half to even, starts at 0 or later, below ``cells``."""
    low = lambda x: F.greatest(F.bround(x["start"]).cast("int"), F.lit(0))
    high = lambda x: F.least(F.bround(x["end"]).cast("int"), F.lit(cells))
    some = F.filter(clean(iv), lambda x: high(x) > low(x))
    return F.array_distinct(F.flatten(F.transform(some, lambda x: F.sequence(low(x), high(x) - 1))))


def mask_f1(pred: Column, gold: Column, cells: int = 1000) -> Column:
    p, g = mask_cells(pred, cells), mask_cells(gold, cells)
    tp = F.size(F.array_intersect(p, g))
    return F.coalesce(F.try_divide((2 * tp).cast("double"), (F.size(p) + F.size(g)).cast("double")), F.lit(0.0))


def combine_hull(a: Column, b: Column) -> Column:
    return span(F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))


def combine_cut(a: Column, b: Column) -> Column:
    """Intersection, or ``b`` where it is empty."""
    low, high = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(low <= high, span(low, high)).otherwise(span(b["start"], b["end"]))


def longest(iv: Column) -> Column:
    """The first of the longest spans."""
    none = F.lit(None).cast(SPAN)
    return F.aggregate(clean(iv), none, lambda best, x: F.when(best.isNull() | (x["end"] - x["start"] > best["end"] - best["start"]), x).otherwise(best))


def vote(iv: Column) -> Column:
    """The first span with the greatest summed IoU to all spans."""
    some = clean(iv)
    votes = F.transform(some, lambda x: F.aggregate(some, F.lit(0.0), lambda s, y: s + iou_smooth(x, y)))
    return F.get(some, (F.array_position(votes, F.array_max(votes)) - 1).cast("int"))


def gauss_window(center: Column, width: Column, gamma: float = 1.0, sigma: float = 9.0) -> Column:
    """(start, end) of a proposal on [0, 1]: centre -/+ gamma * width / sigma, clamped."""
    half = width * gamma / sigma
    return span(F.least(F.greatest(center - half, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(center + half, F.lit(0.0)), F.lit(1.0)))


def answer_text(iv: Column) -> Column:
    """``1.0 - 2.5 and 4.0 - 6.0 seconds``."""
    return F.concat(F.array_join(F.transform(clean(iv), lambda x: F.format_string("%.1f - %.1f", x["start"], x["end"])), " and "), F.lit(" seconds"))


def box_relative(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """[left, top, right, bottom] relative to the picture, and the relative area."""
    w, h = width.cast("double"), height.cast("double")
    return F.array(x1 / w, y1 / h, x2 / w, y2 / h, (x2 - x1) * (y2 - y1) / (w * h))
