"""Points in intervals and overlapping intervals per key, without a nested loop over the key.

Lengths fall into classes of powers of two. An interval lies in the few buckets of its class's width that it touches, so
no interval, however long, lies in many; points, and shorter intervals, are put into the buckets of every class that
occurs on the other side. The two meet by an equi-join on (key, class, bucket); the exact test follows. A pair of
intervals meets in the class of the longer one, and is kept in the first bucket they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond these bounds values share one bucket.
FAR = 1e15


def _near(c: Column) -> Column:
    return F.greatest(F.least(c.cast("double"), F.lit(FAR)), F.lit(-FAR))


def _class(start: Column, end: Column, width: float) -> Column:
    """The least k >= 0 with length <= width * 2**k."""
    return F.ceil(F.log2(F.greatest((_near(end) - _near(start)) / width, F.lit(1.0)))).cast("int")


def _bucket(c: Column, level: Column, width: float) -> Column:
    return F.floor(_near(c) / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("bigint")


def _levels(df: DataFrame, start: str, end: str, width: float) -> list[int]:
    """The classes that occur: at most some sixty."""
    return sorted(r.k for r in df.select(_class(F.col(start), F.col(end), width).alias("k")).distinct().collect())


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, *, closed: bool = True) -> DataFrame:
    """Every point with every interval of its key that holds it; ``closed``: ends count. Nulls, NaN points and reversed
    intervals match nothing. ``width`` is the width of the narrowest buckets and changes no result."""
    right = intervals.where(F.col(start) <= F.col(end))
    levels = _levels(right, start, end, width)
    right = right.withColumn("_level", _class(F.col(start), F.col(end), width))
    right = right.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_level"), width), _bucket(F.col(end), F.col("_level"), width))))
    left = points.where(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double"))).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    left = left.withColumn("_bucket", _bucket(F.col(at), F.col("_level"), width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)) if closed else (F.col(at) > F.col(start)) & (F.col(at) < F.col(end))
    return left.join(right, [*keys, "_level", "_bucket"]).where(inside).drop("_level", "_bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: float) -> DataFrame:
    """Every pair of intervals of a key that overlap or touch; reversed intervals and those with a null or NaN end match nothing."""
    left, right = (df.where((F.col(a) <= F.col(b)) & ~F.isnan(F.col(b).cast("double"))) for df, a, b in ((left, l_start, l_end), (right, r_start, r_end)))
    levels = sorted({*_levels(left, l_start, l_end, width), *_levels(right, r_start, r_end, width)})
    known = F.array(*map(F.lit, levels)).cast("array<int>")

    def spread(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        df = df.withColumn(f"_own_{name}", _class(F.col(a), F.col(b), width))
        df = df.withColumn("_level", F.explode(F.filter(known, lambda k: k >= F.col(f"_own_{name}"))))
        first, last = _bucket(F.col(a), F.col("_level"), width), _bucket(F.col(b), F.col("_level"), width)
        return df.withColumn(f"_first_{name}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    both = spread(left, l_start, l_end, "l").join(spread(right, r_start, r_end, "r"), [*keys, "_level", "_bucket"])
    both = both.where((F.col("_level") == F.greatest("_own_l", "_own_r")) & (F.col("_bucket") == F.greatest("_first_l", "_first_r")))
    return both.where((F.col(l_end) >= F.col(r_start)) & (F.col(l_start) <= F.col(r_end))).drop("_level", "_bucket", "_own_l", "_own_r", "_first_l", "_first_r")
