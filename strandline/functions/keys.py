"""Key columns in comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^([+-]?)0*([0-9]+)(?:\.0+)?$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def video_key(c: Column | str) -> Column:
    """Without surrounding spaces and tabs; case kept; null stays null."""
    return F.btrim(as_column(c), F.lit(" \t"))


def qid_key(c: Column | str) -> Column:
    """As :func:`video_key`; a whole number (``012``, ``12.0``) in plain digits, any other text as it is."""
    t = F.btrim(as_column(c).cast("string"), F.lit(" \t"))
    whole = F.regexp_replace(F.regexp_replace(t, WHOLE, "$1$2"), r"^(?:\+|-(?=0$))", "")
    # most qids are plain digits already, which a cast tells without a pattern
    return F.when(t.try_cast("bigint").cast("string") == t, t).when(t.rlike(WHOLE), whole).otherwise(t)


def alpha_key(c: Column | str) -> Column:
    """Alpha in hundredths, rounded; null equals null when grouped."""
    return F.round(F.round(as_column(c), 2) * 100).cast("bigint")


VIDEO_SQL = "trim({0}, E' \\t')"
QID_SQL = (
    "CASE WHEN regexp_full_match(trim({0}, E' \\t'), '[+-]?[0-9]+(\\.0+)?') "
    "THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, E' \\t'), '\\.0+$', ''), '^\\+', ''), '^(-?)0+([0-9])', '\\1\\2'), '^-0$', '0') "
    "ELSE trim({0}, E' \\t') END"
)
