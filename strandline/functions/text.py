"""Text and number functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Runs of white space, also of Unicode, become one blank; outer ones go."""
    return F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))


def ascii_share(c: Column) -> Column:
    """Share of ASCII characters; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")).cast("double"), F.length(c))


def match_options(answer: Column, options: Column) -> Column:
    """Indexes of the options that equal the answer without case and white space."""
    want = F.lower(clean_text(answer))
    hits = F.transform(options, lambda x, i: F.when(F.lower(clean_text(x)) == want, i))
    return F.filter(hits, lambda i: i.isNotNull())


def unique_option(answer: Column, options: Column) -> Column:
    """Index of the only matching option, else null."""
    hits = match_options(answer, options)
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def letter(index: Column) -> Column:
    """0 .. 4 as A .. E; null beyond."""
    return F.when((index >= 0) & (index <= 4), F.char(index + 65))


def short_number(c: Column) -> Column:
    """``%g``: six significant digits without trailing zeros; exponent form below 1e-4 and from 1e6 on."""
    x = c.cast("double")
    size = F.abs(x)
    # exponent of the value rounded to six significant digits
    sci = F.format_string("%.5e", x)
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None).cast("string")
    for e in range(-4, 6):
        plain = F.when(exp == e, F.format_string(f"%.{5 - e}f", x)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)
    form = F.format_string("%se%s%02d", mantissa, F.when(exp < 0, "-").otherwise("+"), F.abs(exp))
    return F.when(x.isNull(), None).when(size == 0, "0").when((exp >= -4) & (exp <= 5), plain).otherwise(form)


def numbers_in(c: Column) -> Column:
    """All unsigned numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def number_pairs(c: Column) -> Column:
    """The numbers of a text taken two by two; an odd last one drops out."""
    n = numbers_in(c)
    none = F.array().cast("array<struct<start:double,end:double>>")
    made = F.transform(F.sequence(F.lit(0), F.size(n) - 2, F.lit(2)), lambda i: F.struct(F.get(n, i).alias("start"), F.get(n, i + 1).alias("end")))
    return F.when(F.size(n) >= 2, made).otherwise(none)


def question_mark(c: Column) -> Column:
    """First letter upper, the rest lower case, outer blanks off, a question mark on."""
    return F.concat(F.trim(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000_000)))), F.lit("?"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")


def question_kind(c: Column) -> Column:
    """Class by the first words: whata (what does/do/did), whatb (what is/are/was/were), whato (other what), howm (how many), the other question words as they are, else other."""
    w = words(c)
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    what = F.when(second.isin("does", "do", "did"), "whata").when(second.isin("was", "were", "is", "are"), "whatb").otherwise("whato")
    return (
        F.when(first == "what", what)
        .when((first == "how") & F.coalesce(second == "many", F.lit(False)), "howm")
        .when(first.isin("who", "which", "why", "how", "where"), first)
        .otherwise("other")
    )


def keyword_class(c: Column, classes: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The first class with a keyword in the lower-cased text."""
    out = None
    for name, keys in classes:
        hit = F.lower(c).rlike("|".join(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def non_ascii_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def strip_last_dot(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\.$", "")


def boolean_word(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.when(w.isin("yes", "true", "t", "y", "1"), True).when(w.isin("no", "false", "f", "n", "0"), False)


def strict_boolean(c: Column) -> Column:
    """As :func:`boolean_word`; any other word, but not null, is an error."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(boolean_word(c), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")))


def level_list(c: Column) -> Column:
    """The numbers of a comma list; blanks are skipped, a list without any and a word that is no number are errors."""
    parts = F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")
    numbers = F.transform(parts, lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")))
    return F.when(c.isNull(), F.lit(None).cast("array<double>")).when(F.size(parts) == 0, F.raise_error(F.lit("no levels")).cast("array<double>")).otherwise(numbers)


def frame_rate(c: Column) -> Column:
    """``30000/1001`` or ``29.97``; null where it is neither or divides by 0."""
    top, bottom = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(c.contains("/"), F.try_divide(top, bottom)).otherwise(c.try_cast("double"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def hms_seconds(c: Column) -> Column:
    """Seconds of ``h:mm:ss`` or ``mm:ss``."""
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
