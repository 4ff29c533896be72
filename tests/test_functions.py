"""Column functions on the boundary cases."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import keys, media, replies, sampling, text, times
from strandline.functions.intervals import SPAN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [(" 12 ", "12"), ("012", "12"), ("12.0", "12"), ("\t7\t", "7"), ("000", "0"), ("-0", "0"), ("-05.00", "-5"), ("+3", "3"), ("1.5", "1.5"), ("q-1", "q-1"), ("", ""), (None, None), ("9" * 40, "9" * 40), ("1e3", "1e3"), ("１２", "１２")])
def test_qid(spark, raw, want):
    assert one(spark, keys.qid_key(F.lit(raw).cast("string"))) == want


def test_video_key_keeps_case_and_inner_blanks(spark):
    assert one(spark, keys.video_key(F.lit("\t A b \t"))) == "A b"


@pytest.mark.parametrize("x,want", [(0.0, "0"), (12.5, "12.5"), (1e6, "1e+06"), (999999.5, "1e+06"), (1e-4, "0.0001"), (1e-5, "1e-05"), (123456.7, "123457"), (-2.25, "-2.25"), (100.0, "100"), (1 / 3, "0.333333")])
def test_short_number(spark, x, want):
    assert one(spark, text.short_number(F.lit(x))) == want == f"{x:g}"


@pytest.mark.parametrize("answer,options,want", [("Same", ["a", " same ", "b"], 1), ("same", ["same", "same"], None), ("x", ["a"], None), ("a  b", ["A B"], 0)])
def test_unique_option(spark, answer, options, want):
    assert one(spark, text.unique_option(F.lit(answer), F.array(*map(F.lit, options)))) == want


def test_clean_text_takes_unicode_blanks(spark):
    assert one(spark, text.clean_text(F.lit(" a 　b\n\tc "))) == "a b c"


@pytest.mark.parametrize("q,want", [("What does it", "whata"), ("what is it", "whatb"), ("what", "whato"), ("How many", "howm"), ("how", "how"), ("when so", "other"), ("who", "who")])
def test_question_kind(spark, q, want):
    assert one(spark, text.question_kind(F.lit(q))) == want


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"evidence_seconds": 5}', [(5, 5)]), ('{"evidence_seconds": 0}', []), ('{"evidence_seconds": [7, 3, "x"]}', [(3, 7)]), ('{"evidence_seconds": [4]}', [(4, 4)]), ('{"evidence_seconds": {"start": 9, "end": 2}}', [(9, 2)]),
        ('{"evidence_seconds": [{"start": 1, "end": 2}, {"start": 3}]}', [(1, 2)]), ('{"evidence_seconds": []}', []), ('{"evidence_seconds": null}', []), ("{}", []), ("broken", []), ('{"evidence_seconds": [1, 2]} x', []),
    ],
)
def test_predicted_spans(spark, reply, want):
    got = one(spark, replies.predicted_spans(replies.parsed(F.lit(reply))))
    assert [(s.start, s.end) for s in got] == want


@pytest.mark.parametrize("raw,error", [('```json\n{"label": "X"}\n```', None), ("see {\"label\": 1} end", None), ("none", "no_object"), ("{bad}", "invalid"), (None, "empty")])
def test_model_json(spark, raw, error):
    assert one(spark, replies.model_json(F.lit(raw).cast("string"))).error == error


@pytest.mark.parametrize(
    "t,want",
    [
        ("from 12.5 - 3 and 4 - 5", [(3, 12.5), (4, 5)]), ("10 to 20", [(10, 20)]), ("It starts at 7.\nIt ends at 9.", [(7, 9)]), ("starts at 5", None), ("nothing", None), ("", None),
    ],
)
def test_spans_in_text(spark, t, want):
    got = one(spark, times.spans_in_text(F.lit(t)))
    assert want == (None if got is None else [(s.start, s.end) for s in got])


@pytest.mark.parametrize("t,want", [("3 - 9", (3, 9)), ("1:05", (45, 85)), ("0:10", (10, 50)), ("1:00 and 2:30", (60, 150)), ("7", (7, 47)), ("30", (10, 50)), ("1 2", (1, 2)), ("x", None)])
def test_time_part(spark, t, want):
    got = one(spark, times.time_part(F.lit(t)))
    assert want == (None if got is None else (got.start, got.end))


def test_sampling_edges(spark):
    none = F.array().cast(f"array<{SPAN}>")
    assert one(spark, sampling.uniform(F.lit(10.0), F.lit(4))) == [1.25, 3.75, 6.25, 8.75]
    assert one(spark, sampling.uniform(F.lit(10.0), F.lit(0))) == []
    assert one(spark, sampling.evidence(F.lit(10.0), F.lit(2), none)) == [2.5, 7.5]
    assert one(spark, sampling.mask(F.lit(2), F.lit(4))) == [1, 1, 0, 0]
    assert one(spark, sampling.stride_pad(F.array(*map(F.lit, range(5))), F.lit(3), F.lit(0))) == [0, 1, 3]
    assert one(spark, sampling.stride_pad(F.array(F.lit(1)), F.lit(3), F.lit(0))) == [1, 0, 0]
    assert one(spark, sampling.clip_slice(F.array(*map(F.lit, range(5))), F.lit(3), F.lit(9))) == [3, 4]


def test_evidence_sampling_equals_the_formula(spark):
    span = F.array(F.struct(F.lit(2.0).alias("start"), F.lit(4.0).alias("end")), F.struct(F.lit(10.0).alias("start"), F.lit(16.0).alias("end")))
    n_e, n_g, d = 4, 12, 40.0
    want = [2 + (j + 0.5) * 2 / 1 for j in range(1)] + [10 + (j + 0.5) * 6 / 3 for j in range(3)] + [(i + 0.5) * d / n_g for i in range(n_g)]
    assert one(spark, sampling.evidence(F.lit(d), F.lit(16), span)) == sorted({round(t, 2) for t in want}) and n_e == 4


def test_status_machine(spark):
    some, none = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end"))), F.array().cast(f"array<{SPAN}>")
    got = [one(spark, media.build_status(s, F.lit(n), F.lit(e), True)) for s, n, e in ((none, 1, False), (some, 0, False), (some, 2, False), (some, 1, True), (some, 1, False))]
    assert got == ["skip_no_intervals", "missing", "ambiguous", "skip_exists", "dry_run"]
