"""Tokenizers against one-record-at-a-time parsers, on odd, long and random records."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import tokenizer as T
from strandline.operators.parse_rows import load_json, parse_records, parse_replies, reply_problem
from strandline.plans.p3_parsing import FIELDS, question_problem


def split(s):
    """One record by RFC 4180, character by character; None where quoting fails."""
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + s[i], i + 1
            if i < len(s) and s[i] != ",":
                return None
            fields.append(text)
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return None
            fields.append(s[i:j])
            i = j
        if i >= len(s):
            return fields
        i += 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='",ab\n\\é', max_size=40), max_size=20), st.sampled_from([3, 7, 512]))
def test_tokenizer_states_equal_the_plain_parser(records, chunk):
    data, offsets = T.bytes_of(pa.array(records, pa.string()))
    got = T.run(T.delimited(), data, offsets, chunk)
    for i, r in enumerate(records):
        fields = split(r)
        assert (fields is None) == (got.state[i] in (T.FAILED, T.QUOTED))
        if fields is not None:
            assert (got.mark_record == i).sum() + 1 == len(fields)


def test_sliced_and_null_columns():
    column = pa.array(["x", None, 'a,"b', "c,d"])[1:]
    data, offsets = T.bytes_of(column)
    got = T.run(T.delimited(), data, offsets)
    assert list(got.state) == [T.FIRST, T.QUOTED, T.BARE] and list(np.bincount(got.mark_record, minlength=3)) == [0, 1, 1]


def record(**kw):
    row = dict(zip(FIELDS, ["1", "10", "20", "30", "why", "a", "3", "CW", "x", "y", "z", "v", "w"])) | kw
    return ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n') else v for v in row.values())


LONG = "q" * 300_000 + ',"' + "\n" * 10
CASES = [
    (record(), None), (record(question=LONG), None), (record(a1="null", a2=""), None), (record(frame_count=" 7 "), None), (record(question='say "hi", then'), None),
    (record() + ",x", "column_count"), ("", "column_count"), (None, "column_count"), (record()[:-2], "column_count"),
    ('"' + record(), "quoting"), (record(video_id="a") .replace("a", 'a"', 1), "quoting"), (record() + ',"', "quoting"), ('"a"b' + record(), "quoting"), ("x" * 100_000 + '"', "quoting"),
    (record(width="0"), "bad_value"), (record(width="1.5"), "bad_value"), (record(height="３６９"), "bad_value"), (record(qid=" "), "bad_value"), (record(question="a\x00b"), "bad_value"),
    (record(a0="\t"), "bad_value"), (record(type="cw"), "bad_value"), (record(question="a\tb\nc"), None),
]


def test_records(spark):
    rows = [(i, raw, "x", "y") for i, (raw, _) in enumerate(CASES)]
    made = parse_records(spark.createDataFrame(rows, "row_id bigint, raw_line string, reason string, f0 string"), "row_id", "raw_line", FIELDS, question_problem)
    got = {r.row_id: r for r in made.collect()}
    assert [got[i].reason for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[1].question == LONG and got[4].question == 'say "hi", then'
    assert got[14].detail.startswith("width") and got[13].at == 100_000
    assert parse_records(spark.createDataFrame([], "row_id bigint, raw_line string"), "row_id", "raw_line", FIELDS, question_problem).collect() == []


DEEP = "[" * 50_000 + "]" * 50_000
REPLIES = [
    (None, None), ('{"label": "ANSWERABLE"}', None), ('{"label": "ANSWERABLE", "answer": "B", "evidence_seconds": [1, 2.5]}', None), ('{"label": "UNANSWERABLE", "answer": null, "evidence_seconds": []}', None),
    ('{"label": "ANSWERABLE", "evidence_seconds": {"start": 1, "end": 2, "x": 3}}', None), ('{"label": "ANSWERABLE", "evidence_seconds": [{"start": 1, "end": 2}]}', None), ('{"label": "ANSWERABLE", "x": "\\ud800"}', None),
    ('{"label": "ANSWERABLE", "x": ' + DEEP + "}", None), ('{"label": "ANSWERABLE", "x": ' + "9" * 5000 + "}", None), (' \n{"label": "ANSWERABLE"}\t', None), ('{"label": "ANSWERABLE", "x": "' + "y" * 200_000 + '"}', None),
    ("", "bad_json"), ("nul", "bad_json"), ('{"label": "ANSWERABLE",}', "bad_json"), ('{"label": NaN}', "bad_json"), ('{"label": "a\nb"}', "bad_json"), ('{"label": "\\x"}', "bad_json"), ('{"label": "ANSWERABLE"', "bad_json"),
    ('{"label": "ANSWERABLE"} x', "bad_json"), ("{'label': 1}", "bad_json"), ('{"x": 01}', "bad_json"), ("\ufeff{}", "bad_json"), ('{"x": ' + DEEP + "]}", "bad_json"), ('{"x": "' + "y" * 100_000, "bad_json"),
    ("[1]", "not_object"), ('"x"', "not_object"), ("null", "not_object"), ("1e3", "not_object"), (DEEP, "not_object"),
    ("{}", "bad_value"), ('{"label": "answerable"}', "bad_value"), ('{"label": ["ANSWERABLE"]}', "bad_value"), ('{"label": "ANSWERABLE", "answer": "F"}', "bad_value"), ('{"label": "ANSWERABLE", "answer": ["A"]}', "bad_value"),
    ('{"label": "ANSWERABLE", "evidence_seconds": true}', "bad_value"), ('{"label": "ANSWERABLE", "evidence_seconds": [1, "2"]}', "bad_value"), ('{"label": "ANSWERABLE", "evidence_seconds": [1, {"start": 1, "end": 2}]}', "bad_value"),
]


def test_replies(spark):
    rows = [(i, raw, "x") for i, (raw, _) in enumerate(REPLIES)]
    got = {r.row_id: r for r in parse_replies(spark.createDataFrame(rows, "row_id bigint, model_parsed string, label string"), "row_id", "model_parsed").collect()}
    assert [got[i].reason for i in range(len(REPLIES))] == [want for _, want in REPLIES]
    assert [tuple(s) for s in got[2].spans] == [(1.0, 2.5)] and got[15].at == 12
    assert parse_replies(spark.createDataFrame([], "row_id bigint, model_parsed string"), "row_id", "model_parsed").collect() == []


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values, st.integers(0, 40), st.sampled_from(list('"\\{}[],:x1\n ')))
def test_json_reader_agrees_with_the_parser_and_the_stackless_reader(value, at, mark):
    from strandline.operators.parse_rows import NotJson, load_deep

    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False)[:at] + mark + json.dumps(value, ensure_ascii=False)[at:]):
        data, offsets = T.bytes_of(pa.array([text], pa.string()))
        lexed = T.run(T.json_lexer(), data, offsets, 5).state[0] == T.J_OUT
        try:
            want = load_json(text)
            assert lexed and load_deep(text) == want
        except ValueError:
            with pytest.raises((NotJson, ValueError)):
                load_deep(text)


def test_duplicate_labels_take_the_last():
    assert reply_problem(load_json('{"label": "x", "label": "ANSWERABLE"}')) is None
