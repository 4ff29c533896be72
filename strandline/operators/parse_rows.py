"""Typed rows and labelled failures from raw delimited records and from texts of one JSON value.

Both readers keep every input row: a row that parses has ``reason`` null and its typed values, any other has the reason,
the byte ``at`` which it shows, and a ``detail``. A null record counts as an empty one; a null JSON text is no failure.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import tokenizer as T

#: A check gets the fields of one record and returns None or (position of the field, what is wrong).
RecordCheck = Callable[[list[str]], tuple[int, str] | None]


def parse_records(df: DataFrame, key: str, raw: str, names: list[str], check: RecordCheck, comma: str = ",", quote: str = '"') -> DataFrame:
    """(*key, reason, at, detail, *names as string) of the records in ``raw``.

    Reasons, the first that holds: ``quoting`` (a quoted field is not closed, a closing quote is not followed at once by
    the comma or the end, a bare field holds a quote; ``at`` is the byte that shows it), ``column_count`` (``at`` is the
    end of the last field that has a name, or of the record), ``bad_value`` (``check``; ``at`` is the field's first byte).
    """
    auto = T.delimited(comma, quote)
    want, q = len(names), quote.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.bytes_of(batch.column(1))
            found = T.run(auto, data, offsets)
            n, buffer, origin = batch.num_rows, data.tobytes(), offsets.tolist()
            count = np.bincount(found.mark_record, minlength=n) + 1
            broken = (found.state == T.FAILED) | (found.state == T.QUOTED)
            first_mark = np.searchsorted(found.mark_record, np.arange(n + 1)).tolist()
            marks = found.mark_at.tolist()
            reasons: list[str | None] = [None] * n
            at: list[int | None] = [None] * n
            detail: list[str | None] = [None] * n
            fields: list[list[str | None]] = []
            for i in range(n):
                b, e = origin[i], origin[i + 1]
                row: list[str | None] = [None] * want
                if broken[i]:
                    closed = found.failed_at[i] >= 0
                    reasons[i], at[i] = "quoting", int(found.failed_at[i]) if closed else e - b
                    detail[i] = "misplaced quote" if closed else "quoted field is not closed"
                elif count[i] != want:
                    reasons[i], detail[i] = "column_count", f"{count[i]} fields"
                    at[i] = marks[first_mark[i] + want - 1] if count[i] > want else e - b
                else:
                    ends = marks[first_mark[i] : first_mark[i + 1]] + [e - b]
                    starts = [0] + [x + 1 for x in ends[:-1]]
                    got = []
                    for s, x in zip(starts, ends):
                        field = buffer[b + s : b + x]
                        if field[:1] == q:
                            field = field[1:-1].replace(q + q, q)
                        got.append(field.decode())
                    wrong = check(got)
                    if wrong is None:
                        row = got
                    else:
                        reasons[i], at[i], detail[i] = "bad_value", starts[wrong[0]], f"{names[wrong[0]]}: {wrong[1]}"
                fields.append(row)
            cols = [pa.array([r[k] for r in fields], pa.string()) for k in range(want)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(reasons, pa.string()), pa.array(at, pa.int64()), pa.array(detail, pa.string()), *cols],
                names=["key", "reason", "at", "detail", *[f"f{k}" for k in range(want)]],
            )

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), F.col(raw).cast("string").alias("raw"))
    made = slim.mapInArrow(run, f"key {kind}, reason string, at bigint, detail string, " + ", ".join(f"f{k} string" for k in range(want)))
    return made.select(F.col("key").alias(key), "reason", "at", "detail", *[F.col(f"f{k}").alias(c) for k, c in enumerate(names)])


class NotJson(ValueError):
    def __init__(self, what: str, pos: int = 0) -> None:
        super().__init__(what)
        self.pos = pos


def _no_constant(name: str) -> None:
    raise NotJson(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def load_deep(text: str) -> object:
    """One JSON value without recursion, for texts nested deeper than the interpreter's stack."""
    pos, stack, want, done, key = 0, [], "value", None, None
    text = text.rstrip(" \t\n\r")

    def put(value: object) -> str:
        nonlocal done
        if not stack:
            done = value
            return "end"
        holder = stack[-1]
        if isinstance(holder[0], dict):
            holder[0][holder[1]] = value
        else:
            holder[0].append(value)
        return "next"

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if m is None or want == "end":
            raise NotJson("not JSON", pos)
        pos = m.end()
        mark, string, number, literal = m.groups()
        if want in ("value", "value or end") and (string or number or literal or mark in ("[", "{")):
            if mark:
                stack.append([[] if mark == "[" else {}, None])
                want = "value or end" if mark == "[" else "key or end"
            else:
                want = put(json.loads(string) if string else float(number) if number else {"true": True, "false": False, "null": None}[literal])
        elif want in ("key", "key or end") and string:
            key, want = json.loads(string), "colon"
            stack[-1][1] = key
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and mark == ",":
            want = "key" if isinstance(stack[-1][0], dict) else "value"
        elif stack and (want == "next" or want.endswith("or end")) and mark == ("}" if isinstance(stack[-1][0], dict) else "]"):
            want = put(stack.pop()[0])
        else:
            raise NotJson("not JSON", pos)
    if want != "end":
        raise NotJson("ends early", len(text))
    return done


def load_json(text: str) -> object:
    """One JSON value by RFC 8259 (no NaN, no Infinity; numbers as float); raises ValueError otherwise."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=float)
    except RecursionError:
        return load_deep(text)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _span(x: object) -> bool:
    return isinstance(x, dict) and _number(x.get("start")) and _number(x.get("end"))


def reply_problem(value: dict) -> str | None:
    """What keeps a parsed object from being a reply."""
    if value.get("label") not in ("ANSWERABLE", "UNANSWERABLE"):
        return "label"
    if value.get("answer") is not None and not (isinstance(value["answer"], str) and value["answer"] in ("A", "B", "C", "D", "E")):
        return "answer"
    seconds = value.get("evidence_seconds")
    if seconds is None or _number(seconds) or _span(seconds):
        return None
    if isinstance(seconds, list) and (all(map(_number, seconds)) or all(map(_span, seconds))):
        return None
    return "evidence_seconds"


def _spans(seconds: object) -> list[dict]:
    """evidence_seconds as spans: a number or an array of one is a point, of more numbers their hull."""
    if seconds is None or seconds == []:
        return []
    if _number(seconds):
        seconds = [seconds]
    if isinstance(seconds, dict):
        seconds = [seconds]
    if isinstance(seconds[0], dict):
        return [{"start": float(s["start"]), "end": float(s["end"])} for s in seconds]
    return [{"start": float(min(seconds)), "end": float(max(seconds))}]


def _clean(x: object) -> str | None:
    """Text for an Arrow column: escaped surrogates without a partner become U+FFFD."""
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None


def parse_replies(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(*key, reason, at, detail, label, answer, evidence, spans array<struct<start, end>>, reply_reason) of the JSON texts in ``raw``.

    ``bad_json``: the lexer fails (``at`` is the byte), the text ends inside a string (its length) or the grammar fails
    (the byte at which the parser stopped); ``not_object``; ``bad_value``: label, answer or evidence_seconds (``detail``). Null gives a row without reason and values.
    """
    auto = T.json_lexer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.bytes_of(batch.column(1))
            found = T.run(auto, data, offsets)
            texts, size = batch.column(1).to_pylist(), np.diff(offsets)
            out: list[tuple] = []
            for i, text in enumerate(texts):
                reason = at = detail = None
                value: dict = {}
                if text is not None:
                    if found.state[i] != T.J_OUT:
                        at = int(found.failed_at[i])
                        reason, at, detail = "bad_json", at if at >= 0 else int(size[i]), "lexical" if at >= 0 else "string is not closed"
                    else:
                        try:
                            got = load_json(text)
                            if not isinstance(got, dict):
                                reason = "not_object"
                            elif (detail := reply_problem(got)) is not None:
                                reason = "bad_value"
                            else:
                                value = got
                        except ValueError as e:
                            reason, at, detail = "bad_json", len(text[: getattr(e, "pos", 0)].encode()), "grammar"
                out.append((reason, at, detail, value.get("label"), value.get("answer"), _clean(value.get("evidence")), _spans(value.get("evidence_seconds")) if value else None, _clean(value.get("reason"))))
            r = list(zip(*out))
            span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), span, pa.string()]
            names = ["key", "reason", "at", "detail", "label", "answer", "evidence", "spans", "reply_reason"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(r, kinds)]] if out else [pa.array([], batch.schema.field(0).type), *[pa.array([], k) for k in kinds]], names=names)

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), F.col(raw).cast("string").alias("raw"))
    schema = f"key {kind}, reason string, at bigint, detail string, label string, answer string, evidence string, spans array<struct<start double, end double>>, reply_reason string"
    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)
