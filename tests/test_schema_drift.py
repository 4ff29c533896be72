"""Changes per file against a plain reading of the definition, and the unified table."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from strandline.operators.schema_drift import canonical_target, cast_value, correspondences, drift, flood, json_type, leaves, name_similarity, notation_free, unify, RESULT_FIELDS

SCHEMA = "row_id bigint, file_id string, stream_id string, written_at timestamp, loaded_at timestamp, line_no int, line_text string, path string, pair string"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def frame(spark, files):
    """files: (stream, file, hour, [record or text or None])"""
    rows = []
    for stream, file, hour, lines in files:
        for k, r in enumerate(lines):
            text = r if r is None or isinstance(r, str) else json.dumps(r)
            rows.append((len(rows), file, stream, T0 + timedelta(hours=hour), T0, k, text, "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "a,b,same",
    [
        (0.3, "0.30", True), (0.3, "30%", True), ([0.3], 0.3, True), (1, 1.0, True), (1, "01", True), (1, True, False), ("true", True, True), ("A b", " a  B", True), ([1, 2.5], "1.0;2.5", True), ([1, 2], "1, 2", True),
        ("0", False, False), (10**20, str(10**20), True), (10**20, 10**20 + 1, False), ("", 0, False), ("x;y", "x; y", False), (-0.5, "-50 %", True), ([], 0, False),
    ],
)
def test_notation(a, b, same):
    assert (notation_free(a) == notation_free(b)) is same


def test_leaves_and_types():
    got = dict(leaves({"a": {"b": 1, "c": {}}, "d": [{"e": 1}], "f": None, "g": True}))
    assert got == {"a.b": 1, "d": [{"e": 1}], "f": None, "g": True}
    assert [json_type(x) for x in (None, True, 1, 1.5, [], "x")] == ["null", "boolean", "number", "number", "array", "string"]


def test_kinds(spark):
    base = [{"id": i, "alpha": i / 10, "cond": "full", "note": "x"} for i in range(10)]
    files = [
        ("s", "f2", 2, [{"id": str(i), "meta": {"alpha": f"{i * 10}%"}, "cond": ["full"], "extra": None} for i in range(10)]),  # written later, listed first
        ("s", "f1", 1, base),
        ("s", "f3", 3, [{"id": str(i), "meta": {"alpha": [i / 10]}, "cond": None, "extra": True} for i in range(10)] + [None, "not json", "[1]"]),
        ("t", "g1", 1, [{"a": 1}]),
        ("t", "g2", 2, ["{}"]),
        ("t", "g3", 3, [{"a": 1}, {"a": 1}]),
    ]
    got = sorted(tuple(r)[:3] for r in drift(frame(spark, files)).collect())
    assert got == sorted(
        [
            ("f2", "meta.alpha", "renamed"), ("f2", "meta.alpha", "type_changed"), ("f2", "id", "type_changed"), ("f2", "cond", "type_changed"), ("f2", "note", "removed"), ("f2", "extra", "added"),
            ("f3", "meta.alpha", "type_changed"), ("f3", "extra", "type_changed"), ("g2", "a", "removed"), ("g3", "a", "added"),
        ]
    )


def test_share_of_values_decides(spark):
    a = [{"x": i} for i in range(9)]
    files = [("s", "1", 1, a), ("s", "2", 2, [{"y": i} for i in range(6, 15)]), ("s", "3", 3, [{"z": i} for i in (6, 7, 8, 9, 50, 51, 52, 53, 54)])]
    got = sorted(tuple(r)[:3] for r in drift(frame(spark, files)).collect())
    assert got == [("2", "x", "removed"), ("2", "y", "added"), ("3", "z", "renamed")]  # 3 of 9 is not more than a third, 4 of 9 is


def test_two_candidates_go_to_the_better_one():
    match = correspondences([{"path": "alpha", "types": ["number"]}, {"path": "level", "types": ["number"]}], [{"path": "mask_alpha", "types": ["number"]}, {"path": "levels", "types": ["number"]}],
                            {("alpha", "mask_alpha"): 5, ("alpha", "levels"): 5, ("level", "mask_alpha"): 5, ("level", "levels"): 5}, {"alpha": 5, "level": 5}, {"mask_alpha": 5, "levels": 5}, 1 / 3)
    assert match == {"mask_alpha": "alpha", "levels": "level"}
    scores = flood([{"path": "m.alpha", "types": ["number"]}], [{"path": "m.alphas", "types": ["number"]}, {"path": "task", "types": ["string"]}], {})
    assert scores["m.alpha", "m.alphas"] > scores["m.alpha", "task"]
    assert name_similarity("Alpha", "alpha") == 1 and name_similarity("alpha", "task") < 0.3


def test_hot_stream_and_empty_table(spark):
    rnd = random.Random(1)
    files = [("hot", f"f{i:03}", i, [{rnd.choice(["a", "b"]): 1, "c": 2}]) for i in range(60)] + [("s", "g1", 1, [{"c": 1}])]
    want = []
    for (_, _, _, x), (_, f, _, y) in zip(files[:60], files[1:60]):
        x, y = set(x[0]), set(y[0])
        want += [(f, p, "renamed") for p in y - x]  # the value 1 is shared
    assert sorted(tuple(r)[:3] for r in drift(frame(spark, files)).collect()) == sorted(want)
    assert drift(frame(spark, [])).collect() == []


def test_unify_follows_names_through_a_stream(spark):
    files = [
        ("s", "1", 1, [{"video_id": "v", "alpha": 0.1 * i, "seed": i} for i in range(5)]),
        ("s", "2", 2, [{"video_id": "v", "strength": f"{10 * i}%"} for i in range(5)]),
        ("s", "3", 3, [{"Video_ID": "v", "cfg": {"lambda": [0.1 * i]}} for i in range(5)] + [None]),
    ]
    rows = sorted(unify(frame(spark, files)).collect(), key=lambda r: r.row_id)
    assert [round(r.alpha, 6) if r.alpha is not None else None for r in rows] == [0, 0.1, 0.2, 0.3, 0.4] * 3 + [None]
    assert [r.video_id for r in rows] == ["v"] * 15 + [None] and [r.seed for r in rows][:6] == [0, 1, 2, 3, 4, None] and rows[1].extra is None
    rows = sorted(unify(frame(spark, files), derive=0).collect(), key=lambda r: r.row_id)
    assert json.loads(rows[1].extra) == {"seed": 1}


def test_very_deep_lines(spark):
    deep = "[" * 200_000 + "]" * 200_000
    nested = '{"a":' * 20_000 + "1" + "}" * 20_000
    files = [("s", "1", 1, ['{"x": ' + deep + ', "y": 1}', nested]), ("s", "2", 2, ['{"z": ' + deep + ', "y": "1"}'])]
    got = sorted((r.file_id, r.field, r.change_kind) for r in drift(frame(spark, files)).collect() if len(r.field) < 10)
    assert got == [("2", "y", "type_changed"), ("2", "z", "renamed")]
    rows = sorted(unify(frame(spark, files), derive=0).collect(), key=lambda r: r.row_id)
    assert len(rows) == 3 and rows[0].extra == '{"x": ' + deep + ', "y": 1}'.replace("1", "1.0")


def test_fields_that_stayed_are_context():
    """Two new objects hold fields of one name; the sibling that stayed tells which is the old one."""
    f = lambda path, *types: {"path": path, "types": list(types)}
    old, new = [f("a.x", "number"), f("a.keep", "string"), f("q", "number")], [f("a.y", "number"), f("a.keep", "string"), f("b.y", "number"), f("q", "number")]
    scores = flood(old, new, {("a.x", "a.y"): 1.0, ("a.x", "b.y"): 1.0})
    assert scores["a.x", "a.y"] > scores["a.x", "b.y"] and scores["a.keep", "a.keep"] > 0.5
    assert correspondences(old, new, {("a.x", "a.y"): 3, ("a.x", "b.y"): 3, ("q", "b.y"): 3}, {"a.x": 3, "q": 3}, {"a.y": 3, "b.y": 3}, 1 / 3) == {"a.y": "a.x"}


def test_casts():
    assert cast_value("30%", "number") == 0.3 and cast_value([0.5], "number") == 0.5 and cast_value(True, "number") is None and cast_value("x", "number") is None
    assert cast_value("1.0;2", "numbers") == [1.0, 2.0] and cast_value("a;b", "numbers") is None and cast_value(["x"], "string") == "x" and cast_value(5, "string") == "5"
    assert canonical_target(["x", "alpha"], [], RESULT_FIELDS) == "alpha" and canonical_target(["mask_alpha"], ["number"], RESULT_FIELDS) == "alpha" and canonical_target(["seed"], ["number"], RESULT_FIELDS) is None
