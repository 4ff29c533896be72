"""Schemas that drift between files: what each file changed against its predecessor, by similarity flooding.

The fields of all files come from one pass over the lines; a file's predecessor comes from a global sort. Values are
read again only for fields that vanished or appeared in the same step. For such a step the two whole schema graphs
(paths, their names, JSON types and nesting, the unchanged fields included) are matched: start scores from names, types
and shared values are propagated along equal edges until they settle. The flooded scores decide the one-to-one
correspondences, best first; an exact check on the shared values can only refuse a pair. Graphs are as wide as a schema, not as long as a file, so matching one pair of files is a small task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import range_sorted, rescan, summarise
from strandline.operators.parse_rows import load_deep
from strandline.session import cut, stored

_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_SPLIT = re.compile(r"\s*[;,]\s*")
_OTHER = re.compile(r"[^a-z0-9]+")


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "array" if isinstance(v, list) else "string"


def loads(text: str | None) -> object:
    """One JSON value, however deep; None for null and for what is no JSON."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None
    except RecursionError:
        try:
            return load_deep(text)
        except ValueError:
            return None


def dumps(value: object) -> str:
    """JSON text with sorted keys, however deep."""
    try:
        return json.dumps(value, sort_keys=True)
    except RecursionError:
        out, todo = [], [value]
        while todo:
            v = todo.pop()
            if isinstance(v, _Mark):
                out.append(v)
            elif isinstance(v, dict):
                parts = [p for i, k in enumerate(sorted(v)) for p in (_Mark((", " if i else "") + json.dumps(k) + ": "), v[k])]
                todo += reversed([_Mark("{"), *parts, _Mark("}")])
            elif isinstance(v, list):
                parts = [p for i, x in enumerate(v) for p in ((_Mark(", "), x) if i else (x,))]
                todo += reversed([_Mark("["), *parts, _Mark("]")])
            else:
                out.append(json.dumps(v))
        return "".join(out)


class _Mark(str):
    """A piece of finished text."""


def leaves(record: object) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every value that is not an object; iterative, and paths are made for values only, so that depth does not matter."""
    todo = [(None, record)]
    while todo:
        at, obj = todo.pop()
        if isinstance(obj, dict):
            for k, v in obj.items():
                if isinstance(v, dict):
                    todo.append(((at, k), v))
                else:
                    steps, up = [k], at
                    while up is not None:
                        up, step = up
                        steps.append(step)
                    yield ".".join(reversed(steps)), v


def _quantity(text: str) -> str | None:
    """A number in one notation, also from a percentage."""
    percent = text.endswith("%")
    body = text[:-1].rstrip() if percent else text
    if not _NUMBER.fullmatch(body):
        return None
    if not percent and re.fullmatch(r"[+-]?[0-9]+", body):
        sign = "-" if body[0] == "-" else ""
        digits = body.lstrip("+-").lstrip("0") or "0"
        return digits if digits == "0" else sign + digits
    x = float(body) / (100 if percent else 1)
    return str(int(x)) if abs(x) < 1e15 and x == int(x) else f"{x:.12g}"


def notation_free(v: object) -> str:
    """A value without its notation: 0.3, "0.30", "30%" and [0.3] agree; lists agree with their delimited text; words
    ignore case and outer blanks; a boolean is a word and never a number."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return "#" + (_quantity(repr(v)) or repr(v))
    if isinstance(v, list):
        parts, todo = [], list(reversed(v))
        while todo:
            x = todo.pop()
            if isinstance(x, list) and x:
                todo += reversed(x)
            else:
                parts.append("" if x == [] else notation_free(x))
        return ";".join(parts)
    if isinstance(v, dict):
        return dumps(v)
    text = str(v).strip()
    number = _quantity(text)
    if number is not None:
        return "#" + number
    if text[:1] == "[" and text[-1:] == "]":
        try:
            return notation_free(json.loads(text))
        except (ValueError, RecursionError):
            pass
    if ";" in text or "," in text:
        parts = [_quantity(p) for p in _SPLIT.split(text)]
        if all(p is not None for p in parts):
            return ";".join("#" + p for p in parts)
    return " ".join(text.casefold().split())


def _fields(lines: DataFrame) -> DataFrame:
    """(file_id, stream_id, written_us, path, types): fields of every file; path is null in one row per file, so that a file without fields is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for file_id, stream, written, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen.add((file_id, stream, written, None, None))
                record = loads(text)
                seen.update((file_id, stream, written, path, json_type(v)) for path, v in leaves(record))
            cols = list(zip(*seen)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "stream_id", "written_us", "path", "type"])

    raw = lines.mapInArrow(run, "file_id string, stream_id string, written_us bigint, path string, type string")
    return raw.groupBy("file_id", "path").agg(F.first("stream_id").alias("stream_id"), F.min("written_us").alias("written_us"), F.collect_set("type").alias("types"))


def _successors(files: DataFrame) -> DataFrame:
    """(file_id, prev_id) of every file that has a predecessor in its stream by (written_us, file_id), by one global sort."""
    ordered = range_sorted(files.select("stream_id", "written_us", "file_id"), "stream_id", "written_us", "file_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        last = None
        for b in batches:
            last = {"stream": b.column(0)[-1].as_py(), "file": b.column(2)[-1].as_py()}
        return last

    carry, state = {}, (None, None)
    found = summarise(ordered, fold, "stream string, file string")
    for part in sorted(found):
        carry[part] = state
        state = (found[part]["stream"], found[part]["file"])

    def scan(state: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file = state or (None, None)
        for b in batches:
            streams, ids = b.column(0).to_pylist(), b.column(2).to_pylist()
            before = [f if s == t else None for f, s, t in zip([file, *ids[:-1]], [stream, *streams[:-1]], streams)]
            stream, file = streams[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(before, pa.string())], names=["file_id", "prev_id"])

    return rescan(ordered, carry, scan, "file_id string, prev_id string").where("prev_id IS NOT NULL")


def _values(lines: DataFrame, needs: DataFrame) -> DataFrame:
    """(pair, is_new, path, value) distinct hashes of the non-null values of the wanted paths. ``needs``: (file_id, wanted array<struct<pair, is_new, path>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = loads(text)
                got: dict[str, list[str]] = {}
                for path, v in leaves(record):
                    if v is not None:
                        got.setdefault(path, []).append(notation_free(v))
                for w in wanted:
                    seen.update((w["pair"], w["is_new"], w["path"], v) for v in got.get(w["path"], ()))
            cols = list(zip(*seen)) or [()] * 4
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pair", "is_new", "path", "v"])

    rows = lines.select("file_id", "line_text").join(needs, "file_id").select("line_text", "wanted")
    made = rows.mapInArrow(run, "pair string, is_new boolean, path string, v string")
    return made.select("pair", "is_new", "path", F.xxhash64("v").alias("value")).distinct()


def _grams(name: str) -> set[str]:
    text = f"  {_OTHER.sub('', name.lower())} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of letter triples of the names."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def _graph(fields: tuple[tuple[str, tuple[str, ...]], ...]) -> set[tuple]:
    """Labelled edges of a schema: root and objects to their members, leaves to their types."""
    edges = set()
    for path, types in fields:
        parent = ("o", "")
        steps = path.split(".")
        for depth in range(1, len(steps)):
            child = ("o", ".".join(steps[:depth]))
            edges.add((parent, "has", child))
            parent = child
        leaf = ("f", path)
        edges.add((parent, "has", leaf))
        edges.update((leaf, "type", ("t", t)) for t in types)
    return edges


@lru_cache(maxsize=512)
def _propagation(old: tuple, new: tuple) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, start scores without values, from, to, weights) of the pairwise connectivity graph of two schemas. The
    weight of a pair is spread evenly over its neighbours along edges of one label, in either direction."""
    ends: dict[tuple, list[tuple]] = {}
    starts: dict[tuple, list[tuple]] = {}
    right: dict[tuple, list[tuple]] = {}
    for x, label, y in _graph(new):
        right.setdefault((label, x[0], y[0]), []).append((x, y))
    for a, label, b in _graph(old):
        for x, y in right.get((label, a[0], b[0]), ()):
            ends.setdefault(((a, x), label), []).append((b, y))
            starts.setdefault(((b, y), label), []).append((a, x))
    number: dict[tuple, int] = {}
    edges = []
    for side in (ends, starts):
        for (pair, _), others in side.items():
            at = number.setdefault(pair, len(number))
            edges += [(at, number.setdefault(o, len(number)), 1 / len(others)) for o in others]
    types_old, types_new = ({p: set(t) for p, t in side} for side in (old, new))
    same = types_old.keys() & types_new.keys()

    def first(pair: tuple) -> float:
        (kind, a), (_, b) = pair
        if kind == "t":
            return 1.0 if a == b else 0.2
        if kind == "f" and (a in same or b in same):  # a field that stayed is itself
            return float(a == b)
        name = name_similarity(a.rpartition(".")[2], b.rpartition(".")[2]) if a or b else 1.0
        return name if kind == "o" else 0.3 * name + 0.1 * bool(types_old[a] & types_new[b])

    pairs = list(number)
    cols = list(zip(*edges)) or [(), (), ()]
    return pairs, np.array([first(p) for p in pairs]), np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.int64), np.array(cols[2], dtype=float)


def flood(old: list[dict], new: list[dict], shared: dict[tuple[str, str], float], rounds: int = 60, settled: float = 1e-3) -> dict[tuple[str, str], float]:
    """Scores of (old path, new path) when propagation has settled. Fields are {path, types}; ``shared`` is the share of common values."""
    key = [tuple(sorted((f["path"], tuple(sorted(f["types"]))) for f in side)) for side in (old, new)]
    pairs, start, source, target, weight = _propagation(*key)
    if not pairs:
        return {}
    start = start + 0.6 * np.array([shared.get((a[1], b[1]), 0.0) if a[0] == "f" else 0.0 for a, b in pairs])
    score = start
    for _ in range(rounds):
        both = start + score
        raised = both + np.bincount(target, weights=weight * both[source], minlength=len(pairs))
        raised = raised / (raised.max() or 1.0)
        moved = np.abs(raised - score).max()
        score = raised
        if moved < settled:
            break
    return {(a[1], b[1]): float(v) for (a, b), v in zip(pairs, score) if a[0] == "f"}


def correspondences(old: list[dict], new: list[dict], common: dict[tuple[str, str], int], size_old: dict[str, int], size_new: dict[str, int], least: float) -> dict[str, str]:
    """{new path: old path}, one to one among the fields that only one side has, best flooded score first; a pair must
    share more than ``least`` of the fewer values. ``old`` and ``new`` are whole schemas."""
    stayed = {f["path"] for f in old} & {f["path"] for f in new}
    fewer = {p: n / min(size_old[p[0]], size_new[p[1]]) for p, n in common.items()}
    scores = flood(old, new, fewer)
    match: dict[str, str] = {}
    taken = set(stayed)
    for p in sorted(fewer, key=lambda p: (-round(scores.get(p, 0.0), 9), -fewer[p], p)):
        if fewer[p] > least and p[0] not in taken and p[1] not in match and p[1] not in stayed:
            match[p[1]] = p[0]
            taken.add(p[0])
    return match


def drift(lines: DataFrame, least: float = 1 / 3) -> DataFrame:
    """(file_id, field, change_kind, old_field) of every change of a file against the previous file of its stream.

    ``lines``: file_id, stream_id, written_at, line_text (one JSON object each; other columns are ignored; a null line,
    or one that is no JSON object, adds no field). ``renamed``, ``added``, ``removed`` and ``type_changed`` as they
    are defined for p1_found; ``old_field`` is the former path of a renamed field. Lines loaded twice change nothing.
    """
    slim = lines.select("file_id", "stream_id", F.unix_micros("written_at").alias("written_us"), "line_text")
    fields = cut(_fields(slim))
    links = cut(_successors(fields.where("path IS NULL")))
    named = fields.where("path IS NOT NULL").select("file_id", "path", F.array_except("types", F.array(F.lit("null"))).alias("types"))
    # each file's fields take part twice: as the new side of its own step and as the old side of the next file's
    as_new = links.join(named, "file_id").select(F.col("file_id").alias("pair"), "path", F.lit(True).alias("is_new"), "types")
    as_old = links.join(named.withColumnRenamed("file_id", "prev_id"), "prev_id").select(F.col("file_id").alias("pair"), "path", F.lit(False).alias("is_new"), "types")
    sides = as_new.unionByName(as_old).groupBy("pair", "path").agg(
        F.first(F.when(F.col("is_new"), F.col("types")), True).alias("new_types"), F.first(F.when(~F.col("is_new"), F.col("types")), True).alias("old_types")
    )
    sides = stored(sides)
    retyped = sides.where("new_types IS NOT NULL AND old_types IS NOT NULL AND size(array_except(new_types, old_types)) > 0").select(F.col("pair").alias("file_id"), F.col("path").alias("field"), F.lit("type_changed").alias("change_kind"), F.lit(None).cast("string").alias("old_field"))

    gone, come = F.col("new_types").isNull(), F.col("old_types").isNull()
    both = sides.where(gone | come).groupBy("pair").agg(F.max(gone).alias("gone"), F.max(come).alias("come"))
    steps = stored(sides.join(both, "pair"))  # of files that lost or gained a field, with the fields that stayed
    single = steps.where(~(F.col("gone") & F.col("come")) & (gone | come)).select(
        F.col("pair").alias("file_id"), F.col("path").alias("field"), F.when(come, "added").otherwise("removed").alias("change_kind"), F.lit(None).cast("string").alias("old_field")
    )
    open_ = steps.where("gone AND come")
    undecided = open_.groupBy("pair").agg(F.collect_list(F.struct("path", "old_types", "new_types")).alias("fields"))  # as long as a schema is wide
    moved = open_.where(gone | come).select("pair", "path", come.alias("is_new"))

    asked = moved.join(links.withColumnRenamed("file_id", "pair"), "pair")
    needs = asked.select(F.when(F.col("is_new"), F.col("pair")).otherwise(F.col("prev_id")).alias("file_id"), F.struct("pair", "is_new", "path").alias("w"))
    needs = stored(needs.groupBy("file_id").agg(F.collect_list("w").alias("wanted")))  # a row per file; of known size, so that a small one spares the lines a shuffle
    values = stored(_values(slim, needs))
    sizes = values.groupBy("pair", "is_new", "path").agg(F.count(F.lit(1)).alias("n"))
    new, old = values.where("is_new").select("pair", "value", F.col("path").alias("new_path")), values.where("NOT is_new").select("pair", "value", F.col("path").alias("old_path"))
    common = new.join(old, ["pair", "value"]).groupBy("pair", "old_path", "new_path").agg(F.count(F.lit(1)).alias("n"))
    facts = undecided.join(sizes.groupBy("pair").agg(F.collect_list(F.struct("is_new", "path", "n")).alias("sizes")), "pair", "left").join(
        common.groupBy("pair").agg(F.collect_list(F.struct("old_path", "new_path", "n")).alias("common")), "pair", "left"
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, fs, ns, cs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                old = [{"path": f["path"], "types": f["old_types"]} for f in fs if f["old_types"] is not None]
                new = [{"path": f["path"], "types": f["new_types"]} for f in fs if f["new_types"] is not None]
                was, now = [f["path"] for f in fs if f["new_types"] is None], [f for f in new if all(f["path"] != o["path"] for o in old)]
                size = [{s["path"]: s["n"] for s in ns or () if s["is_new"] == side} for side in (False, True)]
                match = correspondences(old, new, {(c["old_path"], c["new_path"]): c["n"] for c in cs or ()}, size[0], size[1], least)
                types = {f["path"]: set(f["types"]) for f in old}
                for f in now:
                    former = match.get(f["path"])
                    out.append((pair, f["path"], "renamed" if former is not None else "added", former))
                    if former is not None and set(f["types"]) - types[former]:
                        out.append((pair, f["path"], "type_changed", former))
                gone = set(match.values())
                out.extend((pair, path, "removed", None) for path in was if path not in gone)
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["file_id", "field", "change_kind", "old_field"])

    decided = facts.select("pair", "fields", "sizes", "common").mapInArrow(decide, "file_id string, field string, change_kind string, old_field string")
    return retyped.unionByName(single).unionByName(decided)


#: The consistent result record: path and kind of each column; what fits none of them goes to ``extra`` as JSON text.
RESULT_FIELDS = {
    "video_id": "string", "qid": "string", "task": "string", "sampling": "string", "evidence_condition": "string", "sampled_seconds": "numbers",
    "model_response": "string", "model_parsed.label": "string", "model_parsed.answer": "string", "alpha": "number", "partial_mode": "string",
}
_TYPES = {"string": ["string"], "number": ["number"], "numbers": ["array"]}


def _scalar(v: object) -> object:
    """A list of one value is that value."""
    while isinstance(v, list) and len(v) == 1:
        v = v[0]
    return v


def cast_value(v: object, kind: str) -> object:
    """A value in the target's type, whatever its notation; None where it has no such value."""
    if kind == "numbers":
        parts = v if isinstance(v, list) else _SPLIT.split(v.strip()) if isinstance(v, str) else [v]
        out = [cast_value(x, "number") for x in parts]
        return out if all(x is not None for x in out) else None
    v = _scalar(v)
    if v is None:
        return None
    if kind == "number":
        text = notation_free(v)
        return float(text[1:]) if not isinstance(v, bool) and text[:1] == "#" and ";" not in text else None
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else dumps(v)


def canonical_target(names: list[str], types: list[str], targets: dict[str, str], least: float = 0.5) -> str | None:
    """The target field of a lineage: one it was ever called by, else the best flooded match with a similar name."""
    for n in names:
        if n in targets:
            return n
    scores = flood([{"path": p, "types": _TYPES[k]} for p, k in targets.items()], [{"path": n, "types": types} for n in names], {})
    best = max(scores, key=lambda p: (scores[p], p), default=None)
    if best is None:
        return None
    return best[0] if name_similarity(best[0].rpartition(".")[2], best[1].rpartition(".")[2]) >= least else None


def lineages(lines: DataFrame, changes: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(file_id, path, types, root, target) of every field of every file; ``changes`` is the result of :func:`drift`.

    A field's life in a stream begins where it is added or renamed; a renamed one has the life of its former name as
    parent. The first ancestor of each life comes from pointer jumping, which doubles the distance in every round.
    """
    slim = lines.select("file_id", "stream_id", F.unix_micros("written_at").alias("written_us"), "line_text")
    fields = cut(_fields(slim))
    files = fields.where("path IS NULL").select("file_id", "stream_id", "written_us")
    born = changes.where("change_kind IN ('added', 'renamed')").join(files, "file_id").select("stream_id", F.col("field").alias("path"), "written_us", "old_field")

    def latest(asks: DataFrame) -> DataFrame:
        """The life each (stream_id, path, at_us, ...) belongs to: its last birth up to then, else -1 for the stream's first file."""
        lives = born.select("stream_id", "path", F.col("written_us").alias("at_us"), F.col("written_us").alias("life"))
        both = asks.withColumn("life", F.lit(None).cast("bigint")).unionByName(lives, allowMissingColumns=True)
        over = Window.partitionBy("stream_id", "path").orderBy("at_us", F.col("life").isNull())
        return both.withColumn("since", F.coalesce(F.last("life", True).over(over), F.lit(-1))).where("life IS NULL").drop("life")

    asks = born.where("old_field IS NOT NULL").select("stream_id", F.col("old_field").alias("path"), (F.col("written_us") - 1).alias("at_us"), F.col("path").alias("child"), F.col("written_us").alias("child_us"))
    up = latest(asks).select("stream_id", F.col("child").alias("path"), F.col("child_us").alias("life"), F.col("path").alias("to_path"), F.col("since").alias("to_life"))
    up = cut(up)
    while True:
        far = up.select("stream_id", F.col("path").alias("to_path"), F.col("life").alias("to_life"), F.col("to_path").alias("far_path"), F.col("to_life").alias("far_life"))
        step = up.join(far, ["stream_id", "to_path", "to_life"], "left")
        step = cut(step.select("stream_id", "path", "life", F.coalesce("far_path", "to_path").alias("to_path"), F.coalesce("far_life", "to_life").alias("to_life"), F.col("far_path").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    seen = fields.where("path IS NOT NULL").select("file_id", "stream_id", "path", F.col("written_us").alias("at_us"), F.array_except("types", F.array(F.lit("null"))).alias("types"))
    placed = latest(seen).select("file_id", "stream_id", "path", "types", F.col("since").alias("life")).join(up, ["stream_id", "path", "life"], "left")
    placed = cut(placed.select("file_id", "stream_id", "path", "types", F.coalesce("to_path", "path").alias("root"), F.coalesce("to_life", "life").alias("root_life")))
    lines_of = placed.groupBy("stream_id", "root", "root_life").agg(F.sort_array(F.collect_set("path")).alias("names"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str | None] = {}
        for b in batches:
            out = []
            for root, names, types in zip(*(b.column(k).to_pylist() for k in (1, 3, 4))):
                key = (root, *names, None, *sorted(types))
                if key not in known:
                    known[key] = canonical_target([root, *[n for n in names if n != root]], sorted(types), targets)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], names=["stream_id", "root", "root_life", "target"])

    decided = lines_of.select("stream_id", "root", "root_life", "names", "types").mapInArrow(decide, "stream_id string, root string, root_life bigint, target string")
    return placed.join(decided, ["stream_id", "root", "root_life"]).select("file_id", "path", "types", "root", "target")


def derived_targets(placed: DataFrame, targets: dict[str, str], most: int) -> dict[str, str]:
    """{first name of a lineage: kind} of the lineages that fit no target, those in most files first: numbers where no file
    has another type, else text. At most ``most``; the values of the others are kept in ``extra``."""
    taken = {t.replace(".", "_").lower() for t in targets} | {"row_id", "file_id", "stream_id", "line_no", "extra"}
    kinds = placed.where("target IS NULL").groupBy("root").agg(F.countDistinct("file_id").alias("n"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))
    out: dict[str, str] = {}
    for r in kinds.orderBy(F.desc("n"), "root").limit(most).collect():  # as many as a table may have columns
        column = r.root.replace(".", "_").lower()
        if column not in taken:
            taken.add(column)
            out[r.root] = "number" if r.types == ["number"] else "string"
    return out


def unify(lines: DataFrame, targets: dict[str, str] | None = None, derive: int = 200) -> DataFrame:
    """(row_id, file_id, stream_id, line_no, one column per target, extra) of every line: fields under the names, places
    and types of their file, cast to one record. The targets are the given ones, and up to ``derive`` more from the
    lineages that fit none of them. Two fields of a file with the same target: the first by path that has a value. Lines
    that are null or no JSON object have null values. ``extra`` holds what has no target, or no value of its type, as JSON text."""
    targets = dict(targets or RESULT_FIELDS)
    placed = stored(lineages(lines, cut(drift(lines)), targets))
    more = derived_targets(placed, targets, derive)
    targets |= more
    named = F.when(F.col("root").isin(list(more)), F.col("root")) if more else F.lit(None).cast("string")
    maps = placed.withColumn("target", F.coalesce("target", named)).where("target IS NOT NULL").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("path", "target"))).alias("fields"))  # as long as a schema is wide
    arrow = {"string": pa.string(), "number": pa.float64(), "numbers": pa.list_(pa.float64())}
    spark_kind = {"string": "string", "number": "double", "numbers": "array<double>"}
    cols = {t: t.replace(".", "_") for t in targets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {t: [] for t in targets}
            extra: list[str | None] = []
            for text, fields in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                record = loads(text)
                got, rest = dict.fromkeys(targets), {}
                to = {f["path"]: f["target"] for f in fields or ()}
                for path, v in sorted(leaves(record), key=lambda x: x[0]):
                    target = to.get(path)
                    value = cast_value(v, targets[target]) if target is not None and got[target] is None else None
                    if value is not None:
                        got[target] = value
                    elif target is None or v is not None:
                        rest[path] = v
                for t in targets:
                    v = got[t]
                    out[t].append(v.encode("utf-8", "replace").decode() if isinstance(v, str) else v)
                extra.append(dumps(rest) if rest else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(out[t], arrow[k]) for t, k in targets.items()), pa.array(extra, pa.string())], names=["row_id", "file_id", "stream_id", "line_no", *cols.values(), "extra"])

    rows = lines.select("row_id", "file_id", "stream_id", "line_no", "line_text").join(maps, "file_id", "left")
    schema = "row_id bigint, file_id string, stream_id string, line_no int, " + ", ".join(f"{cols[t]} {spark_kind[k]}" for t, k in targets.items()) + ", extra string"
    return rows.select("row_id", "file_id", "stream_id", "line_no", "line_text", "fields").mapInArrow(run, schema)
