"""Orphan references against brute force, with heavy keys on either side."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from strandline.operators.orphans import count_orphans, find_orphans

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(d):
    return None if d is None else T0 + timedelta(hours=d)


def brute(refs, targets):
    out = []
    for i, v, q, t in refs:
        if v is None or q is None or t is None:
            continue
        own = [x for x in targets if x[0] == v and x[1] == q]
        if any(a is not None and a <= t and (d is None or d > t) for _, _, a, d in own):
            continue
        reason = "missing" if not own else "deleted" if any(a is not None and a <= t for _, _, a, _ in own) else "late"
        out.append((i, reason))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"share": 0.9}, {"share": 0.1}, {"share": 0.1, "broadcast_rows": 1}])
def test_equals_brute_force(spark, options):
    rnd = random.Random(5)
    key = lambda: ("hot", "1") if rnd.random() < 0.4 else (rnd.choice(["a", "b", "c", None]), rnd.choice(["1", "2", None]))
    targets = [(*key(), a := rnd.choice([None, *range(0, 2000, 7)]), None if a is None or rnd.random() < 0.3 else a + rnd.randrange(-5, 300)) for _ in range(300)]
    targets = [t for t in targets if t[0] != "b"]
    refs = [(i, *key(), rnd.choice([None, *range(0, 2500, 3)])) for i in range(800)]
    refs += [(i, "ghost", "9", 5) for i in range(900, 1200)]  # a heavy key that is missing altogether
    r = spark.createDataFrame([(i, v, q, at(t), "x") for i, v, q, t in refs], "id int, video_id string, qid string, at timestamp, known string")
    t = spark.createDataFrame([(v, q, at(a), at(d), "y") for v, q, a, d in targets], "video_id string, qid string, loaded timestamp, deleted timestamp, known string")
    got = find_orphans(r, t, ["video_id", "qid"], "at", "loaded", "deleted", **options)
    assert got.columns == ["id", "video_id", "qid", "at", "known", "period", "reason"]
    assert sorted((x.id, x.reason) for x in got.collect()) == brute(refs, targets)
    by_id = {r[0]: r for r in refs}
    want = Counter((by_id[i][1], at(by_id[i][3]).strftime("%Y-%m"), reason) for i, reason in brute(refs, targets))
    made = count_orphans(r, t, ["video_id", "qid"], "at", "loaded", "deleted", ["video_id"], **options)
    assert {(x.video_id, x.period.strftime("%Y-%m"), x.reason): x.n for x in made.collect()} == want


def test_empty_tables(spark):
    r = spark.createDataFrame([], "id int, video_id string, qid string, at timestamp")
    t = spark.createDataFrame([], "video_id string, qid string, loaded timestamp, deleted timestamp")
    assert find_orphans(r, t, ["video_id", "qid"], "at", "loaded", "deleted").collect() == []
    r = spark.createDataFrame([(1, "a", "1", at(1))], "id int, video_id string, qid string, at timestamp")
    assert [x.reason for x in find_orphans(r, t, ["video_id", "qid"], "at", "loaded", "deleted").collect()] == ["missing"]
