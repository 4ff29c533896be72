"""Packing: the planner keeps the histogram and the capacity; placement is a bijection; odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing as P
from strandline.llm.tokens import RANKS, encoding, token_sizes


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.dictionaries(st.integers(1, 300), st.integers(1, 400), max_size=40))
def test_groups_hold_every_length_and_never_more_than_the_capacity(capacity, counts):
    counts = {min(x, capacity): n for x, n in counts.items()}
    groups = P.pack_histogram(counts, capacity)
    held = Counter()
    for g in groups:
        used = sum(x * m for x, m in g.runs.items())
        assert used + g.space == capacity and g.space >= 0 and g.n > 0
        for x, m in g.runs.items():
            held[x] += m * g.n
    assert held == Counter(counts)
    plan = P.slots(groups)
    length = np.concatenate([np.full(n, x) for x, n in counts.items()]) if counts else np.zeros(0, dtype=np.int64)
    rank = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, dtype=np.int64)
    box, place, offset = P.place(plan, length.astype(np.int64), rank.astype(np.int64))
    by = defaultdict(list)
    for row in zip(box.tolist(), place.tolist(), offset.tolist(), length.tolist()):
        by[row[0]].append(row[1:])
    assert len(by) == plan.containers
    for items in by.values():
        items.sort()
        assert [i[0] for i in items] == list(range(len(items)))
        at = 0
        for _, off, n in items:
            assert off == at
            at += n
        assert at <= capacity


def test_the_plan_does_not_grow_with_the_number_of_texts():
    rnd = random.Random(1)
    counts = Counter(min(512, max(1, int(rnd.lognormvariate(4.5, 1.2)))) for _ in range(20_000))
    small, large = (len(P.pack_histogram({x: n * k for x, n in counts.items()}, 512)) for k in (1, 10_000))
    assert large < 2 * small


def test_fill_is_high_where_lengths_allow_it():
    rnd = random.Random(2)
    counts = Counter(min(512, max(1, int(rnd.lognormvariate(4.5, 1.2)))) for _ in range(50_000))
    containers = sum(g.n for g in P.pack_histogram(dict(counts), 512))
    assert sum(x * n for x, n in counts.items()) / containers / 512 > 0.985


def check(rows, sizes, capacity):
    by, mine = defaultdict(list), Counter()
    for r in rows:
        by[r.container_id].append((r.place, r.offset, r.tokens))
    for items in by.values():
        items.sort()
        assert [i[0] for i in items] == list(range(len(items))) and sum(i[2] for i in items) <= capacity
        assert all(b[1] == a[1] + a[2] for a, b in zip(items, items[1:]))
    for r in rows:
        mine[r.doc_id] += r.tokens
    want = Counter()
    for d, n in sizes:
        want[d] += n or 0
    assert mine == want and Counter(r.doc_id for r in rows) == Counter(d for d, n in sizes for _ in range(max(1, -(-(n or 0) // capacity))))


def test_tables(spark):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice([None, 0, 1, 5, 7, 7, 7, 7, 20, 33, 64, 65, 200])) for i in range(500)] + [(1, 7), (1, 7), (None, 3)]  # repeated and null keys
    df = spark.createDataFrame([(*s, "x", 1) for s in sizes], "doc_id bigint, tokens bigint, plan_id string, length int")
    plans = spark.createDataFrame([("a", 64), ("b", 1), ("none", None), ("zero", 0)], "plan_id string, capacity_tokens int")
    rows = P.pack(df, "doc_id", "tokens", plans).collect()
    assert {r.plan_id for r in rows} == {"a", "b"}
    for plan, capacity in (("a", 64), ("b", 1)):
        check([r for r in rows if r.plan_id == plan], sizes, capacity)
    fill = {(r.plan_id, r.container_id): r for r in P.fill(P.pack(df, "doc_id", "tokens", plans), plans).collect()}
    assert all(0 <= r.fill <= 1 for r in fill.values())


@pytest.mark.parametrize("sizes", [[], [(1, 0)], [(1, None), (2, 0)], [(1, 5)] * 40])
def test_small_tables(spark, sizes):
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    plans = spark.createDataFrame([("a", 12)], "plan_id string, capacity_tokens int")
    check(P.pack(df, "doc_id", "tokens", plans).collect(), sizes, 12)


def test_no_plans(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint")
    assert P.pack(df, "doc_id", "tokens", spark.createDataFrame([], "plan_id string, capacity_tokens int")).collect() == []


def test_token_sizes(spark):
    long = "word " * 60_000
    texts = [None, "", "a", "naïve 画面", long, "x" * 200_000]
    got = {r.i: r.tokens for r in token_sizes(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    enc = encoding(RANKS)
    assert [got[i] for i in range(5)] == [0, 0, *(len(enc.encode_ordinary(t)) for t in texts[2:5])] and got[5] > 1000
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
