"""Mixing: shares, caps, repeats, and the deviation along the mix."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.mixing import mix, schedule

TARGETS = "mix_id string, source string, target_weight double, max_repeats int, size_share double"
SIZES = "doc_id bigint, source string, tokens bigint, mix_id string, slot int"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.integers(0, 120), max_size=6))
def test_schedule_keeps_every_source_within_one_block(blocks):
    slots, total = schedule(blocks), sum(blocks.values())
    assert sorted(s for v in slots.values() for s in v.tolist()) == list(range(total))
    for k, n in blocks.items():
        mine, done = set(slots[k].tolist()), 0
        assert slots[k].tolist() == sorted(slots[k].tolist())
        for t in range(total):
            done += t in mine
            assert abs(done - n / total * (t + 1)) < 1


def documents(spark, rnd, n=1500):
    source = lambda: "big" if rnd.random() < 0.6 else rnd.choice(["mid", "small", None])
    rows = [(i, source(), rnd.choice([None, 0, 1, 10, 100, 400])) for i in range(n)] + [(n + i, "tiny", 50) for i in range(4)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], SIZES).repartition(5)


@pytest.mark.parametrize(("period", "repeats"), [(64, 1024), (10_000, 1024), (7, 2)])
def test_shares_caps_and_order(spark, period, repeats):
    rows, df = documents(spark, random.Random(6))
    total = sum(r[2] or 0 for r in rows)
    supply = Counter()
    for _, s, t in rows:
        supply[s] += t or 0
    targets = [("m", "big", 3.0, 2, 0.5), ("m", "mid", 1.0, 2, 0.5), ("m", "tiny", 2.0, 3, 0.5), ("m", "absent", 1.0, 2, 0.5), ("m", "small", 0.0, 2, 0.5),
               ("free", "tiny", 1.0, None, 0.2), ("free", "mid", 1.0, None, 0.2), ("free", "mid", 1.0, None, 0.2), ("none", "big", 0.0, None, 1.0), ("none", "mid", None, None, 1.0), (None, "big", 1.0, None, 1.0)]
    chosen, shares = mix(df, "doc_id", "source", "tokens", spark.createDataFrame(targets, TARGETS), block_tokens=500, period_blocks=period, repeats=repeats)
    chosen, shares = chosen.collect(), {(r.mix_id, r.source): r for r in shares.collect()}
    tokens = {i: t for i, _, t in rows}
    got, uses = Counter(), Counter()
    for r in chosen:
        got[r.mix_id, r.source] += r.tokens
        uses[r.mix_id, r.doc_id] += 1
        assert r.tokens == tokens[r.doc_id] > 0
    assert len({(r.mix_id, r.doc_id, r.repeat_no) for r in chosen}) == len(chosen) and len({(r.mix_id, r.slot, r.place) for r in chosen}) == len(chosen)
    wanted = {"big": 3 / 7, "mid": 1 / 7}
    for s, w in wanted.items():
        assert abs(got["m", s] - min(w * total / 2, 2 * supply[s])) <= 400
    assert got["m", "tiny"] == 3 * supply["tiny"] and shares["m", "tiny"].limited_by == "max_repeats" and shares["m", "tiny"].most_uses == 3
    assert shares["m", "absent"].limited_by == "no documents" and got["m", "absent"] == got["m", "small"] == 0 and max(n for (m, _), n in uses.items() if m == "m") <= 3
    assert abs(got["free", "tiny"] - 0.2 * total / 3) <= 50 and abs(got["free", "mid"] - 0.2 * total * 2 / 3) <= 400
    assert all(got["none", s] == 0 for s in ("big", "mid")) and all(shares[k].reached_tokens == got[k] for k in shares)
    by = defaultdict(list)
    for r in chosen:
        by[r.mix_id].append(r)
    for m, items in by.items():
        items.sort(key=lambda r: (r.slot, r.place))
        end = {r.slot: i for i, r in enumerate(items)}
        run, per, size = 0, Counter(), sum(r.tokens for r in items)
        for i, r in enumerate(items):
            run += r.tokens
            per[r.source] += r.tokens
            if end[r.slot] == i:
                assert all(abs(per[s] - got[m, s] / size * run) <= 2 * 500 + 400 for s in {k[1] for k in got if k[0] == m})


def test_a_tiny_source_repeated_very_often_and_more_blocks_than_a_hyperperiod(spark):
    df = spark.createDataFrame([(1, "tiny", 3, "x", 1), (2, "tiny", 4, "x", 1)] + [(10 + i, "big", 1000, "x", 1) for i in range(200)], SIZES)
    targets = spark.createDataFrame([("m", "tiny", 1.0, None, 1.0), ("m", "big", 1.0, 1, 1.0)], TARGETS)
    base = None
    for period, repeats in ((16, 100), (4096, 10**6)):
        chosen = mix(df, "doc_id", "source", "tokens", targets, block_tokens=500, period_blocks=period, repeats=repeats)[0].collect()
        assert len({(r.doc_id, r.repeat_no) for r in chosen}) == len(chosen) == len({(r.slot, r.place) for r in chosen})
        picked = Counter((r.doc_id, r.repeat_no) for r in chosen)
        base = base or picked
        assert picked == base and max(n for _, n in picked) > 14_000
        run, per, last = 0, Counter(), None
        total = Counter()
        for r in chosen:
            total[r.source] += r.tokens
        whole = sum(total.values())
        for r in sorted(chosen, key=lambda r: (r.slot, r.place)):
            if last is not None and r.slot != last:
                assert all(abs(per[s] - total[s] / whole * run) <= 2 * 500 + 1000 for s in total)
            run, last = run + r.tokens, r.slot
            per[r.source] += r.tokens


def test_empty_tables(spark):
    none = spark.createDataFrame([], SIZES)
    targets = spark.createDataFrame([("m", "a", 1.0, 2, 0.5)], TARGETS)
    chosen, shares = mix(none, "doc_id", "source", "tokens", targets)
    assert chosen.collect() == [] and [(r.reached_tokens, r.limited_by) for r in shares.collect()] in ([(0, "no documents")], [(0, None)])
    df = spark.createDataFrame([(1, "a", 5, "x", 1)], SIZES)
    chosen, shares = mix(df, "doc_id", "source", "tokens", spark.createDataFrame([], TARGETS))
    assert chosen.collect() == [] and shares.collect() == []


def test_repeated_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", 10, "x", 1)] * 6, SIZES)
    chosen, _ = mix(df, "doc_id", "source", "tokens", spark.createDataFrame([("m", "a", 1.0, 1, 0.5)], TARGETS))
    assert len(chosen.collect()) == 3
