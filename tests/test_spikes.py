import datetime as dt
import math
import random

import numpy as np
import pytest

from tidemark.operators.medians import group_medians
from tidemark.operators.spikes import Limits, flag_readings, forward_backward

SCHEMA = "bar_id long, feed string, time timestamp, high double, low double, close double, volume double, load_no int, state string, day int"
T0 = dt.datetime(2024, 1, 2, 14, 30, tzinfo=dt.timezone.utc)


def series(n=120, feed="a", start=0, seed=1, level=100.0):
    rng = random.Random(seed)
    rows, c = [], level
    for i in range(n):
        c = round(c + rng.choice([-0.11, -0.05, 0.04, 0.12, 0.07]), 4)
        # 60 readings a day
        t = T0 + dt.timedelta(days=i // 60, minutes=5 * (i % 60))
        rows.append([start + i, feed, t, c + 0.05, c - 0.05, c, 1000.0 + rng.randrange(400), 1, "x", 0])
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return {r.bar_id: r.state for r in flag_readings(df, **kw).where("verified").collect()}


def test_clean_series_has_no_flags(spark):
    assert found(spark, series()) == {}


def test_hard_bounds(spark):
    r = series()
    r[10][3], r[10][4] = 90.0, 101.0  # high below low
    r[20][5] = 0.0
    r[30][5] = math.nan
    r[40][6] = -5.0
    r[50][6] = math.nan
    r[60][5] = r[60][3] + 1  # close above high
    got = found(spark, r)
    assert {10, 20, 30, 40, 50, 60} <= set(got)
    assert all(got[i] == "range" for i in (10, 20, 30, 40, 50, 60))


def test_nulls_are_no_reading(spark):
    r = series()
    for i in (5, 6, 7):
        r[i][5] = None
    r[8][6] = None
    r[9][3] = r[9][4] = None
    r[11][2] = None
    r[12][1] = None
    assert found(spark, r) == {}


def test_spikes_together_but_not_a_change_of_level(spark):
    r = series()
    for i in (30, 31, 32):
        for k in (3, 4, 5):
            r[i][k] += 9.0
    for i in range(80, 120):
        for k in (3, 4, 5):
            r[i][k] += 9.0
    r[50][3] += 9.0  # only the high
    assert set(found(spark, r)) == {30, 31, 32, 50}


def test_bad_first_load_and_its_copies(spark):
    r = series()
    bad = list(r[40])
    bad[0], bad[5], bad[3], bad[7] = 900, bad[5] + 9, bad[3] + 9, 0
    copy = list(bad)
    copy[0] = 901
    assert set(found(spark, [*r, bad, copy])) == {900, 901}


def test_stuck_runs(spark):
    r = series()
    for i in range(20, 28):  # eight equal closes
        r[i][3], r[i][4], r[i][5] = 100.05, 99.95, 100.0
    for i in range(35, 42):  # seven are fewer than eight
        r[i][6] = 777.0
    for i in range(56, 64):  # eight, but over two days
        r[i][6] = 555.0
    for i in range(80, 90):
        r[i][6] = 333.0
    r[84][6] = None
    got = found(spark, r)
    assert set(got) == {*range(20, 28), *range(80, 90)} - {84}


def test_volume(spark):
    r = series()
    r[70][6] = 1e6
    assert found(spark, r) == {70: "spike"}


def test_blocks_of_a_hot_feed_give_the_same(spark):
    r = series(600, seed=3)
    for i in (59, 60, 119, 300, 301):
        for k in (3, 4, 5):
            r[i][k] += 9.0
    r[200][6] = 1e6
    r += series(100, "b", 5000, 4)
    assert found(spark, r) == found(spark, r, block_rows=130)


def sparse(n, per_day, seed):
    """Readings with pairs and triples of spikes, stretches of nulls and repeated rows, ``per_day`` a day."""
    rng, rows, c = random.Random(seed), [], 100.0
    for i in range(n):
        c = round(c + rng.choice([-0.11, -0.05, 0.04, 0.12, 0.07]), 4)
        t = T0 + dt.timedelta(days=i // per_day, minutes=5 * (i % per_day))
        rows.append([i, "a", t, c + 0.05, c - 0.05, c, 1000.0 + rng.randrange(4000), 1, "x", 0])
    i = 20
    while i < n - 20:
        for j in range(i, i + rng.choice([1, 2, 3])):
            for k in (3, 4, 5):
                rows[j][k] += rng.choice([9.0, 12.0])
        i += rng.choice([4, 6, 15, 40])
    for a in range(50, n - 40, 200):
        for j in range(a, a + 25):
            rows[j][5] = None
    return rows + [[n + k, *rows[k * 7][1:]] for k in range(n // 20)]


@pytest.mark.parametrize(("n", "per_day", "block"), [(3000, 1, 100), (3000, 60, 100), (1500, 7, 37), (1200, 60, 1)])
def test_any_block_size_gives_the_same(spark, n, per_day, block):
    rows = sparse(n, per_day, n + per_day)
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    whole, cut = ({r.bar_id: (r.state, r.verified, round(r.p_spike, 9)) for r in flag_readings(df, **kw).collect()} for kw in ({}, {"block_rows": block}))
    assert whole == cut and sum(v for _, v, _ in whole.values()) > 100


def brute(rows):
    """The limits of the statement for readings of one feed, reading by reading."""
    rows = sorted((r for r in rows), key=lambda r: (r[2], r[7], r[0]))
    last = {r[2]: r[5] for r in rows if r[5] is not None and r[5] > 0 and not (r[3] is not None and r[5] > r[3]) and not (r[4] is not None and r[5] < r[4])}
    times = sorted(last)
    closes = [last[t] for t in times]
    steps = [abs(b - a) for a, b in zip(closes, closes[1:])]
    m = float(np.median(steps))
    departs = lambda x, a, b: x - max(a, b) > 10 * m or min(a, b) - x > 10 * m
    off = set()
    for k in (1, 2, 3):
        for i in range(len(closes) - k - 1):
            inside, a, b = closes[i + 1 : i + 1 + k], closes[i], closes[i + k + 1]
            if min(inside) - max(a, b) > 10 * m or min(a, b) - max(inside) > 10 * m:
                off |= set(range(i + 1, i + 1 + k))
    normal = [(t, c) for i, (t, c) in enumerate(zip(times, closes)) if i not in off]
    volumes = float(np.median([r[6] for r in rows if r[6] is not None]))
    out = set()
    for r in rows:
        before, after = [c for t, c in normal if t < r[2]], [c for t, c in normal if t > r[2]]
        if before and after and any(x is not None and departs(x, before[-1], after[0]) for x in r[3:6]):
            out.add(r[0])
        if (r[6] is not None and r[6] > 20 * volumes) or (r[3] is not None and r[4] is not None and r[3] < r[4]):
            out.add(r[0])
        if r[5] is not None and ((r[3] is not None and r[5] > r[3]) or (r[4] is not None and r[5] < r[4])):
            out.add(r[0])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_found_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = sparse(400, 40, seed)
    for _ in range(10):
        rows[rng.randrange(400)][6] = 2e5
        r = rows[rng.randrange(400)]
        r[rng.choice([3, 4])] += rng.choice([-9.0, 9.0])
    want = brute(rows)
    assert set(found(spark, rows)) == want and len(want) > 30


def test_a_spike_beside_a_steep_but_lasting_change(spark):
    r = series()
    for i in range(33, 120):  # the level rises just before three bad readings
        for k in (3, 4, 5):
            r[i][k] += 0.9
    for i in (34, 35, 36):
        for k in (3, 4, 5):
            r[i][k] -= 9.0
    assert set(found(spark, r)) == {34, 35, 36}


def test_flags_come_from_the_probabilities(spark):
    r = series()
    for i in range(20, 25):  # five equal closes: likely stuck, but no run of eight
        r[i][3], r[i][4], r[i][5] = 100.05, 99.95, 100.0
    df = spark.createDataFrame([tuple(x) for x in r], SCHEMA)
    got = {x.bar_id: x for x in flag_readings(df, Limits(decision=0.0)).collect()}
    assert len(got) == 120 and all(abs(x.p_spike + x.p_stuck + x.p_range) <= 1.0000001 for x in got.values())
    assert got[22].p_stuck > 20 * got[40].p_stuck and not got[22].verified
    some = {x.bar_id for x in flag_readings(df, Limits(decision=got[22].p_stuck)).collect()}
    assert 22 in some and 40 not in some


def test_empty(spark):
    assert found(spark, []) == {}


def test_forward_backward_matches_enumeration():
    from tidemark.operators.spikes import ENTER, _transitions

    rng = np.random.default_rng(0)
    like = rng.random((1, 4, 4))
    got = forward_backward(like.copy(), np.array([4]))[0]
    a, post = _transitions(), np.zeros((4, 4))
    for s in np.ndindex(4, 4, 4, 4):
        p = ENTER[s[0]] * like[0, 0, s[0]]
        for t in range(1, 4):
            p *= a[s[t - 1], s[t]] * like[0, t, s[t]]
        for t in range(4):
            post[t, s[t]] += p
    assert np.allclose(got, post / post.sum(1, keepdims=True))


@pytest.mark.parametrize("seed", range(3))
def test_group_medians(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("a", float(x)) for x in rng.normal(0, 50, 400).round(1)] + [("b", float(x)) for x in rng.lognormal(0, 3, 301)]
    rows += [("a", None), ("a", math.nan), ("b", math.inf), ("c", None), ("d", 0.0), ("d", -2.0)]
    got = {r.k: r.m for r in group_medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m").collect()}
    fin = lambda k: [v for g, v in rows if g == k and v is not None and math.isfinite(v)]
    assert set(got) == {"a", "b", "d"}
    for k in got:
        assert got[k] == pytest.approx(float(np.median(fin(k))))
