"""Indicators, DSL, backtests, metrics, walk-forward and significance on small fixtures."""

import datetime as dt
import json
import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.functions.indicators import Indicator, add_indicators, buffer_length, check_arguments, lookback, need, over_long_series
from tidemark.operators import custom, dips, metrics, opening_range, resample, scoring, significance, walkforward
from tidemark.operators.backtest import BacktestConfig, Engine, Bar, Entry, Exit, backtest_signals, run_custom
from tidemark.operators.prefix import previous, running, with_halo

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2024, 1, 8, 9, 30)


def daily(closes, symbol="S", start=dt.datetime(2024, 1, 1)):
    return [(symbol, start + dt.timedelta(days=i), float(c), c + 0.5, c - 0.5, float(c), 1000.0) for i, c in enumerate(closes)]


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def last(spark, closes, *inds, buffer=None):
    d = add_indicators(frame(spark, daily(closes)), ["symbol"], list(inds), buffer=buffer)
    return d.orderBy(F.desc("ts")).first()


# ---- indicators


def test_simple_values(spark):
    r = last(spark, [100, 101, 102, 103, 104], Indicator("s", "sma", {"period": 5}), Indicator("r", "rsi", {"period": 3}), Indicator("c", "roc", {"period": 4}), Indicator("p", "percent_rank", {"period": 4}), Indicator("d", "daily_return"))
    assert (r.s, r.r, r.c, r.p) == (102.0, 100.0, pytest.approx(4.0), 1.0) and r.d == pytest.approx(104 / 103 - 1)
    down = last(spark, [104, 103, 102, 101], Indicator("r", "rsi", {"period": 3}), Indicator("p", "percent_rank", {"period": 4}), Indicator("z", "zscore", {"period": 4}))
    assert (down.r, down.p) == (0.0, 0.25) and down.z == pytest.approx(-1.5 / np.std([104, 103, 102, 101]))
    flat = last(spark, [5, 5, 5, 5], Indicator("z", "zscore", {"period": 4}), Indicator("b", "bb_upper", {"period": 4}), Indicator("a", "atr", {"period": 2}))
    assert (flat.z, flat.b, flat.a, flat.warm) == (None, 5.0, 1.0, False)


def test_too_short_is_null(spark):
    for kind, params in (("sma", {"period": 5}), ("rsi", {"period": 4}), ("atr", {"period": 4}), ("roc", {"period": 4}), ("ema", {"period": 5}), ("macd", {"fast": 2, "slow": 3, "signal": 2})):
        r = last(spark, [1, 2, 3, 4], Indicator("x", kind, params))
        assert r.x is None and not r.warm


def test_recursive_ones_against_loops(spark):
    rng = random.Random(5)
    closes = [100 + rng.gauss(0, 3) for _ in range(60)]
    r = last(spark, closes, Indicator("e", "ema", {"period": 7}), Indicator("w", "rsi", {"period": 5, "smoothing": "wilder"}), Indicator("m", "macd", {"fast": 4, "slow": 9, "signal": 3}), Indicator("g", "macd_signal", {"fast": 4, "slow": 9, "signal": 3}), buffer=40)
    x = closes[-40:]

    def ema(v, n):
        out = sum(v[:n]) / n
        for c in v[n:]:
            out += (c - out) * 2 / (n + 1)
        return out

    gains = [max(b - a, 0) for a, b in zip(x, x[1:])]
    losses = [max(a - b, 0) for a, b in zip(x, x[1:])]
    g, lo = sum(gains[:5]) / 5, sum(losses[:5]) / 5
    for a, b in zip(gains[5:], losses[5:]):
        g, lo = (g * 4 + a) / 5, (lo * 4 + b) / 5
    series = [ema(x[:i], 4) - ema(x[:i], 9) for i in range(10, 41)]
    assert r.e == pytest.approx(ema(x, 7)) and r.w == pytest.approx(100 - 100 / (1 + g / lo))
    assert r.m == pytest.approx(series[-1]) and r.g == pytest.approx(ema(series, 3))


def test_chunks_of_long_series_change_nothing(spark):
    rows = [("S", T0 + dt.timedelta(hours=i), 1.0, 1.0, 1.0, float(i % 17), 1.0) for i in range(300)]
    inds = [Indicator("s", "sma", {"period": 30}), Indicator("e", "ema", {"period": 10})]
    whole = {(r.ts, r.s, r.e) for r in add_indicators(frame(spark, rows), ["symbol"], inds).collect()}
    assert {(r.ts, r.s, r.e) for r in over_long_series(frame(spark, rows), inds, rows=40).collect()} == whole


def test_arguments():
    assert (lookback("macd", {}), lookback("rsi", {}), lookback("daily_return", {}), need("rsi", {"period": 7}), need("sma", {"period": 7})) == (35, 14, 0, 8, 7)
    assert buffer_length([Indicator("a", "sma", {"period": 200}), Indicator("b", "percent_rank")]) == 210
    for kind, params in (("sma", {}), ("sma", {"period": 3, "x": 1}), ("nope", {})):
        with pytest.raises(ValueError):
            check_arguments(kind, params)


# ---- DSL


def doc(**kw):
    cmp = {"op": "compare", "operator": "<", "lhs": {"op": "indicator", "name": "r"}, "rhs": {"op": "param", "name": "p"}}
    return {
        "name": "x", "archetype": "a", "thesis": "t", "supported_assets": ["stocks"], "timeframes": ["1h"], "parameters": [{"name": "p", "type": "float", "default": 30.0, "description": "d"}],
        "indicators": [{"name": "r", "type": "rsi", "params": {"period": 3}}], "entry_long": cmp, "entry_short": None, "exit_long": None, "exit_short": None, "position_sizing": {"rule": "fixed", "size": 2},
    } | kw


def test_text_clauses_and_hash():
    a = dsl.parse(doc())
    b = dsl.parse(json.dumps(doc(name="y", thesis="other", entry_long=json.dumps(doc()["entry_long"]))))
    assert dsl.spec_hash(a) == dsl.spec_hash(b) and len(dsl.spec_hash(a)) == 64
    assert dsl.spec_hash(a) != dsl.spec_hash(dsl.parse(doc(timeframes=["1d"])))
    c = doc()["entry_long"]
    n = {"op": "not", "arg": c}
    both = [dsl.spec_hash(dsl.parse(doc(entry_long={"op": "and", "args": x}))) for x in ([c, n], [n, c])]
    assert both[0] == both[1]
    assert dsl.render({"op": "and", "args": [c, n]}) == "(r < param.p AND NOT r < param.p)"


@pytest.mark.parametrize(
    "bad",
    [
        {"entry_long": None}, {"timeframes": ["1h", "1d"]}, {"timeframes": ["2h"]}, {"name": "Bad Name"}, {"entry_long": {"op": "and", "args": []}},
        {"entry_long": {"op": "compare", "operator": "<", "lhs": {"op": "indicator", "name": "zz"}, "rhs": {"op": "const", "value": 1}}},
        {"indicators": [{"name": "r", "type": "rsi", "params": {"perio": 3}}]}, {"entry_long": "{cut"}, {"entry_long": {"op": "xor", "args": []}},
        {"timeframes": ["5m"], "indicators": [{"name": "r", "type": "daily_return", "params": {}}]},
    ],
)
def test_rejected_documents(bad):
    with pytest.raises(dsl.SpecError):
        dsl.parse(doc(**bad))


def test_lints():
    kinds = lambda **kw: {f.kind for f in dsl.lint(dsl.parse(doc(**kw)))}
    assert kinds() == set()
    assert kinds(parameters=[{"name": "p", "type": "float", "default": -1.0}]) == {"unreachable"}
    assert kinds(indicators=[{"name": "r", "type": "rsi", "params": {"period": 14}}]) == {"warmup"}
    assert kinds(indicators=[{"name": "r", "type": "rsi", "params": {"period": 7}}]) == {"never_warm"}
    assert kinds(timeframes=["1d"], indicators=[{"name": "r", "type": "percent_rank", "params": {}}]) == {"unreachable", "short_buffer"} - {"unreachable"}


def test_comparisons_with_nan_and_null(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "i int, close double")
    c = lambda op: dsl.to_column({"op": "compare", "operator": op, "lhs": {"op": "price", "field": "close"}, "rhs": {"op": "const", "value": 2}}, {})
    got = {r.i: (r.a, r.b, r.c) for r in d.select("i", c(">").alias("a"), c("<").alias("b"), c("!=").alias("c")).collect()}
    assert got == {1: (False, False, True), 2: (False, False, False), 3: (False, True, True)}


# ---- backtests


class Replay(custom.Strategy):
    """Answers from given flags by time, as a signal strategy would."""

    timeframes = ("5m",)

    def __init__(self, flags):
        super().__init__()
        self.flags = flags

    def on_bar(self, bar, position, history):
        el, es, xl, xs = self.flags[bar.ts]
        if position is None:
            return [Entry("long")] if el else [Entry("short")] if es else []
        return [Exit()] if (xl if position.side == "long" else xs) else []


@pytest.mark.parametrize("seed,sessions", [(1, True), (2, True), (3, False), (4, False)])
def test_automaton_equals_the_fold(spark, seed, sessions):
    rng = random.Random(seed)
    rows, flags = [], {}
    for day in range(6):
        for k in range(78 if day % 2 else 40):
            ts = T0 + dt.timedelta(days=day, minutes=5 * k)
            p = 100 + rng.random() * 5
            flags[ts] = tuple(rng.random() < q for q in (0.2, 0.2, 0.15, 0.15))
            for s in ("A", "B"):
                rows.append((s, ts, p, p + 1, p - 1, p + 0.3, 1.0, *flags[ts]))
    d = spark.createDataFrame(rows, BARS + ", el boolean, es boolean, xl boolean, xs boolean")
    cfg = BacktestConfig(sessions=sessions, commission=0.25)
    cols = ["symbol", "side", "entry_ts", "entry_price", "exit_ts", "exit_price", "exit_reason", "pnl", "duration_mins"]
    got = sorted(map(tuple, backtest_signals(d, ["symbol"], cfg).select(cols).collect()))
    want = sorted(map(tuple, run_custom(d, ["symbol"], lambda: Replay(flags), cfg).select(cols).collect()))
    assert len(got) == len(want) > 20
    for a, b in zip(got, want):
        assert a == tuple(pytest.approx(x) if isinstance(x, float) else x for x in b)


def test_no_bars_no_trades(spark):
    d = spark.createDataFrame([], BARS + ", el boolean, es boolean, xl boolean, xs boolean")
    assert backtest_signals(d, ["symbol"]).count() == 0


def test_buy_and_hold_round_trip(spark):
    rows = [("S", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), p, p + 0.5, p - 0.5, p, 1000.0) for i, p in enumerate([100.0, 101.0, 102.0, 103.0, 104.0, 105.0])]
    t = run_custom(frame(spark, rows), ["symbol"], custom.BuyAndHold, BacktestConfig(sessions=False)).collect()
    assert [(r.entry_price, r.exit_price, r.exit_reason) for r in t] == [(101.01, 104.99, "eod")]
    t = run_custom(frame(spark, rows[:3]), ["symbol"], custom.BuyAndHold, BacktestConfig(sessions=False, commission=0.5, slippage=0.0)).first()
    assert t.pnl == pytest.approx(0.0)


def test_opening_range(spark):
    def bar(k, o, h, lo, c, day=0):
        return ("S", T0 + dt.timedelta(days=day, minutes=5 * k), float(o), float(h), float(lo), float(c), 1.0)

    rules, config = opening_range.OpeningRange(), BacktestConfig()
    rows = [bar(0, 100, 101, 99, 100), bar(1, 101, 102, 101, 101.5), bar(2, 102, 102, 101.2, 101.8), bar(3, 102, 102, 100.9, 101.4), bar(4, 101.4, 101.6, 101, 101.2), bar(5, 101, 107, 101, 106)]
    t = rules.trades(frame(spark, rows), config).collect()
    assert [(r.side, r.entry_price, r.exit_reason, r.signal_label) for r in t] == [("long", pytest.approx(101.41), "target", "long_retest")]
    assert t[0].exit_price == pytest.approx(101.4 + 2 * (101.4 - 99) - 0.01)
    free = rules.trades(frame(spark, rows), BacktestConfig(realistic_fills=False)).first()
    assert free.exit_price == pytest.approx(t[0].exit_price + 0.01)  # slippage on a target is all that differs
    fall = [*rows[:5], bar(5, 101, 101, 98, 98)]
    assert rules.trades(frame(spark, fall), config).first().exit_price == pytest.approx(98.99)
    # an order of a session that ends early fills with the next session's first bar, and ends with that session
    short = [*rows[:4], bar(0, 103, 103.5, 102, 103, day=1), bar(1, 103, 103.2, 102.5, 102.9, day=1), bar(0, 50, 51, 49, 50, day=2)]
    t = rules.trades(frame(spark, short), config).collect()
    assert [(r.entry_price, r.exit_price, r.exit_reason, r.exit_ts.day) for r in t] == [(pytest.approx(103.01), pytest.approx(102.89), "eod", T0.day + 1)]
    act = rules.activity(frame(spark, short), config).first()
    assert (act.n_bars, act.n_orders, act.n_trades, act.longest_window) == (7, 1, 1, 4)
    gaps = [r if i != 2 else (*r[:2], None, None, None, None, None) for i, r in enumerate(rows)]
    assert rules.trades(frame(spark, gaps), config).count() == 0  # a bar of nulls ends the row of closes beyond
    none = frame(spark, rows).limit(0)
    assert rules.trades(none, config).count() == rules.activity(none, config).count() == 0


def dip_brute(closes, p):
    """(entry, exit, level, reason) of dips by their places in a series whose highs and lows are 0.2 off the closes."""
    n, found, i = len(closes), [], 0
    rsi = lambda i: last_rsi([closes[j + 1] - closes[j] for j in range(i - p["rsi_len"], i)]) if i >= p["rsi_len"] else None
    span = lambda i: sum(max(0.4, abs(closes[j] + 0.2 - closes[j - 1]), abs(closes[j] - 0.2 - closes[j - 1])) for j in range(i - p["atr_len"] + 1, i + 1)) / p["atr_len"] if i >= p["atr_len"] else None
    while i < n - 1:
        r, a = rsi(i), span(i)
        if r is None or a is None or r >= p["oversold"] or closes[i] - p["atr_mult"] * a <= 0:
            i += 1
            continue
        stop, peak = closes[i] - p["atr_mult"] * a, closes[i] + 0.2
        for j in range(i + 1, n):
            if closes[j] - 0.2 <= stop:
                found.append((i + 1, j, stop, "stop"))
                i = j
                break
            peak = max(peak, closes[j] + 0.2)
            if p["trailing"]:
                stop = max(stop, peak - p["atr_mult"] * span(j))
            if j - i >= p["max_bars"] or (rsi(j) > p["rsi_exit"] and (rsi(j - 1) is None or rsi(j - 1) <= p["rsi_exit"])):
                found.append((i + 1, j, closes[j], "signal"))
                i = j + 1
                break
        else:
            found.append((i + 1, n - 1, closes[-1], "eod"))
            i = n
    return found


def last_rsi(steps):
    loss = sum(max(-x, 0.0) for x in steps) / len(steps)
    return 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + sum(max(x, 0.0) for x in steps) / len(steps) / loss)


@pytest.mark.parametrize("trailing", [False, True])
def test_dips_against_a_loop(spark, trailing):
    rng = np.random.default_rng(11)
    closes = [float(x) for x in np.round(50 + np.cumsum(rng.normal(0, 0.6, 300)), 2)]
    rows = [("S", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), c, c + 0.2, c - 0.2, c, 1.0) for i, c in enumerate(closes)]
    rules = dips.DipBuyer(rsi_len=3, oversold=35.0, rsi_exit=80.0, use_trend=False, atr_len=4, atr_mult=0.9, max_bars=6, trailing=trailing)
    want = dip_brute(closes, rules.p)
    for size in (25, 50_000):  # chunks change nothing
        t = rules.trades(frame(spark, rows), BacktestConfig(sessions=False, slippage=0.0), rows=size).orderBy("entry_ts").collect()
        assert [((r.entry_ts - rows[0][1]).days, (r.exit_ts - rows[0][1]).days, r.exit_reason) for r in t] == [(a, b, why) for a, b, _, why in want]
        assert [r.exit_price for r in t] == pytest.approx([x for _, _, x, _ in want])
    assert len(want) > 15 and {"stop", "signal"} <= {w[3] for w in want}


def test_dips_above_an_exponential_average(spark):
    rows = daily([100 + i for i in range(30)] + [128.5, 128.2, 131, 132], start=dt.datetime(2024, 1, 1))
    for kind in ("sma", "ema"):
        t = dips.DipBuyer(trend_len=10, trend_type=kind, atr_len=3, max_bars=2).trades(frame(spark, rows), BacktestConfig(sessions=False))
        assert t.count() == 1
    assert dips.DipBuyer(trend_len=10).trades(frame(spark, rows).limit(0), BacktestConfig(sessions=False)).count() == 0


def test_parameters():
    for bad in ({"rsi_len": 0}, {"rsi_len": 2.5}, {"nope": 1}, {"trailing": 1}):
        with pytest.raises(ValueError):
            dips.DipBuyer(**bad)
    with pytest.raises(ValueError):
        opening_range.OpeningRange(stop_mode="x")
    with pytest.raises(TypeError):
        type("Nameless", (custom.Strategy,), {})()


# ---- metrics, prefix


def trades(spark, pnls, symbol="S"):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(symbol, "long", 1, t0 + dt.timedelta(days=i), 10.0, t0 + dt.timedelta(days=i, minutes=30), 10.0 + p, "signal", float(p), p / 10, 30) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, side string, size int, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, exit_reason string, pnl double, pnl_pct double, duration_mins int")


@pytest.mark.parametrize("pnls,pf", [([1, 1, -1], 2.0), ([1, 2, 3], 100.0), ([-1, -2], 0.0)])
def test_profit_factor(spark, pnls, pf):
    assert trades(spark, pnls).groupBy("symbol").agg(metrics.profit_factor().alias("pf")).first().pf == pf


def test_metrics_and_zero_trades(spark):
    bars = frame(spark, daily([10, 11, 12, 11, 13]) + daily([5, 5], "T"))
    m = {r.symbol: r for r in metrics.metrics(bars, trades(spark, [1, -1, 2]), ["symbol"]).collect()}
    assert (m["S"].total_trades, m["S"].gross_win, m["S"].gross_loss, m["S"].profit_factor) == (3, 3.0, -1.0, 3.0)
    assert (m["T"].total_trades, m["T"].profit_factor, m["T"].ending_capital, m["T"].sharpe_ratio) == (0, 0.0, 10_000.0, 0.0)
    assert metrics.trade_metrics(trades(spark, [1, 2]), ["symbol"]).first().profit_factor == math.inf


def test_running_and_previous_over_parts(spark):
    rng = random.Random(1)
    rows = [(k, d, i, rng.random()) for k in ("a", None) for d in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, d int, i int, v double")
    got = {(r.k, r.d, r.i): r for r in running(running(df, ["k"], "d", ["i"], F.col("v"), "s"), ["k"], "d", ["i"], F.col("v"), "m", "max").collect()}
    prev = {(r.k, r.d, r.i): r.p for r in previous(df, ["k"], "d", ["i"], {"v": "p"}).collect()}
    for k in ("a", None):
        mine = sorted(r for r in rows if r[0] == k)
        for j, r in enumerate(mine):
            vs = [x[3] for x in mine[: j + 1]]
            assert got[r[:3]].s == pytest.approx(sum(vs)) and got[r[:3]].m == max(vs)
            assert prev[r[:3]] == (mine[j - 1][3] if j else None)


def test_halo_has_enough_rows(spark):
    df = spark.createDataFrame([("a", i // 7, i) for i in range(100)], "k string, d int, i int")
    rows = with_halo(df, ["k"], "d", 20, 11).collect()
    by = {}
    for r in rows:
        by.setdefault(r.chunk, []).append((r.i, r.is_halo))
    assert sorted(i for r in by.values() for i, h in r if not h) == list(range(100))
    for chunk in by.values():
        own = min(i for i, h in chunk if not h)
        assert {i for i, _ in chunk} >= set(range(max(0, own - 11), own))


# ---- resampling


def test_ramp(spark):
    t = dt.datetime(2024, 5, 15, 9)
    rows = [("S", t + dt.timedelta(minutes=5 * i), 100 + 0.1 * i, 100.5 + 0.1 * i, 99.5 + 0.1 * i, 100.2 + 0.1 * i, 1000.0) for i in range(12)]
    a = resample.resample(frame(spark, rows[:6]), "15m").orderBy("ts").collect()
    assert len(a) == 2 and (a[0].open, round(a[0].high, 6), round(a[0].close, 6)) == (100.0, 100.7, 100.4)
    assert resample.resample(frame(spark, rows), "1h").first().volume == 12000.0
    two = resample.resample(resample.resample(frame(spark, rows), "15m"), "1h").first()
    assert two == resample.resample(frame(spark, rows), "1h").first()


def test_nulls_and_ties_in_ticks(spark):
    t = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("S", t, 1, 100.0, 5.0), ("S", t, 2, 101.0, None), ("S", t, 3, None, 5.0), ("S", t + dt.timedelta(minutes=9), 4, None, 1.0)], "symbol string, ts timestamp_ntz, seq int, price double, volume double")
    r = resample.ticks_to_bars(ticks, "5m", ["seq"]).collect()
    assert [(x.open, x.high, x.low, x.close, x.volume) for x in r] == [(100.0, 101.0, 100.0, 101.0, 10.0)]


# ---- walk-forward, significance, scores


def test_window_dates(spark):
    bars = frame(spark, [("S", dt.datetime(2021, 4, 28), 1.0, 1.0, 1.0, 1.0, 1.0), ("S", dt.datetime(2024, 12, 31), 1.0, 1.0, 1.0, 1.0, 1.0), ("T", dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)])
    w = walkforward.windows(bars).orderBy("window_id").collect()
    assert len(w) == 3 and {r.symbol for r in w} == {"S"}
    assert tuple(w[0])[2:] == (dt.date(2021, 5, 1), dt.date(2023, 5, 1), dt.date(2023, 11, 1))


def test_walk_forward_trades_are_inside(spark):
    rng = random.Random(2)
    closes, c = [], 100.0
    for i in range(1300):
        c *= 1 + rng.gauss(0.0004, 0.02)
        closes.append(c)
    spec = dsl.parse(doc(timeframes=["1d"], parameters=[{"name": "p", "type": "float", "default": 40.0}], exit_long={"op": "compare", "operator": ">", "lhs": {"op": "indicator", "name": "r"}, "rhs": {"op": "const", "value": 60}}))
    cfg = walkforward.WalkForwardConfig(min_trades=5)
    report, oos = walkforward.walk_forward(frame(spark, daily(closes, start=dt.datetime(2020, 1, 1))), spec, {"p": [20.0, 30.0, 40.0]}, cfg, BacktestConfig(sessions=False, part_days=100))
    rows = {r.window_id: r for r in report.collect()}
    assert len(rows) == 3 and all(r.train_n_trades >= 5 and r.p_p in (20.0, 30.0, 40.0) for r in rows.values())
    for t in oos.collect():
        assert rows[t.window_id].test_start <= t.entry_ts.date() < rows[t.window_id].test_end
    none, _ = walkforward.walk_forward(frame(spark, daily(closes, start=dt.datetime(2020, 1, 1))), spec, {"p": [20.0]}, walkforward.WalkForwardConfig(min_trades=10_000), BacktestConfig(sessions=False, part_days=100))
    assert {(r.grid_id, r.p_p, r.train_pf) for r in none.collect()} == {(None, 40.0, 0.0)}


def test_bootstrap(spark):
    r = significance.bootstrap(trades(spark, [1] * 100 + [-1] * 50), ["symbol"], 400, seed=3).first()
    assert r.pf == 2.0 and 1.0 < r.ci_lower < 2.0 < r.ci_upper and not r.under_sampled
    lo, hi, capped = significance.bootstrap_numpy(np.array([1.0] * 100 + [-1.0] * 50), 2000, 42)
    assert 1.0 < lo < r.pf < hi and capped == 0 and abs(lo - r.ci_lower) < 0.15
    assert significance.bootstrap_numpy(np.array([])) == (0.0, 0.0, 0.0)


def test_baseline(spark):
    rows = [("S", T0 + dt.timedelta(minutes=5 * i), *((100.0, 101.0, 99.0, 100.0) if i == 0 else (p := 100 + (i - 39) * 0.05, p + 0.3, p - 0.3, p + 0.1)), 1.0) for i in range(78)]
    rows += [(s, t + dt.timedelta(days=1), *v) for s, t, *v in rows] + [("N", *rows[0][1:])]
    t = trades(spark, [1.0]).withColumn("entry_ts", F.lit(T0 + dt.timedelta(minutes=30)).cast("timestamp_ntz"))
    got = {r.symbol: r for r in significance.random_baseline(frame(spark, rows), t, trials=40).collect()}
    assert 0.0 <= got["S"].p_value <= 1.0 and got["S"].n_trials == 40 and (got["N"].p_value, got["N"].pf) == (1.0, 0.0)
    again = {r.symbol: r for r in significance.random_baseline(frame(spark, rows).repartition(3), t, trials=40).collect()}
    assert again == got


def test_outcomes_match_a_walk():
    rng = np.random.default_rng(4)
    c = 100 + rng.normal(0, 1, 20).cumsum() * 0.3
    h, lo = c + rng.random(20), c - rng.random(20)
    for realistic in (True, False):
        out = significance._outcomes(h, lo, c, {1: 99.0, -1: 101.0}, 2.0, 0.01, realistic)
        for row, sign in enumerate((1, -1)):
            for i in range(20):
                stop, entry = (99.0, c[i] + 0.01) if sign == 1 else (101.0, c[i] - 0.01)
                risk = (entry - stop) * sign
                if risk <= 0:
                    assert math.isnan(out[row, i])
                    continue
                target, price, slip = entry + sign * 2 * risk, None, 0.01
                for k in range(i + 1, 20):
                    if (lo[k] <= stop) if sign == 1 else (h[k] >= stop):
                        price = stop
                    elif (h[k] >= target) if sign == 1 else (lo[k] <= target):
                        price = target
                    if price is not None:
                        slip = 0.01 if realistic else 0.0
                        break
                price = (c[-1] if i < 19 else c[i]) if price is None else price
                assert out[row, i] == pytest.approx((price - sign * slip - entry) * sign)


def test_scores(spark):
    per = spark.createDataFrame([("x", 40, 2.0, 1.4, 0.01), ("x", 20, 3.0, 1.6, 0.03), ("y", 0, 0.0, 0.0, 1.0)], "strategy string, n_trades int, pf double, ci_lower double, p_value double")
    s = {r.strategy: r for r in scoring.fast_floor(scoring.failed_gates(scoring.robustness(scoring.aggregate_symbols(per, ["strategy"]), 1)), 100).collect()}
    assert s["x"].score == pytest.approx(2.5 / 1.5 * 0.95) and s["x"].promising and s["x"].failed == [] and s["x"].reported_score == 0.0
    one_idle = per.unionByName(spark.createDataFrame([("x", 0, 0.0, 0.0, 1.0)], per.schema))
    assert {r.strategy: r for r in scoring.robustness(scoring.aggregate_symbols(one_idle, ["strategy"]), 1).collect()}["x"].score == pytest.approx(2.5 / 1.5 * 0.95)  # a symbol without trades counts in nothing
    assert [f.name for f in s["y"].failed] == ["score", "median_pf", "ci_lower", "n_trades"] and s["y"].p_value == 1.0


def test_registered_significance_has_all_draws(monkeypatch, spark, data):
    from tidemark.plans import analytics_queries, pipeline

    seen = {}
    real = significance.random_baseline
    monkeypatch.setattr(analytics_queries.significance, "random_baseline", lambda bars, trades, **kw: seen.update(kw) or real(bars.limit(0), trades.limit(0), **kw))
    analytics_queries.q_baseline(spark, data)
    configs = []
    blank = lambda: spark.range(0).selectExpr(*[f"0.0D as {c}" for c in ("median_pf", "std_pf", "ci_lower", "p_value", "score", "reported_score")], "array(named_struct('name', 'x')) as failed")
    monkeypatch.setattr(pipeline, "evaluate", lambda bars, spec, grid, config: configs.append(config) or (blank(), None, None))
    monkeypatch.setattr(pipeline, "evaluate_holdout", lambda bars, at, spec, config: configs.append(config) or (blank(), None, None))
    monkeypatch.setattr(pipeline, "conclude", lambda bars, trades, spec, n, config: configs.append(config) or (blank(), None))
    for q in ("q_evaluation", "q_holdout_evaluation", "q_score"):
        analytics_queries.QUERIES[q](spark, data)
    assert seen.get("trials", 200) == 200 and {(c.n_bootstrap, c.m_baseline) for c in configs} == {(5000, 200)} and len(configs) == 3


def test_bootstrap_of_a_large_group_in_blocks(spark):
    rng = np.random.default_rng(5)
    pnl = [float(x) for x in rng.normal(0.1, 1.0, 3000)]
    t = trades(spark, pnl).unionByName(trades(spark, [1.0, -2.0, 3.0], "small"))
    whole = {r.symbol: r for r in significance.bootstrap(t, ["symbol"], 400, seed=3).collect()}
    cut = {r.symbol: r for r in significance.bootstrap(t, ["symbol"], 400, seed=3, block_trades=200).collect()}
    assert whole["small"] == cut["small"] and whole["S"].pf == pytest.approx(cut["S"].pf) and cut["S"].n_trades == 3000
    width = whole["S"].ci_upper - whole["S"].ci_lower
    assert abs(whole["S"].ci_lower - cut["S"].ci_lower) < width / 4 and abs(whole["S"].ci_upper - cut["S"].ci_upper) < width / 4
    sizes = [7, 0, 100, 33, 60]
    drawn = [significance.draws_of_block(sizes, b, 500, [1, 2]) for b in range(5)]
    assert (sum(drawn) == 200).all() and (drawn[1] == 0).all() and abs(drawn[2].mean() - 100) < 2
    assert significance.bootstrap(t.limit(0), ["symbol"]).count() == 0


def test_hash_fills_defaults_and_refuses_unknown_members():
    base = doc(position_sizing={"rule": "fixed", "size": 1})
    same = [base | {"position_sizing": {"rule": "fixed", "size": 1}}, base | {"position_sizing": None}, base | {"name": "else"}]
    same.append(base | {"parameters": [p | {"range_min": None, "description": "text"} for p in base.get("parameters", [])]})
    same.append(base | {"indicators": [({"params": None} | i) for i in base.get("indicators", [])]})
    assert {dsl.spec_hash(dsl.parse(d)) for d in same} == {dsl.spec_hash(dsl.parse(base))}
    assert dsl.spec_hash(dsl.parse(base | {"position_sizing": {"rule": "fixed", "size": 2}})) != dsl.spec_hash(dsl.parse(base))
    with pytest.raises(dsl.SpecError, match="unknown members"):
        dsl.spec_hash(dsl.parse(base | {"mood": "good"}))


def test_gate_rejects_what_can_never_trade():
    long = doc(timeframes=["1h"], indicators=[{"name": "slow", "type": "sma", "params": {"period": 8}}])
    for slot in dsl.SLOTS:
        long[slot] = None
    long["entry_long"] = {"op": "compare", "operator": ">", "lhs": {"op": "price", "field": "close"}, "rhs": {"op": "indicator", "name": "slow"}}
    with pytest.raises(dsl.SpecError, match="exceeds the 7 bars"):
        dsl.gate(dsl.parse(long))
    fits = long | {"indicators": [{"name": "slow", "type": "sma", "params": {"period": 7}}]}
    dsl.gate(dsl.parse(fits))
    dsl.gate(dsl.parse(long | {"timeframes": ["1d"]}))
    with pytest.raises(dsl.SpecError, match="is not for 1h"):
        dsl.gate(dsl.parse(fits), {fits["archetype"]: (set(fits["supported_assets"]), {"1d"})})


@pytest.mark.parametrize(("master", "given", "chosen"), [("local[4]", None, "tidemark"), ("local", None, "tidemark"), ("spark://h:7077", "hdfs:///x", "hdfs:///x"), ("spark://h:7077", None, None), ("local-cluster[3,2,1024]", None, None), ("yarn", None, None)])
def test_no_checkpoint_folder_of_our_own_choice_on_a_cluster(master, given, chosen):
    from types import SimpleNamespace

    from tidemark.session import ensure_checkpoint_dir

    seen = []
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=seen.append)
    bare = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, default=None: given or default))
    if chosen is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(bare)
    else:
        ensure_checkpoint_dir(bare)
        assert chosen in seen[0]


def test_hashes_of_logs_and_backfill(spark):
    from tidemark.operators import leaderboard as lb

    good, bad = json.dumps(doc()), json.dumps(doc() | {"mood": "x"})
    at = dt.datetime(2024, 1, 1)
    rows = [("a/1", at, "P", good), ("a/2", at, "p ", good), ("a/3", at + dt.timedelta(1), "q", good), ("a/4", at, "p", bad), ("a/5", at, "p", None), ("a/6", at, "p", good[:40])]
    logs = spark.createDataFrame(rows, "path string, timestamp timestamp, prompt_hash string, raw_tool_input string")
    known = spark.createDataFrame([(dsl.spec_hash(dsl.parse(doc())).upper(), "2024-01-02T00:00:00.000000Z", "q")], "strategy_hash string, moment string, prompt_hash string")
    added, skipped = lb.backfill_generations(logs, known)
    assert [r.path for r in added.collect()] == ["a/1"]
    why = {r.path: r.reason for r in skipped.collect()}
    assert why["a/2"] == why["a/3"] == "duplicate" and why["a/5"] == "no document" and "unknown members" in why["a/4"] and "no JSON" in why["a/6"]
    name = doc()["name"]
    reports = spark.createDataFrame([("r1", "".join(w.capitalize() for w in name.split("_")), "fast", "m1"), ("r2", name, "fast", "m0"), ("r3", "Nobody", "fast", "m"), ("r4", None, "fast", "m")], "results_dir string, strategy string, eval_type string, moment string")
    had = spark.createDataFrame([(dsl.spec_hash(dsl.parse(doc())), "fast", "m0")], "strategy_hash string, eval_type string, moment string")
    added, skipped = lb.backfill_evaluations(reports, logs, had)
    assert [r.results_dir for r in added.collect()] == ["r1"]
    assert {r.results_dir: r.reason for r in skipped.collect()} == {"r2": "duplicate", "r3": "no hash", "r4": "no strategy"}


def test_prefixes_resolve_or_are_ambiguous(spark):
    from tidemark.operators import leaderboard as lb

    s = spark.createDataFrame([(1, "abcdef1"), (2, "ABCDEF1 "), (3, "abcdef2"), (4, None), (5, "fedcba9")], "strategy_id long, strategy_hash string")
    assert lb.resolve(s, "fedcba") == "fedcba9" and lb.resolve(s, "000000") is None and lb.resolve(s, "abcdef1") == "abcdef1"
    with pytest.raises(lb.Ambiguous):
        lb.resolve(s, "abcdef")
    with pytest.raises(ValueError):
        lb.resolve(s, "abc")


def test_histories_are_not_empty_on_the_given_tables(spark, data):
    from tidemark.plans import leaderboard_queries

    rows = leaderboard_queries.QUERIES["lb_histories"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/generations.parquet").where("strategy_hash is not null").count() > 0


def test_newest_log_by_any_alias_of_the_name(spark, tmp_path):
    from tidemark.plans import leaderboard_queries

    configs = [(1, '{"strategy": "a"}'), (2, '{"strategy_name": "a"}'), (3, '{"strategy_name": "none"}'), (4, "{cut")]
    spark.createDataFrame(configs, "id long, config_json string").write.parquet(f"{tmp_path}/evaluations.parquet")
    logs = [(7, '{"name": "a"}', dt.datetime(2024, 1, 1)), (8, '{"name": "a"}', dt.datetime(2024, 1, 2))]
    spark.createDataFrame(logs, "log_id long, raw_tool_input string, timestamp timestamp").write.parquet(f"{tmp_path}/generation_logs.parquet")
    got = {r.id: r.log_id for r in leaderboard_queries.QUERIES["lb_newest_log_aliases"](spark, str(tmp_path)).collect()}
    assert got == {1: 8, 2: 8, 3: -1, 4: -1}
