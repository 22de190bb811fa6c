"""Registered queries of the time-series engine, over whole tables, with SQL where it can express them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.functions.indicators import Indicator, add_indicators, bar_window, over_long_series
from tidemark.operators import custom, dips, metrics, opening_range, quality, scoring, significance, walkforward
from tidemark.operators.backtest import BacktestConfig, backtest_signals, run_custom
from tidemark.operators.resample import resample, ticks_to_bars
from tidemark.plans import pipeline
from tidemark.plans.inputs import DAILY_SQL, SESSION_SQL, daily_bars, event_ticks, session_bars
from tidemark.session import cut, table
from tidemark.sources import bars as src
from tidemark.streaming import live

PRICES = ["open", "high", "low", "close", "volume"]
ref = lambda name: {"op": "indicator", "name": name}
compare = lambda a, op, b: {"op": "compare", "operator": op, "lhs": a, "rhs": b}
const = lambda v: {"op": "const", "value": v}
param = lambda n: {"op": "param", "name": n}
CLOSE = {"op": "price", "field": "close"}

#: The daily strategy of the queries: dips above the average, left when the oscillator has recovered.
DIPS = dsl.parse(
    {
        "name": "dips", "archetype": "mean_reversion", "thesis": "dips above the average", "supported_assets": ["stocks"], "timeframes": ["1d"],
        "parameters": [{"name": "low", "type": "float", "default": 40.0}, {"name": "high", "type": "float", "default": 60.0}],
        "indicators": [{"name": "osc", "type": "rsi", "params": {"period": 14}}, {"name": "avg20", "type": "sma", "params": {"period": 20}}],
        "entry_long": {"op": "and", "args": [compare(ref("osc"), "<", param("low")), compare(CLOSE, ">", ref("avg20"))]},
        "entry_short": None, "exit_long": json.dumps(compare(ref("osc"), ">", param("high"))), "exit_short": None,
        "position_sizing": {"rule": "fixed", "size": 1},
    }
)
#: An intraday strategy with both sides.
BANDS = dsl.parse(
    {
        "name": "bands", "archetype": "mean_reversion", "thesis": "outside the bands", "supported_assets": ["stocks"], "timeframes": ["5m"],
        "parameters": [],
        "indicators": [{"name": "lo", "type": "bb_lower", "params": {"period": 10, "k": 1.5}}, {"name": "hi", "type": "bb_upper", "params": {"period": 10, "k": 1.5}}, {"name": "mid", "type": "bb_mid", "params": {"period": 10}}],
        "entry_long": compare(CLOSE, "<", ref("lo")), "entry_short": compare(CLOSE, ">", ref("hi")),
        "exit_long": compare(CLOSE, ">=", ref("mid")), "exit_short": {"op": "not", "arg": compare(CLOSE, ">", ref("mid"))},
        "position_sizing": {"rule": "fixed", "size": 1},
    }
)
DAILY = BacktestConfig(sessions=False, part_days=256)
INTRADAY = BacktestConfig(sessions=True)
WINDOWS = walkforward.WalkForwardConfig(min_trades=5)
WINDOWED = [
    Indicator("sma_10", "sma", {"period": 10}), Indicator("rsi_7", "rsi", {"period": 7}), Indicator("atr_7", "atr", {"period": 7}),
    Indicator("bb_up", "bb_upper", {"period": 10, "k": 2.0}), Indicator("bb_lo", "bb_lower", {"period": 10, "k": 2.0}), Indicator("roc_5", "roc", {"period": 5}),
    Indicator("ret", "daily_return"), Indicator("rank_20", "percent_rank", {"period": 20}), Indicator("z_20", "zscore", {"period": 20}),
]
BUFFERED = [
    Indicator("ema_10", "ema", {"period": 10}), Indicator("wilder_7", "rsi", {"period": 7, "smoothing": "wilder"}),
    Indicator("macd_v", "macd", {"fast": 5, "slow": 12, "signal": 4}), Indicator("macd_s", "macd_signal", {"fast": 5, "slow": 12, "signal": 4}),
    Indicator("macd_h", "macd_hist", {"fast": 5, "slow": 12, "signal": 4}),
]


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def _digits(c: str) -> Column:
    """A value to eight significant digits, as profit factors may be of any size."""
    return F.format_string("%.7e", c).cast("double")


def _dates_as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def with_flags(d: DataFrame, spec: dsl.Spec) -> DataFrame:
    return d.select("*", *[c.alias(n) for n, c in dsl.signals(spec).items()])


def dips_ready(spark: SparkSession, d: str) -> DataFrame:
    return with_flags(over_long_series(cut(daily_bars(spark, d)), DIPS.indicators), DIPS)


def dips_trades(spark: SparkSession, d: str) -> DataFrame:
    return backtest_signals(dips_ready(spark, d), ["symbol"], DAILY)


def bands_trades(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("session", F.to_date("ts"))
    return backtest_signals(with_flags(add_indicators(b, ["symbol", "session"], BANDS.indicators), BANDS), ["symbol"], INTRADAY)


TRADE_COLS = ["symbol", "side", "size", "entry_ts", "entry_price", "exit_ts", "exit_price", "exit_reason", "pnl", "pnl_pct", "duration_mins"]


def q_daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily_bars(spark, d), *PRICES)


def q_session_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(session_bars(spark, d), *PRICES)


def q_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ticks_to_bars(event_ticks(spark, d), "1h", ["event_id"]), *PRICES)


def q_four_hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(resample(session_bars(spark, d), "4h"), *PRICES)


def q_indicators(spark: SparkSession, d: str) -> DataFrame:
    x = over_long_series(cut(daily_bars(spark, d)), WINDOWED)
    return _rounded(x.select("symbol", "ts", "warm", *[i.name for i in WINDOWED]), *[i.name for i in WINDOWED], places=5)


def q_buffer_indicators(spark: SparkSession, d: str) -> DataFrame:
    x = over_long_series(cut(daily_bars(spark, d)), BUFFERED, buffer=30)
    return _rounded(x.select("symbol", "ts", *[i.name for i in BUFFERED]), *[i.name for i in BUFFERED], places=5)


def q_crypto_indicators(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bars_5m").where("asset_class != 'stocks' and close is not null and not isnan(close)")
    b = resample(b.select(F.col("feed").alias("symbol"), src.local("time", "UTC").alias("ts"), "open", "high", "low", "close", "volume"), "15m", order=["close", "open", "high", "low", "volume"])
    x = over_long_series(b, [Indicator("sma_10", "sma", {"period": 10}), Indicator("roc_5", "roc", {"period": 5})], rows=400)
    return _rounded(x.select("symbol", "ts", "close", "sma_10", "roc_5"), "close", "sma_10", "roc_5")


def q_session_places(spark: SparkSession, d: str) -> DataFrame:
    b = session_bars(spark, d).withColumn("session", F.to_date("ts"))
    x = bar_window(b, ["symbol", "session"], 6).select("symbol", "ts", "highest_high", "lowest_low", F.col("bars_since_open").cast("long").alias("bars_since_open"), "is_session_start")
    return _rounded(x, "highest_high", "lowest_low")


def q_signal_frequency(spark: SparkSession, d: str) -> DataFrame:
    x = over_long_series(cut(daily_bars(spark, d)), DIPS.indicators)
    return dsl.signal_frequency(x, DIPS, "entry_long").withColumn("warm_ratio", F.round("warm_ratio", 6))


def q_trades(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(dips_trades(spark, d).select(TRADE_COLS), "entry_price", "exit_price", "pnl", "pnl_pct")


def q_session_trades(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bands_trades(session_bars(spark, d)).select(TRADE_COLS), "entry_price", "exit_price", "pnl", "pnl_pct")


def q_trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.trade_metrics(dips_trades(spark, d), ["symbol"])
    return _rounded(m, *[c for c in m.columns if c not in ("symbol", "total_trades")], places=5)


def q_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.pooled(metrics.trade_metrics(dips_trades(spark, d), ["symbol"])), "total_pnl", "profit_factor", places=5)


def q_equity(spark: SparkSession, d: str) -> DataFrame:
    e = metrics.equity_curve(daily_bars(spark, d), cut(dips_trades(spark, d)), ["symbol"])
    return _rounded(e.select("symbol", "ts", "equity"), "equity", places=5)


def q_drawdown_sharpe(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.metrics(cut(daily_bars(spark, d)), cut(dips_trades(spark, d)), ["symbol"])
    cols = ["max_drawdown_dollar", "max_drawdown_pct", "sharpe_ratio", "ending_capital"]
    return _rounded(m.select("symbol", "total_trades", *cols), *cols, places=5)


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    w = walkforward.windows(daily_bars(spark, d))
    return _dates_as_text(w, "train_start", "test_start", "test_end")


def q_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    grid = {"low": [35.0, 45.0], "high": [55.0, 65.0]}
    report, _ = walkforward.walk_forward(cut(daily_bars(spark, d)), DIPS, grid, WINDOWS, DAILY)
    report = report.withColumns({"grid_id": F.coalesce("grid_id", F.lit(-1)), **{c: _digits(c) for c in ("train_pf", "test_pf")}})
    return _dates_as_text(report, "train_start", "test_start", "test_end")


def q_oos_trades(spark: SparkSession, d: str) -> DataFrame:
    _, oos = walkforward.walk_forward(cut(daily_bars(spark, d)), DIPS, None, WINDOWS, DAILY)
    return _rounded(oos.select("window_id", *TRADE_COLS), "entry_price", "exit_price", "pnl", "pnl_pct")


def q_holdout(spark: SparkSession, d: str) -> DataFrame:
    t = walkforward.holdout_run(daily_bars(spark, d), dt.datetime(2001, 1, 1), DIPS, DAILY)
    return _rounded(t.select(TRADE_COLS), "entry_price", "exit_price", "pnl", "pnl_pct")


def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = significance.bootstrap(cut(dips_trades(spark, d)), ["symbol"], n_resamples=5000, seed=7)
    return _rounded(b, "pf", "ci_lower", "ci_upper", "fraction_capped")


def q_baseline(spark: SparkSession, d: str) -> DataFrame:
    bars = cut(session_bars(spark, d))
    return significance.random_baseline(bars, cut(bands_trades(bars)))


def _summary(df: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("failed", lambda x: x["name"]), ",")
    cols = ["median_pf", "std_pf", "ci_lower", "p_value", "score", "reported_score"]
    return df.withColumn("failed_names", names).drop("failed").withColumns({c: _digits(c) for c in cols})


def q_score(spark: SparkSession, d: str) -> DataFrame:
    """Score and thresholds of all trades of the daily strategy, with bootstrap intervals and the random baseline's p-values."""
    bars, trades = cut(daily_bars(spark, d)), cut(dips_trades(spark, d))
    summary, _ = pipeline.conclude(bars, trades, DIPS, 2, pipeline.EvaluationConfig(WINDOWS, DAILY, seed=7, trade_floor=50))
    return _summary(summary)


def q_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The whole walk-forward evaluation."""
    config = pipeline.EvaluationConfig(WINDOWS, DAILY)
    s, _, _ = pipeline.evaluate(daily_bars(spark, d), DIPS, {"low": [35.0, 45.0], "high": [55.0, 65.0]}, config)
    return _summary(s)


def q_holdout_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation on the holdout."""
    s, _, _ = pipeline.evaluate_holdout(daily_bars(spark, d), dt.datetime(2001, 1, 1), DIPS, pipeline.EvaluationConfig(WINDOWS, DAILY))
    return _summary(s)


def q_opening_range(spark: SparkSession, d: str) -> DataFrame:
    return _custom_trades(opening_range.OpeningRange().trades(session_bars(spark, d), INTRADAY))


def q_opening_momentum(spark: SparkSession, d: str) -> DataFrame:
    """The opening range with the other ways to enter and to stop."""
    rules = opening_range.OpeningRange(momentum=True, stop_mode="midpoint", confirm_bars=1, cutoff="15:00", retest_timeout=6)
    return _custom_trades(rules.trades(session_bars(spark, d), INTRADAY))


def _custom_trades(t: DataFrame) -> DataFrame:
    return _rounded(t.select(*TRADE_COLS, "signal_label"), "entry_price", "exit_price", "pnl", "pnl_pct", places=5)


def q_dip_buyer(spark: SparkSession, d: str) -> DataFrame:
    return _custom_trades(dips.DipBuyer(trend_len=50, atr_mult=0.5).trades(daily_bars(spark, d), DAILY))


def q_trailing_dip_buyer(spark: SparkSession, d: str) -> DataFrame:
    return _custom_trades(dips.trailing_dip_buyer(trend_len=50, oversold=45.0, atr_mult=0.5).trades(daily_bars(spark, d), DAILY))


def q_buy_and_hold(spark: SparkSession, d: str) -> DataFrame:
    t = run_custom(daily_bars(spark, d), ["symbol"], custom.BuyAndHold, DAILY)
    return _rounded(t.select(TRADE_COLS), "entry_price", "exit_price", "pnl", "pnl_pct")


def q_engine_activity(spark: SparkSession, d: str) -> DataFrame:
    return opening_range.OpeningRange().activity(session_bars(spark, d), INTRADAY)


def q_session_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _dates_as_text(quality.session_gaps(session_bars(spark, d)), "day")


def q_violations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bars_5m")
    return quality.violations(b.select(F.col("feed").alias("symbol"), F.col("time").alias("ts"), *PRICES))


def q_coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = src.gaps(src.coverage(daily_bars(spark, d)), dt.date(1994, 6, 1), dt.date(2002, 1, 31))
    return _dates_as_text(g, "gap_start", "gap_end")


def q_merge(spark: SparkSession, d: str) -> DataFrame:
    b = daily_bars(spark, d)
    old = b.where("dayofmonth(ts) <= 20")
    fresh = b.where("dayofmonth(ts) >= 15").withColumn("close", F.col("close") + 1)
    return _rounded(src.merge_bars(old, fresh), *PRICES)


def q_splits(spark: SparkSession, d: str) -> DataFrame:
    b, at = daily_bars(spark, d), dt.datetime(2001, 1, 1)
    n = lambda x, name: x.groupBy("symbol").agg(F.count("*").alias("n_bars")).withColumn("split", F.lit(name))
    return n(src.train_test(b, at), "train").unionByName(n(src.holdout(b, at, final_scoring=True), "holdout"))


def q_stream_bars(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    ticks = ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")
    out = live.drain_open(live.stream_bars(ticks, "1h", "1 hour", ("event_id",)), ["symbol", "ts"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))  # as it was read: wall time


def q_stream_ema(spark: SparkSession, d: str) -> DataFrame:
    """A running average over the closes of a stream, its state kept from batch to batch."""
    schema = table(spark, d, "events").schema
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    bars = ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))
    out = live.drain(live.stream_ema(bars, 20))
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.count("ema").alias("n_averages"), F.round(F.max_by("ema", F.struct("ts", "ema")), 4).alias("last_ema"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

# ---- SQL ---------------------------------------------------------------------------------

_R = lambda *cols, n=6: ", ".join(f"round({c}, {n}) AS {c}" for c in cols)
_OHLCV = _R(*PRICES)
_EVENTS = """
ticks AS (SELECT event_type AS symbol, ts, value AS price, (ts, event_id) AS o FROM events),
bars AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, o) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""
_W = "(PARTITION BY symbol ORDER BY ts)"
_ROWS = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_RSI = lambda n: (
    f"CASE WHEN rn >= {n + 1} THEN CASE WHEN avg(greatest(-ch, 0.0)) OVER {_ROWS(n)} = 0 THEN 100.0 ELSE "
    f"100.0 - 100.0 / (1.0 + avg(greatest(ch, 0.0)) OVER {_ROWS(n)} / avg(greatest(-ch, 0.0)) OVER {_ROWS(n)}) END END"
)
_STEPS = f""",
steps AS (SELECT *, row_number() OVER {_W} AS rn, close - lag(close) OVER {_W} AS ch, lag(close) OVER {_W} AS pc,
  lag(close, 5) OVER {_W} AS c5 FROM bars)"""
_INDICATORS = f"""WITH {DAILY_SQL}{_STEPS},
v AS (SELECT symbol, ts,
  CASE WHEN rn >= 10 THEN avg(close) OVER {_ROWS(10)} END AS sma_10, {_RSI(7)} AS rsi_7,
  CASE WHEN rn >= 8 THEN avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER {_ROWS(7)} END AS atr_7,
  CASE WHEN rn >= 10 THEN avg(close) OVER {_ROWS(10)} + 2 * stddev_pop(close) OVER {_ROWS(10)} END AS bb_up,
  CASE WHEN rn >= 10 THEN avg(close) OVER {_ROWS(10)} - 2 * stddev_pop(close) OVER {_ROWS(10)} END AS bb_lo,
  CASE WHEN rn >= 6 THEN (close / c5 - 1) * 100 END AS roc_5, CASE WHEN rn >= 2 THEN close / pc - 1 END AS ret,
  CASE WHEN rn >= 20 THEN len(list_filter(list(close) OVER {_ROWS(20)}, lambda x: x <= close)) / 20.0 END AS rank_20,
  CASE WHEN rn >= 20 THEN (close - avg(close) OVER {_ROWS(20)}) / stddev_pop(close) OVER {_ROWS(20)} END AS z_20 FROM steps)
SELECT symbol, ts, sma_10 IS NOT NULL AND rsi_7 IS NOT NULL AND atr_7 IS NOT NULL AND roc_5 IS NOT NULL AND ret IS NOT NULL AND rank_20 IS NOT NULL AND z_20 IS NOT NULL AS warm,
  {_R("sma_10", "rsi_7", "atr_7", "bb_up", "bb_lo", "roc_5", "ret", "rank_20", "z_20", n=5)} FROM v"""

_FOLD = lambda src_sql, k: (
    f"list_reduce(list_prepend(list_avg({src_sql}[1:{k}]), {src_sql}[{k + 1}:]), lambda e, c: c * (2.0 / {k + 1}) + e * (1 - 2.0 / {k + 1}))"
)
_BUFFER = f"""WITH {DAILY_SQL},
b AS (SELECT symbol, ts, list(close) OVER {_ROWS(30)} AS l FROM bars),
c AS (SELECT *, list_transform(range(1, len(l)), lambda i: l[i + 1] - l[i]) AS ch, len(l) AS n FROM b),
d AS (SELECT *, list_transform(ch, lambda x: greatest(x, 0.0)) AS g, list_transform(ch, lambda x: greatest(-x, 0.0)) AS s,
  CASE WHEN n >= 16 THEN list_transform(range(13, n + 1), lambda i: {_FOLD("l[1:i]", 5)} - {_FOLD("l[1:i]", 12)}) END AS m FROM c),
e AS (SELECT symbol, ts, CASE WHEN n >= 10 THEN {_FOLD("l", 10)} END AS ema_10,
  CASE WHEN n >= 8 THEN list_reduce(list_prepend(list_avg(g[1:7]), g[8:]), lambda a, x: (a * 6 + x) / 7) END AS ug,
  CASE WHEN n >= 8 THEN list_reduce(list_prepend(list_avg(s[1:7]), s[8:]), lambda a, x: (a * 6 + x) / 7) END AS us,
  m[len(m)] AS macd_v, CASE WHEN n >= 16 THEN {_FOLD("m", 4)} END AS macd_s FROM d),
f AS (SELECT symbol, ts, ema_10, CASE WHEN us = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ug / us) END AS wilder_7, macd_v, macd_s, macd_v - macd_s AS macd_h FROM e)
SELECT symbol, ts, {_R("ema_10", "wilder_7", "macd_v", "macd_s", "macd_h", n=5)} FROM f"""

_READY = f"""{DAILY_SQL}{_STEPS},
ready AS (SELECT *, osc IS NOT NULL AND avg20 IS NOT NULL AS warm FROM (SELECT symbol, ts, open, close, rn, {_RSI(14)} AS osc,
  CASE WHEN rn >= 20 THEN avg(close) OVER {_ROWS(20)} END AS avg20 FROM steps)),
flags AS (SELECT symbol, ts, open, close, rn, coalesce(warm AND osc < 40 AND close > avg20, FALSE) AS el, coalesce(warm AND osc > 60, FALSE) AS xl FROM ready)"""
_FOLD_LONG = """,
run AS (
  SELECT symbol, rn, CASE WHEN el THEN 1 ELSE 0 END AS st, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS eop, FALSE AS closed, ts, close FROM flags WHERE rn = 1
  UNION ALL
  SELECT f.symbol, f.rn,
    CASE WHEN r.st > 0 THEN CASE WHEN f.xl THEN 0 ELSE 2 END WHEN f.el THEN 1 ELSE 0 END,
    CASE WHEN r.st = 1 THEN f.ts ELSE r.ets END, CASE WHEN r.st = 1 THEN f.open ELSE r.eop END, r.st > 0 AND f.xl, f.ts, f.close
  FROM run r JOIN flags f ON f.symbol = r.symbol AND f.rn = r.rn + 1),
ends AS (SELECT symbol, max(rn) AS z FROM flags GROUP BY 1),
raw AS (
  SELECT symbol, ets AS entry_ts, eop + 0.01 AS entry_price, ts AS exit_ts, close - 0.01 AS exit_price, 'signal' AS exit_reason FROM run WHERE closed
  UNION ALL SELECT symbol, ets, eop + 0.01, ts, close - 0.01, 'eod' FROM run JOIN ends USING (symbol) WHERE rn = z AND st = 2),
trades AS (SELECT symbol, 'long' AS side, 1 AS size, entry_ts, entry_price, exit_ts, exit_price, exit_reason, exit_price - entry_price AS pnl,
  (exit_price - entry_price) / entry_price AS pnl_pct, CAST(date_diff('minute', entry_ts, exit_ts) AS INT) AS duration_mins FROM raw)"""
_TRADES = f"WITH RECURSIVE {_READY}{_FOLD_LONG} "
_TRADE_SELECT = (
    "symbol, side, size, entry_ts, round(entry_price, 6) AS entry_price, exit_ts, round(exit_price, 6) AS exit_price, exit_reason, "
    "round(pnl, 6) AS pnl, round(pnl_pct, 6) AS pnl_pct, duration_mins"
)
_METRICS = """m AS (SELECT symbol, count(*) AS total_trades, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS gross_win,
  coalesce(sum(pnl) FILTER (pnl <= 0), 0.0) AS gross_loss, coalesce(avg(pnl) FILTER (pnl > 0), 0.0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0.0) AS avg_loss,
  sum(pnl) AS total_pnl, avg(pnl) AS avg_trade, avg(duration_mins) AS avg_duration_mins FROM trades GROUP BY 1)"""
_PF = "CASE WHEN gross_loss < 0 THEN gross_win / -gross_loss ELSE 'inf'::DOUBLE END"

# both sides, sessions: state 0 flat, 1 and 2 pending, 3 and 4 held
_SESSION_READY = f"""{SESSION_SQL},
steps AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER {_W} AS n, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS rn,
  lead(CAST(ts AS DATE)) OVER {_W} AS next_day FROM bars),
ready AS (SELECT *, CASE WHEN rn >= 10 THEN avg(close) OVER w END AS mid, CASE WHEN rn >= 10 THEN stddev_pop(close) OVER w END AS sd FROM steps
  WINDOW w AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
flags AS (SELECT symbol, ts, open, close, n, day, next_day IS NULL OR next_day <> day AS last_bar, strftime(ts, '%H:%M') >= '15:50' AS eod,
  coalesce(close < mid - 1.5 * sd, FALSE) AS el, coalesce(close > mid + 1.5 * sd, FALSE) AS es, coalesce(close >= mid, FALSE) AS xl, coalesce(NOT close > mid, FALSE) AS xs FROM ready)"""
_SESSION_FOLD = """,
run AS (
  SELECT symbol, n, CASE WHEN el THEN 1 WHEN es THEN 2 ELSE 0 END AS st, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS eop, 0 AS side, NULL::VARCHAR AS why, ts, close FROM flags WHERE n = 1
  UNION ALL
  SELECT symbol, n, CASE WHEN ended IS NOT NULL AND NOT (ended = 'eod' AND eod_at) THEN 0
      WHEN held > 0 AND ended IS NULL THEN held
      WHEN el THEN 1 WHEN es THEN 2 ELSE 0 END,
    ets, eop, held, ended, ts, close
  FROM (SELECT f.symbol, f.n, f.ts, f.close, f.el, f.es, f.last_bar, f.eod AS eod_at,
      CASE r.st WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 0 THEN 0 ELSE r.st END AS held,
      CASE WHEN r.st IN (1, 2) THEN f.ts ELSE r.ets END AS ets, CASE WHEN r.st IN (1, 2) THEN f.open ELSE r.eop END AS eop,
      CASE WHEN r.st = 0 THEN NULL WHEN f.eod THEN 'eod' WHEN (r.st IN (1, 3) AND f.xl) OR (r.st IN (2, 4) AND f.xs) THEN 'signal' WHEN f.last_bar THEN 'eod' END AS ended
    FROM run r JOIN flags f ON f.symbol = r.symbol AND f.n = r.n + 1)),
raw AS (SELECT symbol, CASE side WHEN 3 THEN 1 ELSE -1 END AS sg, ets AS entry_ts, eop, ts AS exit_ts, close, why AS exit_reason FROM run WHERE why IS NOT NULL),
trades AS (SELECT symbol, CASE sg WHEN 1 THEN 'long' ELSE 'short' END AS side, 1 AS size, entry_ts, eop + sg * 0.01 AS entry_price, exit_ts, close - sg * 0.01 AS exit_price, exit_reason,
  (close - sg * 0.01 - eop - sg * 0.01) * sg AS pnl, (close - sg * 0.01 - eop - sg * 0.01) * sg / (eop + sg * 0.01) AS pnl_pct,
  CAST(date_diff('second', entry_ts, exit_ts) // 60 AS INT) AS duration_mins FROM raw)"""

def _boot(seed: int) -> str:
    return _BOOT.replace("SEED", str(seed))


_BOOT = """
numbered AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, exit_ts, pnl) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n FROM trades),
d0 AS (SELECT symbol, r, n, (r * 7919 + place * 104729 + SEED * 1299709 + 1) % 2147483647 AS x
  FROM numbered, (SELECT unnest(range(5000)) AS r)),
d1 AS (SELECT * REPLACE ((x * (x + 48271) + r) % 2147483647 AS x) FROM d0), d2 AS (SELECT * REPLACE ((x * (x + 48271) + r) % 2147483647 AS x) FROM d1),
d3 AS (SELECT * REPLACE ((x * (x + 48271) + r) % 2147483647 AS x) FROM d2), drawn AS (SELECT symbol, r, (x * (x + 48271) + r) % 2147483647 % n AS place FROM d3),
pfs AS (SELECT symbol, r, coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS w, coalesce(-sum(pnl) FILTER (pnl < 0), 0.0) AS l FROM drawn JOIN numbered USING (symbol, place) GROUP BY 1, 2),
ci AS (SELECT symbol, quantile_cont(CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 100.0 ELSE 0.0 END, 0.05) AS ci_lower,
  quantile_cont(CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 100.0 ELSE 0.0 END, 0.95) AS ci_upper, avg(CAST(l <= 0 AS DOUBLE)) AS fraction_capped FROM pfs GROUP BY 1),
own AS (SELECT symbol, count(*) AS n_trades, coalesce(sum(pnl) FILTER (pnl > 0), 0.0) AS w, coalesce(-sum(pnl) FILTER (pnl < 0), 0.0) AS l FROM trades GROUP BY 1),
boot AS (SELECT symbol, CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 100.0 ELSE 0.0 END AS pf, ci_lower, ci_upper, fraction_capped, n_trades, n_trades < 100 AS under_sampled FROM own JOIN ci USING (symbol))"""


def _judged(bars: str, n_grid: int, floor: int) -> str:
    """Score and thresholds from boot.  On daily bars no random entry has a later bar, so p is 0 for a symbol that gains and 1 else."""
    columns = {c: c for c in ("median_pf", "std_pf", "ci_lower", "p_value", "score")} | {"reported_score": f"CASE WHEN n_trades < {floor} THEN 0.0 ELSE score END"}
    return f""",
judged_a AS (SELECT coalesce(median(pf), 0.0) AS median_pf, coalesce(stddev_pop(pf), 0.0) AS std_pf, coalesce(median(ci_lower), 0.0) AS ci_lower, CAST(coalesce(sum(n_trades), 0) AS BIGINT) AS n_trades,
  coalesce(median(CASE WHEN pf <= 0 THEN 1.0 ELSE 0.0 END), 1.0)::DOUBLE AS p_value FROM boot),
judged_u AS (SELECT substring(sha256(string_agg(DISTINCT symbol, ',' ORDER BY symbol)), 1, 12) AS basket_hash, count(DISTINCT symbol) AS n_symbols FROM {bars}),
judged AS (SELECT *, median_pf / (1 + std_pf) * pow(0.95, {n_grid}) * CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.5 END AS score FROM judged_a, judged_u)
SELECT 'dips' AS strategy, {", ".join(f"CAST(format('{{:.7e}}', {v}) AS DOUBLE) AS {c}" for c, v in columns.items())}, n_trades,
  concat_ws(',', CASE WHEN score <= 1.5 THEN 'score' END, CASE WHEN median_pf <= 1.2 THEN 'median_pf' END, CASE WHEN ci_lower <= 1.0 THEN 'ci_lower' END, CASE WHEN n_trades < 30 THEN 'n_trades' END) AS failed_names,
  score > 1.5 AND median_pf > 1.2 AND ci_lower > 1.0 AND n_trades >= 30 AS promising, basket_hash, n_symbols FROM judged"""


_EQUITY = """
e0 AS (SELECT b.symbol, b.ts, b.close, (SELECT max(ts) FROM bars z WHERE z.symbol = b.symbol) AS z FROM bars b),
eq AS (SELECT symbol, ts, 10000.0
    + coalesce((SELECT sum(pnl) FROM trades t WHERE t.symbol = e0.symbol AND t.exit_ts <= e0.ts AND NOT (t.exit_reason = 'eod' AND t.exit_ts = e0.z)), 0.0)
    + coalesce((SELECT sum(e0.close - entry_price) FROM trades t WHERE t.symbol = e0.symbol AND t.entry_ts <= e0.ts
        AND (e0.ts < t.exit_ts OR (t.exit_reason = 'eod' AND t.exit_ts = e0.z AND e0.ts = t.exit_ts))), 0.0) AS equity FROM e0)"""
_DD = """
pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts) AS peak, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM eq)"""

_WINDOWS = f"""WITH {DAILY_SQL},
s AS (SELECT symbol, CAST(min(ts) AS DATE) AS a, CAST(date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS DATE) AS z FROM bars GROUP BY 1),
t AS (SELECT symbol, CASE WHEN day(a) = 1 THEN a ELSE CAST(date_trunc('month', a) + INTERVAL 1 MONTH AS DATE) END AS a, z FROM s),
w AS (SELECT symbol, i, CAST(a + to_months(CAST(6 * i AS INT)) AS DATE) AS train_start, z FROM t, (SELECT unnest(range(0, 200)) AS i))
SELECT symbol, CAST(i AS INT) AS window_id, CAST(train_start AS VARCHAR) AS train_start, CAST(CAST(train_start + INTERVAL 24 MONTH AS DATE) AS VARCHAR) AS test_start,
  CAST(CAST(train_start + INTERVAL 30 MONTH AS DATE) AS VARCHAR) AS test_end
FROM w WHERE CAST(train_start + INTERVAL 30 MONTH AS DATE) <= z"""


def _series_sql(bars: str, n: str, points: str) -> str:
    """Flags, fold and trades of the daily strategy over the series of ``bars`` (symbol is the series) and grid points, as CTEs with suffix n."""
    steps = _STEPS.replace("FROM bars", f"FROM {bars}").replace("steps AS", f"steps{n} AS")
    return f"""{steps},
ready{n} AS (SELECT symbol, ts, open, close, rn, {_RSI(14)} AS osc, CASE WHEN rn >= 20 THEN avg(close) OVER {_ROWS(20)} END AS avg20 FROM steps{n}),
flags{n} AS (SELECT r.symbol, grid_id, ts, open, close, rn, coalesce(osc < lo AND close > avg20, FALSE) AS el, coalesce(osc > hi AND avg20 IS NOT NULL, FALSE) AS xl
  FROM ready{n} r JOIN {points} p ON p.symbol = '' OR p.symbol = r.symbol),
run{n} AS (
  SELECT symbol, grid_id, rn, CASE WHEN el THEN 1 ELSE 0 END AS st, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS eop, FALSE AS closed, ts, close FROM flags{n} WHERE rn = 1
  UNION ALL
  SELECT f.symbol, f.grid_id, f.rn, CASE WHEN r.st > 0 THEN CASE WHEN f.xl THEN 0 ELSE 2 END WHEN f.el THEN 1 ELSE 0 END,
    CASE WHEN r.st = 1 THEN f.ts ELSE r.ets END, CASE WHEN r.st = 1 THEN f.open ELSE r.eop END, r.st > 0 AND f.xl, f.ts, f.close
  FROM run{n} r JOIN flags{n} f ON f.symbol = r.symbol AND f.grid_id = r.grid_id AND f.rn = r.rn + 1),
ends{n} AS (SELECT symbol, max(rn) AS z FROM flags{n} GROUP BY 1),
raw{n} AS (SELECT symbol, grid_id, ets, eop, ts, close, 'signal' AS exit_reason FROM run{n} WHERE closed
  UNION ALL SELECT symbol, grid_id, ets, eop, ts, close, 'eod' FROM run{n} JOIN ends{n} USING (symbol) WHERE rn = z AND st = 2),
trades{n} AS (SELECT symbol, grid_id, 'long' AS side, 1 AS size, ets AS entry_ts, eop + 0.01 AS entry_price, ts AS exit_ts, close - 0.01 AS exit_price, exit_reason, close - eop - 0.02 AS pnl,
  (close - eop - 0.02) / (eop + 0.01) AS pnl_pct, CAST(date_diff('minute', ets, ts) AS INT) AS duration_mins FROM raw{n})"""


_SLICES = _WINDOWS.replace("FROM bars", "FROM bars0").replace("bars AS (", "bars0 AS (").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT symbol, CAST(i AS INT)", ", win AS (SELECT symbol, CAST(i AS INT)", 1) + """),
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS g FROM bars0),
firsts AS (SELECT w.symbol, window_id, min(g) AS f FROM nb JOIN win w ON w.symbol = nb.symbol AND ts >= CAST(test_start AS TIMESTAMP) GROUP BY 1, 2),
test AS (SELECT nb.symbol || '|' || w.window_id AS symbol, nb.* EXCLUDE (symbol) FROM nb JOIN win w ON w.symbol = nb.symbol JOIN firsts f ON f.symbol = w.symbol AND f.window_id = w.window_id
  WHERE g >= f - 200 AND ts < CAST(test_end AS TIMESTAMP)),
train AS (SELECT nb.symbol || '|' || w.window_id AS symbol, nb.* EXCLUDE (symbol) FROM nb JOIN win w ON w.symbol = nb.symbol AND ts >= CAST(train_start AS TIMESTAMP) AND ts < CAST(test_start AS TIMESTAMP)),
keyed AS (SELECT symbol || '|' || window_id AS k, * FROM win)"""
_PFX = lambda a: f"CASE WHEN coalesce(-sum({a}) FILTER ({a} < 0), 0) > 0 THEN coalesce(sum({a}) FILTER ({a} > 0), 0) / -sum({a}) FILTER ({a} < 0) WHEN coalesce(sum({a}) FILTER ({a} > 0), 0) > 0 THEN 100.0 ELSE 0.0 END"
_OOS = f"""{_SLICES}, pts AS (SELECT '' AS symbol, 0 AS grid_id, 40.0 AS lo, 60.0 AS hi){_series_sql("test", "_t", "pts")},
oos AS (SELECT window_id, t.* REPLACE (keyed.symbol AS symbol) FROM trades_t t JOIN keyed ON k = t.symbol WHERE entry_ts >= CAST(test_start AS TIMESTAMP))
SELECT window_id, {_TRADE_SELECT} FROM oos"""
_WALK = f"""{_SLICES}, grid AS (SELECT '' AS symbol, * FROM (VALUES (0, 35.0, 55.0), (1, 35.0, 65.0), (2, 45.0, 55.0), (3, 45.0, 65.0)) v(grid_id, lo, hi)){_series_sql("train", "_a", "grid")},
fit AS (SELECT symbol AS k, grid_id, {_PFX("pnl")} AS pf, count(*) AS n, sum(pnl) AS pnl FROM trades_a GROUP BY 1, 2 HAVING count(*) >= 5),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY k ORDER BY pf DESC, pnl DESC, grid_id) = 1),
chosen AS (SELECT k AS symbol, coalesce(best.grid_id, -1) AS grid_id, coalesce(lo, 40.0) AS lo, coalesce(hi, 60.0) AS hi, best.grid_id AS found, coalesce(pf, 0.0) AS train_pf, coalesce(n, 0) AS train_n_trades
  FROM keyed LEFT JOIN best USING (k) LEFT JOIN grid ON grid.grid_id = best.grid_id){_series_sql("test", "_b", "chosen")},
o AS (SELECT t.symbol AS k, {_PFX("pnl")} AS test_pf, count(*) AS test_n FROM trades_b t JOIN keyed ON k = t.symbol WHERE entry_ts >= CAST(test_start AS TIMESTAMP) GROUP BY 1)
SELECT keyed.symbol, window_id, train_start, test_start, test_end, coalesce(found, -1) AS grid_id, CAST(format('{{:.7e}}', train_pf) AS DOUBLE) AS train_pf, train_n_trades, hi::DOUBLE AS p_high, lo::DOUBLE AS p_low, CAST(format('{{:.7e}}', coalesce(test_pf, 0.0)) AS DOUBLE) AS test_pf, coalesce(test_n, 0) AS test_n_trades
FROM keyed JOIN chosen c ON c.symbol = keyed.k LEFT JOIN o USING (k)"""
_HOLDOUT = f"""WITH RECURSIVE {DAILY_SQL.replace("bars AS (", "bars0 AS (")}, nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS g FROM bars0),
f AS (SELECT symbol, count(*) FILTER (ts < TIMESTAMP '2001-01-01') AS n FROM nb GROUP BY 1), hold AS (SELECT nb.* FROM nb JOIN f USING (symbol) WHERE g > n - 200),
pts AS (SELECT '' AS symbol, 0 AS grid_id, 40.0 AS lo, 60.0 AS hi){_series_sql("hold", "_h", "pts")}
SELECT {_TRADE_SELECT} FROM trades_h WHERE entry_ts >= TIMESTAMP '2001-01-01'"""
_CRYPTO = f"""WITH c AS (SELECT feed AS symbol, time AT TIME ZONE 'UTC' AS ts, open, high, low, close, volume FROM bars_5m WHERE asset_class <> 'stocks' AND close IS NOT NULL AND close::VARCHAR <> 'nan'),
bars AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_max(close, (ts, close, open, high, low, volume)) AS close FROM c GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER {_W} AS rn, lag(close, 5) OVER {_W} AS c5 FROM bars)
SELECT symbol, ts, round(close, 6) AS close, round(CASE WHEN rn >= 10 THEN avg(close) OVER {_ROWS(10)} END, 6) AS sma_10, round(CASE WHEN rn >= 6 THEN (close / nullif(c5, 0) - 1) * 100 END, 6) AS roc_5 FROM s"""
# the state of a dip buyer: flat 0, order 1, position 2
def _dips(n: int, low: float, high: float, trend: int, mult: float, most: int, trailing: bool) -> str:
    raised = f"greatest(s.stop, s.peak - {mult} * s.rng)" if trailing else "s.stop"
    return f"""WITH RECURSIVE {DAILY_SQL}, st AS (SELECT *, row_number() OVER {_W} AS rn, close - lag(close) OVER {_W} AS ch, lag(close) OVER {_W} AS pc FROM bars),
v AS (SELECT *, {_RSI(n)} AS osc, CASE WHEN rn >= 15 THEN avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER {_ROWS(14)} END AS rng, CASE WHEN rn >= {trend} THEN avg(close) OVER {_ROWS(trend)} END AS trend FROM st),
w AS (SELECT *, lag(osc) OVER {_W} AS was, close - {mult} * rng AS level FROM v),
f AS (SELECT *, coalesce(osc < {low} AND close > trend AND level > 0, FALSE) AS el, coalesce(osc > {high} AND (was IS NULL OR was <= {high}), FALSE) AS xl FROM w),
run AS (
  SELECT symbol, rn, CASE WHEN el THEN 1 ELSE 0 END AS st, level AS stop, high AS peak, 0 AS age, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS eop, NULL::VARCHAR AS why, NULL::DOUBLE AS lvl, ts, close FROM f WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN s.held AND NOT s.stopped THEN CASE WHEN s.gone THEN 0 ELSE 2 END WHEN s.el THEN 1 ELSE 0 END,
    CASE WHEN s.held AND NOT s.stopped THEN {raised} ELSE s.level END, CASE WHEN s.held AND NOT s.stopped THEN s.peak ELSE s.high END,
    CASE WHEN s.held AND NOT s.stopped THEN s.age ELSE 0 END, s.ets, s.eop, CASE WHEN s.stopped THEN 'stop' WHEN s.held AND s.gone THEN 'signal' END, CASE WHEN s.stopped THEN s.stop ELSE s.close END, s.ts, s.close
  FROM (SELECT f.symbol, f.rn, f.el, f.level, f.high, f.ts, f.close, f.rng, r.stop, r.st > 0 AS held, r.st > 0 AND f.low <= r.stop AS stopped, r.age + 1 AS age, greatest(r.peak, f.high) AS peak,
    f.xl OR r.age + 1 >= {most} AS gone, CASE WHEN r.st = 1 THEN f.ts ELSE r.ets END AS ets, CASE WHEN r.st = 1 THEN f.open ELSE r.eop END AS eop
    FROM run r JOIN f ON f.symbol = r.symbol AND f.rn = r.rn + 1) s),
ends AS (SELECT symbol, max(rn) AS z FROM f GROUP BY 1),
raw AS (SELECT symbol, ets, eop, ts, lvl, why FROM run WHERE why IS NOT NULL UNION ALL SELECT symbol, ets, eop, ts, close, 'eod' FROM run JOIN ends USING (symbol) WHERE rn = z AND st = 2),
trades AS (SELECT symbol, 'long' AS side, 1 AS size, ets AS entry_ts, eop + 0.01 AS entry_price, ts AS exit_ts, lvl - 0.01 AS exit_price, why AS exit_reason, lvl - eop - 0.02 AS pnl,
  (lvl - eop - 0.02) / (eop + 0.01) AS pnl_pct, CAST(date_diff('minute', ets, ts) AS INT) AS duration_mins, 'dip' AS signal_label FROM raw)
SELECT symbol, side, size, entry_ts, exit_ts, exit_reason, duration_mins, signal_label, {_R('entry_price', 'exit_price', 'pnl', 'pnl_pct', n=5)} FROM trades"""


# the opening range bar by bar: a fills, b exits, c is the bar's place in the session's phases (0 first bar, 1 breakout, 2 retest, 3 trade, 4 over)
def _opening(select: str, *, momentum: bool = False, stop: str = "far", confirm: int = 2, cutoff: str = "11:00", timeout: int = 12) -> str:
    return f"""WITH RECURSIVE {SESSION_SQL},
f AS (SELECT *, row_number() OVER {_W} AS n, CAST(ts AS DATE) AS day, CAST(lag(ts) OVER {_W} AS DATE) IS DISTINCT FROM CAST(ts AS DATE) AS fresh, CAST(lead(ts) OVER {_W} AS DATE) IS DISTINCT FROM CAST(ts AS DATE) AS final,
  strftime(ts, '%H:%M') >= '{cutoff}' AS late, strftime(ts, '%H:%M') >= '15:50' AS ending FROM bars),
run AS (
  SELECT symbol, 0::BIGINT AS n, 0 AS phase, NULL::DOUBLE AS top, NULL::DOUBLE AS flo, 0 AS trend, 0 AS beyond, 0 AS waits, 0 AS oside, NULL::DOUBLE AS ostop, NULL::DOUBLE AS otarget, NULL::VARCHAR AS olabel,
    0 AS side, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::VARCHAR AS label, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS eop, NULL::VARCHAR AS why, NULL::DOUBLE AS lvl, 0 AS was, NULL::TIMESTAMP AS ts, FALSE AS held, 0 AS ordered FROM (SELECT DISTINCT symbol FROM f)
  UNION ALL
  SELECT symbol, n, phase3, top3, flo3, trend3, beyond3, waits3,
    CASE WHEN closes THEN 0 WHEN enters AND left_side = 0 THEN trend3 ELSE oside2 END, CASE WHEN enters AND left_side = 0 THEN far ELSE ostop END, CASE WHEN enters AND left_side = 0 THEN close + trend3 * risk * 2.0 ELSE otarget END,
    CASE WHEN enters AND left_side = 0 THEN CASE WHEN trend3 > 0 THEN 'long_' ELSE 'short_' END || CASE WHEN touched THEN 'retest' ELSE 'momentum' END ELSE olabel END,
    CASE WHEN closes THEN 0 ELSE left_side END, stop2, target2, label2, ets2, eop2, CASE WHEN why2 IS NOT NULL THEN why2 WHEN closes THEN 'eod' END, CASE WHEN why2 IN ('stop', 'target') THEN lvl2 ELSE close END, side2, ts, left_side <> 0, CAST(enters AS INT)
  FROM (SELECT *, CASE WHEN enters THEN 3 WHEN phase_w = 2 AND flat_risk THEN 4 ELSE phase_w END AS phase3, final AND left_side <> 0 AS closes FROM (
    SELECT *, abs(close - far) AS risk, hits AND abs(close - far) > 0 AS enters, hits AND NOT abs(close - far) > 0 AS flat_risk FROM (
    SELECT *, watching AND (touched OR quick) AS hits, {{"far": "CASE WHEN trend3 > 0 THEN flo3 ELSE top3 END", "midpoint": "(top3 + flo3) / 2"}}[STOP] AS far FROM (
    SELECT *, watching AND past > 0 AND CASE WHEN trend3 > 0 THEN low <= top3 ELSE high >= flo3 END AS touched, {str(momentum).upper()} AND watching AND past >= 0.5 * (top3 - flo3) AS quick FROM (
    SELECT *, CASE WHEN trend3 > 0 THEN close - top3 ELSE flo3 - close END AS past, phase2 = 2 AND NOT late AND waits2 < {timeout} AS watching,
      CASE WHEN phase2 = 2 AND NOT late AND waits2 < {timeout} THEN waits2 + 1 WHEN phase2 = 1 AND beyond3 >= {confirm} THEN 0 ELSE waits2 END AS waits3,
      CASE WHEN phase2 = 0 THEN 1 WHEN phase2 IN (1, 2) AND late THEN 4 WHEN phase2 = 1 AND beyond3 >= {confirm} THEN 2 WHEN phase2 = 2 AND waits2 >= {timeout} THEN 4 ELSE phase2 END AS phase_w FROM (
    SELECT *, CASE WHEN phase2 = 0 THEN high ELSE top END AS top3, CASE WHEN phase2 = 0 THEN low ELSE flo END AS flo3, CASE WHEN phase2 = 1 AND NOT late THEN sgn ELSE trend2 END AS trend3,
      CASE WHEN phase2 = 1 AND NOT late THEN CASE WHEN sgn = 0 THEN 0 WHEN sgn = trend2 THEN beyond2 + 1 ELSE 1 END ELSE beyond2 END AS beyond3 FROM (
    SELECT *, CASE WHEN close > top THEN 1 WHEN close < flo THEN -1 ELSE 0 END AS sgn, CASE WHEN why2 IS NULL THEN side2 ELSE 0 END AS left_side, CASE WHEN why2 = 'eod' THEN 0 ELSE oside1 END AS oside2,
      CASE WHEN why2 IS NULL THEN phase1 WHEN trend2 <> 0 THEN 2 ELSE 4 END AS phase2, CASE WHEN why2 IS NULL THEN waits1 ELSE 0 END AS waits2 FROM (
    SELECT *, CASE WHEN side2 > 0 AND low <= stop2 OR side2 < 0 AND high >= stop2 THEN 'stop' WHEN side2 > 0 AND high >= target2 OR side2 < 0 AND low <= target2 THEN 'target' WHEN side2 <> 0 AND ending THEN 'eod' END AS why2,
      CASE WHEN side2 > 0 AND low <= stop2 OR side2 < 0 AND high >= stop2 THEN stop2 ELSE target2 END AS lvl2 FROM (
    SELECT f.*, CASE WHEN fresh THEN 0 ELSE phase END AS phase1, CASE WHEN fresh THEN 0 ELSE waits END AS waits1, CASE WHEN fresh THEN 0 ELSE trend END AS trend2, CASE WHEN fresh THEN 0 ELSE beyond END AS beyond2,
      r.top, r.flo, r.ostop, r.otarget, r.olabel, CASE WHEN oside <> 0 AND side = 0 THEN oside ELSE side END AS side2, CASE WHEN oside <> 0 AND side = 0 THEN ostop ELSE stop END AS stop2,
      CASE WHEN oside <> 0 AND side = 0 THEN otarget ELSE target END AS target2, CASE WHEN oside <> 0 AND side = 0 THEN olabel ELSE label END AS label2, CASE WHEN oside <> 0 AND side = 0 THEN f.ts ELSE ets END AS ets2,
      CASE WHEN oside <> 0 AND side = 0 THEN f.open ELSE eop END AS eop2, CASE WHEN side = 0 THEN 0 ELSE oside END AS oside1
    FROM run r JOIN f ON f.symbol = r.symbol AND f.n = r.n + 1)))))))))),
trades AS (SELECT symbol, CASE WHEN was > 0 THEN 'long' ELSE 'short' END AS side, 1 AS size, ets AS entry_ts, eop + was * 0.01 AS entry_price, ts AS exit_ts, lvl - was * 0.01 AS exit_price, why AS exit_reason,
  (lvl - eop - was * 0.02) * was AS pnl, (lvl - eop - was * 0.02) * was / (eop + was * 0.01) AS pnl_pct, CAST(date_diff('second', ets, ts) // 60 AS INT) AS duration_mins, label AS signal_label FROM run WHERE why IS NOT NULL)
{select}""".replace('{"far": "CASE WHEN trend3 > 0 THEN flo3 ELSE top3 END", "midpoint": "(top3 + flo3) / 2"}[STOP]', {"far": "CASE WHEN trend3 > 0 THEN flo3 ELSE top3 END", "midpoint": "(top3 + flo3) / 2"}[stop])


_CUSTOM_SELECT = f"SELECT symbol, side, size, entry_ts, exit_ts, exit_reason, duration_mins, signal_label, {_R('entry_price', 'exit_price', 'pnl', 'pnl_pct', n=5)} FROM trades"

SQL = {
    "q_daily_bars": f"WITH {DAILY_SQL} SELECT symbol, ts, {_OHLCV} FROM bars",
    "q_session_bars": f"WITH {SESSION_SQL} SELECT symbol, ts, {_OHLCV} FROM bars",
    "q_hourly_bars": f"WITH {_EVENTS} SELECT symbol, ts, {_OHLCV} FROM bars",
    "q_four_hour_bars": f"""WITH {SESSION_SQL}, o AS (SELECT symbol, date_trunc('day', min(ts))::TIMESTAMP AS o FROM bars GROUP BY 1),
c AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts, o) AS b, bars.* EXCLUDE (symbol) FROM bars JOIN o USING (symbol)),
x AS (SELECT symbol, b AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM c GROUP BY symbol, b)
SELECT symbol, ts, {_OHLCV} FROM x""",
    "q_indicators": _INDICATORS,
    "q_buffer_indicators": _BUFFER,
    "q_session_places": f"""WITH {SESSION_SQL}
SELECT symbol, ts, round(max(high) OVER w, 6) AS highest_high, round(min(low) OVER w, 6) AS lowest_low, row_number() OVER o AS bars_since_open, row_number() OVER o = 1 AS is_session_start
FROM bars WINDOW o AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts), w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "q_signal_frequency": f"""WITH {_READY},
a AS (SELECT symbol, count(*) AS n_bars, count(*) FILTER (warm) AS warm_bars, count(*) FILTER (warm AND osc < 40 AND close > avg20) AS full_hits,
  count(*) FILTER (warm AND osc < 40) AS c0, count(*) FILTER (warm AND close > avg20) AS c1 FROM ready GROUP BY 1)
SELECT symbol, n_bars, warm_bars, round(warm_bars / n_bars, 6) AS warm_ratio, full_hits, round(full_hits / nullif(least(c0, c1), 0)::DOUBLE, 6) AS full_to_least, unnest(['osc < param.low', 'price.close > avg20']) AS clause, unnest([c0, c1]) AS clause_hits FROM a""",
    "q_trades": _TRADES + f"SELECT {_TRADE_SELECT} FROM trades",
    "q_session_trades": f"WITH RECURSIVE {_SESSION_READY}{_SESSION_FOLD} SELECT {_TRADE_SELECT} FROM trades",
    "q_trade_metrics": f"{_TRADES}, {_METRICS} SELECT symbol, total_trades, {_R('win_rate', 'gross_win', 'gross_loss', 'avg_win', 'avg_loss', 'total_pnl', 'avg_trade', 'avg_duration_mins', n=5)}, round({_PF}, 5) AS profit_factor FROM m",
    "q_pooled": f"{_TRADES}, {_METRICS}, p AS (SELECT CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(round(win_rate * total_trades)) AS BIGINT) AS wins, sum(total_pnl) AS total_pnl, sum(gross_win) AS gross_win, sum(gross_loss) AS gross_loss FROM m) SELECT total_trades, wins, round(total_pnl, 5) AS total_pnl, round({_PF}, 5) AS profit_factor FROM p",
    "q_equity": f"{_TRADES}, {_EQUITY} SELECT symbol, ts, round(equity, 5) AS equity FROM eq",
    "q_drawdown_sharpe": f"""{_TRADES}, {_EQUITY}, {_DD}
SELECT symbol, (SELECT count(*) FROM trades t WHERE t.symbol = pk.symbol) AS total_trades, round(min(equity - peak), 5) AS max_drawdown_dollar, round(min((equity - peak) / peak), 5) AS max_drawdown_pct,
  round(avg(r) / stddev_samp(r) * sqrt(252.0), 5) AS sharpe_ratio, round(arg_max(equity, ts), 5) AS ending_capital FROM pk GROUP BY 1""",
    "q_windows": _WINDOWS,
    "q_walk_forward": _WALK,
    "q_oos_trades": _OOS,
    "q_holdout": _HOLDOUT,
    "q_crypto_indicators": _CRYPTO,
    "q_stream_ema": """WITH e AS (SELECT event_type AS symbol, list(value ORDER BY ts, event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT symbol, len(l) AS n, greatest(len(l) - 19, 0) AS n_averages, round(CASE WHEN len(l) >= 20 THEN list_reduce(list_prepend(list_avg(l[1:20]), l[21:]), lambda e, c: c * (2.0 / 21) + e * (1 - 2.0 / 21)) END, 4) AS last_ema FROM e""",
    "q_stream_bars": f"WITH {_EVENTS} SELECT symbol, ts, open, high, low, close, volume FROM bars",
    "q_bootstrap": f"{_TRADES}, {_boot(7)} SELECT symbol, {_R('pf', 'ci_lower', 'ci_upper', 'fraction_capped')}, n_trades, under_sampled FROM boot",
    "q_score": f"{_TRADES}, {_boot(7)}{_judged('bars', 2, 50)}",
    "q_evaluation": f"{_WALK.rpartition('SELECT keyed.symbol')[0]}, trades AS (SELECT keyed.symbol, t.* EXCLUDE (symbol) FROM trades_b t JOIN keyed ON k = t.symbol WHERE entry_ts >= CAST(test_start AS TIMESTAMP)), {_boot(0)}{_judged('bars0', 2, 0)}",
    "q_holdout_evaluation": f"{_HOLDOUT.rpartition('SELECT symbol, side')[0]}, trades AS (SELECT * FROM trades_h WHERE entry_ts >= TIMESTAMP '2001-01-01'), {_boot(0)}{_judged('(SELECT * FROM bars0 WHERE ts >= TIMESTAMP ' + chr(39) + '2001-01-01' + chr(39) + ')', 0, 0)}",
    "q_buy_and_hold": f"""WITH {DAILY_SQL}, x AS (SELECT symbol, 'long' AS side, 1 AS size, list(ts ORDER BY ts)[2] AS entry_ts, list(open ORDER BY ts)[2] + 0.01 AS entry_price, max(ts) AS exit_ts,
  arg_max(close, ts) - 0.01 AS exit_price, 'eod' AS exit_reason FROM bars GROUP BY 1 HAVING count(*) > 1),
trades AS (SELECT *, exit_price - entry_price AS pnl, (exit_price - entry_price) / entry_price AS pnl_pct, CAST(date_diff('minute', entry_ts, exit_ts) AS INT) AS duration_mins FROM x) SELECT {_TRADE_SELECT} FROM trades""",
    "q_dip_buyer": _dips(2, 10.0, 70.0, 50, 0.5, 10, False),
    "q_trailing_dip_buyer": _dips(8, 45.0, 89.0, 50, 0.5, 5, True),
    "q_opening_range": _opening(_CUSTOM_SELECT),
    "q_opening_momentum": _opening(_CUSTOM_SELECT, momentum=True, stop="midpoint", confirm=1, cutoff="15:00", timeout=6),
    "q_engine_activity": _opening("""SELECT symbol, count(*) AS n_bars, count(*) FILTER (held AND NOT closed_now) AS bars_in_position, CAST(sum(ordered) AS BIGINT) AS n_orders, count(*) FILTER (why IS NOT NULL) AS n_trades,
  max(longest) AS longest_window FROM (SELECT *, FALSE AS closed_now FROM run WHERE n > 0) JOIN (SELECT symbol, max(k) AS longest FROM (SELECT symbol, day, count(*) AS k FROM f GROUP BY 1, 2) GROUP BY 1) USING (symbol) GROUP BY 1"""),
    "q_session_gaps": f"""WITH {SESSION_SQL}, g AS (SELECT symbol, CAST(ts AS DATE) AS day, ts, lag(ts) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS p FROM bars)
SELECT symbol, CAST(day AS VARCHAR) AS day, count(*) AS n_bars, count(*) FILTER (date_diff('second', p, ts) > 600) AS n_gaps, count(*) FILTER (minute(ts) % 5 <> 0 OR second(ts) <> 0) AS n_unaligned FROM g GROUP BY symbol, g.day""",
    "q_violations": """WITH k AS (SELECT feed, time, count(*) AS n, sum(CASE WHEN open IS NULL OR open::VARCHAR = 'nan' OR high IS NULL OR high::VARCHAR = 'nan' OR low IS NULL OR low::VARCHAR = 'nan' OR close IS NULL OR close::VARCHAR = 'nan' THEN 1 ELSE 0 END) AS bad FROM bars_5m GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (time IS NULL), 0) AS BIGINT) AS n_without_time, CAST(coalesce(sum(n - 1) FILTER (time IS NOT NULL), 0) AS BIGINT) AS n_repeated, CAST(sum(bad) AS BIGINT) AS n_bad_prices FROM k""",
    "q_coverage_gaps": f"""WITH {DAILY_SQL}, c AS (SELECT symbol, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM bars GROUP BY 1)
SELECT symbol, '1994-06-01' AS gap_start, CAST(CAST(least(a, DATE '2002-02-01') - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS gap_end FROM c WHERE DATE '1994-06-01' < a
UNION ALL SELECT symbol, CAST(CAST(greatest(z + INTERVAL 1 DAY, DATE '1994-06-01') AS DATE) AS VARCHAR), '2002-01-31' FROM c WHERE DATE '2002-01-31' > z""",
    "q_merge": f"WITH {DAILY_SQL}, x AS (SELECT * REPLACE (CASE WHEN day(ts) <= 20 THEN close ELSE close + 1 END AS close) FROM bars) SELECT symbol, ts, {_OHLCV} FROM x",
    "q_splits": f"WITH {DAILY_SQL} SELECT symbol, count(*) AS n_bars, CASE WHEN ts < TIMESTAMP '2001-01-01' THEN 'train' ELSE 'holdout' END AS split FROM bars GROUP BY ALL",
}
