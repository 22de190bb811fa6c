"""Walk-forward evaluation of signal strategies: windows, grids, best parameters, out-of-sample trades."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.functions.indicators import add_indicators, over_long_series
from tidemark.operators.backtest import BacktestConfig, backtest_signals
from tidemark.operators.metrics import profit_factor
from tidemark.session import cut


@dataclass(frozen=True)
class WalkForwardConfig:
    train_months: int = 24
    test_months: int = 6
    step_months: int = 6
    min_trades: int = 30
    warmup_bars: int = 200


def windows(bars: DataFrame, config: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """(symbol, window_id, train_start, test_start, test_end), the starts anchored at first days of months.

    The first window starts on the symbol's first day if that is the first of a month, else on
    the next first; a window is there if its test ends by the month after the last bar.
    """
    span = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.add_months(F.trunc(F.to_date(F.max("ts")), "MM"), 1).alias("z"))
    span = span.withColumn("a", F.when(F.dayofmonth("a") == 1, F.col("a")).otherwise(F.add_months(F.trunc("a", "MM"), 1)))
    last = F.add_months("z", -(config.train_months + config.test_months))
    starts = F.when(last >= F.col("a"), F.expr(f"sequence(a, add_months(z, -{config.train_months + config.test_months}), interval {config.step_months} month)"))
    w = span.select("symbol", F.posexplode(starts).alias("window_id", "train_start"))
    test = F.add_months("train_start", config.train_months)
    return w.select("symbol", "window_id", "train_start", test.alias("test_start"), F.add_months(test, config.test_months).alias("test_end"))


def last_before(bars: DataFrame, at: DataFrame, n: int) -> DataFrame:
    """The last n bars of a symbol before each of its days ``at.day`` (columns of at, without symbol and day, are added).

    The days that hold them are found from counts per day; only their bars are ranked.
    """
    keys = [c for c in at.columns if c != "day"]
    b = bars.withColumn("__day", F.to_date("ts"))
    days = b.groupBy("symbol", "__day").agg(F.count("*").alias("__n")).join(at, "symbol").where(F.col("__day") < F.col("day"))
    back = Window.partitionBy(*keys).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("__upto", F.sum("__n").over(back)).where(F.col("__upto") - F.col("__n") < n)
    near = b.join(days.select(*keys, "__day"), ["symbol", "__day"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank", "__day")


def slices(bars: DataFrame, wins: DataFrame, config: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """The bars of every window's train and test run (role), the test with warm-up bars before it.

    Windows begin and end with months, so bars meet their windows by symbol and month, and no symbol is one task.
    Windows without bars in either part are left out.
    """
    months = F.explode(F.sequence("train_start", F.add_months("test_end", -1), F.expr("interval 1 month"))).alias("__month")
    by_month = wins.select("*", months)
    d = bars.withColumn("__month", F.trunc(F.to_date("ts"), "MM")).join(by_month, ["symbol", "__month"])
    d = d.withColumn("role", F.when(F.col("__month") < F.col("test_start"), "train").otherwise("test"))
    warm = last_before(bars, wins.withColumn("day", F.col("test_start")), config.warmup_bars).withColumn("role", F.lit("test"))
    both = d.groupBy("symbol", "window_id").agg(F.count_distinct("role").alias("n")).where("n = 2")
    cols = ["symbol", "window_id", "train_start", "test_start", "test_end", *[c for c in bars.columns if c != "symbol"], "role"]
    return d.select(*cols).unionByName(warm.select(*cols)).join(both, ["symbol", "window_id"], "left_semi")


def grid_points(grid: dict[str, list[Any]] | None) -> list[dict[str, Any]]:
    """All combinations, in order; one empty point without a grid."""
    names = list(grid or {})
    return [dict(zip(names, v)) for v in itertools.product(*(grid or {}).values())]


def _params(spec: dsl.Spec, points: list[dict[str, Any]]) -> Column:
    """Array of (grid_id, p_<name>...) structs; a literal, so that no join is needed."""
    names = sorted(spec.defaults)
    full = [spec.defaults | p for p in points]
    return F.array(*[F.struct(F.lit(i).alias("grid_id"), *[F.lit(float(p[n])).alias(f"p_{n}") for n in names]) for i, p in enumerate(full)])


def walk_forward(
    bars: DataFrame, spec: dsl.Spec, grid: dict[str, list[Any]] | None = None, config: WalkForwardConfig = WalkForwardConfig(), backtest: BacktestConfig = BacktestConfig()
) -> tuple[DataFrame, DataFrame]:
    """(one row per symbol and window, out-of-sample trades).

    Indicators are computed once per slice and serve all grid points; all symbols, windows and points
    run in parallel.  The best point has the highest profit factor among those with enough trades,
    ties going to the higher profit and then to the earlier point; where none is eligible the
    defaults are used.  Warm-up bars are traded, but only trades entered from test_start on count.
    """
    points = grid_points(grid)
    names = [f"p_{n}" for n in sorted(spec.defaults)]
    own = ["symbol", "window_id", "role"]
    series = [*own, "session"] if backtest.sessions else own
    sl = slices(bars, windows(bars, config), config)
    sl = sl.withColumn("session", F.to_date("ts")) if backtest.sessions else sl
    ready = add_indicators(sl, series, spec.indicators) if backtest.sessions else over_long_series(sl, spec.indicators, keys=series)
    sl = cut(ready)  # read by the train runs, the test runs and the report
    ps = _params(spec, points)
    flags = dsl.signals(spec, {n.removeprefix("p_"): F.col(n) for n in names})
    flagged = lambda d: d.select("*", *[c.alias(n) for n, c in flags.items()])

    train = sl.where("role = 'train'").withColumn("__p", F.explode(ps)).select("*", "__p.*")
    keys = ["symbol", "window_id", "grid_id"]
    trades = backtest_signals(flagged(train), keys, backtest)
    n_or_pf = trades.groupBy(*keys).agg(profit_factor().alias("pf"), F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    if grid is None:
        eligible = n_or_pf
    else:
        eligible = n_or_pf.where(F.col("n") >= config.min_trades)
    best = eligible.groupBy("symbol", "window_id").agg(F.max(F.struct("pf", "pnl", (-F.col("grid_id")).alias("back"), "n")).alias("b"))
    best = best.select("symbol", "window_id", (-F.col("b.back")).alias("grid_id"), F.col("b.pf").alias("train_pf"), F.col("b.n").alias("train_n_trades"))
    wins = sl.select("symbol", "window_id", "train_start", "test_start", "test_end").distinct()
    chosen = cut(wins.join(best, ["symbol", "window_id"], "left"))

    # the chosen point's values, or the defaults where none was eligible
    all_points = _params(spec, [*points, {}])
    at = F.coalesce(F.col("grid_id"), F.lit(len(points)))
    chosen = chosen.withColumn("__p", F.element_at(all_points, at + 1)).select(
        *wins.columns, "grid_id", F.coalesce("train_pf", F.lit(0.0)).alias("train_pf"), F.coalesce("train_n_trades", F.lit(0)).alias("train_n_trades"), *[F.col(f"__p.{n}").alias(n) for n in names]
    )
    test = sl.where("role = 'test'").join(chosen.select("symbol", "window_id", *names), ["symbol", "window_id"])
    oos = backtest_signals(flagged(test), ["symbol", "window_id"], backtest)
    oos = oos.join(wins.select("symbol", "window_id", "test_start"), ["symbol", "window_id"]).where(F.col("entry_ts") >= F.col("test_start").cast("timestamp_ntz")).drop("test_start")
    oos = cut(oos)
    pf = oos.groupBy("symbol", "window_id").agg(profit_factor().alias("test_pf"), F.count("*").alias("test_n_trades"))
    report = chosen.join(pf, ["symbol", "window_id"], "left").select(
        *chosen.columns, F.coalesce("test_pf", F.lit(0.0)).alias("test_pf"), F.coalesce("test_n_trades", F.lit(0)).alias("test_n_trades")
    )
    return report, oos


def holdout_run(bars: DataFrame, boundary: Any, spec: dsl.Spec, backtest: BacktestConfig = BacktestConfig(), warmup_bars: int = 200) -> DataFrame:
    """Trades entered from ``boundary`` on, with default parameters and warm-up bars before it."""
    b = F.lit(boundary).cast("timestamp_ntz")
    at = bars.select("symbol").distinct().withColumn("day", F.to_date(b))
    day = F.to_date(b).cast("timestamp_ntz")  # bars of the boundary's own day before it warm up, too
    early = bars.where((F.col("ts") >= day) & (F.col("ts") < b))
    d = last_before(bars, at, warmup_bars).unionByName(early).unionByName(bars.where(F.col("ts") >= b))
    keys = ["symbol"]
    if backtest.sessions:
        d = d.withColumn("session", F.to_date("ts"))
    d = add_indicators(d, [*keys, "session"], spec.indicators) if backtest.sessions else over_long_series(cut(d), spec.indicators, keys=keys)
    flags = dsl.signals(spec)
    return backtest_signals(d.select("*", *[c.alias(n) for n, c in flags.items()]), keys, backtest).where(F.col("entry_ts") >= b)
