"""Measures of trades and equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running

CAP = 100.0


def profit_factor(pnl: str = "pnl", cap: float = CAP) -> Column:
    """Aggregate: gains over losses; ``cap`` without losses, 0 without trades or gains."""
    win = F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0))
    loss = F.coalesce(-F.sum(F.when(F.col(pnl) < 0, F.col(pnl))), F.lit(0.0))
    return F.when(loss > 0, win / F.nullif(loss, F.lit(0.0))).when(win > 0, cap).otherwise(0.0)


def equity_curve(bars: DataFrame, trades: DataFrame, keys: list[str], starting: float = 10_000.0, commission: float = 0.0) -> DataFrame:
    """Equity after each bar: capital, closed trades, and the open position at the close less one commission.

    A position that the end of the data closes is not marked again.  A trade meets
    only the bars of its own days, so the join is on series and day, whatever the length of a series.
    """
    b = bars.select(*keys, "ts", "close", F.to_date("ts").alias("day"))
    last = b.groupBy(*keys).agg(F.max("ts").alias("__last"))
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    t = trades.select(*keys, "entry_ts", "exit_ts", "entry_price", "size", side.alias("sign"), "pnl", "exit_reason").join(last, keys, "left")
    open_end = (F.col("exit_reason") == "eod") & (F.col("exit_ts") == F.col("__last"))
    t = t.withColumn("open_end", open_end)
    held = t.select("*", F.explode(F.sequence(F.to_date("entry_ts"), F.to_date("exit_ts"))).alias("day"))
    marked = b.join(held, [*keys, "day"]).where("ts >= entry_ts and (ts < exit_ts or (open_end and ts = exit_ts))")
    marked = marked.select(*keys, "ts", ((F.col("close") - F.col("entry_price")) * F.col("size") * F.col("sign") - commission).alias("unrealised"))
    marked = marked.groupBy(*keys, "ts").agg(F.sum("unrealised").alias("unrealised"))
    closed = t.where("not open_end").groupBy(*keys, F.col("exit_ts").alias("ts")).agg(F.sum("pnl").alias("realised"))
    d = b.join(closed, [*keys, "ts"], "left").join(marked, [*keys, "ts"], "left")
    d = running(d, keys, "day", ["ts"], F.coalesce("realised", F.lit(0.0)), "cash")
    return d.select(*keys, "ts", "day", (F.lit(starting) + F.col("cash") + F.coalesce("unrealised", F.lit(0.0))).alias("equity"))


def drawdown(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fall below the running peak, in money and as a share."""
    d = running(equity, keys, "day", ["ts"], F.col("equity"), "peak", "max")
    gap = F.col("equity") - F.col("peak")
    return d.groupBy(*keys).agg(F.min(gap).alias("max_drawdown_dollar"), F.min(gap / F.nullif("peak", F.lit(0.0))).alias("max_drawdown_pct"))


def sharpe(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over sample deviation of daily returns, times the root of 252; 0 for fewer than two days or no deviation, NaN for one return."""
    days = equity.groupBy(*keys, "day").agg(F.max_by("equity", "ts").alias("e"))
    before = F.lag("e").over(Window.partitionBy(*keys).orderBy("day"))
    r = days.select(*keys, (F.col("e") / F.nullif(before, F.lit(0.0)) - 1).alias("r"))
    out = r.groupBy(*keys).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    value = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, float("nan")).when(F.col("s") == 0, 0.0).otherwise(F.col("m") / F.nullif("s", F.lit(0.0)) * F.sqrt(F.lit(252.0)))
    return out.select(*keys, value.alias("sharpe_ratio"))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates and sums of trades; a loss is a trade that gains nothing; no losses make an infinite profit factor."""
    pnl, win, loss = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") <= 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gross = lambda cond: zero(F.sum(F.when(cond, pnl)))
    d = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.avg(win.cast("double")).alias("win_rate"), gross(win).alias("gross_win"), gross(loss).alias("gross_loss"),
        zero(F.avg(F.when(win, pnl))).alias("avg_win"), zero(F.avg(F.when(loss, pnl))).alias("avg_loss"), F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_trade"), F.avg("duration_mins").alias("avg_duration_mins"),
    )
    pf = F.when(F.col("gross_loss") < 0, F.col("gross_win") / -F.nullif("gross_loss", F.lit(0.0))).otherwise(float("inf"))
    return d.withColumn("profit_factor", pf)


def metrics(bars: DataFrame, trades: DataFrame, keys: list[str], starting: float = 10_000.0, commission: float = 0.0) -> DataFrame:
    """All measures of each series; zeros, and the capital, for series without trades."""
    eq = equity_curve(bars, trades, keys, starting, commission)
    end = eq.groupBy(*keys).agg(F.max_by("equity", "ts").alias("ending_capital"))
    d = end.join(trade_metrics(trades, keys), keys, "left").join(drawdown(eq, keys), keys, "left").join(sharpe(eq, keys), keys, "left")
    some = F.col("total_trades").isNotNull()
    names = ["win_rate", "profit_factor", "total_pnl", "gross_win", "gross_loss", "avg_win", "avg_loss", "avg_trade", "max_drawdown_dollar", "max_drawdown_pct", "avg_duration_mins", "sharpe_ratio"]
    return d.select(
        *keys, F.coalesce("total_trades", F.lit(0)).alias("total_trades"), *[F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in names],
        F.lit(starting).alias("starting_capital"), F.when(some, F.col("ending_capital")).otherwise(starting).alias("ending_capital"),
    )


def pooled(m: DataFrame) -> DataFrame:
    """One row over all series: trades, wins, money and the pooled profit factor."""
    win, loss = F.sum("gross_win"), F.sum("gross_loss")
    return m.agg(
        F.sum("total_trades").alias("total_trades"), F.sum(F.round(F.col("win_rate") * F.col("total_trades"))).cast("long").alias("wins"),
        F.sum("total_pnl").alias("total_pnl"), F.when(loss < 0, win / -F.nullif(loss, F.lit(0.0))).otherwise(float("inf")).alias("profit_factor"),
    )
