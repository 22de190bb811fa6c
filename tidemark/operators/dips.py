"""Buying dips with a bracket: signals as columns, the outcome of every possible entry, and a choice of those that do not overlap.

A position lasts ``max_bars`` bars at most, so what an entry would earn depends on its own bar and a few bars after
it.  The outcomes of all entries are worked out side by side, as expressions; only which of them are taken
depends on earlier ones, and that is settled within clusters of overlapping entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import Indicator, over_long_series
from tidemark.operators.backtest import BacktestConfig, finish_trades
from tidemark.operators.custom import Declared, Parameter
from tidemark.operators.prefix import previous, running, with_halo
from tidemark.session import cut


class DipBuyer(Declared):
    """Long when a short RSI is below ``oversold`` and the close above its average over ``trend_len``.

    Left when the RSI has crossed above ``rsi_exit``, with bar number ``max_bars``, or at a stop ``atr_mult`` average true ranges
    below the close of the signal; with ``trailing`` the stop rises with the highest high since then, and never falls.
    """

    timeframes = ("1d",)
    parameters = {
        "rsi_len": Parameter(2, 1, 50), "oversold": Parameter(10.0, 1, 50), "rsi_exit": Parameter(70.0, 20, 99), "use_trend": Parameter(True),
        "trend_len": Parameter(200, 2, 400), "trend_type": Parameter("sma", allowed=("sma", "ema")), "atr_mult": Parameter(2.5, 0.1, 10),
        "atr_len": Parameter(14, 1, 100), "max_bars": Parameter(10, 1, 100), "trailing": Parameter(False),
    }

    def ready(self, bars: DataFrame, rows: int) -> DataFrame:
        """The bars (of one column ``symbol`` as key) with enter, stop, recovered and the average true range ``range``."""
        p = self.p
        declared = [Indicator("osc", "rsi", {"period": p["rsi_len"]}), Indicator("range", "atr", {"period": p["atr_len"]})]
        if p["use_trend"]:
            declared.append(Indicator("trend", p["trend_type"], {"period": p["trend_len"]}))
        keep = max(p["trend_len"], p["atr_len"] + 1, p["rsi_len"] + 1) + 5
        d = over_long_series(bars, declared, rows=rows, buffer=keep).withColumn("day", F.to_date("ts"))
        d = previous(d, ["symbol"], "day", [F.col("ts")], {"osc": "osc_before"})
        stop = F.col("close") - p["atr_mult"] * F.col("range")
        low = (F.col("osc") < p["oversold"]) & (stop > 0)
        above = F.col("close") > F.col("trend") if p["use_trend"] else F.lit(True)
        crossed = (F.col("osc") > p["rsi_exit"]) & (F.col("osc_before").isNull() | (F.col("osc_before") <= p["rsi_exit"]))
        false = lambda c: F.coalesce(c, F.lit(False))
        return d.select("symbol", "day", "ts", "open", "high", "low", "close", "range", stop.alias("stop"), false(low & above).alias("enter"), false(crossed).alias("recovered"))

    def _outcome(self, bars_after: Column) -> Column:
        """How a position entered at the first of these bars ends: the bar, the level and the reason; null reason while it is open."""
        p = self.p
        start = F.struct(F.lit(0).alias("age"), F.col("stop").alias("stop"), F.col("high").alias("peak"), F.lit(None).cast("string").alias("reason"))

        def bar(a: Column, b: Column) -> Column:
            open_, stopped = a["reason"].isNull(), b["low"] <= a["stop"]
            peak = F.greatest(a["peak"], b["high"])
            raised = F.greatest(a["stop"], peak - p["atr_mult"] * b["range"]) if p["trailing"] else a["stop"]
            left = b["recovered"] | (a["age"] + 1 >= p["max_bars"])
            held = F.struct((a["age"] + 1).alias("age"), raised.alias("stop"), peak.alias("peak"), F.when(left, "signal").alias("reason"))
            out = F.struct((a["age"] + 1).alias("age"), a["stop"].alias("stop"), a["peak"].alias("peak"), F.lit("stop").alias("reason"))
            return F.when(~open_, a).when(stopped, out).otherwise(held)

        return F.aggregate(bars_after, start, bar)

    def trades(self, bars: DataFrame, config: BacktestConfig, *, rows: int = 50_000) -> DataFrame:
        """Trades per symbol; times must be unique in a symbol.  Null prices never meet a condition; no bars give no trades."""
        m = self.p["max_bars"]
        d = cut(self.ready(cut(bars), rows)).withColumn("back", -F.unix_date("day"))
        d = with_halo(d, ["symbol"], "back", rows, m + 1)  # halos of later days
        series = Window.partitionBy("symbol", "chunk").orderBy("ts")
        after = F.collect_list(F.struct("ts", "open", "low", "high", "close", "recovered", "range")).over(series.rowsBetween(1, m))
        d = d.withColumn("after", F.when(F.col("enter"), after)).where("enter and not is_halo and size(after) > 0")
        d = d.withColumn("o", self._outcome(F.col("after"))).withColumn("last", F.element_at("after", F.col("o.age")))
        reason = F.coalesce("o.reason", F.lit("eod"))
        d = d.select("symbol", "day", "ts", F.col("after")[0]["ts"].alias("entry_ts"), F.col("after")[0]["open"].alias("entry_open"), F.col("last.ts").alias("exit_ts"), reason.alias("reason"),
                     F.when(reason == "stop", F.col("o.stop")).otherwise(F.col("last.close")).alias("level"))
        taken = _apart(cut(d))
        free = F.lit(not config.realistic_fills) & (F.col("reason") == "stop")
        t = taken.select(
            "symbol", F.lit("long").alias("side"), F.lit(config.size).alias("size"), "entry_ts", (F.col("entry_open") + config.slippage).alias("entry_price"), "exit_ts",
            (F.col("level") - F.when(free, 0.0).otherwise(config.slippage)).alias("exit_price"), F.col("reason").alias("exit_reason"), F.lit("dip").alias("signal_label"),
        )
        return finish_trades(t, config)


def trailing_dip_buyer(**given: Any) -> DipBuyer:
    """The variant with RSI(8) and a trailing stop of two average true ranges."""
    return DipBuyer(**({"rsi_len": 8, "oversold": 30.0, "rsi_exit": 89.0, "atr_mult": 2.0, "max_bars": 5, "trailing": True} | given))


def _apart(entries: DataFrame) -> DataFrame:
    """The entries that are taken when one position is held at a time.

    After an exit at the close, signals count from the next bar on, and after a stop from the same bar on.  An entry that no
    earlier one, taken or not, could reach begins a cluster; clusters are settled apart, in the order of time.
    """
    free_from = F.struct(F.col("exit_ts"), (F.col("reason") != "stop").cast("int").alias("after"))
    d = entries.withColumn("until", free_from)
    d = running(d, ["symbol"], "day", ["ts"], F.col("until"), "reach", "max")
    d = previous(d, ["symbol"], "day", [F.col("ts")], {"reach": "reached"})
    fresh = F.col("reached").isNull() | (F.struct(F.col("ts").alias("exit_ts"), F.lit(0).alias("after")) >= F.col("reached"))
    d = running(d, ["symbol"], "day", ["ts"], F.coalesce(fresh, F.lit(True)).cast("long"), "cluster").drop("reach", "reached")
    cols = ["symbol", "ts", "entry_ts", "entry_open", "exit_ts", "reason", "level"]
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until = None, None
        for b in batches:
            keys = zip(b.column("symbol").to_pylist(), b.column("cluster").to_pylist())
            keep = []
            for i, (key, ts, end, why) in enumerate(zip(keys, b.column("ts").to_pylist(), b.column("exit_ts").to_pylist(), b.column("reason").to_pylist())):
                if key != now:
                    now, until = key, None
                if until is None or (ts, 0) >= until:
                    keep.append(i)
                    until = (end, int(why != "stop"))
            if keep:
                yield b.select(cols).take(pa.array(keep))

    d = d.select(*cols, "cluster").repartition("symbol", "cluster").sortWithinPartitions("symbol", "cluster", "ts")
    return d.mapInArrow(settle, ", ".join(f"{c} {kinds[c]}" for c in cols))
