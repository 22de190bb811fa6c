"""Breakouts of a session's opening range, as an automaton over all sessions at once.

Sessions are the columns of arrays: step t of the automaton takes bar t of every session that has one.  An order of a session's
last bar would fill in the next session, which is possible only where a session ends before the cutoff; such sessions
are chained to the next.  No symbol is gathered: a task works on (symbol, chain).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.backtest import BacktestConfig, finish_trades
from tidemark.operators.custom import Declared, Parameter
from tidemark.operators.grouped_stream import whole_groups
from tidemark.operators.prefix import running

#: Phases of a session.
FIRST, BREAK, EDGE, HELD, OVER = range(5)
LABELS = np.array(["short_retest", "long_retest", "short_momentum", "long_momentum"], dtype=object)
REASONS = np.array(["stop", "target", "eod"], dtype=object)
ROWS = "symbol string, kind int, side int, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, level double, reason string, label string, n_bars long, n_held long, n_orders long, longest long"


@dataclass
class _Book:
    """What the automaton knows of each session, and the trades it has closed."""

    n: int
    closed: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        whole, real = (lambda: np.zeros(self.n, np.int64)), (lambda: np.zeros(self.n))
        self.phase, self.top, self.floor = whole(), real(), real()
        self.trend, self.beyond, self.waits = whole(), whole(), whole()  # side of the breakout, closes beyond, bars waited for a retest
        self.order, self.order_label, self.order_stop, self.order_target = whole(), whole(), real(), real()
        self.side, self.label, self.stop, self.target = whole(), whole(), real(), real()
        self.entry_row, self.n_held, self.n_orders = whole(), whole(), whole()

    def leave(self, who: np.ndarray, rows: np.ndarray, level: np.ndarray, reason: int, again: bool) -> None:
        """Close the positions of ``who`` (indices); a session with a breakout is armed again, if that is wanted."""
        if len(who):
            self.closed.append((self.entry_row[who], rows, self.side[who], level, np.full(len(who), reason), self.label[who]))
            self.side[who] = 0
            self.phase[who] = np.where((self.trend[who] != 0) & again, EDGE, OVER)
            self.waits[who] = 0


class OpeningRange(Declared):
    """The first bar's range; ``confirm_bars`` closes beyond it in a row confirm a breakout; entry on a bar that touches the edge and closes beyond it.

    The stop lies at the other edge, in the middle, at a fixed distance or share of the close; the target at ``rr_ratio`` times
    the risk.  No entry from ``cutoff`` on, or after ``retest_timeout`` bars of waiting.  With ``momentum`` a close far beyond the
    edge is an entry too, and with ``again`` the session waits for another retest after a trade.  Positions end at ``eod_exit``.
    """

    timeframes = ("5m",)
    parameters = {
        "stop_mode": Parameter("opposite_bracket", allowed=("opposite_bracket", "midpoint", "fixed_dollar", "pct_move")), "stop_value": Parameter(0.5, 0.0),
        "rr_ratio": Parameter(2.0, 0.1, 10), "cutoff": Parameter("11:00"), "eod_exit": Parameter("15:50"), "confirm_bars": Parameter(2, 1, 20),
        "retest_timeout": Parameter(12, 1), "again": Parameter(True), "momentum": Parameter(False), "momentum_distance": Parameter(0.5, 0.0),
    }

    def _minutes(self, name: str) -> int:
        at = dt.time.fromisoformat(self.p[name])
        return at.hour * 60 + at.minute

    def _watch(self, k: _Book, who: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, late: np.ndarray) -> None:
        """What the sessions ``who`` make of their bar, after fills and exits."""
        p, phase = self.p, k.phase[who]
        new = who[phase == FIRST]
        k.top[new], k.floor[new] = high[phase == FIRST], low[phase == FIRST]
        waiting = (phase == BREAK) | (phase == EDGE)
        k.phase[who[waiting & late]] = OVER

        at = (phase == BREAK) & ~late
        some, c = who[at], close[at]
        side = (c > k.top[some]).astype(np.int64) - (c < k.floor[some])
        k.beyond[some] = np.where(side == 0, 0, np.where(side == k.trend[some], k.beyond[some] + 1, 1))
        k.trend[some] = side
        sure = some[k.beyond[some] >= p["confirm_bars"]]
        k.phase[sure], k.waits[sure] = EDGE, 0

        at = (phase == EDGE) & ~late
        some, h, lo, c = who[at], high[at], low[at], close[at]
        tired = k.waits[some] >= p["retest_timeout"]
        k.phase[some[tired]] = OVER
        some, h, lo, c = some[~tired], h[~tired], lo[~tired], c[~tired]
        k.waits[some] += 1
        up = k.trend[some] > 0
        past = np.where(up, c - k.top[some], k.floor[some] - c)
        touched = np.where(up, lo <= k.top[some], h >= k.floor[some]) & (past > 0)
        fast = ~touched & p["momentum"] & (past >= p["momentum_distance"] * (k.top[some] - k.floor[some]))
        enter = touched | fast
        some, c, up, fast = some[enter], c[enter], up[enter], fast[enter]
        sign = np.where(up, 1, -1)
        far = {
            "opposite_bracket": np.where(up, k.floor[some], k.top[some]), "midpoint": (k.top[some] + k.floor[some]) / 2,
            "fixed_dollar": c - sign * p["stop_value"], "pct_move": c * (1 - sign * p["stop_value"]),
        }[p["stop_mode"]]
        risk = np.abs(c - far)
        k.phase[some] = np.where(risk > 0, HELD, OVER)
        k.n_orders[some[risk > 0]] += 1
        free = (risk > 0) & (k.side[some] == 0)
        placed = some[free]
        k.order[placed], k.order_stop[placed] = sign[free], far[free]
        k.order_target[placed] = c[free] + sign[free] * risk[free] * p["rr_ratio"]
        k.order_label[placed] = up[free] + 2 * fast[free]
        k.phase[new] = BREAK

    def fold(self, tbl: pa.Table, config: BacktestConfig) -> pa.Table | None:
        """Trades (kind 0) and activity (kind 1) of complete chains, sorted by chain and time."""
        key = tbl.column("__chain").to_numpy()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        open_, high, low, close = (tbl.column(c).to_numpy() for c in ("open", "high", "low", "close"))
        day, minute = tbl.column("__day").to_numpy(), tbl.column("__minute").to_numpy()
        late, ending = minute >= self._minutes("cutoff"), minute >= self._minutes("eod_exit")
        again, k = self.p["again"], _Book(len(start))
        order = np.argsort(-length, kind="stable")  # longest first: those that still run are a prefix
        for t in range(int(length.max())):
            who = order[: np.searchsorted(-length[order], -t, side="left")]
            row = start[who] + t
            if t:
                turn = day[row] != day[row - 1]
                gone = who[turn & (k.side[who] != 0)]
                k.order[gone] = 0
                k.leave(gone, row[turn & (k.side[who] != 0)] - 1, close[row[turn & (k.side[who] != 0)] - 1], 2, again)
                fresh = who[turn]
                for x in (k.phase, k.trend, k.beyond, k.waits):
                    x[fresh] = 0
            fill = (k.order[who] != 0) & (k.side[who] == 0)
            some = who[fill]
            k.side[some], k.label[some], k.stop[some], k.target[some] = k.order[some], k.order_label[some], k.order_stop[some], k.order_target[some]
            k.entry_row[some], k.order[some] = row[fill], 0
            s = k.side[who]
            stopped = ((s > 0) & (low[row] <= k.stop[who])) | ((s < 0) & (high[row] >= k.stop[who]))
            reached = ~stopped & (((s > 0) & (high[row] >= k.target[who])) | ((s < 0) & (low[row] <= k.target[who])))
            k.leave(who[stopped], row[stopped], k.stop[who[stopped]], 0, again)
            k.leave(who[reached], row[reached], k.target[who[reached]], 1, again)
            end = (k.side[who] != 0) & ending[row]
            k.order[who[end]] = 0
            k.leave(who[end], row[end], close[row[end]], 2, again)
            self._watch(k, who, high[row], low[row], close[row], late[row])
            k.n_held[who] += k.side[who] != 0
        left = np.flatnonzero(k.side != 0)
        last = start + length - 1
        k.leave(left, last[left], close[last[left]], 2, again)
        cols = [np.concatenate(c) for c in zip(*k.closed)] if k.closed else [np.empty(0, np.int64)] * 6
        entry, out, side, level, reason, label = (np.asarray(c) for c in cols)
        entry, out, label, reason = (x.astype(np.int64) for x in (entry, out, label, reason))
        n, m = len(entry), len(start)
        both = pa.array(np.r_[entry, start].astype(np.int64))
        at_end = pa.array(np.r_[out, last].astype(np.int64))
        session = np.diff(np.r_[np.flatnonzero(np.r_[True, (day[1:] != day[:-1]) | (key[1:] != key[:-1])]), len(day)])
        first_of = np.r_[True, (day[1:] != day[:-1]) | (key[1:] != key[:-1])]
        longest = np.maximum.reduceat(session, np.searchsorted(np.flatnonzero(first_of), start))
        none = np.zeros(n, np.int64)
        sign = np.r_[side, np.zeros(m)].astype(np.int64)
        return pa.table(
            {
                "symbol": tbl.column("symbol").take(both), "kind": np.r_[none, np.ones(m)].astype(np.int32), "side": sign.astype(np.int32),
                "entry_ts": tbl.column("ts").take(both), "entry_price": np.r_[open_[entry], np.zeros(m)] + sign * config.slippage,
                "exit_ts": tbl.column("ts").take(at_end), "level": np.r_[level.astype(float), np.zeros(m)],
                "reason": pa.array([*REASONS[reason].tolist(), *[None] * m], pa.string()), "label": pa.array([*LABELS[label].tolist(), *[None] * m], pa.string()),
                "n_bars": np.r_[none, length], "n_held": np.r_[none, k.n_held], "n_orders": np.r_[none, k.n_orders], "longest": np.r_[none, longest].astype(np.int64),
            }
        )

    def run(self, bars: DataFrame, config: BacktestConfig) -> DataFrame:
        """Trades and activity of every chain of sessions, as rows of ``ROWS``.

        bars: symbol, ts (unique in a symbol), open, high, low, close.  Bars of null prices meet no condition; null symbols
        are one series; no bars give no rows.
        """
        d = bars.select(
            "symbol", "ts", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("open", "high", "low", "close")],
            F.unix_date(F.to_date("ts")).cast("long").alias("__day"), (F.hour("ts") * 60 + F.minute("ts")).cast("int").alias("__minute"),
        )
        days = d.groupBy("symbol", "__day").agg(F.max("__minute").alias("__end")).withColumn("__month", F.floor(F.col("__day") / 32))
        before = F.lag("__end").over(Window.partitionBy("symbol").orderBy("__day"))  # one row a session
        days = days.withColumn("__new", F.coalesce(before >= self._minutes("cutoff"), F.lit(True)).cast("long"))
        days = running(days, ["symbol"], "__month", ["__day"], F.col("__new"), "__no")
        a, b = d.alias("a"), days.alias("b")
        d = a.join(b, F.col("a.symbol").eqNullSafe(F.col("b.symbol")) & (F.col("a.__day") == F.col("b.__day"))).select("a.*", F.xxhash64("a.symbol", "b.__no").alias("__chain"))

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return whole_groups(iter(batches), "__chain", lambda t: self.fold(t, config))

        return d.repartition("__chain").sortWithinPartitions("__chain", "symbol", "ts").mapInArrow(work, ROWS)

    def trades(self, bars: DataFrame, config: BacktestConfig) -> DataFrame:
        sign = F.col("side")
        free = F.lit(not config.realistic_fills) & F.col("reason").isin("stop", "target")
        t = self.run(bars, config).where("kind = 0").select(
            "symbol", F.when(sign > 0, "long").otherwise("short").alias("side"), F.lit(config.size).alias("size"), "entry_ts", "entry_price", "exit_ts",
            (F.col("level") - F.when(free, 0.0).otherwise(sign * config.slippage)).alias("exit_price"), F.col("reason").alias("exit_reason"), F.col("label").alias("signal_label"),
        )
        return finish_trades(t, config)

    def activity(self, bars: DataFrame, config: BacktestConfig) -> DataFrame:
        """Per symbol: bars, bars with a position, orders, trades, and the longest history that a session gave."""
        count = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0))
        return self.run(bars, config).groupBy("symbol").agg(
            count(1, F.col("n_bars")).alias("n_bars"), count(1, F.col("n_held")).alias("bars_in_position"), count(1, F.col("n_orders")).alias("n_orders"),
            count(0, F.lit(1)).cast("long").alias("n_trades"), F.max("longest").alias("longest_window"),
        )
