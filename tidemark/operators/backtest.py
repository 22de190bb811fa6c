"""Backtests: signal strategies as a finite automaton over parts of a series, custom ones as a streamed fold.

A signal strategy has no price-dependent exits, so its state on a bar is one of five
(flat, entry pending long or short, in a long or short position) and a bar maps states to
states.  Each part of a series (a session, or a day of a round-the-clock series) is run for all five
incoming states at once; the parts' maps are then composed in order, one small row per
part, and only the events of the true incoming state are kept.  No series, however long, is
gathered in one task, and parts of a hot symbol run in parallel.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.operators.grouped_stream import whole_groups
from tidemark.operators.prefix import previous
from tidemark.schema import SESSION_END
from tidemark.session import cut

FLAT, PENDING_LONG, PENDING_SHORT, LONG, SHORT = range(5)
EVENTS = "kind int, part long, mask int, seq int, ts timestamp_ntz, side int, price double, reason string, next0 int, next1 int, next2 int, next3 int, next4 int"


@dataclass(frozen=True)
class BacktestConfig:
    starting_capital: float = 10_000.0
    commission: float = 0.0
    slippage: float = 0.01
    realistic_fills: bool = True
    size: int = 1
    #: intraday bars end their positions with the session; others run through
    sessions: bool = True
    #: days in a part of a series without sessions: 1 for intraday bars, more for daily ones
    part_days: int = 1


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _fold_parts(tbl: pa.Table, keys: list[str], sessions: bool) -> pa.Table | None:
    """Events and state maps of complete parts, sorted by part and time; kind 0 is an entry, 1 an exit, 2 the map."""
    part = tbl.column("__part").to_numpy()
    g = np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1
    n = int(g[-1]) + 1
    start = np.searchsorted(g, np.arange(n))
    length = np.diff(np.r_[start, len(g)])
    flag = {c: tbl.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("el", "es", "xl", "xs", "eod")}
    state = np.tile(np.arange(5, dtype=np.int8), (n, 1))
    bits = 1 << np.arange(5)
    events: list[tuple[np.ndarray, ...]] = []  # row, kind, side, reason, mask

    def emit(rows: np.ndarray, hit: np.ndarray, kind: int, side: int, reason: int) -> None:
        some = hit.any(1)
        if some.any():
            k = int(some.sum())
            events.append((rows[some], np.full(k, kind), np.full(k, side), np.full(k, reason), (hit[some] * bits).sum(1)))

    order = np.argsort(-length, kind="stable")  # longest first: those that still run are a prefix
    sorted_length = length[order]
    for t in range(int(sorted_length[0])):
        live = order[: np.searchsorted(-sorted_length, -t, side="left")]
        rows = start[live] + t
        s = state[live]
        for pending, held, side in ((PENDING_LONG, LONG, 1), (PENDING_SHORT, SHORT, -1)):
            hit = s == pending
            emit(rows, hit, 0, side, 0)
            s[hit] = held
        if sessions:
            for held, side in ((LONG, 1), (SHORT, -1)):
                hit = (s == held) & flag["eod"][rows][:, None]
                emit(rows, hit, 1, side, 1)
                s[hit] = FLAT
        flat = s == FLAT
        for held, side, x in ((LONG, 1, "xl"), (SHORT, -1, "xs")):
            hit = (s == held) & flag[x][rows][:, None]
            emit(rows, hit, 1, side, 2)
            s[hit] = FLAT
        s[flat & flag["el"][rows][:, None]] = PENDING_LONG
        s[flat & ~flag["el"][rows][:, None] & flag["es"][rows][:, None]] = PENDING_SHORT
        state[live] = s
    last = start + length - 1
    if sessions:
        for held, side in ((LONG, 1), (SHORT, -1)):
            hit = state == held
            emit(last, hit, 1, side, 1)
            state[hit] = FLAT
    cols = [np.concatenate(c) for c in zip(*events)] if events else [np.empty(0, np.int64)] * 5
    row = np.concatenate([cols[0], last]).astype(np.int64)
    kind = np.concatenate([cols[1], np.full(n, 2)]).astype(np.int32)
    side = np.concatenate([cols[2], np.zeros(n)]).astype(np.int32)
    reason = np.concatenate([cols[3], np.zeros(n)]).astype(np.int64)
    mask = np.concatenate([cols[4], np.full(n, 31)]).astype(np.int32)
    opens, closes = (tbl.column(c).to_numpy(zero_copy_only=False) for c in ("open", "close"))
    price = np.where(kind == 0, opens[row], closes[row])
    nothing = np.zeros(len(row) - n, dtype=np.int32)
    take = pa.array(row)
    return pa.table(
        {
            **{k: tbl.column(k).take(take) for k in keys},
            "kind": kind, "part": tbl.column("part").take(take), "mask": mask, "seq": (row - start[g[row]]).astype(np.int32),
            "ts": tbl.column("ts").take(take), "side": side, "price": price,
            "reason": pa.array(np.array(["entry", "eod", "signal"], dtype=object)[reason].tolist(), pa.string()),
            **{f"next{i}": np.concatenate([nothing, state[:, i].astype(np.int32)]) for i in range(5)},
        }
    )


def _compose(batches: Iterable[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Incoming state of each part, from maps sorted by series and part; the last part of a series is marked."""
    current, state, held = None, FLAT, None
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            series = tuple(r[k] for k in keys)
            if series != current:
                if held is not None:
                    out.append(held | {"is_last": True})
                current, state, held = series, FLAT, None
            elif held is not None:
                out.append(held)
            own = {k: r[k] for k in keys} | {"part": r["part"], "incoming": state, "last_ts": r["ts"], "last_close": r["price"]}
            state = r[f"next{state}"]
            held = own | {"outgoing": state, "is_last": False}
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held | {"is_last": True}], schema=schema)


def backtest_signals(bars: DataFrame, keys: list[str], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Trades of a signal strategy.

    bars: the keys of a series, ts, open, close, and the flags el, es, xl, xs (entry and exit,
    long and short).  An entry fills at the next bar's open, a signal exit at the
    current close; long is tested first.  With sessions, a position ends at 15:50 or with its
    session's last bar, and an entry still pending then fills in the next session; without, the last
    position of a series ends with its last close.  Times must be unique in a series.
    Null flags count as false; empty input gives no trades.
    """
    end = SESSION_END.hour * 60 + SESSION_END.minute
    d = bars.select(
        *keys, "ts", "open", "close", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("el", "es", "xl", "xs")],
        (F.lit(config.sessions) & (F.hour("ts") * 60 + F.minute("ts") >= end)).alias("eod"),
        F.floor(F.unix_date(F.to_date("ts")) / (1 if config.sessions else config.part_days)).cast("long").alias("part"),
    ).withColumn("__part", F.xxhash64(*keys, "part"))
    key_ddl = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in keys)
    run = lambda b: whole_groups(b, "__part", lambda t: _fold_parts(t, keys, config.sessions))
    folded = d.repartition("__part").sortWithinPartitions("__part", *keys, "ts").mapInArrow(run, f"{key_ddl}, {EVENTS}")
    folded = cut(folded)  # events and maps are read apart
    maps = folded.where("kind = 2").repartition(*keys).sortWithinPartitions(*keys, "part")
    state_ddl = f"{key_ddl}, part long, incoming int, last_ts timestamp_ntz, last_close double, outgoing int, is_last boolean"
    schema = _arrow(state_ddl)
    states = cut(maps.mapInArrow(lambda b: _compose(b, keys, schema), state_ddl))
    same = [folded[k].eqNullSafe(states[k]) for k in keys] + [folded["part"] == states["part"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    true_ones = folded.where("kind < 2").join(states, cond).where("(mask & shiftleft(1, incoming)) != 0").select(
        *[folded[k] for k in keys], folded["part"], "seq", "ts", "kind", "side", "price", "reason"
    )
    lingering = states.where(f"is_last and outgoing in ({LONG}, {SHORT})").select(
        *keys, "part", F.lit(2**30).alias("seq"), F.col("last_ts").alias("ts"), F.lit(1).alias("kind"),
        F.when(F.col("outgoing") == LONG, 1).otherwise(-1).alias("side"), F.col("last_close").alias("price"), F.lit("eod").alias("reason"),
    )
    if config.sessions:  # positions begin and end in one session
        before = Window.partitionBy(*keys, "part").orderBy("seq", "kind")
        paired = true_ones.select("*", F.lag("ts").over(before).alias("entry_ts"), F.lag("price").over(before).alias("entry_open")).where("kind = 1")
    else:
        order = [F.col("seq"), F.col("kind")]
        paired = previous(true_ones.unionByName(lingering), keys, "part", order, {"ts": "entry_ts", "price": "entry_open"}).where("kind = 1")
    side = F.col("side")
    entry = F.col("entry_open") + side * config.slippage
    out = F.col("price") - side * config.slippage
    return finish_trades(
        paired.select(
            *keys, F.when(side == 1, "long").otherwise("short").alias("side"), F.lit(config.size).alias("size"), "entry_ts", entry.alias("entry_price"),
            F.col("ts").alias("exit_ts"), out.alias("exit_price"), F.col("reason").alias("exit_reason"),
            F.when(side == 1, "long_entry").otherwise("short_entry").alias("signal_label"),
        ),
        config,
    )


def finish_trades(trades: DataFrame, config: BacktestConfig) -> DataFrame:
    """Add pnl, pnl_pct and duration_mins (whole minutes)."""
    side = F.when(F.col("side") == "long", 1).otherwise(-1)
    move = (F.col("exit_price") - F.col("entry_price")) * side
    return trades.select(
        "*", (move * F.col("size") - 2 * config.commission).alias("pnl"), (move / F.nullif(F.col("entry_price"), F.lit(0.0))).alias("pnl_pct"),
        F.expr("timestampdiff(MINUTE, entry_ts, exit_ts)").cast("int").alias("duration_mins"),
    )


# ---- custom strategies -------------------------------------------------------------------


@dataclass
class Bar:
    ts: dt.datetime
    open: float
    high: float
    low: float
    close: float
    volume: float


@dataclass
class Entry:
    """An order to enter at the next bar's open; only market orders can be filled."""

    side: str  # long or short
    stop: float | None = None
    target: float | None = None
    label: str = ""
    size: int = 1
    kind: str = "market"


@dataclass
class Exit:
    """An order to leave at the current close; only market orders can be filled."""

    label: str = ""
    kind: str = "market"


@dataclass
class Position:
    side: str
    size: int
    price: float
    ts: dt.datetime
    stop: float
    target: float
    label: str


TRADES = (
    "side string, size int, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, exit_reason string, signal_label string"
)
EQUITY = "ts timestamp_ntz, equity double, in_position boolean, n_orders int"


class Engine:
    """One series' run of a custom strategy; ``feed`` takes its bars in order and yields closed trades."""

    def __init__(self, strategy: Any, config: BacktestConfig):
        self.strategy, self.config = strategy, config
        self.history: list[Bar] = []
        self.position: Position | None = None
        self.pending: Entry | None = None
        self.last: Bar | None = None
        self.cash = config.starting_capital
        self.orders = 0
        self.equity = self.cash

    def _leave(self, price: float, ts: dt.datetime, reason: str) -> tuple:
        p, c = self.position, self.config
        sign = 1 if p.side == "long" else -1
        free = reason in ("stop", "target") and not c.realistic_fills
        paid = price if free else price - sign * c.slippage
        self.cash += (paid - p.price) * p.size * sign - 2 * c.commission
        trade = (p.side, p.size, p.ts, p.price, ts, paid, reason, p.label)
        self.position = None
        self.strategy.on_trade_closed(trade)
        return trade

    def feed(self, bar: Bar) -> Iterator[tuple]:
        c, strategy = self.config, self.strategy
        fresh = self.last is None or (c.sessions and bar.ts.date() != self.last.ts.date())
        if fresh:
            if self.position is not None:
                yield self._leave(self.last.close, self.last.ts, "eod")
                self.pending = None
            self.history.clear()
            strategy.on_session_start(bar.ts)
        if self.pending is not None and self.position is None:
            o, self.pending = self.pending, None
            sign = 1 if o.side == "long" else -1
            far, inf = (0.0, float("inf")) if sign == 1 else (float("inf"), 0.0)
            stop, target = (far if o.stop is None else o.stop), (inf if o.target is None else o.target)
            self.position = Position(o.side, o.size, bar.open + sign * c.slippage, bar.ts, stop, target, o.label)
        p = self.position
        if p is not None:
            stopped, reached = (bar.low <= p.stop, bar.high >= p.target) if p.side == "long" else (bar.high >= p.stop, bar.low <= p.target)
            if stopped or reached:
                yield self._leave(p.stop if stopped else p.target, bar.ts, "stop" if stopped else "target")
        if c.sessions and self.position is not None and bar.ts.time() >= SESSION_END:
            yield self._leave(bar.close, bar.ts, "eod")
            self.pending = None
        self.history.append(bar)
        if len(self.history) > strategy.keep:
            del self.history[: len(self.history) - strategy.keep]
        for order in strategy.on_bar(bar, self.position, self.history):
            self.orders += 1
            if order.kind != "market":
                raise ValueError(f"a {order.kind} order cannot be filled")
            if isinstance(order, Entry):
                if self.position is None:
                    self.pending = order
            elif self.position is not None:
                yield self._leave(bar.close, bar.ts, "signal")
        p = self.position
        open_pnl = 0.0 if p is None else (bar.close - p.price) * p.size * (1 if p.side == "long" else -1) - c.commission
        self.equity = self.cash + open_pnl
        self.last = bar

    def finish(self) -> Iterator[tuple]:
        if self.position is not None:
            yield self._leave(self.last.close, self.last.ts, "eod")


def run_custom(bars: DataFrame, keys: list[str], make: Callable[[], Any], config: BacktestConfig, *, equity: bool = False) -> DataFrame:
    """Trades (or the equity after each bar) of a custom strategy.

    Such a strategy may depend on all of its past, so a series is one ordered stream: rows
    are sorted on disk and folded batch by batch, and only the strategy's own
    history of at most ``keep`` bars is held.  Different series run in parallel.
    """
    key_ddl = ", ".join(f"`{k}` {bars.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{key_ddl}, {EQUITY if equity else TRADES}"
    schema = _arrow(ddl)
    cols = ["ts", "open", "high", "low", "close", "volume"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, engine = None, None
        for batch in batches:
            out: list[tuple] = []
            key_cols = [batch.column(k).to_pylist() for k in keys]
            values = zip(*[batch.column(c).to_pylist() for c in cols])
            for key, row in zip(zip(*key_cols), values):
                if key != series:
                    if engine is not None and not equity:
                        out += [series + t for t in engine.finish()]
                    series, engine = key, Engine(make(), config)
                closed = list(engine.feed(Bar(*row)))
                if equity:
                    out.append(key + (row[0], engine.equity, engine.position is not None, engine.orders))
                else:
                    out += [key + t for t in closed]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if engine is not None and not equity:
            rest = [series + t for t in engine.finish()]
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), schema)], schema=schema)

    folded = bars.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys, "ts").mapInArrow(run, ddl)
    return folded if equity else finish_trades(folded, config)
