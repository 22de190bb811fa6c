"""Technical indicators as window and higher-order expressions, registered by name.

An indicator of a bar looks at the bars of its series up to it.  A series is a
partition of a window (symbol and session, or symbol and chunk with a halo); a bar whose
series is too short has null.  Recursive averages are seeded at the beginning of
the last ``buffer`` bars of the series.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import with_halo

#: Default arguments of each indicator.
DEFAULTS: dict[str, dict[str, Any]] = {
    "sma": {},
    "ema": {},
    "rsi": {"period": 14, "smoothing": "simple"},
    "atr": {"period": 14},
    "bb_mid": {"period": 20, "k": 2.0},
    "bb_upper": {"period": 20, "k": 2.0},
    "bb_lower": {"period": 20, "k": 2.0},
    "roc": {"period": 10},
    "macd": {"fast": 12, "slow": 26, "signal": 9},
    "macd_signal": {"fast": 12, "slow": 26, "signal": 9},
    "macd_hist": {"fast": 12, "slow": 26, "signal": 9},
    "daily_return": {},
    "percent_rank": {"period": 252},
    "zscore": {"period": 20},
}
REQUIRED = {"sma": ("period",), "ema": ("period",)}
#: Closed ranges of bounded indicators.
RANGES = {"rsi": (0.0, 100.0), "atr": (0.0, float("inf")), "percent_rank": (0.0, 1.0)}
DAILY_ONLY = {"daily_return"}


@dataclass(frozen=True)
class Indicator:
    """One declared indicator: its alias, its type and arguments."""

    name: str
    type: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)

    def args(self) -> dict[str, Any]:
        check_arguments(self.type, self.params)
        return DEFAULTS[self.type] | self.params


def check_arguments(kind: str, params: dict[str, Any]) -> None:
    """Raise ValueError for an unknown indicator, an unknown argument or a missing one."""
    if kind not in DEFAULTS:
        raise ValueError(f"unknown indicator {kind!r}")
    allowed = set(DEFAULTS[kind]) | set(REQUIRED.get(kind, ()))
    extra, missing = set(params) - allowed, set(REQUIRED.get(kind, ())) - set(params)
    if extra or missing:
        raise ValueError(f"{kind}: unknown arguments {sorted(extra)}, missing {sorted(missing)}")


def lookback(kind: str, params: dict[str, Any]) -> int:
    """Bars of history by the arguments; the two averages of macd add up."""
    if kind not in DEFAULTS or kind == "daily_return":
        return 0
    args = DEFAULTS[kind] | params
    names = ("slow", "signal") if kind.startswith("macd") else ("period",)
    return sum(int(args[n]) for n in names if isinstance(args.get(n), (int, float)) and not isinstance(args[n], bool))


def need(kind: str, params: dict[str, Any]) -> int:
    """Bars without which the value is null: one more than the period where changes are used."""
    if kind == "daily_return":
        return 2
    return lookback(kind, params) + (kind in ("rsi", "atr", "roc"))


def buffer_length(indicators: list[Indicator]) -> int:
    """Bars that a strategy keeps: 50, or ten more than the largest explicit period, slow or lookback."""
    own = [v for i in indicators for k in ("period", "slow", "lookback") if isinstance(v := i.params.get(k), int) and v > 0]
    return max([50, *[v + 10 for v in own]])


class Series:
    """Window specs over one ordered series."""

    def __init__(self, keys: list[str], buffer: int):
        self.base = Window.partitionBy(*keys).orderBy("ts")
        self.place = F.row_number().over(self.base)
        self.buffer = buffer

    def last(self, n: int):  # noqa: ANN201
        return self.base.rowsBetween(-(n - 1), 0)

    def before(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def closes(self) -> Column:
        return F.collect_list("close").over(self.last(self.buffer))


def _from(values: Column, place: int) -> Column:
    """The values from a place (the first is 1) to the end."""
    return F.slice(values, F.lit(place), F.size(values))


def _ema(closes: Column, period: int) -> Column:
    """Average of the first ``period`` values, then exponential over the rest."""
    k = 2.0 / (period + 1)
    seed = F.aggregate(F.slice(closes, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    return F.aggregate(_from(closes, period + 1), seed, lambda e, c: c * k + e * (1 - k))


def _wilder(changes: Column, period: int) -> Column:
    seed = F.aggregate(F.slice(changes, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    return F.aggregate(_from(changes, period + 1), seed, lambda e, c: (e * (period - 1) + c) / period)


def _macd(closes: Column, fast: int, slow: int, signal: int) -> Column:
    """(macd, signal line) of a buffer, by one pass with the three averages in the accumulator."""
    kf, ks, kg = (2.0 / (n + 1) for n in (fast, slow, signal))
    head = lambda n: F.aggregate(F.slice(closes, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    zero = F.struct(F.lit(0).alias("i"), head(fast).alias("f"), head(slow).alias("s"), F.lit(0.0).alias("g"), F.lit(0.0).alias("m"))

    def step(a: Column, c: Column) -> Column:
        f = F.when(a.i >= fast, c * kf + a.f * (1 - kf)).otherwise(a.f)
        s = F.when(a.i >= slow, c * ks + a.s * (1 - ks)).otherwise(a.s)
        m = f - s
        nth = a.i - slow  # place in the macd series
        g = F.when(nth < 0, a.g).when(nth < signal, a.g + m / signal).otherwise(m * kg + a.g * (1 - kg))
        return F.struct((a.i + 1).alias("i"), f.alias("f"), s.alias("s"), g.alias("g"), F.when(nth >= 0, m).otherwise(a.m).alias("m"))

    return F.aggregate(closes, zero, step, lambda a: F.struct(a.m.alias("macd"), a.g.alias("line")))


def _plain(kind: str, a: dict[str, Any], s: Series) -> Column:
    """Indicators over frames; ``__change`` and ``__range`` are the change and the true range of each bar."""
    p = int(a.get("period", 0))
    if kind == "sma":
        return F.avg("close").over(s.last(p))
    if kind == "rsi":
        gain, loss = F.avg(F.greatest("__change", F.lit(0.0))).over(s.last(p)), F.avg(F.greatest(-F.col("__change"), F.lit(0.0))).over(s.last(p))
        return F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))
    if kind == "atr":
        return F.avg("__range").over(s.last(p))
    if kind.startswith("bb_"):
        side = {"bb_mid": 0.0, "bb_upper": 1.0, "bb_lower": -1.0}[kind]
        return F.avg("close").over(s.last(p)) + side * a["k"] * F.stddev_pop("close").over(s.last(p))
    if kind == "roc":
        return (F.col("close") / F.nullif(s.before("close", p), F.lit(0.0)) - 1.0) * 100.0
    if kind == "daily_return":
        return F.col("close") / F.nullif(s.before("close"), F.lit(0.0)) - 1.0
    if kind == "percent_rank":
        return F.col("__list").cast("double")
    if kind == "zscore":
        m, sd = F.avg("close").over(s.last(p)), F.stddev_pop("close").over(s.last(p))
        return (F.col("close") - m) / F.nullif(sd, F.lit(0.0))
    raise ValueError(f"unknown indicator {kind!r}")


def add_indicators(bars: DataFrame, keys: list[str], indicators: list[Indicator], *, buffer: int | None = None) -> DataFrame:
    """Add one column per alias and ``warm`` (all are there) to bars ordered by ts within ``keys``.

    Equal declarations are computed once.  ``buffer`` is the length of the history that
    recursive averages see (by default that of a strategy with these indicators).  Windows
    share one partitioning and order, so there is one shuffle and one sort.
    """
    buffer = buffer or buffer_length(indicators)
    s = Series(keys, buffer)
    d = bars.withColumn("__place", s.place)
    kinds = {i.type for i in indicators}
    prev = s.before("close")
    if "rsi" in kinds:
        d = d.withColumn("__change", F.col("close") - prev)
    if "atr" in kinds:
        d = d.withColumn("__range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    recursive = any(i.type == "ema" or i.type.startswith("macd") or (i.type == "rsi" and i.args()["smoothing"] == "wilder") for i in indicators)
    if recursive:
        d = d.withColumn("__closes", s.closes())
    done: dict[str, str] = {}
    for i in indicators:
        a = i.args()
        text = f"{i.type}{sorted(a.items())}"
        if text in done:
            d = d.withColumn(i.name, F.col(done[text]))
            continue
        done[text] = i.name
        have = F.least(F.col("__place"), F.lit(buffer)) if recursive and _recursive(i) else F.col("__place")
        if i.type == "ema":
            value = _ema(F.col("__closes"), int(a["period"]))
        elif i.type.startswith("macd"):
            m = _macd(F.col("__closes"), int(a["fast"]), int(a["slow"]), int(a["signal"]))
            value = {"macd": m["macd"], "macd_signal": m["line"], "macd_hist": m["macd"] - m["line"]}[i.type]
        elif i.type == "rsi" and a["smoothing"] == "wilder":
            p = int(a["period"])
            steps = F.zip_with(F.col("__closes"), _from(F.col("__closes"), 2), lambda x, y: y - x)
            steps = F.filter(steps, lambda x: x.isNotNull())
            gain = _wilder(F.transform(steps, lambda x: F.greatest(x, F.lit(0.0))), p)
            loss = _wilder(F.transform(steps, lambda x: F.greatest(-x, F.lit(0.0))), p)
            value = F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))
        elif i.type == "percent_rank":
            p = int(a["period"])
            d = d.withColumn("__window", F.collect_list("close").over(s.last(p)))
            value = F.size(F.filter("__window", lambda x: x <= F.col("close"))) / F.lit(float(p))
        else:
            value = _plain(i.type, a, s)
        enough = have >= need(i.type, i.params)
        if i.type in ("sma", "bb_mid", "bb_upper", "bb_lower", "zscore", "percent_rank", "rsi", "atr", "roc", "daily_return"):
            # a strategy's own buffer is also a bound
            enough = enough & F.lit(need(i.type, i.params) <= buffer)
        d = d.withColumn(i.name, F.when(enough, value))
        if i.type == "percent_rank":
            d = d.drop("__window")
    warm = F.lit(True)
    for i in indicators:
        warm = warm & F.col(i.name).isNotNull()
    return d.withColumn("warm", warm & (F.col("__place") >= 2)).drop("__place", "__change", "__range", "__closes")


def _recursive(i: Indicator) -> bool:
    return i.type == "ema" or i.type.startswith("macd") or (i.type == "rsi" and i.args()["smoothing"] == "wilder")


def over_long_series(bars: DataFrame, indicators: list[Indicator], *, keys: list[str] | None = None, rows: int = 50_000, buffer: int | None = None) -> DataFrame:
    """Indicators of series without sessions, however long: chunks of about ``rows`` bars, each behind a halo as long as the history looked at."""
    keys = keys or ["symbol"]
    buffer = buffer or buffer_length(indicators)
    halo = max([buffer, *[need(i.type, i.params) for i in indicators]]) + 1
    d = with_halo(bars.withColumn("__day", F.to_date("ts")), keys, "__day", rows, halo)
    return add_indicators(d, [*keys, "chunk"], indicators, buffer=buffer).where("not is_halo").drop("is_halo", "chunk", "__day")


def bar_window(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Highest high and lowest low of the last n bars, and the place of the bar in its session."""
    s = Series(keys, n)
    return bars.select(
        "*", F.max("high").over(s.last(n)).alias("highest_high"), F.min("low").over(s.last(n)).alias("lowest_low"),
        s.place.alias("bars_since_open"), (s.place == 1).alias("is_session_start"),
    )
