"""Bar sources: normalising, merging, gaps, splits, and stored bars partitioned by symbol and timeframe."""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import AGGREGATES, BARS, MARKET_ZONE, RTH_LAST, RTH_OPEN, TICKS, TIMEFRAMES, is_intraday

OHLCV = ["open", "high", "low", "close", "volume"]
HOLDOUT_START = dt.datetime(2025, 1, 1)


class BarProvider(ABC):
    """Lands bars of a symbol and timeframe for an inclusive range of dates."""

    @abstractmethod
    def fetch_bars(self, symbol: str, timeframe: str, start: dt.date, end: dt.date) -> DataFrame: ...


class LandedJsonProvider(BarProvider):
    """Bars from landed aggregate payloads, one folder per symbol and timeframe."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def fetch_bars(self, symbol: str, timeframe: str, start: dt.date, end: dt.date) -> DataFrame:
        raw = self.spark.read.schema(AGGREGATES).option("multiLine", True).json(f"{self.root}/{symbol.upper()}/{timeframe}")
        bars = trim_dates(aggregates_to_bars(raw, symbol), start, end)
        return rth_only(bars) if is_intraday(timeframe) else bars


def local(ts: Column | str, zone: str = MARKET_ZONE) -> Column:
    """Wall time without zone, in a zone, of an instant."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    # by microseconds, so that the session's zone has no part in it
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.from_utc_timestamp(ts, zone)), epoch)


def aggregates_to_bars(payload: DataFrame, symbol: str, zone: str = MARKET_ZONE, *, strict: bool = True) -> DataFrame:
    """Rows of aggregate payloads (t in milliseconds UTC, o, h, l, c, v) as bars in local wall time.

    A payload whose status is neither OK nor DELAYED stops the query; unless ``strict``, it gives no rows.  Null results give none.
    """
    good = F.coalesce(F.col("status").isin("OK", "DELAYED"), F.lit(False))
    if strict:
        found = F.when(good, F.col("results")).otherwise(F.raise_error(F.concat(F.lit("payload with status "), F.coalesce("status", F.lit("null")))).cast(AGGREGATES["results"].dataType))
        rows = payload.select(F.explode(found).alias("r"))
    else:
        rows = payload.where(good).select(F.explode("results").alias("r"))
    return rows.select(
        F.lit(symbol).alias("symbol"), local(F.timestamp_millis("r.t"), zone).alias("ts"),
        *[F.col(f"r.{c[0]}").alias(c) for c in OHLCV],
    )


#: Places of the fields in a row of a crypto payload: time in seconds, open, high, low, close, vwap, volume, count.
PAIR_ROW = {"open": 2, "high": 3, "low": 4, "close": 5, "volume": 7}


def pair_payload_to_bars(payload: DataFrame, symbol: str, text: str = "value") -> DataFrame:
    """Bars in UTC from crypto payloads (JSON in the column ``text``): the rows under the first member of ``result`` but ``last``.

    A payload with errors, or that is no JSON, stops the query; one without such a member gives no rows.
    """
    p = F.from_json(text, "error array<string>, result map<string,variant>")
    d = payload.select(p.alias("p"), F.col(text).alias("t"))
    wrong = F.col("p.result").isNull() & (F.coalesce(F.size("p.error"), F.lit(0)) == 0) | (F.size("p.error") > 0)
    said = F.concat(F.lit("payload with errors: "), F.coalesce(F.array_join("p.error", "; "), F.substring("t", 1, 80), F.lit("null")))
    pairs = F.map_values(F.map_filter("p.result", lambda k, v: k != "last"))
    rows = F.try_variant_get(F.get(pairs, F.lit(0)), "$", "array<array<string>>")
    kind = "array<array<string>>"
    d = d.select(F.explode(F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(said).cast(kind)).otherwise(rows)).alias("r"))
    return d.select(
        F.lit(symbol).alias("symbol"), local(F.timestamp_seconds(F.element_at("r", 1).cast("double")), "UTC").alias("ts"),
        *[F.element_at("r", PAIR_ROW[c]).cast("double").alias(c) for c in OHLCV],
    )


def rest_rows_to_bars(rows: DataFrame, symbol: str) -> DataFrame:
    """Rows (time in seconds UTC, open, high, low, close, vwap, volume, count) as bars in UTC."""
    return rows.select(
        F.lit(symbol).alias("symbol"), local(F.timestamp_seconds("time"), "UTC").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in OHLCV],
    )


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tick files (ts_unix, price, volume); file_seq keeps the order within a file."""
    return spark.read.schema(TICKS).csv(path).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("file_seq"))


def normalize(df: DataFrame, zone: str | None = None, keep: Column | None = None) -> DataFrame:
    """Bars in the fixed schema, one row per symbol and time.

    Of rows with one time the first by ``keep`` stays (by default by all values, so
    that the result does not depend on input order).  Rows without time are dropped.
    """
    ts = F.col("ts") if zone is None else local("ts", zone)
    d = df.select("symbol", ts.cast("timestamp_ntz").alias("ts"), *[F.col(c).cast("double").alias(c) for c in OHLCV], *([keep.alias("__keep")] if keep is not None else []))
    order = [F.col("__keep")] if keep is not None else [F.col(c) for c in OHLCV]
    rn = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*order))
    return d.where("ts is not null").withColumn("__rn", rn).where("__rn = 1").select(*BARS.names)


def merge_bars(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union in which the existing row of a symbol and time wins."""
    both = existing.select(*BARS.names, F.lit(0).alias("rank")).unionByName(fresh.select(*BARS.names, F.lit(1).alias("rank")))
    rn = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("rank", *OHLCV))
    return both.withColumn("__rn", rn).where("__rn = 1").select(*BARS.names)


def trim_dates(bars: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Rows from the start of ``start`` to the end of ``end``, both inclusive."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz")))


def window_slice(bars: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Rows of the half-open range [start, end); a missing bound is open."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def minute_of_day(ts: Column | str = "ts") -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def rth_only(bars: DataFrame) -> DataFrame:
    """Rows whose local time is in the regular session, from 09:30 to 15:55."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return bars.where(second.between(RTH_OPEN.hour * 3600 + RTH_OPEN.minute * 60, RTH_LAST.hour * 3600 + RTH_LAST.minute * 60))


def is_open(ts: Column, holidays: list[dt.date], first: str = "09:30", last: str = "16:00") -> Column:
    """Weekday, no holiday, and within the open hours."""
    clock = F.date_format(ts, "HH:mm")
    closed = F.to_date(ts).cast("string").isin([d.isoformat() for d in holidays]) if holidays else F.lit(False)
    return (F.weekday(ts) < 5) & ~closed & (clock >= first) & (clock < last)


def coverage(bars: DataFrame) -> DataFrame:
    """First and last date per symbol."""
    return bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"), F.count("*").alias("n_bars"))


def covers(cov: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return cov.select("symbol", ((F.col("first_date") <= F.lit(start)) & (F.col("last_date") >= F.lit(end))).alias("covered"))


def gaps(cov: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Missing ranges before the first and after the last stored date of each symbol, never inside."""
    one = F.lit(1)
    before = F.when(F.lit(start) < F.col("first_date"), F.struct(F.lit(start).alias("gap_start"), F.date_sub(F.least("first_date", F.date_add(F.lit(end), one)), one).alias("gap_end")))
    after = F.when(F.lit(end) > F.col("last_date"), F.struct(F.greatest(F.date_add("last_date", one), F.lit(start)).alias("gap_start"), F.lit(end).alias("gap_end")))
    return cov.select("symbol", F.explode(F.array_compact(F.array(before, after))).alias("g")).select("symbol", "g.gap_start", "g.gap_end")


class BarStore:
    """Parquet bars partitioned by timeframe and symbol; reads prune partitions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _exists(self, sub: str = "") -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root + sub)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def load(self, timeframe: str, symbols: list[str] | None = None) -> DataFrame | None:
        if not self._exists(f"/timeframe={timeframe}"):
            return None
        d = self.spark.read.parquet(self.root).where(F.col("timeframe") == timeframe)
        if symbols is not None:
            d = d.where(F.col("symbol").isin([s.upper() for s in symbols]))
        return d.select(*BARS.names)

    def save(self, bars: DataFrame, timeframe: str) -> None:
        """Overwrite the symbols in ``bars``; other symbols stay.  The bars are validated first."""
        from tidemark.operators.quality import require_valid

        require_valid(bars)
        out = bars.select(*[F.col(c) for c in BARS.names if c != "symbol"], F.upper("symbol").alias("symbol"), F.lit(timeframe).alias("timeframe"))
        (
            out.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(self.root)
        )

    def merge(self, fresh: DataFrame, timeframe: str) -> None:
        from tidemark.session import cut

        old = self.load(timeframe)
        symbols = fresh.select(F.upper("symbol").alias("symbol")).distinct()
        merged = normalize(fresh) if old is None else merge_bars(old.join(symbols, "symbol", "left_semi"), fresh.withColumn("symbol", F.upper("symbol")))
        self.save(cut(merged), timeframe)  # read before the files are replaced


_OPTIMIZING: ContextVar[bool] = ContextVar("optimizing", default=False)


@contextmanager
def optimization_mode() -> Iterator[None]:
    """While active, holdout data cannot be loaded."""
    token = _OPTIMIZING.set(True)
    try:
        yield
    finally:
        _OPTIMIZING.reset(token)


class HoldoutAccessError(RuntimeError):
    """Holdout data were asked for where they must not be seen."""


def source_timeframe(timeframe: str) -> str:
    """Stored timeframe from which a timeframe is made: 1m and 5m themselves, coarser ones from 5m."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return timeframe if timeframe in ("1m", "5m") else "5m"


def train_test(bars: DataFrame, boundary: dt.datetime = HOLDOUT_START) -> DataFrame:
    """Bars before the holdout boundary."""
    return window_slice(bars, None, boundary)


def holdout(bars: DataFrame, boundary: dt.datetime = HOLDOUT_START, *, final_scoring: bool = False) -> DataFrame:
    """Bars from the boundary on; only outside optimisation and only for final scoring."""
    if _OPTIMIZING.get():
        raise HoldoutAccessError("holdout data cannot be loaded inside optimization_mode()")
    if not final_scoring:
        raise HoldoutAccessError("holdout data need final_scoring=True")
    return window_slice(bars, boundary, None)


def write_splits(bars: DataFrame, path: str, boundary: dt.datetime = HOLDOUT_START) -> None:
    """One table partitioned by split (train, holdout)."""
    split = F.when(F.col("ts") < F.lit(boundary).cast("timestamp_ntz"), "train").otherwise("holdout")
    bars.withColumn("split", split).write.mode("overwrite").partitionBy("split", "symbol").parquet(path)


def write_trade_log(trades: DataFrame, path: str) -> None:
    """Trades as CSV with a header: prices rounded to 4 places, minutes in the stamps, percent in percent."""
    price = lambda c: F.round(c, 4).alias(c)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    trades.select(
        "symbol", "side", "size", stamp("entry_ts"), price("entry_price"), stamp("exit_ts"), price("exit_price"), "exit_reason",
        "signal_label", price("pnl"), F.round(F.col("pnl_pct") * 100, 4).alias("pnl_pct"), "duration_mins",
    ).write.mode("overwrite").option("header", True).csv(path)


def write_report(summary: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    """An evaluation report: summary as JSON, each table as CSV."""
    summary.write.mode("overwrite").json(f"{path}/summary.json")
    for name, t in tables.items():
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")


def read_logs(spark: SparkSession, path: str, archetype: str | None = None, name: str | None = None) -> DataFrame:
    """Generation log files (one JSON document each), narrowed by archetype and name."""
    d = spark.read.option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    if archetype is not None:
        d = d.where(F.col("archetype") == archetype)
    return d if name is None else d.where(F.col("path").contains(name))
