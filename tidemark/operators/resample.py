"""Bars from ticks and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import TIMEFRAMES


def bucket(ts: str, timeframe: str) -> Column:
    """Left edge of the bucket of a wall time, counted from midnight; a day is a calendar day."""
    if timeframe == "1d":
        return F.date_trunc("DAY", F.col(ts)).cast("timestamp_ntz")
    # every shorter timeframe divides a day, so edges counted from the epoch are those from midnight
    return F.window(ts, f"{TIMEFRAMES[timeframe]} seconds")["start"]


def resample(bars: DataFrame, timeframe: str, *, order: list[str] | None = None) -> DataFrame:
    """OHLCV of left-closed, left-labelled buckets: first open, highest high, lowest low, last close, sum of volume.

    Buckets follow the wall clock from midnight.  Empty buckets give no row, rows without time are dropped.  Null opens and closes are
    skipped, as are nulls in the other columns; a bucket whose closes are all null is dropped.
    Ties in time are broken by ``order``.  The aggregation is partial before its only shuffle.
    """
    # a plain time keeps the aggregation a hash aggregation; ties need a struct, and a sort
    at = F.struct("ts", *order) if order else F.col("ts")
    some = lambda c: F.when(F.col(c).isNotNull(), at)
    out = bars.where("ts is not null").withColumn("bucket", bucket("ts", timeframe)).groupBy("symbol", "bucket").agg(
        F.min_by("open", some("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", some("close")).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.where("close is not null").withColumnRenamed("bucket", "ts")


def ticks_to_bars(ticks: DataFrame, timeframe: str, order: list[str] | None = None) -> DataFrame:
    """Bars from ticks (symbol, ts, price, volume); file order breaks ties within one time."""
    price = ["open", "high", "low", "close"]
    return resample(ticks.select("symbol", "ts", *[F.col("price").alias(c) for c in price], "volume", *(order or [])), timeframe, order=order)


def latest_load(bars: DataFrame) -> DataFrame:
    """Of rows of one feed and time the one of the last load."""
    rn = F.row_number().over(Window.partitionBy("feed", "time").orderBy(F.desc("load_no"), F.desc("bar_id")))
    return bars.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
