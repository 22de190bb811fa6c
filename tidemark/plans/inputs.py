"""Inputs of the analytics queries from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resample import latest_load, resample, ticks_to_bars
from tidemark.session import table
from tidemark.sources.bars import local, rth_only

TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def daily_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of six symbols from the line items."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), *TICK_ORDER,
    )


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    return ticks_to_bars(daily_ticks(spark, d), "1d", TICK_ORDER)


def event_ticks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return t.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def session_bars(spark: SparkSession, d: str) -> DataFrame:
    """5-minute bars of the stock feeds in local wall time: the last load of each reading, regular session only."""
    b = table(spark, d, "bars_5m").where("asset_class = 'stocks' and time is not null")
    ok = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    b = latest_load(b.where(ok))
    b = b.select(F.col("feed").alias("symbol"), local("time").alias("ts"), "open", "high", "low", "close", "volume")
    return rth_only(resample(b, "5m"))


DAILY_SQL = """
ticks AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem),
bars AS (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, o) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)"""

# NaN is told by its text: DuckDB folds isnan() away by the statistics of parquet files, which leave NaN out
SESSION_SQL = """
good AS (
  SELECT feed, time, open, high, low, close, volume FROM bars_5m
  WHERE asset_class = 'stocks' AND time IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL
    AND volume IS NOT NULL AND open::VARCHAR <> 'nan' AND high::VARCHAR <> 'nan' AND low::VARCHAR <> 'nan' AND close::VARCHAR <> 'nan' AND volume::VARCHAR <> 'nan'
  QUALIFY row_number() OVER (PARTITION BY feed, time ORDER BY load_no DESC, bar_id DESC) = 1),
wall AS (SELECT feed AS symbol, time AT TIME ZONE 'America/New_York' AS ts, open, high, low, close, volume FROM good),
bars AS (
  SELECT symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, sum(volume) AS volume FROM wall GROUP BY 1, 2
  HAVING strftime(time_bucket(INTERVAL '5 minutes', wall.ts), '%H:%M') BETWEEN '09:30' AND '15:55')"""
