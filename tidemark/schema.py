"""Schemas, timeframes and the trading calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

#: Timeframes and their seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14_400, "1d": 86_400}
#: Bars of a regular session by timeframe.
BARS_PER_SESSION = {"1m": 390, "5m": 78, "15m": 26, "30m": 13, "1h": 7, "4h": 3}

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
TICKS = T.StructType([T.StructField("ts_unix", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
AGGREGATES = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("next_url", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(T.StructType([T.StructField("t", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in "ohlcv"]])),
        ),
    ]
)

RTH_OPEN, RTH_LAST, SESSION_END = dt.time(9, 30), dt.time(15, 55), dt.time(15, 50)
MARKET_ZONE = "America/New_York"


def is_intraday(timeframe: str) -> bool:
    return TIMEFRAMES[timeframe] < TIMEFRAMES["1d"]
