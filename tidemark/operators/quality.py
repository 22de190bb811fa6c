"""Checks of bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import BARS


def violations(bars: DataFrame) -> DataFrame:
    """One row: rows, rows without time, repeated (symbol, time) rows, rows with null or NaN prices."""
    keyed = bars.groupBy("symbol", "ts").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.greatest(*[(F.col(c).isNull() | F.isnan(c)).cast("int") for c in ("open", "high", "low", "close")]) > 0, 1).otherwise(0)).alias("bad"),
    )
    return keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("n"))), F.lit(0)).alias("n_without_time"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad_prices"),
    )


def require_valid(bars: DataFrame) -> None:
    """Raise ValueError if columns are missing, times are null or (symbol, time) rows repeat.  Empty tables pass."""
    missing = [c for c in BARS.names if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    v = violations(bars).first()
    if v.n_without_time or v.n_repeated:
        raise ValueError(f"{v.n_without_time} rows without time, {v.n_repeated} repeated rows")


def session_gaps(bars: DataFrame, minutes: int = 10) -> DataFrame:
    """Per symbol and day: bars, gaps of more than ``minutes`` between neighbours, bars off the 5-minute marks."""
    w = Window.partitionBy("symbol", "day").orderBy("ts")
    d = bars.withColumn("day", F.to_date("ts"))
    step = F.expr("timestampdiff(SECOND, before, ts)")
    d = d.withColumn("before", F.lag("ts").over(w))
    return d.groupBy("symbol", "day").agg(
        F.count("*").alias("n_bars"),
        F.count_if(step > minutes * 60).alias("n_gaps"),
        F.count_if((F.minute("ts") % 5 != 0) | (F.second("ts") != 0)).alias("n_unaligned"),
    )
