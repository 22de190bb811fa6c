"""The batch operators on streams: bars from ticks with late-data rules, and signals bar by bar."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tidemark.schema import TIMEFRAMES
from tidemark.session import ensure_checkpoint_dir


def stream_bars(ticks: DataFrame, timeframe: str = "5m", late: str = "10 minutes", order: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a tick stream (symbol, ts, price, volume); ticks later than ``late`` are dropped, bars come when they are closed.

    Of ticks with one time, the columns ``order`` tell the first and the last.
    """
    width = f"{TIMEFRAMES[timeframe]} seconds"
    place = F.struct("ts", *order)
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_ema(bars: DataFrame, period: int = 20) -> DataFrame:
    """Running exponential average of closes per symbol, its state kept across batches (symbol, ts, close, ema).

    The average begins as the mean of the first ``period`` closes; before, it is null.  Rows of one batch are taken in order of
    time, however they arrive; rows older than an earlier batch's are averaged after those.  Null closes are left out.
    """
    k = 2.0 / (period + 1)

    def step(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(pdfs)).dropna(subset=["close"]).sort_values("ts", kind="stable")
        closes = rows["close"].to_numpy(dtype=float)
        out = np.full(len(closes), np.nan)
        head = max(0, min(period - n, len(closes)))  # closes that still belong to the seed
        total += closes[:head].sum()
        rest = closes[head:]
        if n + head == period and head:
            last = total / period
            out[head - 1] = last
        if len(rest):
            out[head:] = pd.Series(np.r_[last, rest]).ewm(alpha=k, adjust=False).mean().to_numpy()[1:]
            last = out[-1]
        state.update((int(n + len(closes)), float(total), float(last)))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"], "close": closes, "ema": pd.Series(out, index=rows.index).where(~np.isnan(out), None)})

    kept = "n long, total double, ema double"
    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", kept, "append", "NoTimeout")


def _folder(stream: DataFrame) -> str:
    ensure_checkpoint_dir(stream.sparkSession)
    return f"{stream.sparkSession.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4()}"


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all data there is, into files of the shared checkpoint folder, and return the rows it has given out.

    Windows that the watermark has not closed are not among them; ``drain_open`` returns those, too.
    """
    root = _folder(stream)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_open(stream: DataFrame, keys: list[str]) -> DataFrame:
    """As ``drain``, with the windows that are still open when the data end: the last state of each key."""
    root, spark = _folder(stream), stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{root}/rows/none")  # a stream without data has no batch

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/rows/{number}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/rows")
    values = F.struct(*[c for c in stream.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, "__batch").alias("__v")).select(*keys, "__v.*")
