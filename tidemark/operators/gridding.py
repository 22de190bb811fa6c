"""Irregular readings onto a regular grid, by validity intervals.

A reading holds from its time until the next reading of its source, at most
``hold`` long.  These intervals are cut at the grid's cells; a cell's value is the
time-weighted mean of the pieces in it, its coverage the share of the cell they
fill.  All windows run per source and day; only one row per source and day takes
part in windows over a whole source, so a hot source is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["feed", "symbol", "asset_class"]
NONE = "\x00"  # stands for a null key inside the operator


def to_grid(bars: DataFrame, sessions: DataFrame, *, step: int = 300, hold: int = 600) -> DataFrame:
    """Every grid slot of each source (feed, symbol, slot, close, volume, coverage, n_readings, status).

    Slots run from the slot of the source's first row to that of its last one.  The
    grid is every ``step`` seconds; for asset class stocks only from opens_at to
    before closes_at of each session.  ``n_readings`` counts the distinct readings in
    the slot that have a close; status is observed, held (covered by an earlier
    reading only) or missing.  ``volume`` is the sum of the slot's readings, null without any.

    Of several rows with one time the last load counts.  A null close is no reading;
    NaN and infinite closes are readings without a value.  Rows of null time
    have no slot; null feeds or symbols are keys like any other; empty tables give
    an empty result; other columns are ignored.
    """
    us = step * 1_000_000
    r = bars.where(F.col("time").isNotNull()).select(
        *[F.coalesce(F.col(k).cast("string"), F.lit(NONE)).alias(k) for k in KEYS],
        F.unix_micros(F.col("time").cast("timestamp")).alias("t"),
        F.col("close").cast("double").alias("close"),
        F.col("volume").cast("double").alias("volume"),
        F.struct("load_no", "bar_id").alias("load"),
    )
    r = r.withColumn("day", F.expr("t div 86400000000"))
    one_day = Window.partitionBy(*KEYS, "day")
    reads = F.col("close").isNotNull()
    # the next reading of the day, over rows without a close; backwards, so that the frame only grows
    backwards = one_day.orderBy(F.desc("t"), F.desc("load")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.min(F.when(reads, F.col("t"))).over(backwards)
    r = r.select(*KEYS, "day", "t", "close", "volume", reads.alias("reads"), ahead.alias("next_t"))

    days = r.groupBy(*KEYS, "day").agg(
        F.min(F.when(F.col("reads"), F.col("t"))).alias("first_t"), F.min("t").alias("lo"), F.max("t").alias("hi")
    )
    by_day = Window.partitionBy(*KEYS).orderBy("day")
    whole = Window.partitionBy(*KEYS)
    days = days.select(
        *KEYS, "day",
        F.min("first_t").over(whole.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)).alias("later_t"),
        F.lag("day").over(by_day).alias("day_before"),
        F.lead("day").over(by_day).alias("day_after"),
        F.expr(f"min(lo) over (partition by {', '.join(KEYS)}) div {us} * {step}").alias("from_slot"),
        F.expr(f"max(hi) over (partition by {', '.join(KEYS)}) div {us} * {step}").alias("to_slot"),
    )

    # readings: validity intervals, cut at the cells
    read = r.where("reads").join(days.select(*KEYS, "day", "later_t"), [*KEYS, "day"])
    read = read.withColumn("next_t", F.coalesce("next_t", "later_t"))
    read = read.where("next_t is null or next_t > t")  # superseded by a later load of the same time
    end = F.least(F.coalesce("next_t", F.lit(2**62)), F.col("t") + hold * 1_000_000)
    read = read.withColumn("end", end).withColumn(
        "slot", F.explode(F.expr(f"sequence(t div {us}, (end - 1) div {us})"))
    )
    overlap = F.least("end", (F.col("slot") + 1) * us) - F.greatest("t", F.col("slot") * us)
    own = F.expr(f"slot = t div {us}")
    valued = ~F.isnan("close") & (F.abs("close") < float("inf"))
    pieces = read.select(
        *KEYS, (F.col("slot") * step).alias("slot"), F.lit(0).alias("grid"),
        F.when(valued, overlap).otherwise(0).cast("long").alias("w"),
        F.when(valued, F.col("close") * overlap).otherwise(0.0).alias("wc"),
        own.cast("long").alias("n"), F.when(own, F.col("volume")).alias("volume"),
    )

    # grid cells: each day with rows stands for the days up to the next one
    first = F.when(F.col("day_before").isNull(), F.col("day") - 1).otherwise(F.col("day"))
    span = days.select(
        *KEYS, "from_slot", "to_slot",
        F.explode(F.sequence(first, F.coalesce(F.col("day_after") - 1, F.col("day")))).alias("day"),
    )
    always = span.where("asset_class != 'stocks'").select(
        *KEYS, "from_slot", "to_slot", (F.col("day") * 86_400).alias("a"), (F.col("day") * 86_400 + 86_400).alias("b")
    )
    calendar = sessions.select(
        F.unix_seconds(F.col("opens_at").cast("timestamp")).alias("a"), F.unix_seconds(F.col("closes_at").cast("timestamp")).alias("b")
    ).where("a < b").withColumn("day", F.expr("a div 86400"))
    trading = span.where("asset_class = 'stocks'").join(calendar, "day").select(*KEYS, "from_slot", "to_slot", "a", "b")
    # slots of the cell list are clipped to the source's span before they are made
    cells = always.unionByName(trading).select(
        *KEYS,
        (F.col("a") + F.ceil(F.greatest(F.lit(0), F.col("from_slot") - F.col("a")) / step).cast("long") * step).alias("a"),
        F.least(F.col("b") - 1, F.col("to_slot")).alias("b"),
    ).where("a <= b").select(*KEYS, F.explode(F.expr(f"sequence(a, b, {step}L)")).alias("slot"))
    cells = cells.select(
        *KEYS, "slot", F.lit(1).alias("grid"), F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("wc"),
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("volume"),
    )

    slots = pieces.unionByName(cells).groupBy(*KEYS, "slot").agg(
        F.max("grid").alias("grid"), F.sum("w").alias("w"), F.sum("wc").alias("wc"),
        F.sum("n").alias("n_readings"), F.sum("volume").alias("volume"),
    )
    back = lambda k: F.nullif(F.col(k), F.lit(NONE)).alias(k)
    return slots.where("grid = 1").select(
        back("feed"), back("symbol"), "slot",
        F.round(F.col("wc") / F.nullif(F.col("w"), F.lit(0)), 6).alias("close"),
        "volume", F.round(F.col("w") / us, 6).alias("coverage"), "n_readings",
        F.when(F.col("n_readings") > 0, "observed").when(F.col("w") > 0, "held").otherwise("missing").alias("status"),
    )
