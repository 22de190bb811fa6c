"""Ordered windows over groups of any size.

A group that is ordered in time is cut at days: windows over rows run per group and
day, and only one row per day takes part in the window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], part: str, order: list, value: Column, out: str, how: str = "sum") -> DataFrame:
    """Running sum or max of ``value`` per group, up to and including each row.

    ``part`` must rise with the order (such as the day); ties in ``order`` should not occur.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    d = df.withColumn("__x", value)
    totals = d.groupBy(*keys, part).agg(fold("__x").alias("__t"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(part).alias("__p"), fold("__t").over(before).alias("__before"))
    on = [d[k].eqNullSafe(totals[f"__k{i}"]) for i, k in enumerate(keys)]
    cond = d[part].eqNullSafe(totals["__p"])
    for c in on:
        cond = cond & c
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = d.join(totals, cond).drop("__p", *[f"__k{i}" for i in range(len(keys))])
    own = fold("__x").over(inside)
    whole = F.coalesce("__before", F.lit(0)) + own if how == "sum" else F.greatest(F.col("__before"), own)
    return joined.withColumn(out, whole).drop("__x", "__before")


def previous(df: DataFrame, keys: list[str], part: str, order: list, columns: dict[str, str]) -> DataFrame:
    """Add the values that ``columns`` (source -> new name) have in the row before, across parts."""
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    src = list(columns)
    last = df.groupBy(*keys, part).agg(F.max_by(F.struct(*src), F.struct(*order)).alias("__last"))
    over = Window.partitionBy(*keys).orderBy(part)
    last = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(part).alias("__p"), F.lag("__last").over(over).alias("__prev"))
    cond = df[part].eqNullSafe(last["__p"])
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(last[f"__k{i}"])
    d = df.join(last, cond).drop("__p", *[f"__k{i}" for i in range(len(keys))])
    d = d.withColumn("__l", F.lag(F.struct(*src)).over(inside))
    prev = F.coalesce("__l", "__prev")
    return d.select(*df.columns, *[prev[s].alias(n) for s, n in columns.items()])


def with_halo(df: DataFrame, keys: list[str], part: str, rows: int, halo: int) -> DataFrame:
    """Deal each group into chunks of about ``rows`` rows, each preceded by at least ``halo`` earlier rows.

    Adds ``chunk`` and ``is_halo``; rows needed by two chunks are repeated.  Parts (days) stay whole.
    """
    days = df.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("__n").over(w)
    days = days.select(*keys, part, F.floor((upto - F.col("__n")) / rows).alias("__own"), F.floor((upto + halo - 1) / rows).alias("__to"))
    days = days.withColumn("__last", F.max("__own").over(Window.partitionBy(*keys)))
    # chunks that begin within the next ``halo`` rows; a chunk's first day begins at or after chunk * rows
    days = days.select(*keys, part, "__own", F.explode(F.sequence("__own", F.greatest("__own", F.least("__to", "__last")))).alias("chunk"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, part]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.alias("a").join(days.alias("b"), cond).select("a.*", "b.chunk", (F.col("b.chunk") != F.col("b.__own")).alias("is_halo"))
