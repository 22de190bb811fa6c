"""Exact medians per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_medians(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact median (mean of the two middle values) of ``value`` per ``key``.

    Nulls, NaN and infinities are left out; a group without values gives no row.
    Equal values are counted first (map-side), so that a group, however hot, is
    a list of (value, count).  Those are counted in coarse buckets; only the one
    or two buckets that hold the middle ranks are ranked value by value.
    """
    v = F.col(value).cast("double")
    ok = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # 1/64 octave: monotone in the value, a few thousand buckets in all
    magnitude = F.ceil(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * 64)
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (magnitude + 100_000)).cast("long")
    counted = ok.groupBy(F.col(key), bucket.alias("__b"), v.alias("__v")).agg(F.count("*").alias("__n"))
    buckets = counted.groupBy(key, "__b").agg(F.sum("__n").alias("__bn"))
    upto = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select(
        key,
        "__b",
        (F.sum("__bn").over(upto) - F.col("__bn")).alias("__before"),
        F.col("__bn"),
        F.sum("__bn").over(Window.partitionBy(key)).alias("__all"),
    )
    lo, hi = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    end = F.col("__before") + F.col("__bn")
    middle = buckets.where(((F.col("__before") <= lo) & (lo < end)) | ((F.col("__before") <= hi) & (hi < end)))
    inside = counted.join(middle, [key, "__b"])
    within = Window.partitionBy(key, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select(
        key, "__v", "__all", (F.col("__before") + F.sum("__n").over(within)).alias("__to"), F.col("__n")
    )
    at = lambda r: (F.col("__to") - F.col("__n") <= r) & (r < F.col("__to"))
    return ranked.groupBy(key).agg(
        ((F.max(F.when(at(lo), F.col("__v"))) + F.max(F.when(at(hi), F.col("__v")))) / 2).alias(out)
    )
