"""Percentiles of very large columns from counts in logarithmic buckets.

A value falls into a signed bucket of fixed relative width; a sketch is a table of
bucket counts with the accuracy they were made for, so sketches of partitions, streams or
days are combined by adding equal buckets.  A percentile read from a sketch differs from
the exact one (the value at rank floor(p (n - 1))) by at most the relative error ``accuracy``,
whatever its magnitude: the buckets span all normal doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Greatest and least magnitude of a double.
MOST, LEAST = 1.7976931348623157e308, 5e-324


def base(accuracy: float) -> float:
    """Ratio of a bucket's ends; narrower by a billionth, so that rounding in a logarithm stays within the bound."""
    a = accuracy * (1 - 1e-9)
    return (1 + a) / (1 - a)


def origin(accuracy: float) -> int:
    """Steps from 1 down to the least magnitude: what makes the numbers of the buckets positive."""
    return 2 - math.floor(math.log(LEAST) / math.log(base(accuracy)))


def bucket_of(value: Column, accuracy: float) -> Column:
    """Signed bucket: 0 for zero, else sign times the (positive) number of the magnitude's bucket."""
    steps = F.ceil(F.ln(F.abs(value)) / math.log(base(accuracy))).cast("int") + origin(accuracy)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * steps)


def bucket_value(bucket: Column, accuracy: float) -> Column:
    """The value in a bucket with the least relative error to either end."""
    g = base(accuracy)
    lower = F.pow(F.lit(g), F.abs(bucket) - (origin(accuracy) + 1))
    size = F.least(lower * (2 * g / (g + 1)), F.lit(MOST))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, keys: list[str], values: list[str], accuracy: float = 0.01) -> DataFrame:
    """Bucket counts (keys, metric, accuracy, bucket, n).

    Nulls, NaN and infinities are left out; a group without values has no row.  Counts are
    added map-side, so a hot group is shuffled as its few thousand buckets.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values]))
    rows = df.select(*keys, pairs.alias("x")).select(*keys, "x.metric", "x.v")
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    counted = rows.groupBy(*keys, "metric", bucket_of(F.col("v"), accuracy).alias("bucket")).agg(F.count("*").alias("n"))
    return counted.select(*keys, "metric", F.lit(float(accuracy)).alias("accuracy"), "bucket", "n")


def merge(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of all rows from the sketches of parts of them.

    Sketches of different accuracy stay apart here, and ``percentiles`` refuses them.
    """
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*keys, "metric", "accuracy", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sk: DataFrame, keys: list[str], at: list[float], accuracy: float = 0.01) -> DataFrame:
    """(keys, metric, n_values, p, value) for each percentile in ``at``.

    Counts made for another accuracy than the one given stop the query: their buckets are other ranges.
    """
    strange = F.concat(F.lit("a sketch of accuracy "), F.col("accuracy").cast("string"), F.lit(f" read as {accuracy}"))
    bucket = F.when(F.col("accuracy") == float(accuracy), F.col("bucket")).otherwise(F.raise_error(strange).cast("int"))
    sk = sk.select(*keys, "metric", bucket.alias("bucket"), "n")
    by = Window.partitionBy(*keys, "metric")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sk.select(*keys, "metric", "bucket", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by).alias("n_values"))
    wanted = ranked.select("*", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("p"))
    rank = F.floor(F.col("p") * (F.col("n_values") - 1))
    hit = wanted.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    return hit.select(*keys, "metric", "n_values", "p", bucket_value(F.col("bucket"), accuracy).alias("value"))


def archetype_of(strategies: DataFrame) -> DataFrame:
    """(key, archetype): of each strategy hash, in one spelling, the archetype of its earliest row."""
    name = F.regexp_replace(F.lower(F.trim("archetype")), r"[\s-]+", "_")
    return (
        strategies.select(hash_key("strategy_hash").alias("key"), name.alias("archetype"), "batch_no", "strategy_id")
        .where("key is not null")
        .groupBy("key")
        .agg(F.min_by("archetype", F.struct("batch_no", "strategy_id")).alias("archetype"))
    )


def hash_key(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.col(c))), "^sha256:", ""))


def evaluation_sketch(evaluations: DataFrame, strategies: DataFrame, by: list[str] | None = None, accuracy: float = 0.01) -> DataFrame:
    """Sketches of score and median_pf per archetype (and the columns ``by``, such as stream).

    The rows are counted per strategy hash first, so a much-used strategy is joined as a few
    buckets.  Evaluations whose strategy is not there are kept under the archetype ``unknown``.
    """
    by = by or []
    part = sketch(evaluations.withColumn("key", hash_key("strategy_hash")), [*by, "key"], ["score", "median_pf"], accuracy)
    named = part.join(archetype_of(strategies), "key", "left").withColumn("archetype", F.coalesce("archetype", F.lit("unknown")))
    return merge(named.drop("key"), keys=[*by, "archetype"])
