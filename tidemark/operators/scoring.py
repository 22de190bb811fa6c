"""Robustness scores and threshold checks of evaluated strategies."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate_symbols(per_symbol: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and spread over the symbols with trades, and the sum of trades; zeros and p = 1 where none traded.

    per_symbol: keys, n_trades, pf, ci_lower, p_value.  A symbol without trades has no profit factor, so it
    counts in none of them.
    """
    own = lambda c: F.when(F.col("n_trades") > 0, F.col(c))
    return per_symbol.groupBy(*keys).agg(
        F.coalesce(F.median(own("pf")), F.lit(0.0)).alias("median_pf"), F.coalesce(F.stddev_pop(own("pf")), F.lit(0.0)).alias("std_pf"),
        F.coalesce(F.median(own("ci_lower")), F.lit(0.0)).alias("ci_lower"), F.coalesce(F.median(own("p_value")), F.lit(1.0)).alias("p_value"),
        F.coalesce(F.sum("n_trades"), F.lit(0)).alias("n_trades"),
    )


def robustness(agg: DataFrame, num_parameters: int) -> DataFrame:
    """Add score: median profit factor, less for spread over symbols, for parameters, and for p of 0.05 or more."""
    score = F.col("median_pf") / (1 + F.col("std_pf")) * (0.95 ** max(num_parameters, 0)) * F.when(F.col("p_value") < 0.05, 1.0).otherwise(0.5)
    return agg.withColumn("score", score)


def failed_gates(scored: DataFrame, *, score: float = 1.5, median_pf: float = 1.2, ci_lower: float = 1.0, n_trades: int = 30) -> DataFrame:
    """Add failed (name, required, actual, deficit of each threshold missed) and promising (none is)."""
    gate = lambda name, limit, sign, bad: F.when(
        bad, F.struct(F.lit(name).alias("name"), F.lit(f"{sign}{limit}").alias("required"), F.col(name).cast("double").alias("actual"), (F.lit(float(limit)) - F.col(name)).alias("deficit"))
    )
    gates = [gate(n, v, ">", F.col(n) <= v) for n, v in (("score", score), ("median_pf", median_pf), ("ci_lower", ci_lower))]
    gates.append(gate("n_trades", n_trades, ">=", F.col("n_trades") < n_trades))
    d = scored.withColumn("failed", F.array_compact(F.array(*gates)))
    return d.withColumn("promising", F.size("failed") == 0)


def fast_floor(scored: DataFrame, least: int = 50) -> DataFrame:
    """The reported score is 0 below ``least`` trades; the thresholds still see the score itself."""
    return scored.withColumn("reported_score", F.when(F.col("n_trades") < least, 0.0).otherwise(F.col("score")))


def basket_hash(rows: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """Identity of a set of symbols: the first 12 digits of sha256 over the sorted, joined names."""
    joined = F.array_join(F.array_sort(F.collect_set(symbol)), ",")
    return rows.groupBy(*keys).agg(F.substring(F.sha2(joined, 256), 1, 12).alias("basket_hash"), F.count_distinct(symbol).alias("n_symbols"))


def basket_label(baskets: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Add label: the name of the known set of symbols with the same hash, else ``unknown_`` and the hash."""
    names = {hashlib.sha256(",".join(sorted(set(v))).encode()).hexdigest()[:12]: k for k, v in known.items()}
    found = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("basket_hash")) if names else F.lit(None).cast("string")
    return baskets.withColumn("label", F.coalesce(found, F.concat(F.lit("unknown_"), "basket_hash")))
