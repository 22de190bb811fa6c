"""Queries over strategies, their generations and evaluations.

Hashes are compared as by ``orphans.hash_key`` (without case, outer blanks and a leading
``sha256:``), and stamps, written in several formats and zones, by the instants
they denote: ``dated`` adds both.  A stamp that denotes no single instant sorts as the oldest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.operators.instants import instants
from tidemark.operators.medians import group_medians
from tidemark.operators.orphans import hash_key
from tidemark.operators.prefix import running

#: Evaluation types by rank.
EVAL_TYPES = ("fast", "canonical", "holdout")
ORDERS = {"first_generated_at", "last_seen_at", "generation_count", "archetype", "status"}
QUIRKS = ["stringification_firings", "kwarg_validator_firings", "unreachable_default_firings"]


def dated(df: DataFrame, text: str, zone: str = "recorded_zone") -> DataFrame:
    """df with key (the strategy's hash in one spelling) and moment (the instant of ``text`` in one form, or null).

    Without a column ``zone``, stamps that name no zone themselves denote no instant.
    """
    d = instants(df if zone in df.columns else df.withColumn(zone, F.lit(None).cast("string")), text, zone)
    cols = [c for c in df.columns if c not in ("key", "moment")]
    return d.select(*cols, hash_key("strategy_hash").alias("key"), F.when(F.col("instant").rlike("^[0-9]"), F.col("instant")).alias("moment"))


def uniform(archetype: str = "archetype") -> Column:
    """An archetype in one spelling."""
    return F.regexp_replace(F.lower(F.trim(archetype)), r"[\s-]+", "_")


def earliest(strategies: DataFrame) -> DataFrame:
    """One row per key: that of the earliest batch, and of it the least id; rows without hash are left out."""
    d = strategies.withColumn("key", hash_key("strategy_hash")).where("key is not null")
    row = F.min_by(F.struct(*[F.col(c) for c in strategies.columns if c != "key"]), F.struct("batch_no", "strategy_id"))
    return d.groupBy("key").agg(row.alias("s")).select("key", "s.*")


def strategy(strategies: DataFrame, strategy_hash: str) -> DataFrame:
    """The rows of one hash, in any spelling."""
    wanted = strategy_hash.strip().lower().removeprefix("sha256:").strip()
    return strategies.where(hash_key("strategy_hash") == wanted)


class Ambiguous(LookupError):
    """A prefix that several hashes share."""


def hash_prefix(strategies: DataFrame, prefix: str) -> DataFrame:
    """Up to 11 strategies whose hash starts with the prefix (at least 6 characters): more than one is ambiguous."""
    if len(prefix) < 6:
        raise ValueError("at least 6 characters are needed")
    return strategies.where(F.col("strategy_hash").startswith(prefix)).orderBy("strategy_hash", "strategy_id").limit(11)


def resolve(strategies: DataFrame, prefix: str) -> str | None:
    """The one hash with the prefix; None if there is none, Ambiguous if there are several."""
    if len(prefix) < 6:
        raise ValueError("at least 6 characters are needed")
    key = hash_key("strategy_hash")
    found = [r.key for r in strategies.select(key.alias("key")).where(F.col("key").startswith(prefix.lower())).distinct().orderBy("key").limit(11).collect()]
    if len(found) > 1:
        raise Ambiguous(f"{prefix} begins {', '.join(found[:10])}{' and more' if len(found) > 10 else ''}")
    return found[0] if found else None


def listed(strategies: DataFrame, *, archetype: str | None = None, status: str | None = None, timeframe: str | None = None, order: str = "last_seen_at", limit: int = 50) -> DataFrame:
    """Filtered strategies, newest (or largest) first."""
    if order not in ORDERS:
        raise ValueError(f"cannot order by {order!r}")
    for c, v in (("archetype", archetype), ("status", status), ("timeframe", timeframe)):
        if v is not None:
            strategies = strategies.where(F.col(c) == v)
    return strategies.orderBy(F.desc_nulls_last(order), F.desc("strategy_id")).limit(limit)


def newest_specs(strategies: DataFrame, n: int = 5) -> DataFrame:
    """The n newest strategies of each archetype (in one spelling) with their place, for comparison with new ones."""
    d = earliest(strategies).withColumn("archetype", uniform())
    place = F.row_number().over(Window.partitionBy("archetype").orderBy(F.desc_nulls_last("first_generated_at"), F.desc("strategy_id")))
    return d.withColumn("place", place).where(F.col("place") <= n)  # the limit is applied before the shuffle, too


def _one_per_hash(evaluations: DataFrame, *order: Column) -> DataFrame:
    """The best row per strategy by an order; an aggregation, so that much-used strategies are reduced map-side."""
    keep = F.struct(*[F.col(c) for c in evaluations.columns])
    return evaluations.groupBy("key").agg(F.max_by(keep, F.struct(*order)).alias("e")).select("e.*")


def latest(evaluations: DataFrame, eval_type: str | None = None) -> DataFrame:
    """Latest evaluation per strategy; of equal instants the highest id.  Rows without hash are one group."""
    d = evaluations if eval_type is None else evaluations.where(F.col("eval_type") == eval_type)
    return _one_per_hash(dated(d, "evaluated_at"), F.col("moment"), F.col("id"))


def promising(strategies: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Strategies whose latest evaluation is promising, with its score; best first, missing scores last."""
    e = latest(evaluations).where("promising = 1").select("key", "eval_type", "evaluated_at", "moment", "score", "median_pf", "ci_lower", "basket_version")
    return strategies.withColumn("key", hash_key("strategy_hash")).join(e, "key").orderBy(F.desc_nulls_last("score"), "key", "strategy_id")


def authoritative(evaluations: DataFrame) -> DataFrame:
    """Per strategy the evaluation of the highest type, and of those the newest."""
    rank = F.array_position(F.array(*[F.lit(t) for t in EVAL_TYPES]), F.col("eval_type"))
    return _one_per_hash(dated(evaluations, "evaluated_at"), rank, F.col("moment"), F.col("id"))


def history(generations: DataFrame, strategy_hash: str) -> DataFrame:
    """The generations of one hash, in any spelling, in order."""
    return strategy(dated(generations, "generated_at"), strategy_hash).orderBy("moment", "id")


def histories(generations: DataFrame) -> DataFrame:
    """The history of every hash: its generations with their place in it, from 1; rows without a hash have none.

    Places are counted per day and added up over days, so a much-generated hash is not one task.
    """
    d = dated(generations, "generated_at").where("key is not null").withColumn("day", F.substring("moment", 1, 10))
    return running(d, ["key"], "day", ["moment", "id"], F.lit(1), "place").drop("day")


def status_histogram(strategies: DataFrame) -> DataFrame:
    return strategies.groupBy("status").agg(F.count("*").alias("n"))


def generation_rollup(generations: DataFrame, strategies: DataFrame | None = None, timeframe: str | None = None) -> DataFrame:
    """Per archetype: generations, cost and the three repair counts; joined to strategies only if a timeframe is asked for."""
    if timeframe is not None:
        wanted = strategies.where(F.col("timeframe") == timeframe).select(hash_key("strategy_hash").alias("key")).distinct()
        generations = generations.withColumn("key", hash_key("strategy_hash")).join(wanted, "key", "left_semi")
    return generations.groupBy("archetype").agg(F.count("*").alias("n_generations"), F.sum("cost_usd").alias("total_cost"), *[F.sum(c).alias(c) for c in QUIRKS])


def evaluation_rollup(evaluations: DataFrame) -> DataFrame:
    """Evaluations and promising ones for each of the three types, zero where there are none."""
    types = evaluations.sparkSession.createDataFrame([(t,) for t in EVAL_TYPES], "eval_type string")
    n = evaluations.groupBy("eval_type").agg(F.count("*").alias("n"), F.sum("promising").alias("p"))
    return types.join(n, "eval_type", "left").select("eval_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0)).alias("n_promising"))


def median_score(evaluations: DataFrame, strategies: DataFrame) -> DataFrame:
    """Exact median of the finite scores per archetype (in one spelling) of the strategies."""
    arch = earliest(strategies).select("key", uniform().alias("archetype"))
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    scored = evaluations.where(ok).select(hash_key("strategy_hash").alias("key"), "score")
    return group_medians(scored.join(arch, "key"), "archetype", "score", "median_score")


def archetype_summary(
    strategies: DataFrame, generations: DataFrame, evaluations: DataFrame, *, timeframe: str | None = None, since: str | None = None
) -> DataFrame:
    """One row per archetype of the strategies or generations: all that is known of it.

    Columns: archetype (in one spelling), n_strategies, by_status (a map), n_generations, total_cost and the repair
    counts, n_<type> and promising_<type> of evaluations, median_score.  ``timeframe`` keeps what belongs to strategies
    of it; ``since`` (a UTC instant in the form of ``instants``) keeps what is not older, by each table's own stamp.
    Evaluations and, with a timeframe, generations of unknown strategies belong to no archetype.
    """
    s = earliest(strategies).withColumn("archetype", uniform())
    if timeframe is not None:
        s = s.where(F.col("timeframe") == timeframe)
    of_key = s.select("key", F.col("archetype").alias("own"))
    fresh = s
    if since is not None:
        fresh = s.where(F.date_format(F.to_utc_timestamp("first_generated_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") >= since)
    status = fresh.groupBy("archetype", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))
    status = status.groupBy("archetype").agg(F.sum("n").alias("n_strategies"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))

    g = dated(generations, "generated_at") if since is not None else generations.withColumn("key", hash_key("strategy_hash"))
    g = g if since is None else g.where(F.col("moment") >= since)
    g = g.withColumn("archetype", uniform())
    g = g if timeframe is None else g.join(of_key.select("key"), "key", "left_semi")
    made = g.groupBy("archetype").agg(F.count("*").alias("n_generations"), F.sum("cost_usd").alias("total_cost"), *[F.sum(c).alias(c) for c in QUIRKS])

    e = dated(evaluations, "evaluated_at") if since is not None else evaluations.withColumn("key", hash_key("strategy_hash"))
    e = (e if since is None else e.where(F.col("moment") >= since)).select("key", "eval_type", "promising", "score")
    kinds = [(t, F.col("eval_type") == t) for t in EVAL_TYPES]
    # counted per strategy before the join, as one may be much used
    per = e.groupBy("key").agg(*[F.count_if(c).alias(f"n_{t}") for t, c in kinds], *[F.sum(F.when(c, F.col("promising"))).alias(f"promising_{t}") for t, c in kinds])
    tried = per.join(of_key, "key").groupBy(F.col("own").alias("archetype")).agg(*[F.sum(f"{n}_{t}").alias(f"{n}_{t}") for t in EVAL_TYPES for n in ("n", "promising")])
    middle = group_medians(e.join(of_key, "key"), "own", "score", "median_score").withColumnRenamed("own", "archetype")

    there = lambda d, yes: d.withColumn("there", F.lit(yes))
    parts = there(status, True).unionByName(there(made, True), True).unionByName(there(tried, False), True).unionByName(there(middle, False), True)
    counts = ["n_strategies", "n_generations", *QUIRKS, *[f"{n}_{t}" for t in EVAL_TYPES for n in ("n", "promising")]]
    one = lambda c: F.first(c, ignorenulls=True)  # noqa: E731  # each comes from one part
    d = parts.groupBy("archetype").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[one(c).alias(c) for c in ("by_status", "total_cost", "median_score")], F.bool_or("there").alias("there")
    )
    return d.where("there").drop("there")


def quirk_trend(generations: DataFrame, last_day: str, days: int) -> DataFrame:
    """Repairs per UTC day over ``days`` days up to last_day, one row per day."""
    span = generations.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{last_day}', {days - 1}), date'{last_day}')")).alias("day"))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in QUIRKS[1:]), F.coalesce(F.col(QUIRKS[0]), F.lit(0)))
    per = dated(generations, "generated_at").groupBy(F.substring("moment", 1, 10).cast("date").alias("day")).agg(F.sum(total).alias("n"))
    return span.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_firings"))


def cohort(evaluations: DataFrame, strategies: DataFrame, *, least_ci: float, least_trades: int, basket: str) -> DataFrame:
    """Keys of strategies whose best ci_lower and trades reach the limits and that were not evaluated on the basket."""
    e = evaluations.withColumn("key", hash_key("strategy_hash"))
    best = e.groupBy("key").agg(
        F.max(F.nanvl("ci_lower", F.lit(None).cast("double"))).alias("best_ci"), F.max("n_oos_trades").alias("best_n"), F.bool_or(F.coalesce(F.col("basket_version") == basket, F.lit(False))).alias("done")
    )
    known = strategies.select(hash_key("strategy_hash").alias("key")).distinct()
    return best.where((F.col("best_ci") >= least_ci) & (F.col("best_n") >= least_trades) & ~F.col("done")).drop("done").join(known, "key", "left_semi")


def merge_generations(events: DataFrame) -> DataFrame:
    """Strategies derived from generation events: first and last time, count, and the newest name and document."""
    newest = F.max_by(F.struct("name", "spec_json"), F.struct("generated_at", "id"))
    return events.groupBy(hash_key("strategy_hash").alias("strategy_hash")).agg(
        F.min("generated_at").alias("first_generated_at"), F.max("generated_at").alias("last_seen_at"), F.count("*").alias("generation_count"), newest.alias("x")
    ).select("strategy_hash", "first_generated_at", "last_seen_at", "generation_count", "x.name", "x.spec_json")


def unknown_rows(fresh: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows whose natural key is not known yet (null keys compare as equal)."""
    a, b = fresh.alias("a"), known.select(*keys).distinct().alias("b")
    cond = F.col(f"a.{keys[0]}").eqNullSafe(F.col(f"b.{keys[0]}"))
    for k in keys[1:]:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, cond, "left_anti")


def reconcile(evaluations: DataFrame, *, score: float = 1.5, median_pf: float = 1.2, ci_lower: float = 1.0, n_trades: int = 30) -> DataFrame:
    """Fast evaluations whose stored verdict differs from the thresholds' (id, was, now).

    A missing ci_lower passes; a missing or NaN score or profit factor, and missing trades, do not.
    """
    above = lambda c, limit: F.coalesce(~F.isnan(c) & (F.col(c) > limit), F.lit(False))
    now = above("score", score) & above("median_pf", median_pf) & (F.col("ci_lower").isNull() | above("ci_lower", ci_lower)) & F.coalesce(F.col("n_oos_trades") >= n_trades, F.lit(False))
    d = evaluations.where("eval_type = 'fast'").select("id", F.col("promising").alias("was"), now.cast("int").alias("now"))
    return d.where(~F.col("was").eqNullSafe(F.col("now")))


def newest_log(evaluations: DataFrame, logs: DataFrame, names: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """For each evaluation the newest readable log of a strategy with its name (id, log_id); none gives null.

    The name is the first value under the paths ``names`` of the config.

    The logs are reduced to one per name before the join.
    """
    name = lambda c: F.try_variant_get(F.try_parse_json(c), "$.name", "string")
    by_name = logs.select(name("raw_tool_input").alias("name"), "log_id", "timestamp").where("name is not null")
    newest = by_name.groupBy("name").agg(F.max_by("log_id", F.struct("timestamp", "log_id")).alias("log_id"))
    e = evaluations.select("id", F.coalesce(*[F.try_variant_get(F.try_parse_json("config_json"), f"$.{n}", "string") for n in names]).alias("name"))
    return e.join(newest, "name", "left").select("id", "log_id")


def monthly_cost(generations: DataFrame) -> DataFrame:
    """Cost and number of generations per UTC month; those whose stamp denotes no instant are under ``undated``."""
    month = F.coalesce(F.substring("moment", 1, 7), F.lit("undated"))
    return dated(generations, "generated_at").groupBy(month.alias("month")).agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("n"))


def regated(evaluations: DataFrame, *, score: float = 1.5, median_pf: float = 1.2, ci_lower: float = 1.0, n_trades: int = 30) -> DataFrame:
    """The thresholds each fast evaluation misses, worked out anew (id, promising, gates: JSON, null if none is missed).

    A gate has name, required, actual and deficit; a missing value has no actual and no deficit, and fails, but for
    a missing ci_lower, which passes.
    """
    def gate(name: str, column: str, limit: float, sign: str) -> Column:
        v = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
        fails = (v <= limit) if sign == ">" else (v < limit)
        missing = F.col(column).isNotNull() if column == "ci_lower" else F.lit(True)
        return F.when(
            F.coalesce(fails, missing),
            F.struct(F.lit(name).alias("name"), F.lit(f"{sign}{limit}").alias("required"), v.alias("actual"), F.round(F.lit(float(limit)) - v, 6).alias("deficit")),
        )

    gates = F.array_compact(F.array(gate("score", "score", score, ">"), gate("median_pf", "median_pf", median_pf, ">"), gate("ci_lower", "ci_lower", ci_lower, ">"), gate("n_oos_trades_total", "n_oos_trades", n_trades, ">=")))
    d = evaluations.where("eval_type = 'fast'").select("id", gates.alias("g"))
    return d.select("id", (F.size("g") == 0).cast("int").alias("promising"), F.when(F.size("g") > 0, F.to_json("g")).alias("gates"), F.transform("g", lambda x: x["name"]).alias("names"))


RECOVERED = "path string, name string, strategy_hash string, generated_at timestamp, prompt_hash string, reason string"


def recovered_logs(logs: DataFrame) -> DataFrame:
    """Per log the hash of its document, or why there is none (path, name, strategy_hash, generated_at, prompt_hash, reason).

    Reasons: no document (a failed call), a document that is cut off or breaks the language's rules, or one that the checks of
    ``dsl.lint`` reject.  Documents are read batch by batch; nothing is shuffled.
    """
    def hashed(text: str | None) -> tuple[str | None, str | None, str | None]:
        if text is None:
            return None, None, "no document"
        try:
            spec = dsl.parse(text)
            dsl.gate(spec)
            return spec.name, dsl.spec_hash(spec), None
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return None, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [hashed(t) for t in b.column(3).to_pylist()]
            name, own, reason = (pa.array(x, pa.string()) for x in (zip(*got) if got else ((), (), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), name, own, b.column(1), b.column(2), reason], names=[c.split()[0] for c in RECOVERED.split(", ")])

    return logs.select("path", F.col("timestamp").cast("timestamp"), "prompt_hash", "raw_tool_input").mapInArrow(run, RECOVERED)


def backfill_generations(logs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, skipped logs with reasons); a log whose hash, instant and prompt hash are known is a duplicate.

    known: strategy_hash, moment (instants in one form), prompt_hash.  Of equal new logs the first by path is added.
    """
    r = recovered_logs(logs).withColumn("moment", F.concat(F.date_format(F.to_utc_timestamp("generated_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    r = r.withColumn("key", F.concat_ws("|", "strategy_hash", "moment", F.coalesce(hash_key("prompt_hash"), F.lit(""))))
    had = known.select(F.concat_ws("|", hash_key("strategy_hash"), "moment", F.coalesce(hash_key("prompt_hash"), F.lit(""))).alias("key")).distinct().withColumn("had", F.lit(True))
    first = r.where("reason is null").groupBy("key").agg(F.min("path").alias("first_path"))
    d = r.join(had, "key", "left").join(first, "key", "left")
    twice = F.coalesce("had", F.lit(False)) | (F.col("path") != F.col("first_path"))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & twice, F.lit("duplicate")).otherwise(F.col("reason")))
    return d.where("reason is null").select("path", "name", "strategy_hash", "moment", "prompt_hash"), d.where("reason is not null").select("path", "reason")


def backfill_evaluations(reports: DataFrame, logs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, skipped reports with reasons) of stored reports, each given the hash of the newest log of its strategy that has one.

    reports: results_dir, strategy (the name, in camel or snake case), eval_type, moment; known: strategy_hash, eval_type, moment.
    """
    snake = F.lower(F.regexp_replace("strategy", "(?<!^)(?=[A-Z])", "_"))
    r = recovered_logs(logs).where("reason is null")
    newest = r.groupBy("name").agg(F.max_by("strategy_hash", F.struct("generated_at", "path")).alias("strategy_hash"))
    d = reports.withColumn("name", snake).join(newest, "name", "left")
    d = d.join(known.select("strategy_hash", "eval_type", "moment").distinct().withColumn("had", F.lit(True)), ["strategy_hash", "eval_type", "moment"], "left")
    reason = F.when(F.col("strategy").isNull(), "no strategy").when(F.col("strategy_hash").isNull(), "no hash").when(F.col("had"), "duplicate")
    d = d.withColumn("reason", reason)
    return d.where("reason is null").drop("had", "reason", "name"), d.where("reason is not null").select("results_dir", "reason")
