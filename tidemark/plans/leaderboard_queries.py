"""Registered queries over strategies, generations and evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import leaderboard as lb
from tidemark.operators import drift, scoring
from tidemark.plans.stamps_sql import stamps
from tidemark.session import table

BASKET = "five_v1"


def _t(spark: SparkSession, d: str, n: str) -> DataFrame:
    return table(spark, d, n)


def lb_latest(spark: SparkSession, d: str) -> DataFrame:
    return lb.latest(_t(spark, d, "evaluations")).select("key", "moment", "strategy_hash", "id", "eval_type", "evaluated_at", F.round("median_pf", 6).alias("median_pf"))


def lb_promising(spark: SparkSession, d: str) -> DataFrame:
    p = lb.promising(_t(spark, d, "strategies"), _t(spark, d, "evaluations"))
    return p.select("strategy_id", "key", "moment", "eval_type", "evaluated_at", "score", "ci_lower", "basket_version")


def lb_authoritative(spark: SparkSession, d: str) -> DataFrame:
    return lb.authoritative(_t(spark, d, "evaluations")).select("key", "moment", "id", "eval_type", "evaluated_at")


def lb_list(spark: SparkSession, d: str) -> DataFrame:
    return lb.listed(_t(spark, d, "strategies"), archetype="momentum").select("strategy_id", "strategy_hash", "name", "status", "generation_count")


def lb_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lb.hash_prefix(_t(spark, d, "strategies"), "4f53cd").select("strategy_id", "strategy_hash")


def _some_hash(spark: SparkSession, d: str) -> str:
    """The hash of the generation with the least id that has one, as it is written there."""
    g = _t(spark, d, "generations").where("strategy_hash is not null")
    return g.agg(F.min_by("strategy_hash", "id").alias("h")).first().h or ""


def lb_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup, in any spelling."""
    return lb.strategy(_t(spark, d, "strategies"), _some_hash(spark, d)).select("strategy_id", "name", "archetype", "status", "generation_count")


def lb_history(spark: SparkSession, d: str) -> DataFrame:
    """The generations of one hash, in any spelling, in order."""
    return lb.history(_t(spark, d, "generations"), _some_hash(spark, d)).select("id", "moment", "generated_at", "model_version")


def lb_histories(spark: SparkSession, d: str) -> DataFrame:
    """The history of every hash, its generations numbered in order."""
    return lb.histories(_t(spark, d, "generations")).select("key", F.col("place").cast("long").alias("place"), "moment", "id", "generated_at", "model_version")


def lb_newest_specs(spark: SparkSession, d: str) -> DataFrame:
    return lb.newest_specs(_t(spark, d, "strategies")).select("archetype", F.col("place").cast("long").alias("place"), "strategy_id", "key", F.md5("spec_json").alias("spec_md5"))


def _summary(spark: SparkSession, d: str, **only: str) -> DataFrame:
    r = lb.archetype_summary(_t(spark, d, "strategies"), _t(spark, d, "generations"), _t(spark, d, "evaluations"), **only)
    by_status = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.withColumns({"by_status": by_status, "total_cost": F.round("total_cost", 6), "median_score": F.round("median_score", 6)})


def lb_archetypes(spark: SparkSession, d: str) -> DataFrame:
    """All that is known of each archetype."""
    return _summary(spark, d)


def lb_archetypes_5m_since(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, timeframe="5m", since="2022-06-01T00:00:00.000000Z")


def lb_regated(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds that each fast evaluation misses, worked out anew."""
    return lb.regated(_t(spark, d, "evaluations")).select("id", "promising", F.array_join("names", ",").alias("missed"))


def lb_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the documents in the generation logs, or why there is none."""
    return lb.recovered_logs(_t(spark, d, "generation_logs")).select("path", "name", "strategy_hash", "reason")


def lb_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What a scan of the generation logs would add to the generations, and what it skips."""
    known = lb.dated(_t(spark, d, "generations"), "generated_at").where("key is not null and moment is not null").select("strategy_hash", "moment", "prompt_hash")
    added, skipped = lb.backfill_generations(_t(spark, d, "generation_logs"), known)
    return added.select("path", F.lit(None).cast("string").alias("reason")).unionByName(skipped)


def lb_status(spark: SparkSession, d: str) -> DataFrame:
    return lb.status_histogram(_t(spark, d, "strategies"))


def lb_generations(spark: SparkSession, d: str) -> DataFrame:
    return lb.generation_rollup(_t(spark, d, "generations")).withColumn("total_cost", F.round("total_cost", 6))


def lb_generations_5m(spark: SparkSession, d: str) -> DataFrame:
    r = lb.generation_rollup(_t(spark, d, "generations"), _t(spark, d, "strategies"), "5m")
    return r.withColumn("total_cost", F.round("total_cost", 6))


def lb_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return lb.evaluation_rollup(_t(spark, d, "evaluations"))


def lb_median(spark: SparkSession, d: str) -> DataFrame:
    return lb.median_score(_t(spark, d, "evaluations"), _t(spark, d, "strategies")).withColumn("median_score", F.round("median_score", 6))


def lb_quirks(spark: SparkSession, d: str) -> DataFrame:
    return lb.quirk_trend(_t(spark, d, "generations"), "2022-03-31", 60).withColumn("day", F.col("day").cast("string"))


def lb_cohort(spark: SparkSession, d: str) -> DataFrame:
    c = lb.cohort(_t(spark, d, "evaluations"), _t(spark, d, "strategies"), least_ci=0.5, least_trades=30, basket=BASKET)
    return c.withColumn("best_ci", F.round("best_ci", 6))


def lb_derived(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "strategies").select("strategy_hash", F.col("first_generated_at").alias("generated_at"), F.col("strategy_id").alias("id"), "name", "spec_json")
    return lb.merge_generations(ev).select("strategy_hash", F.unix_micros("first_generated_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "generation_count", "name", F.md5("spec_json").alias("spec_md5"))


def lb_unknown(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "evaluations").select("id", "strategy_hash", "eval_type", "evaluated_at", "batch_no")
    return lb.unknown_rows(e.where("batch_no > 8"), e.where("batch_no <= 8"), ["strategy_hash", "eval_type", "evaluated_at"])


def lb_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return lb.reconcile(_t(spark, d, "evaluations"))


def lb_newest_log(spark: SparkSession, d: str) -> DataFrame:
    r = lb.newest_log(_t(spark, d, "evaluations"), _t(spark, d, "generation_logs"))
    return r.withColumn("log_id", F.coalesce("log_id", F.lit(-1)))


def lb_newest_log_aliases(spark: SparkSession, d: str) -> DataFrame:
    """lb_newest_log with the name under any alias that p4_config reads it from."""
    names = next(paths for name, _, paths in drift.CONFIG_ALIASES if name == "strategy")
    r = lb.newest_log(_t(spark, d, "evaluations"), _t(spark, d, "generation_logs"), names)
    return r.withColumn("log_id", F.coalesce("log_id", F.lit(-1)))


def lb_monthly_cost(spark: SparkSession, d: str) -> DataFrame:
    return lb.monthly_cost(_t(spark, d, "generations")).withColumn("cost", F.round("cost", 6))


def lb_baskets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.basket_hash(_t(spark, d, "bars_5m"), ["asset_class"])


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("lb_")}

_KEY = "trim(regexp_replace(lower(trim({}strategy_hash)), '^sha256:', ''))"
_NAME = "regexp_replace(lower(trim({}archetype)), '[\\s-]+', '_', 'g')"
_AT = "CASE WHEN regexp_matches(instant, '^[0-9]') THEN instant END AS moment"
_E = f"""WITH {stamps("es", "evaluations", "evaluated_at", "recorded_zone")}, e AS (SELECT *, {_KEY.format("")} AS key, {_AT} FROM es)"""
_G = f"""WITH {stamps("gs", "generations", "generated_at", "recorded_zone")}, g AS (SELECT *, {_KEY.format("")} AS key, {_AT} FROM gs)"""
_S = f"""s AS (SELECT *, {_KEY.format("")} AS key, {_NAME.format("")} AS arch FROM strategies WHERE strategy_hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_KEY.format("")} ORDER BY batch_no, strategy_id) = 1)"""
_BEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY {}) = 1"
_LATEST = "moment DESC NULLS LAST, id DESC"
_RANK = "list_position(['fast', 'canonical', 'holdout'], eval_type)"
_SOME = f"(SELECT {_KEY.format('')} FROM generations WHERE strategy_hash IS NOT NULL ORDER BY id LIMIT 1)"
_ROLLUP = (
    "count(*) AS n_generations, round(sum(cost_usd), 6) AS total_cost, CAST(sum(stringification_firings) AS BIGINT) AS stringification_firings, "
    "CAST(sum(kwarg_validator_firings) AS BIGINT) AS kwarg_validator_firings, CAST(sum(unreachable_default_firings) AS BIGINT) AS unreachable_default_firings"
)
_REAL = "{0} IS NOT NULL AND {0}::VARCHAR <> 'nan'"


def _summary_sql(timeframe: str | None, since: str | None) -> str:
    frame = f"timeframe = '{timeframe}'" if timeframe else "TRUE"
    after = f">= '{since}'" if since else "IS NOT DISTINCT FROM moment"
    born = f"strftime(make_timestamp(epoch_us(first_generated_at)), '%Y-%m-%dT%H:%M:%S.%fZ') >= '{since}'" if since else "TRUE"
    kept = "key IN (SELECT key FROM own)" if timeframe else "TRUE"
    counts = ["n_strategies", "n_generations", "stringification_firings", "kwarg_validator_firings", "unreachable_default_firings", "n_fast", "promising_fast", "n_canonical", "promising_canonical", "n_holdout", "promising_holdout"]
    return f"""{_E}, {_G.replace("WITH ", "", 1)}, {_S},
own AS (SELECT key, arch FROM s WHERE {frame}),
st AS (SELECT arch, sum(n) AS n_strategies, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status FROM (
  SELECT arch, coalesce(status, 'none') AS status, count(*) AS n FROM s WHERE {frame} AND {born} GROUP BY 1, 2) GROUP BY 1),
ge AS (SELECT {_NAME.format("")} AS arch, {_ROLLUP} FROM g WHERE moment {after} AND {kept} GROUP BY 1),
ev AS (SELECT arch, count(*) FILTER (eval_type = 'fast') AS n_fast, sum(promising) FILTER (eval_type = 'fast') AS promising_fast, count(*) FILTER (eval_type = 'canonical') AS n_canonical,
  sum(promising) FILTER (eval_type = 'canonical') AS promising_canonical, count(*) FILTER (eval_type = 'holdout') AS n_holdout, sum(promising) FILTER (eval_type = 'holdout') AS promising_holdout,
  round(median(score) FILTER ({_REAL.format("score")} AND NOT isinf(score)), 6) AS median_score FROM e JOIN own USING (key) WHERE moment {after} GROUP BY 1),
names AS (SELECT arch FROM st UNION SELECT arch FROM ge)
SELECT names.arch AS archetype, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in counts)}, by_status, total_cost, median_score
FROM names LEFT JOIN st ON st.arch IS NOT DISTINCT FROM names.arch LEFT JOIN ge ON ge.arch IS NOT DISTINCT FROM names.arch LEFT JOIN ev ON ev.arch IS NOT DISTINCT FROM names.arch"""


def _missed(name: str, column: str, bad: str, if_null: str) -> str:
    return f"CASE WHEN CASE WHEN {column} IS NULL THEN {if_null} WHEN {column}::VARCHAR = 'nan' THEN TRUE ELSE {bad} END THEN '{name}' END"


SQL = {
    "lb_latest": f"{_E} SELECT key, moment, strategy_hash, id, eval_type, evaluated_at, round(median_pf, 6) AS median_pf FROM e {_BEST.format(_LATEST)}",
    "lb_promising": f"""{_E}, l AS (SELECT * FROM (SELECT * FROM e {_BEST.format(_LATEST)}) WHERE promising = 1)
SELECT s.strategy_id, l.key, moment, l.eval_type, l.evaluated_at, l.score, l.ci_lower, l.basket_version FROM strategies s JOIN l ON l.key = {_KEY.format("s.")}""",
    "lb_authoritative": f"{_E} SELECT key, moment, id, eval_type, evaluated_at FROM e {_BEST.format(_RANK + ' DESC NULLS LAST, ' + _LATEST)}",
    "lb_strategy": f"SELECT strategy_id, name, archetype, status, generation_count FROM strategies WHERE {_KEY.format('')} = {_SOME}",
    "lb_newest_specs": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY arch ORDER BY first_generated_at DESC NULLS LAST, strategy_id DESC) AS place FROM s)
SELECT arch AS archetype, place, strategy_id, key, md5(spec_json) AS spec_md5 FROM r WHERE place <= 5""",
    "lb_archetypes": _summary_sql(None, None),
    "lb_archetypes_5m_since": _summary_sql("5m", "2022-06-01T00:00:00.000000Z"),
    "lb_regated": f"""WITH x AS (SELECT id, concat_ws(',', {_missed("score", "score", "score <= 1.5", "TRUE")}, {_missed("median_pf", "median_pf", "median_pf <= 1.2", "TRUE")},
  {_missed("ci_lower", "ci_lower", "ci_lower <= 1.0", "FALSE")}, {_missed("n_oos_trades_total", "n_oos_trades", "n_oos_trades < 30", "TRUE")}) AS missed FROM evaluations WHERE eval_type = 'fast')
SELECT id, CAST(missed = '' AS INT) AS promising, missed FROM x""",
    "lb_list": "SELECT strategy_id, strategy_hash, name, status, generation_count FROM strategies WHERE archetype = 'momentum' ORDER BY last_seen_at DESC NULLS LAST, strategy_id DESC LIMIT 50",
    "lb_prefix": "SELECT strategy_id, strategy_hash FROM strategies WHERE starts_with(strategy_hash, '4f53cd') ORDER BY strategy_hash, strategy_id LIMIT 11",
    "lb_history": f"{_G} SELECT id, moment, generated_at, model_version FROM g WHERE key = {_SOME}",
    "lb_histories": f"{_G} SELECT key, row_number() OVER (PARTITION BY key ORDER BY moment NULLS FIRST, id) AS place, moment, id, generated_at, model_version FROM g WHERE key IS NOT NULL",
    "lb_status": "SELECT status, count(*) AS n FROM strategies GROUP BY 1",
    "lb_generations": f"SELECT archetype, {_ROLLUP} FROM generations GROUP BY 1",
    "lb_generations_5m": f"SELECT archetype, {_ROLLUP} FROM generations WHERE {_KEY.format('')} IN (SELECT {_KEY.format('')} FROM strategies WHERE timeframe = '5m') GROUP BY 1",
    "lb_evaluations": "SELECT t.eval_type, coalesce(n, 0) AS n, CAST(coalesce(p, 0) AS BIGINT) AS n_promising FROM (VALUES ('fast'), ('canonical'), ('holdout')) t(eval_type) LEFT JOIN (SELECT eval_type, count(*) AS n, sum(promising) AS p FROM evaluations GROUP BY 1) USING (eval_type)",
    "lb_median": f"""WITH {_S} SELECT arch AS archetype, round(median(score), 6) AS median_score FROM (SELECT *, {_KEY.format("")} AS key FROM evaluations) JOIN s USING (key)
WHERE {_REAL.format("score")} AND NOT isinf(score) GROUP BY 1""",
    "lb_quirks": f"""{_G}, n AS (SELECT substring(moment, 1, 10) AS day, sum(coalesce(stringification_firings, 0) + coalesce(kwarg_validator_firings, 0) + coalesce(unreachable_default_firings, 0)) AS n FROM g GROUP BY 1)
SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n_firings FROM (SELECT unnest(generate_series(DATE '2022-03-31' - INTERVAL 59 DAY, DATE '2022-03-31', INTERVAL 1 DAY)) AS day) d
LEFT JOIN n ON n.day = CAST(CAST(d.day AS DATE) AS VARCHAR)""",
    "lb_cohort": f"""SELECT {_KEY.format("")} AS key, round(max(ci_lower) FILTER ({_REAL.format("ci_lower")}), 6) AS best_ci, max(n_oos_trades) AS best_n FROM evaluations
WHERE {_KEY.format("")} IN (SELECT {_KEY.format("")} FROM strategies) GROUP BY 1
HAVING max(ci_lower) FILTER ({_REAL.format("ci_lower")}) >= 0.5 AND max(n_oos_trades) >= 30 AND count(*) FILTER (basket_version = '{BASKET}') = 0""",
    "lb_derived": f"""SELECT {_KEY.format("")} AS strategy_hash, epoch_us(min(first_generated_at)) AS first_us, epoch_us(max(first_generated_at)) AS last_us, count(*) AS generation_count,
  arg_max(name, (first_generated_at, strategy_id)) AS name, md5(arg_max(spec_json, (first_generated_at, strategy_id))) AS spec_md5 FROM strategies GROUP BY 1""",
    "lb_unknown": """SELECT id, strategy_hash, eval_type, evaluated_at, batch_no FROM evaluations a WHERE batch_no > 8 AND NOT EXISTS (SELECT 1 FROM evaluations b WHERE b.batch_no <= 8
  AND a.strategy_hash IS NOT DISTINCT FROM b.strategy_hash AND a.eval_type IS NOT DISTINCT FROM b.eval_type AND a.evaluated_at IS NOT DISTINCT FROM b.evaluated_at)""",
    "lb_reconcile": """WITH x AS (SELECT id, promising AS was, CAST(coalesce(score::VARCHAR <> 'nan' AND score > 1.5, FALSE) AND coalesce(median_pf::VARCHAR <> 'nan' AND median_pf > 1.2, FALSE)
  AND (ci_lower IS NULL OR (ci_lower::VARCHAR <> 'nan' AND ci_lower > 1.0)) AND coalesce(n_oos_trades >= 30, FALSE) AS INT) AS now FROM evaluations WHERE eval_type = 'fast')
SELECT * FROM x WHERE was IS DISTINCT FROM now""",
    "lb_newest_log": """WITH l AS (SELECT json_extract(raw_tool_input, '$.name') AS name, arg_max(log_id, (timestamp, log_id)) AS log_id FROM (SELECT * FROM generation_logs WHERE raw_tool_input IS NOT NULL AND json_valid(raw_tool_input)) GROUP BY 1),
e AS (SELECT id, CASE WHEN json_valid(config_json) THEN json_extract(config_json, '$.strategy') END AS name FROM evaluations)
SELECT id, coalesce(log_id, -1) AS log_id FROM e LEFT JOIN l USING (name)""",
    "lb_newest_log_aliases": """WITH l AS (SELECT json_extract(raw_tool_input, '$.name') AS name, arg_max(log_id, (timestamp, log_id)) AS log_id FROM (SELECT * FROM generation_logs WHERE raw_tool_input IS NOT NULL AND json_valid(raw_tool_input)) GROUP BY 1),
e AS (SELECT id, CASE WHEN json_valid(config_json) THEN coalesce(json_extract(config_json, '$.strategy'), json_extract(config_json, '$.strategy_name')) END AS name FROM evaluations)
SELECT id, coalesce(log_id, -1) AS log_id FROM e LEFT JOIN l USING (name)""",
    "lb_monthly_cost": f"{_G} SELECT coalesce(substring(moment, 1, 7), 'undated') AS month, round(sum(cost_usd), 6) AS cost, count(*) AS n FROM g GROUP BY 1",
    "lb_baskets": "SELECT asset_class, substring(sha256(string_agg(DISTINCT symbol, ',' ORDER BY symbol)), 1, 12) AS basket_hash, count(DISTINCT symbol) AS n_symbols FROM bars_5m GROUP BY 1",
}
