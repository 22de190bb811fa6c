"""Registered queries of the data-quality operators, over whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, gridding, instants, orphans, spikes
from tidemark.plans.stamps_sql import stamps
from tidemark.session import table


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(table(spark, d, "bars_5m"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).where("verified").select("bar_id").distinct()


def _misses(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return orphans.hash_and_path_orphans(t("evaluations"), t("generations"), t("strategies"), t("generation_logs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _misses(spark, d).select("src", "row_id", "field").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_misses(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.all_changes(table(spark, d, "evaluations"), table(spark, d, "generation_logs")).distinct()


def p4_config(spark: SparkSession, d: str) -> DataFrame:
    return drift.config_table(table(spark, d, "evaluations"))


def p4_gates(spark: SparkSession, d: str) -> DataFrame:
    return drift.gates_table(table(spark, d, "evaluations"))


def p4_tool(spark: SparkSession, d: str) -> DataFrame:
    return drift.tool_table(table(spark, d, "generation_logs"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return gridding.to_grid(table(spark, d, "bars_5m"), table(spark, d, "sessions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_grid(spark, d).where("n_readings = 0").select("feed", "symbol", "slot")


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return instants.all_stamps(t("raw_bars_5m"), t("generations"), t("evaluations"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.to_normalise(_stamps(spark, d)).distinct()


def p7_formats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("instant").rlike("^[0-9]"), "instant").otherwise(F.col("instant"))
    return _stamps(spark, d).groupBy("src", "format", kind.alias("outcome")).agg(F.count("*").alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_flags, p2_found, p2_report, p4_found, p4_config, p4_gates, p4_tool, p5_found, p5_grid, p7_found, p7_formats)
}

_HASH = "trim(regexp_replace(lower(trim(strategy_hash)), '^sha256:', ''))"
_NAME = r"trim(regexp_extract(trim({}), '([^/\\]*)$', 1))"
_ORPHANS = f"""
WITH p AS (
  SELECT 's:' || {_HASH} AS k, batch_no AS b, removed_in_batch AS r, strategy_id AS i FROM strategies
  UNION ALL SELECT 'l:' || {_NAME.format("path")}, batch_no, removed_in_batch, log_id FROM generation_logs),
first_of AS (
  SELECT k, b AS first_b, r AS gone FROM p WHERE k IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY b NULLS FIRST, i) = 1),
refs AS (
  SELECT 'evaluations' AS src, id AS row_id, 'strategy_hash' AS field, 's:' || {_HASH} AS k, batch_no FROM evaluations
  UNION ALL SELECT 'generations', id, 'strategy_hash', 's:' || {_HASH}, batch_no FROM generations
  UNION ALL SELECT 'generations', id, 'raw_response_path', 'l:' || {_NAME.format("raw_response_path")}, batch_no FROM generations),
misses AS (
  SELECT src, row_id, field, batch_no,
    CASE WHEN f.k IS NULL THEN 'missing' WHEN first_b > batch_no THEN 'later' WHEN gone <= batch_no THEN 'removed' END AS reason
  FROM refs LEFT JOIN first_of f USING (k) WHERE refs.k IS NOT NULL)
"""

_TARGET = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00"
_STAMPS = f"""
WITH stamped AS (
  SELECT 'raw_bars_5m' AS src, raw_id AS row_id, time AS stamp, zone FROM raw_bars_5m
  UNION ALL SELECT 'generations', id, generated_at, recorded_zone FROM generations
  UNION ALL SELECT 'evaluations', id, evaluated_at, recorded_zone FROM evaluations),
{stamps("read", "stamped", "stamp", "zone")}
"""

_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END"
_IN = "json_extract({0}, '$.\"' || {1} || '\"')"


def _changes(field: str, tab: str, paths: str) -> str:
    """CTEs and the changes of one JSON column: each file compared with the one before it, as sets."""
    f = field
    return f"""
{f}_v AS (SELECT stream, file_no, {field}::JSON AS j FROM {tab} WHERE file_no IS NOT NULL AND json_valid({field})),
{f}_f AS (SELECT stream, file_no, lag(file_no) OVER (PARTITION BY stream ORDER BY file_no) AS prev FROM (SELECT DISTINCT stream, file_no FROM {f}_v)),
{f}_p AS (SELECT stream, file_no, path, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types FROM ({paths.replace("ROWS_", f + "_v")}) GROUP BY 1, 2, 3),
{f}_c AS (SELECT '{field}' AS field, f.stream, f.file_no, path, max(types) FILTER (own) AS now, max(types) FILTER (NOT own) AS was, bool_or(own) AS here, bool_or(NOT own) AS there
  FROM {f}_f f JOIN (SELECT stream, file_no, path, types, TRUE AS own FROM {f}_p UNION ALL SELECT n.stream, n.file_no, path, types, FALSE FROM {f}_f n JOIN {f}_p p ON p.stream IS NOT DISTINCT FROM n.stream AND p.file_no = n.prev) x
    ON x.stream IS NOT DISTINCT FROM f.stream AND x.file_no = f.file_no WHERE f.prev IS NOT NULL GROUP BY ALL)"""


def _objects(source: str, value: str, prefix: str) -> str:
    """(stream, file_no, path, member) of the objects among the values of a source."""
    return f"""(SELECT stream, file_no, {prefix} || k AS path, {_IN.format(value, "k")} AS x FROM (
  SELECT *, unnest(json_keys({value})) AS k FROM {source} WHERE json_type({value}) = 'OBJECT'))"""


def _elements(source: str, value: str) -> str:
    return f"(SELECT * EXCLUDE ({value}), unnest(json_extract({value}, '$[*]')) AS {value} FROM {source} WHERE json_type({value}) = 'ARRAY')"


_TOP = _objects("ROWS_", "j", "''")
_ROW = f"SELECT stream, file_no, path, {_KIND.format('x')} AS t FROM "
_CONFIG_PATHS = _ROW + _TOP + " UNION ALL " + _ROW + _objects(_TOP, "x", "path || '.'")
_TOOL_PATHS = _ROW + _TOP + " UNION ALL " + _ROW + _objects(_elements(_TOP, "x"), "x", "path || '[].'")
_GATE_PATHS = f"SELECT stream, file_no, '[]' AS path, {_KIND.format('j')} AS t FROM " + _elements("ROWS_", "j") + " UNION ALL " + _ROW + _objects(_elements("ROWS_", "j"), "j", "'[].'")
_DRIFT = f"""WITH {_changes("config_json", "evaluations", _CONFIG_PATHS)}, {_changes("failed_gates", "evaluations", _GATE_PATHS)}, {_changes("raw_tool_input", "generation_logs", _TOOL_PATHS)},
everything AS (SELECT * FROM config_json_c UNION ALL SELECT * FROM failed_gates_c UNION ALL SELECT * FROM raw_tool_input_c)
SELECT DISTINCT field, stream, file_no, path AS json_path, CASE WHEN NOT there THEN 'added' WHEN NOT here THEN 'removed' ELSE 'retyped' END AS change FROM everything
WHERE NOT there OR NOT here OR (now <> '' AND was <> '' AND now <> was)"""

# readings beyond the limits of the statement; a close is off if it departs, alone or with up to two neighbours, from the closes around
_GROUP = lambda k, i: f"""(least({', '.join(f'lead(c, {j}) OVER w' if j > 0 else f'lag(c, {-j}) OVER w' if j < 0 else 'c' for j in range(-i, k - i))}) - greatest(lag(c, {i + 1}) OVER w, lead(c, {k - i}) OVER w) > lim
    OR least(lag(c, {i + 1}) OVER w, lead(c, {k - i}) OVER w) - greatest({', '.join(f'lead(c, {j}) OVER w' if j > 0 else f'lag(c, {-j}) OVER w' if j < 0 else 'c' for j in range(-i, k - i))}) > lim)"""  # noqa: E731
_BOTH = lambda k, i: f"(lag(c, {i + 1}) OVER w IS NOT NULL AND lead(c, {k - i}) OVER w IS NOT NULL AND {_GROUP(k, i)})"
_RUNS = lambda c: f"""
{c}_t AS (SELECT DISTINCT feed, time, CAST(time AT TIME ZONE 'UTC' AS DATE) AS day, {c} AS x FROM b WHERE {c} IS NOT NULL AND time IS NOT NULL),
{c}_n AS (SELECT *, dense_rank() OVER (PARTITION BY feed, day ORDER BY time) AS n FROM {c}_t),
{c}_g AS (SELECT *, n - row_number() OVER (PARTITION BY feed, day, x ORDER BY n) AS g FROM {c}_n WHERE x::VARCHAR <> 'nan'),
{c}_r AS (SELECT feed, time, x FROM {c}_g QUALIFY count(*) OVER (PARTITION BY feed, day, x, g) >= 8)"""  # noqa: E731
_SPIKES = f"""WITH b AS (SELECT bar_id, coalesce('f' || feed, '-') AS feed, time, load_no, high, low, close, volume, close::VARCHAR = 'nan' AS close_nan, volume::VARCHAR = 'nan' AS volume_nan, high::VARCHAR = 'nan' AS high_nan, low::VARCHAR = 'nan' AS low_nan FROM bars_5m),
reps AS (SELECT feed, time, close AS c FROM b WHERE time IS NOT NULL AND close > 0 AND NOT close_nan AND NOT isinf(close) AND (high IS NULL OR high_nan OR close <= high) AND (low IS NULL OR low_nan OR close >= low)
  QUALIFY row_number() OVER (PARTITION BY feed, time ORDER BY load_no DESC, bar_id DESC) = 1),
steps AS (SELECT feed, abs(c - lag(c) OVER (PARTITION BY feed ORDER BY time)) AS d FROM reps),
lims AS (SELECT feed, 10 * median(d) AS lim FROM steps GROUP BY 1),
vols AS (SELECT feed, 20 * median(volume) AS most FROM b WHERE volume IS NOT NULL AND NOT volume_nan AND NOT isinf(volume) GROUP BY 1),
normal AS (SELECT feed, time, c FROM (SELECT feed, time, c, {' OR '.join(_BOTH(k, i) for k in (1, 2, 3) for i in range(k))} AS off FROM reps JOIN lims USING (feed) WINDOW w AS (PARTITION BY feed ORDER BY time)) WHERE NOT coalesce(off, FALSE)),
before AS (SELECT b.bar_id, p.c AS pc FROM b ASOF JOIN normal p ON p.feed = b.feed AND b.time > p.time),
after AS (SELECT b.bar_id, p.c AS nc FROM b ASOF JOIN normal p ON p.feed = b.feed AND b.time < p.time),{_RUNS("close")},{_RUNS("volume")}
SELECT DISTINCT bar_id FROM b LEFT JOIN lims USING (feed) LEFT JOIN vols USING (feed) LEFT JOIN before USING (bar_id) LEFT JOIN after USING (bar_id)
WHERE (NOT high_nan AND NOT low_nan AND high < low) OR close_nan OR volume_nan OR volume < 0 OR (NOT close_nan AND (close <= 0 OR (NOT low_nan AND close < low) OR (NOT high_nan AND close > high))) OR (NOT low_nan AND low <= 0) OR (NOT volume_nan AND volume > most)
  OR {' OR '.join(f"({x} IS NOT NULL AND NOT {x}_nan AND pc IS NOT NULL AND nc IS NOT NULL AND ({x} - greatest(pc, nc) > lim OR least(pc, nc) - {x} > lim))" for x in ("high", "low", "close"))}
  OR EXISTS (SELECT 1 FROM close_r r WHERE r.feed = b.feed AND r.time = b.time AND r.x = b.close) OR EXISTS (SELECT 1 FROM volume_r r WHERE r.feed = b.feed AND r.time = b.time AND r.x = b.volume)"""

SQL = {
    "p1_found": _SPIKES,
    "p4_found": _DRIFT,
    "p7_found": _STAMPS + f"SELECT DISTINCT src, row_id, instant FROM read WHERE stamp IS NOT NULL AND NOT regexp_full_match(stamp, '{_TARGET}')",
    "p7_formats": _STAMPS + r"""SELECT src, format, CASE WHEN regexp_matches(instant, '^[0-9]') THEN 'instant' ELSE instant END AS outcome, count(*) AS n_rows FROM (SELECT *, CASE
  WHEN epoch_ IS NOT NULL THEN 'epoch' WHEN num_ IS NOT NULL THEN NULL WHEN regexp_matches(s_, '^\d{4}-\d{2}-\d{2}[T ]') THEN 'iso' WHEN regexp_matches(s_, '^\d{1,2}\.\d{1,2}\.\d{4} ') THEN 'dots'
  WHEN regexp_matches(s_, '^\d{1,2}/\d{1,2}/\d{4} ') THEN 'slashes' WHEN regexp_matches(s_, '^\d{1,2}/\d{1,2}/\d{2} ') THEN 'short_slashes' WHEN regexp_matches(s_, '^\d{8}[_T]\d{6}') THEN 'compact'
  WHEN regexp_matches(s_, '^([A-Z][a-z]{2}, )?\d{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} ') THEN 'named' END AS format FROM read) GROUP BY ALL""",
    "p2_found": _ORPHANS + "SELECT DISTINCT src, row_id, field FROM misses WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS + "SELECT src, field, batch_no, reason, count(*) AS n_rows FROM misses WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": """
WITH b AS (SELECT feed, symbol, asset_class, CAST(floor(epoch_us(time) / 300000000.0) AS BIGINT) * 300 AS slot, close FROM bars_5m),
f AS (SELECT feed, symbol, asset_class, min(slot) AS a, max(slot) AS z FROM b GROUP BY ALL),
grid AS (
  SELECT feed, symbol, unnest(generate_series(a, z, 300)) AS slot FROM f WHERE asset_class <> 'stocks'
  UNION ALL
  SELECT feed, symbol, slot FROM f JOIN (
    SELECT unnest(generate_series(CAST(epoch(opens_at) AS BIGINT), CAST(epoch(closes_at) AS BIGINT) - 1, 300)) AS slot FROM sessions)
  ON slot BETWEEN a AND z WHERE asset_class = 'stocks')
SELECT feed, symbol, slot FROM grid ANTI JOIN (SELECT feed, symbol, slot FROM b WHERE close IS NOT NULL) USING (feed, symbol, slot)""",
}
