"""Registered queries of the training-corpus operators, over whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, leaks, percentiles, pivots, splitting
from tidemark.session import table

ACCURACY = 0.01
PERCENTILES = [0.5, 0.9, 0.99]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = pivots.in_batches(table(spark, d, "strategies")).select(F.lit("strategies").alias("src"), "id_a", "id_b")
    again = pivots.repeated_keys(table(spark, d, "generations"), "id", "prompt_hash")
    return near.unionByName(again.select(F.lit("generations").alias("src"), "id_a", "id_b"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return pivots.strategy_links(table(spark, d, "strategies"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    sk = percentiles.evaluation_sketch(table(spark, d, "evaluations"), table(spark, d, "strategies"), accuracy=ACCURACY)
    return _digits(percentiles.percentiles(sk, ["archetype"], PERCENTILES, ACCURACY))


def _digits(df: DataFrame) -> DataFrame:
    """Values to twelve significant digits: engines differ in the last one of a power."""
    return df.withColumn("value", F.format_string("%.11e", "value").cast("double"))


def p6_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of the streams, combined again: the same percentiles as from all rows at once."""
    sk = percentiles.evaluation_sketch(table(spark, d, "evaluations"), table(spark, d, "strategies"), ["stream"], ACCURACY)
    return _digits(percentiles.percentiles(percentiles.merge(sk.drop("stream"), keys=["archetype"]), ["archetype"], PERCENTILES, ACCURACY))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where("longest_run >= 15").select("item_id", "doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 1").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_links, p6_percentiles, p6_by_stream, p8_ids, p9_found, p9_leaks, p10_found, p10_pieces)}

_G, _AT = repr(percentiles.base(ACCURACY)), percentiles.origin(ACCURACY)
_KEY = "trim(regexp_replace(lower(trim(strategy_hash)), '^sha256:', ''))"
_PERCENTILES = f"""
WITH a AS (
  SELECT {_KEY} AS key, regexp_replace(lower(trim(archetype)), '[\\s-]+', '_', 'g') AS archetype
  FROM strategies WHERE strategy_hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY batch_no, strategy_id) = 1),
v AS (
  SELECT coalesce(archetype, 'unknown') AS archetype, metric, v FROM (
    SELECT {_KEY} AS key, 'score' AS metric, score AS v FROM evaluations
    UNION ALL SELECT {_KEY}, 'median_pf', median_pf FROM evaluations) LEFT JOIN a USING (key)
  WHERE v IS NOT NULL AND v::VARCHAR <> 'nan' AND NOT isinf(v)),
s AS (
  SELECT archetype, metric,
    CASE WHEN v = 0 THEN 0 ELSE sign(v) * ({_AT} + CAST(ceil(ln(abs(v)) / ln({_G})) AS INT)) END AS bucket,
    n_values, p
  FROM (SELECT archetype, metric, v, count(*) OVER (PARTITION BY archetype, metric) AS n_values FROM v),
    (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS t(p)),
b AS (SELECT archetype, metric, n_values, p, bucket, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY archetype, metric, p ORDER BY bucket) AS upto FROM b)
SELECT archetype, metric, n_values, p,
  CAST(format('{{:.11e}}', CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * 2 * {_G} / ({_G} + 1) * pow({_G}, abs(bucket) - {_AT + 1}) END) AS DOUBLE) AS value
FROM c WHERE upto > floor(p * (n_values - 1)) AND upto - n <= floor(p * (n_values - 1))"""

_WORDS = "string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_LEAKS = f"""
WITH i AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
gi AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 13)) AS k FROM i WHERE len(w) >= 15)),
gd AS (SELECT doc_id, array_to_string(w[k:k + 14], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 13)) AS k FROM d WHERE len(w) >= 15))
SELECT DISTINCT item_id, doc_id FROM gd JOIN gi USING (g)"""

SQL = {"p9_found": _LEAKS, "p6_percentiles": _PERCENTILES, "p6_by_stream": _PERCENTILES}
