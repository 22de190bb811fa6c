"""References to records that are missing, arrive later or were removed.

Parents and references are spread by the range of a 64-bit key hash.  Each range
keeps its parents as one sorted array; reference batches probe it by vectorised
binary search.  Ranges with many references (a hot key) are salted: their
references are dealt to several groups, each with its own copy of the range's
parents, whose number per range is bounded by the number of ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("missing", "later", "removed")
MISSES = "src string, row_id long, field string, batch_no int, reason string"


def hash_key(c: Column | str) -> Column:
    """A hash without case, outer blanks and a leading ``sha256:``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "^sha256:", ""))


def path_key(c: Column | str) -> Column:
    """The last name of a path, split at slashes or backslashes, without outer blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_extract(F.trim(c), r"([^/\\]*)$", 1))


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    h, keys = refs.column("h").to_numpy(), refs.column("key")
    ph = parents.column("h").to_numpy()
    order = np.argsort(ph, kind="stable")
    ph = ph[order]
    pkey = np.array(parents.column("key").to_pylist(), dtype=object)[order]
    first = parents.column("first_batch").to_numpy(zero_copy_only=False).astype(float)[order]
    gone = parents.column("removed").to_numpy(zero_copy_only=False).astype(float)[order]
    at = np.searchsorted(ph, h, side="left")
    to = np.searchsorted(ph, h, side="right")
    key = np.array(keys.to_pylist(), dtype=object)
    found = at < to
    same = np.zeros(len(h), dtype=bool)
    same[found] = pkey[at[found]] == key[found]
    for i in np.flatnonzero(found & ~same):  # two keys with one hash
        for j in range(at[i] + 1, to[i]):
            if pkey[j] == key[i]:
                at[i], same[i] = j, True
    batch = refs.column("batch_no").to_numpy(zero_copy_only=False).astype(float)
    late, removed = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    with np.errstate(invalid="ignore"):
        late[same] = first[at[same]] > batch[same]
        removed[same] = gone[at[same]] <= batch[same]
    code = np.where(~same, 0, np.where(late, 1, np.where(removed, 2, 3)))
    rows = np.flatnonzero(code < 3)
    return refs.select(["src", "row_id", "field", "batch_no"]).take(pa.array(rows)).append_column(
        "reason", pa.array(np.array(REASONS, dtype=object)[code[rows]].tolist(), pa.string())
    )


def orphans(refs: DataFrame, parents: DataFrame, *, rows_per_group: int = 200_000) -> DataFrame:
    """References that do not hold at their batch (src, row_id, field, batch_no, reason).

    refs: src, row_id, field, space, key, batch_no; parents: space, key, row_id,
    batch_no, removed_in_batch.  ``space`` names the referenced table.  Of several
    parents with a key, the earliest (by batch, then row_id) counts.  A null
    reference is no reference; an empty one refers to nothing unless a parent's key
    is empty; a null batch on either side is no reason; parents without key or an empty
    parents' table leave every reference missing.  Repeated rows are reported each.
    """
    spaced = lambda d: d.where(F.col("key").isNotNull()).withColumn("key", F.concat_ws(":", "space", "key"))
    p = (
        spaced(parents)
        .groupBy("key")
        .agg(F.min_by(F.struct("batch_no", "removed_in_batch"), F.struct(F.coalesce("batch_no", F.lit(-(2**31))), "row_id")).alias("e"))
        .select("key", F.xxhash64("key").alias("h"), F.col("e.batch_no").cast("int").alias("first_batch"), F.col("e.removed_in_batch").cast("int").alias("removed"))
    )
    r = spaced(refs).select("src", F.col("row_id").cast("long").alias("row_id"), "field", "key", F.xxhash64("key").alias("h"), F.col("batch_no").cast("int").alias("batch_no"))
    spark = refs.sparkSession
    n = parents.count()
    bits = max(4, math.ceil(math.log2(max(1, n / rows_per_group, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    bucket = F.shiftrightunsigned("h", 64 - bits).cast("int").alias("bucket")
    r, p = r.withColumn("bucket", bucket), p.withColumn("bucket", bucket)
    salts = r.groupBy("bucket").agg(F.ceil(F.count("*") / rows_per_group).cast("int").alias("salts"))
    salts = salts.where("salts > 1")  # at most one row per range
    r = r.join(salts, "bucket", "left").withColumn("salt", F.pmod(F.hash("src", "field", "row_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    p = p.join(salts, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return r.groupBy("bucket", "salt").cogroup(p.groupBy("bucket", "salt")).applyInArrow(_probe, MISSES)


def orphan_report(misses: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, batch and reason."""
    return misses.groupBy("src", "field", "batch_no", "reason").agg(F.count("*").alias("n_rows"))


def hash_and_path_orphans(evaluations: DataFrame, generations: DataFrame, strategies: DataFrame, logs: DataFrame) -> DataFrame:
    """Orphans of evaluations and generations by strategy hash, and of generations by response path."""
    ref = lambda d, src, field, space, key: d.select(
        F.lit(src).alias("src"), F.col("id").alias("row_id"), F.lit(field).alias("field"), F.lit(space).alias("space"), key(field).alias("key"), "batch_no"
    )
    refs = (
        ref(evaluations, "evaluations", "strategy_hash", "s", hash_key)
        .unionByName(ref(generations, "generations", "strategy_hash", "s", hash_key))
        .unionByName(ref(generations, "generations", "raw_response_path", "l", path_key))
    )
    parent = lambda d, space, key, row_id: d.select(F.lit(space).alias("space"), key.alias("key"), F.col(row_id).alias("row_id"), "batch_no", "removed_in_batch")
    parents = parent(strategies, "s", hash_key("strategy_hash"), "strategy_id").unionByName(parent(logs, "l", path_key("path"), "log_id"))
    return orphans(refs, parents)
