"""Near-duplicates of new batches against all history, by a table of distances to fixed pivots.

A strategy specification is reduced to a canonical tree.  The distance of two trees is the
number of values that differ, unordered and/or arguments being matched at least cost;
trees of unlike shape are infinitely far apart.  Each leaf is a token (path, value), and a
changed value replaces one token.  The pivots are fixed synthetic token sets, one for each of a few
bits of a token's hash, within each of ``max_changes + 1`` blocks of paths; the distance of a tree to
a pivot is, up to a constant, the count of its tokens with that bit.  They need no data, so
stored rows stay valid for ever.

The distance is the sum of its parts over the blocks.  So of two trees within ``max_changes`` at
least one block agrees wholly, where the triangle inequality allows only equal pivot distances, and in the
others the distances to a pivot, each an integer, differ by ``max_changes`` in all: they lie on one of thirteen
places around the tree's own.  The table stores a tree once per block, under a key of the shape, the block's
distances and the others' distances to their first pivots; a new tree looks up the thirteen places of each block.  The table is
partitioned by ranges of the key's hash, and a batch reads the ranges it falls in.  The inequality for all other pivots
then prunes the pairs, and survivors are verified by the true distance.  Equal trees are one class and are joined once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.percentiles import hash_key
from tidemark.session import cut, ensure_checkpoint_dir

BLOCKS, PIVOTS = 3, 8
MAX_CHANGES = BLOCKS - 1
FAR = 99
DROPPED_TOP, DROPPED = {"name", "thesis"}, {"description", "descriptions"}
#: Ranges of keys by which the stored table is partitioned.
RANGES = 16
#: A batch's keys, pairs and links are broadcast if there are no more of them (some 20 to 100 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000
PIVOT_COLUMNS = [f"d{b}_{j}" for b in range(BLOCKS) for j in range(PIVOTS)]
CELLS = [f"cell{b}" for b in range(BLOCKS)]
PIVOT_ROW = (
    "row_id long, class string, shape long, canon string, "
    + ", ".join(f"{c} long" for c in CELLS) + ", " + ", ".join(f"{c} int" for c in PIVOT_COLUMNS)
)
#: The places that distances in the two other blocks can have, which differ by MAX_CHANGES in all.
PLACES = [p for p in itertools.product(range(-MAX_CHANGES, MAX_CHANGES + 1), repeat=BLOCKS - 1) if sum(map(abs, p)) <= MAX_CHANGES]
#: For each eight bits of a hash, what they add to the distances of a block's pivots, sixteen bits apart.
_SPREAD = [sum((h >> j & 1) << 16 * j for j in range(8)) for h in range(256)]


_text = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def canonical(spec: str) -> Any:
    """The canonical tree of a specification; raises ValueError if it is no JSON object.

    Left out are name, thesis and descriptions.  Numbers are floats, texts that hold a JSON object or
    array are parsed, names of indicators and parameters are replaced by their places where they
    are referred to, and the arguments of and/or are sorted.
    """
    tree = json.loads(spec)
    if isinstance(tree, str):
        tree = json.loads(tree)
    if not isinstance(tree, dict):
        raise ValueError("not an object")
    refs: dict[str, dict[str, str]] = {"indicator": {}, "param": {}}

    def opened(x: Any) -> Any:
        if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
            try:
                return opened(json.loads(x))
            except ValueError:
                return x
        if isinstance(x, dict):
            return {k: opened(v) for k, v in x.items() if k not in DROPPED}
        if isinstance(x, list):
            return [opened(v) for v in x]
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return float(x)
        return x

    tree = {k: opened(v) for k, v in tree.items() if k not in DROPPED_TOP | DROPPED}
    for kind, section in (("indicator", "indicators"), ("param", "parameters")):
        for i, x in enumerate(tree.get(section) or [] if isinstance(tree.get(section), list) else []):
            if isinstance(x, dict) and isinstance(x.get("name"), str):
                refs[kind].setdefault(x["name"], f"@{kind}{i}")

    def ordered(x: Any) -> Any:
        if isinstance(x, dict):
            y = {k: ordered(v) for k, v in x.items()}
            op, name = y.get("op"), y.get("name")
            if op in ("indicator", "param") and isinstance(name, str):
                y["name"] = refs[op].get(name, name)
            if op in ("and", "or") and isinstance(y.get("args"), list):
                y["args"] = sorted(y["args"], key=_text)
            return y
        return [ordered(v) for v in x] if isinstance(x, list) else x

    return ordered(tree)


def _is_clauses(key: str, x: Any) -> bool:
    return key == "args" and isinstance(x, list)


def _scalars(x: list) -> bool:
    return not any(isinstance(v, (dict, list)) for v in x)


def shape(x: Any, key: str = "") -> str:
    """The tree without its values; arguments unordered, lists of scalars without their length."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{shape(x[k], k)}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        if _scalars(x):
            return "[*]"
        parts = [shape(v) for v in x]
        return "(" + ",".join(sorted(parts) if _is_clauses(key, x) else parts) + ")"
    return "*"


def leaves(x: Any) -> list[tuple[str, str | None]]:
    """(path, value) of every leaf; lists of scalars also give their path with None."""
    out: list[tuple[str, str | None]] = []

    def walk(x: Any, path: str, key: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}", k)
        elif isinstance(x, list):
            flat = _scalars(x)
            if flat:
                out.append((f"{path}[]", None))
            alike = flat or _is_clauses(key, x)
            for i, v in enumerate(x):
                walk(v, f"{path}[]" if alike else f"{path}[{i}]", "")
        else:
            out.append((path, "'" + x if isinstance(x, str) else repr(x)))

    walk(x, "", "")
    return out


def distance(a: Any, b: Any, most: int = MAX_CHANGES, key: str = "") -> int:
    """Number of differing values; FAR as soon as it exceeds ``most`` or the shapes differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        if a.keys() != b.keys():
            return FAR
        total = 0
        for k in a:
            total += distance(a[k], b[k], most - total, k)
            if total > most:
                return FAR
        return total
    if isinstance(a, list) and isinstance(b, list):
        if _scalars(a) and _scalars(b):
            left, right = [_text(v) for v in a], [_text(v) for v in b]
            for v in list(left):
                if v in right:
                    left.remove(v)
                    right.remove(v)
            n = max(len(left), len(right))
            return n if n <= most else FAR
        if len(a) != len(b):
            return FAR
        if not _is_clauses(key, a):
            total = 0
            for x, y in zip(a, b):
                total += distance(x, y, most - total)
                if total > most:
                    return FAR
            return total
        left, right = sorted(map(_text, a)), sorted(map(_text, b))
        for v in list(left):
            if v in right:
                left.remove(v)
                right.remove(v)
        if len(left) > most:  # each pair left costs at least one
            return FAR
        left, right = [json.loads(v) for v in left], [json.loads(v) for v in right]
        best = min(sum(distance(x, y, most) for x, y in zip(left, p)) for p in itertools.permutations(right))
        return best if best <= most else FAR
    if isinstance(a, (dict, list)) or isinstance(b, (dict, list)):
        return FAR
    same = a == b and isinstance(a, bool) == isinstance(b, bool)
    return 0 if same else 1 if most >= 1 else FAR


def _pivot_row(row_id: int, spec: str | None) -> tuple | None:
    if spec is None:
        return None
    none = (None,) * (BLOCKS + len(PIVOT_COLUMNS))
    try:
        tree = canonical(spec)
        canon, form = _text(tree), shape(tree)
    except (ValueError, RecursionError):  # not readable: only an equal text repeats it
        return (row_id, "t" + hashlib.md5(spec.encode("utf-8", "surrogatepass")).hexdigest(), None, None, *none)
    found = leaves(tree)
    block = {p: i % BLOCKS for i, p in enumerate(sorted({p for p, _ in found}))}
    sums = [0] * BLOCKS
    for path, value in found:
        if value is not None:
            sums[block[path]] += _SPREAD[_hash(f"{path}={value}") & 255]
    counts = [[x >> 16 * j & 0xFFFF for j in range(PIVOTS)] for x in sums]
    # the distances of a block side by side, 7 bits each (a capped count still differs by no more than the tree)
    cells = [sum(min(c, 127) << 7 * j for j, c in enumerate(own)) for own in counts]
    return (row_id, "s" + hashlib.md5(canon.encode("utf-8", "surrogatepass")).hexdigest(), _hash(form), canon, *cells, *itertools.chain(*counts))


def _schema(rows: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in rows.split(", ")])


def pivot_rows(specs: DataFrame, id_col: str = "strategy_id", text_col: str = "spec_json") -> DataFrame:
    """One row of the pivot table for each row with a text."""
    schema = _schema(PIVOT_ROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(_pivot_row, batch.column(0).to_pylist(), batch.column(1).to_pylist()) if r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return specs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIVOT_ROW)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per class, with a number ``cid`` (a hash of its name); all rows of a class have the same values."""
    d = rows.where("shape is not null").groupBy("class").agg(*[F.first(c).alias(c) for c in ["shape", "canon", *CELLS, *PIVOT_COLUMNS]])
    return d.withColumn("cid", F.xxhash64("class"))


def _others(block: int) -> list[str]:
    return [f"d{b}_0" for b in range(BLOCKS) if b != block]


def index_rows(classes: DataFrame) -> DataFrame:
    """(key, cid): the table's rows of each class, one for each block."""
    own = F.array(*[F.xxhash64("shape", F.lit(b), f"cell{b}", *_others(b)) for b in range(BLOCKS)])
    return classes.select(F.explode(own).alias("key"), "cid")


def probes(classes: DataFrame) -> DataFrame:
    """(key, cid): where a class looks up others: for each block the places around its own distances in the other blocks."""
    keys = [
        F.xxhash64("shape", F.lit(b), f"cell{b}", *[F.col(c) + F.lit(p).cast("int") for c, p in zip(_others(b), place)])
        for b in range(BLOCKS) for place in PLACES
    ]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "cid")


def _range(key: str) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - RANGES.bit_length() + 1).cast("int")


def _small(d: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows, else shuffled; d must be stored, as it is counted."""
    return F.broadcast(d) if d.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else d.hint("merge")


def candidates(asking: DataFrame, table: DataFrame) -> DataFrame:
    """(new, old) class numbers of unlike classes that meet at a key, each pair once."""
    a, b = asking.withColumnRenamed("cid", "new"), table.withColumnRenamed("cid", "old")
    return a.join(b, "key").where("new != old").select("new", "old").distinct()


def verified(pairs: DataFrame, fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(class_new, class_old, distance) of the candidates within MAX_CHANGES; fresh and stored are rows of ``_classes`` that hold them.

    First the triangle inequality for all pivots, then the true distance.
    """
    side = lambda d, k: d.select(F.col("cid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("class", "canon", "shape", *PIVOT_COLUMNS)])
    both = _small(pairs).join(side(fresh, "new"), "new")
    both = both.hint("merge").join(side(stored, "old"), "old") if stored is fresh else both.join(side(stored, "old"), "old")
    gap = lambda blk: F.greatest(*[F.abs(F.col(f"new_d{blk}_{j}") - F.col(f"old_d{blk}_{j}")) for j in range(PIVOTS)])
    both = both.where((F.col("new_shape") == F.col("old_shape")) & (sum((gap(k) for k in range(1, BLOCKS)), gap(0)) <= MAX_CHANGES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(4)]
            d = [distance(json.loads(x), json.loads(y)) for x, y in zip(cols[2], cols[3])]
            keep = [i for i, v in enumerate(d) if v <= MAX_CHANGES]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([cols[c][i] for i in keep], pa.string()) for c in (0, 1)], pa.array([d[i] for i in keep], pa.int32())],
                names=["class_new", "class_old", "distance"],
            )

    return both.select("new_class", "old_class", "new_canon", "old_canon").mapInArrow(run, "class_new string, class_old string, distance int")


def near_classes(rows: DataFrame) -> DataFrame:
    """(class_new, class_old, distance) of all unlike classes of the rows within MAX_CHANGES."""
    classes = cut(_classes(rows))
    return verified(cut(candidates(probes(classes), index_rows(classes))), classes, classes)


class History:
    """The stored pivot table: batches are checked against it and appended; what is stored is never rewritten.

    Three parquet tables under ``path``: ``index``, (key, cid) of ``index_rows``, partitioned by the range of the key; ``classes``, the
    rows of ``_classes``, and ``rows``, (row_id, class, cid), partitioned by the range of cid.  A batch reads the ranges it falls in, with its own keys,
    pairs and links broadcast (if they are few, by BROADCAST_ROWS), so that no stored row is shuffled.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, range int")
        return self.spark.read.schema(f"{schema}, range int").parquet(f"{self.path}/{name}")

    def index(self) -> DataFrame:
        return self._stored("index", "key long, cid long")

    def classes(self) -> DataFrame:
        return self._stored("classes", ", ".join(["class string", "shape long", "canon string", *[f"{c} long" for c in CELLS], *[f"{c} int" for c in PIVOT_COLUMNS], "cid long"]))

    def accepted(self) -> DataFrame:
        return self._stored("rows", "row_id long, class string, cid long")

    def _touched(self, table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """The partitions of the table that the keys fall in; there are at most RANGES."""
        return table.where(F.col("range").isin([r.range for r in keys.select(_range(key).alias("range")).distinct().collect()])).drop("range")

    def check(self, batch: DataFrame, id_col: str = "strategy_id", text_col: str = "spec_json") -> tuple[DataFrame, DataFrame]:
        """(matches of the batch, its pivot rows for append).

        Matches are (id_a, id_b, distance), id_a < id_b: pairs of a new row with an accepted or another new one that it repeats or
        nearly repeats.  Rows without text have none; texts that are no JSON object match equal texts only.
        """
        new = cut(pivot_rows(batch, id_col, text_col))
        classes = cut(_classes(new))
        asking = cut(probes(classes))
        with_old = cut(candidates(_small(asking), self._touched(self.index(), asking, "key")))
        inside = cut(candidates(asking, index_rows(classes)))
        near = verified(with_old, classes, self._touched(self.classes(), with_old, "old"))
        near = near.unionByName(verified(inside, classes, classes)).dropDuplicates(["class_new", "class_old"])  # a class may be stored and new
        same = new.select(F.col("class").alias("class_new"), F.col("class").alias("class_old")).distinct().withColumn("distance", F.lit(0))
        links = cut(same.unionByName(near))
        rows = new.select(F.col("row_id").alias("id_b"), F.col("class").alias("class_new"))
        held = self._touched(self.accepted(), links.select(F.xxhash64("class_old").alias("cid")), "cid")
        old = _small(links).join(held.select(F.col("row_id").alias("id_a"), F.col("class").alias("class_old")), "class_old").join(rows.hint("merge"), "class_new")
        new_ones = rows.select(F.col("id_b").alias("id_a"), F.col("class_new").alias("class_old"))
        own = _small(links).join(new_ones.hint("merge"), "class_old").join(rows.hint("merge"), "class_new").where("id_a < id_b")
        old = old.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance")
        return own.select("id_a", "id_b", "distance").unionByName(old), new

    def append(self, new: DataFrame) -> None:
        """Add checked rows; a class that is stored already is not stored again."""
        classes = _classes(new)
        known = self._touched(self.accepted(), new.select(F.xxhash64("class").alias("cid")), "cid").select("class").distinct()
        fresh = cut(classes.join(known, "class", "left_anti"))

        def add(d: DataFrame, key: str, name: str) -> None:
            d = d.withColumn("range", _range(key))
            d.repartition("range").sortWithinPartitions("range", key).write.mode("append").partitionBy("range").parquet(f"{self.path}/{name}")

        add(index_rows(fresh), "key", "index")
        add(fresh, "cid", "classes")
        add(new.select("row_id", "class", F.xxhash64("class").alias("cid")), "cid", "rows")


def in_batches(strategies: DataFrame, steps: int = 2) -> DataFrame:
    """(id_a, id_b, distance) of all rows, taken batch by batch (batch_no, rows of none first) against a history of its own.

    Consecutive batches are taken together in ``steps`` steps: the first half of the rows, then half of what is left, and so on; a step's
    rows are compared with each other and with all before.  The history lies in the shared checkpoint folder.
    """
    spark = strategies.sparkSession
    ensure_checkpoint_dir(spark)
    history = History(spark, f"{spark.sparkContext.getCheckpointDir()}/pivots-{uuid.uuid4()}")
    d = strategies.withColumn("batch_no", F.coalesce(F.col("batch_no").cast("long"), F.lit(-(2**40))))
    shares = [1 - 0.5**k for k in range(1, steps)]
    ends = d.agg(F.percentile_approx("batch_no", [float(x) for x in shares], 1000).alias("e")).first().e or []
    edges = [None, *sorted(set(ends)), None]
    found = None
    for after, upto in zip(edges, edges[1:]):
        part = d if after is None else d.where(F.col("batch_no") > after)
        part = part if upto is None else part.where(F.col("batch_no") <= upto)
        matches, rows = history.check(part)
        if upto is not None:
            matches = cut(matches)  # before the history grows
            history.append(rows)
        found = matches if found is None else found.unionByName(matches)
    return found


def repeated_keys(rows: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(id_a, id_b): the first row (least id) with a key, and each later one; keys compared as hashes."""
    k = rows.select(F.col(id_col).cast("long").alias("id_b"), hash_key(key_col).alias("key")).where("key is not null")
    first = k.groupBy("key").agg(F.min("id_b").alias("id_a"), F.count("*").alias("n")).where("n > 1")
    return k.join(first, "key").where("id_a < id_b").select("id_a", "id_b")


def strategy_links(strategies: DataFrame) -> DataFrame:
    """One row per strategy: its class (the least id of the equal specs), and to how many other classes it is near."""
    rows = cut(pivot_rows(strategies))
    names = rows.groupBy("class").agg(F.min("row_id").alias("class_id"), F.count("*").alias("class_size"))
    near = near_classes(rows).groupBy(F.col("class_new").alias("class")).agg(F.count("*").alias("n_links"))
    named = names.join(near, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return rows.select("row_id", "class").join(named, "class").select(F.col("row_id").alias("strategy_id"), "class_id", "class_size", "n_links")
