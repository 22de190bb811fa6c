"""Percentile sketches and the pivot table against exact results."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import percentiles as pc
from tidemark.llm import pivots


def test_relative_error_and_merging(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v), i % 3) for i, v in enumerate(rng.normal(0, 3, 900))] + [("b", float(v), i % 3) for i, v in enumerate(rng.lognormal(0, 4, 700))]
    rows += [("a", 0.0, 0), ("a", None, 0), ("a", math.nan, 1), ("b", math.inf, 1), ("b", -math.inf, 2), ("c", None, 0), ("d", -5.0, 0), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, part int").withColumn("bucket", F.lit("x"))
    at = [0.0, 0.5, 0.9, 0.99, 1.0]
    whole = pc.sketch(df, ["g"], ["v"], 0.02)
    parts = pc.merge(*[pc.sketch(df.where(F.col("part") == k), ["g"], ["v"], 0.02) for k in range(3)], keys=["g"])
    got = {(r.g, r.p): r for r in pc.percentiles(whole, ["g"], at, 0.02).collect()}
    assert {(r.g, r.p): r for r in pc.percentiles(parts, ["g"], at, 0.02).collect()} == got
    assert {g for g, _ in got} == {"a", "b", "d", None}
    for (g, p), r in got.items():
        v = sorted(x for k, x, _ in rows if k == g and x is not None and math.isfinite(x))
        exact = v[math.floor(p * (len(v) - 1))]
        assert abs(r.value - exact) <= 0.02 * abs(exact) and r.n_values == len(v)


def test_the_bound_holds_at_every_magnitude(spark):
    rows = [(f"{sign}{e}{f}", sign * f * 10.0**e) for sign in (-1, 1) for e in (-307, -30, -12, -7, -3, 0, 5, 12, 300, 307) for f in (1.0, 1.37, 1.7, 5e-1)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.value for r in pc.percentiles(pc.sketch(df, ["g"], ["v"]), ["g"], [0.5]).collect()}
    assert all(abs(got[g] - v) <= 0.01 * abs(v) for g, v in rows)


def test_sketches_of_other_accuracy_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0)], "g string, v double")
    mixed = pc.merge(pc.sketch(df, ["g"], ["v"], 0.01), pc.sketch(df, ["g"], ["v"], 0.02), keys=["g"])
    with pytest.raises(Exception, match="a sketch of accuracy 0.02 read as 0.01"):
        pc.percentiles(mixed, ["g"], [0.5], 0.01).collect()


def test_archetypes(spark):
    s = spark.createDataFrame([(1, "AB", " Mean Reversion", 1), (2, "sha256:ab ", "momentum", 2), (3, None, "x", 1)], "strategy_id long, strategy_hash string, archetype string, batch_no int")
    e = spark.createDataFrame([("ab", 1.0, None, "s"), ("zz", 2.0, 3.0, "s"), (None, 4.0, math.nan, "t")], "strategy_hash string, score double, median_pf double, stream string")
    got = {(r.archetype, r.metric, r.n) for r in pc.evaluation_sketch(e, s).groupBy("archetype", "metric").agg(F.sum("n").alias("n")).collect()}
    assert got == {("mean_reversion", "score", 1), ("unknown", "score", 2), ("unknown", "median_pf", 1)}
    assert pc.percentiles(pc.evaluation_sketch(e.limit(0), s), ["archetype"], [0.5]).count() == 0


# ---- pivots


def spec(rng, shape=None):
    ind = [{"name": f"i{k}", "type": "sma", "params": {"period": rng.randrange(2, 200)}} for k in range(2)]
    par = [{"name": f"p{k}", "type": "float", "default": round(rng.random() * 90, 2), "range_min": rng.randrange(50), "range_max": 99.5, "description": "d"} for k in range(2)]
    side = lambda: rng.choice([{"op": "indicator", "name": rng.choice(["i0", "i1"])}, {"op": "param", "name": rng.choice(["p0", "p1"])}, {"op": "const", "value": round(rng.random() * 99, 1)}])
    cmp = lambda: {"op": "compare", "operator": rng.choice("<>"), "lhs": side(), "rhs": side()}
    return {
        "name": "n", "thesis": "t", "archetype": rng.choice("ab"), "timeframes": ["5m"], "supported_assets": ["stocks"], "parameters": par, "indicators": ind,
        "entry_long": {"op": rng.choice(["and", "or"]), "args": [cmp() for _ in range(3)]}, "exit_long": cmp(), "entry_short": None, "position_sizing": {"rule": "fixed", "size": rng.randrange(1, 100)},
    }


def changed(rng, s, k):
    s = json.loads(json.dumps(s))
    for what in rng.sample(["size", "period", "default", "op", "alias", "const"], k):
        if what == "size":
            s["position_sizing"]["size"] += 1
        elif what == "period":
            s["indicators"][0]["params"]["period"] += 1
        elif what == "default":
            s["parameters"][1]["default"] += 1
        elif what == "op":
            s["exit_long"]["operator"] = "<=" if s["exit_long"]["operator"] == "<" else "<"
        elif what == "alias":
            s = json.loads(json.dumps(s).replace('"i1"', '"i1_alt"'))
        else:
            a = s["entry_long"]["args"][0]
            a["operator"] = "!="
    return s


def layout(rng, s):
    s = json.loads(json.dumps(s))
    s["name"], s["thesis"] = f"n{rng.random()}", "else"
    for p in s["parameters"]:
        p["description"] = "other"
    rng.shuffle(s["entry_long"]["args"])
    if rng.random() < 0.5:
        s["entry_long"] = json.dumps(s["entry_long"])
    s = dict(rng.sample(sorted(s.items()), len(s)))
    s["position_sizing"]["size"] = float(s["position_sizing"]["size"])
    return json.dumps(s, indent=rng.choice([None, 2]))


def test_layout_does_not_count():
    rng = random.Random(1)
    for _ in range(50):
        s = spec(rng)
        assert pivots.canonical(layout(rng, s)) == pivots.canonical(json.dumps(s))


def test_distance_counts_changes():
    rng = random.Random(2)
    for k in (0, 1, 2, 3):
        for _ in range(30):
            s = spec(rng)
            a, b = pivots.canonical(json.dumps(s)), pivots.canonical(layout(rng, changed(rng, s, k)))
            d = pivots.distance(a, b)
            assert d == pivots.distance(b, a) and (d <= k if k <= 2 else d in (2, pivots.FAR) or d < 2)
    a, b = pivots.canonical('{"x": [1, 2]}'), pivots.canonical('{"x": [2]}')
    assert (pivots.distance(a, b), pivots.distance(a, {"y": [1.0]}), pivots.distance({"x": True}, {"x": 1.0})) == (1, pivots.FAR, 1)


def corpus(rng):
    base = [spec(rng) for _ in range(25)]
    texts = [layout(rng, changed(rng, s, k)) for s in base for k in (0, 0, 1, 2, 3)]
    return [*texts, None, "", "{cut", "{cut", "[1]", "7", *texts[:5]]


def frame(spark, texts, start=1):
    return spark.createDataFrame([(start + i, t, 1, "z", 5) for i, t in enumerate(texts)], "strategy_id long, spec_json string, batch_no int, class string, shape int")


def brute(texts):
    def tree(t):
        try:
            return pivots.canonical(t)
        except ValueError:
            return None

    trees = [tree(t) if t is not None else None for t in texts]
    out = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] is None or texts[j] is None:
            continue
        if trees[i] is not None and trees[j] is not None:
            near = pivots.distance(trees[i], trees[j]) <= 2
        else:
            near = texts[i] == texts[j]
        if near:
            out.add((i + 1, j + 1))
    return out


def test_matches_are_those_of_brute_force(spark, tmp_path):
    texts = corpus(random.Random(3))
    found, _ = pivots.History(spark, str(tmp_path / "empty")).check(frame(spark, texts))
    got = [(r.id_a, r.id_b) for r in found.collect()]
    assert set(got) == brute(texts) and len(got) == len(set(got)) > 100
    d = frame(spark, texts).withColumn("batch_no", F.when(F.col("strategy_id") % 9 > 0, F.floor(F.col("strategy_id") / 13).cast("int")))
    for steps in (1, 3):
        again = [(r.id_a, r.id_b) for r in pivots.in_batches(d, steps).collect()]
        assert sorted(again) == sorted(got)


@pytest.mark.parametrize("few", [0, 100_000])
def test_batches_against_history(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(pivots, "BROADCAST_ROWS", few)
    texts = corpus(random.Random(4))
    random.Random(5).shuffle(texts)
    history, got = pivots.History(spark, str(tmp_path / "pivots")), set()
    for a in range(0, len(texts), 60):
        found, rows = history.check(frame(spark, texts[a : a + 60], a + 1))
        got |= {(r.id_a, r.id_b) for r in found.collect()}
        history.append(rows)
    assert got == brute(texts)
    assert history.accepted().count() == sum(t is not None for t in texts)
    stored = history.index()
    assert stored.count() == 3 * history.classes().count() == 3 * stored.select("cid").distinct().count()


def written(spark, action):
    """Records that shuffles wrote during an action."""
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    store = spark.sparkContext._jsc.sc().statusStore()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)[: -before or None] for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_the_shuffle_of_a_batch_does_not_grow_with_history(spark, tmp_path):
    texts = [json.dumps(spec(random.Random(i))) for i in range(600)]
    batch = frame(spark, [layout(random.Random(1), json.loads(t)) for t in texts[:20]], 10_001)
    sizes = []
    for n in (40, 560):
        history = pivots.History(spark, str(tmp_path / f"h{n}"))
        _, rows = history.check(frame(spark, texts[:n]))
        history.append(rows)
        sizes.append(written(spark, lambda h=history: h.check(batch)[0].collect()))
    assert 0 < sizes[1] <= sizes[0] * 1.3, sizes


def test_repeated_keys_and_empty(spark):
    g = spark.createDataFrame([(3, "AB"), (1, " ab"), (2, "sha256:ab"), (4, None), (5, "x"), (6, None)], "id long, prompt_hash string")
    assert {tuple(r) for r in pivots.repeated_keys(g, "id", "prompt_hash").collect()} == {(1, 2), (1, 3)}
    e = frame(spark, [])
    assert pivots.in_batches(e).count() == 0 and pivots.strategy_links(e).count() == 0


def test_links(spark):
    rng = random.Random(6)
    s = spec(rng)
    texts = [json.dumps(s), layout(rng, s), json.dumps(changed(rng, s, 1)), json.dumps(spec(rng)), "{cut"]
    got = {r.strategy_id: (r.class_id, r.class_size, r.n_links) for r in pivots.strategy_links(frame(spark, texts)).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 4: (4, 1, 0), 5: (5, 1, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_triangle_inequality_of_stored_distances(seed):
    rng = random.Random(seed)
    for _ in range(40):
        s = spec(rng)
        x, y = (pivots._pivot_row(1, json.dumps(v)) for v in (s, changed(rng, s, 2)))
        if x[2] != y[2]:
            continue
        d = pivots.distance(json.loads(x[3]), json.loads(y[3]))
        first = 4 + pivots.BLOCKS
        for k in range(len(pivots.PIVOT_COLUMNS)):
            assert abs(x[first + k] - y[first + k]) <= d
