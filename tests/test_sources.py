"""Sources, sinks, splits, quality checks, leaderboard pieces and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import leaderboard as lb
from tidemark.operators import quality, resample
from tidemark.sources import bars as src
from tidemark.streaming import live

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2024, 1, 2, 9, 30)


def frame(spark, closes, symbol="S", start=T0, step=5):
    return spark.createDataFrame([(symbol, start + dt.timedelta(minutes=step * i), c, c, c, c, 1.0) for i, c in enumerate(closes)], BARS)


def test_landed_payloads(spark, tmp_path):
    ms = int(dt.datetime(2024, 1, 2, 14, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    d = tmp_path / "AMD" / "5m"
    d.mkdir(parents=True)
    row = lambda t, c: {"t": t, "o": c, "h": c, "l": c, "c": c, "v": 10}
    (d / "a.json").write_text(json.dumps({"status": "OK", "results": [row(ms, 1.5), row(ms - 3_600_000, 9.0), row(ms + 86_400_000 * 3, 7.0)]}))
    (d / "b.json").write_text(json.dumps({"status": "ERROR", "results": [row(ms, 2.0)]}))
    (d / "c.json").write_text(json.dumps({"status": "DELAYED", "results": None}))
    with pytest.raises(Exception, match="payload with status ERROR"):  # as bars could be missing
        src.LandedJsonProvider(spark, str(tmp_path)).fetch_bars("amd", "5m", dt.date(2024, 1, 2), dt.date(2024, 1, 3)).collect()
    raw = spark.read.schema(src.AGGREGATES).option("multiLine", True).json(str(d))
    assert src.aggregates_to_bars(raw, "amd", strict=False).count() == 3
    (d / "b.json").unlink()
    got = src.LandedJsonProvider(spark, str(tmp_path)).fetch_bars("amd", "5m", dt.date(2024, 1, 2), dt.date(2024, 1, 3)).collect()
    assert [(r.symbol, r.ts, r.close) for r in got] == [("amd", T0, 1.5)]


def test_tick_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1704067200,100,4\n1704067201,101,3\n1704067201,99,3\n1704067500,98,5\n")
    t = src.read_ticks(spark, str(tmp_path)).select(F.lit("X").alias("symbol"), F.timestamp_seconds("ts_unix").cast("timestamp_ntz").alias("ts"), "price", "volume", "file_seq")
    got = resample.ticks_to_bars(t, "5m", ["file_seq"]).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100.0, 101.0, 99.0, 99.0, 10.0), (98.0, 98.0, 98.0, 98.0, 5.0)]


def test_store_merge_keeps_existing_rows(spark, tmp_path):
    store = src.BarStore(spark, str(tmp_path / "bars"))
    assert store.load("5m") is None
    store.save(frame(spark, [1.0, 2.0], "a"), "5m")
    store.save(frame(spark, [5.0], "b"), "5m")
    store.merge(frame(spark, [9.0, 9.0, 3.0], "a"), "5m")
    assert sorted((r.symbol, r.close) for r in store.load("5m").collect()) == [("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 5.0)]
    assert [r.close for r in store.load("5m", ["b"]).collect()] == [5.0]
    with pytest.raises(ValueError):
        store.save(frame(spark, [1.0]).unionByName(frame(spark, [2.0])), "5m")


def test_normalize_is_independent_of_order(spark):
    a, b = frame(spark, [1.0]), frame(spark, [2.0])
    nulls = spark.createDataFrame([("S", None, 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    for d in (a.unionByName(b), b.unionByName(a).unionByName(nulls)):
        assert [r.close for r in src.normalize(d.withColumn("extra", F.lit(1))).collect()] == [1.0]


def test_holdout_guard(spark):
    d = frame(spark, [1.0], start=dt.datetime(2024, 12, 31, 10)).unionByName(frame(spark, [2.0], start=dt.datetime(2025, 1, 1)))
    assert [r.close for r in src.train_test(d).collect()] == [1.0]
    assert [r.close for r in src.holdout(d, final_scoring=True).collect()] == [2.0]
    with pytest.raises(src.HoldoutAccessError):
        src.holdout(d)
    with src.optimization_mode(), pytest.raises(src.HoldoutAccessError):
        src.holdout(d, final_scoring=True)
    assert src.source_timeframe("1h") == "5m" and src.source_timeframe("1m") == "1m"
    with pytest.raises(ValueError):
        src.source_timeframe("3m")


def test_gaps_are_at_the_ends_only(spark):
    d = frame(spark, [1.0, 1.0], start=dt.datetime(2024, 1, 10), step=60 * 24 * 5)
    got = {(r.gap_start, r.gap_end) for r in src.gaps(src.coverage(d), dt.date(2024, 1, 5), dt.date(2024, 1, 20)).collect()}
    assert got == {(dt.date(2024, 1, 5), dt.date(2024, 1, 9)), (dt.date(2024, 1, 16), dt.date(2024, 1, 20))}
    assert src.covers(src.coverage(d), dt.date(2024, 1, 11), dt.date(2024, 1, 14)).first().covered


def test_session_filters(spark):
    d = frame(spark, [float(i) for i in range(100)], start=dt.datetime(2024, 1, 2, 9, 0))
    assert src.rth_only(d).agg(F.min("ts"), F.max("ts")).first()[:] == (T0, dt.datetime(2024, 1, 2, 15, 55))
    assert d.where(src.is_open(F.col("ts"), [dt.date(2024, 1, 2)])).count() == 0 and d.where(src.is_open(F.col("ts"), [])).count() == 78


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("S", "long", 1, T0, 1.23456, T0, 2.0, "signal", "x", 0.5, 0.123456, 0)], "symbol string, side string, size int, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, exit_reason string, signal_label string, pnl double, pnl_pct double, duration_mins int")
    src.write_trade_log(t, str(tmp_path / "log"))
    r = spark.read.option("header", True).csv(str(tmp_path / "log")).first()
    assert (r.entry_ts, r.entry_price, r.pnl_pct) == ("2024-01-02 09:30", "1.2346", "12.3456")
    src.write_report(t.select("symbol"), {"trades": t}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/summary.json")).first().symbol == "S"
    src.write_splits(frame(spark, [1.0]), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).first().split == "train"


def test_quality(spark):
    d = frame(spark, [1.0, 2.0]).unionByName(frame(spark, [3.0])).unionByName(spark.createDataFrame([("S", None, 1.0, None, 1.0, 1.0, 1.0)], BARS))
    v = quality.violations(d).first()
    assert (v.n_rows, v.n_without_time, v.n_repeated, v.n_bad_prices) == (4, 1, 1, 1)
    quality.require_valid(spark.createDataFrame([], BARS))
    with pytest.raises(ValueError):
        quality.require_valid(d.drop("close"))
    g = quality.session_gaps(frame(spark, [1.0, 2.0], step=15)).first()
    assert (g.n_bars, g.n_gaps, g.n_unaligned) == (2, 1, 0)


def test_latest_before_promising(spark):
    s = spark.createDataFrame([("h", 1), ("k", 2)], "strategy_hash string, strategy_id long")
    cols = "id long, strategy_hash string, eval_type string, evaluated_at string, score double, median_pf double, ci_lower double, promising int, basket_version string, n_oos_trades int"
    e = spark.createDataFrame(
        [(1, "h", "fast", "2024-01-01", 2.0, 1.0, 1.0, 1, "b", 5), (2, "h", "fast", "2024-01-02", 0.1, 1.0, 1.0, 0, "b", 5), (3, "k", "holdout", "2024-01-01", 0.5, 1.0, None, 1, None, 5), (4, "k", "fast", "2024-01-01", None, 1.0, 1.2, 1, "c", 40)], cols
    )
    assert [r.strategy_hash for r in lb.promising(s, e).collect()] == ["k"]
    assert {(r.strategy_hash, r.id) for r in lb.authoritative(e).collect()} == {("h", 2), ("k", 3)}
    assert [r.key for r in lb.cohort(e, s, least_ci=1.0, least_trades=30, basket="b").collect()] == ["k"]
    assert {(r.eval_type, r.n, r.n_promising) for r in lb.evaluation_rollup(e).collect()} == {("fast", 3, 2), ("canonical", 0, 0), ("holdout", 1, 1)}
    with pytest.raises(ValueError):
        lb.hash_prefix(s, "abc")
    with pytest.raises(ValueError):
        lb.listed(s, order="name; drop")


def test_late_ticks_are_dropped_and_state_is_kept(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, volume double"
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for k, rows in enumerate([[("S", t, 1.0, 1.0), ("S", t + dt.timedelta(minutes=4), 3.0, 1.0)], [("S", t + dt.timedelta(minutes=40), 5.0, 1.0)], [("S", t + dt.timedelta(minutes=90), 5.0, 1.0)], [("S", t + dt.timedelta(minutes=1), 9.0, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"t/k={k}"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t/*"))
    got = sorted((r.open, r.close, r.volume) for r in live.drain(live.stream_bars(read(), "5m")).collect())
    assert got == [(1.0, 3.0, 2.0), (5.0, 5.0, 1.0)]
    whole = sorted((r.open, r.close, r.volume) for r in live.drain_open(live.stream_bars(read(), "5m"), ["symbol", "ts"]).collect())
    assert whole == [(1.0, 3.0, 2.0), (5.0, 5.0, 1.0), (5.0, 5.0, 1.0)]  # the bar that is still open, too
    e = live.drain(live.stream_ema(read().select("symbol", "ts", F.col("price").alias("close")), 3)).orderBy("ts").collect()
    assert len(e) == 5
    seeds = [r.ema for r in e]
    assert seeds.count(None) == 2 and any(x is not None and abs(x - 3.0) < 1e-9 for x in seeds)  # the mean of 1, 3 and 5


def test_rows_of_a_batch_in_any_order_give_the_same_average(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    closes = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9)]
    rows = [("S", t + dt.timedelta(minutes=i), c) for i, c in enumerate(closes)]
    import random

    for k in range(3):
        part = rows[5 * k : 5 * k + 5] + [("N", t, None)]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, "symbol string, ts timestamp, close double").repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / f"t/k={k}"))
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t/*"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # a group in several chunks
    try:
        got = live.drain(live.stream_ema(stream, 4)).where("symbol = 'S'").orderBy("ts").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    e, want = sum(closes[:4]) / 4, [None] * 3
    want.append(e)
    for c in closes[4:]:
        e = c * 0.4 + e * 0.6
        want.append(e)
    assert [r.ema for r in got][:3] == [None] * 3 and [r.ema for r in got][3:] == pytest.approx(want[3:])


def test_rosters_and_dates(tmp_path):
    from tidemark.sources import rosters

    r = rosters.draw_roster(["A", "B", "C", "D"], ["A"], 3, 7)
    assert r == rosters.draw_roster(["D", "C", "B", "A"], ["A"], 3, 7) and "A" in r and len(r) == 3
    with pytest.raises(ValueError):
        rosters.draw_roster(["A"], ["A"], 3, 7)
    rosters.save_roster(str(tmp_path / "r.json"), r, 7, "test")
    assert rosters.load_roster(str(tmp_path / "r.json")) == r
    now = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    assert rosters.parse_since("3d", now) == dt.datetime(2024, 1, 7, tzinfo=dt.timezone.utc)
    assert rosters.parse_since("2024-01-02", now) == dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    with pytest.raises(ValueError):
        rosters.parse_since("yesterday", now)


def test_reconcile_and_newest_log(spark):
    e = spark.createDataFrame(
        [(1, "fast", 2.0, 1.5, None, 40, 0, '{"strategy": "a"}'), (2, "fast", float("nan"), 1.5, 2.0, 40, 1, "{cut"), (3, "fast", 2.0, 1.5, 1.1, 40, 1, None), (4, "holdout", 0.0, 0.0, 0.0, 0, 1, '{"strategy": "zz"}')],
        "id long, eval_type string, score double, median_pf double, ci_lower double, n_oos_trades int, promising int, config_json string",
    )
    assert {(r.id, r.was, r.now) for r in lb.reconcile(e).collect()} == {(1, 0, 1), (2, 1, 0)}
    t = dt.datetime(2024, 1, 1)
    logs = spark.createDataFrame([(1, t, '{"name": "a"}'), (2, t, '{"name": "a"}'), (3, t + dt.timedelta(1), '{"name": "a"'), (4, t, None)], "log_id long, timestamp timestamp, raw_tool_input string")
    assert {(r.id, r.log_id) for r in lb.newest_log(e, logs).collect()} == {(1, 2), (2, None), (3, None), (4, None)}


def test_crypto_payloads(spark):
    from tidemark.sources.bars import pair_payload_to_bars

    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    good = '{"error": [], "result": {"last": 1700000600, "XXBTZUSD": [[1700000000, "1.5", "2.0", "1.0", "1.7", "1.6", "12.5", 3]], "other": [[1, "9", "9", "9", "9", "9", "9", 9]]}}'
    rows = pair_payload_to_bars(frame(good, '{"error": [], "result": {"last": 1}}'), "BTC").collect()
    assert [tuple(r) for r in rows] == [("BTC", dt.datetime(2023, 11, 14, 22, 13, 20), 1.5, 2.0, 1.0, 1.7, 12.5)]
    for bad in ('{"error": ["EQuery:Unknown asset pair"]}', "no json", None):
        with pytest.raises(Exception, match="payload with errors"):
            pair_payload_to_bars(frame(good, bad), "BTC").collect()
    assert pair_payload_to_bars(frame(), "BTC").count() == 0


def test_baskets_have_labels(spark):
    from tidemark.operators import scoring

    d = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "X"), ("b", "Z")], "k string, symbol string")
    got = {r.k: r.label for r in scoring.basket_label(scoring.basket_hash(d, ["k"]), {"two": ["Y", "X"], "five": ["A"]}).collect()}
    assert got["a"] == "two" and got["b"].startswith("unknown_") and len(got["b"]) == 20


def test_orders_that_are_no_market_orders_are_refused():
    from tidemark.operators.backtest import Bar, BacktestConfig, Engine, Entry

    class Limit:
        keep = 5
        on_session_start = on_trade_closed = staticmethod(lambda *a: None)
        on_bar = staticmethod(lambda *a: [Entry("long", kind="limit")])

    with pytest.raises(ValueError, match="limit"):
        list(Engine(Limit(), BacktestConfig()).feed(Bar(dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)))


def test_the_package_can_be_shipped(spark):
    from tidemark.session import ship

    ship(spark)
    assert any("tidemark" in str(f) for f in spark.sparkContext.listFiles)

