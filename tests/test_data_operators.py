"""Orphans, drift, gridding and instants against brute force and stated cases."""

import datetime as dt
import math

import pytest

from tidemark.operators import drift, gridding, instants, orphans

UTC = dt.timezone.utc


# ---- orphans


def misses(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "src string, row_id long, field string, space string, key string, batch_no int, h int, bucket string")
    p = spark.createDataFrame(parents, "space string, key string, row_id long, batch_no int, removed_in_batch int, salt int")
    return {(x.row_id, x.reason) for x in orphans.orphans(r, p, **kw).collect()}


def ref(i, key, batch, space="s"):
    return ("t", i, "f", space, key, batch, 0, "")


def test_reasons(spark):
    parents = [("s", "a", 1, 2, None, 0), ("s", "b", 2, 1, 5, 0), ("s", "c", 3, 4, None, 0), ("s", "c", 4, 2, None, 0), ("l", "a", 9, 1, 1, 0), ("s", None, 5, 1, None, 0)]
    refs = [ref(1, "a", 2), ref(2, "a", 1), ref(3, "b", 4), ref(4, "b", 5), ref(5, "c", 3), ref(6, "zz", 9), ref(7, None, 1), ref(8, "", 1), ref(9, "a", 3, "l"), ref(10, "a", None), ref(2, "a", 1)]
    assert misses(spark, refs, parents) == {(2, "later"), (4, "removed"), (6, "missing"), (8, "missing"), (9, "removed")}


def test_no_parents_and_no_references(spark):
    assert misses(spark, [ref(1, "a", 1)], []) == {(1, "missing")}
    assert misses(spark, [], [("s", "a", 1, 1, None, 0)]) == set()


def test_hot_key_is_salted(spark):
    refs = [ref(i, "hot" if i % 3 else f"k{i}", 1) for i in range(600)]
    parents = [("s", "hot", 1, 2, None, 0), ("s", "k0", 2, 1, None, 0)]
    got = misses(spark, refs, parents, rows_per_group=50)
    assert got == {(i, "later" if i % 3 else "missing") for i in range(1, 600)}


def test_key_spellings(spark):
    d = spark.createDataFrame([(" SHA256:AbC ", "x\\y/ z.json "), ("abc", "z.json"), (None, None), ("sha256:sha256:a", "a/")], "h string, p string")
    got = d.select(orphans.hash_key("h").alias("h"), orphans.path_key("p").alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [("abc", "z.json"), ("abc", "z.json"), (None, None), ("sha256:a", "")]


# ---- drift


def changes(spark, rows, kind, column="config_json"):
    d = spark.createDataFrame(rows, f"stream string, file_no int, {column} string, json_path string")
    return {(r.stream, r.file_no, r.json_path, r.change) for r in drift.field_changes(d, column, kind).collect()}


def test_members_come_and_go(spark):
    rows = [
        ("s", 1, '{"a": 1, "b": {"x": "t"}, "n": null}', ""), ("s", 1, '{"a": 2}', ""), ("s", 2, "{broken", ""), ("s", 2, None, ""),
        ("s", 5, '{"a": "1", "b": {"y": 1}, "n": 3}', ""), ("s", 6, '{"a": "1", "b": [1], "n": 3}', ""), ("u", 3, '{"q": 1}', ""), (None, 1, '{"q": 1}', ""), (None, 2, "{}", ""), ("s", None, '{"z": 1}', ""),
    ]
    assert changes(spark, rows, drift.NESTED) == {
        ("s", 5, "a", "retyped"), ("s", 5, "b.x", "removed"), ("s", 5, "b.y", "added"), ("s", 6, "b", "retyped"), ("s", 6, "b.y", "removed"), (None, 2, "q", "removed"),
    }


def test_elements_and_members_in_arrays(spark):
    rows = [("s", 1, '[{"n": 1}, "t"]', ""), ("s", 2, '[{"n": "1", "m": true}]', ""), ("s", 3, "[]", "")]
    assert changes(spark, rows, drift.ELEMENTS, "failed_gates") == {
        ("s", 2, "[]", "retyped"), ("s", 2, "[].n", "retyped"), ("s", 2, "[].m", "added"), ("s", 3, "[]", "removed"), ("s", 3, "[].n", "removed"), ("s", 3, "[].m", "removed"),
    }
    rows = [("s", 1, '{"p": [{"a": 1, "b": {"c": 1}}, 5]}', ""), ("s", 2, '{"p": [{"a": 1.5, "d": []}]}', "")]
    assert changes(spark, rows, drift.MEMBERS, "raw_tool_input") == {("s", 2, "p[].b", "removed"), ("s", 2, "p[].d", "added")}


def test_no_files(spark):
    assert changes(spark, [], drift.NESTED) == set()


def test_one_table_from_all_files(spark):
    rows = [
        (1, "s", 1, '{"strategy": "a", "n_bootstrap": 5, "walk_forward": {"step_months": 3}}'), (2, "s", 2, '{"strategy_name": "b", "bootstrap_n": "7", "walk_config": "{\\"step_months\\": 4}"}'),
        (3, "s", 3, "{cut"), (4, "s", 4, None),
    ]
    got = {r.id: r for r in drift.config_table(spark.createDataFrame(rows, "id long, stream string, file_no int, config_json string")).collect()}
    assert [(got[i].strategy, got[i].n_bootstrap, got[i].step_months, got[i].valid) for i in (1, 2, 3, 4)] == [("a", 5, 3, True), ("b", 7, 4, True), (None, None, None, False), (None, None, None, False)]
    gates = [(1, "s", 1, '[{"gate": "g", "shortfall": 0.5}, "plain"]'), (2, "s", 2, "7")]
    got = drift.gates_table(spark.createDataFrame(gates, "id long, stream string, file_no int, failed_gates string")).orderBy("pos").collect()
    assert [(r.id, r.name, r.deficit) for r in got] == [(1, "g", "0.5"), (1, "plain", None)]


def test_every_catalogued_path_reaches_the_table(spark):
    config = [
        (1, "s", 1, '{"strategy": "a", "git_dirty": true, "tags": ["n"], "new": {"deep": {"er": 1}}, "backtest_config": {"bar_timeframe": "5m", "unseen": [1]}, "odd.name": null}'),
        (2, "s", 2, '{"walk_forward": {"min_trades_for_objective": 30}, "walk_config": "{\\"embargo_days\\": 3, \\"fresh\\": \\"x\\"}", "strategy": "a", "strategy_name": "b"}'),
        (3, "s", 3, '{"walk_config": "no json", "backtest_config": [1], "walk_forward": null, "strategy": "a", "strategy_name": "a"}'), (4, "s", 4, "[7]"), (5, "s", 5, "{cut"),
    ]
    d = spark.createDataFrame(config, "id long, stream string, file_no int, config_json string")
    got = {r.id: r for r in drift.config_table(d).collect()}
    assert (got[1].git_dirty, got[1].tags, got[1].bar_timeframe, got[2].min_trades_for_objective, got[2].embargo_days) == (True, '["n"]', "5m", 30, 3)
    rest = {i: [tuple(x) for x in r.rest] for i, r in got.items()}
    assert rest == {
        1: [("backtest_config.unseen", "[1]"), ("new", '{"deep":{"er":1}}'), ("odd.name", "null")], 2: [("strategy_name", '"b"'), ("walk_config.fresh", '"x"')],
        3: [("backtest_config", "[1]"), ("walk_config", '"no json"')], 4: [("$", "[7]")], 5: [],
    }
    tool = [(1, "s", 1, '{"name": "n", "notes": "t", "reviewed": true, "confidence": 0.5, "later": [{"a": 1}]}')]
    t = spark.createDataFrame(tool, "log_id long, stream string, file_no int, raw_tool_input string")
    r = drift.tool_table(t).first()
    assert (r.notes, r.reviewed, r.confidence, [tuple(x) for x in r.rest]) == ("t", True, 0.5, [("later", '[{"a":1}]')])
    gates = spark.createDataFrame([(1, "s", 1, '[{"gate": "g", "more": 1}, "plain", 5]')], "id long, stream string, file_no int, failed_gates string")
    g = drift.gates_table(gates).orderBy("pos").collect()
    assert [(x.name, [tuple(y) for y in x.rest]) for x in g] == [("g", [("more", "1")]), ("plain", []), (None, [("$", "5")])]


def test_numbers_stored_as_text(spark):
    config = [
        (1, '{"backtest_config": {"starting_capital": "10,000.00"}, "n_bootstrap": "1,000", "seed": "42.0"}'), (2, '{"backtest_config": {"capital": " 1,234,567.5 "}, "seed": 42.0}'),
        (3, '{"backtest_config": {"starting_capital": "10.000,00", "capital": 5, "realistic_fills": "perhaps"}, "seed": 4.5, "n_bootstrap": [1], "m_baseline": null}'),
        (4, '{"backtest_config": {"starting_capital": "1,00", "realistic_fills": "yes"}, "seed": "9007199254740993"}'),
    ]
    d = spark.createDataFrame([(i, "s", i, c) for i, c in config], "id long, stream string, file_no int, config_json string")
    got = {r.id: r for r in drift.config_table(d).collect()}
    assert [(got[i].starting_capital, got[i].n_bootstrap, got[i].seed, got[i].realistic_fills) for i in (1, 2, 3, 4)] == [
        (10000.0, 1000, 42, None), (1234567.5, None, 42, None), (5.0, None, None, None), (None, None, 9007199254740993, True),
    ]
    assert {i: [tuple(x) for x in r.unread] for i, r in got.items()} == {
        1: [], 2: [], 3: [("backtest_config.realistic_fills", '"perhaps"'), ("backtest_config.starting_capital", '"10.000,00"'), ("n_bootstrap", "[1]"), ("seed", "4.5")],
        4: [("backtest_config.starting_capital", '"1,00"')],
    }
    assert all(r.rest == [] for r in got.values())


def test_every_path_of_the_files_reaches_the_table(spark, data):
    ev, logs = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("evaluations", "generation_logs"))
    for df, column, kind, aliases, read in (
        (ev, "config_json", drift.NESTED, drift.CONFIG_ALIASES, drift.config_table), (ev, "failed_gates", drift.ELEMENTS, drift.GATE_ALIASES, drift.gates_table),
        (logs, "raw_tool_input", drift.MEMBERS, drift.TOOL_ALIASES, drift.tool_table),
    ):
        there = {r.json_path.removeprefix("[].") for r in drift.file_paths(df, column, kind).select("json_path").distinct().collect()}
        kept = {p for _, _, paths in aliases for p in paths} | {r.path for r in read(df).selectExpr("explode(rest.path) as path").distinct().collect()}
        whole = lambda p: p in kept or p.partition(".")[0].partition("[")[0] in kept  # noqa: E731  a value is there with all below it
        section = lambda p: p == "[]" or any(x.startswith(f"{p}.") for x in kept)  # noqa: E731  or by its members
        assert there and [p for p in there if not whole(p) and not section(p)] == []


# ---- gridding


BARS = "bar_id long, feed string, symbol string, asset_class string, time timestamp, close double, volume double, load_no int, slot string, n int"
SESSIONS = "session_date date, opens_at timestamp, closes_at timestamp, half_day boolean"


def at(*a):
    return dt.datetime(*a, tzinfo=UTC)


def grid(spark, rows, sessions=()):
    b = spark.createDataFrame([(i, *r, 1, "", 0) for i, r in enumerate(rows)], BARS)
    s = spark.createDataFrame(list(sessions), SESSIONS)
    return {(r.feed, r.slot): r for r in gridding.to_grid(b, s).collect()}


def test_values_and_coverage(spark):
    rows = [("f", "S", "crypto", at(2024, 1, 1, 0, 1), 10.0, 5.0), ("f", "S", "crypto", at(2024, 1, 1, 0, 3), 20.0, 7.0), ("f", "S", "crypto", at(2024, 1, 1, 0, 25), 30.0, None)]
    g = grid(spark, rows)
    t = int(at(2024, 1, 1).timestamp())
    assert [s for _, s in sorted(g)] == [t + 300 * i for i in range(6)]
    first = g["f", t]
    assert (first.close, first.coverage, first.volume, first.n_readings) == (pytest.approx((10 * 120 + 20 * 120) / 240), 0.8, 12.0, 2)
    assert [g["f", t + 300 * i].status for i in range(6)] == ["observed", "held", "held", "missing", "missing", "observed"]
    assert g["f", t + 600].coverage == 0.6 and g["f", t + 900].close is None


def test_sessions_nulls_and_loads(spark):
    sessions = [(dt.date(2024, 1, d), at(2024, 1, d, 14, 30), at(2024, 1, d, 14, 45), False) for d in (2, 3, 5)]
    rows = [
        ("f", "S", "stocks", at(2024, 1, 2, 14, 36), None, 1.0), ("f", "S", "stocks", at(2024, 1, 2, 14, 41), 5.0, 1.0), ("f", "S", "stocks", at(2024, 1, 2, 14, 41), 6.0, 2.0),
        ("f", "S", "stocks", at(2024, 1, 5, 14, 31), math.nan, 1.0), ("f", "S", "stocks", None, 5.0, 1.0), (None, None, "stocks", at(2024, 1, 3, 14, 30), 1.0, 1.0),
    ]
    g = grid(spark, rows, sessions)
    mine = {s: r for (f, s), r in g.items() if f == "f"}
    t = lambda d, m: int(at(2024, 1, d, 14, m).timestamp())
    assert sorted(mine) == [t(2, 35), t(2, 40), t(3, 30), t(3, 35), t(3, 40), t(5, 30)]
    assert {s for s, r in mine.items() if r.n_readings == 0} == {t(2, 35), t(3, 30), t(3, 35), t(3, 40)}
    assert (mine[t(2, 40)].close, mine[t(2, 40)].volume, mine[t(2, 40)].n_readings) == (6.0, 2.0, 1)
    assert mine[t(5, 30)].n_readings == 1 and mine[t(5, 30)].close is None
    assert [s for (f, s) in g if f is None] == [t(3, 30)]


def test_empty_grid(spark):
    assert grid(spark, []) == {}


# ---- instants

CASES = [
    ("2024-01-31T03:08:37.123Z", None, "2024-01-31T03:08:37.123000Z"), ("2024-11-24T00:50:00.000000725Z", None, "2024-11-24T00:50:00.000000Z"),
    ("2023-09-17T07:52:34-04:00", "Asia/Tokyo", "2023-09-17T11:52:34.000000Z"), ("2022-12-11 11:50:00.5+0530", None, "2022-12-11T06:20:00.500000Z"),
    ("Tue, 01 Mar 2022 09:31:34 +1100", None, "2022-02-28T22:31:34.000000Z"), ("03/19/24 04:27", "Europe/Berlin", "2024-03-19T03:27:00.000000Z"),
    ("10/02/2022 12:50:00 AM", "America/Chicago", "2022-10-02T05:50:00.000000Z"), ("01.08.2023 01:35:00", "America/New_York", "2023-08-01T05:35:00.000000Z"),
    ("  20220201_013500 ", "UTC", "2022-02-01T01:35:00.000000Z"), ("9 Sep 2023 19:16", "Asia/Kolkata", "2023-09-09T13:46:00.000000Z"),
    ("2023-01-31 11:40:38 EST", "Asia/Tokyo", "2023-01-31T16:40:38.000000Z"), ("2023-04-27 00:35:00 CEST", None, "2023-04-26T22:35:00.000000Z"),
    ("2023-10-20T10:00:00[UTC]", None, "2023-10-20T10:00:00.000000Z"), ("2022-12-27 21:20:00 America/New_York", "Asia/Tokyo", "2022-12-28T02:20:00.000000Z"),
    ("1704899100", None, "2024-01-10T15:05:00.000000Z"), ("1642013100000", "Asia/Tokyo", "2022-01-12T18:45:00.000000Z"), ("1718364767000123", None, "2024-06-14T11:32:47.000123Z"),
    ("1.713945000E+09", None, "2024-04-24T07:50:00.000000Z"), ("1666369500.641", None, "2022-10-21T16:25:00.641000Z"),
    ("2023-11-05T01:30:00", "America/New_York", "ambiguous"), ("2023-03-12T02:26:17[America/New_York]", None, "nonexistent"), ("2023-11-05T01:30:00-04:00", "America/New_York", "2023-11-05T05:30:00.000000Z"),
    ("2024-04-07 01:45:00", "Australia/Lord_Howe", "ambiguous"), ("2024-10-06 02:10:00", "Australia/Lord_Howe", "nonexistent"),
    ("2023-05-19T06:55:00", None, "nozone"), ("2023-05-19T06:55:00", "  ", "nozone"), ("2023-13-04T09:00:00Z", None, "unreadable"), ("2024-06-11T25:10:00Z", None, "unreadable"),
    ("2022-11-07T", None, "unreadable"), ("pending", None, "unreadable"), ("", None, "unreadable"), ("-", "UTC", "unreadable"), ("2023-02-30 00:00:00", "UTC", "unreadable"),
    ("2023-05-19T06:55:00", "Mars/Base", "unreadable"), ("2023-05-19 06:55:00 XYZ", None, "unreadable"), ("13/19/24 04:27", "UTC", "unreadable"), (None, "UTC", None), ("x" * 100_000, None, "unreadable"),
]


def test_instants(spark):
    d = spark.createDataFrame([(i, t, z, "old") for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string, instant string")
    got = {r.i: r.instant for r in instants.instants(d, "t", "z").collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong and len(got) == len(CASES)


def test_instants_do_not_depend_on_the_session_zone(spark):
    d = spark.createDataFrame([("03/19/24 04:27", "Europe/Berlin")], "t string, z string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert instants.instants(d, "t", "z").first().instant == "2024-03-19T03:27:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_written_form_is_left_out(spark):
    d = spark.createDataFrame([("a", 1, "2024-01-31T03:08:37.123456+00:00", None), ("a", 2, "2024-01-31T03:08:37+00:00", None), ("a", 3, None, None)], "src string, row_id long, stamp string, zone string")
    assert [r.row_id for r in instants.to_normalise(instants.instants(d, "stamp", "zone")).collect()] == [2]


def test_predicates_on_an_instant_do_not_blow_up(spark):
    import time

    stamps = ["2024-03-10 02:30", "2024-11-03T01:30:00", "03/04/24 5:06 PM", "1.642479346E+09", "x", None, "10 Jan 2022 05:34", "2022-01-10T05:34:00.123456789Z"]
    d = spark.createDataFrame([(i, stamps[i % 8], "America/New_York" if i % 3 else None) for i in range(10_000)], "i int, t string, z string")
    r = instants.instants(d, "t", "z")
    began = time.time()
    kinds = {k.instant: k["count"] for k in r.groupBy("instant").count().where("instant != 'x'").collect()}
    assert r.where("instant != 'x' and length(instant) > 3").count() == 8_750 and sum(kinds.values()) == 8_750
    assert kinds["nozone"] == sum(i % 8 in (0, 1, 2, 6) and i % 3 == 0 for i in range(10_000)) and kinds["unreadable"] == 1_250
    assert r.where("instant like '2022%'").join(r.withColumnRenamed("i", "j").where("j < 8"), "instant").count() > 0
    assert time.time() - began < 60

