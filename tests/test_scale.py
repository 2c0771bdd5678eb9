"""What a step costs: rows, calls and passes do not grow faster than the input."""

import json
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from wavetrail.operators import messages as M
from wavetrail.operators.joins import count_intervals, with_intervals
from wavetrail.plans.messages import parsed
from wavetrail.streaming import live as L


def test_sessions_are_counted_without_a_row_for_each(spark):
    t = "2024-01-01 "
    spans = [(1, "00:00:00", "06:00:00"), (1, "00:00:00", "06:00:00"), (1, "05:30:00", "05:30:00"), (1, "05:45:00.000001", None), (2, "03:00:00", "02:00:00"),
             (2, "23:30:00", "23:59:59.999999"), (None, "01:00:00", "05:45:00"), (3, None, "04:00:00")]
    rows = [(i, k, a and t + a, b and t + b) for i, (k, a, b) in enumerate(spans)] * 2
    sessions = spark.createDataFrame(rows, "session_id long, site_id long, start_time string, end_time string")
    sessions = sessions.withColumn("start_time", F.to_timestamp("start_time")).withColumn("end_time", F.to_timestamp("end_time"))
    times = ["00:00:00", "01:00:00", "05:29:59.999999", "05:30:00", "05:30:00.000001", "05:45:00", "05:45:00.000001", "06:00:00", "06:00:00.000001", "23:30:00", "23:59:59.999999"]
    grants = spark.createDataFrame([(i, t + x) for i, x in enumerate(times)] + [(99, None)], "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    as_of = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    each = with_intervals(grants, F.unix_micros("ts"), sessions, as_of, ["session_id", "site_id"])
    want = sorted(map(repr, map(tuple, each.groupBy("id", "site_id").count().collect())))
    counted = count_intervals(grants, F.unix_micros("ts"), sessions, as_of, ["site_id"])
    assert counted.columns == ["id", "ts", "site_id", "covers"]
    assert sorted(map(repr, map(tuple, counted.select("id", "site_id", "covers").collect()))) == want and len(want) > 10


def test_pairs_of_one_cell_are_dealt_over_tasks(spark):
    us = F.timestamp_micros(F.lit(1704067200 * 10**6) + F.col("m"))
    n = F.col("n")
    # all but a few grants within one half hour, some twice, some without an id; sessions begin and end inside of it, cover it, or are open
    grants = spark.range(0, 900, 1, 1).select(F.col("id").alias("n")).select(
        F.when(n % 90 != 7, n - n % 3).alias("id"), F.when(n % 100 == 99, 3 * 1800 * 10**6 + n).otherwise((n - n % 3) * 10**6).alias("m")
    ).withColumn("ts", us)
    sessions = spark.range(0, 60, 1, 1).select(F.col("id").alias("n")).select(
        F.when(n != 5, n - n % 2).alias("session_id"), F.when(n % 11 != 0, n % 10).alias("site_id"), ((n % 7) * 300 * 10**6).alias("m"), n
    ).withColumn("start_time", us).withColumn("m", F.col("m") + F.when(n % 9 != 0, n % 4 * 1500 * 10**6)).withColumn("end_time", us).drop("m", "n")
    as_of = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    got = with_intervals(grants.drop("m"), F.unix_micros("ts"), sessions, as_of, ["session_id", "site_id"], block=100)
    assert got.columns == ["id", "ts", "session_id", "site_id"]
    held = [(s.session_id, s.site_id, s.start_time, s.end_time) for s in sessions.withColumn("end_time", F.coalesce("end_time", as_of)).collect()]
    want = [(g.id, g.ts, i, k) for g in grants.collect() for i, k, a, b in held if a <= g.ts <= b]
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(repr(tuple(r[:4])) for r in rows) == sorted(map(repr, want)) and len(want) > 10_000
    assert len({r.task for r in rows}) > 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "SortMergeJoin" in plan  # pieces are not broadcast


def test_equal_rows_of_a_block_are_cut_into_lists(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:10:00"))
    grants = spark.range(700).select(F.lit(1).alias("id"), at.alias("ts"))
    sessions = spark.range(3).select(F.col("id").alias("session_id"), at.alias("start_time"), at.alias("end_time"))
    got = with_intervals(grants, F.unix_micros("ts"), sessions, at, ["session_id"], block=10)
    assert [tuple(r) for r in got.groupBy("id", "session_id").count().orderBy("session_id").collect()] == [(1, i, 700) for i in range(3)]


class Handle:
    """The state of one group in memory; counts the calls that change it."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def getListState(self, name, schema):
        held = []

        def append(value):
            self.calls += 1
            held.append(value)

        def put(values):
            self.calls += 1
            held[:] = values

        return SimpleNamespace(appendValue=append, put=put, get=lambda: list(held), exists=lambda: bool(held), clear=held.clear)

    def getValueState(self, name, schema):
        held = []

        def update(value):
            self.calls += 1
            held[:] = [value]

        return SimpleNamespace(update=update, get=lambda: held[0] if held else None, exists=lambda: bool(held), clear=held.clear)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_live_keys_of_a_group_share_calls():
    handle, ms = Handle(), L.MS
    process = L.InOrder({"visit": L.Visits()})
    process.init(handle)
    rows = [Row(tracker="visit", group=1, key=str(k), timestamp_ns=n * ms, given=json.dumps({"rank": 1, "id": 10 * k + n, "channel_id": n % 2 or None, "note": ""})) for n in (3, 2, 1, 9) for k in range(500)]
    clock = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    assert list(process.handleInputRows(("visit", 1), iter(rows), clock(0))) == []
    assert handle.timers == {1} and handle.calls == 2
    handle.timers.clear()
    found = list(process.handleExpiredTimer(("visit", 1), clock(5), None))
    seen = {}
    for r in found:
        seen.setdefault(r["key"], []).append((r["timestamp_ns"] // ms, r["finding"], r["channel_id"]))
    assert len(seen) == 500 and all(v == [(1, "enter", 1), (2, "exit", 1), (3, "enter", 1)] for v in seen.values())
    assert handle.timers == {9} and handle.calls == 5
    late = list(process.handleInputRows(("visit", 1), iter(rows[:1]), clock(5)))
    assert [(r["key"], r["late"], r["id"], r["timestamp_ns"]) for r in late] == [("0", True, 3, 3 * ms)]
    handle.timers.clear()
    found = list(process.handleExpiredTimer(("visit", 1), clock(10), None))
    assert [(r["finding"], r["timestamp_ns"]) for r in found] == [("exit", 9 * ms)] * 500


def test_live_rows_keep_their_values():
    given = {"rank": 0, "id": -1, "low_ns": 2**62 + 1, "power": "NaN", "note": "a, \"b\" é"}
    row = L._unpack(7, json.dumps(given))
    assert (row["timestamp_ns"], row["low_ns"], row["power"], row["note"], row["tgid"]) == (7, 2**62 + 1, None, given["note"], None)
    assert L._unpack(7, '{"power": "-Infinity"}')["power"] == float("-inf")


def test_messages_are_parsed_once(spark, views):
    for made in (M.network_sites, M.network_grants):
        plan = made(parsed(views), "SYS")._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan
