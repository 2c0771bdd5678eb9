"""Sinks, files, and streams fed in several batches."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetrail.functions import frames as A
from wavetrail.operators import filters as P
from wavetrail.operators import history as H
from wavetrail.operators.rules import Rule, matches
from wavetrail.plans.history import DAY_NS
from wavetrail.sources import readers, sinks
from wavetrail.sources.bindings import EPOCH_S
from wavetrail.streaming import jobs as J

NS = 10**9


@pytest.fixture(scope="module")
def parts(spark, views, tmp_path_factory):
    """The events table in five files, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    raw = views.table("events")
    for i in range(5):
        day = F.dayofmonth("ts")
        raw.where((day > i * 6) & (day <= i * 6 + 6) | (F.lit(i == 4) & (day > 30))).orderBy("ts").coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_traces_equal_batch(spark, views, parts, tmp_path):
    log = J.log_stream(spark, parts, 1).where(F.col("event_type").startswith("protocol.p25."))
    J.run_to_end(J.trace_stream(log, DAY_NS, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/cp")
    got = {r.id: (r.trace_id, r.span_id) for r in spark.read.schema(J.TRACED).parquet(f"{tmp_path}/out").collect()}
    batch = H.assign_traces(views.ev.where(F.col("event_type").startswith("protocol.p25.")), DAY_NS)
    assert got == {r.id: (r.trace_id, r.span_id) for r in batch.collect()}


def test_stream_append_restarts_without_loss(spark, views, parts, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        J.run_to_end(J.append_log(J.log_stream(spark, parts, 1), f"{tmp_path}/log"), f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/log").count() == views.ev.count()


def test_stream_threshold_windows(spark, views, parts, tmp_path):
    rule = Rule(1, "grants", "threshold", (P.Eq("type", "protocol.p25.grant"),), 6 * 3600, "gte", 3.0)
    out = J.threshold_stream(J.log_stream(spark, parts, 1), rule, 3600, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    J.run_to_end(out, f"{tmp_path}/cp")
    got = {(r["at"], r["match_count"]) for r in spark.read.schema("rule_id int, at timestamp, match_count long").parquet(f"{tmp_path}/out").collect()}
    w = F.window("ts", "6 hours", "1 hour")
    batch = views.ev.where(F.col("event_type") == "protocol.p25.grant").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    want = {(r.w.end, r.n) for r in batch.collect()}
    assert got and got <= want  # the last windows are still open


def test_stream_cooldown_over_batches(spark, views, parts, tmp_path):
    rule = Rule(5, "federal", "first_occurrence", (P.Eq("cls", "FEDL"),), cooldown_sec=43200)
    hits = matches(J.log_stream(spark, parts, 1), [rule]).select("ts", "rule_id", "timestamp_ns")
    J.run_to_end(J.cooldown_stream(hits, 43200, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/cp")
    got = sorted(r.timestamp_ns for r in spark.read.schema("rule_id int, timestamp_ns long").parquet(f"{tmp_path}/out").collect())
    want, last = [], None
    for r in views.ev.where("classification = 'FEDL'").orderBy("timestamp_ns").collect():
        if last is None or r.timestamp_ns - last >= 43200 * NS:
            want.append(r.timestamp_ns)
            last = r.timestamp_ns
    assert got == want


def test_stream_distinct_windows(spark, views, parts, tmp_path):
    rule = Rule(13, "bands", "cardinality", (P.Exists("uid"),), 6 * 3600, "gte", 3.0, field="band")
    out = J.cardinality_stream(J.log_stream(spark, parts, 1), rule, 3600, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    J.run_to_end(out, f"{tmp_path}/cp")
    got = {r["at"] for r in spark.read.schema("rule_id int, at timestamp, match_count long").parquet(f"{tmp_path}/out").collect()}
    w = F.window("ts", "6 hours", "1 hour")
    want = {r.w.end for r in views.ev.groupBy(w.alias("w")).agg(F.count_distinct("band").alias("n")).where("n >= 3").collect()}
    assert got and got <= want


def test_stream_absence_finds_every_silence(spark, views, parts, tmp_path):
    rule = Rule(4, "quiet", "absence", (P.Eq("type", "spectrum.detect"),), 8 * 3600)
    J.run_to_end(J.absence_stream(J.log_stream(spark, parts, 1), rule, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/cp")
    rows = spark.read.schema("rule_id int, since_ns long, until_ns long").parquet(f"{tmp_path}/out").collect()
    times = [r.timestamp_ns for r in views.hits.orderBy("timestamp_ns").collect()]
    want = {(a, b) for a, b in zip(times, times[1:]) if b - a > 8 * 3600 * NS}
    assert want and {(r.since_ns, r.until_ns) for r in rows if r.until_ns} == want


def test_partition_pruning_reaches_the_scan(spark, views, tmp_path):
    from wavetrail.operators.query import time_range

    sinks.append_events(views.ev, f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    start = (EPOCH_S + 5 * 86400) * NS
    week = time_range(log, start, start + DAY_NS + DAY_NS // 2)
    assert week.select("event_date").distinct().count() == 2
    text = week._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text and "PushedFilters: [IsNotNull(timestamp_ns)" in text


def test_purge_rewrites_only_the_day_of_the_cut(spark, views):
    spark.sql("DROP TABLE IF EXISTS purge_log")
    sinks.with_event_date(views.ev).write.mode("overwrite").partitionBy("event_date").format("parquet").saveAsTable("purge_log")
    cut = (EPOCH_S + 10 * 86400 + 40_011) * NS
    want = {r.id for r in sinks.kept_after_purge(views.ev, cut).select("id").collect()}
    sinks.purge_table(spark, "purge_log", cut)
    left = spark.table("purge_log")
    assert {r.id for r in left.select("id").collect()} == want
    assert left.agg(F.min("event_date").alias("d")).first().d == datetime.date(2024, 1, 11)
    spark.sql("DROP TABLE purge_log")


def test_read_only_sql_refuses_writes(spark, views):
    views.ev.createOrReplaceTempView("event_log")
    assert sinks.run_read_only(spark, "SELECT count(*) AS n FROM event_log").first().n == views.ev.count()
    for text in (
        "  drop view event_log", "/* x */ DROP VIEW event_log", "-- c\nDROP VIEW event_log", "SET spark.sql.ansi.enabled=false", "CACHE TABLE event_log",
        "WITH x AS (SELECT 1) INSERT INTO event_log SELECT * FROM x", "SELECT 1) ; DROP VIEW event_log", "SELECT 1; SELECT 2",
    ):
        with pytest.raises(ValueError):
            sinks.run_read_only(spark, text)
    assert spark.catalog.tableExists("event_log")
    many = sinks.run_read_only(spark, "WITH r AS (SELECT id FROM range(25000)) SELECT id FROM r ORDER BY id DESC -- all of them")
    assert many.count() == 25_000 and many.first().id == 24_999


def test_iq_files(spark, tmp_path):
    z = np.exp(2j * np.pi * 64 * np.arange(1024) / 1024)
    np.stack([z.real, z.imag], 1).astype("<f4").tofile(tmp_path / "tone.iq")
    np.zeros(200, dtype="<f4").tofile(tmp_path / "short.iq")
    (tmp_path / "odd.iq").write_bytes(b"\0" * 8003)
    rows = readers.iq_files(spark, str(tmp_path), pairs_per_row=512)
    got = {(r.path.rsplit("/", 1)[1], r.part): (r.n, r.enough_samples) for r in rows.select("path", "part", "enough_samples", F.size("i").alias("n")).collect()}
    assert got == {("tone.iq", 0): (512, True), ("tone.iq", 1): (512, True), ("short.iq", 0): (100, False), ("odd.iq", 0): (512, True), ("odd.iq", 1): (488, True)}
    psd = rows.where("part = 0 AND path LIKE '%tone.iq'").select(A.welch_psd(512)("i", "q").alias("p")).first().p
    assert abs(max(psd)) < 0.5


def test_frequency_list_file(spark, tmp_path):
    (tmp_path / "list.json").write_text('{"conventional": [{"freq": 162.4, "name": "WX", "cls": "PUBS", "band": "VHF", "mode": "NFM"}, {"freq": 155.1, "name": "X", "cls": "COMM", "band": "VHF"}]}')
    got = readers.read_frequency_list(spark, str(tmp_path / "list.json")).orderBy("position").collect()
    assert [(r.freq, r.name, r["mode"], r.tag) for r in got] == [(162.4, "WX", "NFM", None), (155.1, "X", None, None)]


def test_stream_new_values_by_last_sighting_over_batches(spark, views, parts, tmp_path):
    rule = Rule(9, "band", "new_value", (P.Exists("band"),), baseline_sec=2 * 86400, field="band")
    out = J.new_value_stream(J.log_stream(spark, parts, 1), rule).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    J.run_to_end(out, f"{tmp_path}/cp")
    got = sorted((r.value, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows = sorted((r.timestamp_ns, r.id, r.band) for r in views.ev.where("band IS NOT NULL").select("timestamp_ns", "id", "band").collect())
    last, want = {}, []
    for ns, i, band in rows:
        if band not in last or ns - last[band] > 2 * 86400 * NS:
            want.append((band, i))
        last[band] = ns
    assert got == sorted(want)
