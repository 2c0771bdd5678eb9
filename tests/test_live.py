"""Live jobs fed with files in reversed and mixed order: the rows are those of the batch form."""

import pytest
from pyspark.sql import functions as F

from wavetrail.operators import geofence as G
from wavetrail.operators import history as H
from wavetrail.operators import messages as M
from wavetrail.operators import rules as R
from wavetrail.plans import live as PL
from wavetrail.plans import rules as PR
from wavetrail.plans.history import DAY_NS, sessions_of
from wavetrail.plans.messages import parsed
from wavetrail.plans.streams import fixes, geo_sites
from wavetrail.streaming import jobs as J
from wavetrail.streaming import live as L

NS = 10**9
#: The whole record may be late, so nothing is.
PATIENT, UNTIL = "40 days", PL.END_S + 60 * 86400


def deliver(spark, views, path, order):
    """The events in files of equal stretches of the month, delivered one by one."""
    raw, days = views.table("events"), 30 // len(order)
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / days), F.lit(len(order) - 1))
    for i in order:
        raw.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return J.log_stream(spark, path, 1)


@pytest.fixture(scope="module")
def log(spark, views, tmp_path_factory):
    return deliver(spark, views, str(tmp_path_factory.mktemp("reversed")), (2, 1, 0))


@pytest.fixture(scope="module")
def mixed(spark, views, tmp_path_factory):
    return deliver(spark, views, str(tmp_path_factory.mktemp("mixed")), (3, 0, 4, 1, 2))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_traces(views, log, tmp_path):
    batch = H.assign_traces(views.ev.where(F.col("event_type").startswith("protocol.p25.")), DAY_NS)
    got = PL.trace_rows(views, log, str(tmp_path), PATIENT, UNTIL)
    assert rows(got) == rows(batch.select("id", "event_type", "trace_id", "span_id"))
    assert views.spark.read.parquet(f"{tmp_path}/late").isEmpty()


def test_cooldown(views, log, tmp_path):
    want, last = [], None
    for r in views.ev.where("classification = 'FEDL'").orderBy("timestamp_ns").collect():
        if last is None or r.timestamp_ns - last >= 43200 * NS:
            last = r.timestamp_ns
            want.append((5, last))
    assert rows(PL.cooldown_rows(views, log, str(tmp_path), PATIENT, UNTIL)) == sorted(map(repr, want)) and len(want) > 10


def test_silences(views, log, tmp_path):
    times = [PL.EPOCH_S * NS] + [r.timestamp_ns for r in views.hits.orderBy("timestamp_ns").collect()]
    want = [(4, a, a + 7200 * NS) for a, b in zip(times, [*times[1:], UNTIL * NS]) if b - a > 7200 * NS]
    want.append((3, PL.EPOCH_S * NS, (PL.EPOCH_S + 3600) * NS))  # never matches, told once
    assert rows(PL.silence_rows(views, log, str(tmp_path), PATIENT, UNTIL)) == sorted(map(repr, want))


def test_analysis(views, mixed, tmp_path):
    got = PL.analysis_rows(views, mixed, str(tmp_path), PATIENT, UNTIL)
    new = F.concat(F.lit("New UID "), "uid", F.lit(" on TG "), "tgid").alias("summary")
    s = sessions_of(views)
    want = (
        H.key_rotations(views.crypto).select(F.lit("crypto_rotation").alias("finding"), "id", "summary")
        .unionByName(H.first_sightings(views.gr).select(F.lit("new_uid").alias("finding"), "id", new))
        .unionByName(s.select(F.lit("traffic_session").alias("finding"), F.col("channel_id").alias("id"), M.session_text(F.col("duration_sec"), F.col("avg_signal")).alias("summary")))
        .unionByName(M.network_findings(parsed(views), "SYS").select("finding", "id", "summary"))
    )
    assert rows(got.select("finding", "id", "summary")) == rows(want)


def test_counted_rules(views, log, tmp_path):
    want = R.counted_firings(views.ev, PR.RULES, PR.STEP, PR.START, PR.END)
    assert rows(PL.counted_rows(views, log, str(tmp_path), PATIENT, UNTIL)) == rows(want.select("rule_id", "at_s", "match_count"))


def test_new_values(views, log, tmp_path):
    last, want = {}, []
    for r in views.gr.where("tgid IS NOT NULL").orderBy("timestamp_ns", "id").collect():
        if r.timestamp_ns - last.get(r.tgid, -(10**19)) > 2 * DAY_NS:
            want.append((12, r.id, str(r.tgid)))
        last[r.tgid] = r.timestamp_ns
    assert rows(PL.new_value_rows(views, log, str(tmp_path), PATIENT, UNTIL)) == sorted(map(repr, want))


def test_site_visits(views, log, tmp_path):
    want = G.site_visits(fixes(views.ev).drop("ts"), geo_sites(views))
    got = PL.visit_rows(views, log, str(tmp_path), PATIENT, UNTIL)
    assert rows(got) == rows(want.select("device", "id", "timestamp_ns", "change", "site_id"))


def test_late_rows_have_a_sink_of_their_own(views, log, tmp_path):
    """With ten minutes of patience, files that come late are reported row by row, and every row is in one of the two sinks."""
    p25 = views.ev.where(F.col("event_type").startswith("protocol.p25."))
    got = {r.id for r in PL.trace_rows(views, log, str(tmp_path), "10 minutes").collect()}
    late = {r.id for r in views.spark.read.parquet(f"{tmp_path}/late").collect()}
    assert got and late and not got & late
    assert got | late == {r.id for r in p25.select("id").collect()}


def test_sessions_close_by_the_clock_alone():
    """Hits two apart, expiry by a heartbeat, single hits dropped."""
    t, memory = L.Sessions(2 * NS), {}
    row = {"channel_id": 7, "freq_key": "155.100", "power": -50.0}
    assert [t.step(memory, {**row, "timestamp_ns": k * NS}) for k in (0, 2, 4)] == [[], [], []]
    assert t.deadline(memory) == 6 * NS
    (done,) = t.step(memory, {**row, "timestamp_ns": 7 * NS})
    assert (done["hit_count"], done["duration_sec"], done["avg_signal"], done["channel_id"]) == (3, 4.0, -50.0, 7)
    assert t.expire(memory) == [] and memory == {}
