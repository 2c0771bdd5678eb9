"""Enrichment, geofence, sinks and streaming jobs replayed over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail.operators import enrich as N
from wavetrail.operators import filters as P
from wavetrail.operators import geofence as G
from wavetrail.operators import history as H
from wavetrail.operators import messages as M
from wavetrail.operators import spectrum as X
from wavetrail.operators.rules import Rule, matches, rule_table
from wavetrail.plans.history import DAY_NS, ROT_CTE, sessions_cte, sessions_of, traces_cte
from wavetrail.plans.messages import FIND_SQL, MSG_CTE, parsed
from wavetrail.plans.presets import EVENT_PRESETS
from wavetrail.plans.registry import query
from wavetrail.plans.spectrum import CFAR_CTE, G as GUARD, MERGE, MERGE_CTE, PFA, T as TRAIN
from wavetrail.session import shared_dir
from wavetrail.sources import sinks
from wavetrail.sources.bindings import EPOCH_S, bind_event_log
from wavetrail.streaming import jobs as J


def scratch(v, name: str) -> str:
    """A new folder for one run, below the cluster's shared folder."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


# --- enrichment ------------------------------------------------------------


@N.enricher("drop_noise")
def drop_noise(log):
    return log.where(F.col("severity") >= 5)


@N.enricher("tag_band")
def tag_band(log):
    return log.withColumn("classification", F.coalesce("classification", F.concat(F.lit("BAND-"), F.col("band"))))


ENRICH_SQL = "SELECT id, event_type, COALESCE(classification, concat('BAND-', band)) AS classification FROM ev WHERE severity >= 5"


@query("stm01_enrichment_chain", ENRICH_SQL)
def _(v):
    return N.enrich(v.ev, ["drop_noise", "tag_band"]).select("id", "event_type", "classification")


@query("udx01_enricher_plugin", "SELECT id, event_type, COALESCE(classification, concat('BAND-', band)) AS classification, k * 2 AS doubled FROM ev WHERE severity >= 5")
def _(v):
    double = lambda df: df.withColumn("doubled", F.col("k") * 2)
    return N.enrich(v.ev, ["drop_noise", double, "tag_band"]).select("id", "event_type", "classification", "doubled")


POS_CTE = """
pos AS (SELECT id, timestamp_ns, device_key, CASE WHEN k % 13 = 0 THEN 0e0 ELSE 45 + (k % 10)*0.01e0 END AS lat, -122 - (k % 7)*0.01e0 AS lon FROM ev WHERE event_type = 'sigex.emitter.new'),
fixes AS (SELECT * FROM pos WHERE abs(lat) > 0.01),
evs AS (SELECT *, CASE WHEN k % 5 = 0 THEN 44e0 END AS receiver_lat, CASE WHEN k % 5 = 0 THEN -121e0 END AS receiver_lon FROM ev WHERE event_type LIKE 'protocol.%')"""


@query(
    "stm02_position_stamp",
    """SELECT e.id, ROUND(CASE WHEN receiver_lat IS NOT NULL THEN receiver_lat ELSE p.lat END, 6) AS receiver_lat, ROUND(CASE WHEN receiver_lat IS NOT NULL THEN receiver_lon ELSE p.lon END, 6) AS receiver_lon FROM evs e
       LEFT JOIN LATERAL (SELECT lat, lon FROM fixes p WHERE p.device_key = e.device_key AND p.timestamp_ns <= e.timestamp_ns ORDER BY p.timestamp_ns DESC, p.id DESC LIMIT 1) p ON TRUE""",
    POS_CTE,
)
def _(v):
    k = F.col("k")
    pos = v.ev.where(F.col("event_type") == "sigex.emitter.new").select(
        "id", "timestamp_ns", "device_key", F.when(k % 13 == 0, 0.0).otherwise(45 + (k % 10) * 0.01).alias("lat"), (-122 - (k % 7) * 0.01).alias("lon")
    )
    own = k % 5 == 0
    ev = v.ev.where(F.col("event_type").startswith("protocol.")).select(
        "id", "timestamp_ns", "device_key", F.when(own, F.lit(44.0)).alias("receiver_lat"), F.when(own, F.lit(-121.0)).alias("receiver_lon")
    )
    out = N.stamp_position(ev, pos)
    return out.select("id", F.round("receiver_lat", 6).alias("receiver_lat"), F.round("receiver_lon", 6).alias("receiver_lon"))


@query(
    "stm03_context_stamp",
    """SELECT e.id, CASE WHEN s.session_id > 0 AND (s.end_time IS NULL OR e.ts <= s.end_time) THEN s.session_id END AS site_session_id,
        COALESCE(CASE WHEN e.k % 9 = 0 THEN 77 END, CASE WHEN s.end_time IS NULL OR e.ts <= s.end_time THEN s.operation_id END) AS operation_id
       FROM ev e LEFT JOIN LATERAL (SELECT id AS session_id, end_time, 1 + site_id AS operation_id FROM ss WHERE concat('dev-', site_id % 2) = e.device_key AND start_time <= e.ts ORDER BY start_time DESC, id DESC LIMIT 1) s ON TRUE""",
)
def _(v):
    sessions = v.ss.select(
        F.col("id").alias("session_id"), F.concat(F.lit("dev-"), F.col("site_id") % 2).alias("device_key"), (1 + F.col("site_id")).alias("operation_id"),
        "start_time", "end_time",
    )
    ev = v.ev.select("id", "timestamp_ns", "device_key", F.when(F.col("k") % 9 == 0, F.lit(77).cast("long")).alias("operation_id"))
    return N.stamp_context(ev, sessions).select("id", "site_session_id", "operation_id")


GEO_CTE = """
site AS (SELECT r_regionkey::BIGINT AS site_id, 45 + r_regionkey*0.04e0 AS lat, -122e0 AS lon, 1500e0 + 100*r_regionkey AS r FROM region),
track AS (SELECT id, source_unit AS device, timestamp_ns, 44.98e0 + (k % 21)*0.01e0 AS lat, -122 + (k % 3)*0.005e0 AS lon, row_number() OVER (PARTITION BY source_unit ORDER BY timestamp_ns, id) AS rn FROM ev WHERE k % 13 <> 0),
dist AS (SELECT t.id, s.site_id, s.r, 6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS d FROM (
   SELECT t.id, s.site_id, s.r, POWER(sin(radians(s.lat - t.lat)/2), 2) + cos(radians(t.lat))*cos(radians(s.lat))*POWER(sin(radians(s.lon - t.lon)/2), 2) AS a FROM track t, site s) AS t, LATERAL (SELECT t.site_id AS site_id, t.r AS r) s),
near AS (SELECT id, COALESCE(arg_min(site_id, (d, site_id)) FILTER (WHERE d <= r), -1) AS enter, COALESCE(list(site_id) FILTER (WHERE d <= 2*r), []) AS keep FROM dist GROUP BY 1),
steps AS (SELECT t.*, n.enter, n.keep FROM track t JOIN near n USING (id)),
walk AS (WITH RECURSIVE w AS (
  SELECT device, 0::BIGINT AS rn, -1::BIGINT AS st, NULL::VARCHAR AS change, NULL::BIGINT AS site_id, NULL::BIGINT AS id, NULL::BIGINT AS timestamp_ns FROM (SELECT DISTINCT device FROM track)
  UNION ALL SELECT s.device, s.rn, CASE WHEN w.st >= 0 THEN CASE WHEN list_contains(s.keep, w.st) THEN w.st ELSE -1 END ELSE s.enter END,
    CASE WHEN w.st >= 0 THEN CASE WHEN list_contains(s.keep, w.st) THEN NULL ELSE 'exit' END WHEN s.enter >= 0 THEN 'enter' END,
    CASE WHEN w.st >= 0 THEN w.st ELSE s.enter END, s.id, s.timestamp_ns
  FROM w JOIN steps s ON s.device = w.device AND s.rn = w.rn + 1) SELECT * FROM w WHERE change IS NOT NULL)"""


def geo_sites(v):
    r = F.col("r_regionkey").cast("long")
    return v.table("region").select(r.alias("site_id"), (45 + r * 0.04).alias("lat"), F.lit(-122.0).alias("lon"), (1500.0 + 100 * r).alias("radius_m"))


def fixes(log):
    """Positions of devices by event."""
    k = F.col("k")
    return log.select("id", "ts", F.col("source_unit").alias("device"), "timestamp_ns", (44.98 + (k % 21) * 0.01).alias("lat"), F.when(k % 13 != 0, -122 + (k % 3) * 0.005).alias("lon"))


@query("stm16_geofence_sessions", "SELECT device, id, timestamp_ns, change, site_id FROM walk", GEO_CTE)
def _(v):
    return G.site_visits(fixes(v.ev).drop("ts"), geo_sites(v), 5 * DAY_NS)


# --- sinks -----------------------------------------------------------------

WEEK = (EPOCH_S + 7 * 86400) * 10**9, (EPOCH_S + 14 * 86400) * 10**9
WEEK_SQL = f"SELECT id, timestamp_ns, event_type, freq_mhz, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE timestamp_ns BETWEEN {WEEK[0]} AND {WEEK[1]}"


def week_of(v, path):
    from wavetrail.operators.query import time_range

    log = time_range(v.spark.read.schema(T.StructType(v.ev.schema.fields + [T.StructField("event_date", T.DateType())])).parquet(path), *WEEK)
    return log.select("id", "timestamp_ns", "event_type", "freq_mhz", F.date_format("event_date", "yyyy-MM-dd").alias("day"))


@query("snk01_batch_append", WEEK_SQL)
def _(v):
    path = scratch(v, "snk01")
    sinks.append_events(v.ev, path)
    return week_of(v, path)


def raw_stream(v, schema=None):
    source = f"{v.dir}/events*.parquet"
    return bind_event_log(J.read_stream(v.spark, source))


@query("snk02_stream_append", WEEK_SQL)
def _(v):
    path = scratch(v, "snk02")
    J.run_to_end(J.append_log(raw_stream(v), f"{path}/log"), f"{path}/checkpoint")
    return week_of(v, f"{path}/log")


EMB = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def frame_stream(v):
    raw = J.read_stream(v.spark, f"{v.dir}/embeddings*.parquet", schema=EMB)
    return raw.select(
        F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("sensor"), (EPOCH_S + F.col("vec_id")).alias("t_s"),
        (150e6 + F.col("label") * 64e3).alias("tile_center_hz"), F.lit(1e3).alias("bin_hz"), F.transform("embedding", lambda x: -70 + 60 * x.cast("double")).alias("psd"),
    )


@query(
    "snk03_detection_append",
    "SELECT 1 AS mission_id, frame_id, sensor, ROUND(center_hz, 4) AS center_hz, ROUND(snr_db, 6) AS snr_db FROM merged",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    path = scratch(v, "snk03")
    key = ["mission_id", "sensor", "t_s", "center_hz"]
    make = lambda b: X.detect(b, TRAIN, GUARD, PFA, 6.0, MERGE).withColumn("mission_id", F.lit(1)).dropDuplicates(key)
    J.run_to_end(J.append_batches(frame_stream(v), f"{path}/detections", make), f"{path}/checkpoint")
    rows = v.spark.read.parquet(f"{path}/detections")
    return rows.select("mission_id", "frame_id", "sensor", F.round("center_hz", 4).alias("center_hz"), F.round("snr_db", 6).alias("snr_db"))


@query(
    "stm19_two_sinks",
    "SELECT 'telemetry' AS sink, COUNT(*) AS n FROM ev UNION ALL SELECT 'detections', COUNT(*) FROM ev WHERE event_type = 'spectrum.detect'",
)
def _(v):
    path = scratch(v, "stm19")
    writers = J.fan_out(raw_stream(v).select("id", "event_type"), f"{path}/telemetry", f"{path}/detections", F.col("event_type") == "spectrum.detect")
    for name, w in zip(("telemetry", "detections"), writers):
        J.run_to_end(w, f"{path}/checkpoint-{name}")
    count = lambda s: v.spark.read.schema("id long, event_type string").parquet(f"{path}/{s}").agg(F.count(F.lit(1)).alias("n")).withColumn("sink", F.lit(s))
    return count("telemetry").unionByName(count("detections"))


# --- stateful streams ------------------------------------------------------


@query("stm04_stream_traces", "SELECT id, event_type, trace_id, span_id FROM traced", traces_cte())
def _(v):
    path = scratch(v, "stm04")
    log = raw_stream(v).where(F.col("event_type").startswith("protocol.p25."))
    out = J.trace_stream(log, DAY_NS, "10 minutes").writeStream.format("parquet").option("path", f"{path}/traced")
    J.run_to_end(out, f"{path}/checkpoint")
    return v.spark.read.schema(J.TRACED).parquet(f"{path}/traced").select("id", "event_type", "trace_id", "span_id")


NEW_TG = Rule(12, "New Talkgroup Spotter", "new_value", (P.Eq("type", "protocol.p25.grant"),), baseline_sec=86400 * 2, field="talkgroup")


@query(
    "stm09_stream_new_values",
    """SELECT 12 AS rule_id, id, value FROM (SELECT id, talkgroup::VARCHAR AS value, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY talkgroup ORDER BY timestamp_ns, id) AS gap
       FROM ev WHERE event_type = 'protocol.p25.grant' AND talkgroup IS NOT NULL) WHERE gap IS NULL OR gap > 172800000000000""",
)
def _(v):
    path = scratch(v, "stm09")
    out = J.new_value_stream(raw_stream(v), NEW_TG).writeStream.format("parquet").option("path", f"{path}/new")
    J.run_to_end(out, f"{path}/checkpoint")
    return v.spark.read.schema("rule_id int, id long, timestamp_ns long, value string").parquet(f"{path}/new").select("rule_id", "id", "value")


PAIR = Rule(21, "voice near emitter", "correlation", (P.Eq("type", "sigex.emitter.new"), P.Eq("band", "VHF")), 6 * 3600, second=(P.Eq("type", "protocol.p25.voice"), P.Eq("enc", True)), field="uid")


@query(
    "stm10_stream_correlation",
    """SELECT 21 AS rule_id, a.source_unit::VARCHAR AS value, a.id AS a_id, b.id AS b_id FROM ev a JOIN ev b ON a.source_unit = b.source_unit AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR
       WHERE a.event_type = 'sigex.emitter.new' AND a.band = 'VHF' AND b.event_type = 'protocol.p25.voice' AND b.encrypted""",
)
def _(v):
    path = scratch(v, "stm10")
    out = J.correlation_stream(raw_stream(v), raw_stream(v), PAIR, "10 minutes").writeStream.format("parquet").option("path", f"{path}/pairs")
    J.run_to_end(out, f"{path}/checkpoint")
    return v.spark.read.schema("rule_id int, value string, a_id long, b_id long").parquet(f"{path}/pairs")


@query(
    "win08_stream_cooldown",
    """SELECT 5 AS rule_id, t AS timestamp_ns FROM w WHERE t IS NOT NULL""",
    """w AS (WITH RECURSIVE r AS (SELECT MIN(timestamp_ns) AS t FROM ev WHERE classification = 'FEDL' UNION ALL
  SELECT (SELECT MIN(timestamp_ns) FROM ev WHERE classification = 'FEDL' AND timestamp_ns >= r.t + 43200000000000) FROM r WHERE r.t IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    path = scratch(v, "win08")
    rule = Rule(5, "Federal Activity Detected", "first_occurrence", (P.Eq("cls", "FEDL"),), cooldown_sec=12 * 3600)
    hits = matches(raw_stream(v), [rule]).select("ts", "rule_id", "timestamp_ns")
    J.run_to_end(J.cooldown_stream(hits, rule.cooldown_sec, "10 minutes").writeStream.format("parquet").option("path", f"{path}/fired"), f"{path}/checkpoint")
    return v.spark.read.schema("rule_id int, timestamp_ns long").parquet(f"{path}/fired")


@query(
    "stm15_stream_rules",
    "SELECT id AS source_event_id, 14 AS rule_id, concat('Encrypted voice on TG ', talkgroup, ' at ', printf('%.4f', freq_mhz)) AS body FROM ev WHERE event_type = 'protocol.p25.voice' AND encrypted",
)
def _(v):
    path = scratch(v, "stm15")
    table = rule_table(v.spark, [EVENT_PRESETS[3]])
    J.run_to_end(J.every_stream(raw_stream(v), lambda: table, f"{path}/derived"), f"{path}/checkpoint")
    return v.spark.read.parquet(f"{path}/derived").select("source_event_id", "rule_id", "body")


# --- three-tier analysis ---------------------------------------------------


@query(
    "stm20_analysis_job",
    f"""SELECT finding, id, summary, CASE finding WHEN 'crypto_rotation' THEN 13 WHEN 'emergency_grant' THEN 13 WHEN 'traffic_session' THEN 9 ELSE 11 END AS severity FROM (
        SELECT 'crypto_rotation' AS finding, id, summary FROM rotations
        UNION ALL SELECT 'new_uid', id, concat('New UID ', uid, ' on TG ', tgid) FROM (SELECT *, row_number() OVER (PARTITION BY system, uid ORDER BY timestamp_ns, id) AS rn FROM gr WHERE uid > 0) WHERE rn = 1
        UNION ALL SELECT 'traffic_session', channel_id, concat('Session on ', freq_key, ' MHz — ', hit_count, ' hits, ', printf('%.1f', duration_sec), 's, avg ', printf('%.0f', avg_signal), ' dB') FROM sessions
        UNION ALL SELECT finding, id, summary FROM ({FIND_SQL}))""",
    ROT_CTE + "," + sessions_cte() + "," + MSG_CTE,
)
def _(v):
    from wavetrail.functions.scalars import fixed

    crypto = H.key_rotations(v.crypto).select(F.lit("crypto_rotation").alias("finding"), "id", "summary")
    fresh = H.first_sightings(v.gr).select(
        F.lit("new_uid").alias("finding"), "id", F.concat(F.lit("New UID "), F.col("uid"), F.lit(" on TG "), F.col("tgid")).alias("summary")
    )
    text = F.concat(
        F.lit("Session on "), "freq_key", F.lit(" MHz — "), F.col("hit_count"), F.lit(" hits, "), fixed(F.col("duration_sec"), 1), F.lit("s, avg "),
        fixed(F.col("avg_signal"), 0), F.lit(" dB"),
    )
    traffic = sessions_of(v).select(F.lit("traffic_session").alias("finding"), F.col("channel_id").alias("id"), text.alias("summary"))
    network = M.network_findings(parsed(v), "SYS").select("finding", "id", "summary")
    events = M.finding_events(N.combine_findings([crypto, fresh, traffic, network]))
    return events.select("finding", "id", "summary", "severity")
