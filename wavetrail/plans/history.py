"""Rotations, first sightings, traffic sessions, traces, transitions, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import history as H
from wavetrail.plans.registry import query
from wavetrail.sources.bindings import AS_OF_NS

DAY_NS = 86400 * 10**9

ALG_SQL = """CASE algorithm WHEN 'AES-256' THEN 132 WHEN 'DES-OFB' THEN 129 WHEN 'Unencrypted' THEN 128
  ELSE CASE WHEN encrypted_flag THEN 0 ELSE 128 END END"""
SHORT_SQL = "CASE {} WHEN 128 THEN 'CLEAR' WHEN 129 THEN 'DES' WHEN 131 THEN '3DES' WHEN 132 THEN 'AES' WHEN 170 THEN 'ADP' ELSE 'UNK' END"
ROT_CTE = f"""
algs AS (SELECT *, {ALG_SQL} AS alg FROM crypto),
lagged AS (SELECT *, lag(alg) OVER w AS old_alg, lag(key_id) OVER w AS old_key, lag(id) OVER w AS prev_id
  FROM algs WINDOW w AS (PARTITION BY system, tgid ORDER BY timestamp_ns, id)),
rotations AS (SELECT id, system, tgid, uid, freq_mhz, timestamp_ns, COALESCE(old_key, -1) AS old_key_id, key_id AS new_key_id,
  old_alg AS old_algorithm_id, alg AS new_algorithm_id, CASE WHEN old_alg <> alg THEN 'warning' ELSE 'notice' END AS severity,
  CASE WHEN old_alg <> alg AND old_key IS DISTINCT FROM key_id THEN concat('Key rotation on TG ', tgid, ': ', {SHORT_SQL.format('old_alg')}, ' key=', COALESCE(old_key::VARCHAR, '?'), ' -> ', {SHORT_SQL.format('alg')}, ' key=', COALESCE(key_id::VARCHAR, '?'))
       WHEN old_alg <> alg THEN concat('Algorithm change on TG ', tgid, ': ', {SHORT_SQL.format('old_alg')}, ' -> ', {SHORT_SQL.format('alg')})
       ELSE concat('Key rotation on TG ', tgid, ': key ', COALESCE(old_key::VARCHAR, '?'), ' -> ', COALESCE(key_id::VARCHAR, '?')) END AS summary
  FROM lagged WHERE prev_id IS NOT NULL AND (old_alg <> alg OR old_key IS DISTINCT FROM key_id))"""


@query("win01_key_rotations", "SELECT * FROM rotations", ROT_CTE)
def _(v):
    return H.key_rotations(v.crypto)


@query(
    "win02_first_sightings",
    "SELECT system, uid, tgid, id, timestamp_ns FROM (SELECT *, row_number() OVER (PARTITION BY system, uid ORDER BY timestamp_ns, id) AS rn FROM gr WHERE uid > 0) WHERE rn = 1",
)
def _(v):
    return H.first_sightings(v.gr)


def sessions_cte(gap_ns: int = DAY_NS) -> str:
    return f"""
s1 AS (SELECT *, printf('%.3f', freq_mhz) AS freq_key, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY printf('%.3f', freq_mhz) ORDER BY timestamp_ns, id) AS gap FROM hits),
s2 AS (SELECT *, SUM(CASE WHEN gap <= {gap_ns} THEN 0 ELSE 1 END) OVER (PARTITION BY freq_key ORDER BY timestamp_ns, id) AS sno FROM s1),
s3 AS (SELECT freq_key, sno, arg_min(freq_mhz, (timestamp_ns, id)) AS freq_mhz, arg_min(channel_id, (timestamp_ns, id)) AS channel_id,
   first(encrypted ORDER BY timestamp_ns, id) AS encrypted, 'NFM' AS modulation,
   MIN(timestamp_ns) AS start_ns, MAX(timestamp_ns) AS last_ns, COUNT(*) AS hit_count, SUM(power) AS power_sum FROM s2 GROUP BY 1, 2),
s4 AS (SELECT *, COALESCE(lead(start_ns) OVER (PARTITION BY freq_key ORDER BY start_ns), {AS_OF_NS}) AS closed_ns FROM s3),
sessions AS (SELECT freq_key, freq_mhz, channel_id, encrypted, modulation, start_ns, last_ns, closed_ns,
   ROUND((last_ns - start_ns) / 1e9, 6) AS duration_sec, hit_count, ROUND(power_sum / hit_count, 6) AS avg_signal FROM s4 WHERE hit_count >= 2)"""


def sessions_of(v, gap_ns: int = DAY_NS):
    s = H.traffic_sessions(v.hits, gap_ns, AS_OF_NS)
    return s.withColumn("duration_sec", F.round("duration_sec", 6)).withColumn("avg_signal", F.round("avg_signal", 6))


@query("win03_traffic_sessions", "SELECT * FROM sessions", sessions_cte())
def _(v):
    return sessions_of(v)


def traces_cte(gap_ns: int = DAY_NS) -> str:
    return f"""
p1 AS (SELECT *, CAST(trunc(freq_mhz*1000) AS BIGINT) AS khz, event_type = 'protocol.p25.grant' AS is_grant,
   COALESCE(event_type = 'protocol.p25.voice' AND duid IN ('TLC', 'SimpleTerm'), FALSE) AS ends FROM ev WHERE event_type LIKE 'protocol.p25.%'),
p2 AS (SELECT *, lag(timestamp_ns) OVER w AS prev_ns, lag(ends) OVER w AS prev_ends FROM p1 WINDOW w AS (PARTITION BY talkgroup, khz ORDER BY timestamp_ns, id)),
p3 AS (SELECT *, SUM(CASE WHEN is_grant OR prev_ends OR timestamp_ns - prev_ns > {gap_ns} THEN 1 ELSE 0 END) OVER (PARTITION BY talkgroup, khz ORDER BY timestamp_ns, id) AS run FROM p2),
p4 AS (SELECT *, first_value(id) OVER w AS head, first_value(is_grant) OVER w AS open, row_number() OVER w AS pos FROM p3 WINDOW w AS (PARTITION BY talkgroup, khz, run ORDER BY timestamp_ns, id)),
traced AS (SELECT *, CASE WHEN open THEN head END AS trace_id, CASE WHEN open THEN pos END AS span_id FROM p4),
traces AS (SELECT trace_id, MIN(timestamp_ns) AS start_ns, MAX(timestamp_ns) AS last_event_ns, COUNT(*) AS event_count, MIN(talkgroup) AS talkgroup, MIN(freq_mhz) AS freq_mhz,
   arg_min(source_unit, (timestamp_ns, id)) AS source_unit, bool_or(COALESCE(encrypted, FALSE)) AS encrypted, (MAX(timestamp_ns) - MIN(timestamp_ns)) / 1e9 AS duration_sec
   FROM traced WHERE trace_id IS NOT NULL GROUP BY trace_id)"""


def traced_log(v, gap_ns: int = DAY_NS):
    return H.assign_traces(v.ev.where(F.col("event_type").startswith("protocol.p25.")), gap_ns)


@query("win04_trace_assignment", "SELECT id, event_type, trace_id, span_id FROM traced", traces_cte())
def _(v):
    return traced_log(v).select("id", "event_type", "trace_id", "span_id")


@query(
    "win04b_trace_sessions",
    "SELECT trace_id, start_ns, last_event_ns, event_count, talkgroup, freq_mhz, source_unit, encrypted, ROUND(duration_sec, 6) AS duration_sec FROM traces",
    traces_cte(),
)
def _(v):
    return H.trace_sessions(traced_log(v)).withColumn("duration_sec", F.round("duration_sec", 6))


@query(
    "stm04_session_events",
    """SELECT 'sigex.traffic.session' AS event_type, 9 AS severity, trace_id, talkgroup, source_unit, freq_mhz, encrypted, last_event_ns AS timestamp_ns,
       concat('Session ', trace_id, ' — TG:', talkgroup, ' UID:', source_unit, printf(' %.4fMHz ', freq_mhz), event_count, 'events ', printf('%.1fs', duration_sec), CASE WHEN encrypted THEN ' ENC' ELSE '' END) AS body FROM traces""",
    traces_cte(),
)
def _(v):
    return H.session_events(H.trace_sessions(traced_log(v)))


@query(
    "src03_trace_scan",
    "SELECT id, timestamp_ns, event_type, span_id FROM traced WHERE trace_id = (SELECT MIN(trace_id) FROM traced WHERE event_type <> 'protocol.p25.grant')",
    traces_cte(),
)
def _(v):
    traced = traced_log(v)
    wanted = traced.where((F.col("event_type") != H.GRANT) & F.col("trace_id").isNotNull()).agg(F.min("trace_id").alias("trace_id"))
    return traced.join(wanted, "trace_id", "left_semi").select("id", "timestamp_ns", "event_type", "span_id").orderBy("timestamp_ns", "id")


@query(
    "win12_event_rate",
    "SELECT (timestamp_ns // 1000000000) AS second, COUNT(*) AS events, COUNT(*)::DOUBLE AS rate FROM ev GROUP BY 1",
)
def _(v):
    return H.event_rate(v.ev, 1)


@query(
    "win13_state_transitions",
    """SELECT device_key, timestamp_ns, id, event_type, state FROM (
        SELECT device_key, timestamp_ns, id, 'system.site.exit' AS event_type, prev AS state, st, prev FROM lagged WHERE st IS DISTINCT FROM prev AND prev IS NOT NULL
        UNION ALL SELECT device_key, timestamp_ns, id, 'system.site.enter', st, st, prev FROM lagged WHERE st IS DISTINCT FROM prev AND st IS NOT NULL)""",
    "lagged AS (SELECT *, lag(st) OVER (PARTITION BY device_key ORDER BY timestamp_ns, id) AS prev FROM (SELECT device_key, timestamp_ns, id, CASE WHEN k % 5 < 4 THEN k // 20 END AS st FROM ev))",
)
def _(v):
    states = v.ev.select("device_key", "timestamp_ns", "id", F.when(F.col("k") % 5 < 4, F.expr("k div 20")).alias("st"))
    return H.transitions(states, ["device_key"], "st", ["timestamp_ns", "id"], "system.site.exit", "system.site.enter")


@query(
    "agg21_activity_baseline",
    """SELECT freq_key, channel_id, hour(make_timestamp(start_ns // 1000)) AS hour_of_day, dayofweek(make_timestamp(start_ns // 1000)) AS day_of_week,
        ROUND(COUNT(*) * 1e0 / GREATEST(1, COUNT(DISTINCT start_ns // 86400000000000)), 6) AS avg_sessions, 0e0 AS stddev_sessions,
        ROUND(AVG(duration_sec), 4) AS avg_duration, COUNT(DISTINCT start_ns // 86400000000000) AS sample_days
       FROM sessions WHERE start_ns >= %d GROUP BY 1, 2, 3, 4""" % (AS_OF_NS - 30 * DAY_NS),
    sessions_cte(),
)
def _(v):
    s = sessions_of(v).where(F.col("start_ns") >= AS_OF_NS - 30 * DAY_NS)
    ts = F.expr("timestamp_micros(start_ns div 1000L)")
    days = F.count_distinct(F.to_date(ts))
    return (
        s.groupBy("freq_key", "channel_id", F.hour(ts).alias("hour_of_day"), (F.dayofweek(ts) - 1).alias("day_of_week"))
        .agg(
            F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), days), 6).alias("avg_sessions"),
            F.lit(0.0).alias("stddev_sessions"),
            F.round(F.avg("duration_sec"), 4).alias("avg_duration"),
            days.alias("sample_days"),
        )
    )


@query(
    "agg25_channel_occupancy",
    """SELECT freq, total_sec, session_count, hit_total, ROUND(total_sec / MAX(total_sec) OVER (), 6) AS share FROM (
        SELECT ROUND(freq_mhz, 4) AS freq, ROUND(SUM(duration_sec), 4) AS total_sec, COUNT(*) AS session_count, SUM(hit_count)::BIGINT AS hit_total
        FROM sessions GROUP BY 1 ORDER BY total_sec DESC, freq LIMIT 20)""",
    sessions_cte(),
)
def _(v):
    from pyspark.sql import Window

    top = (
        sessions_of(v).groupBy(F.round("freq_mhz", 4).alias("freq"))
        .agg(F.round(F.sum("duration_sec"), 4).alias("total_sec"), F.count(F.lit(1)).alias("session_count"), F.sum("hit_count").alias("hit_total"))
        .orderBy(F.desc("total_sec"), "freq").limit(20)
    )
    # The window sees the twenty reported rows only.
    return top.withColumn("share", F.round(F.col("total_sec") / F.max("total_sec").over(Window.partitionBy()), 6))
