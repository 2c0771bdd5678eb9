"""Daily statistics, threat score, canned queries, harmonic suppression, report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from wavetrail.functions import scalars as S
from wavetrail.operators import emitters as E
from wavetrail.operators import history as H
from wavetrail.operators.counters import counters, rows, tally
from wavetrail.operators.harmonics import suppress_repeats
from wavetrail.plans.emitters import CFO_BUCKET, FPC_CTE, LINK_CTE, OBS_CTE, RESOLUTION, catalogue, links, observations, targets
from wavetrail.plans.history import DAY_NS, ROT_CTE, sessions_cte, sessions_of
from wavetrail.plans.network import tg_dim
from wavetrail.plans.registry import query
from wavetrail.plans.spectrum import ANOM_CTE, WALK_CTE, anomaly_rows, harmonic_rows
from wavetrail.sources.bindings import AS_OF_NS, EPOCH_S, ts_lit
from wavetrail.sources.work import stored

TODAY_NS = AS_OF_NS - 2 * DAY_NS
TODAY = "TIMESTAMP '2024-01-29'"


@query(
    "agg09_daily_stats",
    f"""SELECT (SELECT COUNT(*) FROM (SELECT freq_mhz FROM hits GROUP BY 1 HAVING MAX(ts) >= {TODAY})) AS signals_today, (SELECT COUNT(DISTINCT freq_mhz) FROM hits) AS signals_total,
        (SELECT COUNT(*) FROM gr WHERE ts >= {TODAY}) AS grants_today, (SELECT COUNT(DISTINCT tgid) FROM gr WHERE ts >= {TODAY}) AS unique_tgs_today, (SELECT COUNT(DISTINCT uid) FROM gr WHERE ts >= {TODAY}) AS unique_uids_today,
        (SELECT COUNT(*) FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE g.ts >= {TODAY} AND t.encrypted = 'encrypted') AS encrypted_grants_today,
        (SELECT COUNT(*) FROM rotations WHERE timestamp_ns >= {TODAY_NS}) AS key_rotations_today, (SELECT COUNT(*) FROM sessions WHERE start_ns >= {TODAY_NS}) AS sessions_today,
        (SELECT COUNT(*) FROM rec WHERE start_time >= TIMESTAMP '2001-11-03') AS recordings_today, (SELECT COALESCE(SUM(file_size_bytes), 0)::BIGINT FROM rec WHERE start_time >= TIMESTAMP '2001-11-03') AS recordings_size_today""",
    ROT_CTE + "," + sessions_cte(),
)
def _(v):
    signals = v.hits.groupBy("freq_mhz").agg(F.max("timestamp_ns").alias("last_ns"))
    today = v.gr.where(F.col("timestamp_ns") >= TODAY_NS).join(tg_dim(v, "encrypted"), ["tgid", "system"], "left")
    recent = v.rec.where(F.col("start_time") >= ts_lit("2001-11-03 00:00:00"))
    return counters([
        (signals, {"signals_today": tally(F.col("last_ns") >= TODAY_NS), "signals_total": rows()}),
        (
            today,
            {
                "grants_today": rows(), "unique_tgs_today": F.count_distinct("tgid"), "unique_uids_today": F.count_distinct("uid"),
                "encrypted_grants_today": tally(F.col("encrypted") == "encrypted"),
            },
        ),
        (H.key_rotations(v.crypto).where(F.col("timestamp_ns") >= TODAY_NS), {"key_rotations_today": rows()}),
        (sessions_of(v).where(F.col("start_ns") >= TODAY_NS), {"sessions_today": rows()}),
        (recent, {"recordings_today": rows(), "recordings_size_today": F.coalesce(F.sum("file_size_bytes"), F.lit(0))}),
    ])


@query(
    "agg09b_daily_breakdown",
    f"""SELECT 'band' AS kind, band AS value, COUNT(*) AS cnt FROM hits WHERE ts >= {TODAY} GROUP BY 2 UNION ALL SELECT 'class', COALESCE(classification, 'UNK'), COUNT(*) FROM hits WHERE ts >= {TODAY} GROUP BY 2
       UNION ALL SELECT * FROM (SELECT 'talkgroup', concat(g.tgid, ' ', t.name), COUNT(*) AS c FROM gr g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE g.ts >= {TODAY} GROUP BY 2, g.tgid ORDER BY c DESC, g.tgid LIMIT 10)""",
)
def _(v):
    hits = v.hits.where(F.col("timestamp_ns") >= TODAY_NS)
    pairs = F.array(
        F.struct(F.lit("band").alias("kind"), F.col("band").alias("value")),
        F.struct(F.lit("class").alias("kind"), F.coalesce("classification", F.lit("UNK")).alias("value")),
    )
    mix = hits.select(F.inline(pairs)).groupBy("kind", "value").agg(rows().alias("cnt"))
    top = v.gr.where(F.col("timestamp_ns") >= TODAY_NS).groupBy("tgid", "system").agg(rows().alias("cnt")).orderBy(F.desc("cnt"), "tgid").limit(10)
    named = top.join(tg_dim(v, "name"), ["tgid", "system"], "left").select(
        F.lit("talkgroup").alias("kind"), F.concat(F.col("tgid"), F.lit(" "), F.col("name")).alias("value"), "cnt"
    )
    return mix.unionByName(named)


@query(
    "agg28_threat_score",
    f"""SELECT *, CASE WHEN score > 20 THEN 'HIGH' WHEN score >= 5 THEN 'ELEVATED' ELSE 'LOW' END AS level FROM (SELECT *, 3*new_emitters + 2*anomalies + 5*uid_mismatches + deviations AS score FROM (
        SELECT (SELECT COUNT(*) FROM fpcat WHERE first_ns >= {(EPOCH_S + 20*86400)*10**9}) AS new_emitters, (SELECT COUNT(*) FROM anom) AS anomalies, (SELECT COUNT(*) FROM anom WHERE abs(z_score) > 3) AS deviations,
          (SELECT COUNT(*) FROM links l JOIN (SELECT uid, arg_min(fingerprint_id, (first_ns, fingerprint_id)) AS f FROM links GROUP BY 1) k ON k.uid = l.uid AND k.f <> l.fingerprint_id) AS uid_mismatches))""",
    FPC_CTE + "," + LINK_CTE + "," + ANOM_CTE,
)
def _(v):
    one = counters([
        (catalogue(v).where(F.col("first_ns") >= (EPOCH_S + 20 * 86400) * 10**9), {"new_emitters": rows()}),
        (anomaly_rows(v), {"anomalies": rows(), "deviations": tally(F.abs("z_score") > 3)}),
        (E.uid_mismatches(stored(links(v), "uid-links")), {"uid_mismatches": rows()}),
    ])
    score = 3 * F.col("new_emitters") + 2 * F.col("anomalies") + 5 * F.col("uid_mismatches") + F.col("deviations")
    scored = one.withColumn("score", score)
    return scored.withColumn("level", F.when(F.col("score") > 20, "HIGH").when(F.col("score") >= 5, "ELEVATED").otherwise("LOW"))


# --- canned queries --------------------------------------------------------


@query(
    "agg31_active_talkgroups",
    f"""SELECT x.tgid, t.name, t.department, t.priority, t.encrypted, last_ns FROM (SELECT tgid, system, MAX(timestamp_ns) AS last_ns FROM gr GROUP BY 1, 2) x LEFT JOIN tg t ON t.tgid = x.tgid AND t.system = x.system
        WHERE last_ns > {TODAY_NS} ORDER BY last_ns DESC, x.tgid, x.system LIMIT 100""",
)
def _(v):
    last = v.gr.groupBy("tgid", "system").agg(F.max("timestamp_ns").alias("last_ns")).where(F.col("last_ns") > TODAY_NS)
    top = last.orderBy(F.desc("last_ns"), "tgid", "system").limit(100)
    return top.join(tg_dim(v, "name", "department", "priority", "encrypted"), ["tgid", "system"], "left").drop("system")


@query("agg31b_encrypted_sessions", "SELECT freq_key, modulation, duration_sec, avg_signal, start_ns FROM sessions WHERE encrypted ORDER BY start_ns DESC, freq_key LIMIT 100", sessions_cte())
def _(v):
    s = sessions_of(v).where("encrypted").orderBy(F.desc("start_ns"), "freq_key").limit(100)
    return s.select("freq_key", "modulation", "duration_sec", "avg_signal", "start_ns")


@query("agg31c_busiest_frequencies", "SELECT freq_mhz, COUNT(*) AS session_count, ROUND(SUM(duration_sec), 4) AS total_sec, ROUND(AVG(avg_signal), 4) AS avg_sig FROM sessions GROUP BY 1 ORDER BY session_count DESC, freq_mhz LIMIT 20", sessions_cte())
def _(v):
    g = sessions_of(v).groupBy("freq_mhz").agg(
        rows().alias("session_count"), F.round(F.sum("duration_sec"), 4).alias("total_sec"), F.round(F.avg("avg_signal"), 4).alias("avg_sig")
    )
    return g.orderBy(F.desc("session_count"), "freq_mhz").limit(20)


@query("agg31d_recent_grants", "SELECT id, tgid, uid, voice_freq, grant_type, timestamp_ns FROM gr ORDER BY timestamp_ns DESC, id DESC LIMIT 100")
def _(v):
    return v.gr.orderBy(F.desc("timestamp_ns"), F.desc("id")).limit(100).select("id", "tgid", "uid", "voice_freq", "grant_type", "timestamp_ns")


@query("agg31e_rotation_events", "SELECT id, tgid, system, old_algorithm_id, new_algorithm_id, old_key_id, new_key_id, timestamp_ns FROM rotations ORDER BY timestamp_ns DESC, id DESC LIMIT 50", ROT_CTE)
def _(v):
    r = H.key_rotations(v.crypto).orderBy(F.desc("timestamp_ns"), F.desc("id")).limit(50)
    return r.select("id", "tgid", "system", "old_algorithm_id", "new_algorithm_id", "old_key_id", "new_key_id", "timestamp_ns")


@query(
    "agg31f_radio_sightings",
    f"SELECT uid, system, first_ns, last_ns, tgid FROM (SELECT uid, system, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns, arg_max(tgid, (timestamp_ns, id)) AS tgid FROM gr GROUP BY 1, 2) WHERE last_ns > {TODAY_NS} ORDER BY last_ns DESC, uid, system LIMIT 100",
)
def _(v):
    g = v.gr.groupBy("uid", "system").agg(
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.max_by("tgid", F.struct("timestamp_ns", "id")).alias("tgid")
    )
    return g.where(F.col("last_ns") > TODAY_NS).orderBy(F.desc("last_ns"), "uid", "system").limit(100)


@query("agg31g_target_summary", "SELECT t.target_id, target_type, target_label, priority, COALESCE(n, 0) AS obs_count FROM targets t LEFT JOIN (SELECT target_id, COUNT(*) AS n FROM obs GROUP BY 1) o ON o.target_id = t.target_id", OBS_CTE)
def _(v):
    n = observations(v).groupBy("target_id").agg(rows().alias("n"))
    return targets(v).join(n, "target_id", "left").select("target_id", "target_type", "target_label", "priority", F.coalesce("n", F.lit(0)).alias("obs_count"))


@query("agg31h_signals_by_class", "SELECT classification, COUNT(*) AS count, ROUND(AVG(power), 6) AS avg_power, MIN(freq_mhz) AS min_freq, MAX(freq_mhz) AS max_freq FROM hits GROUP BY 1")
def _(v):
    return v.hits.groupBy("classification").agg(
        rows().alias("count"), F.round(F.avg("power"), 6).alias("avg_power"), F.min("freq_mhz").alias("min_freq"), F.max("freq_mhz").alias("max_freq")
    )


@query("agg31i_recordings_by_type", "SELECT rec_type, COUNT(*) AS count, ROUND(SUM(duration_sec), 4) AS total_duration, SUM(file_size_bytes)::BIGINT AS total_bytes FROM rec GROUP BY 1")
def _(v):
    return v.rec.groupBy("rec_type").agg(rows().alias("count"), F.round(F.sum("duration_sec"), 4).alias("total_duration"), F.sum("file_size_bytes").alias("total_bytes"))


# --- harmonics over time, report -------------------------------------------


@query(
    "ups10_harmonic_suppression",
    """SELECT sensor, t_s, frame_id, f AS fundamental_mhz FROM kept WHERE keep""",
    WALK_CTE + """,
grp AS (SELECT s.sensor, s.t_s, w.frame_id, w.f[w.i] AS f, row_number() OVER (PARTITION BY s.sensor ORDER BY s.t_s, w.frame_id, w.f[w.i]) AS rn
  FROM walk w JOIN (SELECT DISTINCT frame_id, sensor, t_s FROM bins) s USING (frame_id) WHERE w.i > 0 AND len(w.h) > 0),
kept AS (WITH RECURSIVE r AS (
  SELECT sensor, 0::BIGINT AS rn, []::STRUCT(t BIGINT, f DOUBLE)[] AS seen, false AS keep, NULL::BIGINT AS t_s, NULL::BIGINT AS frame_id, NULL::DOUBLE AS f FROM (SELECT DISTINCT sensor FROM grp)
  UNION ALL
  SELECT sensor, rn, CASE WHEN fresh THEN list_append(near, {'t': t_s, 'f': f}) ELSE near END, fresh, t_s, frame_id, f FROM (
    SELECT *, len(list_filter(near, lambda k: abs(k.f - f) < 0.002)) = 0 AS fresh FROM (
      SELECT g.sensor, g.rn, list_filter(r.seen, lambda k: k.t > g.t_s - 60) AS near, g.t_s, g.frame_id, g.f FROM r JOIN grp g ON g.sensor = r.sensor AND g.rn = r.rn + 1)))
  SELECT * FROM r)""",
)
def _(v):
    return suppress_repeats(harmonic_rows(v), 0.002, 60).select("sensor", "t_s", "frame_id", "fundamental_mhz")


REPORT_SQL = f"""SELECT section, position, payload FROM (
  SELECT 'summary' AS section, 1 AS position, concat('{{"emitter_count":', (SELECT COUNT(*) FROM fpcat), ',"anomaly_count":', (SELECT COUNT(*) FROM anom), ',"detections_24h":', (SELECT COUNT(*) FROM hits WHERE ts >= {TODAY}), '}}') AS payload
  UNION ALL SELECT 'emitters', rn, concat('{{"fingerprint_id":"', fingerprint_id, '","capture_count":', capture_count, ',"last_ns":', last_ns, '}}') FROM (SELECT *, row_number() OVER (ORDER BY last_ns DESC, fingerprint_id) AS rn FROM fpcat) WHERE rn <= 100
  UNION ALL SELECT 'anomalies', rn, concat('{{"frame_id":', frame_id, ',"bin":', bin, ',"kind":"', kind, '"}}') FROM (SELECT *, row_number() OVER (ORDER BY t_s DESC, bin) AS rn FROM anom) WHERE rn <= 100
  UNION ALL SELECT 'drones', rn, concat('{{"id":', id, ',"timestamp_ns":', timestamp_ns, '}}') FROM (SELECT *, row_number() OVER (ORDER BY timestamp_ns DESC, id DESC) AS rn FROM hits) WHERE rn <= 50
  UNION ALL SELECT 'recommendations', 1, concat('{{"text":"Investigate ', (SELECT COUNT(*) FROM fpcat WHERE first_ns >= {(EPOCH_S + 20*86400)*10**9}), ' unknown/new emitters in catalog"}}') WHERE (SELECT COUNT(*) FROM fpcat WHERE first_ns >= {(EPOCH_S + 20*86400)*10**9}) > 0
  UNION ALL SELECT 'recommendations', n, concat('{{"text":"Acknowledge and investigate ', (SELECT COUNT(*) FROM anom WHERE abs(z_score) > 5), ' CRITICAL anomalies"}}') FROM (SELECT CASE WHEN (SELECT COUNT(*) FROM fpcat WHERE first_ns >= {(EPOCH_S + 20*86400)*10**9}) > 0 THEN 2 ELSE 1 END AS n) WHERE (SELECT COUNT(*) FROM anom WHERE abs(z_score) > 5) > 0)"""


@query("snk10_sectioned_report", f"SELECT section, position, payload, sha256(payload) AS hash FROM ({REPORT_SQL})", FPC_CTE + "," + ANOM_CTE)
def _(v):
    return report(v)


def top(df, order, n, section, fields):
    """The first ``n`` rows of a section as JSON, numbered in order."""
    from pyspark.sql import Window

    # The window sees the n rows that TakeOrdered keeps.
    page = df.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return page.select(F.lit(section).alias("section"), "position", F.to_json(F.struct(*fields)).alias("payload"))


def report(v):
    cat, anomalies = stored(catalogue(v), "catalogue"), stored(anomaly_rows(v), "anomalies")
    new = tally(F.col("first_ns") >= (EPOCH_S + 20 * 86400) * 10**9)
    facts = counters([
        (cat, {"emitter_count": rows(), "new_emitters": new}),
        (anomalies, {"anomaly_count": rows(), "critical": tally(F.abs("z_score") > 5)}),
        (v.hits.where(F.col("timestamp_ns") >= TODAY_NS), {"detections_24h": rows()}),
    ])
    summary = facts.select(
        F.lit("summary").alias("section"), F.lit(1).alias("position"), F.to_json(F.struct("emitter_count", "anomaly_count", "detections_24h")).alias("payload")
    )
    advice = lambda n, text: F.struct(F.col(n).alias("n"), F.to_json(F.struct(text.alias("text"))).alias("payload"))
    lines = F.array(
        advice("new_emitters", F.concat(F.lit("Investigate "), F.col("new_emitters"), F.lit(" unknown/new emitters in catalog"))),
        advice("critical", F.concat(F.lit("Acknowledge and investigate "), F.col("critical"), F.lit(" CRITICAL anomalies"))),
    )
    rec = facts.select(F.posexplode(F.filter(lines, lambda x: x["n"] > 0)).alias("pos", "r")).select(
        F.lit("recommendations").alias("section"), (F.col("pos") + 1).alias("position"), "r.payload"
    )
    parts = [
        summary,
        top(cat, [F.desc("last_ns"), F.col("fingerprint_id")], 100, "emitters", ["fingerprint_id", "capture_count", "last_ns"]),
        top(anomalies, [F.desc("t_s"), F.col("bin")], 100, "anomalies", ["frame_id", "bin", "kind"]),
        top(v.hits, [F.desc("timestamp_ns"), F.desc("id")], 50, "drones", ["id", "timestamp_ns"]),
        rec,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("hash", F.sha2("payload", 256))
