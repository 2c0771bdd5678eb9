"""Grants, talkgroups, sites, keys and radios: joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetrail.functions import scalars as S
from wavetrail.operators import history as H
from wavetrail.operators.counters import counters, rows, tally
from wavetrail.operators.joins import count_intervals, with_intervals, within_intervals
from wavetrail.operators.ordered import merge_intervals
from wavetrail.plans.history import ALG_SQL, DAY_NS, ROT_CTE, sessions_cte, sessions_of
from wavetrail.plans.registry import query
from wavetrail.sources import sinks
from wavetrail.sources.bindings import AS_OF, ts_lit

NOW = f"TIMESTAMP '{AS_OF}'"
SITE_CTE = f"""
ranges AS (SELECT site_id, start_time, COALESCE(end_time, {NOW}) AS end_time FROM ss),
sg AS (SELECT s.site_id, g.* FROM gr g, (SELECT DISTINCT site_id FROM ss) s
  WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.site_id = s.site_id AND g.ts >= r.start_time AND g.ts <= r.end_time))"""


def site_grants(v):
    """Grants heard while a site was staffed, for every site."""
    return within_intervals(v.gr, F.unix_micros("ts"), v.ss, ts_lit(AS_OF), ["site_id"])


def tg_dim(v, *columns):
    return v.tg.select("tgid", "system", *columns)


# --- joins -----------------------------------------------------------------


@query("joi01_left_join", "SELECT g.id, g.tgid, t.name, t.department FROM gr g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system")
def _(v):
    return v.gr.join(tg_dim(v, "name", "department"), ["tgid", "system"], "left").select("id", "tgid", "name", "department")


@query(
    "joi02_inner_join",
    """SELECT t.department, dayofweek(g.ts) AS day_of_week, hour(g.ts) AS hour, COUNT(*) AS grant_count
       FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE t.department IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(v):
    dim = tg_dim(v, "department").where(F.col("department").isNotNull())
    return (
        v.gr.join(dim, ["tgid", "system"])
        .groupBy("department", S.sunday_dow(F.col("ts")).alias("day_of_week"), F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("grant_count"))
    )


@query("joi03_interval_semi_join", "SELECT site_id, id, tgid, uid FROM sg", SITE_CTE)
def _(v):
    return site_grants(v).select("site_id", "id", "tgid", "uid")


@query(
    "joi04_interval_inner_join",
    f"SELECT r.id AS session_id, r.site_id, g.id FROM gr g JOIN (SELECT *, COALESCE(end_time, {NOW}) AS e FROM ss) r ON g.ts BETWEEN r.start_time AND r.e",
)
def _(v):
    sessions = v.ss.withColumnRenamed("id", "session_id")
    grants = v.gr.select("id", "ts")  # rows are collected whole
    return with_intervals(grants, F.unix_micros("ts"), sessions, ts_lit(AS_OF), ["session_id", "site_id"]).select("session_id", "site_id", "id")


@query(
    "joi05_dimension_chain",
    """SELECT g.id, g.uid, a.callsign, o.org_name FROM gr g LEFT JOIN actors a ON a.radio_id = g.uid LEFT JOIN orgs o ON o.organization_id = a.organization_id""",
)
def _(v):
    return (
        v.gr.join(v.actors, F.col("radio_id") == F.col("uid"), "left").join(v.orgs, "organization_id", "left")
        .select("id", "uid", "callsign", "org_name")
    )


KEYS_CTE = f"""
keycat AS (SELECT system, tgid, {ALG_SQL} AS algorithm_id, COALESCE(key_id, -1) AS key_id, COUNT(*) AS session_count,
   MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns,
   arg_min(COALESCE(algorithm, CASE WHEN encrypted_flag THEN 'Unknown' ELSE 'Unencrypted' END), (timestamp_ns, id)) AS algorithm_name FROM crypto GROUP BY 1, 2, 3, 4)"""


def key_catalogue(v):
    """Every (talkgroup, algorithm, key) with its use; a missing key is -1."""
    flag = F.col("encrypted_flag")
    return v.crypto.groupBy(
        "system", "tgid", S.algorithm_id(F.col("algorithm"), flag).alias("algorithm_id"), F.coalesce("key_id", F.lit(-1)).alias("key_id")
    ).agg(
        rows().alias("session_count"),
        F.min("timestamp_ns").alias("first_ns"),
        F.max("timestamp_ns").alias("last_ns"),
        F.min_by(S.algorithm_name(F.col("algorithm"), flag), F.struct("timestamp_ns", "id")).alias("algorithm_name"),
    )


@query("ups04_key_catalogue", "SELECT * FROM keycat", KEYS_CTE)
def _(v):
    return key_catalogue(v)


@query(
    "joi06_fan_out_join",
    """SELECT g.site_id, g.id, g.tgid, t.name, t.encrypted, k.algorithm_name, k.key_id FROM sg g
       LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system LEFT JOIN keycat k ON k.tgid = g.tgid AND k.system = g.system
       WHERE t.encrypted = 'encrypted' OR k.algorithm_id <> 128""",
    SITE_CTE + "," + KEYS_CTE,
)
def _(v):
    keys = key_catalogue(v).select("system", "tgid", "algorithm_id", "algorithm_name", "key_id")
    return (
        site_grants(v).join(tg_dim(v, "name", "encrypted"), ["tgid", "system"], "left").join(keys, ["tgid", "system"], "left")
        .where((F.col("encrypted") == "encrypted") | (F.col("algorithm_id") != 128))
        .select("site_id", "id", "tgid", "name", "encrypted", "algorithm_name", "key_id")
    )


@query(
    "ord05_interval_merge",
    """SELECT site_id, epoch_us(MIN(start_time)) AS start_t, epoch_us(MAX(end_time)) AS end_t FROM (
        SELECT *, SUM(CASE WHEN start_time <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY start_time, end_time) AS island FROM (
          SELECT *, MAX(end_time) OVER (PARTITION BY site_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges)) GROUP BY site_id, island""",
    f"ranges AS (SELECT site_id, start_time, COALESCE(end_time, {NOW}) AS end_time FROM ss)",
)
def _(v):
    from wavetrail.operators.joins import to_seconds_intervals

    spans = to_seconds_intervals(v.ss, ts_lit(AS_OF), ["site_id"])
    return merge_intervals(spans, ["site_id"], "start_t", "end_t", 86400 * 10**6)


# --- site reports ----------------------------------------------------------

DASH_SQL = """SELECT s.site_id, COUNT(DISTINCT s.id) AS total_sessions, (SELECT COUNT(*) FROM gr) AS global_grants, MAX(COALESCE(n, 0)) AS total_grants,
  MAX(COALESCE(tgs, 0)) AS unique_tgids, MAX(COALESCE(uids, 0)) AS unique_uids, MAX(COALESCE(enc, 0)) AS encrypted_grants,
  MAX(CASE WHEN s.end_time IS NULL THEN s.id END) AS active_session
  FROM ss s LEFT JOIN (SELECT g.site_id, COUNT(*) AS n, COUNT(DISTINCT g.tgid) AS tgs, COUNT(DISTINCT CASE WHEN uid > 0 THEN uid END) AS uids,
    SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END)::BIGINT AS enc FROM sg g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system GROUP BY 1) x ON x.site_id = s.site_id GROUP BY 1"""


@query("agg10_site_dashboard", DASH_SQL, SITE_CTE)
def _(v):
    heard = (
        site_grants(v).join(tg_dim(v, "encrypted"), ["tgid", "system"], "left").groupBy("site_id")
        .agg(
            rows().alias("total_grants"), F.count_distinct("tgid").alias("unique_tgids"),
            F.count_distinct(F.when(F.col("uid") > 0, F.col("uid"))).alias("unique_uids"),
            tally(F.col("encrypted") == "encrypted").alias("encrypted_grants"),
        )
    )
    sessions = v.ss.groupBy("site_id").agg(
        F.count_distinct("id").alias("total_sessions"), F.max(F.when(F.col("end_time").isNull(), F.col("id"))).alias("active_session")
    )
    total = v.gr.agg(rows().alias("global_grants")).withColumn("_one", F.lit(1))
    return (
        sessions.join(heard, "site_id", "left").fillna(0, ["total_grants", "unique_tgids", "unique_uids", "encrypted_grants"])
        .withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")
    )


@query(
    "agg11_site_talkgroups",
    """SELECT site_id, tgid, name, department, encrypted, grants, last_ns FROM (
        SELECT x.*, t.name, t.department, t.encrypted, row_number() OVER (PARTITION BY site_id ORDER BY grants DESC, x.tgid) AS rk FROM (
          SELECT site_id, tgid, system, COUNT(*) AS grants, MAX(timestamp_ns) AS last_ns FROM sg GROUP BY 1, 2, 3) x
        LEFT JOIN tg t ON t.tgid = x.tgid AND t.system = x.system) WHERE rk <= 10""",
    SITE_CTE,
)
def _(v):
    best = Window.partitionBy("site_id").orderBy(F.desc("grants"), "tgid")
    top = (
        site_grants(v).groupBy("site_id", "tgid", "system").agg(rows().alias("grants"), F.max("timestamp_ns").alias("last_ns"))
        .withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= 10)
    )
    return top.join(tg_dim(v, "name", "department", "encrypted"), ["tgid", "system"], "left").drop("rk", "system")


@query(
    "agg11b_site_radios",
    """SELECT site_id, uid, observations, first_ns, last_ns, callsign, org_name FROM (
        SELECT x.*, row_number() OVER (PARTITION BY site_id ORDER BY observations DESC, uid) AS rk FROM (
          SELECT site_id, uid, COUNT(*) AS observations, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns FROM sg WHERE uid > 0 GROUP BY 1, 2) x) y
       LEFT JOIN actors a ON a.radio_id = y.uid LEFT JOIN orgs o ON o.organization_id = a.organization_id WHERE rk <= 10""",
    SITE_CTE,
)
def _(v):
    best = Window.partitionBy("site_id").orderBy(F.desc("observations"), "uid")
    top = (
        site_grants(v).where(F.col("uid") > 0).groupBy("site_id", "uid")
        .agg(rows().alias("observations"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
        .withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= 10)
    )
    named = top.join(v.actors, F.col("radio_id") == F.col("uid"), "left").join(v.orgs, "organization_id", "left")
    return named.select("site_id", "uid", "observations", "first_ns", "last_ns", "callsign", "org_name")


@query(
    "agg12_enriched_radios",
    """SELECT site_id, uid, COUNT(*) AS observations, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns,
        string_agg(DISTINCT t.department, ',' ORDER BY t.department) AS departments, string_agg(DISTINCT g.tgid::VARCHAR, ',' ORDER BY g.tgid::VARCHAR) AS tgids,
        string_agg(DISTINCT t.name, ',' ORDER BY t.name) AS tg_names
       FROM sg g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE uid > 0 GROUP BY 1, 2""",
    SITE_CTE,
)
def _(v):
    # Counting per (site, radio, talkgroup) first keeps the lists to distinct talkgroups.
    pairs = (
        site_grants(v).where(F.col("uid") > 0).groupBy("site_id", "uid", "tgid", "system")
        .agg(rows().alias("n"), F.min("timestamp_ns").alias("t0"), F.max("timestamp_ns").alias("t1"))
        .join(tg_dim(v, "name", "department"), ["tgid", "system"], "left")
    )
    names = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    return pairs.groupBy("site_id", "uid").agg(
        F.sum("n").alias("observations"), F.min("t0").alias("first_ns"), F.max("t1").alias("last_ns"),
        names("department").alias("departments"), names(F.col("tgid").cast("string")).alias("tgids"), names("name").alias("tg_names"),
    )


@query(
    "agg13_encryption_timeline",
    f"""SELECT site_id, strftime(g.ts, '%Y-%m-%d %H:00') AS hour, SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END)::BIGINT AS encrypted,
        SUM(CASE WHEN t.encrypted <> 'encrypted' OR t.encrypted IS NULL THEN 1 ELSE 0 END)::BIGINT AS clear
       FROM sg g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE g.ts >= {NOW} - INTERVAL 240 HOUR GROUP BY 1, 2""",
    SITE_CTE,
)
def _(v):
    recent = v.gr.where(F.col("ts") >= ts_lit(AS_OF) - F.make_dt_interval(hours=F.lit(240)))
    heard = within_intervals(recent, F.unix_micros("ts"), v.ss, ts_lit(AS_OF), ["site_id"])
    secret = F.coalesce(F.col("encrypted") == "encrypted", F.lit(False))
    return (
        heard.join(tg_dim(v, "encrypted"), ["tgid", "system"], "left")
        .groupBy("site_id", F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"))
        .agg(tally(secret).alias("encrypted"), tally(~secret).alias("clear"))
    )


@query("agg14_activity_by_hour", "SELECT site_id, hour(ts) AS hour, COUNT(*) AS grants FROM sg GROUP BY 1, 2", SITE_CTE)
def _(v):
    return site_grants(v).groupBy("site_id", F.hour("ts").alias("hour")).agg(rows().alias("grants"))


@query(
    "agg15_hour_weekday_pattern",
    """SELECT site_id, dayofweek(g.ts) AS dow, hour(g.ts) AS hour, COUNT(*) AS grants, SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END)::BIGINT AS encrypted_grants
       FROM sg g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system GROUP BY 1, 2, 3""",
    SITE_CTE,
)
def _(v):
    return (
        site_grants(v).join(tg_dim(v, "encrypted"), ["tgid", "system"], "left")
        .groupBy("site_id", S.sunday_dow(F.col("ts")).alias("dow"), F.hour("ts").alias("hour"))
        .agg(rows().alias("grants"), tally(F.col("encrypted") == "encrypted").alias("encrypted_grants"))
    )


CACHE_SQL = f"""SELECT 'site_dashboard' AS cache_key, r.site_id, COUNT(*) AS total_grants, COUNT(DISTINCT g.tgid) AS unique_talkgroups, COUNT(DISTINCT g.uid) AS unique_radio_ids,
  SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END)::BIGINT AS encrypted_count, ROUND(SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END) * 100e0 / COUNT(*), 6) AS encrypted_pct
  FROM gr g JOIN (SELECT *, COALESCE(end_time, {NOW}) AS e FROM ss) r ON g.ts BETWEEN r.start_time AND r.e
  LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system GROUP BY 2"""


@query("snk07_dashboard_cache", CACHE_SQL)
def _(v):
    # a grant counts once for each session; equal ones are summed up before the rest
    heard = count_intervals(v.gr.select("tgid", "uid", "system", "ts"), F.unix_micros("ts"), v.ss, ts_lit(AS_OF), ["site_id"])
    uses = heard.groupBy("site_id", "tgid", "uid", "system").agg(F.sum("covers").alias("n"))
    secret = F.coalesce(F.sum(F.when(F.col("encrypted") == "encrypted", F.col("n")).otherwise(0)), F.lit(0))
    return (
        uses.join(tg_dim(v, "encrypted"), ["tgid", "system"], "left").groupBy("site_id")
        .agg(
            F.sum("n").alias("total_grants"), F.count_distinct("tgid").alias("unique_talkgroups"),
            F.count_distinct("uid").alias("unique_radio_ids"), secret.alias("encrypted_count"),
            F.round(secret * 100.0 / F.sum("n"), 6).alias("encrypted_pct"),
        )
        .withColumn("cache_key", F.lit("site_dashboard"))
    )


@query(
    "snk05_grant_compaction",
    f"""SELECT g.system, g.tgid, g.grant_type, strftime(g.ts, '%Y-%m-%dT%H:00:00') AS hour, COUNT(*) AS grant_count, COUNT(DISTINCT uid) AS unique_uids,
        SUM(CASE WHEN t.encrypted = 'encrypted' THEN 1 ELSE 0 END)::BIGINT AS encrypted_count, MAX(operation_id) AS operation_id,
        (SELECT COUNT(*) FROM gr WHERE ts >= {NOW} - INTERVAL 15 DAY) AS kept_rows
       FROM gr g LEFT JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE g.ts < {NOW} - INTERVAL 15 DAY GROUP BY 1, 2, 3, 4""",
)
def _(v):
    cutoff = ts_lit(AS_OF) - F.make_dt_interval(days=F.lit(15))
    hourly, kept = sinks.compact_grants(v.gr, v.tg, cutoff)
    total = kept.agg(rows().alias("kept_rows")).withColumn("_one", F.lit(1))
    return hourly.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


# --- departments -----------------------------------------------------------


@query(
    "agg16_departments",
    """SELECT COALESCE(t.department, '') AS department, COUNT(DISTINCT t.tgid) AS tg_count, COUNT(DISTINCT CASE WHEN scan_enabled = 1 THEN t.tgid END) AS watched_count,
        COUNT(DISTINCT CASE WHEN encrypted <> 'clear' THEN t.tgid END) AS encrypted_tgs, COUNT(g.id) AS total_grants, COUNT(DISTINCT g.uid) AS unique_uids,
        MIN(g.timestamp_ns) AS first_ns, MAX(g.timestamp_ns) AS last_ns
       FROM tg t LEFT JOIN gr g ON g.tgid = t.tgid AND g.system = t.system GROUP BY 1""",
)
def _(v):
    dep = F.coalesce("department", F.lit("")).alias("department")
    static = v.tg.groupBy(dep).agg(
        rows().alias("tg_count"), F.sum("scan_enabled").alias("watched_count"), tally(F.col("encrypted") != "clear").alias("encrypted_tgs")
    )
    used = (
        v.gr.join(v.tg.select("tgid", "system", dep), ["tgid", "system"]).groupBy("department")
        .agg(
            rows().alias("total_grants"), F.count_distinct("uid").alias("unique_uids"),
            F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        )
    )
    return static.join(used, "department", "left").fillna(0, ["total_grants", "unique_uids"])


@query(
    "agg16b_department_radios",
    """SELECT department, uid, n AS observation_count, tgs AS tg_count, first_ns, last_ns FROM (
        SELECT *, row_number() OVER (PARTITION BY department ORDER BY n DESC, uid) AS rk FROM (
          SELECT t.department, g.uid, COUNT(*) AS n, COUNT(DISTINCT g.tgid) AS tgs, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns
          FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE t.department IS NOT NULL AND g.uid IS NOT NULL GROUP BY 1, 2)) WHERE rk <= 20""",
)
def _(v):
    dim = tg_dim(v, "department").where(F.col("department").isNotNull())
    per_radio = (
        v.gr.where(F.col("uid").isNotNull()).join(dim, ["tgid", "system"]).groupBy("department", "uid")
        .agg(
            rows().alias("observation_count"), F.count_distinct("tgid").alias("tg_count"),
            F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        )
    )
    best = Window.partitionBy("department").orderBy(F.desc("observation_count"), "uid")
    return per_radio.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= 20).drop("rk")


@query(
    "agg16c_watched_talkgroups",
    "SELECT system, tgid FROM tg WHERE scan_enabled = 1",
)
def _(v):
    return v.tg.where(F.col("scan_enabled") == 1).select("system", "tgid")


# --- counters --------------------------------------------------------------


@query(
    "agg07_operation_stats",
    """SELECT op AS operation_id, SUM(CASE WHEN n = 'signal_hits' THEN c ELSE 0 END)::BIGINT AS signal_hits, SUM(CASE WHEN n = 'traffic_sessions' THEN c ELSE 0 END)::BIGINT AS traffic_sessions,
        SUM(CASE WHEN n = 'channel_grants' THEN c ELSE 0 END)::BIGINT AS channel_grants, SUM(CASE WHEN n = 'unique_tgs' THEN c ELSE 0 END)::BIGINT AS unique_tgs,
        SUM(CASE WHEN n = 'encrypted_grants' THEN c ELSE 0 END)::BIGINT AS encrypted_grants, SUM(CASE WHEN n = 'recordings' THEN c ELSE 0 END)::BIGINT AS recordings,
        SUM(CASE WHEN n = 'sigex_events' THEN c ELSE 0 END)::BIGINT AS sigex_events, SUM(CASE WHEN n = 'sessions' THEN c ELSE 0 END)::BIGINT AS sessions FROM (
         SELECT 1 + k % 2 AS op, 'signal_hits' AS n, COUNT(*) AS c FROM hits GROUP BY 1
         UNION ALL SELECT 1 + channel_id % 2, 'traffic_sessions', COUNT(*) FROM sessions GROUP BY 1
         UNION ALL SELECT operation_id, 'channel_grants', COUNT(*) FROM gr GROUP BY 1
         UNION ALL SELECT operation_id, 'unique_tgs', COUNT(DISTINCT tgid) FROM gr GROUP BY 1
         UNION ALL SELECT operation_id, 'encrypted_grants', COUNT(DISTINCT g.id) FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE t.encrypted = 'encrypted' GROUP BY 1
         UNION ALL SELECT 1 + site_id % 2, 'recordings', COUNT(*) FROM rec GROUP BY 1
         UNION ALL SELECT 1 + k % 2, 'sigex_events', COUNT(*) FROM ev WHERE event_type LIKE 'sigex.%' GROUP BY 1
         UNION ALL SELECT 1 + site_id % 2, 'sessions', COUNT(*) FROM ss GROUP BY 1) GROUP BY 1""",
    sessions_cte(),
)
def _(v):
    op = lambda c: (1 + F.col(c) % 2).alias("operation_id")
    grants = v.gr.join(tg_dim(v, "encrypted"), ["tgid", "system"], "left")
    return counters(
        [
            (v.hits.select(op("k")), {"signal_hits": rows()}),
            (sessions_of(v).select(op("channel_id")), {"traffic_sessions": rows()}),
            (
                grants,
                {"channel_grants": rows(), "unique_tgs": F.count_distinct("tgid"), "encrypted_grants": tally(F.col("encrypted") == "encrypted")},
            ),
            (v.rec.select(op("site_id")), {"recordings": rows()}),
            (v.ev.where(F.col("event_type").startswith("sigex.")).select(op("k")), {"sigex_events": rows()}),
            (v.ss.select(op("site_id")), {"sessions": rows()}),
        ],
        ["operation_id"],
    )


@query(
    "agg08_fleet_stats",
    """SELECT (SELECT COUNT(*) FROM hits) AS signal_hits, (SELECT COUNT(*) FROM sessions) AS traffic_sessions, (SELECT COUNT(*) FROM gr) AS channel_grants,
        (SELECT COUNT(*) FROM rec) AS recordings, (SELECT COUNT(*) FROM ev WHERE event_type LIKE 'sigex.%') AS sigex_events, (SELECT COUNT(*) FROM ss) AS sessions,
        (SELECT COUNT(DISTINCT operation_id) FROM gr) AS total_ops, (SELECT COUNT(DISTINCT tgid) FROM gr) AS unique_tgs,
        (SELECT COUNT(*) FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE t.encrypted = 'encrypted') AS encrypted_grants""",
    sessions_cte(),
)
def _(v):
    grants = v.gr.join(tg_dim(v, "encrypted"), ["tgid", "system"], "left")
    return counters(
        [
            (v.hits, {"signal_hits": rows()}),
            (sessions_of(v), {"traffic_sessions": rows()}),
            (
                grants,
                {
                    "channel_grants": rows(), "total_ops": F.count_distinct("operation_id"), "unique_tgs": F.count_distinct("tgid"),
                    "encrypted_grants": tally(F.col("encrypted") == "encrypted"),
                },
            ),
            (v.rec, {"recordings": rows()}),
            (v.ev.where(F.col("event_type").startswith("sigex.")), {"sigex_events": rows()}),
            (v.ss, {"sessions": rows()}),
        ]
    )


@query(
    "agg17_network_summary",
    f"""SELECT (SELECT COUNT(DISTINCT site_id) FROM ss) AS total_sites, (SELECT COUNT(*) FROM tg) AS total_talkgroups, COUNT(*) AS total_grants,
        (SELECT COUNT(*) FROM (SELECT DISTINCT uid, tgid FROM gr)) AS total_affiliations, COUNT(DISTINCT uid) AS unique_uids,
        COUNT(CASE WHEN ts >= {NOW} - INTERVAL 36 HOUR THEN 1 END) AS recent_grants FROM gr""",
)
def _(v):
    recent = F.col("ts") >= ts_lit(AS_OF) - F.make_dt_interval(hours=F.lit(36))
    return counters(
        [
            (v.ss, {"total_sites": F.count_distinct("site_id")}),
            (v.tg, {"total_talkgroups": rows()}),
            (
                v.gr,
                {
                    "total_grants": rows(), "total_affiliations": F.count_distinct("uid", "tgid"),
                    "unique_uids": F.count_distinct("uid"), "recent_grants": tally(recent),
                },
            ),
        ]
    )


@query(
    "agg34_dashboard_counters",
    f"""SELECT (SELECT COUNT(*) FROM sessions) AS total_sessions, (SELECT COUNT(*) FROM ss WHERE end_time IS NULL) AS active_sessions,
        COUNT(*) AS total_events, COUNT(CASE WHEN encrypted IS NULL THEN 1 END) AS unacked_events, COUNT(CASE WHEN ts >= {NOW} - INTERVAL 1 DAY THEN 1 END) AS events_today,
        (SELECT COUNT(*) FROM actors) AS total_actors, (SELECT COUNT(*) FROM orgs) AS total_organizations, (SELECT COUNT(DISTINCT site_id) FROM ss) AS total_sites
       FROM ev WHERE event_type LIKE 'sigex.%'""",
    sessions_cte(),
)
def _(v):
    today = F.col("ts") >= ts_lit(AS_OF) - F.make_dt_interval(days=F.lit(1))
    return counters(
        [
            (sessions_of(v), {"total_sessions": rows()}),
            (v.ss, {"active_sessions": tally(F.col("end_time").isNull()), "total_sites": F.count_distinct("site_id")}),
            (
                v.ev.where(F.col("event_type").startswith("sigex.")),
                {"total_events": rows(), "unacked_events": tally(F.col("encrypted").isNull()), "events_today": tally(today)},
            ),
            (v.actors, {"total_actors": rows()}),
            (v.orgs, {"total_organizations": rows()}),
        ]
    )


# --- encryption ------------------------------------------------------------


@query(
    "agg18_encryption_posture",
    """SELECT k.system, k.tgid, total_sessions, encrypted_sessions, total_sessions - encrypted_sessions AS clear_sessions, algorithms, key_ids, last_rotation_ns,
        CASE WHEN encrypted_sessions = 0 THEN 'clear' WHEN total_sessions = encrypted_sessions THEN 'encrypted' ELSE 'mixed' END AS posture FROM (
         SELECT system, tgid, SUM(session_count)::BIGINT AS total_sessions, SUM(CASE WHEN algorithm_id IN (0, 128) THEN 0 ELSE session_count END)::BIGINT AS encrypted_sessions,
           string_agg(DISTINCT algorithm_name, ',' ORDER BY algorithm_name) AS algorithms, string_agg(DISTINCT CASE WHEN key_id >= 0 THEN key_id::VARCHAR END, ',' ORDER BY CASE WHEN key_id >= 0 THEN key_id::VARCHAR END) AS key_ids
         FROM keycat GROUP BY 1, 2) k LEFT JOIN (SELECT system, tgid, MAX(timestamp_ns) AS last_rotation_ns FROM rotations GROUP BY 1, 2) r ON r.system = k.system AND r.tgid = k.tgid""",
    KEYS_CTE + "," + ROT_CTE,
)
def _(v):
    clear = F.col("algorithm_id").isin(0, 128)
    total, secret = F.sum("session_count"), F.sum(F.when(clear, 0).otherwise(F.col("session_count")))
    names = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    per_tg = key_catalogue(v).groupBy("system", "tgid").agg(
        total.alias("total_sessions"), secret.alias("encrypted_sessions"), (total - secret).alias("clear_sessions"),
        names("algorithm_name").alias("algorithms"), names(F.when(F.col("key_id") >= 0, F.col("key_id").cast("string"))).alias("key_ids"),
    )
    last = H.key_rotations(v.crypto).groupBy("system", "tgid").agg(F.max("timestamp_ns").alias("last_rotation_ns"))
    return per_tg.withColumn("posture", S.posture(F.col("encrypted_sessions"), F.col("clear_sessions"))).join(last, ["system", "tgid"], "left")


@query(
    "agg19_posture_detail",
    """SELECT t.tgid, t.name, t.department, COALESCE(g.n, 0) * GREATEST(COALESCE(k.n, 0), 1) AS grant_count, g.last_ns AS last_activity_ns, COALESCE(r.n, 0) AS rotation_count, r.last_ns AS last_rotation_ns
       FROM tg t LEFT JOIN (SELECT tgid, COUNT(*) AS n, MAX(timestamp_ns) AS last_ns FROM gr GROUP BY 1) g ON g.tgid = t.tgid
       LEFT JOIN (SELECT tgid, system, COUNT(*) AS n FROM keycat GROUP BY 1, 2) k ON k.tgid = t.tgid AND k.system = t.system
       LEFT JOIN (SELECT tgid, COUNT(*) AS n, MAX(timestamp_ns) AS last_ns FROM rotations GROUP BY 1) r ON r.tgid = t.tgid WHERE t.encrypted = 'encrypted'""",
    KEYS_CTE + "," + ROT_CTE,
)
def _(v):
    # The keys of a talkgroup multiply its grant count; the product of two counts says it without the fan-out.
    grants = v.gr.groupBy("tgid").agg(rows().alias("g_n"), F.max("timestamp_ns").alias("last_activity_ns"))
    keys = key_catalogue(v).groupBy("tgid", "system").agg(rows().alias("k_n"))
    turns = H.key_rotations(v.crypto).groupBy("tgid").agg(rows().alias("rotation_count"), F.max("timestamp_ns").alias("last_rotation_ns"))
    count = F.coalesce("g_n", F.lit(0)) * F.greatest(F.coalesce("k_n", F.lit(0)), F.lit(1))
    return (
        v.tg.where(F.col("encrypted") == "encrypted").join(grants, "tgid", "left").join(keys, ["tgid", "system"], "left").join(turns, "tgid", "left")
        .select("tgid", "name", "department", count.alias("grant_count"), "last_activity_ns", F.coalesce("rotation_count", F.lit(0)).alias("rotation_count"), "last_rotation_ns")
    )


@query("agg20_algorithm_mix", "SELECT algorithm_name, SUM(session_count)::BIGINT AS sessions, COUNT(*) AS tg_rows FROM keycat GROUP BY 1", KEYS_CTE)
def _(v):
    return key_catalogue(v).groupBy("algorithm_name").agg(F.sum("session_count").alias("sessions"), rows().alias("tg_rows")).orderBy(F.desc("sessions"))


@query(
    "ups03_talkgroup_catalogue",
    """SELECT system, tgid, COUNT(*) AS total_grants, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns,
        CASE WHEN NOT bool_or(enc) THEN 'clear' WHEN bool_and(enc) THEN 'encrypted' ELSE 'mixed' END AS encrypted FROM (SELECT *, k % 4 = 0 AND grant_type <> 'group_update' AS enc FROM gr) GROUP BY 1, 2""",
)
def _(v):
    # Group updates carry no encryption flag and count as clear.
    enc = (F.col("k") % 4 == 0) & (F.col("grant_type") != "group_update")
    return (
        v.gr.withColumn("enc", enc).groupBy("system", "tgid")
        .agg(
            rows().alias("total_grants"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
            F.when(~F.bool_or("enc"), "clear").when(F.bool_and("enc"), "encrypted").otherwise("mixed").alias("encrypted"),
        )
    )


@query(
    "ups05_radio_sightings",
    """SELECT uid, system, COUNT(*) AS observation_count, arg_max(tgid, (timestamp_ns, id)) AS tgid, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns FROM (
        SELECT *, CASE WHEN grant_type <> 'unit' THEN tgid END AS t2 FROM gr) WHERE t2 IS NOT NULL GROUP BY 1, 2""",
)
def _(v):
    seen = v.gr.where(F.col("grant_type") != "unit")
    return seen.groupBy("uid", "system").agg(
        rows().alias("observation_count"),
        F.max_by("tgid", F.when(F.col("tgid").isNotNull(), F.struct("timestamp_ns", "id"))).alias("tgid"),
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )


# --- scalars over grants ---------------------------------------------------


@query(
    "scl01_date_parts",
    "SELECT id, hour(ts) AS h, dayofweek(ts) AS w, strftime(ts, '%Y-%m-%d %H:00') AS hour_text, strftime(ts, '%Y-%m-%dT%H:00:00') AS hour_iso FROM gr",
)
def _(v):
    ts = F.col("ts")
    return v.gr.select(
        "id", F.hour(ts).alias("h"), S.sunday_dow(ts).alias("w"), F.date_format(ts, "yyyy-MM-dd HH:00").alias("hour_text"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:00:00").alias("hour_iso"),
    )


@query("scl02_relative_time", f"SELECT id FROM gr WHERE ts >= {NOW} - INTERVAL 7 DAY AND ts < {NOW} - INTERVAL 36 HOUR")
def _(v):
    now = ts_lit(AS_OF)
    return v.gr.where(
        (F.col("ts") >= now - F.make_dt_interval(days=F.lit(7))) & (F.col("ts") < now - F.make_dt_interval(hours=F.lit(36)))
    ).select("id")


@query("scl03_null_handling", "SELECT id, COALESCE(classification, 'UNK') AS cls, COALESCE(nac, -1) AS nac, encrypted IS NULL OR encrypted AS maybe_secret FROM ev")
def _(v):
    enc = F.col("encrypted")
    return v.ev.select(
        "id", F.coalesce("classification", F.lit("UNK")).alias("cls"), F.coalesce("nac", F.lit(-1)).alias("nac"), (enc.isNull() | enc).alias("maybe_secret")
    )


@query(
    "scl04_numeric",
    "SELECT id, ROUND(abs(voice_freq - 150.25e0), 6) AS off, ROUND(voice_freq, 3) AS r3, CAST(trunc(voice_freq) AS BIGINT) AS whole, GREATEST(1, k % 3) AS at_least, k // 7 AS sevenths FROM gr",
)
def _(v):
    f = F.col("voice_freq")
    return v.gr.select(
        "id", F.round(F.abs(f - 150.25), 6).alias("off"), F.round(f, 3).alias("r3"), f.cast("long").alias("whole"),
        F.greatest(F.lit(1), F.col("k") % 3).alias("at_least"), F.expr("k div 7").alias("sevenths"),
    )


@query("scl05_conditional", "SELECT tgid, SUM(CASE WHEN grant_type = 'unit' THEN 1 ELSE 0 END)::BIGINT AS units, SUM(CASE WHEN grant_type <> 'unit' THEN 1 ELSE 0 END)::BIGINT AS groups FROM gr GROUP BY 1")
def _(v):
    unit = F.col("grant_type") == "unit"
    return v.gr.groupBy("tgid").agg(tally(unit).alias("units"), tally(~unit).alias("groups"))


@query(
    "scl06_text",
    """SELECT tgid, string_agg(DISTINCT grant_type, ',' ORDER BY grant_type) AS kinds, concat('TG ', tgid, ' @ ', printf('%.4f', MIN(voice_freq))) AS label
       FROM gr WHERE grant_type ILIKE 'GROUP%' GROUP BY tgid""",
)
def _(v):
    kinds = F.array_join(F.array_sort(F.collect_set("grant_type")), ",")
    label = F.concat(F.lit("TG "), F.col("tgid"), F.lit(" @ "), S.fixed(F.col("low"), 4))
    return (
        v.gr.where(F.col("grant_type").ilike("GROUP%")).groupBy("tgid").agg(kinds.alias("kinds"), F.min("voice_freq").alias("low"))
        .select("tgid", "kinds", label.alias("label"))
    )


@query(
    "scl07_json",
    "SELECT id, CAST(json_extract_string(j, '$.tg') AS BIGINT) AS tg, CAST(json_extract_string(j, '$.f[1].mhz') AS DOUBLE) AS second_mhz FROM (SELECT id, json_object('tg', tgid, 'f', [json_object('mhz', voice_freq), json_object('mhz', k)]) AS j FROM gr)",
)
def _(v):
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("tg", T.LongType()),
        T.StructField("f", T.ArrayType(T.StructType([T.StructField("mhz", T.DoubleType())]))),
    ])
    pair = F.array(F.struct(F.col("voice_freq").alias("mhz")), F.struct(F.col("k").cast("double").alias("mhz")))
    text = v.gr.select("id", F.to_json(F.struct(F.col("tgid").alias("tg"), pair.alias("f"))).alias("j"))
    parsed = text.withColumn("p", F.from_json("j", schema))
    return parsed.select("id", "p.tg", F.get("p.f", F.lit(1))["mhz"].alias("second_mhz"))
