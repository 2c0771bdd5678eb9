"""Live jobs with keyed state, replayed over the given tables; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import filters as P
from wavetrail.operators.rules import Rule, matches, rule_table
from wavetrail.plans.history import DAY_NS, ROT_CTE, sessions_cte, traces_cte
from wavetrail.plans.messages import FIND_SQL, MSG_CTE, parsed
from wavetrail.plans.registry import query
from wavetrail.plans.rules import CHAIN, COUNTS, END, FIRES_SQL, RULES, START, STEP
from wavetrail.plans.streams import GEO_CTE, NEW_TG, fixes, geo_sites, raw_stream, scratch
from wavetrail.sources.bindings import AS_OF_NS, EPOCH_S, Views
from wavetrail.streaming import jobs as J
from wavetrail.streaming import live as L

LATE = "10 minutes"
#: Event time that ends a replay: everything open is closed by then.
END_S = AS_OF_NS // 10**9 + 5 * 86400


def live_views(v, log) -> Views:
    """The bound views over a stream of the log."""
    views = Views(v.spark, v.dir)
    views.ev = log
    return views


def beat(spark, path: str, second: int) -> None:
    """A heartbeat of the clock as one more file of its stream."""
    spark.range(1).select(F.timestamp_seconds(F.lit(second)).alias("ts")).write.mode("append").parquet(path)


def replay(v, path: str, make, until_s: int = END_S) -> None:
    """Runs ``make(beats)``, a writer, over all there is, then once more after a last heartbeat."""
    beats_path = f"{path}/beats"
    beat(v.spark, beats_path, EPOCH_S)
    beats = v.spark.readStream.schema("ts timestamp").parquet(beats_path)
    writer = make(beats)
    with L.state_store(v.spark):
        J.run_to_end(writer, f"{path}/checkpoint")
        beat(v.spark, beats_path, until_s)
        J.run_to_end(writer, f"{path}/checkpoint")


def written(spark, path: str, schema: str):
    """Rows of all batches of a sink."""
    return spark.read.schema(schema).parquet(path).drop("batch")


def analysis_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    live = live_views(v, log)
    messages = lambda kinds: parsed(live, kinds).withColumn("ts", F.timestamp_micros(F.expr("timestamp_ns div 1000")))
    replay(v, path, lambda beats: L.write_findings(L.analysis(live.crypto, live.gr, live.hits, messages, beats, DAY_NS, late), path, L.describe), until_s)
    return written(v.spark, f"{path}/findings", "finding string, id long, timestamp_ns long, summary string")


@query(
    "stm20_stream_analysis",
    f"""SELECT 'crypto_rotation' AS finding, id, summary FROM rotations
        UNION ALL SELECT 'new_uid', id, concat('New UID ', uid, ' on TG ', tgid) FROM (SELECT *, row_number() OVER (PARTITION BY system, uid ORDER BY timestamp_ns, id) AS rn FROM gr WHERE uid > 0) WHERE rn = 1
        UNION ALL SELECT 'traffic_session', channel_id, concat('Session on ', freq_key, ' MHz — ', hit_count, ' hits, ', printf('%.1f', duration_sec), 's, avg ', printf('%.0f', avg_signal), ' dB') FROM sessions
        UNION ALL SELECT finding, id, summary FROM ({FIND_SQL})""",
    ROT_CTE + "," + sessions_cte() + "," + MSG_CTE,
)
def _(v):
    return analysis_rows(v, raw_stream(v), scratch(v, "stm20")).select("finding", "id", "summary")


def trace_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    p25 = log.where(F.col("event_type").startswith("protocol.p25."))
    make = lambda found: found.select("id", "event_type", "trace_id", "span_id")
    replay(v, path, lambda beats: L.write_findings(L.traces(p25, beats, DAY_NS, late), path, make), until_s)
    return written(v.spark, f"{path}/findings", "id long, event_type string, trace_id long, span_id long")


@query("stm04_live_traces", "SELECT id, event_type, trace_id, span_id FROM traced", traces_cte())
def _(v):
    return trace_rows(v, raw_stream(v), scratch(v, "stm04-live"))


FEDERAL = Rule(5, "Federal Activity Detected", "first_occurrence", (P.Eq("cls", "FEDL"),), cooldown_sec=12 * 3600)


def cooldown_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    hits = matches(log, [FEDERAL]).select("ts", "rule_id", "id", "timestamp_ns")
    replay(v, path, lambda beats: L.fire(L.cooldown(hits, beats, FEDERAL.cooldown_sec, late), path, FEDERAL.cooldown_sec), until_s)
    return written(v.spark, f"{path}/fired", "rule_id int, timestamp_ns long")


@query(
    "win08_live_cooldown",
    """SELECT 5 AS rule_id, t AS timestamp_ns FROM w WHERE t IS NOT NULL""",
    """w AS (WITH RECURSIVE r AS (SELECT MIN(timestamp_ns) AS t FROM ev WHERE classification = 'FEDL' UNION ALL
  SELECT (SELECT MIN(timestamp_ns) FROM ev WHERE classification = 'FEDL' AND timestamp_ns >= r.t + 43200000000000) FROM r WHERE r.t IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    return cooldown_rows(v, raw_stream(v), scratch(v, "win08-live"))


QUIET = [
    Rule(4, "no spectrum", "absence", (P.Eq("type", "spectrum.detect"),), 2 * 3600),
    Rule(3, "no disconnect", "absence", (P.Eq("type", "system.sdr.disconnect"),), 3600),
]


def silence_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    make = lambda found: found.select(F.col("key").cast("int").alias("rule_id"), "since_ns", "timestamp_ns")
    replay(v, path, lambda beats: L.write_findings(L.silences(log, QUIET, beats, late), path, make), until_s)
    return written(v.spark, f"{path}/findings", "rule_id int, since_ns long, timestamp_ns long")


@query(
    "stm06_live_absence",
    f"""SELECT rule_id, since AS since_ns, since + width AS timestamp_ns FROM (
        SELECT 4 AS rule_id, 7200000000000 AS width, t AS since, lead(t) OVER (ORDER BY t) AS next FROM (SELECT {EPOCH_S}000000000 AS t UNION ALL SELECT timestamp_ns FROM ev WHERE event_type = 'spectrum.detect')
        UNION ALL SELECT 3, 3600000000000, {EPOCH_S}000000000, NULL) WHERE coalesce(next, {END_S}000000000) - since > width""",
)
def _(v):
    return silence_rows(v, raw_stream(v), scratch(v, "stm06-live"))


@query(
    "stm11_stream_chain",
    """SELECT event_key, source_key, depth, rule_id, body FROM (
        SELECT concat(id, '>14') AS event_key, id::VARCHAR AS source_key, 1 AS depth, 14 AS rule_id, concat('Encrypted voice on TG ', talkgroup, ' at ', printf('%.4f', freq_mhz)) AS body FROM ev WHERE event_type = 'protocol.p25.voice' AND encrypted
        UNION ALL SELECT concat(id, '>14>17'), concat(id, '>14'), 2, 17, concat('Escalated ', talkgroup, ' in ', band) FROM ev WHERE event_type = 'protocol.p25.voice' AND encrypted AND band = 'UHF'
        UNION ALL SELECT concat(id, '>14>17>18'), concat(id, '>14>17'), 3, 18, concat('Echo of ', printf('%.4f', freq_mhz)) FROM ev WHERE event_type = 'protocol.p25.voice' AND encrypted AND band = 'UHF')""",
)
def _(v):
    path = scratch(v, "stm11-chain")
    table = rule_table(v.spark, CHAIN)
    J.run_to_end(J.chain_stream(raw_stream(v), lambda: table, f"{path}/derived"), f"{path}/checkpoint")
    return written(v.spark, f"{path}/derived", "event_key string, source_key string, depth int, rule_id int, body string")


def counted_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    make = lambda found: found.select(F.col("key").cast("int").alias("rule_id"), F.expr("timestamp_ns div 1000000000").alias("at_s"), F.col("hit_count").alias("match_count"))
    replay(v, path, lambda beats: L.write_findings(L.counted(log, RULES, beats, late, STEP, START, END), path, make), until_s)
    return written(v.spark, f"{path}/findings", "rule_id int, at_s long, match_count long")


@query("stm07_live_counted_rules", FIRES_SQL, COUNTS)
def _(v):
    return counted_rows(v, raw_stream(v), scratch(v, "stm07-live"))


def new_value_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    make = lambda found: found.select(F.lit(NEW_TG.id).alias("rule_id"), "id", F.col("key").alias("value"))
    replay(v, path, lambda beats: L.write_findings(L.new_values(log, NEW_TG, beats, late), path, make), until_s)
    return written(v.spark, f"{path}/findings", "rule_id int, id long, value string")


@query(
    "stm09_live_new_values",
    """SELECT 12 AS rule_id, id, value FROM (SELECT id, talkgroup::VARCHAR AS value, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY talkgroup ORDER BY timestamp_ns, id) AS gap
       FROM ev WHERE event_type = 'protocol.p25.grant' AND talkgroup IS NOT NULL) WHERE gap IS NULL OR gap > 172800000000000""",
)
def _(v):
    return new_value_rows(v, raw_stream(v), scratch(v, "stm09-live"))


def visit_rows(v, log, path: str, late: str = LATE, until_s: int = END_S):
    make = lambda found: found.select(F.col("key").cast("long").alias("device"), "id", "timestamp_ns", F.col("finding").alias("change"), F.col("channel_id").alias("site_id"))
    replay(v, path, lambda beats: L.write_findings(L.site_visits(fixes(log), geo_sites(v), beats, late), path, make), until_s)
    return written(v.spark, f"{path}/findings", "device long, id long, timestamp_ns long, change string, site_id long")


@query("stm16_live_geofence", "SELECT device, id, timestamp_ns, change, site_id FROM walk", GEO_CTE)
def _(v):
    return visit_rows(v, raw_stream(v), scratch(v, "stm16-live"))
