"""Rules over the bound event log: hourly evaluation, windows of hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import filters as P
from wavetrail.operators import rules as R
from wavetrail.operators.spacing import spaced_rows
from wavetrail.plans.presets import ALERT_PRESETS, EVENT_PRESETS, scaled
from wavetrail.plans.registry import query
from wavetrail.sources.bindings import AS_OF_NS, EPOCH_S
from wavetrail.sources.work import stored

STEP, SIX, DAY = 3600, 6 * 3600, 86400
START, END = EPOCH_S + DAY, AS_OF_NS // 10**9
GRID = f"grid AS (SELECT {START} + i*{STEP} AS at_s FROM range({(END - START) // STEP + 1}) r(i))"

BURST = scaled(ALERT_PRESETS[0], window_sec=SIX, value=22.0, cooldown_sec=12 * 3600)
SPIKE = scaled(ALERT_PRESETS[5], window_sec=SIX, value=22.0, cooldown_sec=12 * 3600)
SILENCE = R.Rule(4, "Signal Lost (No Spectrum)", "absence", (P.Eq("type", "sigex.emitter.new"), P.Eq("band", "VHF")), 3 * 3600, cooldown_sec=12 * 3600)
RATE = scaled(ALERT_PRESETS[7], percent=20.0, window_sec=SIX, baseline_sec=DAY, cooldown_sec=12 * 3600)


def counts_sql(rule_id: int, cond: str, window: int, older: int = 0) -> str:
    return f"""SELECT {rule_id} AS rule_id, at_s, (SELECT COUNT(*) FROM ev WHERE ({cond}) AND timestamp_ns BETWEEN (at_s - {window})*1000000000 AND at_s*1000000000) AS current,
      (SELECT COUNT(*) FROM ev WHERE ({cond}) AND timestamp_ns BETWEEN (at_s - {older})*1000000000 AND (at_s - {window})*1000000000) AS older FROM grid"""


SPARSE = "event_type = 'sigex.emitter.new' AND band = 'VHF'"
COUNTS = GRID + f""",
counted AS ({counts_sql(1, 'encrypted', SIX)} UNION ALL {counts_sql(6, "event_type = 'protocol.p25.grant'", SIX)}
  UNION ALL {counts_sql(4, SPARSE, 3*3600)} UNION ALL {counts_sql(8, 'TRUE', SIX, DAY)})"""
FIRES_SQL = """SELECT rule_id, at_s, current AS match_count FROM counted WHERE (rule_id IN (1, 6) AND current >= 22) OR (rule_id = 4 AND current = 0)
  OR (rule_id = 8 AND older*(6e0/18) >= 1 AND abs((current - older*(6e0/18))/(older*(6e0/18))*100) >= 20)"""


@query("stm05_threshold_rule", "SELECT rule_id, at_s, current AS match_count FROM counted WHERE rule_id IN (1, 6) AND current >= 22", COUNTS)
def _(v):
    return R.counted_firings(v.ev, [BURST, SPIKE], STEP, START, END)


@query("stm06_absence_rule", "SELECT rule_id, at_s, current AS match_count FROM counted WHERE rule_id = 4 AND current = 0", COUNTS)
def _(v):
    return R.counted_firings(v.ev, [SILENCE], STEP, START, END)


@query("stm07_rate_change_rule", "SELECT rule_id, at_s, current AS match_count FROM counted WHERE rule_id = 8 AND older*(6e0/18) >= 1 AND abs((current - older*(6e0/18))/(older*(6e0/18))*100) >= 20", COUNTS)
def _(v):
    return R.counted_firings(v.ev, [RATE], STEP, START, END)


MULTI = scaled(EVENT_PRESETS[2], window_sec=SIX, value=60.0, field="freq", cooldown_sec=12 * 3600)
MULTI = scaled(MULTI, value=31.0)
PER_UID = scaled(EVENT_PRESETS[2], window_sec=SIX, value=3.0, group_by=("uid",))


@query(
    "stm08_cardinality_rule",
    "SELECT 13 AS rule_id, '' AS grp, at_s, n AS match_count FROM (SELECT at_s, (SELECT COUNT(DISTINCT freq_mhz) FROM ev WHERE source_unit IS NOT NULL AND timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND at_s*1000000000) AS n FROM grid) WHERE n >= 31",
    GRID,
)
def _(v):
    return R.distinct_firings(v.ev, [MULTI], STEP, START, END)


@query(
    "stm08b_cardinality_per_radio",
    """SELECT 13 AS rule_id, source_unit::VARCHAR AS grp, at_s, COUNT(DISTINCT band) AS match_count FROM grid JOIN ev ON timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND at_s*1000000000 GROUP BY 2, 3 HAVING COUNT(DISTINCT band) >= 3""",
    GRID,
)
def _(v):
    return R.distinct_firings(v.ev, [PER_UID], STEP, START, END)


SPOTTER = scaled(EVENT_PRESETS[1], baseline_sec=SIX)


@query(
    "stm09_new_value_rule",
    """SELECT 12 AS rule_id, at_s, COUNT(DISTINCT talkgroup) AS match_count FROM grid JOIN ev e ON e.event_type = 'protocol.p25.grant' AND e.timestamp_ns BETWEEN (at_s - 3600)*1000000000 AND at_s*1000000000
       WHERE NOT EXISTS (SELECT 1 FROM ev h WHERE h.talkgroup = e.talkgroup AND h.timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND (at_s - 3600)*1000000000) GROUP BY at_s""",
    GRID,
)
def _(v):
    return R.new_value_firings(v.ev, SPOTTER, STEP, START, END)


@query(
    "joi16_new_value_anti_join",
    f"""SELECT DISTINCT source_unit AS uid FROM ev e WHERE event_type = 'protocol.p25.grant' AND timestamp_ns BETWEEN {AS_OF_NS} - 2*86400000000000 AND {AS_OF_NS}
       AND NOT EXISTS (SELECT 1 FROM ev h WHERE h.source_unit = e.source_unit AND h.event_type <> 'protocol.p25.update' AND h.timestamp_ns BETWEEN {AS_OF_NS} - 2*86400000000000 - 7200000000000 AND {AS_OF_NS} - 2*86400000000000)""",
)
def _(v):
    cut = AS_OF_NS - 2 * DAY * 10**9
    recent = v.ev.where((F.col("event_type") == "protocol.p25.grant") & F.col("timestamp_ns").between(cut, AS_OF_NS)).select(F.col("source_unit").alias("uid")).distinct()
    known = v.ev.where((F.col("event_type") != "protocol.p25.update") & F.col("timestamp_ns").between(cut - 7200 * 10**9, cut)).select(F.col("source_unit").alias("uid"))
    return recent.join(known, "uid", "left_anti")


PAIR = R.Rule(
    21, "Same unit on voice and emitter", "correlation", (P.Eq("type", "sigex.emitter.new"), P.Eq("band", "VHF")), SIX,
    second=(P.Eq("type", "protocol.p25.voice"), P.Eq("enc", True)), field="uid", cooldown_sec=12 * 3600,
)
PAIR_SQL = """SELECT 21 AS rule_id, at_s, a + b AS match_count FROM (SELECT at_s, (SELECT COUNT(*) FROM ev WHERE event_type = 'sigex.emitter.new' AND band = 'VHF' AND timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND at_s*1000000000) AS a,
  (SELECT COUNT(*) FROM ev s WHERE event_type = 'protocol.p25.voice' AND encrypted AND timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND at_s*1000000000
     AND source_unit IN (SELECT source_unit FROM ev WHERE event_type = 'sigex.emitter.new' AND band = 'VHF' AND timestamp_ns BETWEEN (at_s - 21600)*1000000000 AND at_s*1000000000)) AS b FROM grid) WHERE b > 0"""


@query("joi15_stream_correlation", PAIR_SQL, GRID)
def _(v):
    return R.correlation_firings(v.ev, PAIR, STEP, START, END)


@query("stm10_correlation_rule", PAIR_SQL, GRID)
def _(v):
    rule = R.load_rules(R.rule_table(v.spark, [PAIR]))[0]
    return R.correlation_firings(v.ev, rule, STEP, START, END)


COOL_CTE = """
walk AS (WITH RECURSIVE w AS (
  SELECT rule_id, MIN(at_s) AS at_s FROM fires GROUP BY 1
  UNION ALL SELECT w.rule_id, (SELECT MIN(f.at_s) FROM fires f WHERE f.rule_id = w.rule_id AND f.at_s >= w.at_s + 43200) FROM w WHERE w.at_s IS NOT NULL) SELECT * FROM w WHERE at_s IS NOT NULL)"""
RULES = [BURST, SPIKE, SILENCE, RATE]


def counted(v):
    return stored(R.counted_firings(v.ev, RULES, STEP, START, END), "counted")


@query("win08_cooldown", "SELECT rule_id, at_s FROM walk", COUNTS + f",\nfires AS ({FIRES_SQL})," + COOL_CTE)
def _(v):
    return R.after_cooldown(counted(v), RULES)


def cooled(v):
    fires = counted(v)
    return stored(fires.join(R.after_cooldown(fires, RULES), ["rule_id", "at_s"], "left_semi"), "cooled")


COND = {1: "encrypted", 6: "event_type = 'protocol.p25.grant'", 4: SPARSE, 8: "TRUE"}
_names = {r.id: r.name for r in RULES}
_sample = " ".join(
    f"WHEN {i} THEN (SELECT arg_max(id, (timestamp_ns, id)) FROM ev WHERE ({c}) AND timestamp_ns BETWEEN (at_s - {w})*1000000000 AND at_s*1000000000)"
    for i, c, w in ((1, COND[1], SIX), (6, COND[6], SIX), (8, COND[8], SIX))
)


@query(
    "stm13_firing_log",
    f"SELECT rule_id, CASE rule_id {' '.join(f'''WHEN {i} THEN '{n}' ''' for i, n in _names.items())} END AS rule_name, at_s*1000000000 AS fired_ns, match_count, CASE rule_id {_sample} END AS sample_event_id, FALSE AS acknowledged FROM fires JOIN walk USING (rule_id, at_s)",
    COUNTS + f",\nfires AS ({FIRES_SQL})," + COOL_CTE,
)
def _(v):
    return R.firing_log(cooled(v), v.ev, RULES, STEP)


TAGGER = EVENT_PRESETS[3]


@query(
    "stm11_every_event_rule",
    """SELECT id AS source_event_id, 14 AS rule_id, 'custom.encrypted_voice' AS event_type, 5 AS source, 9 AS severity, timestamp_ns, freq_mhz, talkgroup, band,
       concat('Encrypted voice on TG ', talkgroup, ' at ', printf('%.4f', freq_mhz)) AS body, '{"rule_id":14,"rule_name":"Encrypted Traffic Tagger","match_count":1,"chain_depth":0}' AS attributes
       FROM ev WHERE event_type = 'protocol.p25.voice' AND encrypted""",
)
def _(v):
    return R.every_events(v.ev, [TAGGER])


#: A chain of two rules after the tagger, and a rule that matches its own events.
CHAIN = [
    TAGGER,
    R.Rule(17, "Escalation", "every", (P.Eq("type", "custom.encrypted_voice"), P.Eq("band", "UHF")), event_type="custom.escalation", severity=13, body_template="Escalated {{talkgroups}} in {{bands}}"),
    R.Rule(18, "Echo", "every", (P.In("type", ["custom.escalation", "custom.echo"]),), event_type="custom.echo", severity=5, body_template="Echo of {{freqs}}"),
]


@query(
    "stm11b_chained_rules",
    """SELECT event_key, source_key, root_id, depth, rule_id, event_type, source, severity, timestamp_ns, body, freq_mhz, talkgroup, band FROM chain WHERE depth > 0""",
    """chain AS (WITH RECURSIVE c AS (
  SELECT id::VARCHAR AS event_key, NULL::VARCHAR AS source_key, id AS root_id, 0 AS depth, 0 AS rule_id, event_type, 0 AS source, 0 AS severity, timestamp_ns, '' AS body, freq_mhz, talkgroup, band, encrypted FROM ev
  UNION ALL
  SELECT concat(c.event_key, '>', r.id), c.event_key, root_id, depth + 1, r.id, r.type, 5, r.sev, timestamp_ns,
    CASE r.id WHEN 14 THEN concat('Encrypted voice on TG ', talkgroup, ' at ', printf('%.4f', freq_mhz)) WHEN 17 THEN concat('Escalated ', talkgroup, ' in ', band) ELSE concat('Echo of ', printf('%.4f', freq_mhz)) END,
    freq_mhz, talkgroup, band, NULL
  FROM c JOIN (VALUES (14, 'custom.encrypted_voice', 9), (17, 'custom.escalation', 13), (18, 'custom.echo', 5)) r(id, type, sev)
    ON (r.id = 14 AND c.event_type = 'protocol.p25.voice' AND c.encrypted) OR (r.id = 17 AND c.event_type = 'custom.encrypted_voice' AND c.band = 'UHF') OR (r.id = 18 AND c.event_type IN ('custom.escalation', 'custom.echo'))
  WHERE depth < 5) SELECT * FROM c)""",
)
def _(v):
    return R.chain_events(v.ev, CHAIN, 5)


FEDL = scaled(ALERT_PRESETS[4], cooldown_sec=12 * 3600)


@query(
    "stm12_first_occurrence_alert",
    """SELECT 5 AS rule_id, t AS timestamp_ns FROM w WHERE t IS NOT NULL""",
    """w AS (WITH RECURSIVE r AS (SELECT MIN(timestamp_ns) AS t FROM ev WHERE classification = 'FEDL' UNION ALL
  SELECT (SELECT MIN(timestamp_ns) FROM ev WHERE classification = 'FEDL' AND timestamp_ns >= r.t + 43200000000000) FROM r WHERE r.t IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    hits = R.matches(v.ev.where(F.col("event_type") != "system.alert.fired"), [FEDL])
    return R.after_cooldown(hits, [FEDL], "timestamp_ns", 10**9)


BOTH = [scaled(EVENT_PRESETS[0], window_sec=SIX, value=12.0, cooldown_sec=12 * 3600), scaled(EVENT_PRESETS[0], id=16, name="UHF Burst", filters=(P.Eq("band", "UHF"), P.Eq("type", "protocol.p25.grant")), window_sec=SIX, value=9.0, cooldown_sec=12 * 3600)]
B_COND = {11: "classification = 'FEDL'", 16: "band = 'UHF' AND event_type = 'protocol.p25.grant'"}
B_FIRES = GRID + f""",
counted AS ({counts_sql(11, B_COND[11], SIX)} UNION ALL {counts_sql(16, B_COND[16], SIX)}),
fires AS (SELECT rule_id, at_s, current AS match_count FROM counted WHERE (rule_id = 11 AND current >= 12) OR (rule_id = 16 AND current >= 9)),""" + COOL_CTE + f""",
inwin AS (SELECT w.rule_id, w.at_s, e.* FROM walk w JOIN ev e ON e.timestamp_ns BETWEEN (w.at_s - {SIX})*1000000000 AND w.at_s*1000000000 WHERE (w.rule_id = 11 AND {B_COND[11]}) OR (w.rule_id = 16 AND {B_COND[16]})),
vals AS (SELECT rule_id, at_s, 'f' AS f, printf('%.4f', freq_mhz) AS v, timestamp_ns, id FROM inwin UNION ALL SELECT rule_id, at_s, 't', talkgroup::VARCHAR, timestamp_ns, id FROM inwin
  UNION ALL SELECT rule_id, at_s, 'b', band, timestamp_ns, id FROM inwin UNION ALL SELECT rule_id, at_s, 'u', source_unit::VARCHAR, timestamp_ns, id FROM inwin),
cnt AS (SELECT rule_id, at_s, f, v, COUNT(*) AS n, MAX((timestamp_ns, id)) AS last FROM vals GROUP BY 1, 2, 3, 4),
lists AS (SELECT rule_id, at_s, string_agg(v, ', ' ORDER BY n DESC, v) FILTER (WHERE f = 'f') AS freqs, string_agg(v, ', ' ORDER BY n DESC, v) FILTER (WHERE f = 't') AS talkgroups,
  string_agg(v, ', ' ORDER BY n DESC, v) FILTER (WHERE f = 'b') AS bands, string_agg(v, ', ' ORDER BY last DESC) FILTER (WHERE f = 'u') AS uids,
  arg_min(v, (-n, v)) FILTER (WHERE f = 't') AS top_tg FROM cnt GROUP BY 1, 2),
ctx AS (SELECT i.rule_id, i.at_s, COUNT(*) AS count, arg_max(freq_mhz, (timestamp_ns, id)) AS primary_freq, arg_max(band, (timestamp_ns, id)) AS primary_band FROM inwin i GROUP BY 1, 2)"""


def burst_firings(v):
    fires = stored(R.counted_firings(v.ev, BOTH, STEP, START, END), "burst")
    return stored(fires.join(R.after_cooldown(fires, BOTH), ["rule_id", "at_s"], "left_semi"), "burst-fired")


@query(
    "agg32_body_context",
    "SELECT c.rule_id, c.at_s, c.count, primary_freq, primary_band, freqs, talkgroups, bands, uids, top_tg::BIGINT AS primary_talkgroup FROM ctx c JOIN lists USING (rule_id, at_s)",
    B_FIRES,
)
def _(v):
    links = R.source_links(burst_firings(v), v.ev, BOTH, STEP)
    inside = stored(links.join(v.ev.withColumnRenamed("id", "event_id"), "event_id").withColumnRenamed("event_id", "id"), "burst-inside")
    return R.context(inside, ["rule_id", "at_s"])


@query(
    "prj17_body_template",
    "SELECT c.rule_id, c.at_s, concat(c.count, ' federal signals on ', freqs, ' in ', bands) AS body FROM ctx c JOIN lists USING (rule_id, at_s)",
    B_FIRES,
)
def _(v):
    d = R.derived_events(burst_firings(v), v.ev, BOTH, STEP)
    return d.select("rule_id", F.expr("timestamp_ns div 1000000000L").alias("at_s"), "body")


@query(
    "prj18_derived_events",
    """SELECT c.rule_id, 'custom.fedl_burst' AS event_type, 5 AS source, 13 AS severity, c.at_s*1000000000 AS timestamp_ns, concat(c.count, ' federal signals on ', freqs, ' in ', bands) AS body, primary_freq AS freq_mhz, top_tg::BIGINT AS talkgroup, primary_band AS band,
        concat('{"rule_id":', c.rule_id, ',"rule_name":"', CASE c.rule_id WHEN 11 THEN 'Federal Burst Detector' ELSE 'UHF Burst' END, '","match_count":', c.count, ',"chain_depth":0}') AS attributes FROM ctx c JOIN lists USING (rule_id, at_s)""",
    B_FIRES,
)
def _(v):
    return R.derived_events(burst_firings(v), v.ev, BOTH, STEP)


@query("prj18b_source_links", "SELECT rule_id, at_s, id AS event_id FROM inwin", B_FIRES)
def _(v):
    return R.source_links(burst_firings(v), v.ev, BOTH, STEP)


@query("udx02_rule_defined_events", "SELECT rule_id, at_s FROM walk", B_FIRES)
def _(v):
    rules = R.load_rules(R.rule_table(v.spark, BOTH))
    fires = stored(R.counted_firings(v.ev, rules, STEP, START, END), "ruled")
    return R.after_cooldown(fires, rules)


@query(
    "stm14_rule_presets",
    """SELECT r AS rule_id, COUNT(*) AS matches FROM (SELECT unnest([CASE WHEN encrypted THEN 1 END, CASE WHEN event_type = 'sigex.emitter.new' THEN 2 END, CASE WHEN event_type = 'spectrum.detect' THEN 4 END, CASE WHEN classification = 'FEDL' THEN 5 END,
        CASE WHEN event_type = 'protocol.p25.grant' THEN 6 END, 8, CASE WHEN classification = 'FEDL' THEN 11 END, CASE WHEN event_type = 'protocol.p25.grant' THEN 12 END, CASE WHEN source_unit IS NOT NULL THEN 13 END,
        CASE WHEN event_type = 'protocol.p25.voice' AND encrypted THEN 14 END, CASE WHEN event_type = 'spectrum.detect' THEN 15 END]) AS r FROM ev) WHERE r IS NOT NULL GROUP BY 1""",
)
def _(v):
    rules = R.load_rules(R.rule_table(v.spark, ALERT_PRESETS + EVENT_PRESETS))
    return R.matches(v.ev, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "stm15_rules_as_data",
    "SELECT 1 AS rule_id, COUNT(*) AS matches FROM ev WHERE encrypted AND band IN ('VHF', 'UHF') UNION ALL SELECT 3, COUNT(*) FROM ev WHERE NOT (body ILIKE '%uid 1%') OR talkgroup < 1005",
)
def _(v):
    rules = [
        R.Rule(1, "secret", "every", (P.Eq("enc", True), P.In("band", ["VHF", "UHF"]))),
        R.Rule(2, "off", "every", (P.Exists("id"),), enabled=False),
        R.Rule(3, "mixed", "every", (P.Or(P.Not(P.Contains("body", "uid 1")), P.Lt("tg", 1005)),)),
    ]
    loaded = R.load_rules(R.rule_table(v.spark, rules))
    return R.matches(v.ev, loaded).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "win08b_cooldown_per_radio",
    "SELECT source_unit AS uid, t AS timestamp_ns FROM w WHERE t IS NOT NULL",
    """w AS (WITH RECURSIVE r AS (SELECT source_unit, MIN(timestamp_ns) AS t FROM ev GROUP BY 1 UNION ALL
  SELECT source_unit, (SELECT MIN(timestamp_ns) FROM ev e WHERE e.source_unit = r.source_unit AND e.timestamp_ns >= r.t + 43200000000000) FROM r WHERE r.t IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    rows = v.ev.select(F.col("source_unit").alias("uid"), "timestamp_ns")
    return spaced_rows(rows, "uid", "timestamp_ns", 43200 * 10**9)
