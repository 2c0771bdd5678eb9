"""Message sources, message events, network tracking and alert headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail import schemas
from wavetrail.operators import alerts as W
from wavetrail.operators import messages as M
from wavetrail.plans.registry import query
from wavetrail.sources import readers

TYPES = [
    "GroupVoiceGrant", "GroupVoiceUpdate", "UnitVoiceGrant", "NetworkStatusBroadcast", "RfssStatusBroadcast", "AdjacentSite",
    "ChannelParamsUpdate", "AltControlChannel", "GroupAffiliation", "UnitRegistration", "UnitDeregistration", "DenyResponse", "Other",
]


def messages(v):
    """Tagged-union JSON messages, one per event of the log."""
    k, u = F.col("k"), F.col("source_unit")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("id") % 13 + 1).cast("int"))
    has = lambda *names: F.col("kind").isin(*names)
    chan = lambda d: F.struct(((k + d) % 4).alias("channel_id"), (u + d).alias("channel_num"), (F.col("talkgroup") + d).alias("talkgroup"))
    alt = lambda d: F.struct(((k + d) % 4).alias("channel_id"), (u + d).alias("channel_num"))
    payload = F.struct(
        F.col("kind").alias("type"),
        F.when(has("GroupVoiceGrant", "GroupAffiliation"), F.col("talkgroup")).alias("talkgroup"),
        F.when(has("GroupVoiceGrant", "UnitVoiceGrant", "GroupAffiliation", "UnitRegistration", "UnitDeregistration", "DenyResponse"), u).alias("src_unit"),
        F.when(has("UnitVoiceGrant"), u + 1).alias("dest_unit"),
        F.when(has("GroupVoiceGrant", "UnitVoiceGrant", "NetworkStatusBroadcast", "RfssStatusBroadcast", "AdjacentSite"), k % 4).alias("channel_id"),
        F.when(has("GroupVoiceGrant", "UnitVoiceGrant", "NetworkStatusBroadcast", "RfssStatusBroadcast", "AdjacentSite"), u).alias("channel_num"),
        F.when(has("GroupVoiceGrant"), k % 2 == 0).alias("emergency"),
        F.when(has("GroupVoiceGrant"), k % 3 == 0).alias("encrypted"),
        F.when(has("GroupVoiceUpdate"), F.array(chan(0), chan(1))).alias("updates"),
        F.when(has("NetworkStatusBroadcast", "UnitDeregistration"), F.lit(0xBEE00)).alias("wacn"),
        F.when(has("NetworkStatusBroadcast", "RfssStatusBroadcast", "AdjacentSite", "UnitRegistration", "UnitDeregistration"), F.lit(0x3CC)).alias("system"),
        F.when(has("RfssStatusBroadcast", "AdjacentSite", "AltControlChannel"), k % 3).alias("rfss"),
        F.when(has("RfssStatusBroadcast", "AdjacentSite", "AltControlChannel"), k % 5).alias("site"),
        F.when(has("RfssStatusBroadcast"), F.lit(True)).alias("networked"),
        F.when(has("ChannelParamsUpdate"), k % 3).alias("id"),
        F.when(has("ChannelParamsUpdate"), F.lit(12500)).alias("bandwidth_hz"),
        F.when(has("ChannelParamsUpdate"), 851000000 + (k % 9) * 12500).alias("base_freq_hz"),
        F.when(has("ChannelParamsUpdate"), F.lit(12500)).alias("spacing_hz"),
        F.when(has("AltControlChannel"), F.array(alt(0), alt(1))).alias("channels"),
        F.when(has("Other"), F.array(k)).alias("raw"),
    )
    rows = v.ev.withColumn("kind", kind)
    return rows.select("id", "timestamp_ns", F.to_json(F.struct(F.lit(659).alias("nac"), payload.alias("payload"))).alias("message"))


def parsed(v, kinds=None):
    return readers.protocol_messages(messages(v), kinds=kinds)


_types_sql = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
MSG_CTE = f"""
m0 AS (SELECT *, source_unit AS u, {_types_sql}[CAST(id % 13 AS INTEGER) + 1] AS kind FROM ev),
m AS (SELECT id, timestamp_ns, k, u, talkgroup AS tgx, kind, 659::BIGINT AS nac, CASE WHEN kind IN ('GroupVoiceGrant', 'GroupAffiliation') THEN talkgroup END AS talkgroup,
  CASE WHEN kind IN ('GroupVoiceGrant', 'UnitVoiceGrant', 'GroupAffiliation', 'UnitRegistration', 'UnitDeregistration', 'DenyResponse') THEN u END AS src_unit,
  CASE WHEN kind IN ('GroupVoiceGrant', 'UnitVoiceGrant', 'NetworkStatusBroadcast', 'RfssStatusBroadcast', 'AdjacentSite') THEN k % 4 END AS channel_id,
  CASE WHEN kind IN ('GroupVoiceGrant', 'UnitVoiceGrant', 'NetworkStatusBroadcast', 'RfssStatusBroadcast', 'AdjacentSite') THEN u END AS channel_num,
  CASE WHEN kind = 'GroupVoiceGrant' THEN k % 2 = 0 END AS emergency, CASE WHEN kind = 'GroupVoiceGrant' THEN k % 3 = 0 END AS encrypted,
  CASE WHEN kind IN ('RfssStatusBroadcast', 'AdjacentSite', 'AltControlChannel') THEN k % 3 END AS rfss, CASE WHEN kind IN ('RfssStatusBroadcast', 'AdjacentSite', 'AltControlChannel') THEN k % 5 END AS site,
  CASE WHEN kind IN ('NetworkStatusBroadcast', 'UnitDeregistration') THEN 781824 END AS wacn,
  CASE WHEN kind IN ('NetworkStatusBroadcast', 'RfssStatusBroadcast', 'AdjacentSite', 'UnitRegistration', 'UnitDeregistration') THEN 972 END AS system_id FROM m0),
params AS (SELECT id, timestamp_ns, k % 3 AS channel_id, 851000000 + (k % 9)*12500 AS base_hz FROM m WHERE kind = 'ChannelParamsUpdate'),
ask AS (SELECT id, timestamp_ns, channel_id, channel_num, 0 AS entry FROM m WHERE channel_id IS NOT NULL
  UNION ALL SELECT id, timestamp_ns, (k + d) % 4, u + d, d FROM m, range(2) r(d) WHERE kind IN ('GroupVoiceUpdate', 'AltControlChannel')),
freqs AS (SELECT a.id, a.entry, (p.base_hz + 12500*a.channel_num)/1e6 AS freq FROM ask a LEFT JOIN LATERAL (
   SELECT base_hz FROM params p WHERE p.channel_id = a.channel_id AND p.timestamp_ns <= a.timestamp_ns ORDER BY p.timestamp_ns DESC, p.id DESC LIMIT 1) p ON TRUE),
ngrants AS (SELECT m.id, timestamp_ns, 'SYS' AS system, f.entry, CASE kind WHEN 'GroupVoiceGrant' THEN talkgroup WHEN 'GroupVoiceUpdate' THEN tgx + f.entry ELSE 0 END AS tgid,
  CASE WHEN kind <> 'GroupVoiceUpdate' THEN u END AS uid, CASE kind WHEN 'GroupVoiceGrant' THEN 'group' WHEN 'GroupVoiceUpdate' THEN 'group_update' ELSE 'unit' END AS grant_type,
  COALESCE(emergency, FALSE) AS emergency, COALESCE(encrypted, FALSE) AS encrypted, ROUND(freq, 6) AS voice_freq
  FROM m JOIN freqs f ON f.id = m.id WHERE kind IN ('GroupVoiceGrant', 'GroupVoiceUpdate', 'UnitVoiceGrant'))"""


@query("src07_protocol_messages", "SELECT id, kind AS type, nac, talkgroup, src_unit, channel_id, channel_num, emergency, CASE WHEN kind = 'GroupVoiceUpdate' THEN 2 END AS n_updates FROM m", MSG_CTE)
def _(v):
    p = "payload."
    return parsed(v).select(
        "id", F.col(p + "type").alias("type"), "nac", p + "talkgroup", p + "src_unit", p + "channel_id", p + "channel_num", p + "emergency",
        F.when(F.col(p + "updates").isNotNull(), F.size(p + "updates")).alias("n_updates"),
    )


_etype = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, (e, _) in M.MESSAGE_EVENTS.items()) + " ELSE 'protocol.p25.cc_status' END"
_esev = "CASE kind " + " ".join(f"WHEN '{k}' THEN {s}" for k, (_, s) in M.MESSAGE_EVENTS.items()) + " ELSE 1 END"


@query(
    "prj10_message_events",
    f"""SELECT id, timestamp_ns, {_etype} AS event_type, {_esev} AS severity, 1 AS source, CASE WHEN kind LIKE '%VoiceGrant' THEN COALESCE(talkgroup, 0) ELSE talkgroup END AS talkgroup,
        CASE WHEN src_unit > 0 THEN src_unit END AS source_unit, NULL::DOUBLE AS freq_mhz, nac, encrypted,
        CASE WHEN kind LIKE '%VoiceGrant' THEN concat(kind, ' TG:', COALESCE(talkgroup, 0), ' UID:', u) WHEN kind = 'GroupVoiceUpdate' THEN 'GroupVoiceUpdate (2 channels)'
         WHEN kind IN ('UnitRegistration', 'UnitDeregistration') THEN concat(kind, ' UID:', u) WHEN kind = 'GroupAffiliation' THEN concat('Affiliation TG:', talkgroup, ' UID:', u)
         WHEN kind = 'DenyResponse' THEN concat('DenyResponse target UID:', u) WHEN kind = 'AdjacentSite' THEN 'AdjacentStatusBroadcast' WHEN kind = 'NetworkStatusBroadcast' THEN 'NetworkStatus WACN:0xBEE00 SYS:0x3CC'
         WHEN kind = 'RfssStatusBroadcast' THEN kind WHEN kind = 'ChannelParamsUpdate' THEN concat('ChannelParamsUpdate id:', k % 3) ELSE concat('TSBK ', kind) END AS body FROM m""",
    MSG_CTE,
)
def _(v):
    return M.message_events(parsed(v))


@query(
    "prj11_voice_events",
    """SELECT id, 'protocol.p25.voice' AS event_type, 1 AS severity, concat('P25 ', COALESCE(d, ''), ' TG:', COALESCE(tg, 0), ' UID:', source_unit % 5) AS body, freq_mhz, tg AS talkgroup, NULLIF(source_unit % 5, 0) AS source_unit,
        nac, encrypted, CASE WHEN d IS NOT NULL THEN concat('{"duid":"', d, '"}') END AS attributes FROM (SELECT *, CASE WHEN k % 6 <> 0 THEN COALESCE(duid, 'HDU') END AS d, CASE WHEN k % 9 <> 0 THEN talkgroup END AS tg FROM ev)""",
)
def _(v):
    k = F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 6 != 0, F.coalesce("duid", F.lit("HDU"))).alias("duid"), F.when(k % 9 != 0, F.col("talkgroup")).alias("talkgroup"),
        (F.col("source_unit") % 5).alias("source_unit"), "nac", "encrypted", "freq_mhz",
    ))
    raw = readers.parse_once(v.ev.select("id", body.alias("text")), "text", schemas.VOICE_METADATA)
    return M.voice_events(raw)


@query(
    "prj12_broadcast_events",
    """SELECT id, 'protocol.rds.update' AS event_type, 9 AS severity, freq_mhz, CASE WHEN ps <> '' AND rt <> '' THEN concat('RDS: ', trim(ps), ' — ', trim(rt)) WHEN ps <> '' THEN concat('RDS: ', trim(ps)) ELSE concat('RDS PI:', pi) END AS body,
        NULLIF(ps, '') AS ps, NULLIF(rt, '') AS rt FROM (SELECT id, freq_mhz, CASE WHEN k % 3 = 0 THEN '' ELSE concat(' STN', k, ' ') END AS ps, CASE WHEN k % 2 = 0 THEN '' ELSE concat('Now ', body) END AS rt, concat('C', source_unit) AS pi FROM ev)""",
)
def _(v):
    k = F.col("k")
    text = F.to_json(F.struct(
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" STN"), k, F.lit(" "))).alias("ps"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("Now "), F.col("body"))).alias("rt"), F.concat(F.lit("C"), F.col("source_unit")).alias("pi"), "freq_mhz",
    ))
    raw = readers.parse_once(v.ev.select("id", text.alias("text")), "text", schemas.BROADCAST_METADATA)
    from wavetrail.operators.filters import attribute

    e = M.broadcast_events(raw)
    return e.select("id", "event_type", "severity", "freq_mhz", "body", attribute("rds.ps").alias("ps"), attribute("rds.rt").alias("rt"))


_kinds = list(M.FINDING_EVENTS) + ["mystery"]
_kinds_sql = "[" + ", ".join(f"'{x}'" for x in _kinds) + "]"


@query(
    "prj13_finding_events",
    f"""SELECT id, finding, 2 AS source, CASE finding {' '.join(f"WHEN '{k}' THEN '{e}'" for k, (e, _) in M.FINDING_EVENTS.items())} ELSE 'sigex.anomaly.baseline' END AS event_type,
        CASE finding {' '.join(f"WHEN '{k}' THEN {s}" for k, (_, s) in M.FINDING_EVENTS.items())} ELSE 11 END AS severity FROM (SELECT id, {_kinds_sql}[CAST(k % 10 AS INTEGER) + 1] AS finding FROM ev)""",
)
def _(v):
    kind = F.element_at(F.array(*[F.lit(x) for x in _kinds]), (F.col("k") % 10 + 1).cast("int"))
    return M.finding_events(v.ev.select("id", kind.alias("finding")))


@query(
    "prj14_lifecycle_events",
    """SELECT id, event_type, 3 AS source, CASE event_type WHEN 'system.recording.start' THEN 9 WHEN 'system.recording.stop' THEN 9 WHEN 'system.site.enter' THEN 9 WHEN 'system.sdr.disconnect' THEN 13 WHEN 'system.gps.fix' THEN CASE WHEN b = 'none' THEN 13 ELSE 9 END ELSE 11 END AS severity,
        CASE event_type WHEN 'system.mode.change' THEN concat('Mode: ', a, ' → ', b) WHEN 'system.sdr.disconnect' THEN concat('SDR quarantined: ', a) WHEN 'system.recording.start' THEN concat('Recording started: id=', n, ' type=', a)
          WHEN 'system.recording.stop' THEN concat('Recording finalized: id=', n, ' ', printf('%.1f', x), 's ', m // 1024, 'KB') WHEN 'system.operation.start' THEN concat('Operation started: ', a, ' (id=', n, ', profile=', b, ')')
          WHEN 'system.site.enter' THEN concat('Entered site: ', a, ' (id=', n, ', session=', m, ')') WHEN 'system.gps.fix' THEN concat('GPS source changed: ', a, ' → ', b) END AS body
       FROM (SELECT id, ['system.mode.change', 'system.sdr.disconnect', 'system.recording.start', 'system.recording.stop', 'system.operation.start', 'system.site.enter', 'system.gps.fix'][CAST(k % 7 AS INTEGER) + 1] AS event_type,
         band AS a, CASE WHEN k % 3 = 0 THEN 'none' ELSE device_key END AS b, source_unit AS n, k*1000 AS m, -power AS x FROM ev)""",
)
def _(v):
    kinds = ["system.mode.change", "system.sdr.disconnect", "system.recording.start", "system.recording.stop", "system.operation.start", "system.site.enter", "system.gps.fix"]
    k = F.col("k")
    rows = v.ev.select(
        "id", F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 7 + 1).cast("int")).alias("kind"), F.col("band").alias("a"),
        F.when(k % 3 == 0, "none").otherwise(F.col("device_key")).alias("b"), F.col("source_unit").alias("n"), (k * 1000).alias("m"), (-F.col("power")).alias("x"),
    )
    return M.lifecycle_events(rows)


@query(
    "prj14b_clip_events",
    """SELECT id, CASE WHEN duid = 'TLC' THEN 'system.clip.end' ELSE 'system.clip.start' END AS event_type, 1 AS source, 9 AS severity, freq_mhz, talkgroup, source_unit, encrypted,
        concat('P25 TX ', CASE WHEN duid = 'TLC' THEN 'end' ELSE 'start' END, ': ', printf('%.4f', freq_mhz), ' MHz TG:', talkgroup, ' UID:', source_unit, CASE WHEN encrypted THEN ' [ENC]' ELSE '' END) AS body FROM ev WHERE duid IS NOT NULL""",
)
def _(v):
    return M.clip_events(v.ev.where(F.col("duid").isNotNull()).withColumn("ends", F.col("duid") == "TLC"))


# --- network tracking ------------------------------------------------------


@query("stm17_network_grants", "SELECT id, timestamp_ns, system, entry, tgid, uid, grant_type, emergency, encrypted, voice_freq FROM ngrants", MSG_CTE)
def _(v):
    g = M.network_grants(parsed(v), "SYS").withColumn("voice_freq", F.round("voice_freq", 6))
    return g.select("id", "timestamp_ns", "system", "entry", "tgid", "uid", "grant_type", "emergency", "encrypted", "voice_freq")


@query(
    "ups06_site_topology",
    """SELECT 'SYS' AS system, rfss AS rfss_id, site AS site_id, arg_max(wacn, (timestamp_ns, id)) FILTER (WHERE wacn IS NOT NULL) AS wacn, arg_max(system_id, (timestamp_ns, id)) FILTER (WHERE system_id IS NOT NULL) AS system_id,
        ROUND(arg_max(control, (timestamp_ns, id)) FILTER (WHERE control IS NOT NULL), 6) AS control, arg_max(alt_control, (timestamp_ns, id)) FILTER (WHERE alt_control IS NOT NULL) AS alt_control, COUNT(*) AS messages, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns
       FROM (SELECT m.*, CASE WHEN kind <> 'AltControlChannel' THEN (SELECT MAX(freq) FROM freqs f WHERE f.id = m.id) END AS control,
          CASE WHEN kind = 'AltControlChannel' THEN (SELECT string_agg(printf('%.4f', freq), ',' ORDER BY entry) FROM freqs f WHERE f.id = m.id AND freq IS NOT NULL) END AS alt_control
         FROM m WHERE kind IN ('NetworkStatusBroadcast', 'RfssStatusBroadcast', 'AdjacentSite', 'AltControlChannel')) GROUP BY 2, 3""",
    MSG_CTE,
)
def _(v):
    return M.network_sites(parsed(v), "SYS").withColumn("control", F.round("control", 6))


@query(
    "stm17b_network_affiliations",
    """SELECT id, timestamp_ns, 'SYS' AS system, src_unit AS uid, CASE WHEN kind = 'GroupAffiliation' THEN talkgroup ELSE 0 END AS tgid, CASE kind WHEN 'GroupAffiliation' THEN 'affiliation' WHEN 'UnitRegistration' THEN 'registration' ELSE 'deregistration' END AS response_type
       FROM m WHERE kind IN ('GroupAffiliation', 'UnitRegistration', 'UnitDeregistration')""",
    MSG_CTE,
)
def _(v):
    return M.network_affiliations(parsed(v), "SYS")


FIND_SQL = """SELECT id, timestamp_ns, CASE kind WHEN 'DenyResponse' THEN 'access_deny' ELSE 'network_event' END AS finding, src_unit AS uid, NULL::BIGINT AS tgid,
  CASE kind WHEN 'NetworkStatusBroadcast' THEN 'Network identified: WACN 0xBEE00 System 0x3CC' WHEN 'UnitRegistration' THEN concat('Unit ', u, ' registered on system 0x3CC') ELSE concat('Request denied for UID ', u) END AS summary
  FROM m WHERE kind IN ('NetworkStatusBroadcast', 'UnitRegistration', 'DenyResponse')
  UNION ALL SELECT id, timestamp_ns, 'emergency_grant', uid, tgid, concat('EMERGENCY grant: TG ', tgid, ' UID ', uid, ' freq ', COALESCE(printf('%.4f', voice_freq), '?'), 'MHz') FROM ngrants WHERE emergency"""


@query("stm17c_network_findings", FIND_SQL, MSG_CTE)
def _(v):
    return M.network_findings(parsed(v), "SYS")


# --- seeds -----------------------------------------------------------------


@query(
    "src04_frequency_list",
    "SELECT freq, concat('CH ', k) AS name, CASE WHEN k % 2 = 0 THEN 'PUBS' ELSE 'COMM' END AS cls, band, 'NFM' AS mode FROM (SELECT DISTINCT ON (band, k) k, band, freq_mhz AS freq FROM ev)",
)
def _(v):
    k = F.col("k")
    entry = F.struct(
        F.col("freq_mhz").alias("freq"), F.concat(F.lit("CH "), k).alias("name"), F.when(k % 2 == 0, "PUBS").otherwise("COMM").alias("cls"),
        F.col("band").alias("band"), F.lit("NFM").alias("mode"),
    )
    # One document per band; k takes a hundred values.
    docs = v.ev.select("band", "k", "freq_mhz").distinct().groupBy("band").agg(F.to_json(F.struct(F.collect_list(entry).alias("conventional"))).alias("value"))
    return readers.frequency_list(docs).select("freq", "name", "cls", "band", "mode")


SEED_CTE = """
sd AS (SELECT s_nationkey % 5 AS doc, s_suppkey % 20 AS site, MIN(s_suppkey % 3) AS rfss FROM supplier GROUP BY 1, 2)"""


def seed_documents(v):
    s = F.col("s_suppkey")
    site = F.struct(
        F.col("rfss"), F.col("site"), F.concat(F.lit("Site "), F.col("site")).alias("name"),
        F.array(851 + F.col("site") * 0.0125, 852 + F.col("site") * 0.0125).alias("control_channels"),
    )
    n = F.col("n_nationkey")
    tags = F.array(*[F.lit(x) for x in ("Law Dispatch", "Ops", "Fire Tac")])
    group = F.struct(
        n.alias("tgid"), F.col("n_name").alias("alpha_tag"), F.concat(F.lit("Dept "), n % 4).alias("department"),
        F.get(tags, (n % 3).cast("int")).alias("tag"), F.when(n % 4 == 0, "DE").otherwise("D").alias("mode"),
    )
    sites = (
        v.table("supplier").groupBy((F.col("s_nationkey") % 5).alias("doc"), (s % 20).alias("site")).agg(F.min(s % 3).alias("rfss"))
        .groupBy("doc").agg(F.collect_list(site).alias("sites"))
    )
    groups = v.table("nation").groupBy((n % 5).alias("doc")).agg(F.collect_list(group).alias("talkgroups"))
    doc = F.struct(F.concat(F.lit("NET-"), F.col("doc")).alias("system"), F.lit("0xBEE00").alias("wacn"), "sites", "talkgroups")
    return sites.join(groups, "doc").select(F.to_json(doc).alias("value"))


@query(
    "src05_network_seed_sites",
    """SELECT concat('NET-', doc) AS system, 781824 AS wacn, 972 AS system_id, rfss AS rfss_id, site AS site_id, concat('Site ', site) AS name, ROUND(851 + site*0.0125e0, 6) AS control_channel, ROUND(852 + site*0.0125e0, 6) AS alternate FROM sd WHERE site <> 0""",
    SEED_CTE,
)
def _(v):
    sites, _ = readers.network_seed(seed_documents(v))
    alt = F.get_json_object("alt_control", "$[0].freq_mhz").cast("double")
    return sites.withColumn("alternate", F.round(alt, 6)).withColumn("control_channel", F.round("control_channel", 6)).drop("alt_control")


@query(
    "src05b_network_seed_talkgroups",
    """SELECT concat('NET-', n % 5) AS system, n::BIGINT AS tgid, n_name AS name, concat('Dept ', n % 4) AS department, ['Law Dispatch', 'Ops', 'Fire Tac'][n % 3 + 1] AS tag, CASE WHEN n % 4 = 0 THEN 'encrypted' ELSE 'clear' END AS encrypted,
        CASE WHEN n % 3 = 1 THEN 'COMM' ELSE 'PUBS' END AS cls FROM (SELECT *, n_nationkey AS n FROM nation) WHERE n <> 0""",
)
def _(v):
    return readers.network_seed(seed_documents(v))[1]


# --- alert headers ---------------------------------------------------------

CODES = ["TOR", "SVR", "FFW", "RWT", "XYZ"]


def headers(v):
    k = F.col("k")
    loc = lambda d: F.concat(F.lit("041"), F.lpad(((k % 40) * 2 + d).cast("string"), 3, "0"))
    locs = F.concat_ws("-", loc(1), F.when(k % 3 == 0, "153011"), F.when(k % 4 == 0, "006037"), F.when(k % 5 == 0, "99"))
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (k % 5).cast("int"))
    dur = F.get(F.array(*[F.lit(c) for c in ("0030", "0115", "0600", "45")]), (k % 4).cast("int"))
    good = F.concat(
        F.lit("ZCZC-WXR-"), code, F.lit("-"), locs, F.lit("+"), dur, F.lit("-"), F.date_format("ts", "DDDHHmm"), F.lit("-KPDX/NWS-")
    )
    return v.ev.select("id", "timestamp_ns", "ts", "source_unit", "k", F.when(k % 17 == 0, "NOISE BURST").otherwise(good).alias("header"))


HEAD_CTE = """
h0 AS (SELECT *, ['TOR', 'SVR', 'FFW', 'RWT', 'XYZ'][CAST(k % 5 AS INTEGER) + 1] AS code, ['0030', '0115', '0600', '45'][CAST(k % 4 AS INTEGER) + 1] AS dur,
   concat('041', lpad(((k % 40)*2 + 1)::VARCHAR, 3, '0')) AS l1, CASE WHEN k % 3 = 0 THEN '153011' END AS l2, CASE WHEN k % 4 = 0 THEN '006037' END AS l3, CASE WHEN k % 5 = 0 THEN '99' END AS l4,
   lpad(dayofyear(ts)::VARCHAR, 3, '0') AS jjj FROM ev),
hd AS (SELECT *, [x FOR x IN [l1, l2, l3] IF x IS NOT NULL] AS locs, ['30', '75', '360', '0'][CAST(k % 4 AS INTEGER) + 1]::INTEGER AS mins FROM h0 WHERE k % 17 <> 0)"""


@query(
    "scl14_alert_headers",
    """SELECT id, 'WXR' AS originator, code AS event_code, list_aggregate(locs, 'string_agg', ',') AS locations, mins AS duration_mins, concat('J', jjj, ' ', strftime(ts, '%H:%M'), 'Z') AS issued_utc, 'KPDX/NWS' AS station FROM hd""",
    HEAD_CTE,
)
def _(v):
    d = W.decode_headers(headers(v))
    return d.select("id", "originator", "event_code", F.array_join("locations", ",").alias("locations"), "duration_mins", "issued_utc", "station")


@query(
    "scl15_header_vote",
    """SELECT alert_id, arg_max(header, (votes, -first)) AS header, MAX(votes) AS votes FROM (SELECT alert_id, header, COUNT(*) AS votes, MIN(j) AS first FROM reps GROUP BY 1, 2) GROUP BY 1""",
    "reps AS (SELECT id AS alert_id, j, concat('ZCZC-WXR-', CASE (k + j*(k % 5)) % 3 WHEN 0 THEN 'TOR' WHEN 1 THEN 'SVR' ELSE 'FFW' END, '-041051') AS header FROM ev, range(3) r(j))",
)
def _(v):
    k = F.col("k")
    reps = v.ev.select(F.col("id").alias("alert_id"), "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    pick = (k + F.col("j") * (k % 5)) % 3
    code = F.when(pick == 0, "TOR").when(pick == 1, "SVR").otherwise("FFW")
    return W.vote(reps.select("alert_id", "j", F.concat(F.lit("ZCZC-WXR-"), code, F.lit("-041051")).alias("header")), "alert_id", "header", "j")


COUNTY_CTE = ref.sql_values(ref.COUNTIES, "area, county, state", "counties") + "," + ref.sql_values(ref.ALERT_CODES, "code, name, severity", "codes")


@query(
    "scl16_code_county_lookup",
    """SELECT id, event_code, COALESCE(c.name, 'Unknown Event') AS event_name, COALESCE(c.severity, 'Info') AS alert_severity, l AS code,
        COALESCE(n.county, CASE WHEN l[2:3] IN ('41', '53', '06', '16') THEN 'Unknown County' ELSE 'Unknown' END) AS county, CASE l[2:3] WHEN '41' THEN 'OR' WHEN '53' THEN 'WA' WHEN '06' THEN 'CA' WHEN '16' THEN 'ID' ELSE '??' END AS state
       FROM (SELECT id, code AS event_code, unnest(locs) AS l FROM hd) LEFT JOIN codes c ON c.code = event_code LEFT JOIN counties n ON n.area = l[2:6]""",
    HEAD_CTE + "," + COUNTY_CTE,
)
def _(v):
    named = W.name_codes(W.decode_headers(headers(v)))
    rows = named.select("id", "event_code", "event_name", "alert_severity", F.explode("locations").alias("l"))
    return rows.select("id", "event_code", "event_name", "alert_severity", W.county(F.col("l")).alias("c")).select("id", "event_code", "event_name", "alert_severity", "c.*")


@query(
    "scl17_active_alerts",
    "SELECT id, event_code, expires_ns FROM (SELECT id, code AS event_code, CASE WHEN mins > 0 THEN timestamp_ns + mins*60000000000 END AS expires_ns, timestamp_ns FROM hd) WHERE expires_ns IS NULL OR expires_ns >= 1706572800000000000 ORDER BY timestamp_ns DESC, id DESC LIMIT 200",
    HEAD_CTE,
)
def _(v):
    d = W.decode_headers(headers(v))
    ends = F.when(F.col("duration_mins") > 0, F.col("timestamp_ns") + F.col("duration_mins").cast("long") * 60000000000)
    live = W.active(d.withColumn("expires_at", ends), F.lit(1706572800000000000))
    return live.orderBy(F.desc("timestamp_ns"), F.desc("id")).limit(200).select("id", "event_code", F.col("expires_at").alias("expires_ns"))
