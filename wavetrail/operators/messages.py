"""Protocol, voice, broadcast and lifecycle messages turned into events and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.functions import scalars as S
from wavetrail.operators.joins import asof_backward
from wavetrail.sources.work import stored

P = "payload."

# Message type -> (event type, severity). Decoder and report spellings both occur.
MESSAGE_EVENTS = {
    "GroupVoiceGrant": ("protocol.p25.grant", 9),
    "UnitVoiceGrant": ("protocol.p25.grant", 9),
    "GroupVoiceUpdate": ("protocol.p25.update", 5),
    "UnitRegistrationResponse": ("protocol.p25.register", 11),
    "UnitRegistration": ("protocol.p25.register", 11),
    "UnitDeregistration": ("protocol.p25.deregister", 11),
    "GroupAffiliationResponse": ("protocol.p25.affiliation", 5),
    "GroupAffiliation": ("protocol.p25.affiliation", 5),
    "DenyResponse": ("protocol.p25.deny", 13),
    "AdjacentStatusBroadcast": ("protocol.p25.adjacent", 5),
    "AdjacentSite": ("protocol.p25.adjacent", 5),
    "NetworkStatusBroadcast": ("protocol.p25.net_status", 5),
    "RfssStatusBroadcast": ("protocol.p25.rfss_status", 5),
    "ChannelParamsUpdate": ("protocol.p25.chan_params", 5),
}
# Finding -> (event type, severity).
FINDING_EVENTS = {
    "new_emitter": ("sigex.emitter.new", 11),
    "emitter_reappearance": ("sigex.emitter.return", 11),
    "uid_fp_mismatch": ("sigex.uid.mismatch", 13),
    "traffic_session": ("sigex.traffic.session", 9),
    "crypto_rotation": ("sigex.crypto.rotation", 13),
    "new_uid": ("sigex.protocol.new_uid", 11),
    "emergency_grant": ("sigex.network.emergency", 13),
    "access_deny": ("sigex.network.deny", 11),
    "network_event": ("sigex.network.event", 11),
}


def _text(value: Column, default: int = 0) -> Column:
    return F.coalesce(value, F.lit(default)).cast("string")


def _hex(value: Column, width: int = 0) -> Column:
    digits = F.hex(F.coalesce(value, F.lit(0).cast("long")))
    return F.lpad(digits, width, "0") if width else digits


def message_events(parsed: DataFrame) -> DataFrame:
    """One event per protocol message; unknown types are kept as status events."""
    kind = F.col(P + "type")
    uid = F.coalesce(P + "source", P + "src_unit")
    tg = F.col(P + "talkgroup")
    grant = kind.isin("GroupVoiceGrant", "UnitVoiceGrant")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = (
        F.when(grant, cat(kind, " TG:", _text(tg), " UID:", _text(uid)))
        .when(kind == "GroupVoiceUpdate", cat("GroupVoiceUpdate (", F.coalesce(F.size(P + "updates"), F.lit(0)).cast("string"), " channels)"))
        .when(kind.startswith("UnitRegistration"), cat("UnitRegistration UID:", _text(uid)))
        .when(kind == "UnitDeregistration", cat("UnitDeregistration UID:", _text(uid)))
        .when(kind.startswith("GroupAffiliation"), cat("Affiliation TG:", _text(tg), " UID:", _text(uid)))
        .when(kind == "DenyResponse", cat("DenyResponse target UID:", _text(F.coalesce(F.col(P + "target"), uid))))
        .when(kind.isin("AdjacentStatusBroadcast", "AdjacentSite"), F.lit("AdjacentStatusBroadcast"))
        .when(
            kind == "NetworkStatusBroadcast",
            cat("NetworkStatus WACN:0x", _hex(F.col(P + "wacn")), " SYS:0x", _hex(F.coalesce(P + "system_id", P + "system"))),
        )
        .when(kind == "RfssStatusBroadcast", F.lit("RfssStatusBroadcast"))
        .when(kind == "ChannelParamsUpdate", cat("ChannelParamsUpdate id:", _text(F.col(P + "id"))))
        .otherwise(cat("TSBK ", kind))
    )
    event_type = F.coalesce(S.lookup([(k, e) for k, (e, _) in MESSAGE_EVENTS.items()], kind), F.lit("protocol.p25.cc_status"))
    severity = F.coalesce(S.lookup([(k, s) for k, (_, s) in MESSAGE_EVENTS.items()], kind), F.lit(1))
    return parsed.where(kind.isNotNull()).select(
        "id", "timestamp_ns", event_type.alias("event_type"), severity.alias("severity"), F.lit(1).alias("source"), body.alias("body"),
        F.when(grant, F.coalesce(tg, F.lit(0))).otherwise(tg).alias("talkgroup"),
        F.when(uid > 0, uid).alias("source_unit"), F.col(P + "voice_freq").alias("freq_mhz"), "nac", F.col(P + "encrypted").alias("encrypted"),
    )


def voice_events(voice: DataFrame) -> DataFrame:
    """Voice metadata; the data unit is kept as an attribute, uid 0 means none."""
    body = F.concat(F.lit("P25 "), F.coalesce("duid", F.lit("")), F.lit(" TG:"), _text(F.col("talkgroup")), F.lit(" UID:"), _text(F.col("source_unit")))
    return voice.select(
        "id", F.lit("protocol.p25.voice").alias("event_type"), F.lit(1).alias("severity"), body.alias("body"), "freq_mhz", "talkgroup",
        F.nullif("source_unit", F.lit(0).cast("long")).alias("source_unit"), "nac", "encrypted",
        F.when(F.col("duid") != "", F.to_json(F.struct("duid"))).alias("attributes"),
    )


def broadcast_events(meta: DataFrame) -> DataFrame:
    """Broadcast station metadata: name and text in the body and as attributes."""
    ps, rt, pi = (F.coalesce(c, F.lit("")) for c in ("ps", "rt", "pi"))
    body = (
        F.when((ps != "") & (rt != ""), F.concat(F.lit("RDS: "), F.trim(ps), F.lit(" — "), F.trim(rt)))
        .when(ps != "", F.concat(F.lit("RDS: "), F.trim(ps)))
        .otherwise(F.concat(F.lit("RDS PI:"), pi))
    )
    given = F.struct(*[F.nullif(c, F.lit("")).alias(f"rds.{n}") for c, n in ((ps, "ps"), (rt, "rt"), (pi, "pi"))])
    return meta.select(
        "id", F.lit("protocol.rds.update").alias("event_type"), F.lit(9).alias("severity"), body.alias("body"), "freq_mhz",
        F.to_json(given).alias("attributes"),
    )


def finding_events(findings: DataFrame) -> DataFrame:
    """Analysis findings as events; unknown kinds count as baseline anomalies."""
    kind = F.col("finding")
    event_type = F.coalesce(S.lookup([(k, e) for k, (e, _) in FINDING_EVENTS.items()], kind), F.lit("sigex.anomaly.baseline"))
    severity = F.coalesce(S.lookup([(k, s) for k, (_, s) in FINDING_EVENTS.items()], kind), F.lit(11))
    return findings.withColumn("event_type", event_type).withColumn("severity", severity).withColumn("source", F.lit(2))


def lifecycle_events(rows: DataFrame) -> DataFrame:
    """System records: ``kind`` selects the event, its severity and wording."""
    k = F.col("kind")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    a, b, n, m = F.col("a"), F.col("b"), F.col("n"), F.col("m")
    # Wording of the records.
    wording = {
        "system.mode.change": (11, cat("Mode: ", a, " → ", b)),
        "system.sdr.connect": (11, cat("SDR connected: ", a, " (", b, ")")),
        "system.sdr.disconnect": (13, cat("SDR quarantined: ", a)),
        "system.recording.start": (9, cat("Recording started: id=", n, " type=", a)),
        "system.recording.stop": (
            9, cat("Recording finalized: id=", n, " ", S.fixed(F.col("x"), 1), "s ", F.expr("m div 1024"), "KB"),
        ),
        "system.operation.start": (11, cat("Operation started: ", a, " (id=", n, ", profile=", b, ")")),
        "system.operation.stop": (11, cat("Operation stopped: ", a, " (id=", n, ")")),
        "system.site.enter": (9, cat("Entered site: ", a, " (id=", n, ", session=", m, ")")),
        "system.site.exit": (9, cat("Exited site: ", a, " (id=", n, ", session=", m, ")")),
        "system.gps.fix": (None, cat("GPS source changed: ", a, " → ", b)),
    }
    body, severity = F.lit(None).cast("string"), F.lit(9)
    for kind, (level, text) in wording.items():
        body = F.when(k == kind, text).otherwise(body)
        level = F.lit(level) if level is not None else F.when(b == "none", 13).otherwise(9)
        severity = F.when(k == kind, level).otherwise(severity)
    return rows.select("id", k.alias("event_type"), F.lit(3).alias("source"), severity.alias("severity"), body.alias("body"))


def clip_events(rows: DataFrame) -> DataFrame:
    """Start and end of a recorded transmission (``ends`` tells which)."""
    word = F.when(F.col("ends"), "end").otherwise("start")
    body = F.concat(
        F.lit("P25 TX "), word, F.lit(": "), S.fixed(F.col("freq_mhz"), 4), F.lit(" MHz TG:"), _text(F.col("talkgroup")), F.lit(" UID:"),
        _text(F.col("source_unit")), F.when(F.col("encrypted"), " [ENC]").otherwise(""),
    )
    return rows.select(
        "id", F.concat(F.lit("system.clip."), word).alias("event_type"), F.lit(1).alias("source"), F.lit(9).alias("severity"), body.alias("body"),
        "freq_mhz", "talkgroup", "source_unit", "encrypted",
    )


# --- network tracking ------------------------------------------------------


def channel_parameters(parsed: DataFrame, extra: list[str] = []) -> DataFrame:
    """Channel plan announcements (ids 0 to 15)."""
    return parsed.where((F.col(P + "type") == "ChannelParamsUpdate") & (F.col(P + "id") < 16)).select(
        *extra, "id", "timestamp_ns", F.col(P + "id").alias("channel_id"), F.col(P + "base_freq_hz").alias("base_hz"),
        F.col(P + "spacing_hz").alias("spacing_hz"),
    )


def resolve_channels(rows: DataFrame, parameters: DataFrame, width: int = 3600 * 10**9) -> DataFrame:
    """Frequency of (channel_id, channel_num) by the latest plan before the row."""
    found = asof_backward(rows, parameters, ["channel_id"], "timestamp_ns", ["base_hz", "spacing_hz"], width)
    hz = F.col("match.base_hz") + F.col("match.spacing_hz") * F.col("channel_num")
    return found.withColumn("freq_mhz", hz / F.lit(1e6)).drop("match")


def grant_entries(parsed: DataFrame, system: str, extra: list[str] = []) -> DataFrame:
    """Voice grants of groups, group updates and units with their channel."""
    kind = F.col(P + "type")
    one = lambda tg, uid, label, emergency, enc: F.array(
        F.struct(
            tg.alias("tgid"), uid.alias("uid"), F.col(P + "channel_id").alias("channel_id"), F.col(P + "channel_num").alias("channel_num"),
            F.lit(label).alias("grant_type"), emergency.alias("emergency"), enc.alias("encrypted"),
        )
    )
    none, no = F.lit(None).cast("long"), F.lit(False)
    updates = F.transform(
        P + "updates",
        lambda u: F.struct(
            u["talkgroup"].alias("tgid"), none.alias("uid"), u["channel_id"].alias("channel_id"), u["channel_num"].alias("channel_num"),
            F.lit("group_update").alias("grant_type"), no.alias("emergency"), no.alias("encrypted"),
        ),
    )
    group = one(F.col(P + "talkgroup"), F.col(P + "src_unit"), "group", F.col(P + "emergency"), F.col(P + "encrypted"))
    unit = one(F.lit(0).cast("long"), F.col(P + "src_unit"), "unit", no, no)
    entries = F.when(kind == "GroupVoiceGrant", group).when(kind == "GroupVoiceUpdate", updates).when(kind == "UnitVoiceGrant", unit)
    return parsed.where(kind.isin(*GRANTS)).select(
        *extra, "id", "timestamp_ns", F.lit(system).alias("system"), F.posexplode(entries).alias("entry", "g")
    ).select(*extra, "id", "timestamp_ns", "system", "entry", "g.*")


PLAN = "ChannelParamsUpdate"
GRANTS = ["GroupVoiceGrant", "GroupVoiceUpdate", "UnitVoiceGrant"]
STATUS = ["NetworkStatusBroadcast", "RfssStatusBroadcast", "AdjacentSite", "AltControlChannel"]
TELLING = ["NetworkStatusBroadcast", "UnitRegistration", "DenyResponse"]


def _kept(parsed: DataFrame, kinds: list[str], name: str) -> DataFrame:
    """The messages of some kinds, stored: what follows reads them several times, and parsing is the dearest part of it."""
    return stored(parsed.where(F.col(P + "type").isin(*kinds)), name)


def network_grants(parsed: DataFrame, system: str) -> DataFrame:
    """Voice grants with their frequency."""
    parsed = _kept(parsed, [*GRANTS, PLAN], "grants")
    return resolve_channels(grant_entries(parsed, system), channel_parameters(parsed)).withColumnRenamed("freq_mhz", "voice_freq")


def network_sites(parsed: DataFrame, system: str) -> DataFrame:
    """Latest known attributes of every site, from four kinds of message."""
    parsed = _kept(parsed, [*STATUS, PLAN], "sites")
    kind = F.col(P + "type")
    alts = F.coalesce(F.col(P + "channels"), F.array().cast("array<struct<channel_id: bigint, channel_num: bigint, talkgroup: bigint>>"))
    main = F.array(F.struct(F.col(P + "channel_id").alias("channel_id"), F.col(P + "channel_num").alias("channel_num"), F.lit(None).cast("int").alias("alt")))
    listed = F.transform(alts, lambda c, i: F.struct(c["channel_id"].alias("channel_id"), c["channel_num"].alias("channel_num"), i.alias("alt")))
    rows = parsed.where(kind.isin(*STATUS)).select(
        "id", "timestamp_ns", F.lit(system).alias("system"), F.col(P + "rfss").alias("rfss_id"), F.col(P + "site").alias("site_id"),
        F.col(P + "wacn").alias("wacn"), F.col(P + "system").alias("system_id"),
        F.explode(F.when(kind == "AltControlChannel", listed).otherwise(main)).alias("c"),
    ).select("id", "timestamp_ns", "system", "rfss_id", "site_id", "wacn", "system_id", "c.*")
    placed = stored(resolve_channels(rows, channel_parameters(parsed)), "placed")
    order = F.struct("timestamp_ns", "id")
    keys = ["system", "rfss_id", "site_id"]
    main = F.col("alt").isNull()
    latest = lambda c, given: F.max_by(c, F.when(given & F.col(c).isNotNull(), order))
    sites = placed.groupBy(*keys).agg(
        latest("wacn", F.lit(True)).alias("wacn"), latest("system_id", F.lit(True)).alias("system_id"),
        latest("freq_mhz", main).alias("control"), F.count(F.when(main | (F.col("alt") == 0), 1)).alias("messages"),
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )
    # Only messages that list alternates are put together again; a list is one message long.
    listed_freqs = F.array_sort(F.collect_list(F.struct("alt", "freq_mhz")))
    alternates = (
        placed.where(F.col("alt").isNotNull() & F.col("freq_mhz").isNotNull()).groupBy(*keys, "timestamp_ns", "id")
        .agg(F.concat_ws(",", F.transform(listed_freqs, lambda s: S.fixed(s["freq_mhz"], 4))).alias("alt_control"))
        .groupBy(*keys).agg(F.max_by("alt_control", order).alias("alt_control"))
    )
    return sites.join(alternates, keys, "left")


def network_affiliations(parsed: DataFrame, system: str) -> DataFrame:
    kind = F.col(P + "type")
    what = F.when(kind == "GroupAffiliation", "affiliation").when(kind == "UnitRegistration", "registration").when(kind == "UnitDeregistration", "deregistration")
    return parsed.where(what.isNotNull()).select(
        "id", "timestamp_ns", F.lit(system).alias("system"), F.col(P + "src_unit").alias("uid"),
        F.when(kind == "GroupAffiliation", F.col(P + "talkgroup")).otherwise(F.lit(0)).alias("tgid"), what.alias("response_type"),
    )


def emergency_text() -> Column:
    freq = F.coalesce(S.fixed(F.col("voice_freq"), 4), F.lit("?"))
    return F.concat(F.lit("EMERGENCY grant: TG "), F.col("tgid"), F.lit(" UID "), F.col("uid"), F.lit(" freq "), freq, F.lit("MHz"))


def session_text(duration_sec: Column, avg_signal: Column) -> Column:
    """What the finding of a traffic session says."""
    return F.concat(
        F.lit("Session on "), "freq_key", F.lit(" MHz — "), F.col("hit_count"), F.lit(" hits, "), S.fixed(duration_sec, 1), F.lit("s, avg "),
        S.fixed(avg_signal, 0), F.lit(" dB"),
    )


def message_findings(parsed: DataFrame, extra: list[str] = []) -> DataFrame:
    """Findings that one message tells: identity, registrations, denials."""
    kind, uid = F.col(P + "type"), F.col(P + "src_unit")
    text = (
        F.when(
            kind == "NetworkStatusBroadcast",
            F.concat(F.lit("Network identified: WACN 0x"), _hex(F.col(P + "wacn"), 5), F.lit(" System 0x"), _hex(F.col(P + "system"), 3)),
        )
        .when(kind == "UnitRegistration", F.concat(F.lit("Unit "), uid, F.lit(" registered on system 0x"), _hex(F.col(P + "system"), 3)))
        .when(kind == "DenyResponse", F.concat(F.lit("Request denied for UID "), uid))
    )
    finding = (
        F.when(kind == "NetworkStatusBroadcast", "network_event").when(kind == "UnitRegistration", "network_event").when(kind == "DenyResponse", "access_deny")
    )
    return parsed.where(finding.isNotNull()).select(*extra, "id", "timestamp_ns", finding.alias("finding"), uid.alias("uid"), F.lit(None).cast("long").alias("tgid"), text.alias("summary"))


def network_findings(parsed: DataFrame, system: str) -> DataFrame:
    """Findings the tracker reports: identity, emergencies, registrations, denials."""
    urgent = network_grants(parsed, system).where(F.col("emergency"))
    alarm = urgent.select("id", "timestamp_ns", F.lit("emergency_grant").alias("finding"), "uid", "tgid", emergency_text().alias("summary"))
    return message_findings(parsed).unionByName(alarm)
