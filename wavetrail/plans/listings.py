"""Listings with optional filters, and newest-first pages of derived tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetrail.operators import history as H
from wavetrail.operators.filters import apply_optional
from wavetrail.operators.query import newest
from wavetrail.plans.emitters import FPC_CTE, catalogue
from wavetrail.plans.history import DAY_NS, ROT_CTE, sessions_cte, sessions_of, traces_cte
from wavetrail.plans.registry import query
from wavetrail.sources.bindings import EPOCH_S

SINCE_NS = (EPOCH_S + 20 * 86400) * 10**9


@query("flt19b_channel_listing", "SELECT channel_id, channel_freq, label, channel_cls FROM channels WHERE channel_cls = 'PUBS' AND channel_freq >= 150.1")
def _(v):
    return apply_optional(v.channels, channel_cls="PUBS", label=None, channel_freq__ge=150.1).select("channel_id", "channel_freq", "label", "channel_cls")


@query("flt19c_signal_listing", "SELECT id, freq_mhz, band, classification FROM hits WHERE band = 'UHF' AND classification = 'FEDL'")
def _(v):
    return apply_optional(v.hits, band="UHF", classification="FEDL").select("id", "freq_mhz", "band", "classification")


@query("flt19d_finding_listing", f"SELECT id, event_type, severity, timestamp_ns FROM ev WHERE event_type = 'sigex.emitter.new' AND severity >= 9 AND timestamp_ns >= {SINCE_NS}")
def _(v):
    found = apply_optional(v.ev, event_type="sigex.emitter.new", severity__ge=9, timestamp_ns__ge=SINCE_NS)
    return found.select("id", "event_type", "severity", "timestamp_ns")


@query("flt19e_key_rotation_listing", "SELECT id, tgid, old_key_id, new_key_id, timestamp_ns FROM rotations WHERE system = 'SYS' AND tgid = 1004", ROT_CTE)
def _(v):
    return apply_optional(H.key_rotations(v.crypto), system="SYS", tgid=1004).select("id", "tgid", "old_key_id", "new_key_id", "timestamp_ns")


@query("flt19f_equal_or_unset", "SELECT id, tgid, key_id FROM crypto WHERE key_id = 3 OR key_id IS NULL")
def _(v):
    return apply_optional(v.crypto, key_id__or_unset=3).select("id", "tgid", "key_id")


@query("ord08b_newest_traffic_sessions", "SELECT freq_key, channel_id, start_ns, last_ns, hit_count FROM sessions ORDER BY start_ns DESC, freq_key DESC LIMIT 50", sessions_cte())
def _(v):
    return newest(sessions_of(v), "start_ns", 50, "freq_key").select("freq_key", "channel_id", "start_ns", "last_ns", "hit_count")


@query("ord08c_newest_traces", "SELECT trace_id, start_ns, last_event_ns, event_count FROM traces ORDER BY start_ns DESC, trace_id DESC LIMIT 50", traces_cte())
def _(v):
    traces = H.trace_sessions(H.assign_traces(v.ev.where(F.col("event_type").startswith("protocol.p25.")), DAY_NS))
    return newest(traces, "start_ns", 50, "trace_id").select("trace_id", "start_ns", "last_event_ns", "event_count")


@query("ord08d_newest_iq_recordings", "SELECT id, tgid, start_time FROM rec WHERE rec_type = 'iq' ORDER BY start_time DESC, id DESC, tgid DESC LIMIT 50")
def _(v):
    page = v.rec.where(F.col("rec_type") == "iq").orderBy(F.desc("start_time"), F.desc("id"), F.desc("tgid")).limit(50)
    return page.select("id", "tgid", "start_time")


@query(
    "joi12b_nearest_fingerprints",
    """SELECT probe, fingerprint_id, ROUND(d, 6) AS distance FROM (SELECT p.probe, f.fingerprint_id, d, row_number() OVER (PARTITION BY p.probe ORDER BY d, f.fingerprint_id) AS rk FROM (
         SELECT probe, fingerprint_id, abs(cfo_hz - cfo) + abs(iq_amplitude_imbal - iqa) AS d, cfo_hz, cfo, iq_amplitude_imbal, iqa FROM fpcat f,
           (SELECT label AS probe, ROUND(AVG(100*embedding[1]::DOUBLE), 4) AS cfo, ROUND(AVG(abs(embedding[2]::DOUBLE)), 4) AS iqa FROM embeddings GROUP BY 1)) AS f, LATERAL (SELECT f.probe AS probe) p
       WHERE abs(cfo_hz - cfo) < 10 AND abs(iq_amplitude_imbal - iqa) < 10) WHERE rk <= 20""",
    FPC_CTE,
)
def _(v):
    """Of the fingerprints within a tolerance in both measures, the 20 of least total distance."""
    e, tolerance = F.col("embedding"), 10.0
    probes = v.table("embeddings").groupBy(F.col("label").alias("probe")).agg(
        F.round(F.avg(100 * F.get(e, F.lit(0)).cast("double")), 4).alias("cfo"),
        F.round(F.avg(F.abs(F.get(e, F.lit(1)).cast("double"))), 4).alias("iqa"),
    )
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    grid = probes.withColumn("_x", F.explode(F.array(cell("cfo") - 1, cell("cfo"), cell("cfo") + 1)))
    near = grid.join(catalogue(v).withColumn("_x", cell("cfo_hz")), "_x").where(
        (F.abs(F.col("cfo_hz") - F.col("cfo")) < tolerance) & (F.abs(F.col("iq_amplitude_imbal") - F.col("iqa")) < tolerance)
    )
    distance = F.abs(F.col("cfo_hz") - F.col("cfo")) + F.abs(F.col("iq_amplitude_imbal") - F.col("iqa"))
    ranked = near.withColumn("_d", distance).withColumn("rk", F.row_number().over(Window.partitionBy("probe").orderBy("_d", "fingerprint_id")))
    return ranked.where(F.col("rk") <= 20).select("probe", "fingerprint_id", F.round("_d", 6).alias("distance"))


@query(
    "joi02b_channel_history",
    "SELECT h.id, h.power, h.timestamp_ns FROM hits h JOIN (SELECT DISTINCT freq_mhz, channel_id FROM hits) s ON s.freq_mhz = h.freq_mhz AND s.channel_id = h.channel_id WHERE s.channel_id = 7 ORDER BY h.id DESC LIMIT 100",
)
def _(v):
    """Hits of one channel through the signals that belong to it, newest first."""
    signals = v.hits.select("freq_mhz", "channel_id").distinct().where(F.col("channel_id") == 7)
    return v.hits.join(signals, ["freq_mhz", "channel_id"]).orderBy(F.desc("id")).limit(100).select("id", "power", "timestamp_ns")
