"""Channels, fingerprints, emitters, pulses, recordings and observation targets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.functions import scalars as S
from wavetrail.operators import emitters as E
from wavetrail.operators import history as H
from wavetrail.operators.counters import counters, rows, tally
from wavetrail.operators.filters import apply_optional
from wavetrail.operators.joins import asof_backward, first_in_catalogue, nearest_in_catalogue
from wavetrail.operators.ordered import gap_sessions
from wavetrail.operators.spacing import spaced_rows
from wavetrail.plans.history import DAY_NS
from wavetrail.plans.registry import query
from wavetrail.sources.bindings import AS_OF, AS_OF_NS, EPOCH_S, REC_AS_OF, ts_lit
from wavetrail.sources.work import stored

NOW = f"TIMESTAMP '{AS_OF}'"
CFO_BUCKET, RESOLUTION = 50.0, 0.05
LIB_CTE = ref.sql_values(ref.EMITTERS, "ref_id, name, emitter_type, f_min, f_max, pri_min, pri_max, pw_min, pw_max", "lib")
SIG_CTE = ref.sql_values(
    [(o, m, n, bw, lo, hi) for o, m, n, spans, bw in ref.DRONES for lo, hi in spans], "sig_order, manufacturer, model, sig_bw, lo, hi", "sig"
)
BAND_CTE = ref.sql_values(ref.BANDS, "band_key, band_start, band_end, band_label", "bandlist")

REPEATER_SQL = " OR ".join(f"f BETWEEN {a}e0 AND {b}e0" for a, b in ref.REPEATER_RANGES)

# --- channel lookups -------------------------------------------------------


@query(
    "joi07_nearest_channel",
    """SELECT id, freq_mhz, channel_id, label FROM (SELECT e.id, e.freq_mhz, c.channel_id, c.label, row_number() OVER (PARTITION BY e.id ORDER BY abs(c.channel_freq - e.freq_mhz), c.channel_id) AS rk
        FROM (SELECT id, ROUND(149.98 + k*0.006e0, 4) AS freq_mhz FROM ev) e LEFT JOIN channels c ON abs(c.channel_freq - e.freq_mhz) < 0.015e0) WHERE rk = 1""",
)
def _(v):
    e = v.ev.select("id", F.round(149.98 + F.col("k") * 0.006, 4).alias("freq_mhz"))
    return nearest_in_catalogue(e, "freq_mhz", v.channels, "channel_freq", ["channel_id", "label"], 0.015).drop("channel_freq")


@query(
    "scl12_frequency_label",
    f"""SELECT id, COALESCE(label, CASE WHEN {REPEATER_SQL} THEN concat('Repeater ', printf('%.4f', f)) ELSE 'Unknown' END) AS name FROM (
        SELECT e.id, e.f, c.label, row_number() OVER (PARTITION BY e.id ORDER BY c.channel_id) AS rk FROM (SELECT id, ROUND(145 + k*0.0601e0, 4) AS f FROM ev) e LEFT JOIN channels c ON abs(c.channel_freq - e.f) < 0.015e0) WHERE rk = 1""",
)
def _(v):
    e = v.ev.select("id", F.round(145 + F.col("k") * 0.0601, 4).alias("f"))
    named = first_in_catalogue(e, "f", v.channels, "channel_freq", ["channel_id", "label"], 0.015)
    rptr = F.when(S.is_repeater(F.col("f")), F.concat(F.lit("Repeater "), S.fixed(F.col("f"), 4))).otherwise("Unknown")
    return named.select("id", F.coalesce("label", rptr).alias("name"))


@query(
    "scl13_band_definitions",
    "SELECT id, f, band_key, band_label FROM (SELECT id, ROUND(k*8.63e0, 3) AS f FROM ev) JOIN bandlist ON f BETWEEN band_start AND band_end",
    BAND_CTE,
)
def _(v):
    rows_ = v.ev.select("id", F.round(F.col("k") * 8.63, 3).alias("f"))
    return S.bands_of(rows_, v.spark, "f").select("id", "f", "band_key", "band_label")


STAT_CTE = """
near AS (SELECT h.*, c.channel_id AS ch, c.label, row_number() OVER (PARTITION BY h.id ORDER BY abs(c.channel_freq - f), c.channel_id) AS rk
  FROM (SELECT *, ROUND(freq_mhz + 0.1e0*(k % 7), 4) AS f FROM hits) h LEFT JOIN channels c ON abs(c.channel_freq - f) < 0.015e0)"""


@query(
    "ups02_channel_statistics",
    """SELECT COALESCE(label, concat('Unknown ', printf('%.3f', f))) AS label, CASE WHEN label IS NULL THEN 'discovered' ELSE 'catalogue' END AS source, COUNT(*) AS total_hits,
        ROUND(AVG(power), 9) AS avg_power, arg_max(power, (timestamp_ns, id)) AS last_power, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns,
        MIN(timestamp_ns) >= 1706400000000000000 AS new_in_window FROM near WHERE rk = 1 GROUP BY 1, 2""",
    STAT_CTE,
)
def _(v):
    hits = v.hits.withColumn("f", F.round(F.col("freq_mhz") + 0.1 * (F.col("k") % 7), 4)).drop("channel_id")
    near = nearest_in_catalogue(hits, "f", v.channels, "channel_freq", ["channel_id", "label"], 0.015)
    label = F.coalesce("label", F.concat(F.lit("Unknown "), S.fixed(F.col("f"), 3)))
    source = F.when(F.col("label").isNull(), "discovered").otherwise("catalogue")
    return near.groupBy(label.alias("label"), source.alias("source")).agg(
        rows().alias("total_hits"), F.round(F.avg("power"), 9).alias("avg_power"),
        F.max_by("power", F.struct("timestamp_ns", "id")).alias("last_power"),
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        (F.min("timestamp_ns") >= 1706400000000000000).alias("new_in_window"),
    )


@query(
    "ups01_signal_catalogue",
    """SELECT freq_mhz, COUNT(*) AS total_hits, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns,
        COALESCE(arg_max(name, (timestamp_ns, id)) FILTER (WHERE name <> 'Unknown'), 'Unknown') AS name, COALESCE(arg_max(cls, (timestamp_ns, id)) FILTER (WHERE cls <> 'UNK'), 'UNK') AS cls
       FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'Unknown' ELSE concat('Sig ', k) END AS name, COALESCE(classification, 'UNK') AS cls FROM hits) GROUP BY 1""",
)
def _(v):
    hits = v.hits.withColumn("name", F.when(F.col("k") % 4 == 0, "Unknown").otherwise(F.concat(F.lit("Sig "), F.col("k")))).withColumn(
        "cls", F.coalesce("classification", F.lit("UNK"))
    )
    order = F.struct("timestamp_ns", "id")
    best = lambda c, none: F.coalesce(F.max_by(c, F.when(F.col(c) != none, order)), F.lit(none)).alias(c)
    return hits.groupBy("freq_mhz").agg(
        rows().alias("total_hits"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
        best("name", "Unknown"), best("cls", "UNK"),
    )


# --- fingerprints ----------------------------------------------------------

FP_ID = f"printf('FP-%+06d:%04d:%04d', CAST(ROUND(cfo_hz/{CFO_BUCKET}) AS BIGINT), CAST(ROUND(iq_amplitude_imbal/{RESOLUTION}) AS BIGINT), CAST(ROUND(iq_phase_imbal/{RESOLUTION}) AS BIGINT))"
FPC_CTE = f"""
fpx AS (SELECT *, {FP_ID} AS fingerprint_id FROM fp),
fpcat AS (SELECT fingerprint_id, COUNT(*) AS capture_count, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns, arg_min(power_variance, (timestamp_ns, capture_id)) AS evm,
  arg_max(cfo_hz, (timestamp_ns, capture_id)) AS cfo_hz, arg_max(iq_amplitude_imbal, (timestamp_ns, capture_id)) AS iq_amplitude_imbal,
  arg_max(iq_phase_imbal, (timestamp_ns, capture_id)) AS iq_phase_imbal, arg_max(avg_power_db, (timestamp_ns, capture_id)) AS avg_power_db, arg_max(freq_mhz, (timestamp_ns, capture_id)) AS freq_mhz
  FROM fpx GROUP BY 1)"""


def catalogue(v):
    return E.fingerprint_catalogue(v.fp, CFO_BUCKET, RESOLUTION)


@query("prj16_fingerprint_id", "SELECT capture_id, printf('FP-%+06d:%04d:%04d', CAST(ROUND(cfo_hz/5e0) AS BIGINT), CAST(ROUND(iq_amplitude_imbal/0.0001e0) AS BIGINT), CAST(ROUND(iq_phase_imbal/0.0001e0) AS BIGINT)) AS fingerprint_id FROM fp")
def _(v):
    fp = S.fingerprint_id(F.col("cfo_hz"), F.col("iq_amplitude_imbal"), F.col("iq_phase_imbal"))
    return v.fp.select("capture_id", fp.alias("fingerprint_id"))


@query("ups07_fingerprint_catalogue", "SELECT fingerprint_id, capture_count, first_ns, last_ns, ROUND(evm, 6) AS evm, ROUND(cfo_hz, 6) AS cfo_hz, ROUND(iq_amplitude_imbal, 6) AS iq_amplitude_imbal, ROUND(iq_phase_imbal, 6) AS iq_phase_imbal, avg_power_db, freq_mhz FROM fpcat", FPC_CTE)
def _(v):
    out = catalogue(v)
    for c in ("evm", "cfo_hz", "iq_amplitude_imbal", "iq_phase_imbal"):
        out = out.withColumn(c, F.round(c, 6))
    return out


LINK_CTE = f"""
cand AS (SELECT f.capture_id, f.timestamp_ns, f.fingerprint_id, g.id AS grant_id, g.tgid, g.uid, g.system, g.timestamp_ns AS grant_ns,
   row_number() OVER (PARTITION BY f.capture_id ORDER BY g.timestamp_ns DESC, g.id DESC) AS rk
  FROM fpx f JOIN gr g ON abs(g.voice_freq - f.freq_mhz) < 0.002e0 AND g.timestamp_ns <= f.timestamp_ns AND f.timestamp_ns - g.timestamp_ns <= {DAY_NS // 2}),
links AS (SELECT uid, fingerprint_id, COUNT(*) AS observation_count, MIN(timestamp_ns) AS first_ns, MAX(timestamp_ns) AS last_ns, arg_min(capture_id, (timestamp_ns, capture_id)) AS first_capture FROM cand WHERE rk = 1 AND uid > 0 GROUP BY 1, 2),
claims AS (SELECT fingerprint_id, arg_min(uid, (first_ns, first_capture)) AS claimed_by FROM links GROUP BY 1)"""


def links(v):
    return E.uid_links(v.fp, v.gr, DAY_NS // 2, CFO_BUCKET, RESOLUTION)


@query("joi09_recent_grant", "SELECT capture_id, timestamp_ns, grant_id, tgid, uid, system, grant_ns FROM cand WHERE rk = 1", FPC_CTE + "," + LINK_CTE)
def _(v):
    return E.recent_grant(v.fp, v.gr, DAY_NS // 2)


@query("joi19_uid_links", "SELECT uid, l.fingerprint_id, observation_count, first_ns, last_ns, claimed_by FROM links l JOIN claims USING (fingerprint_id)", FPC_CTE + "," + LINK_CTE)
def _(v):
    return links(v)


@query(
    "win10_uid_mismatch",
    """SELECT l.uid, f.known_fingerprint, l.fingerprint_id, l.first_ns FROM links l JOIN (SELECT uid, arg_min(fingerprint_id, (first_ns, fingerprint_id)) AS known_fingerprint FROM links GROUP BY 1) f ON f.uid = l.uid
       WHERE l.fingerprint_id <> f.known_fingerprint""",
    FPC_CTE + "," + LINK_CTE,
)
def _(v):
    return E.uid_mismatches(stored(links(v), "uid-links"))


@query(
    "win09_reappearance",
    f"SELECT fingerprint_id, capture_id AS id, timestamp_ns, gap/1e9 AS absent_sec FROM (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY fingerprint_id ORDER BY timestamp_ns, capture_id) AS gap FROM fpx) WHERE gap >= {DAY_NS}",
    FPC_CTE,
)
def _(v):
    fp = S.fingerprint_id(F.col("cfo_hz"), F.col("iq_amplitude_imbal"), F.col("iq_phase_imbal"), CFO_BUCKET, RESOLUTION)
    return H.reappearances(v.fp.select(fp.alias("fingerprint_id"), F.col("capture_id").alias("id"), "timestamp_ns"), "fingerprint_id", DAY_NS)


@query("win14_new_emitters", f"SELECT fingerprint_id, first_ns, last_ns, last_ns >= {EPOCH_S + 20*86400}000000000 - 7200000000000 AS active FROM fpcat WHERE first_ns >= {EPOCH_S + 19*86400}000000000", FPC_CTE)
def _(v):
    now = (EPOCH_S + 20 * 86400) * 10**9
    c = catalogue(v).where(F.col("first_ns") >= now - DAY_NS)
    return c.select("fingerprint_id", "first_ns", "last_ns", (F.col("last_ns") >= now - 7200 * 10**9).alias("active"))


@query(
    "agg27_fingerprint_stats",
    "SELECT (SELECT COUNT(*) FROM fp) AS total_captures, (SELECT COUNT(*) FROM fpcat) AS unique_emitters, (SELECT COUNT(*) FROM links) AS uid_links, (SELECT COUNT(DISTINCT uid) FROM links) AS linked_uids",
    FPC_CTE + "," + LINK_CTE,
)
def _(v):
    return counters([
        (v.fp, {"total_captures": rows()}), (catalogue(v), {"unique_emitters": rows()}),
        (links(v), {"uid_links": rows(), "linked_uids": F.count_distinct("uid")}),
    ])


@query(
    "joi08_channel_emitter",
    """SELECT c.channel_id, x.fingerprint_id, x.capture_count FROM channels c LEFT JOIN LATERAL (
        SELECT fingerprint_id, capture_count FROM fpcat f WHERE abs(f.freq_mhz - c.channel_freq) < 0.015e0 ORDER BY capture_count DESC, fingerprint_id LIMIT 1) x ON TRUE""",
    FPC_CTE,
)
def _(v):
    b = lambda c: F.floor(F.col(c) / F.lit(0.015)).cast("long")
    # The best fingerprint per exact frequency is enough, so the join stays small.
    best = catalogue(v).groupBy("freq_mhz").agg(
        F.min(F.struct((-F.col("capture_count")).alias("neg"), F.col("fingerprint_id").alias("fid"))).alias("lo"),
    )
    cells = v.channels.withColumn("_bin", F.explode(F.array(b("channel_freq") - 1, b("channel_freq"), b("channel_freq") + 1)))
    near = cells.join(best.withColumn("_bin", b("freq_mhz")), "_bin").where(F.abs(F.col("freq_mhz") - F.col("channel_freq")) < 0.015)
    top = near.groupBy("channel_id").agg(F.min("lo").alias("lo"))
    return v.channels.select("channel_id").join(top, "channel_id", "left").select(
        "channel_id", F.col("lo.fid").alias("fingerprint_id"), (-F.col("lo.neg")).alias("capture_count")
    )


@query(
    "joi12_fingerprint_match",
    """SELECT probe, fingerprint_id, capture_count FROM (SELECT p.probe, f.fingerprint_id, f.capture_count, row_number() OVER (PARTITION BY p.probe ORDER BY f.capture_count DESC, f.fingerprint_id) AS rk
        FROM (SELECT label AS probe, ROUND(AVG(100*embedding[1]::DOUBLE), 4) AS cfo, ROUND(AVG(abs(embedding[2]::DOUBLE)), 4) AS iqa FROM embeddings GROUP BY 1) p
        JOIN fpcat f ON abs(f.cfo_hz - p.cfo) < 10 AND abs(f.iq_amplitude_imbal - p.iqa) < 0.05e0) WHERE rk <= 10""",
    FPC_CTE,
)
def _(v):
    e = F.col("embedding")
    probes = v.table("embeddings").groupBy(F.col("label").alias("probe")).agg(
        F.round(F.avg(100 * F.get(e, F.lit(0)).cast("double")), 4).alias("cfo"),
        F.round(F.avg(F.abs(F.get(e, F.lit(1)).cast("double"))), 4).alias("iqa"),
    )

    def spread(c, tol):
        cell = F.floor(F.col(c) / F.lit(tol)).cast("long")
        return F.explode(F.array(cell - 1, cell, cell + 1))

    grid = probes.withColumn("_x", spread("cfo", 10.0)).withColumn("_y", spread("iqa", 0.05))
    cat = catalogue(v).withColumn("_x", F.floor(F.col("cfo_hz") / 10.0).cast("long")).withColumn(
        "_y", F.floor(F.col("iq_amplitude_imbal") / F.lit(0.05)).cast("long")
    )
    near = grid.join(cat, ["_x", "_y"]).where(
        (F.abs(F.col("cfo_hz") - F.col("cfo")) < 10) & (F.abs(F.col("iq_amplitude_imbal") - F.col("iqa")) < 0.05)
    )
    best = Window.partitionBy("probe").orderBy(F.desc("capture_count"), "fingerprint_id")
    return near.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= 10).select("probe", "fingerprint_id", "capture_count")


# --- library matching ------------------------------------------------------


@query(
    "joi10_library_match",
    """SELECT id, COALESCE(MAX(score), 0) AS confidence, arg_max(name, (score, ref_id)) AS id_match, arg_max(emitter_type, (score, ref_id)) AS emitter_type FROM (
        SELECT p.id, l.ref_id, l.name, l.emitter_type, CASE WHEN ref_id IS NOT NULL THEN LEAST(1e0, 0.5e0 + CASE WHEN pri BETWEEN pri_min AND pri_max THEN 0.3e0 ELSE 0 END + CASE WHEN pw_us BETWEEN pw_min AND pw_max THEN 0.2e0 ELSE 0 END) END AS score
        FROM (SELECT id, ROUND(1200 + k*90e0, 1) AS freq, 500 + k*30e0 AS pri, ROUND(-power/20, 4) AS pw_us FROM ev) p LEFT JOIN lib l ON p.freq BETWEEN l.f_min AND l.f_max) GROUP BY 1""",
    LIB_CTE,
)
def _(v):
    k = F.col("k")
    m = v.ev.select("id", F.round(1200 + k * 90.0, 1).alias("freq"), (500 + k * 30.0).alias("pri"), F.round(-F.col("power") / 20, 4).alias("pw_us"))
    return E.match_library(m, ["id"], "freq", "pri", "pw_us")


@query(
    "joi11_drone_match",
    """SELECT id, arg_min(manufacturer, sig_order) AS manufacturer, arg_min(model, sig_order) AS model, ROUND(LEAST(1e0, arg_min(0.5e0 + 0.5e0*LEAST(bw/sig_bw, sig_bw/bw), sig_order)), 6) AS confidence
       FROM (SELECT id, ROUND(900 + k*50e0, 1) AS f, 1 + k % 12::DOUBLE AS bw FROM ev) JOIN sig ON f - bw/2 <= hi AND f + bw/2 >= lo GROUP BY 1""",
    SIG_CTE,
)
def _(v):
    d = v.ev.select("id", F.round(900 + F.col("k") * 50.0, 1).alias("f"), (1 + F.col("k") % 12).cast("double").alias("bw"))
    return E.match_drones(d, ["id"], "f", "bw").withColumn("confidence", F.round("confidence", 6))


@query(
    "ups09_drone_tracks",
    f"""SELECT manufacturer, model, MIN(timestamp_ns) AS start_t, MAX(timestamp_ns) AS end_t, COUNT(*) AS detections, MAX(power) AS peak_signal FROM (
        SELECT *, SUM(CASE WHEN gap <= {DAY_NS} THEN 0 ELSE 1 END) OVER (PARTITION BY manufacturer, model ORDER BY timestamp_ns, id) AS tno FROM (
         SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY manufacturer, model ORDER BY timestamp_ns, id) AS gap FROM (
          SELECT h.id, timestamp_ns, power, concat('maker-', source_unit % 17) AS manufacturer, concat('model-', k % 5) AS model FROM hits h))) GROUP BY 1, 2, tno""",
)
def _(v):
    d = v.hits.select(
        "id", "timestamp_ns", "power", F.concat(F.lit("maker-"), F.col("source_unit") % 17).alias("manufacturer"), F.concat(F.lit("model-"), F.col("k") % 5).alias("model")
    )
    return E.tracks(d, ["manufacturer", "model"], DAY_NS)


# --- pulses ----------------------------------------------------------------

PRI_CTE = "pri AS (SELECT *, (toa - lag(toa) OVER (PARTITION BY emitter ORDER BY timestamp_ns, id)) * 1e6 AS pri_us FROM pdw)"


@query("win05_pulse_interval", "SELECT id, emitter, ROUND(pri_us, 2) AS pri_us FROM pri", PRI_CTE)
def _(v):
    return E.pulse_intervals(v.pdw).select("id", "emitter", F.round("pri_us", 2).alias("pri_us"))


@query(
    "agg29_pri_stats",
    """SELECT freq_mhz, cnt, ROUND(m, 1) AS mean_pri_us, ROUND(lo, 1) AS min_pri_us, ROUND(hi, 1) AS max_pri_us, CASE WHEN (hi-lo)/m < 0.05 THEN 'Stable' WHEN (hi-lo)/m < 0.2 THEN 'Stagger' ELSE 'Jitter' END AS pattern FROM (
        SELECT ROUND(freq_mhz, 1) AS freq_mhz, COUNT(*) AS cnt, AVG(pri_us) AS m, MIN(pri_us) AS lo, MAX(pri_us) AS hi FROM pri WHERE pri_us IS NOT NULL GROUP BY 1) ORDER BY cnt DESC, freq_mhz LIMIT 50""",
    PRI_CTE,
)
def _(v):
    s = E.pri_stats(E.pulse_intervals(v.pdw)).orderBy(F.desc("cnt"), "freq_mhz").limit(50)
    for c in ("mean_pri_us", "min_pri_us", "max_pri_us"):
        s = s.withColumn(c, F.round(c, 1))
    return s


@query(
    "agg30_pri_patterns",
    """SELECT emitter, n AS pulses, CASE WHEN n < 3 OR m = 0 THEN 'Insufficient' WHEN s/m < 0.01 THEN 'Stable' WHEN s/m < 0.05 THEN 'Jitter' WHEN c2 OR c3 OR c4 OR c5 THEN 'Stagger' ELSE 'Agile' END AS pattern FROM (
        SELECT emitter, COUNT(*) AS n, AVG(pri_us) AS m, stddev_pop(pri_us) AS s, """
    + ", ".join(
        f"COUNT(*) >= {2*c} AND bool_and(abs(pri_us - l[(pos-1)%{c}+1])/l[(pos-1)%{c}+1] < 0.02) AS c{c}" for c in (2, 3, 4, 5)
    )
    + """ FROM (SELECT *, row_number() OVER (PARTITION BY emitter ORDER BY timestamp_ns, id) AS pos FROM syn) JOIN (SELECT emitter, list(pri_us ORDER BY timestamp_ns, id) AS l FROM syn GROUP BY 1) USING (emitter) GROUP BY 1)""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY source_unit ORDER BY timestamp_ns, id) AS pos FROM ev),
syn AS (SELECT * FROM (SELECT id, timestamp_ns, source_unit AS emitter, CASE source_unit % 5 WHEN 0 THEN 1000 + pos % 2 WHEN 1 THEN 1000 + 40*(pos % 3) WHEN 2 THEN 1000 + 500*(pos % 3) WHEN 3 THEN 1000 + k*10 ELSE CASE WHEN pos <= 2 THEN 1000 END END::DOUBLE AS pri_us FROM ranked) WHERE pri_us IS NOT NULL)""",
)
def _(v):
    # Measured gaps of this stream are all agile, so intervals of every class derive from each emitter's pulse numbers.
    from wavetrail.operators.ordered import with_position

    u, p, k = F.col("source_unit"), F.col("pos"), F.col("k")
    pri = (
        F.when(u % 5 == 0, 1000 + p % 2).when(u % 5 == 1, 1000 + 40 * (p % 3)).when(u % 5 == 2, 1000 + 500 * (p % 3))
        .when(u % 5 == 3, 1000 + k * 10).otherwise(F.when(p <= 2, F.lit(1000).cast("long")))
    )
    syn = with_position(v.ev, ["source_unit"], ["timestamp_ns", "id"]).select(
        "id", "timestamp_ns", u.alias("emitter"), pri.cast("double").alias("pri_us")
    )
    return E.pri_patterns(syn)


# --- recordings ------------------------------------------------------------


@query(
    "agg23_recording_stats",
    f"""SELECT COUNT(*) AS total, SUM(file_size_bytes)::BIGINT AS total_bytes, ROUND(SUM(duration_sec), 4) AS total_sec, COUNT(CASE WHEN rec_type = 'audio' THEN 1 END) AS audio, COUNT(CASE WHEN rec_type = 'iq' THEN 1 END) AS iq,
        COUNT(CASE WHEN trigger_type LIKE 'auto%' THEN 1 END) AS total_clips, COUNT(CASE WHEN trigger_type = 'auto_p25' THEN 1 END) AS p25_clips, COUNT(CASE WHEN trigger_type = 'auto_squelch' THEN 1 END) AS analog_clips,
        COUNT(CASE WHEN start_time >= TIMESTAMP '2001-10-04' THEN 1 END) AS recent, COALESCE(SUM(CASE WHEN start_time >= TIMESTAMP '2001-10-04' THEN file_size_bytes END), 0)::BIGINT AS recent_bytes FROM rec""",
)
def _(v):
    recent = F.col("start_time") >= ts_lit(REC_AS_OF) - F.make_dt_interval(days=F.lit(31))
    t = F.col("trigger_type")
    return v.rec.agg(
        rows().alias("total"), F.sum("file_size_bytes").alias("total_bytes"), F.round(F.sum("duration_sec"), 4).alias("total_sec"),
        tally(F.col("rec_type") == "audio").alias("audio"), tally(F.col("rec_type") == "iq").alias("iq"),
        tally(t.startswith("auto")).alias("total_clips"), tally(t == "auto_p25").alias("p25_clips"), tally(t == "auto_squelch").alias("analog_clips"),
        tally(recent).alias("recent"), F.coalesce(F.sum(F.when(recent, F.col("file_size_bytes"))), F.lit(0)).alias("recent_bytes"),
    )


@query(
    "agg24_clip_groups",
    """SELECT 'talkgroup' AS grouping_kind, r.tgid::VARCHAR AS key, t.name, COUNT(*) AS clip_count, ROUND(SUM(duration_sec), 4) AS total_duration, SUM(file_size_bytes)::BIGINT AS total_size, COUNT(DISTINCT source_unit) AS unique_uids, MAX(start_time) AS last_clip
       FROM rec r LEFT JOIN tg t ON t.tgid = r.tgid WHERE trigger_type = 'auto_p25' GROUP BY 1, 2, 3
       UNION ALL SELECT 'frequency', printf('%.3f', ROUND(freq_mhz, 3)), NULL, COUNT(*), ROUND(SUM(duration_sec), 4), SUM(file_size_bytes)::BIGINT, COUNT(DISTINCT source_unit), MAX(start_time) FROM rec WHERE trigger_type = 'auto_squelch' GROUP BY 2
       UNION ALL SELECT 'unit', concat(tgid, '/', source_unit), NULL, COUNT(*), ROUND(SUM(duration_sec), 4), SUM(file_size_bytes)::BIGINT, COUNT(DISTINCT source_unit), MAX(start_time) FROM rec WHERE trigger_type = 'auto_p25' AND source_unit IS NOT NULL GROUP BY 2""",
)
def _(v):
    measures = [
        rows().alias("clip_count"), F.round(F.sum("duration_sec"), 4).alias("total_duration"), F.sum("file_size_bytes").alias("total_size"),
        F.count_distinct("source_unit").alias("unique_uids"), F.max("start_time").alias("last_clip"),
    ]
    # one row for each group that a clip counts in, so the recordings are read once
    group = lambda kind, key: F.struct(F.lit(kind).alias("grouping_kind"), key.alias("key"), F.when(F.lit(kind == "talkgroup"), F.col("tgid")).alias("tgid"))
    p25, squelch = F.col("trigger_type") == "auto_p25", F.col("trigger_type") == "auto_squelch"
    groups = F.array_compact(F.array(
        F.when(p25, group("talkgroup", F.col("tgid").cast("string"))),
        F.when(squelch, group("frequency", S.fixed(F.round("freq_mhz", 3), 3))),
        F.when(p25 & F.col("source_unit").isNotNull(), group("unit", F.concat("tgid", F.lit("/"), "source_unit"))),
    ))
    clips = v.rec.select("duration_sec", "file_size_bytes", "source_unit", "start_time", F.inline(groups))
    names = v.tg.select("tgid", "name")
    return clips.groupBy("grouping_kind", "key", "tgid").agg(*measures).join(names, "tgid", "left").drop("tgid")


@query(
    "agg22_activity_heatmap",
    "SELECT band, hour(ts) AS hour, COUNT(*) AS cnt FROM hits WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR GROUP BY 1, 2",
)
def _(v):
    day = ts_lit("2024-01-30 00:00:00") - F.make_dt_interval(hours=F.lit(24))
    return v.hits.where(F.col("ts") >= day).groupBy("band", F.hour("ts").alias("hour")).agg(rows().alias("cnt"))


@query(
    "agg22b_dense_heatmap",
    "SELECT band, " + ", ".join(f"COUNT(CASE WHEN hour(ts) = {h} THEN 1 END) AS h{h:02d}" for h in range(24)) + " FROM hits GROUP BY 1",
)
def _(v):
    hour = F.hour("ts")
    return v.hits.groupBy("band").agg(*[F.count(F.when(hour == h, 1)).alias(f"h{h:02d}") for h in range(24)])


# --- targets and observations ----------------------------------------------

OBS_CTE = """
targets AS (SELECT tgid AS target_id, 'talkgroup' AS target_type, tgid::VARCHAR AS target_key, name AS target_label, 1 + priority AS coverage_target_hours, priority FROM tg),
obs AS (SELECT id, tgid AS target_id, site_id, start_time, duration_sec, source_unit AS uid FROM rec)"""


def targets(v):
    return v.tg.select(
        F.col("tgid").alias("target_id"), F.lit("talkgroup").alias("target_type"), F.col("tgid").cast("string").alias("target_key"),
        F.col("name").alias("target_label"), (1 + F.col("priority")).alias("coverage_target_hours"), "priority",
    )


def observations(v):
    return v.rec.select("id", F.col("tgid").alias("target_id"), "site_id", "start_time", "duration_sec", F.col("source_unit").alias("uid"))


@query(
    "agg26_target_coverage",
    """SELECT t.target_id, target_label, priority, coverage_target_hours, COALESCE(o.n, 0) AS observations, ROUND(LEAST(COALESCE(o.recent, 0)/3600e0/coverage_target_hours, 1e0), 6) AS coverage_pct
       FROM targets t LEFT JOIN (SELECT target_id, COUNT(*) AS n, SUM(CASE WHEN start_time >= TIMESTAMP '2001-01-04' THEN duration_sec ELSE 0 END) AS recent FROM obs GROUP BY 1) o ON o.target_id = t.target_id""",
    OBS_CTE,
)
def _(v):
    recent = F.col("start_time") >= ts_lit("2001-01-04 00:00:00")
    done = observations(v).groupBy("target_id").agg(rows().alias("observations"), F.sum(F.when(recent, F.col("duration_sec")).otherwise(0.0)).alias("sec"))
    share = F.least(F.coalesce("sec", F.lit(0.0)) / 3600 / F.col("coverage_target_hours"), F.lit(1.0))
    return targets(v).join(done, "target_id", "left").select(
        "target_id", "target_label", "priority", "coverage_target_hours", F.coalesce("observations", F.lit(0)).alias("observations"),
        F.round(share, 6).alias("coverage_pct"),
    )


@query(
    "joi20_observation_targets",
    """SELECT o.id, o.target_id, o.site_id, o.start_time, o.uid, o.duration_sec, t.target_type, t.target_key, t.target_label FROM obs o LEFT JOIN targets t ON t.target_id = o.target_id
       WHERE o.site_id = 3 AND o.start_time >= TIMESTAMP '1998-01-01' ORDER BY o.start_time DESC, o.id DESC, o.target_id DESC, o.uid DESC, o.duration_sec DESC LIMIT 200""",
    OBS_CTE,
)
def _(v):
    o = apply_optional(observations(v), target_id=None, site_id=3, start_time__ge=ts_lit("1998-01-01 00:00:00"))
    order = [F.desc(c) for c in ("start_time", "id", "target_id", "uid", "duration_sec")]
    page = o.orderBy(*order).limit(200)
    return page.join(targets(v).select("target_id", "target_type", "target_key", "target_label"), "target_id", "left")


@query(
    "agg35_activity_probes",
    """SELECT c.channel_id, COALESCE(h.hit, FALSE) AS signal_near, COALESCE(s.hit, FALSE) AS channel_used FROM channels c
       LEFT JOIN (SELECT DISTINCT c.channel_id, TRUE AS hit FROM channels c JOIN hits h ON abs(h.freq_mhz - c.channel_freq) < 0.004e0 WHERE h.timestamp_ns >= 1706486400000000000) h USING (channel_id)
       LEFT JOIN (SELECT DISTINCT channel_id, TRUE AS hit FROM hits WHERE timestamp_ns >= 1706486400000000000) s USING (channel_id)""",
)
def _(v):
    recent = v.hits.where(F.col("timestamp_ns") >= 1706486400000000000)
    freqs = recent.select("freq_mhz").distinct()
    near = E.near_values(v.channels, "channel_freq", freqs, "freq_mhz", 0.004).select("channel_freq").distinct().withColumn("a", F.lit(True))
    used = recent.select("channel_id").distinct().withColumn("b", F.lit(True))
    return v.channels.join(near, "channel_freq", "left").join(used, "channel_id", "left").select(
        "channel_id", F.coalesce("a", F.lit(False)).alias("signal_near"), F.coalesce("b", F.lit(False)).alias("channel_used")
    )


@query(
    "agg35b_latest_encrypted_grant",
    "SELECT g.id, g.voice_freq FROM gr g JOIN tg t ON t.tgid = g.tgid AND t.system = g.system WHERE t.encrypted = 'encrypted' AND g.ts >= TIMESTAMP '2024-01-15' ORDER BY g.timestamp_ns DESC, g.id DESC LIMIT 1",
)
def _(v):
    secret = v.tg.where(F.col("encrypted") == "encrypted").select("tgid", "system")
    recent = v.gr.where(F.col("ts") >= ts_lit("2024-01-15 00:00:00")).join(secret, ["tgid", "system"], "left_semi")
    return recent.orderBy(F.desc("timestamp_ns"), F.desc("id")).limit(1).select("id", "voice_freq")


# --- tolerance de-duplication, frequency lists -----------------------------


@query(
    "ord04_tolerance_dedup",
    """SELECT grp, x FROM w WHERE x IS NOT NULL""",
    """vals AS (SELECT k % 4 AS grp, list_sort(list(DISTINCT ROUND(power, 2))) AS l FROM ev GROUP BY 1),
w AS (WITH RECURSIVE r AS (SELECT grp, l, l[1] AS x FROM vals UNION ALL SELECT grp, l, list_min(list_filter(l, lambda y: y > r.x + 1.005e0)) FROM r WHERE r.x IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    e = v.ev.select((F.col("k") % 4).alias("grp"), F.round("power", 2).alias("x"))
    return spaced_rows(e, "grp", "x", 1.005, strict=True)


@query(
    "joi18_control_frequencies",
    """SELECT system, x AS freq_mhz FROM w WHERE x IS NOT NULL""",
    """alts AS (SELECT concat('SYS-', s_suppkey % 7) AS system, 851 + (s_suppkey % 50)*0.0125e0 AS f FROM supplier
  UNION ALL SELECT concat('SYS-', s_suppkey % 7), CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 851 + (s_suppkey % 30)*0.0125e0 + 0.00005e0*j END FROM supplier, range(3) t(j)),
vals AS (SELECT system, list_sort(list(DISTINCT ROUND(f, 6))) AS l FROM alts WHERE f > 0 GROUP BY 1),
w AS (WITH RECURSIVE r AS (SELECT system, l, l[1] AS x FROM vals UNION ALL SELECT system, l, list_min(list_filter(l, lambda y: y >= r.x + 0.0001e0)) FROM r WHERE r.x IS NOT NULL) SELECT * FROM r)""",
)
def _(v):
    s = F.col("s_suppkey")
    system = F.concat(F.lit("SYS-"), s % 7)
    alt = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda j: F.struct(F.when(s % 11 == 0, 0.0).otherwise(851 + (s % 30) * 0.0125 + 0.00005 * j).alias("freq_mhz")),
    )
    sites = v.table("supplier").select(system.alias("system"), (851 + (s % 50) * 0.0125).alias("control"), F.to_json(alt).alias("alt_json"))
    alts = sites.select("system", F.explode(F.from_json("alt_json", "array<struct<freq_mhz: double>>")).alias("a")).select("system", F.col("a.freq_mhz").alias("f"))
    every = sites.select("system", F.col("control").alias("f")).unionByName(alts).where(F.col("f") > 0)
    kept = spaced_rows(every.select("system", F.round("f", 6).alias("freq_mhz")), "system", "freq_mhz", 0.0001)
    return kept


@query(
    "ups11_insert_or_ignore",
    """SELECT source_unit, arg_min(id, (timestamp_ns, id)) AS first_id, arg_min(body, (timestamp_ns, id)) AS first_body, arg_max(id, (timestamp_ns, id)) AS last_id, arg_max(band, (timestamp_ns, id)) AS last_band FROM ev GROUP BY 1""",
)
def _(v):
    order = F.struct("timestamp_ns", "id")
    return v.ev.groupBy("source_unit").agg(
        F.min_by("id", order).alias("first_id"), F.min_by("body", order).alias("first_body"),
        F.max_by("id", order).alias("last_id"), F.max_by("band", order).alias("last_band"),
    )


@query(
    "ups08_emitter_catalogue",
    f"""SELECT emitter_mhz, first_s, last_s, hits, id_match, emitter_type, CASE WHEN id_match IS NULL THEN 0e0 ELSE 0.5e0 END AS confidence,
         CASE WHEN {EPOCH_S + 86400} - last_s > 86400 THEN 'GONE' WHEN {EPOCH_S + 86400} - first_s <= 86400 THEN 'NEW' ELSE 'UNKNOWN' END AS status
       FROM (SELECT owner AS emitter_mhz, MIN(first_s) AS first_s, MAX(last_s) AS last_s, SUM(hits)::BIGINT AS hits FROM claimed GROUP BY 1) e
       LEFT JOIN (SELECT f, arg_max(name, ref_id) AS id_match, arg_max(emitter_type, ref_id) AS emitter_type FROM (SELECT DISTINCT owner AS f FROM claimed) c JOIN lib ON c.f BETWEEN f_min AND f_max GROUP BY 1) m ON m.f = e.emitter_mhz""",
    LIB_CTE + """,
pks AS (SELECT t_s, (tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz)/1e6 AS mhz FROM (
  SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r FROM bins WINDOW w AS (PARTITION BY frame_id ORDER BY bin)) WHERE db > -70 AND db > l AND db > r),
seen AS (SELECT f, first_s, last_s, hits, row_number() OVER (ORDER BY first_s, f) AS i FROM (
  SELECT ROUND(mhz, 6) AS f, MIN(t_s) AS first_s, MAX(t_s) AS last_s, COUNT(*) AS hits FROM pks GROUP BY 1)),
claimed AS (WITH RECURSIVE r AS (
  SELECT 0::BIGINT AS i, []::DOUBLE[] AS known, NULL::DOUBLE AS owner, NULL::BIGINT AS first_s, NULL::BIGINT AS last_s, NULL::BIGINT AS hits
  UNION ALL
  SELECT i, CASE WHEN near IS NULL THEN list_append(known, f) ELSE known END, coalesce(near, f), first_s, last_s, hits FROM (
    SELECT s.i, r.known, s.f, list_filter(r.known, lambda e: abs(e - s.f) < 0.05)[1] AS near, s.first_s, s.last_s, s.hits FROM r JOIN seen s ON s.i = r.i + 1))
  SELECT * FROM r WHERE i > 0)""",
)
def _(v):
    from wavetrail.operators.spectrum import peaks

    found = peaks(v.psd, -70.0).select("t_s", (F.col("hz") / 1e6).alias("freq_mhz"))
    known = E.claim_emitters(found, 0.05)
    best = E.match_library(known, ["emitter_mhz"], "emitter_mhz", None, None)
    return known.join(best, "emitter_mhz").withColumn("status", E.emitter_status(known, EPOCH_S + 86400, 86400))


@query(
    "agg33_emitter_rollup",
    f"""SELECT COUNT(*) AS emitters, COUNT(CASE WHEN {EPOCH_S + 21*86400} - last_ns//1000000000 > 86400*3 THEN 1 END) AS gone, COUNT(CASE WHEN {EPOCH_S + 21*86400} - last_ns//1000000000 <= 86400*3 AND {EPOCH_S + 21*86400} - first_ns//1000000000 <= 86400*3 THEN 1 END) AS new,
        COUNT(CASE WHEN {EPOCH_S + 21*86400} - last_ns//1000000000 <= 86400*3 AND {EPOCH_S + 21*86400} - first_ns//1000000000 > 86400*3 THEN 1 END) AS unknown, COUNT(CASE WHEN {EPOCH_S + 21*86400} - last_ns//1000000000 < 43200 THEN 1 END) AS active_tracks FROM fpcat""",
    FPC_CTE,
)
def _(v):
    now = EPOCH_S + 21 * 86400
    c = catalogue(v).select(F.expr("first_ns div 1000000000L").alias("first_s"), F.expr("last_ns div 1000000000L").alias("last_s"))
    s = c.withColumn("status", E.emitter_status(c, now, 3 * 86400))
    return s.agg(
        rows().alias("emitters"), tally(F.col("status") == "GONE").alias("gone"), tally(F.col("status") == "NEW").alias("new"),
        tally(F.col("status") == "UNKNOWN").alias("unknown"), tally(now - F.col("last_s") < 43200).alias("active_tracks"),
    )


@query(
    "scl08_geodesic_distance",
    """SELECT id, ROUND(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM (SELECT id, POWER(sin(radians(la2 - la1)/2), 2) + cos(radians(la1))*cos(radians(la2))*POWER(sin(radians(lo2 - lo1)/2), 2) AS a FROM (
        SELECT id, 45 + (k % 10)*0.01e0 AS la1, -122 - (k % 7)*0.01e0 AS lo1, 45.5e0 + (source_unit % 5)*0.1e0 AS la2, -122.6e0 AS lo2 FROM ev))""",
)
def _(v):
    k = F.col("k")
    d = S.haversine_m(45 + (k % 10) * 0.01, -122 - (k % 7) * 0.01, 45.5 + (F.col("source_unit") % 5) * 0.1, F.lit(-122.6))
    return v.ev.select("id", F.round(d, 3).alias("metres"))


@query(
    "scl10_department_class",
    """SELECT id, department, tag, CASE WHEN tag ILIKE '%law%' OR tag ILIKE '%corrections%' THEN 'PUBS' WHEN tag ILIKE '%fire%' OR tag ILIKE '%ems%' OR tag ILIKE '%emergency%' THEN 'PUBS' WHEN tag ILIKE '%interop%' THEN 'PUBS'
        WHEN department ILIKE '%police%' OR department ILIKE '%sheriff%' THEN 'PUBS' WHEN department ILIKE '%fire%' OR department ILIKE '%ems%' OR department ILIKE '%rescue%' THEN 'PUBS'
        WHEN department ILIKE '%trimet%' OR department ILIKE '%transit%' THEN 'COMM' WHEN department ILIKE '%hospital%' OR department ILIKE '%medical%' THEN 'COMM' WHEN department ILIKE '%federal%' THEN 'FEDL'
        WHEN department ILIKE '%port of portland%' THEN 'PUBS' ELSE 'COMM' END AS cls FROM depts""",
    """depts AS (SELECT id, ['City Police', 'Federal Bureau', 'Water Board', 'County Sheriff', 'Transit Agency', 'Mercy Hospital', 'Air Rescue', 'Port of Portland'][CAST(k % 8 AS INTEGER) + 1] AS department,
   ['Law Dispatch', 'Ops', 'Fire Tac', 'Interop', 'Admin'][CAST(source_unit % 5 AS INTEGER) + 1] AS tag FROM ev)""",
)
def _(v):
    deps = F.array(*[F.lit(x) for x in ("City Police", "Federal Bureau", "Water Board", "County Sheriff", "Transit Agency", "Mercy Hospital", "Air Rescue", "Port of Portland")])
    tags = F.array(*[F.lit(x) for x in ("Law Dispatch", "Ops", "Fire Tac", "Interop", "Admin")])
    d = v.ev.select("id", F.get(deps, (F.col("k") % 8).cast("int")).alias("department"), F.get(tags, (F.col("source_unit") % 5).cast("int")).alias("tag"))
    return d.withColumn("cls", S.department_class(F.col("department"), F.col("tag")))


@query(
    "scl11_algorithm_codes",
    """SELECT id, name, CASE name WHEN 'AES-256' THEN 132 WHEN 'Unencrypted' THEN 128 WHEN 'DES-OFB' THEN 129 WHEN 'Unknown(0x9F)' THEN 159 ELSE 0 END AS algorithm_id,
        CASE name WHEN 'AES-256' THEN 'AES' WHEN 'Unencrypted' THEN 'CLEAR' WHEN 'DES-OFB' THEN 'DES' ELSE 'UNK' END AS short_name FROM (SELECT id, COALESCE(algorithm, CASE WHEN key_id = 3 THEN 'Mystery' ELSE 'Unknown(0x9F)' END) AS name FROM crypto)""",
)
def _(v):
    name = F.coalesce("algorithm", F.when(F.col("key_id") == 3, "Mystery").otherwise("Unknown(0x9F)"))
    c = v.crypto.select("id", name.alias("name"))
    alg = S.algorithm_id(F.col("name"), F.lit(True))
    return c.withColumn("algorithm_id", alg).withColumn("short_name", S.algorithm_short(F.col("algorithm_id")))


@query(
    "prj15_channel_frequency",
    """SELECT m.id, m.channel_id, m.channel_num, ROUND((p.base_hz + p.spacing_hz*m.channel_num)/1e6, 6) AS freq_mhz FROM msgs m LEFT JOIN LATERAL (
        SELECT * FROM params p WHERE p.channel_id = m.channel_id AND (p.timestamp_ns, p.id) <= (m.timestamp_ns, 9223372036854775807) ORDER BY p.timestamp_ns DESC, p.id DESC LIMIT 1) p ON TRUE""",
    """params AS (SELECT id, timestamp_ns, k % 6 AS channel_id, 851000000 + (k % 9)*12500 AS base_hz, 12500 AS spacing_hz FROM ev WHERE event_type = 'spectrum.detect' AND k % 6 < 5),
msgs AS (SELECT id, timestamp_ns, k % 6 AS channel_id, source_unit AS channel_num FROM ev WHERE event_type = 'protocol.p25.grant')""",
)
def _(v):
    k = F.col("k")
    params = v.ev.where((F.col("event_type") == "spectrum.detect") & (k % 6 < 5)).select(
        "id", "timestamp_ns", (k % 6).alias("channel_id"), (851000000 + (k % 9) * 12500).alias("base_hz"), F.lit(12500).alias("spacing_hz")
    )
    msgs = v.ev.where(F.col("event_type") == "protocol.p25.grant").select("id", "timestamp_ns", (k % 6).alias("channel_id"), F.col("source_unit").alias("channel_num"))
    found = asof_backward(msgs, params, ["channel_id"], "timestamp_ns", ["base_hz", "spacing_hz"], 3600 * 10**9)
    hz = F.col("match.base_hz") + F.col("match.spacing_hz") * F.col("channel_num")
    return found.select("id", "channel_id", "channel_num", F.round(hz / 1e6, 6).alias("freq_mhz"))
