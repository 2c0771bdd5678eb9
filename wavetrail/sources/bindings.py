"""Views of the domain (event log, grants, frames ...) over the given tables.

Each view exists twice: as a DataFrame for the engine and as a CTE for the
SQL that checks it. Production tables come through ``sources.readers``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fixed clock: every "now" of a live system is a parameter here.
AS_OF = "2024-01-31 00:00:00"
EPOCH = "2024-01-01 00:00:00"
AS_OF_NS = 1706659200 * 10**9
EPOCH_S = 1704067200
REC_AS_OF = "2001-11-04 00:00:00"


def ts_lit(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


class Views:
    """Bound views for one session and one data folder; built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return bind_event_log(self.table("events"))

    @cached_property
    def gr(self) -> DataFrame:
        """Channel grants."""
        return self.ev.where(F.col("event_type") == "protocol.p25.grant").select(
            "id",
            F.lit("SYS").alias("system"),
            F.col("talkgroup").alias("tgid"),
            F.col("source_unit").alias("uid"),
            F.col("freq_mhz").alias("voice_freq"),
            F.element_at(
                F.array(F.lit("group"), F.lit("group_update"), F.lit("unit")), (F.col("k") % 3 + 1).cast("int")
            ).alias("grant_type"),
            "ts",
            "timestamp_ns",
            (1 + F.col("k") % 2).alias("operation_id"),
            "k",
        )

    @cached_property
    def tg(self) -> DataFrame:
        """Network talkgroups."""
        n = F.col("n_nationkey").cast("long")
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self.table("nation").join(region, "n_regionkey").select(
            (1001 + n).alias("tgid"),
            F.lit("SYS").alias("system"),
            F.col("n_name").alias("name"),
            F.when(n % 8 != 7, F.col("r_name")).alias("department"),
            F.when(n % 3 == 0, "encrypted").when(n % 3 == 1, "clear").otherwise("mixed").alias("encrypted"),
            (n % 4).alias("priority"),
            (n % 2).alias("scan_enabled"),
        )

    @cached_property
    def ss(self) -> DataFrame:
        """Site sessions, the open ones with a NULL end."""
        s = F.col("s_suppkey")
        start = EPOCH_S + (s * 37 % 696) * 3600
        return self.table("supplier").select(
            s.alias("id"),
            (s % 10).alias("site_id"),
            F.timestamp_seconds(start).alias("start_time"),
            F.when(s % 33 != 0, F.timestamp_seconds(start + 18 * 3600)).alias("end_time"),
        )

    @cached_property
    def hits(self) -> DataFrame:
        """Traffic hits: spectrum detections with their channel."""
        return self.ev.where(F.col("event_type") == "spectrum.detect").select(
            "id", "k", "freq_mhz", "power", "ts", "timestamp_ns",
            (F.col("k") % 40).alias("channel_id"),
            "encrypted",
            F.lit("NFM").alias("modulation"),
            "source_unit", "band", "classification", "device_key", "talkgroup",
        )

    @cached_property
    def crypto(self) -> DataFrame:
        """Crypto metadata messages."""
        k = F.col("k")
        return self.ev.where(F.col("event_type").startswith("protocol.p25.")).select(
            "id",
            F.lit("SYS").alias("system"),
            F.col("talkgroup").alias("tgid"),
            F.col("source_unit").alias("uid"),
            "freq_mhz", "ts", "timestamp_ns",
            F.col("encrypted").alias("encrypted_flag"),
            F.when(k % 4 == 0, "AES-256").when(k % 4 == 1, "Unencrypted").when(k % 4 == 2, "DES-OFB").alias("algorithm"),
            F.when(k % 10 != 0, k % 5).alias("key_id"),
        )

    @cached_property
    def channels(self) -> DataFrame:
        """Forty catalogue channels (a fixed dimension)."""
        i = F.col("id")
        return self.spark.range(40).select(
            i.alias("channel_id"),
            F.round(150 + i * 0.0125 + 0.003, 4).alias("channel_freq"),
            F.concat(F.lit("CH-"), i).alias("label"),
            F.when(i % 3 == 0, "PUBS").when(i % 3 == 1, "COMM").otherwise("FEDL").alias("channel_cls"),
        )

    @cached_property
    def actors(self) -> DataFrame:
        """Actors with their radio id and organisation."""
        return self.table("customer").select(
            F.col("c_custkey").alias("actor_id"),
            F.col("c_custkey").alias("radio_id"),
            F.col("c_name").alias("callsign"),
            F.col("c_nationkey").cast("long").alias("organization_id"),
        )

    @cached_property
    def orgs(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("organization_id"), F.col("n_name").alias("org_name")
        )

    @cached_property
    def rec(self) -> DataFrame:
        """Recordings and clips."""
        p = F.col("l_partkey")
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
            F.when(F.col("l_linestatus") == "O", "audio").otherwise("iq").alias("rec_type"),
            F.when(F.col("l_returnflag") == "A", "auto_p25")
            .when(F.col("l_returnflag") == "R", "auto_squelch")
            .otherwise("manual").alias("trigger_type"),
            (1001 + p % 25).alias("tgid"),
            F.col("l_suppkey").alias("source_unit"),
            F.round(150 + (p % 40) * 0.0125, 4).alias("freq_mhz"),
            F.floor(F.col("l_extendedprice")).cast("long").alias("file_size_bytes"),
            F.col("l_quantity").alias("duration_sec"),
            F.col("l_shipdate").cast("timestamp").alias("start_time"),
            (F.col("l_suppkey") % 10).alias("site_id"),
            (p % 3 == 0).alias("encrypted"),
        )

    @cached_property
    def pdw(self) -> DataFrame:
        """Pulse descriptor words, one emitter per user."""
        return self.ev.select(
            "id",
            F.col("source_unit").alias("emitter"),
            ((F.col("timestamp_ns") - EPOCH_S * 10**9) / F.lit(1e9)).alias("toa"),
            "timestamp_ns",
            (-F.col("power")).alias("pw_us"),
            F.round(2700 + (F.col("k") % 4) * 0.1, 1).alias("freq_mhz"),
        )

    @cached_property
    def psd(self) -> DataFrame:
        """PSD frames of 64 bins."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("frame_id"),
            F.col("label").cast("long").alias("sensor"),
            (EPOCH_S + F.col("vec_id")).alias("t_s"),
            (150e6 + F.col("label") * 64e3).alias("tile_center_hz"),
            F.lit(1e3).alias("bin_hz"),
            F.transform("embedding", lambda x: -70 + 60 * x.cast("double")).alias("psd"),
        )

    @cached_property
    def iq(self) -> DataFrame:
        """Dwells: even elements are I, odd ones Q."""
        e = F.col("embedding")
        half = F.sequence(F.lit(0), (F.size(e) / 2 - 1).cast("int"))
        return self.table("embeddings").select(
            F.col("vec_id").alias("dwell_id"),
            F.col("label").cast("long").alias("sensor"),
            F.transform(half, lambda j: F.get(e, 2 * j).cast("double")).alias("i"),
            F.transform(half, lambda j: F.get(e, 2 * j + 1).cast("double")).alias("q"),
        )

    @cached_property
    def fp(self) -> DataFrame:
        """Fingerprint captures."""
        e = F.col("embedding")
        v = F.col("vec_id")
        return self.table("embeddings").select(
            v.alias("capture_id"),
            (100 * F.get(e, F.lit(0)).cast("double")).alias("cfo_hz"),
            F.abs(F.get(e, F.lit(1)).cast("double")).alias("iq_amplitude_imbal"),
            F.abs(F.get(e, F.lit(2)).cast("double")).alias("iq_phase_imbal"),
            F.round(10 * F.get(e, F.lit(3)).cast("double"), 6).alias("avg_power_db"),
            F.abs(F.get(e, F.lit(4)).cast("double")).alias("power_variance"),
            F.round(150 + (v % 40) * 0.0125, 4).alias("freq_mhz"),
            F.timestamp_seconds(EPOCH_S + v * 3600).alias("ts"),
            ((EPOCH_S + v * 3600) * 10**9).alias("timestamp_ns"),
        )


def bind_event_log(events: DataFrame) -> DataFrame:
    """Event log rows from the raw events table; also runs on a stream."""
    base = events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("_t"),
        "user_id", "value", "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    t, k = F.col("_t"), F.col("k")
    ns = F.unix_micros("ts") * 1000
    return base.select(
        "id", "ts",
        ns.alias("timestamp_ns"),
        (ns - ns % 30000000000).alias("ts_bucket"),
        F.when(t == "click", "protocol.p25.voice")
        .when(t == "signup", "protocol.p25.grant")
        .when(t == "purchase", "spectrum.detect")
        .when(t == "error", "sigex.emitter.new")
        .when(t == "view", "protocol.p25.update").alias("event_type"),
        F.when(t == "error", 11).when(t == "view", 5).when(t == "click", 1).otherwise(9).alias("severity"),
        F.when(t == "purchase", 0).when(t == "error", 2).otherwise(1).alias("source"),
        F.concat(t, F.lit(" uid "), F.col("user_id")).alias("body"),
        F.round(150 + (k % 40) * 0.0125, 4).alias("freq_mhz"),
        (1001 + k % 25).alias("talkgroup"),
        F.col("user_id").alias("source_unit"),
        F.when(k % 10 != 0, F.lit(659).cast("long")).alias("nac"),
        F.when(k % 10 != 0, k % 4 == 0).alias("encrypted"),
        F.when(k % 3 == 0, "VHF").when(k % 3 == 1, "UHF").otherwise("P25").alias("band"),
        F.concat(F.lit("dev-"), k % 2).alias("device_key"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 7 == 0, "FEDL").when(k % 7 < 3, "PUBS").otherwise("COMM")
        .alias("classification"),
        F.when(t == "click", F.when(F.col("id") % 5 == 0, "TLC").otherwise("LDU1"))
        .alias("duid"),
        (-F.col("value")).alias("power"),
        F.col("props").alias("attributes"),
        "k",
    )


VIEW_SQL = """
ev AS (
  SELECT event_id AS id, ts, epoch_us(ts)*1000 AS timestamp_ns,
    epoch_us(ts)*1000 - (epoch_us(ts)*1000) % 30000000000 AS ts_bucket,
    CASE t WHEN 'click' THEN 'protocol.p25.voice' WHEN 'signup' THEN 'protocol.p25.grant'
           WHEN 'purchase' THEN 'spectrum.detect' WHEN 'error' THEN 'sigex.emitter.new'
           WHEN 'view' THEN 'protocol.p25.update' END AS event_type,
    CASE t WHEN 'error' THEN 11 WHEN 'view' THEN 5 WHEN 'click' THEN 1 ELSE 9 END AS severity,
    CASE t WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS source,
    concat(t, ' uid ', user_id) AS body,
    ROUND(150 + (k % 40)*0.0125e0, 4) AS freq_mhz,
    1001 + k % 25 AS talkgroup, user_id AS source_unit,
    CASE WHEN k % 10 <> 0 THEN 659::BIGINT END AS nac,
    CASE WHEN k % 10 <> 0 THEN k % 4 = 0 END AS encrypted,
    CASE k % 3 WHEN 0 THEN 'VHF' WHEN 1 THEN 'UHF' ELSE 'P25' END AS band,
    concat('dev-', k % 2) AS device_key,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 7 = 0 THEN 'FEDL' WHEN k % 7 < 3 THEN 'PUBS' ELSE 'COMM' END AS classification,
    CASE WHEN t = 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'TLC' ELSE 'LDU1' END END AS duid,
    -value AS power, props AS attributes, k
  FROM (SELECT *, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
gr AS (
  SELECT id, 'SYS' AS system, talkgroup AS tgid, source_unit AS uid, freq_mhz AS voice_freq,
    CASE k % 3 WHEN 0 THEN 'group' WHEN 1 THEN 'group_update' ELSE 'unit' END AS grant_type,
    ts, timestamp_ns, 1 + k % 2 AS operation_id, k
  FROM ev WHERE event_type = 'protocol.p25.grant'),
tg AS (
  SELECT 1001 + n::BIGINT AS tgid, 'SYS' AS system, n_name AS name,
    CASE WHEN n % 8 <> 7 THEN r_name END AS department,
    CASE n % 3 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'clear' ELSE 'mixed' END AS encrypted,
    (n % 4)::BIGINT AS priority, (n % 2)::BIGINT AS scan_enabled
  FROM (SELECT *, n_nationkey AS n FROM nation) JOIN region ON n_regionkey = r_regionkey),
ss AS (
  SELECT s_suppkey AS id, s_suppkey % 10 AS site_id, start_time,
    CASE WHEN s_suppkey % 33 <> 0 THEN start_time + INTERVAL 18 HOUR END AS end_time
  FROM (SELECT s_suppkey, TIMESTAMP '2024-01-01' + to_hours((s_suppkey*37 % 696)::INTEGER) AS start_time FROM supplier)),
hits AS (
  SELECT id, k, freq_mhz, power, ts, timestamp_ns, k % 40 AS channel_id, encrypted, 'NFM' AS modulation,
    source_unit, band, classification, device_key, talkgroup
  FROM ev WHERE event_type = 'spectrum.detect'),
crypto AS (
  SELECT id, 'SYS' AS system, talkgroup AS tgid, source_unit AS uid, freq_mhz, ts, timestamp_ns, encrypted AS encrypted_flag,
    CASE k % 4 WHEN 0 THEN 'AES-256' WHEN 1 THEN 'Unencrypted' WHEN 2 THEN 'DES-OFB' END AS algorithm,
    CASE WHEN k % 10 <> 0 THEN k % 5 END AS key_id
  FROM ev WHERE event_type LIKE 'protocol.p25.%'),
channels AS (
  SELECT i AS channel_id, ROUND(150 + i*0.0125e0 + 0.003e0, 4) AS channel_freq, concat('CH-', i) AS label,
    CASE i % 3 WHEN 0 THEN 'PUBS' WHEN 1 THEN 'COMM' ELSE 'FEDL' END AS channel_cls
  FROM range(40) AS r(i)),
actors AS (
  SELECT c_custkey AS actor_id, c_custkey AS radio_id, c_name AS callsign, c_nationkey::BIGINT AS organization_id FROM customer),
orgs AS (SELECT n_nationkey::BIGINT AS organization_id, n_name AS org_name FROM nation),
rec AS (
  SELECT l_orderkey*100 + l_linenumber AS id, CASE l_linestatus WHEN 'O' THEN 'audio' ELSE 'iq' END AS rec_type,
    CASE l_returnflag WHEN 'A' THEN 'auto_p25' WHEN 'R' THEN 'auto_squelch' ELSE 'manual' END AS trigger_type,
    1001 + l_partkey % 25 AS tgid, l_suppkey AS source_unit,
    ROUND(150 + (l_partkey % 40)*0.0125e0, 4) AS freq_mhz, CAST(floor(l_extendedprice) AS BIGINT) AS file_size_bytes,
    l_quantity AS duration_sec, l_shipdate AS start_time, l_suppkey % 10 AS site_id, l_partkey % 3 = 0 AS encrypted
  FROM lineitem),
pdw AS (
  SELECT id, source_unit AS emitter, (timestamp_ns - 1704067200000000000) / 1e9 AS toa, timestamp_ns,
    -power AS pw_us, ROUND(2700 + (k % 4)*0.1e0, 1) AS freq_mhz FROM ev),
psd AS (
  SELECT vec_id AS frame_id, label::BIGINT AS sensor, 1704067200 + vec_id AS t_s, 150e6 + label*64e3 AS tile_center_hz,
    1e3 AS bin_hz, list_transform(embedding, lambda x: -70 + 60*x::DOUBLE) AS psd FROM embeddings),
bins AS (
  SELECT frame_id, sensor, t_s, tile_center_hz, bin_hz, len(psd) AS n, i::BIGINT AS bin, psd[i+1] AS db
  FROM psd, LATERAL (SELECT unnest(range(len(psd))) AS i)),
iq AS (
  SELECT vec_id AS dwell_id, label::BIGINT AS sensor, j::BIGINT AS n, embedding[2*j+1]::DOUBLE AS i, embedding[2*j+2]::DOUBLE AS q
  FROM embeddings, LATERAL (SELECT unnest(range(len(embedding)//2)) AS j)),
fp AS (
  SELECT vec_id AS capture_id, 100*embedding[1]::DOUBLE AS cfo_hz, abs(embedding[2]::DOUBLE) AS iq_amplitude_imbal,
    abs(embedding[3]::DOUBLE) AS iq_phase_imbal, ROUND(10*embedding[4]::DOUBLE, 6) AS avg_power_db,
    abs(embedding[5]::DOUBLE) AS power_variance, ROUND(150 + (vec_id % 40)*0.0125e0, 4) AS freq_mhz,
    TIMESTAMP '2024-01-01' + to_hours(vec_id::INTEGER) AS ts, (1704067200 + vec_id*3600)*1000000000 AS timestamp_ns
  FROM embeddings)
"""
