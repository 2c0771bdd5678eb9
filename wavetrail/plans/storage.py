"""Recordings by byte ranges, the log with atomic changes, detections stored once: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail.operators import spectrum as X
from wavetrail.plans.events import CUT_NS
from wavetrail.plans.registry import query
from wavetrail.plans.spectrum import CFAR_CTE, G as GUARD, MERGE, MERGE_CTE, PFA, T as TRAIN
from wavetrail.plans.streams import frame_stream, scratch
from wavetrail.sources import iq
from wavetrail.sources.log_table import LogTable
from wavetrail.streaming import jobs as J

#: Dwells of a sensor that are joined into one recording.
DWELLS = 64


@query(
    "src06_iq_ranges",
    f"""SELECT concat('rec-', sensor, '-', dwell_id // {DWELLS}) AS recording, COUNT(*) AS pairs, ROUND(SUM(i), 4) AS sum_i, ROUND(SUM(q), 4) AS sum_q,
        ROUND(AVG(i*i + q*q), 6) AS power, COUNT(*) >= 480 AS enough_samples FROM iq GROUP BY 1""",
)
def _(v):
    path = scratch(v, "src06")
    name = F.concat(F.lit("rec-"), "sensor", F.lit("-"), F.expr(f"dwell_id div {DWELLS}"))
    iq.write_recordings(v.iq.select(name.alias("recording"), "dwell_id", "i", "q"), path, "recording", ["dwell_id"])
    rows = iq.iq_ranges(v.spark, path, pairs_per_row=128, range_bytes=4096)
    pairs = rows.select("path", "enough_samples", F.inline(F.arrays_zip("i", "q")))
    return pairs.groupBy(F.regexp_extract("path", r"([^/]+)\.iq$", 1).alias("recording")).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.sum("i"), 4).alias("sum_i"), F.round(F.sum("q"), 4).alias("sum_q"),
        F.round(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q")), 6).alias("power"), F.min("enough_samples").alias("enough_samples"),
    )


@query(
    "snk04b_purge_commit",
    f"SELECT id, timestamp_ns, event_type FROM ev WHERE NOT (ts_bucket < {CUT_NS} - {CUT_NS} % 30000000000 AND timestamp_ns < {CUT_NS})",
)
def _(v):
    log = LogTable(v.spark, scratch(v, "snk04"), v.ev.schema)
    log.append(v.ev.where("id % 3 = 0"))
    log.append(v.ev.where("id % 3 <> 0"))
    log.purge(CUT_NS)
    return log.read().select("id", "timestamp_ns", "event_type")


@query(
    "snk03b_detections_once",
    "SELECT 1 AS mission_id, sensor, t_s, ROUND(center_hz, 4) AS center_hz, ROUND(snr_db, 6) AS snr_db FROM merged",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    """The frames come twice: their detections are stored once."""
    path = scratch(v, "snk03b")
    found = lambda f: X.detect(f, TRAIN, GUARD, PFA, 6.0, MERGE).withColumn("mission_id", F.lit(1))
    frames = frame_stream(v)
    for run in ("first", "again"):  # the second stream delivers all frames once more
        start = 0 if run == "first" else 1
        J.run_to_end(J.merge_once(frames.unionByName(frames), f"{path}/detections", found, first_batch=start), f"{path}/checkpoint-{run}")
    rows = v.spark.read.parquet(f"{path}/detections")
    return rows.select("mission_id", "sensor", "t_s", F.round("center_hz", 4).alias("center_hz"), F.round("snr_db", 6).alias("snr_db"))
