"""Recordings by ranges, atomic changes of the log, detections stored once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetrail.plans.events import CUT_NS
from wavetrail.sources import iq, sinks
from wavetrail.sources.log_table import LogTable
from wavetrail.streaming import jobs as J


def test_long_recordings_are_cut_into_ranges(spark, tmp_path):
    z = np.random.default_rng(1).normal(size=(10_000, 2)).astype("<f4")
    z.tofile(tmp_path / "long.iq")
    (tmp_path / "odd.iq").write_bytes(z[:500].tobytes() + b"abc")
    (tmp_path / "short.iq").write_bytes(z[:3].tobytes())
    (tmp_path / "empty.iq").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no samples")
    rows = iq.iq_ranges(spark, str(tmp_path), pairs_per_row=64, range_bytes=1024)
    assert rows.rdd.getNumPartitions() == 79 + 4 + 1  # of two rows each
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.part, r.enough_samples, np.stack([r.i, r.q], 1)))
    assert set(got) == {"long.iq", "odd.iq", "short.iq"}
    for name, n, enough in (("long.iq", 10_000, True), ("odd.iq", 500, True), ("short.iq", 3, False)):
        parts = sorted(got[name], key=lambda p: p[0])
        assert [p[0] for p in parts] == list(range(-(-n // 64))) and all(p[1] == enough for p in parts)
        assert np.array_equal(np.concatenate([p[2] for p in parts]), z[:n].astype(float))
    one = iq.iq_ranges(spark, str(tmp_path / "short.iq"))
    assert one.count() == 1


def test_recordings_round_trip(spark, tmp_path):
    dwells = spark.range(40).select(F.concat(F.lit("r"), F.col("id") % 3).alias("name"), "id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("i"), F.array(F.lit(-1.0), F.col("id") * 2.0).alias("q"))
    iq.write_recordings(dwells, str(tmp_path / "rec"), "name", ["id"])
    assert sorted(p.name for p in (tmp_path / "rec").iterdir()) == ["r0.iq", "r1.iq", "r2.iq"]
    got = iq.iq_ranges(spark, str(tmp_path / "rec"), pairs_per_row=2).orderBy("path", "part").collect()
    assert [(r.i, r.q) for r in got if r.path.endswith("r1.iq")] == [([float(k), 0.5], [-1.0, 2.0 * k]) for k in range(1, 40, 3)]


@pytest.fixture
def log(spark, views, tmp_path):
    table = LogTable(spark, str(tmp_path / "log"), views.ev.schema)
    table.append(views.ev.where("id % 2 = 0"))
    table.append(views.ev.where("id % 2 = 1"))
    return table


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_purge_is_seen_as_a_whole_or_not_at_all(views, log, monkeypatch):
    everything = ids(views.ev)
    assert ids(log.read()) == everything
    commit = log._commit
    monkeypatch.setattr(log, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.purge(CUT_NS)  # stops after the kept rows of the cut day are written
    assert ids(log.read()) == everything
    monkeypatch.setattr(log, "_commit", commit)
    log.purge(CUT_NS)
    kept = ids(sinks.kept_after_purge(views.ev, CUT_NS))
    assert ids(log.read()) == kept and len(kept) < len(everything)
    log.purge(CUT_NS)
    assert ids(log.read()) == kept
    assert log.vacuum() and ids(log.read()) == kept and log.vacuum() == []


def test_days_prune_and_an_empty_log_is_empty(spark, views, log, tmp_path):
    day = views.ev.select(F.to_date("ts").alias("d")).groupBy("d").count().orderBy("d").first()
    assert log.read(day.d, day.d).count() == day["count"]
    empty = LogTable(spark, str(tmp_path / "none"), views.ev.schema)
    assert empty.read().count() == 0 and "event_date" in empty.read().columns


def test_detections_are_stored_once_over_batches(spark, tmp_path):
    rows = [(1, 0, 10, 100.0), (1, 0, 10, 100.0), (1, 1, 10, 100.0), (1, 0, 7200, 5.0)]
    again = [(1, 0, 10, 100.0), (1, 0, 11, 100.0), (1, 0, 7200, 5.0), (2, 0, 10, 100.0)]
    schema = "mission_id int, sensor int, t_s long, center_hz double"
    for part in (rows, again):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = J.read_stream(spark, f"{tmp_path}/in", 1, spark.createDataFrame([], schema).schema)
    J.run_to_end(J.merge_once(stream, f"{tmp_path}/out", lambda b: b), f"{tmp_path}/cp")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("mission_id", "sensor", "t_s", "center_hz").collect())
    want = sorted(set(rows) | set(again))
    assert read() == want
    # both batches once more, as after a lost checkpoint
    J.run_to_end(J.merge_once(stream, f"{tmp_path}/out", lambda b: b), f"{tmp_path}/cp2")
    assert read() == want
