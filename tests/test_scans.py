"""Ordered scans, greedy rules and state machines against plain Python loops."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from wavetrail.operators import emitters as E
from wavetrail.operators import geofence as G
from wavetrail.operators import history as H
from wavetrail.operators import ordered as O
from wavetrail.operators.harmonics import suppress_repeats
from wavetrail.operators.joins import asof_backward
from wavetrail.operators import spacing
from wavetrail.operators.spacing import spaced_rows

NS = 10**9
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def hot_rows(seed, n=400, span=4000):
    """One key holds most rows."""
    rnd = random.Random(seed)
    return [(i, 1 if rnd.random() < 0.7 else rnd.randint(2, 5), rnd.randint(0, span) * NS) for i in range(n)]


@pytest.mark.parametrize("width", [50 * NS, 700 * NS, 10**6 * NS])
def test_previous_and_position_do_not_depend_on_slices(spark, width):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "id long, key long, t long")
    got = {r.id: r.prev and r.prev.id for r in O.with_previous(df, ["key"], ["t", "id"], ["id"], width).collect()}
    pos = {r.id: r.pos for r in O.with_position(df, ["key"], ["t", "id"], width).collect()}
    last, count = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == last.get(key)
        count[key] = count.get(key, 0) + 1
        assert pos[i] == count[key]
        last[key] = i


@FEW
@given(times=st.lists(st.integers(0, 300), min_size=1, max_size=60), gap=st.integers(1, 20), width=st.integers(5, 80))
def test_gap_sessions(spark, times, gap, width):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "id long, key long, t long")
    got = O.gap_sessions(df, ["key"], "t", gap, {"n": F.count(F.lit(1))}, {"n": F.sum}, width=width)
    want, run = [], []
    for t in sorted(times):
        if run and t - run[-1] > gap:
            want.append((run[0], run[-1], len(run)))
            run = []
        run.append(t)
    want.append((run[0], run[-1], len(run)))
    assert sorted((r.start_t, r.end_t, r.n) for r in got.collect()) == want


@FEW
@given(spans=st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60)), min_size=1, max_size=30), width=st.integers(7, 90))
def test_merge_intervals(spark, spans, width):
    df = spark.createDataFrame([(1, a, a + d) for a, d in spans], "key long, s long, e long")
    want = []
    for a, b in sorted((a, a + d) for a, d in spans):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], b))
        else:
            want.append((a, b))
    assert sorted((r.s, r.e) for r in O.merge_intervals(df, ["key"], "s", "e", width).collect()) == want


@FEW
@given(
    values=st.lists(st.integers(0, 500), min_size=1, max_size=150), distance=st.integers(1, 200), rows=st.integers(1, 9), block=st.integers(1, 4),
    strict=st.booleans(),
)
def test_spaced_rows(spark, values, distance, rows, block, strict):
    """Slices of a few rows, also where the distance spans many of them."""
    df = spark.createDataFrame([(v % 2, v) for v in values], "key long, v long")
    want = []
    for key in (0, 1):
        last = None
        for v in sorted({v for v in values if v % 2 == key}):
            if last is None or (v - last > distance if strict else v - last >= distance):
                want.append(v)
                last = v
    before = spacing.SLICE_ROWS, spacing.BLOCK
    try:
        spacing.SLICE_ROWS, spacing.BLOCK = rows, block
        got = sorted(r.v for r in spaced_rows(df, "key", "v", distance, strict).collect())
    finally:
        spacing.SLICE_ROWS, spacing.BLOCK = before
    assert got == sorted(want)


def test_a_key_with_all_rows_in_one_hour_is_cut_by_rows(spark):
    """A third of a million matches of one rule within an hour: no slice holds more than the stated number of values."""
    df = spark.range(400_000).select(F.lit(7).alias("key"), (F.col("id") * 9_000_000).alias("v"))
    assert sorted(r.v for r in spaced_rows(df, "key", "v", 60 * NS).collect())[:3] == [0, 60_003_000_000, 120_006_000_000]
    ranged = df.repartitionByRange("key", "v").sortWithinPartitions("key", "v")
    slices = ranged.mapInArrow(spacing._cut("key", "v", pa.int64()), "key int, _first long, _values array<bigint>")
    sizes = [r.n for r in slices.select(F.size("_values").alias("n")).collect()]
    assert max(sizes) <= spacing.SLICE_ROWS and sum(sizes) == 400_000 and len(sizes) >= 7


def test_spaced_rows_keeps_nanoseconds(spark):
    base = 1_706_000_000_000_000_001
    df = spark.createDataFrame([(1, base), (1, base + 60 * NS - 1), (1, base + 60 * NS)], "key long, v long")
    assert sorted(r.v for r in spaced_rows(df, "key", "v", 60 * NS).collect()) == [base, base + 60 * NS]


def trace_loop(rows, gap):
    """Grants open, terminators close, silence closes; the rest attach."""
    open_, out = {}, {}
    for i, t, kind, duid, key in sorted(rows, key=lambda r: (r[1], r[0])):
        s = open_.get(key)
        if s and t - s[1] > gap:
            s = open_[key] = None
        if kind == H.GRANT:
            s = open_[key] = [i, t, 0]
        if s:
            s[1], s[2] = t, s[2] + 1
            out[i] = (s[0], s[2])
            if kind == "protocol.p25.voice" and duid == "TLC":
                open_[key] = None
        else:
            out[i] = (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_traces(spark, seed):
    rnd = random.Random(seed)
    kinds = [H.GRANT, "protocol.p25.voice", "protocol.p25.voice", "protocol.p25.update"]
    rows = [
        (i, rnd.randint(0, 600) * NS, k, rnd.choice(["TLC", "LDU1", "LDU1"]) if k.endswith("voice") else None, rnd.choice([1, 1, 1, 2]))
        for i, k in enumerate(rnd.choices(kinds, k=300))
    ]
    df = spark.createDataFrame([(i, t, k, d, key, 851.0125) for i, t, k, d, key in rows], "id long, timestamp_ns long, event_type string, duid string, talkgroup long, freq_mhz double")
    want = trace_loop(rows, 5 * NS)
    got = {r.id: (r.trace_id, r.span_id) for r in H.assign_traces(df, 5 * NS, 37 * NS).collect()}
    assert got == want


def test_asof_inherits_across_slices(spark):
    left = spark.createDataFrame([(1, 1, 5 * NS), (2, 1, 50 * NS), (3, 2, 50 * NS), (4, 1, 1 * NS)], "id long, key long, t long")
    right = spark.createDataFrame([(7, 1, 2 * NS, "a"), (8, 1, 5 * NS, "b")], "id long, key long, t long, v string")
    got = {r.id: r.match and r.match.v for r in asof_backward(left, right, ["key"], "t", ["v"], 3 * NS).collect()}
    assert got == {1: "b", 2: "b", 3: None, 4: None}


def test_emitters_are_claimed_in_order_of_arrival(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 500), round(100 + rnd.random() * 6, 3)) for _ in range(300)]
    got = {r.emitter_mhz: (r.first_s, r.last_s, r.hits) for r in E.claim_emitters(spark.createDataFrame(rows, "t_s long, freq_mhz double"), 0.5).collect()}
    first = {}
    for t, f in rows:
        first[f] = min(first.get(f, t), t)
    known, owner = [], {}
    for f in sorted(first, key=lambda f: (first[f], f)):
        near = [e for e in known if abs(e - f) < 0.5]
        owner[f] = near[0] if near else f
        if not near:
            known.append(f)
    want = {}
    for t, f in rows:
        a, b, n = want.get(owner[f], (t, t, 0))
        want[owner[f]] = (min(a, t), max(b, t), n + 1)
    assert got == want


def test_harmonic_groups_are_not_repeated(spark):
    rnd = random.Random(9)
    rows = [(1, t, i, round(rnd.choice([10.0, 10.4, 12.0, 30.0]) + rnd.random(), 3)) for i, t in enumerate(sorted(rnd.randint(0, 900) for _ in range(200)))]
    got = sorted((r.t_s, r.frame_id, r.fundamental_mhz) for r in suppress_repeats(spark.createDataFrame(rows, "sensor long, t_s long, frame_id long, fundamental_mhz double"), 1.0, 60).collect())
    kept = []
    for _, t, i, f in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if not any(t2 > t - 60 and abs(f2 - f) < 1.0 for t2, _, f2 in kept):
            kept.append((t, i, f))
    assert got == sorted(kept)


def test_geofence_hysteresis(spark):
    sites = spark.createDataFrame([(1, 45.0, -122.0, 500.0), (2, 45.02, -122.0, 500.0)], "site_id long, lat double, lon double, radius_m double")
    lats = [44.9, 45.001, 45.006, 45.012, 45.02, 45.021, 45.5, 45.0]
    rows = [(i, 9, i * 10 * NS, lat, -122.0) for i, lat in enumerate(lats)]
    df = spark.createDataFrame(rows, "id long, device long, timestamp_ns long, lat double, lon double")
    for width in (15 * NS, 1000 * NS):
        got = [(r.id, r.change, r.site_id) for r in G.site_visits(df, sites, width).orderBy("timestamp_ns").collect()]
        # 45.006 lies between one and two radii: still inside. The tick that leaves does not enter.
        assert got == [(1, "enter", 1), (3, "exit", 1), (4, "enter", 2), (6, "exit", 2), (7, "enter", 1)]


def test_pri_patterns(spark):
    rows, i = [], 0
    plan = {1: [1000.0] * 8, 2: [1000.0, 1030.0] * 4, 3: [1000.0, 1500.0, 2000.0] * 3, 4: [1000.0, 3000.0, 1700.0, 900.0, 5000.0, 100.0, 2500.0], 5: [1000.0, 1000.0]}
    for emitter, pris in plan.items():
        for pri in pris:
            rows.append((i, emitter, i * NS, pri))
            i += 1
    df = spark.createDataFrame(rows, "id long, emitter long, timestamp_ns long, pri_us double")
    got = {r.emitter: r.pattern for r in E.pri_patterns(df, 3 * NS).collect()}
    assert got == {1: "Stable", 2: "Jitter", 3: "Stagger", 4: "Agile", 5: "Insufficient"}


def test_exponential_average(spark):
    from wavetrail.operators.spectrum import running_average

    lines = np.random.default_rng(1).normal(-80, 5, (12, 4))
    rows = [(i, 1, i * 100, 1e8, 1e3, lines[i].tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "frame_id long, sensor long, t_s long, tile_center_hz double, bin_hz double, psd array<double>")
    want = lines[0]
    for x in lines[1:]:
        want = 0.3 * x + 0.7 * want
    got = [r.avg_db for r in running_average(df, 0.3).orderBy("bin").collect()]
    assert np.allclose(got, want)


def test_nearest_measures_to_the_exact_catalogue_value(spark):
    from wavetrail.operators.joins import nearest_in_catalogue

    catalogue = spark.createDataFrame([(1, 150.00001), (2, 150.00004), (3, 150.00004), (4, None)], "cid int, at double")
    probes = spark.createDataFrame([(1, 150.00004), (2, 150.0), (3, 151.0)], "id int, f double")
    got = {r.id: (r.cid, r.at) for r in nearest_in_catalogue(probes, "f", catalogue, "at", ["cid"], 0.015).collect()}
    assert got == {1: (2, 150.00004), 2: (1, 150.00001), 3: (None, None)}


def test_geofence_missing_positions_date_line_and_idle_runs(spark):
    from wavetrail.operators import geofence as G

    sites = spark.createDataFrame([(1, 60.0, 179.999, 400.0), (2, 60.0, -179.0, 900.0)], "site_id long, lat double, lon double, radius_m double")
    track = [(60.0, 179.9985), (None, 179.9985), (60.0, None), (60.0, -179.9995), *[(60.0, 179.999)] * 6, (60.0, 179.5), (60.0, 179.5), (60.0, -179.0), *[(61.0, 0.0)] * 4]
    rows = [(i, "d", i, lat, lon) for i, (lat, lon) in enumerate(track)]
    df = spark.createDataFrame(rows, "id long, device string, timestamp_ns long, lat double, lon double")
    want = [(0, "enter", 1), (10, "exit", 1), (12, "enter", 2), (13, "exit", 2)]
    for width in (3, 1000):
        assert [(r.id, r.change, r.site_id) for r in G.site_visits(df, sites, width).orderBy("timestamp_ns").collect()] == want
