"""Literal inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetrail.functions import frames as A
from wavetrail.functions import scalars as S
from wavetrail.operators import alerts as W
from wavetrail.operators import emitters as E
from wavetrail.operators import filters as P
from wavetrail.operators import history as H
from wavetrail.operators import messages as M
from wavetrail.operators import spectrum as X
from wavetrail.operators.query import Aggregation, EventQuery
from wavetrail.operators.rules import Rule, load_rules, rule_table
from wavetrail.sources import readers

NS = 10**9


def frame(spark, psd, center=100e6, width=1e3):
    return spark.createDataFrame(
        [(1, 1, 0, center, width, [float(x) for x in psd])],
        "frame_id long, sensor long, t_s long, tile_center_hz double, bin_hz double, psd array<double>",
    )


def level(n, db, **groups):
    psd = np.full(n, float(db))
    for value, (a, b) in groups.items():
        psd[a: b + 1] = -float(value[1:])
    return psd


def test_cfar_finds_one_peak(spark):
    got = X.detect(frame(spark, level(1024, -90, m40=(698, 702)))).collect()
    assert len(got) == 1
    at = (got[0].center_hz - (100e6 - 512e3)) / 1e3 - 0.5
    assert abs(at - 700) <= 2 and got[0].snr_db > 40 and 1e3 <= got[0].bandwidth_hz <= 12e3


def test_cfar_flat_noise_gives_nothing(spark):
    assert X.detect(frame(spark, level(2048, -85))).count() == 0


def test_cfar_merges_close_fragments(spark):
    psd = level(1024, -95, m40=(500, 503))
    psd[516:520] = -40
    assert X.detect(frame(spark, psd)).count() == 1


def test_cfar_keeps_two_signals(spark):
    psd = level(1024, -95, m50=(300, 303))
    psd[700:704] = -45
    assert X.detect(frame(spark, psd)).count() == 2


def test_cfar_against_plain_loop(spark):
    rng = np.random.default_rng(3)
    train, guard, pfa = 6, 2, 1e-2
    for _ in range(3):
        psd = rng.normal(-80, 4, 200)
        psd[rng.integers(10, 190, 5)] += 25
        lin = 10 ** (psd / 10)
        alpha = A.cfar_alpha(train, pfa)
        reach = train + guard
        flags = []
        for i in range(reach, 200 - reach):
            m = (lin[i - reach: i - guard].sum() + lin[i + guard + 1: i + reach + 1].sum()) / (2 * train)
            if lin[i] > m * alpha:
                flags.append(i)
        want, run = [], []
        for i in flags:
            if run and i - run[-1] > 3:
                want.append((run[0], run[-1]))
                run = []
            run.append(i)
        if run:
            want.append((run[0], run[-1]))
        got = X.cfar_clusters(frame(spark, psd), train, guard, pfa, -1000.0).orderBy("first").collect()
        assert [(r["first"], r["last"]) for r in got] == want


def tone(spark, n, k):
    z = np.exp(2j * np.pi * k * np.arange(n) / n)
    return spark.createDataFrame([(z.real.tolist(), z.imag.tolist())], "i array<double>, q array<double>")


def test_full_scale_tone_reads_zero_db(spark):
    psd = tone(spark, 1024, 64).select(A.welch_psd(1024)("i", "q").alias("p")).first().p
    assert int(np.argmax(psd)) == 576 and abs(max(psd)) < 0.5


def test_welch_without_overlap_equals_single_frame(spark):
    x = np.cos(0.1 * np.arange(256))
    df = spark.createDataFrame([(x.tolist(), [0.0] * 256)], "i array<double>, q array<double>")
    got = df.select(A.welch_psd(256, 0.0)("i", "q").alias("p")).first().p
    w = A.blackman_harris(256)
    want = 20 * np.log10(np.maximum(np.abs(np.fft.fftshift(np.fft.fft(x * w))) / w.sum(), 1e-12))
    assert np.abs(np.array(got) - want).max() < 1e-2


def test_dwell_with_tone_gives_one_detection(spark):
    rng = np.random.default_rng(7)
    n, rate = 4096 * 8, 2.4e6
    z = 0.3 * np.exp(2j * np.pi * 300e3 * np.arange(n) / rate) + 1e-3 * (rng.normal(size=n) + 1j * rng.normal(size=n))
    dwell = spark.createDataFrame([(z.real.tolist(), z.imag.tolist())], "i array<double>, q array<double>")
    psd = dwell.select(
        F.lit(1).cast("long").alias("frame_id"), F.lit(1).cast("long").alias("sensor"), F.lit(0).cast("long").alias("t_s"),
        F.lit(150e6).alias("tile_center_hz"), F.lit(rate / 4096).alias("bin_hz"), A.welch_psd(4096)("i", "q").alias("psd"),
    )
    got = X.detect(psd).collect()
    assert len(got) == 1 and abs(got[0].center_hz - 150.3e6) <= 2 * rate / 4096 and got[0].snr_db > 20


def test_stitched_map_peak(spark):
    psd = np.full(20, -90.0)
    psd[10] = -20
    grid = X.stitch(frame(spark, psd, 150e6, 1e5), 100e6, 200e6, 1000)
    hot = grid.orderBy(F.desc("db")).first()
    assert abs(hot.cell - 500) <= 1 and grid.count() == 1000


def test_bin_centres_and_band_edges(spark):
    rows = X.long_bins(frame(spark, [0.0] * 1024)).where(F.col("bin").isin(511, 512)).collect()
    assert abs(np.mean([r.hz for r in rows]) - 100e6) < 1e3


def test_interpolated_peak(spark):
    psd = np.full(512, -100.0)
    psd[199:202] = [-70, -50, -70]
    got = X.interpolated_peaks(frame(spark, psd), -120.0).collect()
    assert len(got) == 1 and abs(got[0].power + 50) < 0.5
    flat = X.interpolated_peaks(frame(spark, np.full(512, -100.0)), -120.0)
    assert flat.count() == 0


def test_dc_notch_and_statistics(spark):
    psd = np.arange(16.0)
    row = frame(spark, psd).select(A.notch_dc(F.col("psd")).alias("n"), A.last_peak(F.col("psd")).alias("p"), A.upper_median(F.col("psd")).alias("m")).first()
    assert row.n[5:12] == [(4 + 12) / 2] * 7 and row.p == 15 and row.m == 8


def hits(spark, seconds, freq=155.010):
    rows = [(i, freq, -50.0 - i, int(s * NS), 7, False, "NFM") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id long, freq_mhz double, power double, timestamp_ns long, channel_id long, encrypted boolean, modulation string")


def test_traffic_session_of_three_hits(spark):
    got = H.traffic_sessions(hits(spark, [0, 1, 2, 5]), 2 * NS, 100 * NS).collect()
    assert len(got) == 1 and got[0].hit_count == 3 and got[0].duration_sec == 2.0 and got[0].closed_ns == 5 * NS


def test_single_hit_is_noise(spark):
    assert H.traffic_sessions(hits(spark, [3]), 2 * NS, 100 * NS).count() == 0


def crypto(spark, rows):
    data = [(i, "SYS", tg, 1, 851.0, i * NS, alg is not None and alg != "Unencrypted", alg, key) for i, (tg, alg, key) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id long, system string, tgid long, uid long, freq_mhz double, timestamp_ns long, encrypted_flag boolean, algorithm string, key_id long"
    )


def test_key_rotation_and_algorithm_change(spark):
    rows = [(283, "AES-256", 1), (283, "AES-256", 1), (283, "AES-256", 2), (10100, "DES-OFB", 5), (10100, "AES-256", 5), (42001, None, None)]
    got = {r.tgid: r for r in H.key_rotations(crypto(spark, rows)).collect()}
    assert set(got) == {283, 10100}
    assert got[283].summary == "Key rotation on TG 283: key 1 -> 2" and got[283].severity == "notice"
    assert got[10100].summary == "Algorithm change on TG 10100: DES -> AES" and got[10100].severity == "warning"
    clear = crypto(spark, [(1, None, None)]).select(S.algorithm_id(F.col("algorithm"), F.col("encrypted_flag")).alias("a")).first().a
    assert clear == 0x80


def test_new_uid_once_per_system(spark):
    rows = [(1, "A", 7, 10, 1), (2, "A", 7, 11, 2), (3, "B", 7, 12, 3), (4, "A", 0, 13, 4), (5, "A", None, 14, 5)]
    df = spark.createDataFrame(rows, "id long, system string, uid long, tgid long, timestamp_ns long")
    assert sorted((r.system, r.uid, r.id) for r in H.first_sightings(df).collect()) == [("A", 7, 1), ("B", 7, 3)]


def messages(spark, *texts):
    rows = [(i, i * NS, t) for i, t in enumerate(texts)]
    return readers.protocol_messages(spark.createDataFrame(rows, "id long, timestamp_ns long, message string"))


def test_channel_arithmetic(spark):
    plan = '{"payload":{"type":"ChannelParamsUpdate","id":%d,"bandwidth_hz":12500,"base_freq_hz":%d,"spacing_hz":12500}}'
    grant = '{"payload":{"type":"GroupVoiceGrant","talkgroup":283,"src_unit":12345,"channel_id":%d,"channel_num":%d,"emergency":true,"encrypted":false}}'
    m = messages(spark, plan % (1, 851_012_500), plan % (2, 851_000_000), grant % (1, 9), grant % (2, 20), grant % (5, 1))
    got = {r.id: r for r in M.network_grants(m, "SYS").collect()}
    assert got[2].voice_freq == 851.125 and got[3].voice_freq == 851.25 and got[4].voice_freq is None
    assert got[2].tgid == 283 and got[2].uid == 12345
    alarms = [r.summary for r in M.network_findings(m, "SYS").orderBy("id").collect()]
    assert alarms[0].startswith("EMERGENCY grant: TG 283 UID 12345 freq 851.1250")


def test_network_identity_and_affiliation(spark):
    m = messages(
        spark, '{"payload":{"type":"NetworkStatusBroadcast","wacn":781824,"system":972,"channel_id":0,"channel_num":1}}',
        '{"payload":{"type":"GroupAffiliation","talkgroup":500,"src_unit":67890}}', '{"payload":{"type":"Mystery"}}', "not json",
    )
    assert M.network_findings(m, "SYS").first().summary == "Network identified: WACN 0xBEE00 System 0x3CC"
    a = M.network_affiliations(m, "SYS").first()
    assert (a.uid, a.tgid, a.response_type) == (67890, 500, "affiliation")
    kinds = [r.event_type for r in M.message_events(m).orderBy("id").collect()]
    assert kinds == ["protocol.p25.net_status", "protocol.p25.affiliation", "protocol.p25.cc_status"]


def test_both_spellings_of_a_registration(spark):
    m = messages(spark, '{"payload":{"type":"UnitRegistration","src_unit":5}}', '{"payload":{"type":"UnitRegistrationResponse","source":5}}')
    assert {(r.event_type, r.body, r.source_unit) for r in M.message_events(m).collect()} == {("protocol.p25.register", "UnitRegistration UID:5", 5)}


def test_alert_headers(spark):
    rows = [(1, "ZCZC-WXR-TOR-041051-053011+0045-1051700-KPDX/NWS-"), (2, "ZCZC-WXR"), (3, "NOISE"), (4, "ZCZC-EAS-RWT-041005+0030-0011200-KOIN-")]
    df = spark.createDataFrame(rows, "id long, header string")
    got = {r.id: r for r in W.name_codes(W.decode_headers(df)).collect()}
    assert set(got) == {1, 4}
    assert got[1].locations == ["041051", "053011"] and got[1].duration_mins == 45 and got[1].issued_utc == "J105 17:00Z" and got[1].station == "KPDX/NWS"
    assert got[1].event_name == "Tornado Warning" and got[4].alert_severity == "Test"
    minutes = spark.sql("SELECT '0130' a UNION ALL SELECT '0000' UNION ALL SELECT '13'").select(W.minutes(F.col("a")).alias("m"))
    assert sorted(r.m for r in minutes.collect()) == [0, 0, 90]


def test_header_vote(spark):
    rows = [(1, "A", 0), (1, "B", 1), (1, "B", 2), (2, "C", 0), (2, "D", 1), (2, "E", 2)]
    got = {r.alert: r.header for r in W.vote(spark.createDataFrame(rows, "alert long, header string, at int"), "alert", "header", "at").collect()}
    assert got == {1: "B", 2: "C"}


@pytest.mark.parametrize("code,county,state", [
    ("041051", "Multnomah", "OR"), ("141051", "Multnomah", "OR"), ("041999", "Unknown County", "OR"), ("099001", "Unknown", "??"), ("41", "Unknown", "??"),
])
def test_county_lookup(spark, code, county, state):
    got = spark.range(1).select(W.county(F.lit(code)).alias("c")).first().c
    assert (got.county, got.state) == (county, state)


def events(spark):
    rows = [
        (1, 0, "protocol.p25.grant", 9, 851.1, 100, 7, True, "P25", '{"k": 3}', None),
        (2, 10 * NS, "protocol.p25.voice", 1, 851.1, 100, 7, None, "P25", '{"rds.ps": "ABC"}', "FEDL"),
        (3, 20 * NS, "spectrum.detect", 9, 155.5, None, None, False, "VHF", "{}", "COMM"),
    ]
    return spark.createDataFrame(
        rows, "id long, timestamp_ns long, event_type string, severity int, freq_mhz double, talkgroup long, source_unit long, encrypted boolean, band string, attributes string, classification string"
    )


@pytest.mark.parametrize("f,want", [
    (P.Eq("tg", 100), [1, 2]), (P.Ne("cls", "COMM"), [2]), (P.Contains("type", "P25"), [1, 2]), (P.Like("type", "%DETECT"), [3]),
    (P.Regex("type", r"^protocol\."), [1, 2]), (P.Eq("rds.ps", "ABC"), [2]), (P.Gt("k", 2), [1]), (P.NotExists("enc"), [2]),
    (P.Or(P.Eq("band", "VHF"), P.Eq("enc", True)), [1, 3]), (P.Not(P.In("band", ["VHF"])), [1, 2]), (P.NotIn("uid", [7]), []),
])
def test_filters(spark, f, want):
    back = P.Filter.from_json(f.to_json())
    assert back == f
    assert [r.id for r in events(spark).where(P.compile_filter(back)).orderBy("id").collect()] == want


def test_null_passes_keeps_rows_without_value(spark):
    got = events(spark).where(P.compile_filter(P.Ne("cls", "COMM"), null_passes=True)).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2]


def test_aggregation_and_paging(spark):
    q = EventQuery(aggregation=Aggregation("count_distinct", "tg", ("band",), having=F.col("agg_value") > 0))
    assert [tuple(r) for r in q.aggregate(events(spark)).collect()] == [("P25", 1)]
    assert [r.id for r in EventQuery(limit=1, offset=1).rows(events(spark)).collect()] == [2]


def test_rule_round_trip(spark):
    r = Rule(3, "x", "correlation", (P.Or(P.Eq("tg", 1), P.Exists("uid")),), 60, second=(P.In("band", ["A", "B"]),), field="uid", cooldown_sec=5)
    assert load_rules(rule_table(spark, [r])) == [r]


def test_library_prefers_the_last_of_equals(spark):
    df = spark.createDataFrame([(1, 2750.0, 1050.0, 1.1), (2, 9400.0, None, None), (3, 1.0, None, None)], "id int, f double, pri double, pw double")
    got = {r.id: r for r in E.match_library(df, ["id"], "f", "pri", "pw").collect()}
    assert got[1].id_match == "ASR-9 Airport Surveillance" and got[1].confidence == 1.0
    assert got[2].id_match == "Marine X-band Radar" and got[2].confidence == 0.5
    assert got[3].id_match is None and got[3].confidence == 0.0


def test_unknown_algorithm_reads_hexadecimal(spark):
    got = spark.range(1).select(S.algorithm_id(F.lit("Unknown(0x9F)"), F.lit(True)).alias("a")).first().a
    assert got == 0x9F


def test_distance(spark):
    d = spark.range(1).select(S.haversine_m(F.lit(45.0), F.lit(-122.0), F.lit(46.0), F.lit(-122.0)).alias("d")).first().d
    assert abs(d - 111194.9) < 1
