"""Spectral operators over PSD frames and I/Q dwells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavetrail.functions import frames as A
from wavetrail.functions import scalars as S
from wavetrail.operators import spectrum as X
from wavetrail.plans.registry import query

R6 = 6


def r6(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, R6))
    return df


@query("arr01_bin_centre", "SELECT frame_id, bin, tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz AS hz FROM bins")
def _(v):
    return X.long_bins(v.psd).select("frame_id", "bin", "hz")


def dft_sql(window: str, size: str, norm: str, period: str) -> str:
    return f"""
segs AS (SELECT dwell_id, start, n - start AS m, {window} * i AS a, {window} * q AS b, win FROM (
   SELECT iq.*, s.start, cos(2*pi()*(n-s.start)/{period}) AS c1, cos(4*pi()*(n-s.start)/{period}) AS c2, cos(6*pi()*(n-s.start)/{period}) AS c3, 1 AS win
   FROM iq JOIN starts s ON n >= s.start AND n < s.start + {size})),
spec AS (SELECT dwell_id, start, f, POWER(SUM(a*cos(2*pi()*f*m/{size}) + b*sin(2*pi()*f*m/{size})), 2) + POWER(SUM(b*cos(2*pi()*f*m/{size}) - a*sin(2*pi()*f*m/{size})), 2) AS p
   FROM segs, range({size}) r(f) GROUP BY 1, 2, 3),
lines AS (SELECT dwell_id, (f + {size}//2) % {size} AS bin, AVG(p) / {norm} AS p FROM spec GROUP BY 1, 2)"""


BH = "(0.35875e0 - 0.48829e0*c1 + 0.14128e0*c2 - 0.01168e0*c3)"
BH_SUM = "(SELECT POWER(SUM(0.35875e0 - 0.48829e0*cos(2*pi()*x/15) + 0.14128e0*cos(4*pi()*x/15) - 0.01168e0*cos(6*pi()*x/15)), 2) FROM range(16) w(x))"


@query(
    "arr02_welch_psd",
    "SELECT dwell_id, bin, ROUND(CASE WHEN p > 1e-24 THEN 10*log10(p) ELSE -240e0 END, 6) AS db FROM lines",
    "starts AS (SELECT unnest([0, 8, 16]) AS start)," + dft_sql(BH, "16", BH_SUM, "15"),
)
def _(v):
    psd = v.iq.select("dwell_id", A.welch_psd(16, 0.5)(F.col("i"), F.col("q")).alias("psd"))
    return psd.select("dwell_id", F.posexplode("psd").alias("bin", "db")).withColumn("db", F.round("db", R6))


@query(
    "arr19_hann_spectrum",
    "SELECT dwell_id, bin, ROUND(10*log10(p + 1e-20), 6) AS db FROM lines",
    "starts AS (SELECT 0 AS start)," + dft_sql("(0.5e0*(1 - c1))", "32", "32", "32"),
)
def _(v):
    psd = v.iq.select("dwell_id", A.hann_spectrum()(F.col("i"), F.col("q")).alias("psd"))
    return psd.select("dwell_id", F.posexplode("psd").alias("bin", "db")).withColumn("db", F.round("db", R6))


T, G, PFA, MERGE = 8, 2, 1e-2, 3000.0
CFAR_CTE = f"""
lin AS (SELECT *, POWER(10e0, db/10) AS p FROM bins),
noise AS (SELECT *, (SUM(p) OVER (w ROWS BETWEEN {T+G} PRECEDING AND {G+1} PRECEDING) + SUM(p) OVER (w ROWS BETWEEN {G+1} FOLLOWING AND {T+G} FOLLOWING)) / {2*T} AS m
  FROM lin WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
flagged AS (SELECT * FROM noise WHERE bin >= {T+G} AND bin < n - {T+G} AND p > m * ({2*T} * (POWER({PFA}, -1e0/{2*T}) - 1))),
isl AS (SELECT *, SUM(CASE WHEN d <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY frame_id ORDER BY bin) AS c FROM (SELECT *, bin - lag(bin) OVER (PARTITION BY frame_id ORDER BY bin) AS d FROM flagged)),
clus AS (SELECT frame_id, c, MIN(bin) AS first, MAX(bin) AS last FROM isl GROUP BY 1, 2),
cells AS (SELECT x.*, k.c, k.first, k.last FROM clus k JOIN noise x ON x.frame_id = k.frame_id AND x.bin BETWEEN k.first AND k.last),
cum AS (SELECT *, SUM(p) OVER (PARTITION BY frame_id, c ORDER BY bin) AS run, SUM(p) OVER (PARTITION BY frame_id, c) AS tot FROM cells),
dets AS (SELECT frame_id, sensor, t_s, tile_center_hz, bin_hz, first, last, MAX(db) AS power_dbfs,
   MAX(db) - 10*log10(GREATEST(arg_max(m, (db, bin)), 1e-24)) AS snr_db,
   tile_center_hz - n/2.0*bin_hz + (SUM(p*bin)/SUM(p) + 0.5)*bin_hz AS center_hz,
   bin_hz * (GREATEST(COALESCE(MIN(CASE WHEN run >= tot*0.995e0 THEN bin END), last), COALESCE(MIN(CASE WHEN run >= tot*0.005e0 THEN bin END), last)) - COALESCE(MIN(CASE WHEN run >= tot*0.005e0 THEN bin END), last) + 1) AS bandwidth_hz
   FROM cum GROUP BY frame_id, sensor, t_s, tile_center_hz, bin_hz, n, c, first, last),
strong AS (SELECT * FROM dets WHERE snr_db >= 6)"""


@query(
    "arr03_cfar_detection",
    "SELECT frame_id, first, last, ROUND(power_dbfs, 6) AS power_dbfs, ROUND(snr_db, 6) AS snr_db, ROUND(center_hz, 4) AS center_hz, bandwidth_hz FROM strong",
    CFAR_CTE,
)
def _(v):
    d = X.cfar_clusters(v.psd, T, G, PFA)
    return r6(d.withColumn("center_hz", F.round("center_hz", 4)), "power_dbfs", "snr_db").select(
        "frame_id", "first", "last", "power_dbfs", "snr_db", "center_hz", "bandwidth_hz"
    )


MERGE_CTE = f"""
edges AS (SELECT *, center_hz - bandwidth_hz/2 AS lo, center_hz + bandwidth_hz/2 AS hi FROM strong),
parts AS (SELECT *, SUM(CASE WHEN lo - reach <= {MERGE} THEN 0 ELSE 1 END) OVER (PARTITION BY frame_id ORDER BY center_hz, first) AS part FROM (
   SELECT *, MAX(hi) OVER (PARTITION BY frame_id ORDER BY center_hz, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM edges)),
merged AS (SELECT frame_id, sensor, t_s, tile_center_hz, COUNT(*) AS parts, MAX(power_dbfs) AS power_dbfs, MAX(snr_db) AS snr_db,
   CASE WHEN COUNT(*) = 1 THEN MIN(center_hz) ELSE (MIN(lo) + MAX(hi))/2 END AS center_hz, CASE WHEN COUNT(*) = 1 THEN MIN(bandwidth_hz) ELSE MAX(hi) - MIN(lo) END AS bandwidth_hz
   FROM parts GROUP BY frame_id, sensor, t_s, tile_center_hz, part)"""
DET = ["frame_id", "sensor", "parts", "power_dbfs", "snr_db", "center_hz", "bandwidth_hz"]


def detections(v):
    return X.detect(v.psd, T, G, PFA, 6.0, MERGE)


@query(
    "arr04_merged_detections",
    "SELECT frame_id, sensor, parts, ROUND(power_dbfs, 6) AS power_dbfs, ROUND(snr_db, 6) AS snr_db, ROUND(center_hz, 4) AS center_hz, ROUND(bandwidth_hz, 4) AS bandwidth_hz FROM merged",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    d = detections(v).withColumn("center_hz", F.round("center_hz", 4)).withColumn("bandwidth_hz", F.round("bandwidth_hz", 4))
    return r6(d, "power_dbfs", "snr_db").select(*DET)


@query(
    "arr20_band_edges",
    "SELECT frame_id, ROUND(center_hz - bandwidth_hz/2, 4) AS lo_hz, ROUND(center_hz + bandwidth_hz/2, 4) AS hi_hz FROM merged",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    c, b = F.col("center_hz"), F.col("bandwidth_hz")
    return detections(v).select("frame_id", F.round(c - b / 2, 4).alias("lo_hz"), F.round(c + b / 2, 4).alias("hi_hz"))


@query(
    "agg36_mission_detections",
    """SELECT mission_id, detection_count, frame_id, ROUND(center_hz, 4) AS center_hz, rk FROM (
        SELECT sensor % 3 AS mission_id, COUNT(*) OVER (PARTITION BY sensor % 3) AS detection_count, frame_id, center_hz,
          row_number() OVER (PARTITION BY sensor % 3 ORDER BY t_s DESC, frame_id DESC, center_hz DESC) AS rk FROM merged) WHERE rk <= 25""",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    d = detections(v).withColumn("mission_id", F.col("sensor") % 3)
    newest = Window.partitionBy("mission_id").orderBy(F.desc("t_s"), F.desc("frame_id"), F.desc("center_hz"))
    page = d.withColumn("rk", F.row_number().over(newest)).where(F.col("rk") <= 25)
    totals = d.groupBy("mission_id").agg(F.count(F.lit(1)).alias("detection_count"))
    return page.join(totals, "mission_id").select("mission_id", "detection_count", "frame_id", F.round("center_hz", 4).alias("center_hz"), "rk")


LO, HI, CELLS = 149.9e6, 150.7e6, 1000
STITCH_CTE = f"""
cellv AS (SELECT CAST(floor((hz - {LO}) / ({HI - LO} / {CELLS})) AS BIGINT) AS cell, db, t_s, frame_id, bin FROM (SELECT *, tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz AS hz FROM bins) WHERE hz >= {LO} AND hz < {HI}),
grid AS (SELECT g.cell, COALESCE(ROUND(x.db, 6), -240e0) AS db FROM range({CELLS}) g(cell) LEFT JOIN (SELECT cell, arg_max(db, (t_s, frame_id, bin)) AS db FROM cellv GROUP BY 1) x ON x.cell = g.cell)"""


def wide_map(v):
    return r6(X.stitch(v.psd, LO, HI, CELLS), "db")


@query("arr05_occupancy_stitch", "SELECT * FROM grid", STITCH_CTE)
def _(v):
    return wide_map(v)


@query("arr06_max_pool", f"SELECT slot, MAX(db) AS db FROM (SELECT unnest(range(96)) AS slot) s JOIN grid ON cell >= slot*{CELLS}//96 AND cell < (slot+1)*{CELLS}//96 GROUP BY 1", STITCH_CTE)
def _(v):
    return X.max_pool(wide_map(v), CELLS, 96)


BASE_SQL = "SELECT sensor, bin, AVG(db) AS mean, stddev_pop(db) AS std_dev, MIN(db) AS min, MAX(db) AS max, COUNT(*) AS sample_count FROM bins GROUP BY 1, 2"


@query("arr07_spectrum_baseline", f"SELECT sensor, bin, ROUND(mean, 6) AS mean, ROUND(std_dev, 6) AS std_dev, ROUND(min, 6) AS min, ROUND(max, 6) AS max, sample_count FROM ({BASE_SQL})")
def _(v):
    return r6(X.baseline(v.psd), "mean", "std_dev", "min", "max")


ANOM_CTE = f"""
base AS ({BASE_SQL}),
scored AS (SELECT b.*, b.db - s.mean AS delta_db, (b.db - s.mean)/s.std_dev AS z_score, s.min, s.max, s.std_dev FROM bins b JOIN base s ON s.sensor = b.sensor AND s.bin = b.bin),
anom AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY bin) AS rk, CASE WHEN db > max + 3 THEN 'NewSignal' WHEN delta_db > 0 THEN 'PowerIncrease' WHEN db < min - 3 THEN 'SignalGone' ELSE 'PowerDecrease' END AS kind
  FROM scored WHERE std_dev >= 0.1 AND abs(z_score) >= 2.5)"""


def anomaly_rows(v, first=None):
    return X.anomalies(v.psd, X.baseline(v.psd), 2.5, first)


@query(
    "arr08_spectrum_anomalies",
    """SELECT frame_id, bin, kind, ROUND(delta_db, 6) AS delta_db, ROUND(z_score, 6) AS z_score, CASE WHEN abs(z_score) > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       ROUND((tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz)/1e6, 6) AS freq_mhz FROM anom WHERE rk <= 5""",
    ANOM_CTE,
)
def _(v):
    return r6(anomaly_rows(v, first=5), "delta_db", "z_score", "freq_mhz").select("frame_id", "bin", "kind", "delta_db", "z_score", "severity", "freq_mhz")


PEAK_CTE = """
nb AS (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r FROM bins WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
flo AS (SELECT frame_id, list_sort(list(db))[COUNT(*)//2 + 1] AS floor FROM bins GROUP BY 1)"""


@query("arr09_local_maxima", "SELECT frame_id, bin, ROUND(db, 6) AS db, tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz AS hz FROM nb WHERE db > -70 AND db > l AND db > r", PEAK_CTE)
def _(v):
    return r6(X.peaks(v.psd, -70.0), "db").select("frame_id", "bin", "db", "hz")


@query(
    "arr10_interpolated_peaks",
    """SELECT frame_id, bin, ROUND(tile_center_hz - n/2.0*bin_hz + (bin + d)*bin_hz, 4) AS freq_hz, ROUND(db - 0.25e0*(l - r)*d, 6) AS power,
        ((SELECT COALESCE(MIN(x.bin), c.n) FROM bins x WHERE x.frame_id = c.frame_id AND x.bin > c.bin AND x.db <= c.floor + 3)
         - (SELECT COALESCE(MAX(x.bin), -1) FROM bins x WHERE x.frame_id = c.frame_id AND x.bin < c.bin AND x.db <= c.floor + 3) - 1) * bin_hz AS bandwidth_hz
       FROM (SELECT nb.*, floor, CASE WHEN abs(l - 2*db + r) > 1e-10 THEN 0.5e0*(l - r)/(l - 2*db + r) ELSE 0 END AS d FROM nb JOIN flo USING (frame_id)
         WHERE db > l AND db > r AND db > GREATEST(-66, floor + 6) AND (db - l >= 3 OR db - r >= 3)) c""",
    PEAK_CTE,
)
def _(v):
    p = X.interpolated_peaks(v.psd, -66.0).withColumn("freq_hz", F.round("freq_hz", 4))
    return r6(p, "power").select("frame_id", "bin", "freq_hz", "power", "bandwidth_hz")


@query(
    "arr11_classified_peaks",
    """SELECT frame_id, bin, ROUND(freq, 6) AS freq_mhz, ROUND(power, 6) AS power, ROUND(bw, 6) AS bandwidth_khz, COALESCE(c.label, 'Unknown') AS name, COALESCE(c.channel_cls, 'UNK') AS cls FROM (
        SELECT *, (rr - ll)*bin_hz/1e3 AS bw FROM (
        SELECT *, COALESCE((SELECT MIN(x.bin) FROM bins x WHERE x.frame_id = c.frame_id AND x.bin > mid AND x.db < power - 3), n - 1) AS rr,
          (SELECT COALESCE(MAX(x.bin), 0) FROM bins x WHERE x.frame_id = c.frame_id AND x.bin < mid AND x.db < power - 3) AS ll FROM (
          SELECT *, (tile_center_hz - n/2.0*bin_hz + bin*bin_hz)/1e6 + d*bin_hz/1e6 AS freq, db - 0.25e0*(l - r)*d AS power, LEAST(CASE WHEN d > 0 THEN bin + 1 ELSE bin END, n - 1) AS mid FROM (
           SELECT nb.*, floor, CASE WHEN abs(l - 2*db + r) > 1e-10 THEN 0.5e0*(l - r)/(l - 2*db + r) ELSE 0 END AS d FROM nb JOIN flo USING (frame_id)
           WHERE db > l AND db > r AND db > floor + 6 AND (db - l >= 6 OR db - r >= 6))) c) WHERE (rr - ll)*bin_hz/1e3 >= 2) p
       LEFT JOIN LATERAL (SELECT * FROM channels WHERE abs(channel_freq - p.freq) < 0.015e0 ORDER BY channel_id LIMIT 1) c ON TRUE""",
    PEAK_CTE,
)
def _(v):
    p = X.classified_peaks(v.psd, v.channels, 6.0, 2.0)
    return r6(p, "freq_mhz", "power", "bandwidth_khz").select("frame_id", "bin", "freq_mhz", "power", "bandwidth_khz", "name", "cls")


@query(
    "arr12_max_hold",
    """SELECT h.sensor, bin, ROUND(db, 6) AS db, ROUND(f.floor, 6) AS floor, f.top > f.floor + 10 AS had_signal FROM held h
       JOIN (SELECT sensor, list_sort(list(db))[COUNT(*)//2 + 1] AS floor, MAX(db) AS top FROM held GROUP BY 1) f USING (sensor)""",
    "held AS (SELECT sensor, bin, MAX(db) AS db FROM bins GROUP BY 1, 2)",
)
def _(v):
    return r6(X.max_hold(v.psd, 10.0), "db", "floor")


@query(
    "arr13_dc_notch",
    "SELECT frame_id, bin, ROUND(CASE WHEN bin BETWEEN n//2 - 3 AND n//2 + 3 THEN (a.db + b.db)/2 ELSE bins.db END, 6) AS db FROM bins JOIN (SELECT frame_id, db FROM bins WHERE bin = n//2 - 4) a USING (frame_id) JOIN (SELECT frame_id, db FROM bins WHERE bin = n//2 + 4) b USING (frame_id)",
)
def _(v):
    notched = v.psd.select("frame_id", F.posexplode(A.notch_dc(F.col("psd"))).alias("bin", "db"))
    return r6(notched, "db")


@query(
    "arr14_grid_resample",
    """SELECT frame_id, j AS point, ROUND(CASE WHEN x <= 0 THEN psd[1] WHEN x >= 63 THEN psd[64] ELSE psd[lo+1]*(1-(x-lo)) + psd[LEAST(lo+1, 63)+1]*(x-lo) END, 6) AS db
       FROM (SELECT frame_id, psd, j, x, CAST(floor(x) AS INTEGER) AS lo FROM (SELECT frame_id, psd, j, (-500e0 + j*700e0)/1e3 AS x FROM psd, range(100) r(j)))""",
)
def _(v):
    start = F.col("tile_center_hz") - 32 * F.col("bin_hz")
    grid = A.resample(F.col("psd"), F.lit(0.0), F.col("bin_hz"), F.lit(-500.0), F.lit(700.0), 100)
    return r6(v.psd.withColumn("start", start).select("frame_id", F.posexplode(grid).alias("point", "db")), "db")


@query(
    "arr15_frame_statistics",
    """SELECT b.frame_id, ROUND(MIN(db), 6) AS min_db, ROUND(MAX(db), 6) AS max_db, ROUND(AVG(db), 6) AS mean_db, ROUND(ANY_VALUE(f.floor), 6) AS median_db, arg_max(bin, (db, bin)) AS peak_bin,
        arg_max(tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz, (db, bin)) AS peak_hz FROM bins b JOIN flo f USING (frame_id) GROUP BY 1""",
    PEAK_CTE,
)
def _(v):
    p = F.col("psd")
    s = v.psd.select(
        "frame_id", F.array_min(p).alias("min_db"), F.array_max(p).alias("max_db"), (A.total(p) / F.size(p)).alias("mean_db"),
        A.upper_median(p).alias("median_db"), A.last_peak(p).alias("peak_bin"),
        A.bin_hz(F.col("tile_center_hz"), F.col("bin_hz"), F.size(p), A.last_peak(p)).alias("peak_hz"),
    )
    return r6(s, "min_db", "max_db", "mean_db", "median_db")


@query("scl09_db_linear", "SELECT frame_id, bin, ROUND(POWER(10e0, db/10)*1e6, 6) AS micro, ROUND(10*log10(GREATEST(POWER(10e0, db/10), 1e-24)), 6) AS back FROM bins")
def _(v):
    lin = S.db_to_linear(F.col("db"))
    return X.long_bins(v.psd).select("frame_id", "bin", F.round(lin * 1e6, R6).alias("micro"), F.round(S.linear_to_db(lin), R6).alias("back"))


@query(
    "joi13_positional_join",
    "SELECT frame_id, bin, ROUND(delta_db, 6) AS delta_db, ROUND(z_score, 6) AS z_score FROM scored WHERE std_dev >= 0.1",
    ANOM_CTE,
)
def _(v):
    base = X.baseline(v.psd).where(F.col("std_dev") >= 0.1)
    delta = F.col("db") - F.col("mean")
    return X.long_bins(v.psd).join(base, ["sensor", "bin"]).select(
        "frame_id", "bin", F.round(delta, R6).alias("delta_db"), F.round(delta / F.col("std_dev"), R6).alias("z_score")
    )


@query(
    "joi14_baseline_difference",
    """SELECT a.sensor, a.bin, ROUND(b.m - a.m, 6) AS delta_db FROM (SELECT sensor, bin, AVG(db) AS m FROM bins WHERE frame_id % 2 = 0 GROUP BY 1, 2) a
       JOIN (SELECT sensor, bin, AVG(db) AS m FROM bins WHERE frame_id % 2 = 1 GROUP BY 1, 2) b USING (sensor, bin) WHERE abs(b.m - a.m) >= 3 ORDER BY abs(b.m - a.m) DESC, sensor, bin LIMIT 20""",
)
def _(v):
    odd = F.col("frame_id") % 2 == 1
    both = (
        v.psd.select("sensor", odd.alias("odd"), F.posexplode("psd").alias("bin", "db")).groupBy("sensor", "bin")
        .agg(F.avg(F.when(~F.col("odd"), F.col("db"))).alias("a"), F.avg(F.when(F.col("odd"), F.col("db"))).alias("b"))
    )
    delta = F.col("b") - F.col("a")
    big = both.withColumn("d", delta).where(F.abs("d") >= 3).orderBy(F.desc(F.abs("d")), "sensor", "bin").limit(20)
    return big.select("sensor", "bin", F.round("d", R6).alias("delta_db"))


@query(
    "win07_persistence",
    """SELECT a.frame_id, a.bin, a.fkey, COUNT(DISTINCT b.sweep) AS hits FROM det a JOIN det b ON b.sensor = a.sensor AND b.fkey = a.fkey AND b.sweep BETWEEN a.sweep - 4 AND a.sweep
       GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT b.sweep) >= 3""",
    PEAK_CTE + """,
det AS (SELECT frame_id, sensor, bin, CAST(ROUND((tile_center_hz - n/2.0*bin_hz + (bin + 0.5)*bin_hz)/1e6*200) AS BIGINT) AS fkey, dense_rank() OVER (PARTITION BY sensor ORDER BY t_s, frame_id) AS sweep FROM (
  SELECT *, db > -62 AND db > l AND db > r AS hit FROM nb) QUALIFY hit)""",
)
def _(v):
    swept = X.sweep_numbers(v.psd)
    found = X.peaks(v.psd, -62.0).join(swept.select("frame_id", "sweep"), "frame_id")
    keyed = found.withColumn("fkey", F.round(F.col("hz") / 1e6 * 200).cast("long"))
    return X.persistent(keyed, "fkey", "sweep", 5, 3).select("frame_id", "bin", "fkey", "hits")


@query(
    "win11_exponential_average",
    "SELECT sensor, bin, ROUND(list_reduce(list(db ORDER BY t_s, frame_id), lambda a, x: 0.3e0*x + 0.7e0*a), 5) AS avg_db FROM bins GROUP BY 1, 2",
)
def _(v):
    return X.running_average(v.psd, 0.3).withColumn("avg_db", F.round("avg_db", 5))


def frame_peaks(v):
    """Peak frequencies of each frame above its tile's lower edge, ascending."""
    found = A.local_maxima(F.col("psd"), F.lit(-70.0))
    return v.psd.select("frame_id", "sensor", "t_s", F.transform(found, lambda i: (i + 0.5) / 1000).alias("peaks_mhz"))


def harmonic_rows(v):
    g = frame_peaks(v).select("frame_id", "sensor", "t_s", F.inline(X.harmonic_groups(1.0)(F.col("peaks_mhz"))))
    return g.withColumn("source", X.oscillator(F.col("fundamental_mhz")))


HARM_CTE = PEAK_CTE + """,
pk AS (SELECT frame_id, list((bin + 0.5)/1000::DOUBLE ORDER BY bin) AS f FROM nb WHERE db > -70 AND db > l AND db > r GROUP BY 1)"""


WALK_CTE = HARM_CTE + """,
walk AS (
  WITH RECURSIVE w AS (
    SELECT frame_id, f, 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS h FROM pk
    UNION ALL
    SELECT frame_id, f, i + 1, list_concat(list_concat(used, nh), CASE WHEN len(nh) > 0 THEN [i + 1] ELSE [] END), nh FROM (
      SELECT frame_id, f, i, used, CASE WHEN list_contains(used, i + 1) THEN []::BIGINT[] ELSE
        list_filter(range(1, len(f) + 1), lambda j: NOT list_contains(used, j) AND j <> i + 1 AND ROUND(f[j]/f[i+1]) >= 2 AND abs(f[j]/f[i+1] - ROUND(f[j]/f[i+1]))/ROUND(f[j]/f[i+1]) < 0.01e0) END AS nh
      FROM w WHERE i < len(f)))
  SELECT * FROM w)"""


@query(
    "joi17_harmonic_groups",
    """SELECT frame_id, ROUND(f[i], 4) AS fundamental_mhz, list_aggregate(list_transform(h, lambda j: printf('%.4f', f[j])), 'string_agg', ',') AS harmonics FROM walk WHERE i > 0 AND len(h) > 0""",
    WALK_CTE,
)
def _(v):
    text = F.array_join(F.transform("harmonics", lambda x: S.fixed(x, 4)), ",")
    return harmonic_rows(v).select("frame_id", F.round("fundamental_mhz", 4).alias("fundamental_mhz"), text.alias("harmonics"))


# --- I/Q -------------------------------------------------------------------


@query(
    "win06_pulse_extraction",
    """SELECT dwell_id, first AS start_sample, ROUND(first / 1e6, 9) AS toa, stop - first AS width_samples, ROUND(10*log10(p_stop), 6) AS amplitude_db, (first - lag(first) OVER (PARTITION BY dwell_id ORDER BY first)) AS pri_samples FROM (
        SELECT dwell_id, n + 1 AS first, (SELECT MIN(y.n) + 1 FROM pw y WHERE y.dwell_id = x.dwell_id AND y.n > x.n AND NOT y.hot) AS stop,
          (SELECT arg_min(y.p, y.n) FROM pw y WHERE y.dwell_id = x.dwell_id AND y.n > x.n AND NOT y.hot) AS p_stop
        FROM pw x WHERE hot AND COALESCE(NOT prev, TRUE)) WHERE stop IS NOT NULL""",
    "pw AS (SELECT *, lag(hot) OVER (PARTITION BY dwell_id ORDER BY n) AS prev FROM (SELECT dwell_id, n, i*i + q*q AS p, i*i + q*q >= 0.02e0 AS hot FROM iq))",
)
def _(v):
    power = F.zip_with("i", "q", lambda a, b: a * a + b * b)
    hot = lambda j: F.coalesce(F.get("power", j) >= 0.02, F.lit(False))
    p = v.iq.select("dwell_id", power.alias("power"))
    idx = A.indices(F.col("power"))
    first = F.filter(idx, lambda j: hot(j) & ~hot(j - 1))
    stop = F.filter(idx, lambda j: ~hot(j) & hot(j - 1))
    pulses = F.zip_with(F.slice(first, F.lit(1), F.size(stop)), stop, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = p.select("dwell_id", "power", F.posexplode(pulses).alias("pos", "pulse"), pulses.alias("all"))
    start = F.col("pulse.a") + 1
    return rows.select(
        "dwell_id", start.alias("start_sample"), F.round(start / 1e6, 9).alias("toa"), (F.col("pulse.b") - F.col("pulse.a")).alias("width_samples"),
        F.round(10 * F.log10(F.get("power", F.col("pulse.b"))), R6).alias("amplitude_db"),
        (F.col("pulse.a") - F.get("all", F.col("pos") - 1)["a"]).alias("pri_samples"),
    )


FP16_CTE = """
st AS (SELECT dwell_id, sensor, i, q, lead(i) OVER w AS i2, lead(q) OVER w AS q2 FROM iq WINDOW w AS (PARTITION BY dwell_id ORDER BY n)),
feat AS (SELECT dwell_id, sensor, sqrt(SUM(i*i + q*q)/COUNT(*)) AS rms, CASE WHEN SUM(q*q) > 0 THEN 10*log10(SUM(i*i)/SUM(q*q)) ELSE 0 END AS imbalance_db,
   atan2(SUM(q*i2 - i*q2), SUM(i*i2 + q*q2)) * 48000 / (2*pi()) AS cfo_hz FROM st GROUP BY 1, 2)"""


def iq_features(v, rate: float = 48000.0):
    """RMS, I/Q imbalance and carrier offset of each dwell (sign as x * conj(next))."""
    i, q = F.col("i"), F.col("q")
    n = F.size(i)
    square = lambda a: A.total(F.transform(a, lambda x: x * x))
    dot = lambda a, b: A.total(F.zip_with(a, b, lambda x, y: x * y))
    head = lambda a: F.slice(a, F.lit(1), n - 1)
    tail = lambda a: F.slice(a, F.lit(2), n - 1)
    re = dot(head(i), tail(i)) + dot(head(q), tail(q))
    im = dot(head(q), tail(i)) - dot(head(i), tail(q))
    return v.iq.select(
        "dwell_id", "sensor", F.sqrt((square(i) + square(q)) / n).alias("rms"),
        F.when(square(q) > 0, 10 * F.log10(square(i) / square(q))).otherwise(0.0).alias("imbalance_db"),
        (F.atan2(im, re) * rate / (2 * F.pi())).alias("cfo_hz"),
    )


@query("arr16_iq_fingerprint", "SELECT dwell_id, ROUND(rms, 6) AS rms, ROUND(imbalance_db, 6) AS imbalance_db, ROUND(cfo_hz, 4) AS cfo_hz FROM feat", FP16_CTE)
def _(v):
    return r6(iq_features(v), "rms", "imbalance_db").select("dwell_id", "rms", "imbalance_db", F.round("cfo_hz", 4).alias("cfo_hz"))


@query(
    "arr17_accumulated_fingerprint",
    """SELECT sensor, n AS sample_count, n >= 480 AS enough_samples, ROUND(CASE WHEN i2 + q2 > 1e-12 THEN abs(i2 - q2)/(i2 + q2) ELSE 0 END, 6) AS amplitude_imbal, ROUND(CASE WHEN i2 + q2 > 1e-12 THEN abs(iq)/(i2 + q2) ELSE 0 END, 6) AS phase_imbal,
        ROUND(CASE WHEN p > 1e-20 THEN 10*log10(p) ELSE -200 END, 6) AS avg_power_db, ROUND(GREATEST(pp - p*p, 0), 6) AS power_variance FROM (
        SELECT sensor, COUNT(*) AS n, AVG(i*i) AS i2, AVG(q*q) AS q2, AVG(i*q) AS iq, AVG(i*i + q*q) AS p, AVG((i*i + q*q)*(i*i + q*q)) AS pp FROM iq GROUP BY 1)""",
)
def _(v):
    i, q = F.col("i"), F.col("q")
    per = v.iq.select(
        "sensor", F.size(i).alias("n"), A.total(F.transform(i, lambda x: x * x)).alias("i2"), A.total(F.transform(q, lambda x: x * x)).alias("q2"),
        A.total(F.zip_with(i, q, lambda a, b: a * b)).alias("iq"),
        A.total(F.zip_with(i, q, lambda a, b: (a * a + b * b) * (a * a + b * b))).alias("pp"),
    )
    sums = per.groupBy("sensor").agg(*[F.sum(c).alias(c) for c in ("n", "i2", "q2", "iq", "pp")])
    n, s = F.col("n"), F.col("i2") + F.col("q2")
    p = s / n
    return sums.select(
        "sensor", n.alias("sample_count"), (n >= 480).alias("enough_samples"),
        F.round(F.when(s / n > 1e-12, F.abs(F.col("i2") - F.col("q2")) / s).otherwise(0.0), R6).alias("amplitude_imbal"),
        F.round(F.when(s / n > 1e-12, F.abs(F.col("iq")) / s).otherwise(0.0), R6).alias("phase_imbal"),
        F.round(F.when(p > 1e-20, 10 * F.log10(p)).otherwise(-200.0), R6).alias("avg_power_db"),
        F.round(F.greatest(F.col("pp") / n - p * p, F.lit(0.0)), R6).alias("power_variance"),
    )


@query(
    "arr18_fingerprint_similarity",
    """SELECT dwell_id, ROUND(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE dot/(na*nb) END, 6) AS similarity FROM (
        SELECT dwell_id, f.cfo_hz*m.cfo_hz + f.imbalance_db*m.imbalance_db + f.rms*m.rms AS dot, sqrt(f.cfo_hz*f.cfo_hz + f.imbalance_db*f.imbalance_db + f.rms*f.rms) AS na,
          sqrt(m.cfo_hz*m.cfo_hz + m.imbalance_db*m.imbalance_db + m.rms*m.rms) AS nb
        FROM feat f JOIN (SELECT sensor, AVG(cfo_hz) AS cfo_hz, AVG(imbalance_db) AS imbalance_db, AVG(rms) AS rms FROM feat GROUP BY 1) m USING (sensor))""",
    FP16_CTE,
)
def _(v):
    feats = iq_features(v)
    mean = feats.groupBy("sensor").agg(F.array(F.avg("cfo_hz"), F.avg("imbalance_db"), F.avg("rms")).alias("m"))
    both = feats.withColumn("f", F.array("cfo_hz", "imbalance_db", "rms")).join(mean, "sensor")
    dot = lambda a, b: A.total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(dot(F.col("f"), F.col("f"))) * F.sqrt(dot(F.col("m"), F.col("m")))
    return both.select("dwell_id", F.round(F.when(norm == 0, 0.0).otherwise(dot(F.col("f"), F.col("m")) / norm), R6).alias("similarity"))


@query(
    "udx04_mergeable_aggregates",
    "SELECT sensor, ROUND(AVG(db), 6) AS mean, ROUND(stddev_pop(db), 6) AS std_dev, COUNT(*) AS sample_count FROM bins GROUP BY 1",
)
def _(v):
    rows = v.psd.select("sensor", F.explode("psd").alias("db"))
    return r6(rows.groupBy("sensor").agg(F.avg("db").alias("mean"), F.stddev_pop("db").alias("std_dev"), F.count(F.lit(1)).alias("sample_count")), "mean", "std_dev")


@query(
    "prj09_detection_event",
    """SELECT frame_id, 'spectrum.detect' AS event_type, 9 AS severity, 0 AS source, ROUND(center_hz/1e6, 6) AS freq_mhz, concat('dev-', sensor) AS device_key,
        concat(printf('%.4f', center_hz/1e6), ' MHz UNK ', printf('%.0f', power_dbfs), ' dBm') AS body FROM merged""",
    CFAR_CTE + "," + MERGE_CTE,
)
def _(v):
    mhz = F.col("center_hz") / 1e6
    body = F.concat(S.fixed(mhz, 4), F.lit(" MHz UNK "), S.fixed(F.col("power_dbfs"), 0), F.lit(" dBm"))
    return detections(v).select(
        "frame_id", F.lit("spectrum.detect").alias("event_type"), F.lit(9).alias("severity"), F.lit(0).alias("source"),
        F.round(mhz, R6).alias("freq_mhz"), F.concat(F.lit("dev-"), F.col("sensor")).alias("device_key"), body.alias("body"),
    )


SNAP_CTE = """
snaps AS (SELECT t_s // 30 * 30 AS ts_bucket, CASE WHEN sensor < 5 THEN 'VHF' ELSE 'UHF' END AS band, concat('dev-', sensor % 2) AS device_key, frame_id,
   ROUND(list_max(psd), 6) AS peak_db, ROUND(list_avg(psd), 6) AS mean_db, sensor AS operation_id FROM psd),
upserted AS (SELECT ts_bucket, band, device_key, arg_max(frame_id, frame_id) AS frame_id, arg_max(peak_db, frame_id) AS peak_db, arg_max(mean_db, frame_id) AS mean_db, arg_min(operation_id, frame_id) AS operation_id FROM snaps GROUP BY 1, 2, 3)"""


def snapshots(v):
    from wavetrail.sources.sinks import upsert_latest

    p = F.col("psd")
    rows = v.psd.select(
        F.expr("t_s div 30 * 30").alias("ts_bucket"), F.when(F.col("sensor") < 5, "VHF").otherwise("UHF").alias("band"),
        F.concat(F.lit("dev-"), F.col("sensor") % 2).alias("device_key"), "frame_id",
        F.round(F.array_max(p), R6).alias("peak_db"), F.round(A.total(p) / F.size(p), R6).alias("mean_db"), F.col("sensor").alias("operation_id"),
    )
    return upsert_latest(rows.withColumn("arrival", F.col("frame_id")), ["ts_bucket", "band", "device_key"], ["arrival"], ["operation_id"]).drop("arrival")


@query("snk06_snapshot_upsert", "SELECT * FROM upserted", SNAP_CTE)
def _(v):
    return snapshots(v)


@query("ord09_snapshot_range", "SELECT * FROM upserted WHERE ts_bucket BETWEEN 1704067260 AND 1704067440 AND band = 'VHF' ORDER BY ts_bucket", SNAP_CTE)
def _(v):
    return snapshots(v).where(F.col("ts_bucket").between(1704067260, 1704067440) & (F.col("band") == "VHF")).orderBy("ts_bucket", "device_key")


@query(
    "stm18_live_throttle",
    "SELECT band, slot, arg_min(frame_id, (t_ms, frame_id)) AS frame_id, COUNT(*) AS offered FROM (SELECT frame_id, t_ms, sensor % 3 AS band, t_ms // 5000 AS slot FROM (SELECT frame_id, sensor, t_s*1000 AS t_ms FROM psd)) GROUP BY 1, 2",
)
def _(v):
    rows = v.psd.select("frame_id", (F.col("t_s") * 1000).alias("t_ms"), (F.col("sensor") % 3).alias("band")).withColumn("slot", F.expr("t_ms div 5000"))
    return rows.groupBy("band", "slot").agg(F.min_by("frame_id", F.struct("t_ms", "frame_id")).alias("frame_id"), F.count(F.lit(1)).alias("offered"))
