"""Detection, baselines, stitching and peaks over tables of PSD frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.functions import frames as A
from wavetrail.functions.scalars import is_repeater
from wavetrail.operators.joins import first_in_catalogue
from wavetrail.operators.ordered import with_position

FRAME = ["frame_id", "sensor", "t_s", "tile_center_hz", "bin_hz"]


def long_bins(frames: DataFrame) -> DataFrame:
    """One row per bin with its centre frequency."""
    n = F.size("psd")
    rows = frames.select(*FRAME, n.alias("n"), F.posexplode("psd").alias("bin", "db"))
    return rows.withColumn("hz", A.bin_hz(F.col("tile_center_hz"), F.col("bin_hz"), F.col("n"), F.col("bin")))


def cfar_clusters(frames: DataFrame, train: int = 24, guard: int = 4, pfa: float = 1e-4, min_snr_db: float = 6.0) -> DataFrame:
    """Groups of bins that rise above the noise of their neighbourhood.

    Cells too near a frame's edge to have all training cells are not tested. The
    centre is the power-weighted centroid, the width holds 99 % of the energy.
    """
    alpha = A.cfar_alpha(train, pfa)
    lin = frames.withColumn("psd", F.filter("psd", lambda x: ~F.isnan(x))).withColumn("lin", A.to_linear(F.col("psd")))
    tested = lin.withColumn("noise", A.training_mean(train, guard)(F.col("lin"))).withColumn(
        "flags", F.zip_with("lin", "noise", lambda p, m: ~F.isnan(m) & (p > m * alpha))
    )
    groups = tested.where(F.exists("flags", lambda f: f)).select(
        *FRAME, "psd", "lin", "noise", F.inline(A.clusters(F.col("flags")))
    )
    length = F.col("last") - F.col("first") + 1
    cut = groups.select(
        *FRAME, F.size("psd").alias("n"), "noise", "first", "last",
        F.slice("psd", F.col("first") + 1, length).alias("part"),
        F.slice("lin", F.col("first") + 1, length).alias("power"),
    )
    peak = F.col("first") + A.last_peak(F.col("part"))
    weighted = F.aggregate(
        F.zip_with("power", F.sequence("first", "last"), lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x
    )
    lo, hi = A.energy_crossing(F.col("power"), 0.005), A.energy_crossing(F.col("power"), 0.995)
    measured = cut.select(
        *FRAME, "first", "last",
        F.array_max("part").alias("power_dbfs"),
        (F.array_max("part") - 10 * F.log10(F.greatest(F.get("noise", peak), F.lit(1e-24)))).alias("snr_db"),
        A.bin_hz(F.col("tile_center_hz"), F.col("bin_hz"), F.col("n"), weighted / A.total(F.col("power"))).alias("center_hz"),
        (F.col("bin_hz") * (F.when(F.size("part") == 1, 0).otherwise(F.greatest(hi, lo) - lo) + 1)).alias("bandwidth_hz"),
    )
    return measured.where(F.col("snr_db") >= min_snr_db)


def merge_adjacent(detections: DataFrame, gap_hz: float = 50_000.0) -> DataFrame:
    """Join detections of a frame whose edges lie within ``gap_hz``.

    A merged detection reaches as far as any part so far, so the running
    maximum of the upper edges decides where the next one begins.
    """
    lo, hi = F.col("center_hz") - F.col("bandwidth_hz") / 2, F.col("center_hz") + F.col("bandwidth_hz") / 2
    w = Window.partitionBy("frame_id").orderBy("center_hz", "first")
    edges = detections.withColumn("lo", lo).withColumn("hi", hi)
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = edges.withColumn("_new", F.when(F.col("lo") - reach <= gap_hz, 0).otherwise(1)).withColumn(
        "_part", F.sum("_new").over(w)
    )
    return (
        numbered.groupBy(*FRAME, "_part")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("power_dbfs").alias("power_dbfs"),
            F.max("snr_db").alias("snr_db"), F.count(F.lit(1)).alias("parts"),
            F.min("center_hz").alias("_c"), F.min("bandwidth_hz").alias("_b"),
        )
        .withColumn("center_hz", F.when(F.col("parts") == 1, F.col("_c")).otherwise((F.col("lo") + F.col("hi")) / 2))
        .withColumn("bandwidth_hz", F.when(F.col("parts") == 1, F.col("_b")).otherwise(F.col("hi") - F.col("lo")))
        .drop("_part", "_c", "_b")
    )


def detect(frames: DataFrame, train=24, guard=4, pfa=1e-4, min_snr_db=6.0, merge_gap_hz=50_000.0) -> DataFrame:
    found = cfar_clusters(frames, train, guard, pfa, min_snr_db)
    return merge_adjacent(found, merge_gap_hz)


def stitch(frames: DataFrame, lo_hz: float, hi_hz: float, cells: int) -> DataFrame:
    """Latest value per cell of one wide grid; empty cells read -240 dB."""
    width = (hi_hz - lo_hz) / cells
    hz = F.col("hz")
    filled = (
        long_bins(frames).where((hz >= lo_hz) & (hz < hi_hz))
        .groupBy(F.floor((hz - lo_hz) / width).cast("long").alias("cell"))
        .agg(F.max_by("db", F.struct("t_s", "frame_id", "bin")).alias("db"))
    )
    grid = frames.sparkSession.range(cells).withColumnRenamed("id", "cell")
    return grid.join(filled, "cell", "left").fillna(A.EMPTY_DB, ["db"])


def max_pool(grid: DataFrame, cells: int, width: int) -> DataFrame:
    """Each of ``width`` slots shows the strongest of its cells."""
    slot = F.col("cell") if width >= cells else F.expr(f"((cell + 1) * {width} - 1) div {cells}")
    return grid.groupBy(slot.alias("slot")).agg(F.max("db").alias("db"))


def baseline(frames: DataFrame, keys: list[str] = ["sensor"]) -> DataFrame:
    """Mean, population deviation, range and count of every bin."""
    return (
        frames.select(*keys, F.posexplode("psd").alias("bin", "db")).groupBy(*keys, "bin")
        .agg(
            F.avg("db").alias("mean"), F.stddev_pop("db").alias("std_dev"), F.min("db").alias("min"),
            F.max("db").alias("max"), F.count(F.lit(1)).alias("sample_count"),
        )
    )


def baseline_arrays(base: DataFrame, keys: list[str] = ["sensor"]) -> DataFrame:
    """A baseline as one row per sensor, bins in order (as long as a frame)."""
    row = F.struct("bin", "mean", "std_dev", "min", "max")
    return base.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("base"))


def anomalies(frames: DataFrame, base: DataFrame, z_threshold: float = 3.5, first: int | None = None) -> DataFrame:
    """Bins far from their baseline; with ``first``, for display, the lowest bins of each frame only.

    The baseline joins as arrays, so frames are neither exploded nor shuffled.
    """
    joined = frames.join(baseline_arrays(base), "sensor")

    def score(x: Column, b: Column) -> Column:
        delta = x - b["mean"]
        return F.struct(
            b["bin"].alias("bin"), delta.alias("delta_db"), (delta / b["std_dev"]).alias("z_score"),
            F.when(x > b["max"] + 3, "NewSignal").when(delta > 0, "PowerIncrease")
            .when(x < b["min"] - 3, "SignalGone").otherwise("PowerDecrease").alias("kind"),
            b["std_dev"].alias("std_dev"),
        )

    scored = F.filter(
        F.zip_with("psd", "base", score), lambda s: (s["std_dev"] >= 0.1) & (F.abs(s["z_score"]) >= z_threshold)
    )
    if first is not None:
        scored = F.slice(scored, 1, first)
    rows = joined.select(*FRAME, F.size("psd").alias("n"), F.inline(scored))
    return rows.select(
        *FRAME, "bin", "kind", "delta_db", "z_score",
        (A.bin_hz(F.col("tile_center_hz"), F.col("bin_hz"), F.col("n"), F.col("bin")) / 1e6).alias("freq_mhz"),
        F.when(F.abs("z_score") > 5, "CRITICAL").otherwise("WARNING").alias("severity"),
    )


def peaks(frames: DataFrame, threshold: float | Column) -> DataFrame:
    """Local maxima above a threshold."""
    level = F.lit(threshold) if isinstance(threshold, float) else threshold
    found = frames.select(*FRAME, "psd", F.size("psd").alias("n"), F.explode(A.local_maxima(F.col("psd"), level)).alias("bin"))
    hz = A.bin_hz(F.col("tile_center_hz"), F.col("bin_hz"), F.col("n"), F.col("bin"))
    return found.select(*FRAME, "bin", F.get("psd", F.col("bin")).alias("db"), hz.alias("hz"))


def interpolated_peaks(frames: DataFrame, threshold: float) -> DataFrame:
    """Peaks placed between bins, with the width of their skirt.

    A peak stands 6 dB above the median floor and 3 dB above one neighbour; its
    skirt is the run of bins more than 3 dB above the floor.
    """
    p, i = F.col("psd"), F.col("bin")
    floored = frames.where(F.size("psd") >= 3).withColumn("floor", A.upper_median(p))
    found = floored.select(
        *FRAME, "psd", "floor", F.size("psd").alias("n"),
        F.filter(A.indices(p), lambda j: F.get(p, j) <= F.col("floor") + 3).alias("low"),
        F.explode(A.local_maxima(p, F.greatest(F.lit(threshold), F.col("floor") + 6))).alias("bin"),
    )
    rise = F.greatest(F.get(p, i) - F.get(p, i - 1), F.get(p, i) - F.get(p, i + 1))
    offset, height = A.vertex(p, i)
    left = F.coalesce(F.array_max(F.filter("low", lambda j: j < i)), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter("low", lambda j: j > i)), F.col("n"))
    start = F.col("tile_center_hz") - F.col("n") / 2 * F.col("bin_hz")
    return found.where(rise >= 3).select(
        *FRAME, "bin", (start + (i + offset) * F.col("bin_hz")).alias("freq_hz"), height.alias("power"),
        ((right - left - 1) * F.col("bin_hz")).alias("bandwidth_hz"),
    )


def classified_peaks(frames: DataFrame, channels: DataFrame, margin_db: float, min_bandwidth_khz: float) -> DataFrame:
    """Peaks above their segment's floor, named from the channel catalogue."""
    p, i, n = F.col("psd"), F.col("bin"), F.col("n")
    found = frames.withColumn("floor", A.upper_median(p)).select(
        *FRAME, "psd", F.size("psd").alias("n"),
        F.explode(A.local_maxima(p, F.col("floor") + margin_db)).alias("bin"),
    )
    rise = F.greatest(F.get(p, i) - F.get(p, i - 1), F.get(p, i) - F.get(p, i + 1))
    offset, height = A.vertex(p, i)
    steep = found.where(rise >= 6).withColumn("_offset", offset).withColumn("power", height)
    mhz = lambda j: (F.col("tile_center_hz") - n / 2 * F.col("bin_hz") + j * F.col("bin_hz")) / 1e6
    middle = F.least(F.when(F.col("_offset") > 0, i + 1).otherwise(i), n - 1)
    weak = F.filter(A.indices(p), lambda j: F.get(p, j) < F.col("power") - margin_db / 2)
    sides = steep.withColumn("_m", middle).withColumn("_weak", weak)
    left = F.coalesce(F.array_max(F.filter("_weak", lambda j: j < F.col("_m"))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter("_weak", lambda j: j > F.col("_m"))), n - 1)
    wide = sides.select(
        *FRAME, "bin", (mhz(i) + F.col("_offset") * F.col("bin_hz") / 1e6).alias("freq_mhz"), "power",
        ((right - left) * F.col("bin_hz") / 1e3).alias("bandwidth_khz"),
    ).where(F.col("bandwidth_khz") >= min_bandwidth_khz)
    named = first_in_catalogue(wide, "freq_mhz", channels, "channel_freq", ["channel_id", "label", "channel_cls"], 0.015)
    rptr = is_repeater(F.col("freq_mhz"))
    return named.select(
        *FRAME, "bin", "freq_mhz", "power", "bandwidth_khz",
        F.coalesce("label", F.when(rptr, "Repeater").otherwise("Unknown")).alias("name"),
        F.coalesce("channel_cls", F.when(rptr, "RPTR").otherwise("UNK")).alias("cls"),
    )


def max_hold(frames: DataFrame, margin_db: float) -> DataFrame:
    """Strongest value per bin of a segment, its floor, and whether it rose."""
    held = frames.select("sensor", F.posexplode("psd").alias("bin", "db")).groupBy("sensor", "bin").agg(F.max("db").alias("db"))
    lines = held.groupBy("sensor").agg(F.array_sort(F.collect_list("db")).alias("sorted"))
    floor = F.get("sorted", F.floor(F.size("sorted") / 2).cast("int"))
    floors = lines.select("sensor", floor.alias("floor"), (F.array_max("sorted") > floor + margin_db).alias("had_signal"))
    return held.join(floors, "sensor")


def persistent(found: DataFrame, key: str, sweep: str, window: int, min_hits: int) -> DataFrame:
    """Detections whose key was seen in at least ``min_hits`` of the last sweeps.

    Each sighting adds one to its own and the following sweeps; counting is then
    a plain aggregate, whatever the number of sightings of a key.
    """
    seen = found.select("sensor", key, sweep).distinct()
    counts = (
        seen.withColumn(sweep, F.explode(F.sequence(F.col(sweep), F.col(sweep) + window - 1)))
        .groupBy("sensor", key, sweep).agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= min_hits)
    )
    return found.join(counts, ["sensor", key, sweep])


def sweep_numbers(frames: DataFrame, width_s: int = 3600) -> DataFrame:
    return with_position(frames, ["sensor"], ["t_s", "frame_id"], width_s, out="sweep")


def running_average(frames: DataFrame, alpha: float) -> DataFrame:
    """Exponential average of every bin after the sensor's last frame.

    The recursion a = alpha*x + (1-alpha)*a unrolls to a weighted sum, so it is
    an ordinary aggregate once every frame knows its place.
    """
    placed = sweep_numbers(frames)
    last = frames.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_frames"))
    age = F.col("n_frames") - F.col("sweep")
    weight = F.pow(F.lit(1 - alpha), age) * F.when(F.col("sweep") == 1, 1.0).otherwise(alpha)
    return (
        placed.join(last, "sensor").select("sensor", weight.alias("w"), F.posexplode("psd").alias("bin", "db"))
        .groupBy("sensor", "bin").agg(F.sum(F.col("w") * F.col("db")).alias("avg_db"))
    )


def harmonic_groups(tolerance_pct: float = 1.0):
    """Pandas UDF: peaks (MHz) of a frame -> fundamentals with their harmonics.

    The claim is greedy: a peak used once is never used again.
    """
    kind = "array<struct<fundamental_mhz: double, harmonics: array<double>>>"

    @F.pandas_udf(kind)
    def udf(peaks_mhz: pd.Series) -> pd.Series:
        out = []
        for line in peaks_mhz:
            f = np.asarray([] if line is None else line, dtype="float64")
            used, groups = np.zeros(len(f), dtype=bool), []
            for i in range(len(f)):
                if used[i] or f[i] <= 0:
                    continue
                ratio = f / f[i]
                order = np.floor(ratio + 0.5)
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = (order >= 2) & (np.abs(ratio - order) / order < tolerance_pct / 100)
                near &= ~used
                near[i] = False
                if near.any():
                    used |= near
                    used[i] = True
                    groups.append({"fundamental_mhz": f[i], "harmonics": f[near].tolist()})
            out.append(groups)
        return pd.Series(out)

    return udf


def oscillator(mhz: Column) -> Column:
    """A likely clock behind a fundamental, where one lies within 1 %."""
    out = F.lit(None).cast("string")
    for freq, label in reversed(ref.OSCILLATORS):
        out = F.when(F.abs(mhz - freq) / freq < 0.01, label).otherwise(out)
    return out
