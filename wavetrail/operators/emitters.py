"""Emitter, fingerprint and pulse analysis."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.functions import scalars as S
from wavetrail.operators.joins import asof_backward
from wavetrail.operators.ordered import NS, gap_sessions, with_position, with_previous
from wavetrail.sources.work import stored


def match_library(df: DataFrame, keep: list[str], freq: str, pri: str | None, pw: str | None) -> DataFrame:
    """Best library entry for measured emitters; the last entry wins ties.

    The library is ten constant rows in an array of each row's expression: no join and no shuffle.
    """

    def bonus(value: str | None, low: float, high: float, points: float) -> Column:
        if value is None:
            return F.lit(0.0)
        return F.when(F.col(value).between(low, high), points).otherwise(0.0)

    entries = [
        F.when(
            F.col(freq).between(f_min, f_max),
            F.struct(
                F.least(F.lit(1.0), 0.5 + bonus(pri, pri_min, pri_max, 0.3) + bonus(pw, pw_min, pw_max, 0.2)).alias("score"),
                F.lit(ref_id).alias("ref_id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"),
            ),
        )
        for ref_id, name, kind, f_min, f_max, pri_min, pri_max, pw_min, pw_max in ref.EMITTERS
    ]
    best = F.array_max(F.array(*entries))  # by score, then by the entry's place
    return df.withColumn("_best", best).select(
        *keep, F.col("_best.name").alias("id_match"), F.col("_best.kind").alias("emitter_type"), F.coalesce("_best.score", F.lit(0.0)).alias("confidence")
    )


def match_drones(df: DataFrame, keep: list[str], freq: str, bandwidth: str) -> DataFrame:
    """First drone signature whose range overlaps the measured band, from an array of the constant ranges."""
    f, b = F.col(freq), F.col(bandwidth)
    entries = [
        F.when(
            (f - b / 2 <= hi) & (f + b / 2 >= lo),
            F.struct(
                F.lit(order).alias("order"), F.lit(manufacturer).alias("manufacturer"), F.lit(model).alias("model"),
                F.least(F.lit(1.0), 0.5 + 0.5 * F.least(b / bw, F.lit(bw) / b)).alias("confidence"),
            ),
        )
        for order, manufacturer, model, spans, bw in ref.DRONES for lo, hi in spans
    ]
    found = df.withColumn("_best", F.array_min(F.array(*entries))).where(F.col("_best").isNotNull())
    return found.select(*keep, "_best.manufacturer", "_best.model", "_best.confidence")


def pulse_intervals(pdw: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Time since the emitter's previous pulse in microseconds, NULL at first."""
    seen = with_previous(pdw, ["emitter"], ["timestamp_ns", "id"], ["toa"], width)
    return seen.withColumn("pri_us", (F.col("toa") - F.col("prev.toa")) * 1e6).drop("prev")


def pri_stats(pulses: DataFrame) -> DataFrame:
    """Interval spread per frequency, classed by (max - min) / mean."""
    s = (
        pulses.where(F.col("pri_us").isNotNull()).groupBy(F.round("freq_mhz", 1).alias("freq_mhz"))
        .agg(
            F.count(F.lit(1)).alias("cnt"), F.avg("pri_us").alias("mean_pri_us"), F.min("pri_us").alias("min_pri_us"),
            F.max("pri_us").alias("max_pri_us"),
        )
    )
    spread = (F.col("max_pri_us") - F.col("min_pri_us")) / F.col("mean_pri_us")
    pattern = F.when(spread < 0.05, "Stable").when(spread < 0.20, "Stagger").otherwise("Jitter")
    return s.withColumn("pattern", pattern)


def pri_patterns(pulses: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Interval pattern of each emitter by variation, then by short cycles.

    A cycle of c intervals repeats if interval p matches interval p mod c within
    2 %. Comparing each interval with the emitter's first five needs its position
    and one small array per emitter, never the whole list.
    """
    timed = pulses.where(F.col("pri_us").isNotNull())
    placed = with_position(timed, ["emitter"], ["timestamp_ns", "id"], width)
    head = (
        placed.where(F.col("pos") <= 5).groupBy("emitter")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pri_us"))), lambda s: s["pri_us"]).alias("head"))
    )
    stats = timed.groupBy("emitter").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pri_us").alias("mean"), F.stddev_pop("pri_us").alias("std")
    )

    def repeats(c: int) -> Column:
        template = F.get("head", ((F.col("pos") - 1) % c).cast("int"))
        return F.bool_and(F.coalesce(F.abs(F.col("pri_us") - template) / template < 0.02, F.lit(False))) & (F.count(F.lit(1)) >= 2 * c)

    cycles = placed.join(head, "emitter").groupBy("emitter").agg(
        (repeats(2) | repeats(3) | repeats(4) | repeats(5)).alias("stagger")
    )
    cv = F.col("std") / F.col("mean")
    pattern = (
        F.when((F.col("n") < 3) | (F.col("mean") == 0), "Insufficient").when(cv < 0.01, "Stable").when(cv < 0.05, "Jitter")
        .when(F.col("stagger"), "Stagger").otherwise("Agile")
    )
    return stats.join(cycles, "emitter").select("emitter", F.col("n").alias("pulses"), pattern.alias("pattern"))


def fingerprint_catalogue(captures: DataFrame, cfo_bucket: float = 5.0, resolution: float = 1e-4) -> DataFrame:
    """One row per fingerprint: latest measures, first power variance, use."""
    order = F.struct("timestamp_ns", "capture_id")
    fp = S.fingerprint_id(F.col("cfo_hz"), F.col("iq_amplitude_imbal"), F.col("iq_phase_imbal"), cfo_bucket, resolution)
    latest = ["cfo_hz", "iq_amplitude_imbal", "iq_phase_imbal", "avg_power_db", "freq_mhz"]
    return (
        captures.withColumn("fingerprint_id", fp).groupBy("fingerprint_id")
        .agg(
            F.count(F.lit(1)).alias("capture_count"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
            F.min_by("power_variance", order).alias("evm"), *[F.max_by(c, order).alias(c) for c in latest],
        )
    )


def near_values(values: DataFrame, column: str, catalogue: DataFrame, other: str, tolerance: float) -> DataFrame:
    """Pairs of distinct values closer than ``tolerance`` (for dimension keys)."""
    b = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    left = values.select(column).distinct().withColumn("_bin", F.explode(F.array(b(column) - 1, b(column), b(column) + 1)))
    right = catalogue.select(other).distinct().withColumn("_bin", b(other))
    return left.join(right, "_bin").where(F.abs(F.col(column) - F.col(other)) < tolerance).drop("_bin")


def recent_grant(
    captures: DataFrame, grants: DataFrame, window_ns: int, tolerance_mhz: float = 0.002, width: int = 3600 * NS
) -> DataFrame:
    """Latest grant near each capture's frequency within the last ``window_ns``.

    The distinct frequencies are paired first (a small table); then the as-of
    join runs per exact grant frequency, and the latest of the candidates wins.
    """
    given = grants.where(F.col("voice_freq").isNotNull())
    pairs = near_values(captures, "freq_mhz", given, "voice_freq", tolerance_mhz)
    # the as-of join reads its probes twice
    probes = stored(captures.join(pairs, "freq_mhz").select("capture_id", "timestamp_ns", "voice_freq"), "probes")
    found = asof_backward(
        probes, given.withColumnRenamed("id", "grant_id"), ["voice_freq"], "timestamp_ns",
        ["grant_id", "tgid", "uid", "system"], max(width, window_ns), tie="grant_id",
    ).where(F.col("timestamp_ns") - F.col("match.at") <= window_ns)
    return found.groupBy("capture_id", "timestamp_ns").agg(
        F.max_by("match", F.struct("match.at", "match.grant_id")).alias("m")
    ).select(
        "capture_id", "timestamp_ns", "m.grant_id", "m.tgid", "m.uid", "m.system", F.col("m.at").alias("grant_ns")
    )


def uid_links(captures: DataFrame, grants: DataFrame, window_ns: int, cfo_bucket: float, resolution: float) -> DataFrame:
    """Radio to fingerprint links, with the first radio to claim a fingerprint."""
    fp = S.fingerprint_id(F.col("cfo_hz"), F.col("iq_amplitude_imbal"), F.col("iq_phase_imbal"), cfo_bucket, resolution)
    ids = captures.select("capture_id", fp.alias("fingerprint_id"))
    seen = recent_grant(captures, grants, window_ns).where(F.col("uid") > 0).join(ids, "capture_id")
    grouped = seen.groupBy("uid", "fingerprint_id").agg(
        F.count(F.lit(1)).alias("observation_count"), F.min(F.struct("timestamp_ns", "capture_id")).alias("first"),
        F.max("timestamp_ns").alias("last_ns"),
    )
    links = stored(grouped, "links")
    claim = links.groupBy("fingerprint_id").agg(F.min_by("uid", "first").alias("claimed_by"))
    return links.join(claim, "fingerprint_id").select(
        "uid", "fingerprint_id", "observation_count", F.col("first.timestamp_ns").alias("first_ns"), "last_ns", "claimed_by"
    )


def uid_mismatches(links: DataFrame) -> DataFrame:
    """Each further fingerprint of a radio after its first one."""
    first = links.groupBy("uid").agg(F.min_by("fingerprint_id", F.struct("first_ns", "fingerprint_id")).alias("known_fingerprint"))
    return links.join(first, "uid").where(F.col("fingerprint_id") != F.col("known_fingerprint")).select(
        "uid", "known_fingerprint", "fingerprint_id", "first_ns"
    )


def tracks(detections: DataFrame, keys: list[str], gap_ns: int) -> DataFrame:
    """Detections of one make and model joined into tracks."""
    return gap_sessions(
        detections, keys, "timestamp_ns", gap_ns,
        {"detections": F.count(F.lit(1)), "peak_signal": F.max("power")}, {"detections": F.sum, "peak_signal": F.max},
    )


def claim_emitters(peaks: DataFrame, tolerance_mhz: float = 0.5, raster_decimals: int = 6) -> DataFrame:
    """Emitters in order of appearance: a peak near a known one refreshes it.

    The rule depends on order of arrival, so it cannot be a plain group. Peaks
    shrink to distinct frequencies first, on a raster that is a parameter (1 Hz); frequencies further apart
    than the tolerance never meet, so runs of touching cells of that width are
    independent and are claimed in parallel.
    """
    freq = peaks.groupBy(F.round("freq_mhz", raster_decimals).alias("freq_mhz")).agg(
        F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"), F.count(F.lit(1)).alias("hits")
    )
    cell = F.floor(F.col("freq_mhz") / F.lit(tolerance_mhz)).cast("long")
    placed = freq.withColumn("_cell", cell)
    # Cells are a property of the radio spectrum (at most its width over the tolerance), not of the data.
    occupied = placed.select("_cell").distinct()
    w = Window.orderBy("_cell")
    runs = occupied.withColumn("_new", F.coalesce((F.col("_cell") - F.lag("_cell").over(w) > 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w)).drop("_new")

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_s", "freq_mhz"])
        known: list[float] = []  # sorted; emitters lie at least the tolerance apart
        born: dict[float, int] = {}
        owner = []
        for f in pdf["freq_mhz"].tolist():
            at = bisect_left(known, f)
            near = [e for e in known[max(at - 1, 0): at + 1] if abs(e - f) < tolerance_mhz]
            if near:
                owner.append(min(near, key=born.get))
            else:
                known.insert(at, f)
                born[f] = len(born)
                owner.append(f)
        return pd.DataFrame({
            "emitter_mhz": owner, "freq_mhz": pdf["freq_mhz"].to_numpy(), "first_s": pdf["first_s"].to_numpy(),
            "last_s": pdf["last_s"].to_numpy(), "hits": pdf["hits"].to_numpy(),
        })

    owned = placed.join(runs, "_cell").groupBy("_run").applyInPandas(
        claim, "emitter_mhz double, freq_mhz double, first_s long, last_s long, hits long"
    )
    return owned.groupBy("emitter_mhz").agg(
        F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.sum("hits").alias("hits")
    )


def emitter_status(emitters: DataFrame, as_of_s: int, gone_s: int = 86400) -> Column:
    """NEW within a day of first sight, GONE after a day of silence, else UNKNOWN."""
    return (
        F.when(as_of_s - F.col("last_s") > gone_s, "GONE").when(as_of_s - F.col("first_s") <= gone_s, "NEW").otherwise("UNKNOWN")
    )
