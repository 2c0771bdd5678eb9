"""Geofence sessions: enter the nearest site within its radius, leave beyond twice that.

Whether a device is at a site depends on its whole past, so this is a state
machine. A device's track is cut into time slices. Each slice is run from every
site it could start at, which gives a small table (state before -> state after);
the tables of a device are chained; then every slice is replayed on its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.scalars import haversine_m
from wavetrail.operators.ordered import NS

EXIT_FACTOR = 2.0
NOWHERE, ELSEWHERE = -1, -2
LAT_METRES = 110_000.0


def near_sites(positions: DataFrame, sites: DataFrame) -> DataFrame:
    """Positions with ``enter`` (nearest site within radius) and ``keep`` (within twice).

    Sites are listed per cell of latitude and longitude, as wide as the largest exit
    radius among them, so a position meets the sites of its own cell and its
    neighbours. Positions without a latitude or longitude say nothing and are left out.
    """
    widest = sites.agg(F.max("radius_m")).first()[0] or 0.0  # one number of a dimension
    band = max(widest, 1.0) * EXIT_FACTOR / LAT_METRES
    # a degree of longitude shrinks towards the poles; the cell is wide enough for every latitude of the band and the next ones
    edge = F.least(F.greatest(F.abs(F.col("_b")), F.abs(F.col("_b") + 1)) + 1, F.lit(89.5 / band)) * F.lit(band)
    cell = lambda lon: F.floor(lon * F.cos(F.radians(edge)) / F.lit(band)).cast("long")
    row = F.struct("site_id", "lat", "lon", "radius_m")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    listed = (
        sites.withColumn("_b", F.floor(F.col("lat") / F.lit(band)).cast("long"))
        .withColumn("_b", F.explode(F.transform(around, lambda d: F.col("_b") + d)))
        .withColumn("_turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))))  # both sides of the date line
        .withColumn("_c", F.explode(F.transform(around, lambda d: cell(F.col("lon") + F.col("_turn")) + d)))
        .groupBy("_b", "_c").agg(F.collect_set(row).alias("_sites"))
    )
    known = positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_b", F.floor(F.col("lat") / F.lit(band)).cast("long"))
    here = known.withColumn("_c", cell(F.col("lon"))).join(listed, ["_b", "_c"], "left")
    dist = F.transform(
        F.coalesce("_sites", F.array().cast("array<struct<site_id: bigint, lat: double, lon: double, radius_m: double>>")),
        lambda s: F.struct(haversine_m(F.col("lat"), F.col("lon"), s["lat"], s["lon"]).alias("d"), s["site_id"].alias("site_id"), s["radius_m"].alias("r")),
    )
    enter = F.array_min(F.filter("_dist", lambda x: x["d"] <= x["r"]))["site_id"]
    keep = F.array_sort(F.transform(F.filter("_dist", lambda x: x["d"] <= x["r"] * EXIT_FACTOR), lambda x: x["site_id"]))
    return here.withColumn("_dist", dist).withColumn("enter", enter).withColumn("keep", keep).drop("_b", "_c", "_sites", "_dist")


def _run(state: int, enters, keeps, visit=None) -> int:
    """Follow a slice from ``state``; ``visit(i, kind, site)`` sees every change."""
    for i, (site, keep) in enumerate(zip(enters, keeps)):
        if state != NOWHERE:
            if state not in keep:
                if visit:
                    visit(i, "exit", state)
                state = NOWHERE
        elif site == site and site is not None:
            state = int(site)
            if visit:
                visit(i, "enter", state)
    return state


def site_visits(positions: DataFrame, sites: DataFrame, width: int = 86400 * NS) -> DataFrame:
    """Enter and exit events of every device, in its own time order.

    A third position in a row with the same ``enter`` and ``keep`` cannot change
    anything, so a track keeps only the first two of each run.
    """
    row = F.struct("timestamp_ns", "id", "enter", "keep")
    near = near_sites(positions, sites).withColumn("slice", F.expr(f"timestamp_ns div {width}L")).withColumn("_now", F.struct("enter", "keep"))
    w = Window.partitionBy("device", "slice").orderBy("timestamp_ns", "id")
    same = lambda k: F.coalesce(F.lag("_now", k).over(w) == F.col("_now"), F.lit(False))
    changes = near.withColumn("_idle", same(1) & same(2)).where(~F.col("_idle"))
    tracks = changes.groupBy("device", "slice").agg(F.array_sort(F.collect_list(row)).alias("track"))

    @F.pandas_udf("array<struct<before: bigint, after: bigint>>")
    def outcomes(track: pd.Series) -> pd.Series:
        out = []
        for t in track:
            enters, keeps = [r["enter"] for r in t], [set(r["keep"]) for r in t]
            # A site not near the first position is left at once, whichever it is.
            out.append([{"before": s, "after": _run(s, enters, keeps)} for s in (NOWHERE, ELSEWHERE, *keeps[0])])
        return pd.Series(out)

    @F.pandas_udf("array<bigint>")
    def chained(steps: pd.Series) -> pd.Series:
        out = []
        for table in steps:
            state, before = NOWHERE, []
            for step in table:
                before.append(state)
                after = {x["before"]: x["after"] for x in step["after"]}
                state = after.get(state, after[ELSEWHERE])
            out.append(before)
        return pd.Series(out)

    @F.pandas_udf("array<struct<id: bigint, timestamp_ns: bigint, change: string, site_id: bigint>>")
    def replay(track: pd.Series, state: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(track, state):
            seen = []
            note = lambda i, kind, site, t=t, seen=seen: seen.append(
                {"id": t[i]["id"], "timestamp_ns": t[i]["timestamp_ns"], "change": kind, "site_id": site}
            )
            _run(int(s), [r["enter"] for r in t], [set(r["keep"]) for r in t], note)
            out.append(seen)
        return pd.Series(out)

    steps = (
        tracks.withColumn("after", outcomes("track")).groupBy("device")
        .agg(F.array_sort(F.collect_list(F.struct("slice", "after"))).alias("steps"))
    )
    pairs = F.arrays_zip(F.transform("steps", lambda x: x["slice"]).alias("slice"), chained("steps").alias("state"))
    states = steps.select("device", F.inline(pairs))
    return tracks.join(states, ["device", "slice"]).select("device", F.inline(replay("track", "state")))
