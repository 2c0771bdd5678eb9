"""Harmonic groups over time: a group just reported is not reported again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = "sensor long, t_s long, frame_id long, fundamental_mhz double"


def suppress_repeats(groups: DataFrame, tolerance_mhz: float = 1.0, memory_s: int = 60) -> DataFrame:
    """Keep a group unless one kept less than ``memory_s`` ago lies within tolerance.

    The rule looks back at what was kept, so it runs in order. Cells of frequency
    (as wide as the tolerance) that do not touch never interact, nor do groups
    separated by a silence of ``memory_s``; each such patch is its own task.
    """
    cell = F.floor(F.col("fundamental_mhz") / F.lit(tolerance_mhz)).cast("long")
    placed = groups.select("sensor", "t_s", "frame_id", "fundamental_mhz").withColumn("_cell", cell)
    # Occupied cells per sensor: bounded by the spectrum's width over the tolerance.
    w = Window.partitionBy("sensor").orderBy("_cell")
    runs = (
        placed.select("sensor", "_cell").distinct()
        .withColumn("_new", F.coalesce((F.col("_cell") - F.lag("_cell").over(w) > 1).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(w)).drop("_new")
    )
    banded = placed.join(runs, ["sensor", "_cell"])
    # Distinct times per run: bounded by the length of the record in seconds.
    t = Window.partitionBy("sensor", "_run").orderBy("t_s")
    times = (
        banded.select("sensor", "_run", "t_s").distinct()
        .withColumn("_new", F.coalesce((F.col("t_s") - F.lag("t_s").over(t) >= memory_s).cast("int"), F.lit(1)))
        .withColumn("_patch", F.sum("_new").over(t)).drop("_new")
    )

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_s", "frame_id", "fundamental_mhz"])
        t_s, mhz = pdf["t_s"].to_numpy(), pdf["fundamental_mhz"].to_numpy()
        kept: list[int] = []
        first = 0
        for i in range(len(pdf)):
            while first < len(kept) and t_s[kept[first]] <= t_s[i] - memory_s:
                first += 1
            recent = kept[first:]
            if not recent or not (np.abs(mhz[recent] - mhz[i]) < tolerance_mhz).any():
                kept.append(i)
        return pdf.iloc[kept][["sensor", "t_s", "frame_id", "fundamental_mhz"]]

    return banded.join(times, ["sensor", "_run", "t_s"]).groupBy("sensor", "_run", "_patch").applyInPandas(keep, COLUMNS)
