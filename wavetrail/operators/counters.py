"""Several counters over several tables as one row (or one row per key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(parts: list[tuple[DataFrame, dict[str, Column]]], keys: list[str] = []) -> DataFrame:
    """Each table is aggregated once; the small results meet in one last group.

    Missing counters of a key are 0.
    """
    longs = []
    for df, measures in parts:
        totals = df.groupBy(*keys).agg(*[m.cast("long").alias(n) for n, m in measures.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in measures])
        longs.append(totals.select(*keys, F.inline(pairs)))
    names = [n for _, measures in parts for n in measures]
    merged = reduce(DataFrame.unionByName, longs)
    return merged.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0).cast("long")).alias(n) for n in names]
    )


def tally(condition: Column) -> Column:
    """How many rows meet a condition (0 for none)."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def rows() -> Column:
    return F.count(F.lit(1))
