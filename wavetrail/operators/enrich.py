"""Enrichment: named stages over a frame, and stamps from other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.operators.joins import asof_backward
from wavetrail.operators.ordered import NS

Stage = Callable[[DataFrame], DataFrame]
ENRICHERS: dict[str, Stage] = {}


def enricher(name: str):
    """Register a user stage; it may add or fill columns and drop rows."""

    def wrap(stage: Stage) -> Stage:
        ENRICHERS[name] = stage
        return stage

    return wrap


def enrich(log: DataFrame, stages: list[str | Stage]) -> DataFrame:
    """Apply stages in order, on a batch or a stream."""
    for stage in stages:
        log = log.transform(ENRICHERS[stage] if isinstance(stage, str) else stage)
    return log


def fill(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), value) if column in df.columns else value)


def stamp_position(log: DataFrame, positions: DataFrame, key: str = "device_key", width: int = 3600 * NS) -> DataFrame:
    """The receiver's latest position, where an event has none of its own.

    Positions at latitude 0 come from receivers without a fix and do not count.
    """
    fixes = positions.where(F.abs("lat") > 0.01)
    found = asof_backward(log, fixes, [key], "timestamp_ns", ["lat", "lon"], width)
    own = F.col("receiver_lat").isNotNull()
    return (
        found.withColumn("receiver_lon", F.when(own, F.col("receiver_lon")).otherwise(F.col("match.lon")))
        .withColumn("receiver_lat", F.when(own, F.col("receiver_lat")).otherwise(F.col("match.lat")))
        .drop("match")
    )


def stamp_context(log: DataFrame, sessions: DataFrame, key: str = "device_key", width: int = 86400 * NS) -> DataFrame:
    """Operation and site session active at the event, where it has none.

    A receiver has one active session: the latest to start, until its end.
    """
    starts = sessions.withColumn("timestamp_ns", F.unix_micros("start_time") * 1000).withColumn(
        "end_ns", F.unix_micros("end_time") * 1000
    )
    found = asof_backward(log, starts, [key], "timestamp_ns", ["session_id", "operation_id", "end_ns"], width, tie="session_id")
    live = F.col("match").isNotNull() & (F.col("match.end_ns").isNull() | (F.col("timestamp_ns") <= F.col("match.end_ns")))
    session = F.when(live & (F.col("match.session_id") > 0), F.col("match.session_id"))
    operation = F.when(live & (F.col("match.operation_id") > 0), F.col("match.operation_id"))
    out = fill(found, "site_session_id", session)
    return fill(out, "operation_id", operation).drop("match")


def combine_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of several trackers as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
