"""Intermediate results that several parts of a job read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wavetrail.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a result to the cluster's shared folder and reads it from there.

    It is computed once however often it is used, its size is known to the planner, and a lost executor costs no recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/work-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
