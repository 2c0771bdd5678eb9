"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Functions sent to executors carry their own code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["wavetrail"])

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "wavetrail") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Event times are UTC instants, so every session must run in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster.

    Work folders below it have random names; whoever owns the folder clears it when
    the application has ended.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return path.rstrip("/")
