"""Writing the event log and derived tables, and read-only access for users."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.operators.query import SECOND_NS
from wavetrail.session import shared_dir


def with_event_date(log: DataFrame) -> DataFrame:
    return log.withColumn("event_date", F.to_date(F.timestamp_seconds(F.expr(f"timestamp_ns div {SECOND_NS}L"))))


def append_events(log: DataFrame, path: str) -> None:
    """Append to the log, one folder per day, rows of a file in time order.

    Ranges of (day, time) give writers of equal size, so a busy day is spread
    over many files and a quiet one is a single file.
    """
    (
        with_event_date(log).repartitionByRange("event_date", "timestamp_ns")
        .sortWithinPartitions("event_date", "timestamp_ns")
        .write.mode("append").partitionBy("event_date").parquet(path)
    )


def read_events(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def purged(before_ns: int) -> Column:
    """Rows a purge removes: whole 30 s buckets that end before the cut."""
    bucket = before_ns - before_ns % (30 * SECOND_NS)
    return (F.col("ts_bucket") < bucket) & (F.col("timestamp_ns") < before_ns)


def kept_after_purge(log: DataFrame, before_ns: int) -> DataFrame:
    return log.where(~purged(before_ns))


def purge_table(spark: SparkSession, table: str, before_ns: int) -> None:
    """Purge a stored log that is partitioned by ``event_date``.

    Days before the cut are dropped as partitions, the day of the cut is replaced
    by its kept rows, and later days are not read. The kept rows go through the
    shared folder because a table cannot be overwritten while it is read. There is
    no common commit: a purge that broke off is completed by running it again.
    """
    cut_day = F.to_date(F.timestamp_seconds(F.lit(before_ns // SECOND_NS)))
    day = datetime.datetime.fromtimestamp(before_ns // SECOND_NS, datetime.timezone.utc).date().isoformat()
    log = spark.table(table)
    # Partition names only: one short row per day of record.
    days = sorted(r["partition"].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    for d in days:
        if d < day:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_date = DATE'{d}')")
    if day not in days:
        return
    staging = f"{shared_dir(spark)}/purge-{table}-{uuid.uuid4().hex}"
    kept_after_purge(log.where(F.col("event_date") == cut_day), before_ns).write.parquet(staging)
    kept = spark.read.schema(log.schema).parquet(staging)
    if kept.isEmpty():
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (event_date = DATE'{day}')")
        return
    columns = ", ".join(c for c in log.columns if c != "event_date")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (event_date = DATE'{day}') SELECT {columns} FROM {{kept}}", kept=kept)


def compact_grants(grants: DataFrame, talkgroups: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Hourly roll-up of grants before the cutoff, and the raw rows that stay."""
    old = grants.where(F.col("ts") < cutoff)
    dim = talkgroups.select("tgid", "system", F.col("encrypted").alias("tg_encrypted"))
    hourly = (
        old.join(dim, ["tgid", "system"], "left")
        .groupBy(
            "system", "tgid", "grant_type", F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("hour")
        )
        .agg(
            F.count(F.lit(1)).alias("grant_count"),
            F.count_distinct("uid").alias("unique_uids"),
            F.sum(F.when(F.col("tg_encrypted") == "encrypted", 1).otherwise(0)).alias("encrypted_count"),
            F.max("operation_id").alias("operation_id"),
        )
    )
    return hourly, grants.where(F.col("ts") >= cutoff)


def upsert_latest(rows: DataFrame, keys: list[str], arrival: list[str], keep_first: list[str] = []) -> DataFrame:
    """One row per key: the last arrival wins, ``keep_first`` columns keep the first."""
    rest = [c for c in rows.columns if c not in keys]
    seq = F.struct(*arrival)
    return rows.groupBy(*keys).agg(
        *[(F.min_by(c, seq) if c in keep_first else F.max_by(c, seq)).alias(c) for c in rest]
    )


def run_read_only(spark: SparkSession, text: str) -> DataFrame:
    """A user's query over registered views, with all its rows.

    The parser is the guard: the text must be what may stand in parentheses, which a query may and a command may not.
    """
    try:
        return spark.sql(f"SELECT * FROM (\n{text}\n)")
    except ParseException as error:
        raise ValueError("only a single query is allowed") from error


def describe_views(spark: SparkSession, views: dict[str, DataFrame]) -> DataFrame:
    """Every column of every view with its type and the view's row count."""
    parts = []
    for name, df in sorted(views.items()):
        columns = F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.lit(t).alias("column_type"))
            for i, (c, t) in enumerate(df.dtypes, 1)
        ])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(name).alias("view_name"), "row_count", F.inline(columns))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
