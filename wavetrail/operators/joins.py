"""Interval, tolerance and as-of joins as equi joins on bins.

Spark would run these conditions as a nested loop. Binning the range key turns
them into hash or sort-merge joins that AQE can broadcast (by measured size) or
split when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.operators.ordered import clip_intervals, merge_intervals, slice_no


def to_seconds_intervals(sessions: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """Session times as epoch microseconds; an open end runs to ``as_of``."""
    return sessions.select(
        *keys,
        F.unix_micros("start_time").alias("start_t"),
        F.unix_micros(F.coalesce("end_time", as_of)).alias("end_t"),
    )


def within_intervals(
    df: DataFrame, time_us: Column, sessions: DataFrame, as_of: Column, keys: list[str], cell_s: int = 1800
) -> DataFrame:
    """Semi join: rows inside ANY session, once each, with the session keys.

    Sessions are united per key and cut into cells, so each row meets only the
    few pieces of its own cell. A row on a cell border is looked up once: it
    belongs to the cell it starts. Sessions need a key, or one task would unite all.
    """
    if not keys:
        raise ValueError("sessions are united per key")
    cell = cell_s * 1_000_000
    spans = to_seconds_intervals(sessions, as_of, keys)
    pieces = clip_intervals(merge_intervals(spans, keys, "start_t", "end_t", cell), keys, "start_t", "end_t", cell)
    left = df.withColumn("_t", time_us).withColumn("cell", F.floor(F.col("_t") / F.lit(cell)).cast("long"))
    hit = left.join(pieces, "cell").where((F.col("_t") >= F.col("start_t")) & (F.col("_t") <= F.col("end_t")))
    return hit.drop("cell", "_t", "start_t", "end_t")


def with_intervals(
    df: DataFrame, time_us: Column, sessions: DataFrame, as_of: Column, keys: list[str], cell_s: int = 1800, block: int = 4096
) -> DataFrame:
    """Inner join: one output row per session that covers the row.

    The output may be far larger than both inputs, so their bytes say nothing about the work. Rows of a cell are dealt by hash to blocks
    of about ``block``; a piece of a session goes to every block of its cell that has rows, once, and meets the block's rows there. Tasks
    hold blocks, not cells: what is shuffled is the rows, the pieces and one row for ``block`` candidates. Only the number of blocks per cell is
    broadcast. Equal rows share a block, which is cut into lists of at most twice ``block``. Columns of ``df`` must be hashable.
    """
    spark = df.sparkSession
    # tasks are not merged by their bytes, and a table of pieces is not taken for as small as the sessions it is made from
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cell = cell_s * 1_000_000
    timed = df.withColumn("_t", time_us).where("_t IS NOT NULL").withColumn("cell", F.floor(F.col("_t") / F.lit(cell)).cast("long"))
    blocks = F.broadcast(timed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("_blocks")))
    held = (
        timed.join(blocks, "cell")
        .withColumn("_block", F.pmod(F.xxhash64("_t", *df.columns), F.col("_blocks")))
        .repartition(tasks, "cell", "_block")
        .withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("cell", "_block").orderBy("_t")) - 1) / F.lit(2 * block)))
        .groupBy("cell", "_block", "_part")
        .agg(F.collect_list(F.struct("_t", *df.columns)).alias("_rows"))
    )
    spans = to_seconds_intervals(sessions, as_of, keys).repartition(tasks)
    pieces = (
        clip_intervals(spans, keys, "start_t", "end_t", cell)
        .join(blocks, "cell")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .drop("_blocks")
        .repartition(tasks, "cell", "_block")
    )
    met = pieces.hint("merge").join(held, ["cell", "_block"]).select(*keys, "start_t", "end_t", F.inline("_rows"))
    return met.where((F.col("_t") >= F.col("start_t")) & (F.col("_t") <= F.col("end_t"))).select(*df.columns, *keys)


def count_intervals(
    df: DataFrame, time_us: Column, sessions: DataFrame, as_of: Column, keys: list[str], cell_s: int = 1800
) -> DataFrame:
    """One output row per key that has sessions which cover the row, with their number as ``covers``.

    What ``with_intervals`` would give as that many rows: starts and ends of a key's sessions are summed up inside each cell, and a row
    meets the steps of its cell.
    """
    cell = cell_s * 1_000_000
    pieces = clip_intervals(to_seconds_intervals(sessions, as_of, keys), keys, "start_t", "end_t", cell)
    # the instant of a cell's end belongs to the next one
    after = F.least(F.col("end_t"), (F.col("cell") + 1) * cell - 1) + 1
    ends = F.array(F.struct(F.col("start_t").alias("start_t"), F.lit(1).alias("_d")), F.struct(after.alias("start_t"), F.lit(-1).alias("_d")))
    edges = pieces.select(*keys, "cell", F.inline(ends)).groupBy(*keys, "cell", "start_t").agg(F.sum("_d").alias("_d"))
    w = Window.partitionBy(*keys, "cell").orderBy("start_t")
    steps = edges.withColumn("covers", F.sum("_d").over(w)).withColumn("end_t", F.lead("start_t").over(w) - 1).where("covers > 0").drop("_d")
    left = df.withColumn("_t", time_us).withColumn("cell", F.floor(F.col("_t") / F.lit(cell)).cast("long"))
    hit = left.join(steps, "cell").where((F.col("_t") >= F.col("start_t")) & (F.col("_t") <= F.col("end_t")))
    return hit.drop("cell", "_t", "start_t", "end_t")


def nearest_in_catalogue(
    df: DataFrame, value: str, catalogue: DataFrame, cat_value: str, payload: list[str], tolerance: float, rank: Column | None = None
) -> DataFrame:
    """Left join each row to the catalogue entry nearest to ``value``.

    Only entries closer than ``tolerance`` count; ties go to the smallest
    ``payload``. Distances are to the exact catalogue values; equal values count
    once. A bin lists the entries of three tolerances, so the catalogue's density
    bounds it. No row of the large side is multiplied or shuffled a second time.
    """
    entry = F.struct(F.col(cat_value).alias("at"), F.struct(*payload).alias("row"))
    distinct = catalogue.where(F.col(cat_value).isNotNull()).groupBy(cat_value).agg(
        *[F.min_by(p, F.struct(*payload)).alias(p) for p in payload]
    )
    bins = (
        distinct.withColumn("_bin", F.floor(F.col(cat_value) / F.lit(tolerance)).cast("long"))
        .withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
        .groupBy("_bin")
        .agg(F.collect_list(entry).alias("_near"))
    )
    close = F.filter("_near", lambda e: F.abs(e["at"] - F.col(value)) < tolerance)
    best = F.array_min(
        F.transform(close, lambda e: F.struct((rank if rank is not None else F.abs(e["at"] - F.col(value))).alias("d"), e["row"].alias("row"), e["at"].alias("at")))
    )
    return (
        df.withColumn("_bin", F.floor(F.col(value) / F.lit(tolerance)).cast("long"))
        .join(bins, "_bin", "left")
        .withColumn("_best", best)
        .select(*df.columns, *[F.col(f"_best.row.{p}").alias(p) for p in payload], F.col("_best.at").alias(cat_value))
    )


def first_in_catalogue(
    df: DataFrame, value: str, catalogue: DataFrame, cat_value: str, payload: list[str], tolerance: float
) -> DataFrame:
    """As above, but the first entry in ``payload`` order within tolerance wins."""
    return nearest_in_catalogue(df, value, catalogue, cat_value, payload, tolerance, rank=F.lit(0.0))


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str], width: int, tie: str = "id"
) -> DataFrame:
    """Left join each row to the latest right row of its key at or before it.

    Both sides are merged in time order inside slices; a slice inherits the last
    right row of the slices before it. Keys must not be NULL. Adds ``match``.
    """
    fields = F.struct(F.col(time).alias("at"), *[F.col(p) for p in payload])
    columns = left.columns
    both = right.select(
        *keys, F.col(time).alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        fields.alias("_r"),
    ).unionByName(
        left.select(
            *keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct(*columns).alias("_l"),
        ),
        allowMissingColumns=True,
    )
    cut = both.withColumn("_slice", slice_no("_at", width))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_tie")
    here = F.last("_r", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tails = cut.groupBy(*keys, "_slice").agg(
        F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_at", "_tie"))).alias("_tail")
    )
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_slice", F.last("_tail", True).over(upto).alias("_carry"))
    return (
        cut.withColumn("_here", here)
        .where(F.col("_side") == 1)
        .join(carry, [*keys, "_slice"], "left")
        .select("_l.*", F.coalesce("_here", "_carry").alias("match"))
    )
