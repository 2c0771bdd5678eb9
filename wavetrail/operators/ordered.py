"""Ordered analytics that stay spread out when one key dominates.

A plain window over a key sorts all rows of that key in one task. Here a key is
first cut into time slices, each slice is scanned on its own, and only one
summary row per (key, slice) is carried from slice to slice. The summaries of a
key number at most (time span / slice), whatever the row count.

Key columns must not be NULL; callers drop or replace NULL keys first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000
HOUR_NS = 3600 * NS


def slice_no(time: str, width: int) -> Column:
    return F.floor(F.col(time) / F.lit(width)).cast("long")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], width: int = HOUR_NS, out: str = "prev"
) -> DataFrame:
    """Add ``out``: a struct of ``values`` of the preceding row of the key.

    ``order[0]`` must be an integer time column; it also places the slices.
    """
    cut = df.withColumn("_slice", slice_no(order[0], width))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(inside)).withColumn(
        "_local", F.lag(F.struct(*values)).over(inside)
    )
    tails = cut.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carry = tails.select(*keys, "_slice", F.lag("_tail").over(across).alias("_carry"))
    return (
        local.join(carry, [*keys, "_slice"], "left")
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_local")))
        .drop("_slice", "_rn", "_local", "_carry")
    )


def with_position(df: DataFrame, keys: list[str], order: list[str], width: int = HOUR_NS, out: str = "pos") -> DataFrame:
    """Add the 1-based position of each row within its key."""
    cut = df.withColumn("_slice", slice_no(order[0], width))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"], "left")
        .withColumn(out, F.col("_rn") + F.col("_before"))
        .drop("_slice", "_rn", "_before")
    )


def with_runs(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, head: list[str], width: int = HOUR_NS
) -> DataFrame:
    """Number the rows of runs; a run begins at each row where ``starts`` holds.

    Adds ``run`` (struct of ``head`` columns of the opening row, NULL before the
    first opening) and ``run_pos`` (1-based position inside the run).
    """
    cut = df.withColumn("_slice", slice_no(order[0], width)).withColumn("_start", F.coalesce(starts, F.lit(False)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(inside)).withColumn(
        "_open",
        F.last(F.when(F.col("_start"), F.struct(F.col("_rn").alias("at"), F.struct(*head).alias("head"))), True).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    summary = local.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_open", "_rn").alias("_last")
    )
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    opened = F.when(
        F.col("_last").isNotNull(),
        F.struct((F.col("_last.at") + F.col("_before")).alias("at"), F.col("_last.head").alias("head")),
    )
    carry = placed.withColumn("_opened", opened).select(
        *keys, "_slice", "_before", F.last("_opened", True).over(upto).alias("_carry")
    )
    here = F.when(
        F.col("_open").isNotNull(),
        F.struct((F.col("_open.at") + F.col("_before")).alias("at"), F.col("_open.head").alias("head")),
    ).otherwise(F.col("_carry"))
    return (
        local.join(carry, [*keys, "_slice"], "left")
        .withColumn("_run", here)
        .withColumn("run", F.col("_run.head"))
        .withColumn("run_pos", F.col("_rn") + F.col("_before") - F.col("_run.at") + 1)
        .drop("_slice", "_start", "_rn", "_open", "_before", "_carry", "_run")
    )


def gap_sessions(
    df: DataFrame,
    keys: list[str],
    time: str,
    gap: int,
    measures: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    tie: str = "id",
    width: int = HOUR_NS,
) -> DataFrame:
    """Sessions of a key split wherever two rows lie more than ``gap`` apart.

    Sessions are built inside slices first; then the pieces, no more than one
    per gap of time, are joined across slices. ``measures`` are aggregates of
    rows, ``merge`` says how each combines when pieces join.
    """
    w = Window.partitionBy(*keys, "_slice").orderBy(time, tie)
    rows = (
        df.withColumn("_slice", slice_no(time, max(width, gap)))
        .withColumn("_new", (F.col(time) - F.lag(time).over(w) > gap).cast("int"))
        .withColumn("_piece", F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(w))
    )
    pieces = rows.groupBy(*keys, "_slice", "_piece").agg(
        F.min(time).alias("start_t"), F.max(time).alias("end_t"), *[c.alias(n) for n, c in measures.items()]
    )
    across = Window.partitionBy(*keys).orderBy("start_t")
    joined = pieces.withColumn(
        "_new", F.coalesce((F.col("start_t") - F.lag("end_t").over(across) > gap).cast("int"), F.lit(1))
    ).withColumn("_session", F.sum("_new").over(across))
    return (
        joined.groupBy(*keys, "_session")
        .agg(
            F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"),
            *[merge[n](n).alias(n) for n in measures],
        )
        .drop("_session")
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, width: int = 24 * 3600) -> DataFrame:
    """Union of overlapping closed intervals per key, ends in epoch seconds.

    Intervals are clipped to slices and merged there, so a busy key spreads
    over its slices; the merged pieces are then joined across slice borders.
    """
    pieces = clip_intervals(df, keys, start, end, width)
    inner = _islands(pieces, [*keys, "cell"], start, end)
    return _islands(inner.drop("cell"), keys, start, end)


def clip_intervals(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Cut closed intervals at multiples of ``width`` seconds into ``cell`` pieces."""
    first = F.floor(F.col(start) / F.lit(width)).cast("long")
    last = F.floor(F.col(end) / F.lit(width)).cast("long")
    return (
        df.select(*keys, start, end)
        .where(F.col(start) <= F.col(end))
        .withColumn("cell", F.explode(F.sequence(first, last)))
        .withColumn(start, F.greatest(F.col(start), F.col("cell") * width))
        .withColumn(end, F.least(F.col(end), (F.col("cell") + 1) * width))
    )


def _islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
