"""Greedy spacing: keep a row only if it lies far enough from the last KEPT row.

Cooldowns and tolerance de-duplication share this rule. It is a recursion, so no
window function states it. A slice of the ordered values turns into a small step
function (value the slice is entered at -> last value it keeps). The functions
are chained in blocks, the blocks along the key, and then every slice picks its
values on its own; no task sees more than one block of functions or one slice.
Slices are cut by number of rows, not by time, and travel as one sorted array each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.sources.work import stored

SLICE_ROWS = 65_536  # distinct values that one slice holds
BLOCK = 32  # slices chained in one task


def _first_after(values: np.ndarray, last: np.ndarray, distance, strict: bool) -> np.ndarray:
    """Index of the first of ``values`` that may follow each of ``last``."""
    return np.searchsorted(values, last + distance, side="right" if strict else "left")


def _known(value):
    """None for a missing value, which Arrow may hand over as NaN."""
    return None if value is None or value != value else value


def _runs(upto: np.ndarray, exits: np.ndarray) -> list[dict]:
    """One step per run of entries that lead to the same last kept value."""
    change = np.r_[exits[1:] != exits[:-1], True]
    return [{"upto": u, "exit": e} for u, e in zip(upto[change].tolist(), exits[change].tolist())]


def _slice_steps(values: np.ndarray, start, distance, strict: bool) -> list[dict]:
    """Last kept value of a slice for every value it can be entered at."""
    n = len(values)
    nxt = _first_after(values, values, distance, strict)
    end = np.where(nxt < n, nxt, np.arange(n))
    while not np.array_equal(end[end], end):  # follow the hops, doubling each time
        end = end[end]
    # A value kept earlier blocks at most `distance` from the start of the slice,
    # so no entry lies beyond the first value after that.
    reach = int(np.searchsorted(values, start + distance, side="right")) + 1
    return _runs(values[:reach], values[end][:reach])


def _table(step, np_type: str) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray([s["upto"] for s in step], dtype=np_type), np.asarray([s["exit"] for s in step], dtype=np_type)


def _follow(last: np.ndarray, tables, distance, strict: bool) -> np.ndarray:
    """Last kept values after further slices, entered after each of ``last``."""
    for upto, exits in tables:
        i = _first_after(upto, last, distance, strict)
        go = i < len(upto)
        last = np.where(go, exits[np.minimum(i, len(upto) - 1)], last)
    return last


def _block_steps(tables, start, distance, strict: bool) -> list[dict]:
    """The step function of several slices in a row."""
    upto, exits = [], []
    for j, (u, e) in enumerate(tables):
        upto.append(u)
        exits.append(_follow(e, tables[j + 1:], distance, strict))
        if u[-1] >= start + distance:
            break
    return _runs(np.concatenate(upto), np.concatenate(exits))


def _carries(tables, last, distance, strict: bool, np_type: str) -> list:
    """Last kept value before each table, from ``last`` before the first."""
    before, last = [], _known(last)
    for upto, exits in tables:
        before.append(last)
        i = 0 if last is None else int(_first_after(upto, np.asarray(last, dtype=np_type), distance, strict))
        if i < len(upto):
            last = exits[i].item()
    return before


def _cut(key: str, value: str, kind: pa.DataType):
    """Sorted rows to slices of at most ``SLICE_ROWS`` distinct values of one key."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, pending, size, last = None, None, [], 0, None

        def row() -> pa.RecordBatch:
            values = np.concatenate(pending)
            columns = [pa.array([current], schema.field(0).type), pa.array([values[0]], kind), pa.array([values], pa.list_(kind))]
            return pa.RecordBatch.from_arrays(columns, [key, "_first", "_values"])

        for batch in batches:
            schema = batch.schema
            keys, values = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            ends = np.r_[np.flatnonzero(np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))) + 1, len(keys)]
            low = 0
            for high in ends.tolist():
                own = keys[low].as_py()
                if pending and (own != current):
                    yield row()
                    pending, size = [], 0
                if own != current:
                    current, last = own, None
                piece = values[low:high]
                piece = piece[np.r_[last is None or piece[0] != last, piece[1:] != piece[:-1]]]
                low = high
                while len(piece):
                    part, piece = piece[: SLICE_ROWS - size], piece[SLICE_ROWS - size :]
                    pending.append(part)
                    size, last = size + len(part), part[-1]
                    if size == SLICE_ROWS:
                        yield row()
                        pending, size = [], 0
        if pending:
            yield row()

    return slices


def spaced_rows(df: DataFrame, key: str, value: str, distance: float, strict: bool = False) -> DataFrame:
    """Distinct ``(key, value)`` pairs kept by the greedy rule.

    A value is kept when it is at least ``distance`` (more than it, if
    ``strict``) above the last kept value of its key. ``value`` is an integer
    or double column; ``key`` must not be NULL. The rows are exchanged once, by
    ranges of equal size, so a key with any share of the rows, at any density in
    time, is cut into slices of at most ``SLICE_ROWS`` values.
    """
    dtype, key_type = dict(df.dtypes)[value], dict(df.dtypes)[key]
    # whole numbers stay whole: nanoseconds do not fit a double
    np_type, distance = ("float64", float(distance)) if dtype == "double" else ("int64", int(distance))
    kind = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[dtype]
    ranged = df.select(key, value).where(F.col(value).isNotNull()).repartitionByRange(key, value).sortWithinPartitions(key, value)
    slices = stored(ranged.mapInArrow(_cut(key, value, kind), f"`{key}` {key_type}, _first {dtype}, _values array<{dtype}>"), "slices")

    step_type = f"array<struct<upto: {dtype}, exit: {dtype}>>"

    @F.pandas_udf(step_type)
    def slice_steps(values: pd.Series, firsts: pd.Series) -> pd.Series:
        return pd.Series([_slice_steps(np.asarray(v, dtype=np_type), first, distance, strict) for v, first in zip(values, firsts)])

    @F.pandas_udf(step_type)
    def block_steps(tables: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([
            _block_steps([_table(x["s"], np_type) for x in t], start, distance, strict) for t, start in zip(tables, starts)
        ])

    @F.pandas_udf(f"array<{dtype}>")
    def carries(tables: pd.Series, entered: pd.Series) -> pd.Series:
        return pd.Series([
            _carries([_table(x["s"], np_type) for x in t], before[0], distance, strict, np_type) for t, before in zip(tables, entered)
        ])

    @F.pandas_udf(f"array<{dtype}>")
    def picked(values: pd.Series, entered: pd.Series) -> pd.Series:
        out = []
        for v, before in zip(values, entered):
            v = np.asarray(v, dtype=np_type)
            nxt = _first_after(v, v, distance, strict)
            last = _known(before[0])
            i = 0 if last is None else int(_first_after(v, np.asarray(last, dtype=np_type), distance, strict))
            kept = []
            while i < len(v):
                kept.append(v[i])
                i = nxt[i]
            out.append(np.asarray(kept, dtype=np_type))
        return pd.Series(out)

    def spread(df: DataFrame, id_column: str) -> DataFrame:
        """Carry values beside the ids of the tables they belong to."""
        pairs = F.arrays_zip(F.transform("_t", lambda t: t["c"]).alias("c"), F.col("_b").alias("b"))
        return df.select(key, F.explode(pairs).alias("z")).select(key, F.col("z.c").alias(id_column), F.array("z.b").alias("_before"))

    # Slices chain inside blocks, blocks chain along the key, and the carries go back down.
    listed = lambda c, s: F.array_sort(F.collect_list(F.struct(F.col(c).alias("c"), F.col(s).alias("s")))).alias("_t")
    along = F.row_number().over(Window.partitionBy(key).orderBy("_first"))  # one row a slice
    steps = slices.withColumn("_s", slice_steps("_values", "_first")).select(key, "_first", "_s").withColumn("_block", F.floor((along - 1) / BLOCK))
    blocks = steps.groupBy(key, "_block").agg(listed("_first", "_s"), F.min("_first").alias("_start"))
    chains = blocks.withColumn("_bs", block_steps("_t", "_start")).groupBy(key).agg(listed("_block", "_bs"))
    nothing = F.array(F.lit(None).cast(dtype))
    into_blocks = spread(chains.withColumn("_b", carries("_t", nothing)), "_block")
    into_slices = spread(blocks.join(into_blocks, [key, "_block"]).withColumn("_b", carries("_t", "_before")), "_first")
    return slices.join(into_slices, [key, "_first"]).select(key, F.explode(picked("_values", "_before")).alias(value))
