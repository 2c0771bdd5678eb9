"""EventQuery: filters, time range, order, paging and aggregation over the event log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions.scalars import fixed
from wavetrail.operators.filters import Filter, all_of, apply_optional, resolve_field

SECOND_NS = 1_000_000_000


def time_range(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Closed range on event time.

    A log partitioned by ``event_date`` gets the date predicate as well, which
    prunes folders before any file is opened.
    """
    if "event_date" in df.columns:
        day = lambda ns: F.to_date(F.timestamp_seconds(F.lit(ns // SECOND_NS)))
        df = df.where(F.col("event_date").between(day(start_ns), day(end_ns)))
    return df.where(F.col("timestamp_ns").between(start_ns, end_ns))


def time_bucket(seconds: int, ns: str = "timestamp_ns") -> Column:
    """Start of the bucket in whole epoch seconds, kept in integers."""
    return F.expr(f"({ns} div {seconds * SECOND_NS}L) * {seconds}L")


@dataclass(frozen=True)
class Aggregation:
    """One measure, grouped by fields and optionally by time bucket."""

    function: str = "count"
    agg_field: str | None = None
    group_by: tuple[str, ...] = ()
    time_bucket_sec: int | None = None
    having: Column | None = None

    def measure(self) -> Column:
        if self.function == "count":
            return F.count(F.lit(1))
        column, is_attribute = resolve_field(self.agg_field)
        if is_attribute and self.function in ("sum", "avg", "min", "max"):
            column = column.cast("double")
        return {
            "count_distinct": F.count_distinct,
            "sum": F.sum,
            "avg": F.avg,
            "min": F.min,
            "max": F.max,
        }[self.function](column)


@dataclass(frozen=True)
class EventQuery:
    filters: tuple[Filter, ...] = ()
    range_ns: tuple[int, int] | None = None
    newest_first: bool = True
    limit: int | None = None
    offset: int = 0
    aggregation: Aggregation | None = None

    def matches(self, log: DataFrame) -> DataFrame:
        if self.range_ns:
            log = time_range(log, *self.range_ns)
        return log.where(all_of(self.filters)) if self.filters else log

    def rows(self, log: DataFrame) -> DataFrame:
        """All rows or one page, ordered by time with the id as tie-break."""
        order = [F.desc("timestamp_ns"), F.desc("id")] if self.newest_first else [F.asc("timestamp_ns"), F.asc("id")]
        page = self.matches(log).orderBy(*order)
        if self.offset:
            page = page.offset(self.offset)
        return page if self.limit is None else page.limit(self.limit)

    def count(self, log: DataFrame) -> DataFrame:
        return self.matches(log).agg(F.count(F.lit(1)).alias("total"))

    def aggregate(self, log: DataFrame) -> DataFrame:
        a = self.aggregation or Aggregation()
        keys = [resolve_field(g)[0].alias(g) for g in a.group_by]
        hits = self.matches(log)
        if a.time_bucket_sec:
            hits = hits.withColumn("time_bucket", time_bucket(a.time_bucket_sec))
            keys = [F.col("time_bucket"), *keys]
        out = hits.groupBy(*keys).agg(a.measure().alias("agg_value"))
        return out.where(a.having) if a.having is not None else out


def grouped_measures(log: DataFrame, asked: list[Aggregation], keys: list[str]) -> DataFrame:
    """(fn, keys, agg_value) of several measures over the same groups, in one pass; values are doubles."""
    names = [f"_m{i}" for i in range(len(asked))]
    out = log.groupBy(*[resolve_field(k)[0].alias(k) for k in keys]).agg(*[a.measure().cast("double").alias(n) for a, n in zip(asked, names)])
    pairs = F.array(*[F.struct(F.lit(a.function).alias("fn"), F.col(n).alias("agg_value")) for a, n in zip(asked, names)])
    return out.select(*keys, F.inline(pairs))


def facets(log: DataFrame, field: str, limit: int) -> DataFrame:
    """Most frequent values of one field; floats read as four decimals."""
    column, _ = resolve_field(field)
    text = fixed(column, 4) if dict(log.dtypes).get(field) == "double" else column.cast("string")
    counts = log.where(column.isNotNull()).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "value").limit(limit)


def multi_facets(log: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """Top values of several fields in a single pass over the log."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    )
    counts = (
        log.select(pairs.alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.field", "p.value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    best = Window.partitionBy("field").orderBy(F.desc("cnt"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def newest(df: DataFrame, time_column: str, n: int, tie: str = "id", **given) -> DataFrame:
    """The newest ``n`` rows among those matching the given values."""
    return apply_optional(df, **given).orderBy(F.desc(time_column), F.desc(tie)).limit(n)
