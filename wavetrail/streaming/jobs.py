"""Structured Streaming forms: the same Columns and stages as the batch jobs.

Event time with watermarks takes the place of polling by the wall clock, and
checkpoints take the place of buffers that drop what they cannot hold. ``late``
says how much older than the newest event a row may be: later ones are dropped
by windows, joins and timed state, so every caller must state it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavetrail import schemas
from wavetrail.operators.filters import all_of, resolve_field
from wavetrail.operators.history import GRANT, TERMINATORS
from wavetrail.operators.ordered import NS
from wavetrail.operators.rules import COMPARE, Rule, chain_events, every_events, load_rules
from wavetrail.sources.bindings import bind_event_log
from wavetrail.sources.sinks import with_event_date


#: Input that one micro-batch takes at most.
BATCH_BYTES = 64 << 30


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, schema=schemas.RAW_EVENTS) -> DataFrame:
    """A folder of files as a stream; micro-batches are limited by bytes, or by files where that is wanted."""
    limit = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    return spark.readStream.schema(schema).option(*limit).parquet(path)


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return bind_event_log(read_stream(spark, path, files_per_batch))


def run_to_end(writer, checkpoint: str) -> None:
    """Process all that is there, however long it takes; a failure is raised, and the checkpoint lets a rerun go on."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def append_log(log: DataFrame, path: str):
    """Every event reaches the log once, in folders by day."""
    return with_event_date(log).writeStream.format("parquet").partitionBy("event_date").option("path", path)


def append_batches(stream: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]):
    """Derived rows of each micro-batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


DETECTION_KEY = ["mission_id", "sensor", "t_s", "center_hz"]


def merge_once(stream: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], key: list[str] = DETECTION_KEY, bucket_s: int = 3600, first_batch: int = 0):
    """Rows of each micro-batch whose key is not stored yet, whenever it came before.

    Rows lie in folders by batch and by bucket of ``t_s``. A batch is compared with the buckets it touches and with older batches only, so
    the cost does not follow the age of the table, and a repeated batch finds what it found before and overwrites itself. A further stream
    into the same table numbers its batches from ``first_batch``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, batch_id = batch.sparkSession, first_batch + number
        fresh = make(batch).dropDuplicates(key).withColumn("bucket", F.expr(f"t_s div {bucket_s}L"))
        staged = f"{path}/_staged/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(fresh.schema).parquet(staged)
        if batch_id:
            schema = T.StructType([*fresh.schema.fields, T.StructField("batch", T.LongType())])
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # the hours of one batch
            known = spark.read.schema(schema).parquet(path).where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
            fresh = fresh.join(known.select("bucket", *key), ["bucket", *key], "left_anti").select(*fresh.columns)
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


def fan_out(stream: DataFrame, telemetry: str, detections: str, is_detection) -> list:
    """All rows to telemetry, detections to their own sink; neither loses rows."""
    return [
        stream.writeStream.format("parquet").option("path", telemetry),
        stream.where(is_detection).writeStream.format("parquet").option("path", detections),
    ]


def threshold_stream(log: DataFrame, rule: Rule, step_s: int, late: str) -> DataFrame:
    """Windows of a threshold rule, each emitted once when it can no longer change."""
    w = F.window("ts", f"{rule.window_sec} seconds", f"{step_s} seconds")
    counts = log.withWatermark("ts", late).where(all_of(rule.filters)).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("match_count"))
    hit = COMPARE[rule.op](F.col("match_count").cast("double"), F.lit(float(rule.value)))
    return counts.where(hit).select(F.lit(rule.id).alias("rule_id"), F.col("w.end").alias("at"), "match_count")


def cardinality_stream(log: DataFrame, rule: Rule, step_s: int, late: str) -> DataFrame:
    """Windows of a cardinality rule by an approximate distinct count.

    A stream cannot count distinct values exactly in bounded state.
    """
    w = F.window("ts", f"{rule.window_sec} seconds", f"{step_s} seconds")
    value = resolve_field(rule.field)[0]
    keys = [w.alias("w"), *[resolve_field(g)[0].alias(g) for g in rule.group_by]]
    counts = log.withWatermark("ts", late).where(all_of(rule.filters)).groupBy(*keys).agg(F.approx_count_distinct(value, 0.01).alias("match_count"))
    hit = COMPARE[rule.op](F.col("match_count").cast("double"), F.lit(float(rule.value)))
    return counts.where(hit).select(F.lit(rule.id).alias("rule_id"), F.col("w.end").alias("at"), *rule.group_by, "match_count")


def absence_stream(log: DataFrame, rule: Rule, late: str) -> DataFrame:
    """A row for each silence of a rule's events longer than its window.

    A silence shows when event time passes the last match by the window, either
    by the timer or by the next match. ``until_ns`` is NULL while it lasts.
    """
    window_ns = rule.window_sec * NS

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((int(key[0]), last, None))
            state.update((last, True))
        else:
            for ns in sorted(int(n) for b in batches for n in b["timestamp_ns"]):
                if last is not None and ns - last > window_ns:
                    out.append((int(key[0]), last, ns))
                last, told = (ns if last is None else max(last, ns)), False
            state.update((last, told))
            state.setTimeoutTimestamp(max((last + window_ns) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["rule_id", "since_ns", "until_ns"])
        yield frame.astype({"rule_id": "int32", "since_ns": "int64", "until_ns": "Int64"})

    hits = log.withWatermark("ts", late).where(all_of(rule.filters)).select("ts", "timestamp_ns", F.lit(rule.id).alias("rule_id"))
    return hits.groupBy("rule_id").applyInPandasWithState(
        watch, "rule_id int, since_ns long, until_ns long", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def new_value_stream(log: DataFrame, rule: Rule) -> DataFrame:
    """Sightings of values not seen within the look-back before them.

    State per value is its LAST sighting, so a value that keeps coming stays known.
    A row older than the last sighting is known by it. State is dropped when event
    time has passed the last sighting by the look-back.
    """
    value = resolve_field(rule.field)[0].cast("string")
    look_back = rule.baseline_sec * NS

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        new = []
        rows = pd.concat(list(batches)).sort_values(["timestamp_ns", "id"])
        for i, ns in zip(rows["id"], rows["timestamp_ns"]):
            if last is None or ns - last > look_back:
                new.append((int(key[0]), int(i), int(ns), key[1]))
            last = int(ns) if last is None else max(last, int(ns))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + look_back) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(new, columns=["rule_id", "id", "timestamp_ns", "value"]).astype({"rule_id": "int32", "id": "int64", "timestamp_ns": "int64"})

    hits = log.withWatermark("ts", f"{rule.baseline_sec} seconds").where(all_of(rule.filters))
    hits = hits.select(F.lit(rule.id).alias("rule_id"), "id", "ts", "timestamp_ns", value.alias("value")).where(F.col("value").isNotNull())
    return hits.groupBy("rule_id", "value").applyInPandasWithState(
        watch, "rule_id int, id long, timestamp_ns long, value string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def correlation_stream(primary: DataFrame, secondary: DataFrame, rule: Rule, late: str) -> DataFrame:
    """Pairs of events of two streams with the same value at most a window apart."""
    value = resolve_field(rule.field)[0].cast("string")
    side = lambda df, f, p: df.where(all_of(f)).select(
        F.col("id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), value.alias(f"{p}_value")
    ).withWatermark(f"{p}_ts", late)
    a, b = side(primary, rule.filters, "a"), side(secondary, rule.second, "b")
    span = F.expr(f"b_ts BETWEEN a_ts - INTERVAL {rule.window_sec} SECONDS AND a_ts + INTERVAL {rule.window_sec} SECONDS")
    return a.join(b, (F.col("a_value") == F.col("b_value")) & span).select(
        F.lit(rule.id).alias("rule_id"), F.col("a_value").alias("value"), "a_id", "b_id"
    )


def every_stream(log: DataFrame, rules_table: Callable[[], DataFrame], path: str):
    """1:1 rules, read anew for each micro-batch so that edits take effect."""
    return append_batches(log, path, lambda batch: every_events(batch, load_rules(rules_table())))


def chain_stream(log: DataFrame, rules_table: Callable[[], DataFrame], path: str):
    """Derived events and what is derived from them, in the micro-batch of their root."""
    return append_batches(log, path, lambda batch: chain_events(batch, load_rules(rules_table())))


TRACED = "id long, timestamp_ns long, event_type string, trace_id long, span_id long"


def trace_stream(log: DataFrame, gap_ns: int, late: str) -> DataFrame:
    """Trace and span of protocol events as they arrive (see ``assign_traces``).

    State per (talkgroup, frequency): the open trace, the last event and the span
    number. Event time past the gap drops the state.
    """

    def assign(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        trace, last, span = state.get if state.exists else (-1, -1, 0)
        pdf = pd.concat(list(batches)).sort_values(["timestamp_ns", "id"])
        traces, spans = [], []
        for ns, i, kind, duid in zip(pdf["timestamp_ns"], pdf["id"], pdf["event_type"], pdf["duid"]):
            if kind == GRANT:
                trace, span = int(i), 0
            elif trace >= 0 and ns - last > gap_ns:
                trace = -1
            span += 1
            traces.append(trace if trace >= 0 else None)
            spans.append(span if trace >= 0 else None)
            if kind == "protocol.p25.voice" and duid in TERMINATORS:
                trace = -1
            last = int(ns)
        state.update((trace, last, span))
        # A timeout must lie past the watermark; late keys keep their state until the next event.
        horizon = (last + gap_ns) // 1_000_000 + 1
        if horizon > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(horizon)
        out = pdf[["id", "timestamp_ns", "event_type"]].copy()
        out["trace_id"] = pd.array(traces, dtype="Int64")
        out["span_id"] = pd.array(spans, dtype="Int64")
        yield out

    keyed = log.withWatermark("ts", late).select(
        "ts", "id", "timestamp_ns", "event_type", "duid",
        F.coalesce("talkgroup", F.lit(-1)).alias("tg"), F.coalesce((F.col("freq_mhz") * 1000).cast("long"), F.lit(-1)).alias("khz"),
    )
    return keyed.groupBy("tg", "khz").applyInPandasWithState(
        assign, TRACED, "trace long, last long, span long", "append", GroupStateTimeout.EventTimeTimeout
    )


def cooldown_stream(hits: DataFrame, rest_s: int, late: str) -> DataFrame:
    """Firings of each rule that lie at least ``rest_s`` after its last firing.

    ``hits`` needs ``ts``, ``rule_id`` and ``timestamp_ns``.
    """

    def fire(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for ns in sorted(n for b in batches for n in b["timestamp_ns"]):
            if last is None or ns - last >= rest_s * NS:
                kept.append(int(ns))
                last = int(ns)
        state.update((last,))
        yield pd.DataFrame({"rule_id": [int(key[0])] * len(kept), "timestamp_ns": kept})

    return hits.withWatermark("ts", late).groupBy("rule_id").applyInPandasWithState(
        fire, "rule_id int, timestamp_ns long", "last long", "append", GroupStateTimeout.NoTimeout
    )
