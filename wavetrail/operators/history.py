"""History to state: rotations, first sightings, sessions, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.functions import scalars as S
from wavetrail.operators.ordered import NS, gap_sessions, with_previous, with_runs

GRANT = "protocol.p25.grant"
# Data units that end a transmission.
TERMINATORS = ["TLC", "SimpleTerm"]


def rotation_text(old_alg: Column, old_key: Column, alg: Column, key: Column, tgid: Column) -> Column:
    """What a rotation finding says."""
    show = lambda k: F.coalesce(k.cast("string"), F.lit("?"))
    old, new, tg = S.algorithm_short(old_alg), S.algorithm_short(alg), tgid.cast("string")
    changed = old_alg != alg
    return (
        F.when(
            changed & ~old_key.eqNullSafe(key),
            F.concat(F.lit("Key rotation on TG "), tg, F.lit(": "), old, F.lit(" key="), show(old_key), F.lit(" -> "), new, F.lit(" key="), show(key)),
        )
        .when(changed, F.concat(F.lit("Algorithm change on TG "), tg, F.lit(": "), old, F.lit(" -> "), new))
        .otherwise(F.concat(F.lit("Key rotation on TG "), tg, F.lit(": key "), show(old_key), F.lit(" -> "), show(key)))
    )


def key_rotations(crypto: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Messages whose algorithm or key differs from the talkgroup's previous one."""
    msgs = crypto.withColumn("alg", S.algorithm_id(F.col("algorithm"), F.col("encrypted_flag")))
    seen = with_previous(msgs, ["system", "tgid"], ["timestamp_ns", "id"], ["alg", "key_id"], width)
    alg_changed = F.col("prev.alg") != F.col("alg")
    key_changed = ~F.col("prev.key_id").eqNullSafe(F.col("key_id"))
    text = rotation_text(F.col("prev.alg"), F.col("prev.key_id"), F.col("alg"), F.col("key_id"), F.col("tgid"))
    return seen.where(F.col("prev").isNotNull() & (alg_changed | key_changed)).select(
        "id", "system", "tgid", "uid", "freq_mhz", "timestamp_ns",
        F.coalesce(F.col("prev.key_id"), F.lit(-1)).alias("old_key_id"),
        F.col("key_id").alias("new_key_id"),
        F.col("prev.alg").alias("old_algorithm_id"),
        F.col("alg").alias("new_algorithm_id"),
        F.when(alg_changed, "warning").otherwise("notice").alias("severity"),
        text.alias("summary"),
    )


def first_sightings(grants: DataFrame) -> DataFrame:
    """The first message of every (system, uid); uid 0 and NULL do not count."""
    order = F.struct("timestamp_ns", "id")
    return (
        grants.where(F.col("uid") > 0)
        .groupBy("system", "uid")
        .agg(F.min(order).alias("_first"), F.min_by("tgid", order).alias("tgid"))
        .select("system", "uid", "tgid", F.col("_first.id").alias("id"), F.col("_first.timestamp_ns").alias("timestamp_ns"))
    )


def traffic_sessions(hits: DataFrame, gap_ns: int, as_of_ns: int, min_hits: int = 2) -> DataFrame:
    """Activity per frequency (three decimals); single hits are noise.

    ``closed_ns`` is the time of the hit that ended the session, or ``as_of_ns``.
    """
    order = F.struct("timestamp_ns", "id")
    first = F.min_by(F.struct("freq_mhz", "channel_id", "encrypted", "modulation"), order)
    sessions = gap_sessions(
        hits.withColumn("freq_key", S.fixed(F.col("freq_mhz"), 3)),
        ["freq_key"], "timestamp_ns", gap_ns,
        {"hit_count": F.count(F.lit(1)), "power_sum": F.sum("power"), "first": first},
        {"hit_count": F.sum, "power_sum": F.sum, "first": lambda c: F.min_by(c, "start_t")},
    )
    nxt = F.lead("start_t").over(Window.partitionBy("freq_key").orderBy("start_t"))
    return (
        sessions.withColumn("closed_ns", F.coalesce(nxt, F.lit(as_of_ns)))
        .where(F.col("hit_count") >= min_hits)
        .select(
            "freq_key", "first.freq_mhz", "first.channel_id", "first.encrypted", "first.modulation",
            F.col("start_t").alias("start_ns"), F.col("end_t").alias("last_ns"), "closed_ns",
            ((F.col("end_t") - F.col("start_t")) / F.lit(1e9)).alias("duration_sec"),
            "hit_count", (F.col("power_sum") / F.col("hit_count")).alias("avg_signal"),
        )
    )


def assign_traces(log: DataFrame, gap_ns: int, width: int = 3600 * NS) -> DataFrame:
    """Give protocol events the trace they belong to and their number in it.

    A grant opens a trace on its (talkgroup, frequency in whole kHz); it ends at
    the next grant, after a terminator, or after ``gap_ns`` of silence. Events
    outside any trace keep NULL in ``trace_id`` and ``span_id``.
    """
    is_grant = F.col("event_type") == GRANT
    ends = (F.col("event_type") == "protocol.p25.voice") & F.col("duid").isin(TERMINATORS)
    keyed = (
        log.where(F.col("talkgroup").isNotNull() | F.col("freq_mhz").isNotNull())
        .withColumn("_tg", F.coalesce("talkgroup", F.lit(-1)))
        .withColumn("_khz", F.coalesce((F.col("freq_mhz") * 1000).cast("long"), F.lit(-1)))
        .withColumn("_grant", is_grant)
        .withColumn("_ends", F.coalesce(ends, F.lit(False)))
    )
    keys, order = ["_tg", "_khz"], ["timestamp_ns", "id"]
    seen = with_previous(keyed, keys, order, ["timestamp_ns", "_ends"], width, out="_prev")
    starts = (
        F.col("_grant")
        | F.col("_prev._ends")
        | (F.col("timestamp_ns") - F.col("_prev.timestamp_ns") > gap_ns)
    )
    runs = with_runs(seen, keys, order, starts, ["id", "_grant"], width)
    in_trace = F.coalesce(F.col("run._grant"), F.lit(False))
    return (
        runs.withColumn("trace_id", F.when(in_trace, F.col("run.id")))
        .withColumn("span_id", F.when(in_trace, F.col("run_pos")))
        .drop("_tg", "_khz", "_grant", "_ends", "_prev", "run", "run_pos")
    )


def trace_sessions(traced: DataFrame) -> DataFrame:
    """One row per trace with its span of time and what it carried."""
    order = F.struct("timestamp_ns", "id")
    rows = traced.where(F.col("trace_id").isNotNull())
    return rows.groupBy("trace_id").agg(
        F.min("timestamp_ns").alias("start_ns"),
        F.max("timestamp_ns").alias("last_event_ns"),
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("talkgroup", order).alias("talkgroup"),
        F.min_by("freq_mhz", order).alias("freq_mhz"),
        F.min_by("source_unit", F.when(F.col("source_unit").isNotNull(), order)).alias("source_unit"),
        F.max(F.coalesce("encrypted", F.lit(False))).alias("encrypted"),
    ).withColumn("duration_sec", (F.col("last_event_ns") - F.col("start_ns")) / F.lit(1e9))


def session_events(sessions: DataFrame) -> DataFrame:
    """The summary event written when a trace closes."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    body = F.concat(
        F.lit("Session "), F.col("trace_id"), F.lit(" — TG:"), show("talkgroup"), F.lit(" UID:"), show("source_unit"),
        F.lit(" "), S.fixed(F.coalesce("freq_mhz", F.lit(0.0)), 4), F.lit("MHz "), F.col("event_count"), F.lit("events "),
        S.fixed(F.col("duration_sec"), 1), F.lit("s"), F.when(F.col("encrypted"), " ENC").otherwise(""),
    )
    return sessions.select(
        F.lit("sigex.traffic.session").alias("event_type"), F.lit(9).alias("severity"), "trace_id", "talkgroup",
        "source_unit", "freq_mhz", "encrypted", F.col("last_event_ns").alias("timestamp_ns"), body.alias("body"),
    )


def transitions(
    states: DataFrame, keys: list[str], state: str, order: list[str], leave: str, enter: str, width: int = 3600 * NS
) -> DataFrame:
    """Leave and enter events wherever a state column changes value."""
    seen = with_previous(states, keys, order, [state], width)
    old, new = F.col(f"prev.{state}"), F.col(state)
    changed = ~old.eqNullSafe(new) & (F.col("prev").isNotNull() | new.isNotNull())
    both = F.array(
        F.when(old.isNotNull(), F.struct(F.lit(leave).alias("event_type"), old.alias("state"))),
        F.when(new.isNotNull(), F.struct(F.lit(enter).alias("event_type"), new.alias("state"))),
    )
    return (
        seen.where(changed)
        .withColumn("_e", F.explode(F.filter(both, lambda e: e.isNotNull())))
        .select(*keys, *order, "_e.event_type", "_e.state")
    )


def reappearances(df: DataFrame, key: str, min_gap_ns: int, width: int = 24 * 3600 * NS) -> DataFrame:
    """Rows of a key seen again after at least ``min_gap_ns``."""
    seen = with_previous(df, [key], ["timestamp_ns", "id"], ["timestamp_ns"], width)
    gap = F.col("timestamp_ns") - F.col("prev.timestamp_ns")
    return seen.where(gap >= min_gap_ns).select(key, "id", "timestamp_ns", (gap / F.lit(1e9)).alias("absent_sec"))


def event_rate(df: DataFrame, seconds: int, keys: list[Column] = []) -> DataFrame:
    """Events per elapsed interval, as a rate per second."""
    step = seconds * NS
    return (
        df.groupBy(F.expr(f"(timestamp_ns div {step}L) * {seconds}L").alias("second"), *keys)
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("rate", F.col("events") / seconds)
    )
