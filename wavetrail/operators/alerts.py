"""Broadcast alert headers as a table job: fields, vote over repeats, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.functions.scalars import lookup


def minutes(hhmm: Column) -> Column:
    """HHMM to minutes; anything but four characters is 0."""
    part = lambda a: F.coalesce(F.substring(hhmm, a, 2).try_cast("int"), F.lit(0))
    return F.when(F.length(hhmm) == 4, part(1) * 60 + part(3)).otherwise(0)


def issue_time(field: Column) -> Column:
    """JJJHHMM as day, hour and minute; other lengths are passed on."""
    num = lambda a, n: F.lpad(F.coalesce(F.substring(field, a, n).try_cast("int"), F.lit(0)).cast("string"), n, "0")
    return F.when(
        F.length(field) == 7, F.concat(F.lit("J"), num(1, 3), F.lit(" "), num(4, 2), F.lit(":"), num(6, 2), F.lit("Z"))
    ).otherwise(field)


def decode_headers(rows: DataFrame, header: str = "header") -> DataFrame:
    """Fields of each valid header; invalid ones give no row."""
    clean = F.regexp_replace(F.trim(F.col(header)), "-+$", "")
    body = F.split(F.regexp_replace(F.substring(clean, 5, 1_000_000), "^-", ""), "-")
    p = F.col("_p")
    plus = F.array_position(F.transform(p, lambda x, i: (i >= 2) & x.contains("+")), True).cast("int") - 1
    # Generators keep the split and its marks from being worked out anew for every field.
    valid = rows.where(F.trim(F.col(header)).startswith("ZCZC"))
    cut = valid.select("*", F.explode(F.array(body)).alias("_p")).where(F.size("_p") >= 4)
    marked = cut.select("*", F.explode(F.array(F.when(plus >= 0, plus))).alias("_plus"))
    at = F.col("_plus")
    end = F.get(p, at)
    before = F.slice(p, F.lit(3), F.greatest(F.coalesce(at, F.size(p)) - 2, F.lit(0)))
    whole = F.filter(before, lambda x: x.rlike("^[0-9]{6}$"))
    tail = F.filter(F.array(F.substring_index(end, "+", 1)), lambda x: x.isNotNull() & (F.length(x) == 6))
    time_at = F.coalesce(at + 1, F.size(p) - 2)
    keep = [F.col(c) for c in rows.columns]
    return marked.select(
        *keep, F.get(p, F.lit(0)).alias("originator"), F.get(p, F.lit(1)).alias("event_code"), F.concat(whole, tail).alias("locations"),
        F.coalesce(minutes(F.substring(end, F.locate("+", end) + 1, 100)), F.lit(0)).alias("duration_mins"),
        F.coalesce(issue_time(F.get(p, time_at)), F.lit("")).alias("issued_utc"),
        F.coalesce(F.trim(F.get(p, time_at + 1)), F.lit("")).alias("station"),
    )


def vote(repeats: DataFrame, alert: str, header: str, position: str) -> DataFrame:
    """Most frequent header of each alert, the earliest on ties."""
    counted = repeats.groupBy(alert, header).agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("_first"))
    return counted.groupBy(alert).agg(
        F.max_by(header, F.struct("votes", -F.col("_first"))).alias(header), F.max("votes").alias("votes")
    )


def name_codes(alerts: DataFrame) -> DataFrame:
    code = F.col("event_code")
    name = lookup([(c, n) for c, n, _ in ref.ALERT_CODES], code)
    severity = lookup([(c, s) for c, _, s in ref.ALERT_CODES], code)
    return alerts.withColumn("event_name", F.coalesce(name, F.lit("Unknown Event"))).withColumn(
        "alert_severity", F.coalesce(severity, F.lit("Info"))
    )


def county(code: Column) -> Column:
    """County and state of a six-digit location; its first digit is a part."""
    area = F.substring(code, 2, 5)
    known = lookup([(c, n) for c, n, _ in ref.COUNTIES], area)
    state = lookup(ref.STATES, F.substring(area, 1, 2))
    good = F.length(code) == 6
    return F.struct(
        code.alias("code"),
        F.when(good & known.isNotNull(), known).when(good & state.isNotNull(), "Unknown County").otherwise("Unknown").alias("county"),
        F.when(good, F.coalesce(state, F.lit("??"))).otherwise("??").alias("state"),
    )


def active(alerts: DataFrame, as_of: Column) -> DataFrame:
    return alerts.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
