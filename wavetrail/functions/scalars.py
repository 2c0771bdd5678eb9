"""Column functions: decoding, formatting, geometry and unit conversion."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.operators.filters import in_any_range

EARTH_RADIUS_M = 6_371_000.0


def lookup(pairs, key: Column) -> Column:
    """Value of a small constant map, NULL where the key is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), key)


def fixed(value: Column, places: int) -> Column:
    """Decimal text rounded from the exact binary value, as C printf does."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places if places else "0"))


def severity_label(code: Column) -> Column:
    steps = ref.SEVERITY_LABELS
    return reduce(lambda acc, s: F.when(code <= s[0], s[1]).otherwise(acc), reversed(steps[:-1]), F.lit(steps[-1][1]))


def source_label(code: Column) -> Column:
    return F.coalesce(lookup(ref.SOURCE_LABELS, code), F.lit("SYSTEM"))


def category(event_type: Column) -> Column:
    return F.substring_index(event_type, ".", 1)


def display_name(event_type: Column) -> Column:
    return F.coalesce(lookup(ref.EVENT_NAMES, event_type), event_type)


def is_tactical(event_type: Column) -> Column:
    return event_type.isin(ref.TACTICAL_EVENTS) | event_type.startswith("custom.")


def bucket_30s(ns: Column) -> Column:
    return ns - ns % 30_000_000_000


def ns_to_timestamp(ns: str = "timestamp_ns") -> Column:
    """Microsecond timestamp; the nanosecond column stays beside it."""
    return F.expr(f"timestamp_micros({ns} div 1000L)")


def is_repeater(freq_mhz: Column) -> Column:
    return in_any_range(freq_mhz, ref.REPEATER_RANGES)


def is_cellular(freq_mhz: Column) -> Column:
    return in_any_range(freq_mhz, ref.CELLULAR_RANGES)


def bands_of(df: DataFrame, spark: SparkSession, freq: str) -> DataFrame:
    """Each row with every named band that holds its frequency (bands overlap)."""
    bands = spark.createDataFrame(ref.BANDS, "band_key string, band_start double, band_end double, band_label string")
    return df.join(F.broadcast(bands), F.col(freq).between(F.col("band_start"), F.col("band_end")), "inner")


def algorithm_id(name: Column, encrypted: Column) -> Column:
    """Numeric algorithm id; ``Unknown(0xNN)`` reads NN as hexadecimal."""
    unknown = F.conv(F.regexp_extract(name, r"^Unknown\(0x([0-9A-Fa-f]+)\)", 1), 16, 10).cast("int")
    known = lookup([(n, i) for n, i, _ in ref.ALGORITHMS], name)
    named = F.coalesce(known, F.when(name.startswith("Unknown(0x"), unknown), F.lit(0))
    clear = F.when(F.coalesce(encrypted, F.lit(False)), 0).otherwise(ref.CLEAR_ALGORITHM)
    return F.when(name.isNull(), clear).otherwise(named)


def algorithm_name(name: Column, encrypted: Column) -> Column:
    fallback = F.when(F.coalesce(encrypted, F.lit(False)), "Unknown").otherwise("Unencrypted")
    return F.coalesce(name, fallback)


def algorithm_short(alg_id: Column) -> Column:
    pairs = list(dict.fromkeys((i, s) for _, i, s in ref.ALGORITHMS))
    return F.coalesce(lookup(pairs, alg_id), F.lit("UNK"))


def department_class(department: Column, tag: Column) -> Column:
    where = {"department": F.lower(F.coalesce(department, F.lit(""))), "tag": F.lower(F.coalesce(tag, F.lit("")))}
    out = F.lit("COMM")
    for source, words, cls in reversed(ref.DEPARTMENT_RULES):
        hit = reduce(lambda a, b: a | b, (where[source].contains(w) for w in words))
        out = F.when(hit, cls).otherwise(out)
    return out


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def linear_to_db(power: Column, floor: float = 1e-24) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(floor)))


def fingerprint_id(cfo: Column, amplitude: Column, phase: Column, cfo_bucket: float = 5.0, resolution: float = 1e-4) -> Column:
    def bucket(x: Column, size: float) -> Column:
        return F.round(x / size).cast("long") if size > 0 else F.lit(0).cast("long")

    return F.format_string(
        "FP-%+06d:%04d:%04d", bucket(cfo, cfo_bucket), bucket(amplitude, resolution), bucket(phase, resolution)
    )


def posture(encrypted: Column, clear: Column) -> Column:
    return F.when(encrypted == 0, "clear").when(clear == 0, "encrypted").otherwise("mixed")


def sunday_dow(ts: Column) -> Column:
    """Day of week with Sunday as 0."""
    return F.dayofweek(ts) - 1
