"""Explicit schemas; nothing in the library infers one from data."""

from pyspark.sql import types as T

L, D, S, B, I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()  # noqa: E741


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


EVENT_LOG = struct(
    ("id", L), ("ts", T.TimestampType()), ("timestamp_ns", L), ("ts_bucket", L), ("event_type", S), ("severity", I),
    ("source", I), ("body", S), ("freq_mhz", D), ("talkgroup", L), ("source_unit", L), ("nac", L), ("encrypted", B),
    ("band", S), ("device_key", S), ("classification", S), ("duid", S), ("power", D), ("attributes", S), ("k", L),
)

RAW_EVENTS = struct(
    ("event_id", L), ("ts", T.TimestampNTZType()), ("user_id", L), ("event_type", S), ("value", D), ("props", S)
)

CHANNEL = struct(("channel_id", L), ("channel_num", L), ("talkgroup", L))

# One struct with the fields of every protocol message; ``type`` tells which are set.
PROTOCOL_PAYLOAD = struct(
    ("type", S), ("talkgroup", L), ("src_unit", L), ("source", L), ("dest_unit", L), ("target", L), ("channel_id", L),
    ("channel_num", L), ("voice_freq", D), ("emergency", B), ("encrypted", B), ("updates", T.ArrayType(CHANNEL)),
    ("wacn", L), ("system", L), ("system_id", L), ("rfss", L), ("site", L), ("networked", B), ("id", L),
    ("bandwidth_hz", L), ("base_freq_hz", L), ("spacing_hz", L), ("channels", T.ArrayType(CHANNEL)), ("raw", T.ArrayType(L)),
)
PROTOCOL_MESSAGE = struct(("nac", L), ("payload", PROTOCOL_PAYLOAD))

FREQUENCY_LIST = struct((
    "conventional",
    T.ArrayType(struct(("freq", D), ("name", S), ("cls", S), ("band", S), ("mode", S), ("tag", S))),
))

NETWORK_SEED = struct(
    ("system", S), ("wacn", S), ("system_id", S),
    ("sites", T.ArrayType(struct(("rfss", L), ("site", L), ("name", S), ("control_channels", T.ArrayType(D))))),
    ("talkgroups", T.ArrayType(struct(("tgid", L), ("alpha_tag", S), ("department", S), ("tag", S), ("mode", S)))),
)

VOICE_METADATA = struct(
    ("duid", S), ("talkgroup", L), ("source_unit", L), ("nac", L), ("encrypted", B), ("freq_mhz", D)
)
BROADCAST_METADATA = struct(("ps", S), ("rt", S), ("pi", S), ("freq_mhz", D))
