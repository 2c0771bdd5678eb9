"""Sources: stored event log, frequency lists, network seeds, raw I/Q, messages."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail import schemas
from wavetrail.functions import scalars as S

#: Pairs below which a recording carries too little to measure.
MIN_IQ_PAIRS = 480
#: Bytes of one little-endian float32 pair.
PAIR = 8


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log; ``event_date`` folders prune on time."""
    return spark.read.schema(T.StructType([*schemas.EVENT_LOG.fields, T.StructField("event_date", T.DateType())])).parquet(path)


def frequency_list(documents: DataFrame, text: str = "value") -> DataFrame:
    """Rows of ``{conventional: [...]}`` documents, in list order."""
    parsed = parse_once(documents.select(text), text, schemas.FREQUENCY_LIST)
    return parsed.select(F.posexplode("conventional").alias("position", "e")).select("position", "e.*")


def read_frequency_list(spark: SparkSession, path: str) -> DataFrame:
    return frequency_list(spark.read.text(path, wholetext=True))


def hex_number(text: Column, default: int) -> Column:
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^0[xX]([0-9A-Fa-f]+)$", 1)
    return F.coalesce(F.when(digits != "", F.conv(digits, 16, 10).cast("long")), F.lit(default))


def network_seed(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Sites and talkgroups of seed documents as dimension rows."""
    d = parse_once(documents.select(text), text, schemas.NETWORK_SEED)
    # Identifiers assumed where a document names none.
    wacn, system_id = hex_number(F.col("wacn"), 0xBEE00), hex_number(F.col("system_id"), 0x3CC)
    ccs = F.col("s.control_channels")
    sites = d.select("system", wacn.alias("wacn"), system_id.alias("system_id"), F.explode("sites").alias("s")).where(
        F.coalesce(F.col("s.site"), F.lit(0)) != 0
    ).select(
        "system", "wacn", "system_id", F.coalesce("s.rfss", F.lit(0)).alias("rfss_id"), F.col("s.site").alias("site_id"), "s.name",
        F.get(ccs, F.lit(0)).alias("control_channel"),
        F.to_json(F.transform(F.slice(ccs, F.lit(2), F.greatest(F.size(ccs) - 1, F.lit(0))), lambda f: F.struct(f.alias("freq_mhz")))).alias("alt_control"),
    )
    t = F.col("t")
    talkgroups = d.select("system", F.explode("talkgroups").alias("t")).where(F.coalesce(t["tgid"], F.lit(0)) != 0).select(
        "system", t["tgid"].alias("tgid"), t["alpha_tag"].alias("name"), t["department"].alias("department"), t["tag"].alias("tag"),
        F.when(t["mode"].isin("DE", "E"), "encrypted").otherwise("clear").alias("encrypted"),
        S.department_class(t["department"], t["tag"]).alias("cls"),
    )
    return sites, talkgroups


def iq_files(spark: SparkSession, path: str, pairs_per_row: int = 65_536) -> DataFrame:
    """Raw interleaved little-endian float32 files as rows of samples, ``part`` counting the rows of a file.

    A file becomes several rows of bounded size, so long recordings spread out downstream; bytes after the last whole pair are
    ignored. ``enough_samples`` is false for files too short to measure. Spark reads a binary file whole, so a file must stay
    below 2 GB; recorders roll files over long before that.
    """

    def split(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                n = len(content) // PAIR
                pairs = np.frombuffer(content, dtype="<f4", count=2 * n).reshape(-1, 2)
                for part, at in enumerate(range(0, n, pairs_per_row)):
                    piece = pairs[at: at + pairs_per_row].astype("float64")
                    yield pd.DataFrame({"path": [name], "part": [part], "enough_samples": [n >= MIN_IQ_PAIRS], "i": [piece[:, 0]], "q": [piece[:, 1]]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(split, "path string, part int, enough_samples boolean, i array<double>, q array<double>")


def protocol_messages(messages: DataFrame, text: str = "message", kinds: list[str] | None = None) -> DataFrame:
    """Tagged-union JSON to typed columns ``nac`` and ``payload``; for some kinds only, others may be left NULL."""
    return parse_once(messages, text, schemas.PROTOCOL_MESSAGE, kinds)


def parse_once(df: DataFrame, text: str, schema, words: list[str] | None = None) -> DataFrame:
    """Replace a JSON text column by its top-level fields, parsing each row once.

    Selecting fields of ``from_json`` would parse the text again for every field
    used; going through a generator keeps it to one parse. A text that cannot
    name one of the ``words`` as a value is not parsed, its fields are NULL.
    """
    keep = [c for c in df.columns if c != text]
    fields = F.from_json(text, schema)
    if words is not None:
        # a value is spelled out in its text unless there is an escape in it
        fields = F.when(reduce(or_, [F.contains(text, F.lit(w)) for w in [*words, "\\"]]), fields)
    return df.select(*keep, F.inline(F.array(fields)))
