"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm.batches import SLICE_BYTES

_OWN: dict[str, str] = {}
#: With this, Spark removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that Spark hands to Python, and gets to hold for it outside its heap.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of a sieve for each key, and at most (8 MB; a fuller sieve lets more rows pass).
SIEVE_BITS, SIEVE_MOST = 16, 1 << 26


def work_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, below it a folder of this application (to be cleared when the application has ended).

    Where it is unset, a local folder serves a local session only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not root:
            root = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="wavetrail-work-")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet and reads it again: it is computed once, and a lost executor costs no recomputation of it.

    Its shuffle files go as soon as it is written, so a job of many steps takes the disk of its largest step.
    """
    conf = df.sparkSession.conf
    path, before = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets batches for Python end at SLICE_BYTES, unless the session has set a limit: operators take no more at a time.

    Without it a batch has up to 10 000 rows or 64 MB, held by the executor and by its worker, both of which keep the memory.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return spark


def release(*frames: DataFrame) -> None:
    """Removes the files of materialised frames that nothing reads any more; frames made of them must be materialised themselves."""
    for df in frames:
        spark, folder = df.sparkSession, None
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
        if folder is not None and f"/{spark.sparkContext.applicationId}/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sifted(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column, name: str) -> DataFrame:
    """rows with the column _may, false only where no key has the row's hash; keys is read twice.

    The sieve, one bit for each hash modulo its size, is small enough to be broadcast, so only rows that may have a key need be shuffled
    to it. Other keys set the same bits: what may have a key must still be joined.
    """
    bits = SIEVE_BITS * max(keys.count(), 2048)
    size = min(1 << (bits - 1).bit_length(), SIEVE_MOST)
    at = F.pmod(key_hash, F.lit(size)) + 1
    sieve = keys.select(F.bitmap_bucket_number(at).alias("_slot"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.pmod(row_hash, F.lit(size)) + 1
    placed = rows.withColumns({"_slot": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}).join(F.broadcast(materialise(sieve, name)), "_slot", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_bit div 8 + 1 AS int)"), F.lit(1))), 16, 10).cast("int")
    return placed.withColumn("_may", F.coalesce(F.getbit(byte, F.expr("cast(_bit % 8 AS int)")) == 1, F.lit(False))).select(*rows.columns, "_may")
