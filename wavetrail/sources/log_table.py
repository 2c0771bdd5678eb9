"""A stored event log whose changes are seen as a whole or not at all.

Data lies in folders that are never changed once written: ``data/batch=<id>/event_date=<day>``. Which of them make up the log is said by
the newest manifest, one Parquet file per version. A change writes its folders first and its manifest last, so a reader sees the state
before it or after it; a change that breaks off leaves folders that no manifest names. There is one writer at a time.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail.operators.query import SECOND_NS
from wavetrail.sources.sinks import kept_after_purge, with_event_date

MANIFEST = "entries array<struct<day: date, batch: string>>, v int"


class LogTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([f for f in schema.fields if f.name not in ("event_date", "batch")])

    def _entries(self) -> tuple[int, list[tuple[datetime.date, str]]]:
        """Version and entries of the newest manifest: one short entry for each day and append."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("v")).limit(1).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return (rows[0].v, [(e.day, e.batch) for e in rows[0].entries]) if rows else (0, [])

    def _commit(self, version: int, entries: list[tuple[datetime.date, str]]) -> None:
        manifest = self.spark.createDataFrame([(entries,)], MANIFEST.rsplit(",", 1)[0])
        # one row is one file, which appears at once
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")

    def _write(self, log: DataFrame) -> list[tuple[datetime.date, str]]:
        """The rows in a folder of their own, in days, sorted by time; its days."""
        batch = uuid.uuid4().hex
        dated = with_event_date(log.select(*self.schema.names))
        folder = f"{self.path}/data/batch={batch}"
        (
            dated.repartitionByRange("event_date", "timestamp_ns").sortWithinPartitions("event_date", "timestamp_ns")
            .write.partitionBy("event_date").parquet(folder)
        )
        days = self.spark.read.schema("event_date date").parquet(folder).select("event_date").distinct()
        return [(r.event_date, batch) for r in days.collect()]

    def append(self, log: DataFrame) -> None:
        version, entries = self._entries()
        self._commit(version + 1, entries + self._write(log))

    def read(self, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
        """The log, or the days from first to last of it; other folders are not opened."""
        _, entries = self._entries()
        return self._open([(d, b) for d, b in entries if (first is None or d >= first) and (last is None or d <= last)])

    def _open(self, entries: list[tuple[datetime.date, str]]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.StringType())])
        if not entries:
            return self.spark.createDataFrame([], schema).drop("batch")
        paths = [f"{self.path}/data/batch={b}/event_date={d.isoformat()}" for d, b in entries]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop("batch")

    def purge(self, before_ns: int) -> None:
        """Removes what ``sinks.purged`` names: whole days by leaving them out, the day of the cut by writing its kept rows anew."""
        version, entries = self._entries()
        cut = datetime.datetime.fromtimestamp(before_ns // SECOND_NS, datetime.timezone.utc).date()
        later = [e for e in entries if e[0] > cut]
        kept = kept_after_purge(self._open([e for e in entries if e[0] == cut]), before_ns)
        self._commit(version + 1, later + self._write(kept))

    def vacuum(self) -> list[str]:
        """Deletes day folders that the newest manifest does not name, once no reader needs an older state; returns them."""
        _, entries = self._entries()
        named = {(d.isoformat(), b) for d, b in entries}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/data")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for batch in store.listStatus(root):
            for day in store.listStatus(batch.getPath()):
                name = day.getPath().getName()
                key = (name.removeprefix("event_date="), batch.getPath().getName().removeprefix("batch="))
                if name.startswith("event_date=") and key not in named:
                    gone.append("/".join(key))
                    store.delete(day.getPath(), True)
        return gone
