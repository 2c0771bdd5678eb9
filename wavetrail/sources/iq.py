"""Raw I/Q recordings as a Spark data source: files are read by byte ranges, so one long recording spreads over all tasks.

Files hold little-endian float32 pairs without a header. Paths may be local, mounted or of a store that Arrow reads (hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavetrail.sources.readers import MIN_IQ_PAIRS, PAIR

FORMAT = "iq_ranges"
SCHEMA = "path string, part long, enough_samples boolean, i array<double>, q array<double>"
SUFFIX = ".iq"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Rows low to high of a file that has so many pairs."""

    path: str
    pairs: int
    low: int
    high: int


class RangeReader(DataSourceReader):
    def __init__(self, path: str, pairs_per_row: int, range_bytes: int):
        self.path, self.pairs_per_row = path, pairs_per_row
        self.rows_per_range = max(1, range_bytes // (pairs_per_row * PAIR))

    def partitions(self) -> list[Range]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX)), key=lambda f: f.path):
            pairs = f.size // PAIR
            rows = -(-pairs // self.pairs_per_row)
            out += [Range(f.path, pairs, low, min(low + self.rows_per_range, rows)) for low in range(0, rows, self.rows_per_range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        width = self.pairs_per_row
        with store.open_input_file(partition.path) as file:
            for part in range(partition.low, partition.high):
                n = min(width, partition.pairs - part * width)
                pairs = np.frombuffer(file.read_at(n * PAIR, part * width * PAIR), dtype="<f4").reshape(-1, 2).astype("float64")
                row = {"path": [partition.path], "part": [part], "enough_samples": [partition.pairs >= MIN_IQ_PAIRS], "i": [pairs[:, 0]], "q": [pairs[:, 1]]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("path", pa.string()), ("part", pa.int64()), ("enough_samples", pa.bool_()), ("i", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))


@dataclass
class Written(WriterCommitMessage):
    """Recordings of a task: under which name they lie, and what they are to be called."""

    files: list[tuple[str, str]]


class RecordingWriter(DataSourceArrowWriter):
    """Rows (recording, i, q), sorted by recording inside each task, become one file a recording; the names appear when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root)
        files, name, out = [], None, None
        for batch in batches:
            for recording, i, q in zip(batch.column("recording").to_pylist(), batch.column("i"), batch.column("q"), strict=True):
                if recording != name:
                    if out is not None:
                        out.close()
                    name, hidden = recording, f"{root}/_{recording}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(hidden)
                    files.append((hidden, f"{root}/{recording}{SUFFIX}"))
                out.write(np.stack([i.values.to_numpy(), q.values.to_numpy()], 1).astype("<f4").tobytes())
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for hidden, name in message.files if message else []:
                store.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for hidden, _name in message.files if message else []:
                store.delete_file(hidden)


class IqRanges(DataSource):
    """Options: ``path`` (a file or a folder), ``pairsPerRow``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("pairsperrow", 65_536)), int(self.options.get("rangebytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"])


def iq_ranges(spark: SparkSession, path: str, pairs_per_row: int = 65_536, range_bytes: int = 128 << 20) -> DataFrame:
    """Recordings as rows of samples; ``part`` counts the rows of a file. Bytes after the last whole pair are ignored.

    ``enough_samples`` is false for files too short to measure. Files of any length are cut into ranges of whole rows.
    """
    spark.dataSource.register(IqRanges)
    return spark.read.format(FORMAT).option("pairsPerRow", pairs_per_row).option("rangeBytes", range_bytes).load(path)


def write_recordings(dwells: DataFrame, path: str, recording: str, order: list[str]) -> None:
    """Dwells (i, q) of each recording, joined in order, as one file per recording."""
    dwells.sparkSession.dataSource.register(IqRanges)
    rows = dwells.withColumnRenamed(recording, "recording").repartition("recording").sortWithinPartitions("recording", *order)
    rows.select("recording", "i", "q").write.format(FORMAT).mode("append").save(path)
