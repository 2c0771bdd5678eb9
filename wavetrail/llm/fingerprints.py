"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes cuts a text wherever its upper bits are zero: with more bits up to the normal chunk length and
fewer beyond it, so lengths gather around the normal one. Boundaries depend on content alone, so an edit changes the chunks it
touches and no others, wherever the text moves. A fingerprint is the set of (digest, length) of the chunks, written as 14
hexadecimal digits each (48 bits of digest, 8 bits of length - 1) in ascending order. Likeness is containment: the share of a
fingerprint's chunk length that the other one holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm.batches import SYMBOLS, U64, Totals, mix, pieces, slices, utf8
from wavetrail.llm.registry import query, table

#: Bytes of a chunk: least (the gear window), normal, most.
LEAST, NORMAL, MOST = 32, 64, 256
#: Zero bits that end a chunk before and after its normal length.
HARD_BITS, EASY_BITS = 7, 5
#: Text of one ordered bucket of documents.
BUCKET_BYTES = 256 << 20

GEAR = (mix(np.arange(257, 513, dtype=U64)) >> U64(32)).astype(np.uint32)
_NIBBLES = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of every chunk of every row, and its row. No chunk looks at bytes before its own start."""
    h = gear(data)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = (h[easy] < np.uint32(1 << (32 - HARD_BITS))).tolist()
    first = np.searchsorted(easy, offsets).tolist()
    candidates, ends, rows = easy.tolist(), [], []
    for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        k, n = first[row], first[row + 1]
        before = len(ends)
        while start < end:
            limit = min(start + MOST, end)
            cut, low, normal = limit, start + LEAST - 1, start + NORMAL - 1
            while k < n and candidates[k] < low:
                k += 1
            while k < n and (at := candidates[k]) < limit:
                k += 1
                if at >= normal or hard[k - 1]:
                    cut = at + 1
                    break
            ends.append(cut)
            start = cut
        rows += [row] * (len(ends) - before)
    return np.array(ends, dtype=np.int64), np.array(rows, dtype=np.int64)


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the distinct chunks, by row and value; value is 48 bits of digest and 8 of length - 1."""
    all_rows, all_values = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for low, high in pieces(offsets):
        own = offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        if len(part) == 0:
            continue
        ends, rows = boundaries(part, own)
        starts = np.concatenate([[0], ends[:-1]])
        values = (Totals(SYMBOLS[part]).spans(starts, ends) >> U64(16) << U64(8)) | (ends - starts - 1).astype(U64)
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        all_rows.append(rows[new] + low)
        all_values.append(values[new])
    return np.concatenate(all_rows), np.concatenate(all_values)


def written(rows: np.ndarray, values: np.ndarray, n: int) -> list[str]:
    """The fingerprint of each of n rows."""
    digits = np.empty((len(values), 14), dtype=np.uint8)
    for k in range(14):
        digits[:, k] = _NIBBLES[((values >> U64(52 - 4 * k)) & U64(15)).astype(np.intp)]
    text, ends = digits.tobytes(), np.searchsorted(rows, np.arange(n), "right") * 14
    starts = np.concatenate([[0], ends[:-1]])
    return [text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _weight(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=(values & U64(255)).astype(np.float64) + 1, minlength=n)


def containment(rows: np.ndarray, values: np.ndarray, other_rows: np.ndarray, other_values: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the share of its chunk length that the other set of the row holds; 1 for two empty sets."""
    both_rows, both_values = np.concatenate([rows, other_rows]), np.concatenate([values, other_values])
    order = np.lexsort((both_values, both_rows))
    both_rows, both_values = both_rows[order], both_values[order]
    same = np.flatnonzero((both_rows[1:] == both_rows[:-1]) & (both_values[1:] == both_values[:-1]))
    shared, own, other = _weight(both_rows[same], both_values[same], n), _weight(rows, values, n), _weight(other_rows, other_values, n)
    return np.where(own > 0, shared / np.maximum(own, 1), (other == 0).astype(np.float64))


def likeness(fingerprint: str, other: str) -> float:
    """Containment of two written fingerprints."""
    chunks = {fingerprint[i : i + 14] for i in range(0, len(fingerprint), 14)}
    others = {other[i : i + 14] for i in range(0, len(other), 14)}
    size = sum(int(c[12:], 16) + 1 for c in chunks)
    return sum(int(c[12:], 16) + 1 for c in chunks & others) / size if size else float(not others)


def with_next(documents: DataFrame) -> DataFrame:
    """Documents in ordered buckets (bucket, ghost, doc_id, text), each ending with a copy of the next bucket's first document (ghost = 1).

    A bucket holds a range of ids, so a sorted partition has every document's successor in the row after it, the last one's by its
    ghost. The last bucket's ghost is the first document. Only cut points and least ids of buckets reach the driver; a text is
    shuffled once.
    """
    spark = documents.sparkSession
    least = -(1 << 63)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(least)))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * shuffles, -(-(size.bytes or 0) // BUCKET_BYTES))
    cuts = np.array(sorted(set(rows.approxQuantile("place", [i / buckets for i in range(1, buckets)], 0.25 / buckets))), dtype=np.int64)

    def bucket_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(dtype=np.int64), "right"))

    own = F.pandas_udf(bucket_of, "long")
    firsts = sorted((r.bucket, r.place) for r in rows.select(own("place").alias("bucket"), "place").groupBy("bucket").agg(F.min("place").alias("place")).collect())
    starts = np.array([place for _, place in firsts], dtype=np.int64)  # ascending, as buckets are ranges
    before = np.array([bucket for bucket, _ in firsts[-1:] + firsts[:-1]], dtype=np.int64)

    def targets(place: pd.Series) -> pd.Series:
        values = place.to_numpy(dtype=np.int64)
        bucket = np.searchsorted(cuts, values, "right")
        at = np.minimum(np.searchsorted(starts, values), max(len(starts) - 1, 0))
        ghost = np.where(starts[at] == values, 2 * before[at] + 1, -1) if len(starts) else np.full(len(values), -1)
        return pd.Series([[2 * b] if g < 0 else [2 * b, g] for b, g in zip(bucket.tolist(), ghost.tolist(), strict=True)])

    code = F.explode(F.pandas_udf(targets, "array<long>")("place"))
    placed = rows.select("doc_id", "place", "text", code.alias("code")).select(F.shiftright("code", 1).alias("bucket"), F.col("code").bitwiseAND(1).alias("ghost"), "place", "doc_id", "text")
    return placed.repartition(shuffles, "bucket").sortWithinPartitions("bucket", "ghost", "place", "text").drop("place")


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every code point, and the first one's index of every row (one more at the end)."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return starts, np.searchsorted(starts, offsets)


_COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(),
}


def _fingerprints(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
    """Rows with a successor in the batch, that are no ghosts."""
    data, offsets = utf8(batch.column("text"))
    n = len(offsets) - 2
    starts, points = code_points(data, offsets)
    chars = np.diff(points)
    cut = chars[:-1] // 4
    kept = points[:-2] + chars[:-1] - cut  # code point after the last one kept
    taken = points[1:-1] + np.minimum(cut, chars[1:])
    starts = np.append(starts, len(data))
    raw = data.tobytes()
    edited = [raw[a:b] + raw[b2:c] for a, b, b2, c in zip(offsets[:-2].tolist(), starts[kept].tolist(), offsets[1:-1].tolist(), starts[taken].tolist(), strict=True)]
    edited_offsets = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
    rows, values = chunk_sets(data, offsets)
    edited_rows, edited_values = chunk_sets(np.frombuffer(b"".join(edited), dtype=np.uint8), edited_offsets)
    own, following = rows < n, rows > 0
    near_edited = containment(rows[own], values[own], edited_rows, edited_values, n)
    near_next = containment(rows[own], values[own], rows[following] - 1, values[following], n)
    columns = [
        batch.column("doc_id").slice(0, n), pa.array(chars[:-1], pa.int64()), [hashlib.sha256(e).hexdigest() for e in edited],
        written(rows[own], values[own], n), written(edited_rows, edited_values, n), near_edited, near_next,
    ]
    out = pa.table({name: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, kind) for (name, kind), c in zip(_COLUMNS.items(), columns, strict=True)})
    return out.filter(pa.compute.equal(batch.column("ghost").slice(0, n), 0))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carried = None
    for batch in (part for whole in batches for part in slices(whole)):
        rows = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
        if rows.num_rows > 1:
            yield from _fingerprints(rows.combine_chunks()).to_batches()
        carried = rows.slice(rows.num_rows - 1)
    # the last row of a partition is a ghost


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's text, in
    ascending doc_id; after the last comes the first. Null text is empty; a null doc_id comes first; equal ids are ordered by text;
    repeated rows stay. A single document follows itself. No rows give no rows.
    """
    types = ", ".join(f"{n} {'string' if k == pa.string() else 'double' if k == pa.float64() else 'long'}" for n, k in _COLUMNS.items())
    return with_next(documents).mapInArrow(_stream, types)


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
