"""Windows of symbols that also start earlier in the corpus, found exactly; shared by the two substring operators.

Symbols are bytes or words. The gram of least hash inside a window is its trigger (the leftmost of equals), so equal windows have
their trigger at the same place. Windows with one trigger occurrence are neighbours and form a phrase; neighbouring phrases overlap,
and equal phrases hold equal windows. Hence:

1. `phrases`: every document becomes a sequence of phrases (trigger, digest, place in order).
2. `marks`: a phrase whose digest an earlier document has is a copy as a whole. A first copy whose trigger also starts other phrases is open.
3. `contexts`: the content of open phrases meets by trigger, and their windows are compared there. Where a trigger has more than
   ``CROWD`` phrases, each window travels alone and meets its equals by its own hash, so no task gets all phrases of one trigger.

All that is shuffled in step 1 is one row per phrase and document. Copies inside one batch are decided there and travel under a key of
their own, so a passage that a third of all documents share brings one row per batch to its key, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.llm.batches import U64, Totals, least_of, mix, slices

#: Windows of a long document that are taken at once; counted from its start, so every pass cuts alike.
SEGMENT = 1 << 20
COPIED, OPEN, CROWDED = 1, 2, 3
#: Rows of a trigger that are compared by one task.
CROWD = 50_000


@dataclass
class Phrases:
    """Phrases of a batch in order: row, first and last window start (from the row's start), trigger, digest.

    ordinal numbers a row's distinct digests in order of first occurrence; first marks these occurrences. source is what the reader of the
    batch wants to keep.
    """

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray
    digest: np.ndarray
    ordinal: np.ndarray
    first: np.ndarray
    source: tuple = ()


def _stretches(symbols: np.ndarray, row: np.ndarray, cut: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, trigger, digest) of each phrase in a piece; cut: True where a phrase must not go on."""
    n = len(symbols) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    totals = Totals(symbols)
    grams = totals.grams(gram)
    # upper 40 bits of the hash, lower 24 the place: the least is the leftmost of the least
    place = np.arange(len(grams), dtype=U64)
    owner = (least_of((grams & ~U64((1 << 24) - 1)) | place, length - gram + 1) & U64((1 << 24) - 1)).astype(np.int64)
    valid = row[:n] == row[length - 1 :]
    starts = valid.copy()
    starts[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1] | cut[1:n]
    low = np.flatnonzero(starts)
    ends = valid.copy()
    ends[:-1] &= starts[1:] | ~valid[1:]
    high = np.flatnonzero(ends)
    trigger = grams[owner[low]]
    digest = mix(totals.spans(low, high + length) + (owner[low] - low).astype(U64) * U64(0xD6E8FEB86659FD93))
    return low, high, trigger, digest


def parse(symbols: Callable[[int, int], np.ndarray], offsets: np.ndarray, length: int, gram: int) -> Phrases:
    """The phrases of rows of symbols; symbols(a, b) gives the hashes of the batch's symbols in [a, b)."""
    found: list[tuple[np.ndarray, ...]] = []

    def take(low_row: int, high_row: int, start: int, end: int) -> None:
        part = symbols(start, end)
        rows = np.repeat(np.arange(low_row, high_row), np.clip(np.diff(offsets[low_row : high_row + 1]), 0, end - start))
        low, high, trigger, digest = _stretches(part, rows, (np.arange(start, end) - offsets[rows]) % SEGMENT == 0, length, gram)
        row = rows[low] if len(low) else np.zeros(0, np.int64)
        found.append((row, low + start - offsets[row], high + start - offsets[row], trigger, digest))

    low_row, n = 0, len(offsets) - 1
    while low_row < n:
        high_row = max(low_row + 1, int(np.searchsorted(offsets, offsets[low_row] + SEGMENT, "right")) - 1)
        start, end = int(offsets[low_row]), int(offsets[high_row])
        if end - start <= SEGMENT:
            take(low_row, high_row, start, end)
        else:  # one long row
            for at in range(start, end, SEGMENT):
                take(low_row, high_row, at, min(at + SEGMENT + length - 1, end))
        low_row = high_row
    row, low, high, trigger, digest = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    order = np.lexsort((low, digest, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    first = np.zeros(len(order), dtype=bool)
    first[order[new]] = True
    number = np.cumsum(first) - 1
    number -= number[np.searchsorted(row, row)] if len(row) else 0  # the row's first phrase is a first occurrence
    ordinal = np.empty(len(order), dtype=np.int64)
    ordinal[order] = number[order[new]][np.cumsum(new) - 1]
    return Phrases(row, low, high, trigger, digest, ordinal, first)


def keyed(documents: DataFrame) -> DataFrame:
    """(place, copy, doc_id, text): place orders documents (a null id comes last), copy numbers rows of one id by text.

    The texts are shuffled here, once: all passes start from this exchange.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    copy = F.row_number().over(Window.partitionBy("place").orderBy("text")) - 1
    return rows.withColumn("copy", copy.cast("long")).select("place", "copy", "doc_id", "text")


def phrases(rows: DataFrame, read: Callable[[pa.RecordBatch], Phrases]) -> DataFrame:
    """(trigger, digest, place, packed, known) of the distinct phrases of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            p = read(batch)
            own = np.flatnonzero(p.first)
            place, copy = (np.asarray(batch.column(c))[p.row[own]] for c in ("place", "copy"))
            trigger, digest = p.trigger[own], p.digest[own]
            order = np.lexsort((place, digest))
            head = np.ones(len(own), dtype=bool)
            head[1:] = digest[order][1:] != digest[order][:-1]
            least = np.empty(len(own), dtype=np.int64)
            least[order] = place[order][head][np.cumsum(head) - 1]
            known = place > least
            # a copy that is decided here goes to a key that no other row has
            trigger = np.where(known, mix(digest + place.astype(U64) * U64(0x9FB21C651E98DF25)), trigger)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trigger.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(place), pa.array(copy << 40 | p.ordinal[own] << 2), pa.array(known.astype(np.int8))],
                names=["trigger", "digest", "place", "packed", "known"],
            )

    return rows.mapInArrow(run, "trigger long, digest long, place long, packed long, known byte")


def marks(found: DataFrame) -> DataFrame:
    """(place, marks, open): for each document with copied or open phrases, copy << 40 | ordinal << 2 | state."""
    phrase = Window.partitionBy("trigger", "digest")
    trigger = Window.partitionBy("trigger")
    crowded = F.count("*").over(trigger) > CROWD
    seen = found.withColumn("least", F.min("place").over(phrase))
    seen = seen.withColumn("several", F.min("digest").over(trigger) != F.max("digest").over(trigger)).withColumn("crowded", crowded)
    copied = (F.col("known") == 1) | (F.col("place") > F.col("least"))
    state = F.when(copied, COPIED).when(F.col("several"), F.when(F.col("crowded"), CROWDED).otherwise(OPEN))
    kept = seen.select("place", "packed", state.alias("state")).filter(F.col("state").isNotNull())
    return kept.groupBy("place").agg(F.collect_list(F.col("packed").bitwiseOR(F.col("state").cast("long"))).alias("marks"), F.max("state").alias("state"))


def states(batch: pa.RecordBatch, p: Phrases) -> np.ndarray:
    """State of every phrase of a batch with columns copy and marks; 0 for one that nothing else has."""
    listed = batch.column("marks")
    values = np.asarray(listed.flatten(), dtype=np.int64)
    counts = np.nan_to_num(np.asarray(pa.compute.list_value_length(listed), dtype=np.float64)).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), counts)
    copy = np.asarray(batch.column("copy"))
    mine = values >> 40 == copy[row]
    row, values = row[mine], values[mine]
    limit = int(p.ordinal.max(initial=0)) + 1
    table = np.zeros(batch.num_rows * limit, dtype=np.int8)
    table[row * limit + (values >> 2 & ((1 << 38) - 1))] = values & 3
    return table[p.row * limit + p.ordinal]


def contexts(joined: DataFrame, read: Callable[[pa.RecordBatch], Phrases], content: Callable, step: int, width: int) -> DataFrame:
    """(trigger, place, packed, shift, content, known) of open phrases; content(batch, phrases, chosen) gives a binary for each chosen one.

    Window i of a phrase is content[i * step : i * step + width]. Each window of a crowded phrase has a row of its own, shift being its
    number and its hash the trigger; one that its batch knows to be a copy is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            p = read(batch)
            state = states(batch, p)
            chosen = np.flatnonzero((state >= OPEN) & p.first)
            place, copy = (np.asarray(batch.column(c))[p.row[chosen]] for c in ("place", "copy"))
            packed, contents = copy << 40 | p.ordinal[chosen] << 2, content(batch, p, chosen)
            crowded = state[chosen] == CROWDED
            whole = np.flatnonzero(~crowded)
            rows = [(t, a, b, 0, contents[i], False) for t, a, b, i in zip(p.trigger[chosen][whole].view(np.int64).tolist(), place[whole].tolist(), packed[whole].tolist(), whole.tolist(), strict=True)]
            if crowded.any():
                rows += alone([(place[i], packed[i], contents[i]) for i in np.flatnonzero(crowded).tolist()])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["trigger", "place", "packed", "shift", "content", "known"])

    def alone(crowd: list[tuple[int, int, bytes]]) -> list[tuple]:
        least: dict[bytes, int] = {}
        rows = []
        for place, packed, own in crowd:
            for shift in range((len(own) - width) // step + 1):
                window = own[shift * step : shift * step + width]
                least[window] = min(place, least.get(window, place))
                rows.append((place, packed, shift, window))
        out = []
        for place, packed, shift, window in rows:
            known = place > least[window]
            salt = f"{place}:{packed}:{shift}".encode() if known else b""  # decided here: a key that no other row has
            key = int.from_bytes(hashlib.blake2b(window + salt, digest_size=8).digest(), "big", signed=True)
            out.append((key, place, packed, shift, window, known))
        return out

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    types = "trigger long, place long, packed long, shift int, content binary, known boolean"
    return joined.filter(F.col("state") >= OPEN).mapInArrow(run, types)


def compared(open_phrases: DataFrame, ranks: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], within: bool, block: int) -> DataFrame:
    """(place, found): windows of open phrases that also start earlier, as (packed, shift, bits) with one byte per window from the shift on.

    ranks(contents) gives, for every window of every content, the content's index (ascending) and a number that equal windows share.
    within: an earlier start in the same document counts, too. Triggers are taken together up to `block` bytes of content.
    """

    def decide(rows: pa.Table) -> pa.RecordBatch:
        contents = rows.column("content").to_pylist()
        of, rank = ranks(contents)
        place, packed, shift = (np.asarray(rows.column(c)) for c in ("place", "packed", "shift"))
        known = rows.column("known").to_numpy()
        order = np.lexsort((shift[of], packed[of], place[of], rank))  # packed orders copies, then first occurrences in a document
        sorted_of, sorted_rank = of[order], rank[order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = sorted_rank[1:] != sorted_rank[:-1]
        least = place[sorted_of][head][np.cumsum(head) - 1]
        copied = (place[sorted_of] > least) | known[sorted_of]
        if within:
            document = place[sorted_of], packed[sorted_of] >> 40
            copied[1:] |= ~head[1:] & (document[0][1:] == document[0][:-1]) & (document[1][1:] == document[1][:-1])
        bits = np.zeros(len(order), dtype=np.uint8)
        bits[order] = copied
        ends = np.searchsorted(of, np.arange(len(contents)), "right")
        starts = np.concatenate([[0], ends[:-1]])
        any_bit = np.flatnonzero(np.maximum.reduceat(np.append(bits, 0), starts) * (ends > starts))
        raw = bits.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array(place[any_bit]), pa.array(packed[any_bit]), pa.array(shift[any_bit]), pa.array([raw[starts[i] : ends[i]] for i in any_bit.tolist()], pa.binary())],
            names=["place", "packed", "shift", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows whose trigger may go on
        for batch in (part for whole in batches for part in slices(whole, "content", block)):
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            trigger = np.asarray(rows.column("trigger"))
            done = int(np.count_nonzero(trigger != trigger[-1]))
            if done:
                yield decide(rows.slice(0, done))
            held = rows.slice(done)
        if held is not None and held.num_rows:
            yield decide(held)

    partitions = int(open_phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = open_phrases.repartition(partitions, "trigger").sortWithinPartitions("trigger")
    found = ordered.mapInArrow(run, "place long, packed long, shift int, bits binary")
    return found.groupBy("place").agg(F.collect_list(F.struct("packed", "shift", "bits")).alias("found"))


def copied_windows(batch: pa.RecordBatch, p: Phrases, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of runs of windows that also start earlier."""
    state = states(batch, p)
    whole = (state == COPIED) | (~p.first if within else False)
    runs = [(p.row[whole], p.low[whole], p.high[whole])]
    listed = batch.column("found")
    counts = np.nan_to_num(np.asarray(pa.compute.list_value_length(listed), dtype=np.float64)).astype(np.int64)
    if counts.sum():
        flat = listed.flatten()
        packed = np.asarray(flat.field("packed"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        mine = packed >> 40 == np.asarray(batch.column("copy"))[row]
        shift = np.asarray(flat.field("shift"))
        bits: dict[tuple[int, int], list] = {}
        for r, k, at, own, m in zip(row.tolist(), (packed >> 2 & ((1 << 38) - 1)).tolist(), shift.tolist(), flat.field("bits").to_pylist(), mine.tolist(), strict=True):
            if m:
                bits.setdefault((r, k), []).append((at, own))
        partly = np.flatnonzero((state >= OPEN) & ~whole)
        for r, k, low in zip(p.row[partly].tolist(), p.ordinal[partly].tolist(), p.low[partly].tolist(), strict=True):
            for at, own in bits.get((r, k), ()):
                edge = np.diff(np.frombuffer(b"\0" + own + b"\0", dtype=np.int8))
                starts = np.flatnonzero(edge == 1) + low + at
                runs.append((np.full(len(starts), r), starts, np.flatnonzero(edge == -1) - 1 + low + at))
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def covered(runs: tuple[np.ndarray, np.ndarray, np.ndarray], offsets: np.ndarray, length: int) -> np.ndarray:
    """True for every symbol of the batch inside one of the windows."""
    row, low, high = runs
    change = np.zeros(offsets[-1] + 1, dtype=np.int32)
    np.add.at(change, offsets[row] + low, 1)
    np.add.at(change, offsets[row] + high + length, -1)
    return np.cumsum(change[:-1]) > 0


def resolve(documents: DataFrame, read: Callable, content: Callable, ranks: Callable, within: bool, block: int, step: int, width: int) -> DataFrame:
    """(place, copy, doc_id, text, marks, found) of every document, as `copied_windows` reads them."""
    rows = keyed(documents)
    marked = rows.join(marks(phrases(rows, read)), "place", "left")
    found = compared(contexts(marked, read, content, step, width), ranks, within, block)
    return marked.join(found, "place", "left").select("place", "copy", "doc_id", "text", "marks", "found")
