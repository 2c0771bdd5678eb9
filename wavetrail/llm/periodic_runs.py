"""Periodic runs of words by a sparse diagonal pass, and texts with the repetitions of each run taken out.

A diagonal is a lag d: the words i with word[i] = word[i - d]. A stretch of consecutive matches on it, of length m, is a run with period d
over m + d words. A run of length max(least, 2d) needs m >= max(least - d, d), so a lag is only worth following where many words match in
a row. This makes the table of diagonals sparse:

* lags below 8 are compared word by word, all of them at once;
* a lag in [2^k, 2^(k+1)) is opened by an earlier occurrence of the 2^k words that begin at i (so far back, not farther), and only where
  the word before breaks the match: elsewhere the lag is active already. Positions whose 2^k words occur once open nothing and are not
  looked at again for longer lags. Few words of ordinary text are left after the first of these rounds, and even in a text of one word
  the openings are linear in its length for each k;
* the match lengths of all active lags of a batch grow together, in strides that halve (equal strides by hashes of spans), up to the word
  where the diagonal ends. What ends long enough is a run.

A diagonal whose lag is a multiple of the smallest period covers the same words, so of equal stretches of words the least lag is kept.
Documents are taken where they lie: nothing is shuffled. Memory follows the longest text, time is n log n in its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm.batches import U64, Totals, mix, slices
from wavetrail.llm.registry import query, table

#: Least number of words of a run; it also holds its period twice.
LEAST = 12
#: Lags below this are compared word by word.
NEAR = 8

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: Runs = (np.zeros(0, np.int64),) * 3


def _near(ids: np.ndarray, text: np.ndarray, least: int) -> Iterator[Runs]:
    """(start, end, period) on the diagonals of small lags."""
    for lag in range(1, NEAR):
        same = np.zeros(len(ids) + 1, dtype=np.int8)
        same[lag:-1] = (ids[lag:] == ids[:-lag]) & (text[lag:] == text[:-lag])
        edges = np.diff(same, prepend=np.int8(0))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - begin >= max(least - lag, lag)
        yield begin[long] - lag, end[long], np.full(int(long.sum()), lag)


def _openings(places: np.ndarray, keys: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of equal keys, `width` to 2 * width - 1 apart, with other words before them; and the places whose key is repeated.

    places ascend; before holds the word in front of each place, or a value of its own at the start of a text.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    repeated = ~new
    repeated[:-1] |= ~new[1:]
    order, new = order[repeated], new[repeated]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, ahead = places[order], before[order]
    group = np.cumsum(new) - 1
    group_start = np.flatnonzero(new)[group]
    # blocks of neighbours with one word before them
    fresh = new.copy()
    fresh[1:] |= ahead[1:] != ahead[:-1]
    block_start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    line = group * (int(places[-1]) + 2 * width + 2) + at
    low = np.maximum(np.searchsorted(line, line - (2 * width - 1), "left"), group_start)
    stop = np.minimum(np.searchsorted(line, line - width, "right"), block_start)
    earlier, later = [], []
    active = np.flatnonzero(stop > low)
    while len(active):
        begin = np.maximum(block_start[stop[active] - 1], low[active])
        differ = ahead[begin] != ahead[active]
        counts = np.where(differ, stop[active] - begin, 0)
        owner = np.repeat(active, counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        earlier.append(at[np.repeat(begin, counts) + inside])
        later.append(at[owner])
        stop[active] = begin
        active = active[begin > low[active]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *earlier]), np.concatenate([none, *later]), np.sort(at)


def _far(ids: np.ndarray, text: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[Runs]:
    """(start, end, period) on the diagonals of all other lags."""
    totals = Totals(mix(ids.view(U64)))
    stop = bounds[1:][text]
    own = mix(text.astype(U64) + U64(1))
    before = np.concatenate([ids[:1], ids[:-1]])
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    # no word stands before a text; any value will do that no word has
    before[starts] = np.int64(-1)
    places, width = np.arange(len(ids)), NEAR
    while len(places):
        places = places[places + width <= stop[places]]
        if not len(places):
            return
        keys = totals.spans(places, places + width) ^ own[places]
        earlier, later, places = _openings(places, keys, before[places], width)
        lags, length = later - earlier, np.full(len(later), width)
        room = stop[later] - later
        stride = 1 << max(0, int(room.max(initial=1)).bit_length() - 1)
        while stride and len(later):
            grows = np.flatnonzero(length + stride <= room)
            a, b = earlier[grows] + length[grows], later[grows] + length[grows]
            length[grows[totals.spans(a, a + stride) == totals.spans(b, b + stride)]] += stride
            stride >>= 1
        long = length >= np.maximum(least - lags, lags)
        yield earlier[long], later[long] + length[long], lags[long]
        width *= 2


def runs_of(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> Runs:
    """(start, end, smallest period) of all runs, by start, then period. Text t holds the symbols bounds[t] to bounds[t + 1]; runs stay inside a text.

    Symbols are 64-bit integers other than -1.
    """
    if not len(ids):
        return _NONE
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = [*_near(ids, text, least), *_far(ids, text, bounds, least)]
    start, end, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least_lag = np.ones(len(start), dtype=bool)
    least_lag[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least_lag], end[least_lag], period[least_lag]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The planted edit: for a tenth of the ids, which original word stands at each place; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _texts(batch: pa.RecordBatch, edit) -> Iterator[tuple[list, list[list[bytes]], np.ndarray, np.ndarray]]:
    """Ids, words, symbols and bounds of the texts of a part of a batch."""
    for part in slices(batch):
        doc_ids, texts = part.column(0).to_pylist(), []
        for doc_id, text in zip(doc_ids, part.column(1).to_pylist(), strict=True):
            own = (text or "").encode().split()  # on \x20 and \x09-\x0D
            places = edit(doc_id, len(own)) if edit else None
            texts.append(own if places is None else [own[i] for i in places])
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        ids = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=int(bounds[-1]))
        yield doc_ids, texts, ids, bounds  # hash() of bytes is never -1


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, _, ids, bounds in _texts(batch, None):
            start, end, period = runs_of(ids, bounds)
            text = np.searchsorted(bounds, start, "right") - 1
            own = pa.array([doc_ids[t] for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([own, *map(pa.array, (start - bounds[text], end - start, period))], ["doc_id", "start", "length", "period"])


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of words.

    documents: doc_id, text; other columns are ignored. Null and empty texts and texts below ``LEAST`` words have none; repeated rows each
    report their runs; runs of equal extent are one, with the least period; no rows give no rows.
    """
    return _plain(documents).mapInArrow(_run_rows, "doc_id long, start long, length long, period long")


_SUMMARY = [
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64()),
]


def _summaries(edit):
    schema = pa.schema(_SUMMARY)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, texts, ids, bounds in _texts(batch, edit):
                start, end, period = runs_of(ids, bounds)
                # a run's first period stays
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, end, -1)
                dropped = np.cumsum(cover[:-1]) > 0
                first = np.searchsorted(start, bounds)
                rows = []
                for t, words in enumerate(texts):
                    low, at = bounds[t], slice(first[t], first[t + 1])
                    runs = list(zip((start[at] - low).tolist(), (end[at] - start[at]).tolist(), period[at].tolist(), strict=True))
                    gone = dropped[low : bounds[t + 1]] if runs else np.zeros(0, bool)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rows.append((
                        doc_ids[t], len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), int(gone.sum()),
                    ))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _SUMMARY, strict=True)], schema=schema)

    return summarise


def collapse_runs(documents: DataFrame, edit=None) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the words kept, counts of words.

    documents: doc_id, text; other columns are ignored. edit(doc_id, number of words) may give the places of the words to look at instead.
    A null text is empty, texts without runs have null start, length, period and exponent_milli and keep all words, ties go to the
    smallest start, then period; a null doc_id stays null; repeated rows are each reported; no rows give no rows.
    """
    types = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in _SUMMARY)
    return _plain(documents).mapInArrow(_summaries(edit), types)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after the planted edit (a null doc_id has no decimal form and is left as it is)."""
    return collapse_runs(table(spark, sf_dir, "documents"), repeat_tail)
