"""Substring de-duplication over words: every window of ``LENGTH`` words that an earlier document has is removed.

The dealt method, a relative Lempel-Ziv parse, is not built: there are no factors and no reference positions. Documents are cut into
phrases of words between content-defined triggers (see `repeats`); a phrase whose digest an earlier document has is a copy as a whole, and the
windows of other phrases are compared one by one with all windows that share their trigger. Rows are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavetrail.llm import repeats
from wavetrail.llm.batches import U64, Totals, pieces, slices, utf8, word_hashes, words
from wavetrail.llm.registry import query, table

#: Words of a window, and of the gram that is a trigger.
LENGTH, GRAM = 50, 8
#: Bytes of window hashes that are compared together.
BLOCK = 4 << 20


def read(batch: pa.RecordBatch) -> repeats.Phrases:
    data, offsets = utf8(batch.column("text"))
    hashes, counts = [np.zeros(0, U64)], []
    for low, high in pieces(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, row = words(part, offsets[low : high + 1] - offsets[low])
        hashes.append(word_hashes(part, starts, ends))
        counts.append(np.bincount(row, minlength=high - low))
    symbols = np.concatenate(hashes)
    of_row = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)
    found = repeats.parse(lambda a, b: symbols[a:b], of_row, LENGTH, GRAM)
    found.source = symbols, of_row
    return found


def content(batch: pa.RecordBatch, p: repeats.Phrases, chosen: np.ndarray) -> list[bytes]:
    """Hashes of the windows of the chosen blocks."""
    symbols, offsets = p.source
    if len(chosen) == 0:
        return []
    start = offsets[p.row[chosen]]
    grams = Totals(symbols).grams(LENGTH)
    return [grams[a:b].tobytes() for a, b in zip((start + p.low[chosen]).tolist(), (start + p.high[chosen] + 1).tolist(), strict=True)]


def window_numbers(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Block and hash of every window."""
    counts = np.array([len(c) // 8 for c in contents])
    return np.repeat(np.arange(len(contents)), counts), np.frombuffer(b"".join(contents), dtype=np.int64)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        p = read(batch)
        _, offsets = p.source
        removed = repeats.covered(repeats.copied_windows(batch, p, within=False), offsets, LENGTH)
        gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[offsets])
        digests = []
        for text, n, a, b in zip(batch.column("text"), gone.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes split at \x20 and \x09-\x0D
            digests.append(hashlib.sha256(b" ".join(w for w, r in zip(own, removed[a:b].tolist(), strict=True) if not r) if n else b" ".join(own)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(gone), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def remove_copied_words(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each text without the words of windows that a smaller doc_id has, too.

    All windows are judged on the texts as given. documents: doc_id, text; other columns are ignored. Null text has no words; a null doc_id
    comes after all others; rows of one doc_id are documents none of which is earlier; no rows give no rows.
    """
    resolved = repeats.resolve(documents, read, content, window_numbers, within=False, block=BLOCK, step=8, width=8)
    return resolved.mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query("op9_relative_parse")
def op9_relative_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copied_words(table(spark, sf_dir, "documents"))
