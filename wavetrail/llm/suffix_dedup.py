"""Substring de-duplication over bytes by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that overlap, so a phrase's content fixes its triggers. The dictionary holds each
distinct phrase once, with its first place in the corpus; the parse is every text as a sequence of phrases. Repeats are resolved on the
dictionary: the suffixes of phrases that share a trigger are sorted (a suffix array up to the match length, neighbours with a common
prefix of that length form a class), and inside a class the parse gives the corpus order of the places. A phrase that only occurs
once more as a whole needs no sorting at all, which is what makes highly repetitive text cheap. See `repeats` for the passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavetrail.llm import repeats
from wavetrail.llm.batches import SYMBOLS, slices, utf8
from wavetrail.llm.registry import query, table

#: Bytes of a match, and of the gram whose rolling hash is a trigger.
LENGTH, GRAM = 100, 24
#: Bytes of phrases whose suffixes are sorted together.
BLOCK = 1 << 20


def read(batch: pa.RecordBatch) -> repeats.Phrases:
    data, offsets = utf8(batch.column("text"))
    found = repeats.parse(lambda a, b: SYMBOLS[data[a:b]], offsets, LENGTH, GRAM)
    found.source = data, offsets
    return found


def content(batch: pa.RecordBatch, p: repeats.Phrases, chosen: np.ndarray) -> list[bytes]:
    """The bytes of the chosen phrases."""
    data, offsets = p.source
    start = offsets[p.row[chosen]]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip((start + p.low[chosen]).tolist(), (start + p.high[chosen] + LENGTH).tolist(), strict=True)]


def suffix_classes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and class of every suffix of at least LENGTH bytes; classes are numbered in the order of the suffix array."""
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in contents])
    counts = np.array([len(c) - LENGTH + 1 for c in contents])
    of = np.repeat(np.arange(len(contents)), counts)
    first = ends - np.array([len(c) for c in contents])
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    suffixes = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    suffixes = np.ascontiguousarray(suffixes).view(f"S{LENGTH}").ravel()  # all have LENGTH bytes, so padding decides nothing
    order = np.argsort(suffixes, kind="stable")
    ordered = suffixes[order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return of, rank


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        p = read(batch)
        data, offsets = p.source
        removed = repeats.covered(repeats.copied_windows(batch, p, within=True), offsets, LENGTH)
        total = np.concatenate([[0], np.cumsum(removed)])
        before = np.concatenate([[False], removed[:-1]])
        before[offsets[:-1][offsets[:-1] < len(before)]] = False  # runs end with their text
        runs = np.concatenate([[0], np.cumsum(removed & ~before)])
        kept = data[~removed].tobytes()
        ends = (offsets - total[offsets]).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])),
                pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of strings that also start earlier.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id or earlier in the same one; all
    judged on the texts as given. documents: doc_id, text; other columns are ignored. Null text is empty; a null doc_id comes after all
    others; rows of one doc_id are documents none of which is earlier; no rows give no rows.
    """
    resolved = repeats.resolve(documents, read, content, suffix_classes, within=True, block=BLOCK, step=1, width=LENGTH)
    return resolved.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
