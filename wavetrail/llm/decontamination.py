"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, units after numbers, and names become typed placeholders, other words are lowered. Windows of
``WIDTH`` canonical tokens are hashed and joined with the benchmark's windows, so a question is found again after its numbers and names
were changed. What filled the placeholders is kept as slots: along one alignment (the same distance between positions) a value of
the benchmark must always become the same value of the document, else the windows are a coincidence.

Beside them go windows of the plain lowered tokens, values included. They do not depend on what counts as a name in the text around,
nor on how many placeholders a window has, so every verbatim copy is found. A window of the item is held if either kind matches.

The benchmark's window hashes are the stated query set. They filter the documents' windows inside the scan, in blocks of at most
``FILTER_HASHES`` (a pass over the documents each), so only windows that match are shuffled.

A document that holds a share of an item's windows holds one of any n - share * n + 1 of them. So documents and items first meet on those
windows of the item alone that the fewest documents have; all windows are compared only for the pairs found that way. A prompt that
many items and documents share makes no pairs unless it is that large a part of the item. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.batches import LOWER, SYMBOLS, U64, Totals, mix, pieces, slices, utf8
from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise

#: Tokens of a window (a shorter item is one window) and how many of them may be placeholders.
WIDTH, PLACEHOLDERS = 8, 3
#: Share of an item's windows that a document must hold.
LEAST_SHARE = 0.5
#: Hashes that one pass over the documents looks for (8 bytes each).
FILTER_HASHES = 1 << 21
UNITS = [
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "hrs", "ms", "mph", "kmh", "kb", "mb", "gb", "tb", "v", "w", "kw", "mw", "hz", "khz", "mhz", "ghz",
    "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "gram", "grams", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents",
    "degree", "degrees",
]
NUMBER, UNIT, NAME = 1, 2, 3

_LETTER, _DIGIT = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x80:] = _CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_JOINS = np.zeros(256, dtype=bool)
_JOINS[[0x2C, 0x2E]] = True  # comma and point between digits belong to the number
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = True  # a capital after these is no name
_UNIT_HASHES = np.sort([Totals(SYMBOLS[np.frombuffer(u.encode(), np.uint8)]).spans(np.array([0]), np.array([len(u)]))[0] for u in UNITS])
_PLAIN = U64(0x6A09E667F3BCC909)
_MARKS = mix(np.arange(1, 4, dtype=U64) * U64(0xF1357AEA2E62A9C5))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row, lowered value hash and byte class of every plain token."""
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, none, none.astype(U64), none
    kind = _CLASS[data]
    digit = kind == _DIGIT
    joint = np.flatnonzero(_JOINS[data[1:-1]] & digit[:-2] & digit[2:]) + 1
    kind[joint] = _DIGIT
    change = np.ones(len(data) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, Totals(SYMBOLS[LOWER[data]]).spans(starts, ends), kind[starts]


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, canonical hash, slot type (0: a literal word), value hash and place among the row's plain tokens of every token."""
    starts, ends, rows, value, kind = split(data, offsets)
    if len(starts) == 0:
        return rows, value, rows, value, rows
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    slot = np.where(kind == _DIGIT, NUMBER, 0)

    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    sentence = np.concatenate([[0], np.cumsum(_ENDS[data])])
    opens = np.ones(len(starts), dtype=bool)  # first token of a row or sentence
    opens[1:] = (rows[1:] != rows[:-1]) | (sentence[starts[1:]] != sentence[ends[:-1]])
    name = capital & ~opens
    # a capital that opens a sentence is a name if the text has it as a name elsewhere
    known = np.unique(mix(value[name] + rows[name].astype(U64)))
    opening = np.flatnonzero(capital & opens)
    if len(known):
        key = mix(value[opening] + rows[opening].astype(U64))
        name[opening] = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    slot[name] = NAME
    after_number = np.zeros(len(starts), dtype=bool)
    after_number[1:] = (slot[:-1] == NUMBER) & (rows[1:] == rows[:-1])
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    slot[after_number & (slot == 0) & (_UNIT_HASHES[at] == value)] = UNIT

    # neighbouring names are one name: its value is that of its words in order
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = (slot[1:] == NAME) & (slot[:-1] == NAME) & ~opens[1:]
    if joined.any():
        heads = np.flatnonzero(~joined)
        value = Totals(value).spans(heads, np.append(heads[1:], len(value)))
        # every value is hashed once more, so single and joined ones are made alike
        rows, slot, place = rows[heads], slot[heads], place[heads]
    else:
        value = Totals(value).spans(np.arange(len(value)), np.arange(1, len(value) + 1))
    return rows, np.where(slot > 0, _MARKS[np.maximum(slot, 1) - 1], value), slot, value, place


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position, hash, token index, begin, end) of windows with enough literal words; arrays of one piece, with its slots and values.

    A template window stands for the plain windows of its span, those that start in [begin, end).
    """
    for low, high in pieces(offsets):
        data_part, offsets_part = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        rows, tokens, slot, value, place = canonical(data_part, offsets_part)
        if len(tokens) < width:
            continue
        grams = Totals(tokens).grams(width)
        filled = np.concatenate([[0], np.cumsum(slot > 0)])
        usable = (rows[: len(grams)] == rows[width - 1 :]) & (filled[width:] - filled[:-width] <= min(PLACEHOLDERS, width - 1))
        at = np.flatnonzero(usable)
        first = np.searchsorted(rows, np.arange(high - low))
        after = np.minimum(at + width, len(rows) - 1)
        plain = np.bincount(split(data_part, offsets_part)[2], minlength=high - low)
        stop = np.where((at + width < len(rows)) & (rows[after] == rows[at]), place[after], plain[rows[at]])
        yield rows[at] + low, at - first[rows[at]], grams[at], at, place[at], np.maximum(place[at] + 1, stop - WIDTH + 1), slot, value


def plain_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position, hash) of every window of plain tokens; arrays of one piece."""
    for low, high in pieces(offsets):
        _, _, rows, value, _ = split(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        if len(rows) < width:
            continue
        grams = mix(Totals(value).grams(width) ^ _PLAIN)
        at = np.flatnonzero(rows[: len(grams)] == rows[width - 1 :])
        first = np.searchsorted(rows, np.arange(high - low))
        yield rows[at] + low, at - first[rows[at]], grams[at]


_ROW = "row_id long, row_key long, position int, window long, width int, plain boolean, begins int, ends int, slots array<long>"


def _emit(batch: pa.RecordBatch, width: int, keep) -> Iterator[pa.RecordBatch]:
    data, offsets = utf8(batch.column(2))
    ids, keys = batch.column(0), batch.column(1)

    def made(row: np.ndarray, position: np.ndarray, gram: np.ndarray, plain: bool, begins: np.ndarray, ends: np.ndarray, slots: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row)), keys.take(pa.array(row)), pa.array(position, pa.int32()), pa.array(gram.view(np.int64)), pa.array(np.full(len(row), width), pa.int32()),
                pa.array(np.full(len(row), plain)), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(slots, pa.list_(pa.int64())),
            ],
            names=["row_id", "row_key", "position", "window", "width", "plain", "begins", "ends", "slots"],
        )

    for row, position, gram, at, begins, ends, slot, value in windows(data, offsets, width):
        chosen = keep(gram)
        # the window's slots as values whose last two bits are the type
        typed = ((value >> U64(2) << U64(2)) | slot.astype(U64)).view(np.int64)
        slots = [typed[i : i + width][slot[i : i + width] > 0] for i in at[chosen].tolist()]
        yield made(row[chosen], position[chosen], gram[chosen], False, begins[chosen], ends[chosen], slots)
    for row, position, gram in plain_windows(data, offsets, width):
        chosen = keep(gram)
        row, position, gram = row[chosen], position[chosen], gram[chosen]
        yield made(row, position, gram, True, position, position + 1, [[]] * len(row))


def template_windows(texts: DataFrame, widths: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """Template and plain windows of (row_id, row_key, text), all or those whose hash is in the sorted array `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(gram: np.ndarray) -> np.ndarray:
            if wanted is None:
                return np.arange(len(gram))
            place = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
            return np.flatnonzero(wanted[place] == gram)

        for batch in (part for whole in batches for part in slices(whole)):
            for width in widths:
                yield from _emit(batch, width, keep)

    return texts.mapInArrow(run, _ROW)


def token_counts(texts: DataFrame) -> DataFrame:
    """(row_id, row_key, tokens, plain_tokens): canonical and plain tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            data, offsets = utf8(batch.column(2))
            counts, none = [], [np.zeros(0, np.int64)]
            for how in (lambda *text: canonical(*text)[0], lambda *text: split(*text)[2]):
                rows = [np.bincount(how(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), minlength=b - a) for a, b in pieces(offsets)]
                counts.append(pa.array(np.concatenate(none + rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["row_id", "row_key", "tokens", "plain_tokens"])

    return texts.mapInArrow(run, "row_id long, row_key long, tokens long, plain_tokens long")


def _texts(frame: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return frame.select(F.col(key).cast("long").alias("row_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose keys may be null on both sides."""
    renamed = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"r_{c}" for c in keys])


_ITEM, _DOCUMENT, _WINDOW = ["item_id", "item_key"], ["row_id", "row_key"], ["window", "width", "plain"]


def _prefix(units: DataFrame, order: list[str], needed: Column) -> DataFrame:
    """Of an item's n units the first n - needed + 1: whoever holds `needed` of them holds one of these."""
    item = Window.partitionBy(*_ITEM)
    ranked = units.withColumn("_rank", F.row_number().over(item.orderBy(*order))).withColumn("_units", F.count(F.lit(1)).over(item))
    return ranked.filter(F.col("_rank") <= F.col("_units") - F.greatest(needed, F.lit(1)) + 1).drop("_rank", "_units")


def candidate_pairs(found: DataFrame, own: DataFrame, sizes: DataFrame, least_share: float) -> DataFrame:
    """Pairs of document and item that may reach the share in template or plain windows: those that meet on a rare part of the item.

    Windows are ordered by the number of places that documents have them at. A plain window is met by itself or by a template window that
    stands for it, so it is as frequent as all of these together.
    """
    places = found.groupBy(*_WINDOW).agg(F.count(F.lit(1)).alias("places"))
    weighed = own.drop("item_slots").join(places, _WINDOW, "left").fillna(0, ["places"])
    weighed = _on(weighed, sizes, _ITEM)

    def needed(windows: str) -> Column:
        return F.ceil(F.col(windows) * least_share - 1e-9)

    templates = _prefix(weighed.filter("NOT plain"), ["places", "item_position"], needed("item_windows")).select(*_ITEM, *_WINDOW)
    start = F.explode(F.when(F.col("plain"), F.array("item_position")).otherwise(F.sequence(F.col("item_begins"), F.col("item_ends") - 1)))
    met = weighed.select(*_ITEM, *_WINDOW, "places", "item_plain_windows", start.alias("start"))
    # one row for each start of a plain window, at most WIDTH + 1 windows stand for it
    starts = met.groupBy(*_ITEM, "start").agg(F.sum("places").alias("places"), F.max("item_plain_windows").alias("plain_windows"), F.collect_set(F.struct(*_WINDOW)).alias("windows"))
    plain = _prefix(starts, ["places", "start"], needed("plain_windows")).select(*_ITEM, F.inline("windows"))
    met = templates.unionByName(plain).distinct()
    return found.select(*_DOCUMENT, *_WINDOW).join(met, _WINDOW).select(*_DOCUMENT, *_ITEM).distinct()


def find_leaks(documents: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, row_key, item_id, n_windows, share, changed_slots, exact) of documents that hold the template of a benchmark item.

    Only template windows count; see `find_held`, which finds verbatim copies too.
    """
    out = find_held(documents, benchmark, least_share).filter(F.col("share") >= least_share)
    return out.drop("n_held", "held_share")


def find_held(documents: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, row_key, item_id, n_windows, share, changed_slots, exact, n_held, held_share) of documents that hold a benchmark item or its template.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored. share: the item's template windows found along
    consistent alignments (0 where it has none). exact: no slot differs. held_share: the item's plain windows (a shorter item is one) that
    are found as they are or by a template. Either share makes a hit. Null and empty texts and those without tokens match nothing; items of
    placeholders alone are found verbatim only; rows of one doc_id and text are one document, items of one item_id and text one item; no
    rows on either side give no rows.
    """
    spark = documents.sparkSession
    items = _texts(benchmark, "item_id").distinct()
    counts = token_counts(items)
    lengths = counts.select(F.explode(F.array(F.least("tokens", F.lit(WIDTH)), F.least("plain_tokens", F.lit(WIDTH)))).alias("width")).distinct()
    widths = sorted(r.width for r in lengths.collect() if r.width)  # at most WIDTH
    # an item shorter than a window is one window of its own length
    own = template_windows(items, widths).join(counts.withColumnRenamed("row_id", "i").withColumnRenamed("row_key", "k"), (F.col("row_id").eqNullSafe(F.col("i"))) & (F.col("row_key") == F.col("k")))
    own = own.filter(F.col("width") == F.least(F.lit(WIDTH), F.when(F.col("plain"), F.col("plain_tokens")).otherwise(F.col("tokens"))))
    own = own.select(
        F.col("row_id").alias("item_id"), F.col("row_key").alias("item_key"), F.col("position").alias("item_position"), "window", "width", "plain",
        F.col("begins").alias("item_begins"), F.col("ends").alias("item_ends"), F.col("slots").alias("item_slots"),
    )
    own = materialise(own, "benchmark-own")
    sizes = own.groupBy(*_ITEM).agg(F.count_if(~F.col("plain")).alias("item_windows"), F.count_if("plain").alias("item_plain_windows"))
    texts = _texts(documents, "doc_id")
    found, after = None, None
    hashes = own.select("window").distinct()
    while True:  # the query set in blocks, in ascending order
        block = hashes if after is None else hashes.filter(F.col("window") > after)
        rows = [r["window"] for r in block.orderBy("window").limit(FILTER_HASHES).collect()]
        if rows:
            wanted = np.sort(np.array(rows, dtype=np.int64).view(U64))
            part = template_windows(texts, widths, wanted)
            found = part if found is None else found.unionByName(part)
            after = rows[-1]
        if len(rows) < FILTER_HASHES:
            break
    if found is None:
        found = spark.createDataFrame([], _ROW)
    found = materialise(found, "benchmark-windows")  # few rows, used for places and for slots
    pairs = materialise(candidate_pairs(found, own, sizes, least_share), "benchmark-pairs")
    every = _on(_on(pairs, own, _ITEM), found.drop("begins", "ends"), [*_DOCUMENT, *_WINDOW])
    matched = every.filter("NOT plain").withColumn("shift", F.col("position") - F.col("item_position"))
    pair = [*_DOCUMENT, *_ITEM]
    slots = matched.select(*pair, "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("slot"))
    slots = slots.select(*pair, "shift", F.col("slot.item_slots").alias("old"), F.col("slot.slots").alias("new")).distinct()
    by_value = slots.groupBy(*pair, "shift", "old").agg(F.count("*").alias("values"), F.max((F.col("old") != F.col("new")).cast("int")).alias("changed"))
    alignments = by_value.groupBy(*pair, "shift").agg((F.max("values") == 1).alias("consistent"), F.sum("changed").alias("changed"))
    places = matched.select(*pair, "shift", "item_position", "item_begins", "item_ends").distinct()
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}")) for c in pair] + [F.col("p.shift") == F.col("a.shift")]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    kept = places.alias("p").join(alignments.alias("a"), condition, "left").select("p.*", F.coalesce("a.consistent", F.lit(True)).alias("consistent"), F.coalesce("a.changed", F.lit(0)).alias("changed"))
    kept = kept.filter("consistent")
    per_shift = kept.groupBy(*pair, "shift").agg(F.max("changed").alias("changed"))
    changed = per_shift.groupBy(*pair).agg(F.sum("changed").alias("changed_slots"))
    hits = kept.groupBy(*pair).agg(F.count_distinct("item_position").alias("n_windows"))
    # the plain windows held by either kind
    by_template = kept.select(*pair, F.explode(F.sequence(F.col("item_begins"), F.col("item_ends") - 1)).alias("start"))
    starts = by_template.unionByName(every.filter("plain").select(*pair, F.col("item_begins").alias("start")))
    held = starts.groupBy(*pair).agg(F.count_distinct("start").alias("n_held"))

    out = _on(_on(_on(held, hits, pair, "left"), changed, pair, "left"), sizes, _ITEM)
    out = out.select(
        F.col("row_id").alias("doc_id"), "row_key", "item_id", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce(F.try_divide("n_windows", "item_windows"), F.lit(0.0)).alias("share"), F.coalesce("changed_slots", F.lit(0)).cast("long").alias("changed_slots"),
        F.col("n_held").cast("long").alias("n_held"), (F.col("n_held") / F.col("item_plain_windows")).alias("held_share"),
    )
    out = out.filter((F.col("share") >= least_share) | (F.col("held_share") >= least_share))
    return out.withColumn("exact", F.col("changed_slots") == 0)


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_held(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
