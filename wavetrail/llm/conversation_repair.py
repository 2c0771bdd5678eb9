"""Least-cost repair of conversations whose turns were lost, emptied, cut, doubled or given the wrong role.

A repair walks through the turns and keeps, re-roles or deletes each, and inserts empty turns, so that the roles read
``(s?(ua)+)?``. The state is the last role written (none, system, user, assistant): a Viterbi search over four states. It runs in parallel
inside one conversation, by rank convergence:

1. Rows are sorted over all tasks and cut into chunks of at most ``CHUNK`` rows; a conversation of any length is as many chunks.
2. Every chunk walks backward from a speculative vector of costs to the end (the last chunk from the true one).
3. Fix-up passes: a chunk whose right neighbour now offers a vector that differs from the one it used by more than a constant walks
   again, and stops where its new costs run parallel to its old ones. Passes go on until no chunk has to.
   Some conversations never converge (all turns of one role keep a memory of odd and even). After ``FIXUPS`` passes the chunks of those
   few become 4 x 4 cost matrices, which are folded from the end, one small row a chunk.
4. With its true vector (up to a constant, which no choice depends on) each chunk knows the least edit for every row and state. Its map from
   the state at its start to that at its end is folded along the conversation; then each chunk writes down its edits.

Only one byte a row takes part in this. Texts move twice: once to be sorted, once to be joined with their edits, in order, conversation by
conversation; that pass streams and holds one row at a time. A conversation's output (audit, digest) is one row by contract, so the last
pass gives one conversation to one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise

#: Rows of a chunk, a power of two.
CHUNK = 4096
#: Passes of speculative vectors before what has not converged is folded.
FIXUPS = 3
#: Characters of a text that take part in cutting the sort into tasks; inside a task whole texts are compared.
CUT_CHARS = 64

START, SYSTEM, USER, ASSISTANT = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
_NEVER = 1 << 20
#: State after an inserted or re-roled turn, and the costs to the end from each state behind the last turn.
_TURNED = np.array([USER, USER, ASSISTANT, USER])
_END = np.array([0, 6, 3, 0], dtype=np.int32)
_SOUND, _BLANK, _DUPLICATE, _CUT = range(4)
_EDITS = ("D", "IK", "IR", "K", "R")

# a row's code: 4 * initial (s, u, a, other) + fault; tables by code and state
_KEPT = np.full((16, 4), -1)
for _fault in range(4):
    _KEPT[_fault, START] = SYSTEM
    _KEPT[4 + _fault, [START, SYSTEM, ASSISTANT]] = USER
    _KEPT[8 + _fault, USER] = ASSISTANT
_FORCED = np.array([code % 4 in (_BLANK, _DUPLICATE) for code in range(16)])
_EXTRA = np.array([TRUNCATED * (code % 4 == _CUT) for code in range(16)], dtype=np.int32)
_KEEP_COST = np.where((_KEPT < 0) | _FORCED[:, None], _NEVER, _EXTRA[:, None]).astype(np.int32)
_REROLE_COST = np.where(_FORCED, _NEVER, REROLE + _EXTRA).astype(np.int32)
_KEPT = np.maximum(_KEPT, 0)


def _options(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to the end by deleting, keeping, re-roling each row, from each state; after: costs behind the row."""
    keep = _KEEP_COST[codes] + np.take_along_axis(after, _KEPT[codes], 1)
    return DELETE + after, keep, _REROLE_COST[codes][:, None] + after[:, _TURNED]


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[:, _TURNED])
    return costs


class Chunks:
    """Code strings of several chunks, all walked in step."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes.astype(np.int64), bounds
        self.lengths = np.diff(bounds)
        self.order = np.argsort(-self.lengths, kind="stable")
        self.places = bounds[:-1] + np.arange(len(self.lengths))  # one more place a chunk, behind its last row

    def _longer(self, step: int) -> np.ndarray:
        return self.order[: np.searchsorted(-self.lengths[self.order], -step, "left")]

    def backward(self, right: np.ndarray) -> np.ndarray:
        """Costs to the end at every place, from each state."""
        costs = np.empty((len(self.codes) + len(self.lengths), 4), dtype=np.int32)
        costs[self.places + self.lengths] = right
        for step in range(int(self.lengths.max(initial=0))):
            own = self._longer(step)
            at = self.lengths[own] - 1 - step
            place = self.places[own] + at
            options = _options(self.codes[self.bounds[own] + at], costs[place + 1])
            costs[place] = _with_inserts(np.minimum.reduce(options))
        return costs

    def left(self, right: np.ndarray) -> np.ndarray:
        return self.backward(right)[self.places]

    def refit(self, right: np.ndarray, old_right: np.ndarray, old_left: np.ndarray) -> np.ndarray:
        """Costs at the chunks' starts, up to a constant, walked from `right` no farther than to where they run parallel to those from `old_right`."""
        new, old = right.astype(np.int32).copy(), old_right.astype(np.int32).copy()
        left = np.empty_like(new)
        walking = np.ones(len(new), dtype=bool)
        for step in range(int(self.lengths.max(initial=0)) + 1):
            own = np.flatnonzero(walking)
            ended = own[self.lengths[own] <= step]
            left[ended], walking[ended] = new[ended], False
            gap = new[own] - old[own]
            parallel = own[(gap == gap[:, :1]).all(1) & (self.lengths[own] > step)]
            left[parallel], walking[parallel] = old_left[parallel], False
            own = np.flatnonzero(walking)
            if not len(own):
                break
            codes = self.codes[self.bounds[own] + self.lengths[own] - 1 - step]
            new[own] = _with_inserts(np.minimum.reduce(_options(codes, new[own])))
            old[own] = _with_inserts(np.minimum.reduce(_options(codes, old[own])))
        return left

    def choices(self, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edit of least name among the cheapest ones, and the state after it, for every row and state."""
        costs = self.backward(right)
        rows = np.arange(len(self.codes)) + np.repeat(np.arange(len(self.lengths)), self.lengths)
        now = costs[rows]
        delete, keep, rerole = _options(self.codes, costs[rows + 1])
        kept, states = _KEPT[self.codes], np.broadcast_to(np.arange(4), now.shape)
        keeps = keep == now
        inserted_keeps = keeps[:, _TURNED]
        cases = [delete == now, INSERT + now[:, _TURNED] == now, keeps]
        edit = np.select(cases, [0, np.where(inserted_keeps, 1, 2), 3], 4)
        turned = np.broadcast_to(_TURNED, now.shape)
        state = np.select([edit == 0, edit == 1, edit == 2, edit == 3], [states, kept[:, _TURNED], _TURNED[turned], kept], turned)
        return edit.astype(np.int8), state.astype(np.int8)

    def follow(self, edit: np.ndarray, state: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits of all rows on the way from the entry states, and the exit states."""
        at, taken = entry.astype(np.int64).copy(), np.empty(len(self.codes), dtype=np.int8)
        for step in range(int(self.lengths.max(initial=0))):
            own = self._longer(step)
            row = self.bounds[own] + step
            taken[row] = edit[row, at[own]]
            at[own] = state[row, at[own]]
        return taken, at


# --- tables of chunks ---------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def _vectors(column: pa.Array) -> np.ndarray:
    return _lists(column)[0].reshape(-1, 4)


def _nested(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.reshape(-1).astype(np.int32)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right = _vectors(batch.column("right"))
        left = Chunks(*_lists(batch.column("codes"))).left(right)
        yield _passed(batch, right, left)


def _walk_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offered = _vectors(batch.column("offered"))
        left = Chunks(*_lists(batch.column("codes"))).refit(offered, _vectors(batch.column("right")), _vectors(batch.column("left")))
        yield _passed(batch, offered, left)


def _passed(batch: pa.RecordBatch, right: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    left = left - left.min(1, keepdims=True)
    keys = [batch.column(n) for n in ("conv", "chunk", "next")]
    return pa.RecordBatch.from_arrays([*keys, _nested(right), _nested(left)], ["conv", "chunk", "next", "right", "left"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk's costs from each state (rows) to each state behind it (columns)."""
    for batch in batches:
        chunks = Chunks(*_lists(batch.column("codes")))
        n = batch.num_rows
        columns = [chunks.left(np.tile(np.where(np.arange(4) == k, 0, _NEVER).astype(np.int32), (n, 1))) for k in range(4)]
        matrix = np.stack(columns, 2).reshape(n, 16)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "next")), _nested(matrix)], ["conv", "chunk", "next", "matrix"])


def _fold_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole conversations, last chunk first: the costs behind each chunk."""
    conv, vector = None, _END
    for batch in batches:
        out = []
        for own, matrix in zip(batch.column("conv").to_pylist(), _lists(batch.column("matrix"))[0].reshape(-1, 4, 4), strict=True):
            if own != conv:
                conv, vector = own, _END
            out.append(vector)
            vector = (matrix + vector).min(1)
            vector = vector - vector.min()
        right = np.array(out, dtype=np.int32).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "next")), _nested(right)], ["conv", "chunk", "next", "right"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exit state of each chunk for every entry state."""
    for batch in batches:
        chunks = Chunks(*_lists(batch.column("codes")))
        edit, state = chunks.choices(_vectors(batch.column("right")))
        exits = np.stack([chunks.follow(edit, state, np.full(batch.num_rows, s))[1] for s in range(4)], 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "right")), _nested(exits)], ["conv", "chunk", "right", "exits"])


def _fold_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole conversations, in order: the state at each chunk's start."""
    conv, state = None, START
    for batch in batches:
        out = []
        for own, exits in zip(batch.column("conv").to_pylist(), _vectors(batch.column("exits")), strict=True):
            if own != conv:
                conv, state = own, START
            out.append(state)
            state = int(exits[state])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "right")), pa.array(out, pa.int32())], ["conv", "chunk", "right", "entry"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's codes and edits, as bytes."""
    for batch in batches:
        codes, bounds = _lists(batch.column("codes"))
        chunks = Chunks(codes, bounds)
        edit, state = chunks.choices(_vectors(batch.column("right")))
        taken, _ = chunks.follow(edit, state, batch.column("entry").to_numpy())
        cut = [pa.array([a[i:j].astype(np.int8).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()) for a in (codes, taken)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), *cut], ["conv", "place", "codes", "edits"])


_KEY = "conv string, chunk long"


def _along(df: DataFrame, *order: Column) -> DataFrame:
    """Small rows of whole conversations in order; one conversation is one task's, one row a chunk."""
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _parallel(a: str, b: str) -> Column:
    return F.size(F.array_distinct(F.zip_with(a, b, lambda x, y: x - y))) == 1


def _settled(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, right, entry) of all chunks of conversations that have more than one: true costs behind them and state before them."""
    end = F.array(*[F.lit(int(x)) for x in _END])
    guess = F.array(*[F.lit(0)] * 4)
    walked = f"{_KEY}, next long, right array<int>, left array<int>"
    vectors = materialise(chunks.withColumn("right", F.when(F.col("next").isNull(), end).otherwise(guess)).select("conv", "chunk", "next", "right", "codes").mapInArrow(_walk, walked), "repair-vectors")
    settled = None
    for step in range(FIXUPS):
        ahead = vectors.select("conv", F.col("chunk").alias("next"), F.col("left").alias("offered"))
        offers = vectors.join(ahead, ["conv", "next"], "left").withColumn("open", F.col("next").isNotNull() & ~F.coalesce(_parallel("right", "offered"), F.lit(True)))
        offers = materialise(offers, f"repair-offers-{step}")
        if offers.filter("open").isEmpty():
            settled = vectors.select("conv", "chunk", "right")
            break
        again = offers.filter("open").join(chunks.select("conv", "chunk", "codes"), ["conv", "chunk"])
        again = again.select("conv", "chunk", "next", "right", "left", "offered", "codes").mapInArrow(_walk_again, walked)
        vectors = materialise(offers.filter("NOT open").select("conv", "chunk", "next", "right", "left").unionByName(again), f"repair-vectors-{step}")
    if settled is None:
        ahead = vectors.select("conv", F.col("chunk").alias("next"), F.col("left").alias("offered"))
        late = vectors.join(ahead, ["conv", "next"]).filter(~_parallel("right", "offered")).select("conv").distinct()
        late = materialise(late, "repair-late")
        matrices = chunks.join(late, "conv").select("conv", "chunk", "next", "codes").mapInArrow(_matrices, f"{_KEY}, next long, matrix array<int>")
        folded = _along(matrices, F.col("chunk").desc()).mapInArrow(_fold_vectors, f"{_KEY}, next long, right array<int>")
        settled = vectors.join(late, "conv", "left_anti").select("conv", "chunk", "right").unionByName(folded.select("conv", "chunk", "right"))
    maps = settled.join(chunks.select("conv", "chunk", "codes"), ["conv", "chunk"]).select("conv", "chunk", "right", "codes")
    maps = maps.mapInArrow(_maps, f"{_KEY}, right array<int>, exits array<int>")
    return _along(maps, F.col("chunk")).mapInArrow(_fold_states, f"{_KEY}, right array<int>, entry int")


# --- rows ---------------------------------------------------------------------

_BLANKS = "\\x20\\x09-\\x0D"
_PLAIN = ["conv_id", "turn", "role", "text"]


def damage(messages: DataFrame) -> DataFrame:
    """The planted faults: by the CRC-32 of `conv_id:turn` a row is dropped, emptied, stripped of its stops, doubled or made the user's.

    Null roles and texts, and null ids in the key, are one space.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind")
    ).filter("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _chunks(ordered: DataFrame) -> DataFrame:
    """(conv, chunk, next, several, place, codes) of every chunk; codes: one per row, in order."""
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))
    blank = ~F.rlike("text", F.lit(f"[^{_BLANKS}]"))
    cut = ~F.rlike("text", F.lit(f"[.!?][{_BLANKS}]*\\z"))
    initial = F.substring("role", 1, 1)
    rows = ordered.select(
        "conv", "place", digest.alias("digest"), F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12).alias("initial"),
        blank.alias("blank"), cut.alias("cut"),
    )
    first = rows.groupBy("conv", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), _BLANK).when(F.col("first").isNull(), _DUPLICATE).when(F.col("cut"), _CUT).otherwise(_SOUND)
    coded = rows.hint("merge").join(first, "place", "left").select("conv", "place", (F.col("initial") + fault).cast("tinyint").alias("code"))
    chunk = F.shiftright("place", CHUNK.bit_length() - 1)
    listed = F.array_sort(F.collect_list(F.struct("place", "code")))  # at most CHUNK
    grouped = coded.groupBy("conv", chunk.alias("chunk")).agg(F.min("place").alias("place"), listed.alias("rows"))
    chunks = materialise(grouped.select("conv", "chunk", "place", F.col("rows.code").alias("codes")), "repair-chunks")
    along = Window.partitionBy("conv").orderBy("chunk")
    keys = chunks.select("conv", "chunk")
    links = keys.select("conv", "chunk", F.lead("chunk").over(along).alias("next"), F.lag("chunk").over(along).alias("before"))
    several = materialise(links.filter("next IS NOT NULL OR before IS NOT NULL").drop("before"), "repair-links")
    return chunks.join(several.withColumn("several", F.lit(True)), ["conv", "chunk"], "left")


class _Writing:
    """One conversation as its rows go by, in order."""

    def __init__(self, conv: str):
        self.conv = conv
        self.digest, self.empty = hashlib.sha256(), True
        self.audit: list[str] = []
        self.state, self.cost = START, 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.turns, self.least, self.last = 0, None, None
        self.codes = self.edits = b""
        self.at = 0

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def turn_to(self) -> str:
        self.state = int(_TURNED[self.state])
        return "user" if self.state == USER else "assistant"

    def insert(self) -> None:
        self.cost += INSERT
        self.write(self.turn_to(), "")

    def add(self, turn: int | None, role: str, text: str) -> None:
        code, edit = self.codes[self.at], _EDITS[self.edits[self.at]]
        self.at += 1
        self.faults[code % 4] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        self.audit.append(edit)
        if edit == "D":
            self.cost += DELETE
            return
        if edit[0] == "I":
            self.insert()
        self.cost += int(_EXTRA[code])
        if edit[-1] == "K":
            self.state = int(_KEPT[code, self.state])
        else:
            self.cost += REROLE
            role = self.turn_to()
        self.write(role, text)

    def close(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
            self.audit.append("I")
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        conv = int(self.conv) if self.conv else None
        return (conv, gaps, self.faults[_BLANK], self.faults[_DUPLICATE], self.faults[_CUT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, chunks of edits and rows of whole conversations, in order."""
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _OUT])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    current = None
    for batch in batches:
        done = []
        columns = (batch.column(n).to_pylist() for n in ("conv", "kind", "turn", "role", "text", "codes", "edits"))
        for conv, kind, turn, role, text, codes, edits in zip(*columns, strict=True):
            if current is None or conv != current.conv:
                if current is not None:
                    done.append(current.close())
                current = _Writing(conv)
            if kind == 1:
                current.codes, current.edits, current.at = codes, edits, 0
            elif kind == 2:
                current.add(turn, role, text)
        if done:
            yield batch_of(done)
    if current is not None:
        yield batch_of([current.close()])


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps and faults of its rows, cost and audit of the cheapest repair, digest of the repaired conversation.

    rows: conv_id, turn, role, text; other columns are ignored. conversations: more conv_ids to report, with or without rows. Rows are
    taken by turn, null first; ties by role, then text. Null role and text are one space; a null conv_id is a conversation of its own; of
    rows equal in role and text all but the first are duplicates. A conversation without rows has zeros, an empty audit and the digest of
    the empty string; no rows and no ids give no rows.
    """
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role"), part("text"))
    dealt = plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, CUT_CHARS)).sortWithinPartitions(*_PLAIN)
    ordered = materialise(dealt.select(conv.alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "repair-rows")
    chunks = materialise(_chunks(ordered), "repair-linked")
    end = F.array(*[F.lit(int(x)) for x in _END])
    settled = _settled(chunks.filter("several"))
    solved = chunks.filter("several IS NULL").select("conv", "place", "codes", end.alias("right"), F.lit(START).alias("entry")).unionByName(
        chunks.filter("several").join(settled, ["conv", "chunk"]).select("conv", "place", "codes", "right", "entry")
    )
    edits = solved.mapInArrow(_trace, "conv string, place long, codes binary, edits binary")
    null = lambda kind: F.lit(None).cast(kind)
    ids = rows.select("conv_id") if conversations is None else rows.select("conv_id").unionByName(conversations.select("conv_id"))
    names = ids.select(conv.alias("conv")).distinct()
    whole = (
        names.select("conv", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("binary").alias("codes"), null("binary").alias("edits"))
        .unionByName(edits.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(ordered.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    )
    types = ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in _OUT)
    return whole.repartition("conv").sortWithinPartitions("conv", "place", "kind").mapInArrow(_write, types)


_SQL = """
WITH RECURSIVE tab AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS crc
), m AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
    FROM conversations, tab
), r AS MATERIALIZED (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM m, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE kind > 0
), o AS MATERIALIZED (
    SELECT *, row_number() OVER w AS n, lag(role[1:1]) OVER w || role[1:1] AS pair
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM o)
), turned AS (
    SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) t(s, t, role)
), pre AS (
    SELECT s, s AS t, '' AS audit, 0 AS cost, []::VARCHAR[] AS wrote FROM turned
    UNION ALL SELECT s, t, 'I', 3, [role || ':'] FROM turned
    UNION ALL SELECT a.s, b.t, 'II', 6, [a.role || ':', b.role || ':'] FROM turned a JOIN turned b ON b.s = a.t
), kept AS (
    SELECT * FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) k(initial, s, t)
), walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, {'c': 0::BIGINT, 'a': '', 'w': []::VARCHAR[]} AS best FROM f
    UNION ALL
    SELECT conv_id, n, state, min(best) FROM (
        SELECT f.conv_id, f.n, e.t AS state,
            {'c': w.best.c + p.cost + e.cost + CASE WHEN f.fault = 3 AND e.edit <> 'D' THEN 3 ELSE 0 END, 'a': w.best.a || p.audit || e.edit,
             'w': CASE WHEN e.edit = 'D' THEN list_concat(w.best.w, p.wrote) ELSE list_append(list_concat(w.best.w, p.wrote), coalesce(e.role, f.role) || ':' || f.text) END} AS best
        FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN pre p ON p.s = w.state
        JOIN (SELECT s, s AS t, 'D' AS edit, 4 AS cost, NULL AS role, NULL AS initial FROM turned UNION ALL SELECT s, t, 'R', 3, role, NULL FROM turned
              UNION ALL SELECT s, t, 'K', 0, NULL, initial FROM kept) e
            ON e.s = p.t AND (e.edit = 'D' OR f.fault NOT IN (1, 2)) AND (e.initial IS NULL OR e.initial = f.role[1:1])
    ) GROUP BY conv_id, n, state
), done AS (
    SELECT conv_id, min({'c': best.c + p.cost, 'a': best.a || p.audit, 'w': list_concat(best.w, p.wrote)}) AS best
    FROM walk JOIN (SELECT conv_id AS c, max(n) AS last FROM f GROUP BY 1) ON c IS NOT DISTINCT FROM conv_id AND n = last JOIN pre p ON p.s = state
    WHERE p.t IN (0, 3) GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.w, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op11_conversation_repair", _SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the planted damage."""
    messages = table(spark, sf_dir, "conversations")
    return repair(damage(messages), messages.select("conv_id"))
