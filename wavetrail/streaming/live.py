"""Live jobs with keyed state that give the batch rows for any order of delivery.

A row waits in the state of its key's group until the watermark has passed it; an event-time timer then hands a key's waiting rows on in order of time.
So the order in which files or partitions arrive does not matter. A row that comes after the watermark has passed its time could no longer
take its place; it is not dropped but reported with ``late`` set, and the sinks put it into a folder of its own.

State per key holds the rows that are newer than the watermark (``late`` of event time) and what its tracker remembers: the previous
algorithm and key of a talkgroup, the open session of a frequency, the latest plan of a channel. Event time moves with the rows and with
heartbeats; a quiet stream without heartbeats keeps what waits, and closes nothing.

Rows travel, wait and are found in blocks, Arrow tables of many rows as one binary value: Spark hands values to a stateful processor one
by one, at a cost that a block's rows share. Trackers that see many rows work on whole columns (``walk``), the others row by row (``step``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wavetrail.functions import scalars as S
from wavetrail.operators import messages as M
from wavetrail.operators.filters import all_of, resolve_field
from wavetrail.operators.geofence import near_sites
from wavetrail.operators.history import GRANT, TERMINATORS, rotation_text
from wavetrail.operators.ordered import NS
from wavetrail.operators.rules import EPSILON, Rule, matches
from wavetrail.operators.spacing import spaced_rows

MS = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Keys over which rows are dealt that need no state of their own.
SHARES = 64
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What trackers are given; every stream fills the columns it has.
GIVEN = {
    "tgid": "long", "uid": "long", "alg": "int", "key_id": "long", "freq_key": "string", "channel_id": "long", "power": "double", "base_hz": "long",
    "spacing_hz": "long", "channel_num": "long", "event_type": "string", "duid": "string", "low_ns": "long", "high_ns": "long",
    "kind": "string", "note": "string",
}
#: What they report.
FOUND = {
    "tgid": "long", "uid": "long", "old_alg": "int", "alg": "int", "old_key": "long", "key_id": "long", "freq_key": "string", "channel_id": "long",
    "hit_count": "long", "duration_sec": "double", "avg_signal": "double", "voice_freq": "double", "event_type": "string", "trace_id": "long",
    "span_id": "long", "since_ns": "long", "note": "string",
}
_ROW = {"timestamp_ns": "long", "rank": "int", "id": "long", **GIVEN}
_OUT = {"tracker": "string", "key": "string", "late": "boolean", "finding": "string", "id": "long", "timestamp_ns": "long", **FOUND}
_ddl = lambda columns: ", ".join(f"{n} {t}" for n, t in columns.items())
FINDINGS = _ddl(_OUT)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_table = lambda columns: pa.schema([(n, _ARROW[t]) for n, t in columns.items()])
_DOUBLES = [n for n, t in _ROW.items() if t == "double"]
#: What a row has whose part of the stream does not fill a column.
_NOTHING = dict.fromkeys(_ROW) | {"low_ns": 0, "high_ns": 0}
#: Rows that a block holds at most, and groups that the keys of a tracker are dealt to.
BLOCK, GROUPS = 16_384, 4096
#: Bytes of rows that are packed at once, and of blocks that one entry of the state holds.
PACKED, ENTRY = 16 << 20, 2 << 20


class Ready:
    """Rows of a group in order of key and time; ``spans`` tells where a key's rows begin and end."""

    def __init__(self, rows: pa.Table):
        keys = rows["key"].combine_chunks().dictionary_encode()
        codes = keys.indices.to_numpy()
        order = np.lexsort([*[pc.fill_null(rows[n], 0).to_numpy() for n in ("low_ns", "id", "rank", "timestamp_ns") if n in rows.column_names], codes])
        self.rows, codes = rows.take(order), codes[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        names = keys.dictionary.to_pylist()
        self.spans = {names[codes[a]]: (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(codes)])}

    def __len__(self) -> int:
        return self.rows.num_rows

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column's values, 0 for nulls, and where there are some."""
        if name not in self.rows.column_names:
            return np.zeros(len(self), "int64"), np.zeros(len(self), bool)
        column = self.rows[name]
        return pc.fill_null(column, 0).to_numpy().copy(), pc.is_valid(column).to_numpy()

    def of(self, name: str) -> Iterator[dict]:
        """A key's rows one by one."""
        a, b = self.spans.get(name, (0, 0))
        for part in self.rows.slice(a, b - a).to_batches(max_chunksize=BLOCK):
            for row in part.to_pylist():
                for n in _DOUBLES:
                    if (value := row.get(n)) is not None and value != value:
                        row[n] = None
                yield _NOTHING | row

    def found(self, where: np.ndarray, finding: str | pa.ChunkedArray, copied: list[str], **made: pa.Array) -> pa.Table:
        """Findings of the rows ``where``, with some of their columns; what is ``made`` has a value for each of them."""
        names = [n for n in ("key", "timestamp_ns", "id", *copied) if n in self.rows.column_names]
        out = self.rows.select(names).take(where)
        if isinstance(finding, str):
            finding = pa.repeat(pa.scalar(finding), len(where))
        for name, values in {"finding": finding, **made}.items():
            out = out.append_column(name, values)
        return out


def _masked(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


class Tracker:
    """Follows one key; ``memory`` is a dict that lives in its state."""

    def walk(self, memories: dict[str, dict], ready: Ready | None, mark: int) -> Iterator[pa.Table]:
        """Findings of the rows of a group that are ready, and of what is due by the mark; keeps the keys' ``memories``."""
        found = []
        for name in sorted(memories.keys() | (ready.spans.keys() if ready else set())):
            memory = memories.pop(name, {})
            for row in ready.of(name) if ready else ():
                found += [{"key": name, **f} for f in self.overdue(memory, row["timestamp_ns"])]
                found += [{"key": name, "timestamp_ns": row["timestamp_ns"], "id": row["id"], **f} for f in self.step(memory, row)]
                if len(found) >= BLOCK:
                    yield pa.Table.from_pylist(found, _table(_OUT))
                    found = []
            found += [{"key": name, **f} for f in self.overdue(memory, mark)]
            if memory:
                memories[name] = memory
        if found:
            yield pa.Table.from_pylist(found, _table(_OUT))

    def overdue(self, memory: dict, now: int) -> list[dict]:
        found = []
        while (deadline := self.deadline(memory)) is not None and deadline < now:
            found += self.expire(memory)
        return found

    def step(self, memory: dict, row: dict) -> list[dict]:
        """Findings of the next row in order."""
        return []

    def deadline(self, memory: dict) -> int | None:
        """Event time (ns) at which something is due without a further row."""
        return None

    def expire(self, memory: dict) -> list[dict]:
        """Findings at the deadline."""
        return []


class Hold(Tracker):
    """Hands every row on, in order."""

    def step(self, memory, row):
        return [{"finding": row["kind"] or "row", "note": row["note"]}]

    def walk(self, memories, ready, mark):
        if ready:
            kind = ready.rows["kind"] if "kind" in ready.rows.column_names else pa.nulls(len(ready), pa.string())
            named = pc.fill_null(pc.not_equal(kind, ""), False)
            yield ready.found(np.arange(len(ready)), pc.if_else(named, kind, "row"), ["note"])


class Rotations(Tracker):
    """A talkgroup's message whose algorithm or key differs from the one before it."""

    def step(self, memory, row):
        old, memory["last"] = memory.get("last"), [row["alg"], row["key_id"]]
        if old is None or old == memory["last"]:
            return []
        return [{"finding": "crypto_rotation", "tgid": row["tgid"], "uid": row["uid"], "old_alg": old[0], "alg": row["alg"], "old_key": old[1], "key_id": row["key_id"]}]

    def walk(self, memories, ready, mark):
        if not ready:
            return
        now = [*ready.numbers("alg"), *ready.numbers("key_id")]
        old, known = [np.roll(values, 1) for values in now], np.ones(len(ready), bool)
        for name, (a, b) in ready.spans.items():
            last = memories.get(name, {}).get("last")
            known[a] = last is not None
            for i, value in enumerate(last or ()):
                old[2 * i][a], old[2 * i + 1][a] = value or 0, value is not None
            alg, alg_there, key, key_there = (values[b - 1].item() for values in now)
            memories[name] = {"last": [alg if alg_there else None, key if key_there else None]}
        changed = np.flatnonzero(known & np.any([a != b for a, b in zip(now, old)], axis=0))
        alg, alg_there, key, key_there = (values[changed] for values in old)
        yield ready.found(changed, "crypto_rotation", ["tgid", "uid", "alg", "key_id"], old_alg=_masked(alg, alg_there), old_key=_masked(key, key_there))


class Sightings(Tracker):
    """The first row of a radio."""

    def step(self, memory, row):
        if memory.get("seen"):
            return []
        memory["seen"] = True
        return [{"finding": "new_uid", "tgid": row["tgid"], "uid": row["uid"]}]

    def walk(self, memories, ready, mark):
        first = [a for name, (a, _) in ready.spans.items() if not memories.get(name, {}).get("seen")] if ready else []
        if first:
            memories.update({name: {"seen": True} for name in ready.spans})
            yield ready.found(np.array(first), "new_uid", ["tgid", "uid"])


class Sessions(Tracker):
    """Hits of a frequency that follow each other within a gap; single hits are noise."""

    def __init__(self, gap_ns: int, min_hits: int = 2):
        self.gap_ns, self.min_hits = gap_ns, min_hits

    def step(self, memory, row):
        out = self.expire(memory) if memory and row["timestamp_ns"] - memory["last"] > self.gap_ns else []
        if not memory:
            memory.update(start=row["timestamp_ns"], hits=0, power=None, channel=row["channel_id"], freq=row["freq_key"])
        memory["last"] = row["timestamp_ns"]
        memory["hits"] += 1
        if row["power"] is not None:
            memory["power"] = (memory["power"] or 0.0) + row["power"]
        return out

    def walk(self, memories, ready, mark):
        found = []
        if ready:
            at, (power, there) = ready.numbers("timestamp_ns")[0], ready.numbers("power")
            there = there & ~np.isnan(power)
            power = np.where(there, power, 0.0)
            starts = np.ones(len(ready), bool)
            starts[1:] = np.diff(at) > self.gap_ns
            starts[[a for a, _ in ready.spans.values()]] = True
            starts = np.flatnonzero(starts)
            ends = np.append(starts[1:], len(ready))
            first = [{n: one[n] for n in ("channel_id", "freq_key")} for one in ready.rows.select(["channel_id", "freq_key"]).take(starts).to_pylist()]
            sums, heard = np.add.reduceat(power, starts), np.add.reduceat(there, starts)
            at_start = {name: i for name, i in zip(ready.spans, np.searchsorted(starts, [a for a, _ in ready.spans.values()]))}
            stops = [*list(at_start.values())[1:], len(starts)]
            for (name, low), high in zip(at_start.items(), stops):
                memory = memories.pop(name, {})
                for i in range(low, high):
                    a, b = int(starts[i]), int(ends[i])
                    found += [{"key": name, **f} for f in self.overdue(memory, int(at[a]))]
                    if not memory:
                        memory.update(start=int(at[a]), hits=0, power=None, channel=first[i]["channel_id"], freq=first[i]["freq_key"])
                    memory["last"] = int(at[b - 1])
                    memory["hits"] += b - a
                    if heard[i]:
                        memory["power"] = (memory["power"] or 0.0) + float(sums[i])
                memories[name] = memory
        for name, memory in list(memories.items()):
            found += [{"key": name, **f} for f in self.overdue(memory, mark)]
            if not memory:
                del memories[name]
        if found:
            yield pa.Table.from_pylist(found, _table(_OUT))

    def deadline(self, memory):
        return memory["last"] + self.gap_ns if memory else None

    def expire(self, memory):
        done = dict(memory)
        memory.clear()
        if not done or done["hits"] < self.min_hits:
            return []
        return [{
            "finding": "traffic_session", "id": done["channel"], "channel_id": done["channel"], "freq_key": done["freq"], "hit_count": done["hits"],
            "duration_sec": (done["last"] - done["start"]) / 1e9, "avg_signal": None if done["power"] is None else done["power"] / done["hits"], "since_ns": done["start"],
            "timestamp_ns": done["last"],
        }]


class Channels(Tracker):
    """Emergency grants of a channel, with the frequency of its latest plan."""

    def step(self, memory, row):
        if row["base_hz"] is not None:
            memory.update(base=row["base_hz"], spacing=row["spacing_hz"])
            return []
        freq = (memory["base"] + memory["spacing"] * row["channel_num"]) / 1e6 if None not in (memory.get("spacing"), row["channel_num"]) else None
        return [{"finding": "emergency_grant", "tgid": row["tgid"], "uid": row["uid"], "voice_freq": freq}]

    def walk(self, memories, ready, mark):
        if not ready:
            return
        (base, plan), (spacing, spaced), (number, numbered) = (ready.numbers(n) for n in ("base_hz", "spacing_hz", "channel_num"))
        at = np.maximum.accumulate(np.where(plan, np.arange(len(ready)), -1))
        there = at >= np.repeat([a for a, _ in ready.spans.values()], [b - a for a, b in ready.spans.values()])
        base, spacing, spaced = base[at], spacing[at], spaced[at]
        for name, (a, b) in ready.spans.items():
            if memory := memories.get(name):
                before = slice(a, a + np.count_nonzero(~there[a:b]))
                base[before], spacing[before], spaced[before], there[before] = memory["base"], memory["spacing"] or 0, memory["spacing"] is not None, True
            if there[b - 1]:
                memories[name] = {"base": int(base[b - 1]), "spacing": int(spacing[b - 1]) if spaced[b - 1] else None}
        grants = np.flatnonzero(~plan)
        base, spacing, number = base[grants], spacing[grants], number[grants]
        if sum(np.abs(x.astype(float)).max(initial=0) for x in (base, spacing, number)) >= 2.0**31:  # products would leave 64 bits
            base, spacing, number = (x.astype(object) for x in (base, spacing, number))
        freq = ((base + spacing * number) / 1e6).astype(float)
        yield ready.found(grants, "emergency_grant", ["tgid", "uid"], voice_freq=_masked(freq, (there & spaced & numbered)[grants]))


class Traces(Tracker):
    """Trace and span of protocol events (see ``history.assign_traces``)."""

    def __init__(self, gap_ns: int):
        self.gap_ns = gap_ns

    def step(self, memory, row):
        if row["event_type"] == GRANT:
            memory.update(trace=row["id"], span=0)
        elif memory.get("trace") is not None and row["timestamp_ns"] - memory["last"] > self.gap_ns:
            memory["trace"] = None
        memory["last"] = row["timestamp_ns"]
        open_ = memory.get("trace") is not None
        memory["span"] = memory.get("span", 0) + 1
        out = {"finding": "traced", "event_type": row["event_type"], "trace_id": memory.get("trace"), "span_id": memory["span"] if open_ else None}
        if row["event_type"] == "protocol.p25.voice" and row["duid"] in TERMINATORS:
            memory["trace"] = None
        return [out]

    def deadline(self, memory):
        return memory["last"] + self.gap_ns if memory else None

    def expire(self, memory):
        memory.clear()
        return []


class NewValues(Tracker):
    """Sightings of a value that was not seen within the look-back before them."""

    def __init__(self, look_back_ns: int):
        self.look_back_ns = look_back_ns

    def step(self, memory, row):
        known, memory["last"] = "last" in memory, row["timestamp_ns"]
        return [] if known else [{"finding": "new_value"}]

    def deadline(self, memory):
        return memory["last"] + self.look_back_ns if memory else None

    def expire(self, memory):
        memory.clear()
        return []


class Visits(Tracker):
    """Enter the nearest site within its radius, leave beyond twice that (see ``geofence.near_sites``)."""

    def step(self, memory, row):
        keep = [int(s) for s in row["note"].split(",") if s]
        at = memory.get("site")
        if at is None:
            if row["channel_id"] is None:
                return []
            memory["site"] = row["channel_id"]
            return [{"finding": "enter", "channel_id": row["channel_id"]}]
        if at in keep:
            return []
        memory.clear()
        return [{"finding": "exit", "channel_id": at}]


class Counted(Tracker):
    """Threshold, absence and rate-change rules at every evaluation time (see ``rules.window_counts``).

    The memory is one count per cell of the longest look back.
    """

    TESTS = {
        "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
        "eq": lambda a, b: abs(a - b) < EPSILON, "ne": lambda a, b: abs(a - b) >= EPSILON,
    }

    def __init__(self, rule: Rule, step_s: int, start_s: int, end_s: int | None):
        self.rule, self.step_ns = rule, step_s * NS
        self.first, self.last = start_s // step_s, None if end_s is None else end_s // step_s
        self.window = max(rule.window_sec // step_s, 1)
        self.baseline = max(rule.baseline_sec // step_s, self.window)

    def step(self, memory, row):
        memory.setdefault("next", self.first)
        if row["rank"] == 1:
            cell = memory.setdefault("cells", {}).setdefault(str(row["timestamp_ns"] // self.step_ns), [0, 0])
            cell[0] += row["low_ns"]
            cell[1] += row["high_ns"]
        return []

    def deadline(self, memory):
        if "next" not in memory or (self.last is not None and memory["next"] > self.last):
            return None
        return memory["next"] * self.step_ns

    def expire(self, memory):
        at, cells = memory["next"], memory.setdefault("cells", {})
        n = lambda low, high: sum(cells.get(str(c), (0, 0))[0] for c in range(low + 1, high + 1))
        edge = lambda c: cells.get(str(c), (0, 0))[1]
        begin, base = at - self.window, at - self.baseline
        current, older = n(begin, at) + edge(begin), n(base, begin) + edge(base)
        memory["next"] = at + 1
        memory["cells"] = {c: v for c, v in cells.items() if int(c) > base}
        if not self.fires(current, older):
            return []
        return [{"finding": "fired", "timestamp_ns": at * self.step_ns, "hit_count": current}]

    def fires(self, current: int, older: int) -> bool:
        r = self.rule
        if r.kind == "threshold":
            return self.TESTS[r.op](float(current), float(r.value))
        if r.kind == "absence":
            return current == 0
        scale = r.window_sec / (r.baseline_sec - r.window_sec) if r.baseline_sec > r.window_sec else 1.0
        usual = older * scale
        return usual >= 1 and abs((current - usual) / usual * 100) >= r.percent


class Silences(Tracker):
    """Stretches without a match longer than the window, each told once; heartbeats start the watch, so a rule that never matches is silent too."""

    def __init__(self, window_ns: int, cell_ns: int):
        self.window_ns, self.cell_ns = window_ns, cell_ns

    def step(self, memory, row):
        out = []
        if row["rank"] == 0:  # a heartbeat
            memory.setdefault("last", row["low_ns"])
            return out
        if "last" in memory and not memory.get("told") and row["low_ns"] - memory["last"] > self.window_ns:
            out.append(self._silence(memory))
        memory.update(last=max(memory.get("last", row["high_ns"]), row["high_ns"]), told=False)
        return out

    def deadline(self, memory):
        if "last" not in memory or memory.get("told"):
            return None
        # rows up to the end of the window are in order only when their whole cell is
        return ((memory["last"] + self.window_ns) // self.cell_ns + 1) * self.cell_ns

    def expire(self, memory):
        memory["told"] = True
        return [self._silence(memory)]

    def _silence(self, memory):
        return {"finding": "silence", "timestamp_ns": memory["last"] + self.window_ns, "since_ns": memory["last"]}


def _unpack(at: int, text: str) -> dict:
    """A row that came as JSON, as trackers see it; JSON leaves nulls out and writes what is not finite as text."""
    row = dict.fromkeys(_ROW) | json.loads(text)
    row["timestamp_ns"] = at
    for name in _DOUBLES:
        value = float(row[name]) if isinstance(row[name], str) else row[name]
        row[name] = None if value != value else value
    return row


def _dump(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write(rows)
    return sink.getvalue().to_pybytes()


def _load(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    for at in range(0, rows.num_rows, BLOCK):
        yield rows.slice(at, BLOCK)


def _joined(parts: list[pa.Table]) -> pa.Table:
    """The rows of all parts, which are given up."""
    rows = pa.concat_tables(parts, promote_options="default").combine_chunks()
    parts.clear()
    return rows


def _entries(blocks: Iterator[bytes]) -> Iterator[tuple[list[bytes]]]:
    """Blocks as entries of the state."""
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block)
        if size >= ENTRY:
            yield (held,)
            held, size = [], 0
    if held:
        yield (held,)


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then lets the key's tracker see them in order.

    The keys of a group share its state: a call costs as much as hundreds of rows, so one call serves all keys of a group. Rows wait in
    blocks, many in one entry of the state; memories are kept by key. Here rows come and go one by one, in ``Blocks`` many at once.
    """

    def __init__(self, trackers: dict[str, Tracker]):
        self.trackers = trackers

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "blocks array<binary>")
        self.memory = handle.getValueState("memory", "json string")
        self.alarm = handle.getValueState("alarm", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        columns = _table({"key": "string", **_ROW})
        blocks = ([{"key": r["key"], **_unpack(r["timestamp_ns"], r["given"])} for r in some] for some in iter(lambda: list(islice(rows, BLOCK)), []))
        for late in self._arrived(((min(r["timestamp_ns"] for r in some), _dump(pa.Table.from_pylist(some, columns))) for some in blocks), timerValues):
            yield from self._rows(key[0], True, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for found in self._released(key[0], timerValues):
            yield from self._rows(key[0], False, found)

    def _rows(self, tracker: str, late: bool, found: pa.Table) -> Iterator[Row]:
        for one in _findings(tracker, late, found).to_pylist():
            yield Row(**one)

    def _arrived(self, blocks: Iterator[tuple[int, bytes]], timerValues) -> Iterator[pa.Table]:
        """Keeps blocks, which come with the time of their earliest row; gives back rows that are late."""
        mark, first, late = timerValues.getCurrentWatermarkInMs() * MS, [], []

        def kept() -> Iterator[bytes]:
            for begin, block in blocks:
                if begin < mark:
                    rows = _load(block)
                    fresh = pc.greater_equal(rows["timestamp_ns"], mark)
                    late.append(rows.filter(pc.invert(fresh)))
                    rows = rows.filter(fresh)
                    if not rows.num_rows:
                        continue
                    begin, block = pc.min(rows["timestamp_ns"]).as_py(), _dump(rows)
                first[:] = [min([begin, *first])]
                yield block

        for entry in _entries(kept()):
            self.waiting.appendValue(entry)
            yield from late
            late.clear()
        yield from late
        if first:
            self._wake(int(first[0]), timerValues)

    def _released(self, name: str, timerValues) -> Iterator[pa.Table]:
        """Findings of all that the watermark has passed."""
        mark = timerValues.getCurrentWatermarkInMs() * MS
        tracker, memories = self.trackers[name], self.memory.get()
        memories = json.loads(memories[0]) if memories else {}
        parts, rest = [], []
        for (blocks,) in self.waiting.get() if self.waiting.exists() else ():
            for block in blocks:
                rows = _load(block)
                fresh = pc.greater_equal(rows["timestamp_ns"], mark)
                if not pc.any(fresh).as_py():
                    parts.append(rows)  # no copy
                elif pc.all(fresh).as_py():
                    rest.append(rows)
                else:
                    parts.append(rows.filter(pc.invert(fresh)))
                    rest.append(rows.filter(fresh))
        ready = Ready(_joined(parts)) if parts else None
        yield from tracker.walk(memories, ready, mark)
        ready = None
        due = [deadline for memory in memories.values() if (deadline := tracker.deadline(memory)) is not None]
        if rest:
            rest = _joined(rest)
            due.append(pc.min(rest["timestamp_ns"]).as_py())
            self.waiting.put(list(_entries(map(_dump, _pieces(rest)))))
        else:
            self.waiting.clear()
        if memories:
            self.memory.update((json.dumps(memories),))
        else:
            self.memory.clear()
        self.alarm.clear()
        if due:
            self._wake(min(due), timerValues)

    def _wake(self, ns: int, timerValues) -> None:
        """One timer a group, at the earliest thing that is due; not at the watermark itself, which has been: Spark drops that timer after its call."""
        at, old = max(ns // MS, timerValues.getCurrentWatermarkInMs() + 1), self.alarm.get()
        if old is not None and old[0] <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def close(self) -> None:
        pass


class Blocks(InOrder):
    """Takes and gives blocks (see ``packed`` and ``unpacked``)."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for late in self._arrived(((begin, block) for frame in rows for begin, block in zip(frame["first_ns"], frame["block"])), timerValues):
            yield from self._frames(key[0], True, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for found in self._released(key[0], timerValues):
            yield from self._frames(key[0], False, found)

    def _frames(self, tracker: str, late: bool, found: pa.Table) -> Iterator[pd.DataFrame]:
        for part in _pieces(found):
            yield pd.DataFrame({"tracker": [tracker], "late": [late], "block": [_dump(part)]})


def _findings(tracker: str, late: bool, found: pa.Table) -> pa.RecordBatch:
    """Findings or late rows with all columns."""
    n, given = found.num_rows, found.column_names
    same = {"tracker": pa.repeat(pa.scalar(tracker), n), "late": pa.repeat(pa.scalar(late), n)}
    column = lambda f: found[f.name].combine_chunks().cast(f.type) if f.name in given else pa.nulls(n, f.type)
    return pa.RecordBatch.from_arrays([same[f.name] if f.name in same else column(f) for f in _table(_OUT)], schema=_table(_OUT))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each tracker and group that come within ``PACKED`` bytes, as blocks."""

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        if rows["timestamp_ns"].null_count:
            raise ValueError("a row without a time has no place in a stream")
        trackers, groups = rows["tracker"].combine_chunks().dictionary_encode(), rows["group"].to_numpy()
        code = trackers.indices.to_numpy().astype("int64") * GROUPS + groups
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        starts = np.array([at for a, b in zip(starts, [*starts[1:], len(order)]) for at in range(a, b, BLOCK)])
        body = rows.drop_columns(["ts", "tracker", "group"]).replace_schema_metadata().take(order).combine_chunks()
        body = pa.Table.from_arrays(body.columns, names=body.column_names)
        ts = pc.fill_null(rows["ts"].cast(pa.int64()), 0).to_numpy()[order]
        made = [_dump(body.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(order)])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.maximum.reduceat(ts, starts)).cast(pa.timestamp("us", tz="UTC")), trackers.dictionary.take(trackers.indices.take(pa.array(order[starts]))),
                pa.array(groups[order[starts]]), pa.array(np.minimum.reduceat(body["timestamp_ns"].to_numpy(), starts)), pa.array(made, pa.binary()),
            ],
            names=["ts", "tracker", "group", "first_ns", "block"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACKED:
            held, size, rows = [], 0, pa.Table.from_batches(held).combine_chunks()
            yield blocks(rows)
    if held:
        yield blocks(pa.Table.from_batches(held).combine_chunks())


def _unpack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for tracker, late, block in zip(*(batch.column(n).to_pylist() for n in ("tracker", "late", "block"))):
            held.append(_findings(tracker, late, _load(block)))
            size += held[-1].num_rows
            if size >= BLOCK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def packed(part: DataFrame) -> DataFrame:
    """Keyed rows in blocks by tracker and group; ``ts`` of a block is its latest one, so event time moves as with single rows."""
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group")
    return part.select("ts", "tracker", group, "key", "timestamp_ns", "given.*").mapInArrow(_pack, "ts timestamp, tracker string, group long, first_ns long, block binary")


def unpacked(found: DataFrame) -> DataFrame:
    """Findings and late rows out of their blocks."""
    return found.select("tracker", "late", "block").mapInArrow(_unpack_blocks, FINDINGS)


def keyed(df: DataFrame, tracker: str | Column, key: Column, rank: int = 1, **values: Column | str) -> DataFrame:
    """A stream's rows for a tracker; needs ``ts``, ``timestamp_ns`` and ``id``. Rows without a key are left out."""
    given = {n: F.col(v) if isinstance(v, str) else v for n, v in values.items()}
    columns = [F.coalesce(c, F.lit(0)).cast(GIVEN[n]).alias(n) if n.endswith("_ns") else c.cast(GIVEN[n]).alias(n) for n, c in given.items()]
    place = [F.lit(rank).alias("rank"), F.coalesce("id", F.lit(-1)).cast("long").alias("id")]
    name = F.lit(tracker) if isinstance(tracker, str) else tracker
    row = F.struct(*place, *columns).alias("given")
    return df.select("ts", name.alias("tracker"), key.cast("string").alias("key"), "timestamp_ns", row).where("key IS NOT NULL")


def heartbeats(beats: DataFrame) -> DataFrame:
    """``ts`` of a clock as rows that only move event time on."""
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns")
    rows = beats.select(F.col("ts").cast("timestamp").alias("ts"), ns, F.lit(None).cast("long").alias("id"))
    return keyed(rows, "clock", F.lit("clock"))


def follow(parts: list[DataFrame], trackers: dict[str, Tracker], late: str) -> DataFrame:
    """Findings of all trackers over the given keyed streams, and late rows, in blocks (see ``unpacked``)."""
    rows = packed(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(packed(part))
    # without the watermarked column itself Spark does not drop late rows before they can be reported
    rows = rows.withWatermark("ts", late).drop("ts")
    processor = Blocks({"clock": Tracker(), **trackers})
    return rows.groupBy("tracker", "group").transformWithStateInPandas(processor, "tracker string, late boolean, block binary", "append", "eventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state with timers needs RocksDB; queries started here use it."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


@contextmanager
def made_once(batch: DataFrame):
    """The rows of a micro-batch's blocks; the state is walked once, however often they are read."""
    batch = batch.persist(StorageLevel.DISK_ONLY)
    try:
        yield unpacked(batch)
    finally:
        batch.unpersist()


def write_findings(found: DataFrame, path: str, make=None):
    """Findings (through ``make``) and late rows in two folders; a repeated batch overwrites itself."""

    def write(blocks: DataFrame, batch_id: int) -> None:
        with made_once(blocks) as batch:
            good = batch.where("NOT late")
            (good if make is None else make(good)).write.mode("overwrite").parquet(f"{path}/findings/batch={batch_id}")
            batch.where("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return found.writeStream.foreachBatch(write)


# --- jobs ------------------------------------------------------------------------


def analysis(
    crypto: DataFrame, grants: DataFrame, hits: DataFrame, parsed: Callable[[list[str]], DataFrame], beats: DataFrame, gap_ns: int, late: str, system: str = "SYS"
) -> DataFrame:
    """Rotations, first sightings, traffic sessions and network findings as one stream (see ``describe``).

    The four streams need ``ts``; what needs no state goes along in order of time. ``parsed`` gives the messages with those of some kinds
    parsed: a stream's rows cannot be kept for several readers, and parsing is the dearest part of them.
    """
    rotations = crypto.withColumn("alg", S.algorithm_id(F.col("algorithm"), F.col("encrypted_flag")))
    name = lambda *parts: F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("?")) for p in parts])
    sessions = hits.withColumn("freq_key", S.fixed(F.col("freq_mhz"), 3))
    urgent = M.grant_entries(parsed(M.GRANTS), system, extra=["ts"]).where("emergency")
    plans = M.channel_parameters(parsed([M.PLAN]), extra=["ts"])
    parts = [
        keyed(rotations, "rotation", name("system", "tgid"), tgid="tgid", uid="uid", alg="alg", key_id="key_id"),
        keyed(grants.where(F.col("uid") > 0), "sighting", name("system", "uid"), tgid="tgid", uid="uid"),
        keyed(sessions, "traffic", F.col("freq_key"), freq_key="freq_key", channel_id="channel_id", power="power"),
        # a plan counts for grants of its own instant
        keyed(plans, "channel", F.col("channel_id"), rank=0, channel_id="channel_id", base_hz="base_hz", spacing_hz="spacing_hz"),
        keyed(urgent, "channel", F.coalesce("channel_id", F.lit(-1)), tgid="tgid", uid="uid", channel_num="channel_num"),
        keyed(M.message_findings(parsed(M.TELLING), extra=["ts"]), "message", F.pmod(F.xxhash64("id"), F.lit(SHARES)), kind="finding", note="summary"),
        heartbeats(beats),
    ]
    trackers = {"message": Hold(), "rotation": Rotations(), "sighting": Sightings(), "traffic": Sessions(gap_ns), "channel": Channels()}
    return follow(parts, trackers, late)


def describe(found: DataFrame) -> DataFrame:
    """Findings of ``analysis`` with their texts."""
    text = (
        F.when(F.col("finding") == "crypto_rotation", rotation_text(F.col("old_alg"), F.col("old_key"), F.col("alg"), F.col("key_id"), F.col("tgid")))
        .when(F.col("finding") == "new_uid", F.concat(F.lit("New UID "), "uid", F.lit(" on TG "), "tgid"))
        .when(F.col("finding") == "traffic_session", M.session_text(F.round("duration_sec", 6), F.round("avg_signal", 6)))
        .when(F.col("finding") == "emergency_grant", M.emergency_text())
        .otherwise(F.col("note"))
    )
    return found.select("finding", "id", "timestamp_ns", text.alias("summary"))


def traces(log: DataFrame, beats: DataFrame, gap_ns: int, late: str) -> DataFrame:
    """Trace and span of protocol events, as ``history.assign_traces`` gives them."""
    known = log.where(F.col("talkgroup").isNotNull() | F.col("freq_mhz").isNotNull())
    khz = F.coalesce((F.col("freq_mhz") * 1000).cast("long"), F.lit(-1))
    key = F.concat_ws(":", F.coalesce("talkgroup", F.lit(-1)).cast("string"), khz.cast("string"))
    return follow([keyed(known, "trace", key, event_type="event_type", duid="duid"), heartbeats(beats)], {"trace": Traces(gap_ns)}, late)


def silences(log: DataFrame, rules: list[Rule], beats: DataFrame, late: str, cells: int = 16) -> DataFrame:
    """Silences of absence rules, from the first heartbeat on.

    Matches are first brought down to the first and last one of each cell, a part of the window, inside every Arrow batch: no silence lies
    within a cell, so a rule's state holds a few cells and no matches. Each heartbeat is dealt to every rule.
    """
    parts, trackers = [], {}
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    for rule in rules:
        cell = max(rule.window_sec * NS // cells, MS)
        name = f"rule:{rule.id}"
        trackers[name] = Silences(rule.window_sec * NS, cell)
        ends = lambda c: (F.floor(c / F.lit(cell)) + 1).cast("long") * F.lit(cell) - 1  # noqa: E731, B023
        hits = log.where(all_of(rule.filters)).select("timestamp_ns").mapInPandas(_first_and_last(cell), "cell long, low_ns long, high_ns long")
        timed = hits.select(F.timestamp_micros(F.expr("high_ns div 1000")).alias("ts"), ((F.col("cell") + 1) * cell - 1).alias("timestamp_ns"), F.lit(None).cast("long").alias("id"), "low_ns", "high_ns")
        parts.append(keyed(timed, name, F.lit(str(rule.id)), low_ns="low_ns", high_ns="high_ns"))
        beat = beats.select(F.col("ts").cast("timestamp").alias("ts"), ends(ns).alias("timestamp_ns"), F.lit(None).cast("long").alias("id"), ns.alias("low_ns"))
        parts.append(keyed(beat, name, F.lit(str(rule.id)), rank=0, low_ns="low_ns"))
    return follow(parts, trackers, late)


def counted(log: DataFrame, rules: list[Rule], beats: DataFrame, late: str, step_s: int, start_s: int, end_s: int | None = None) -> DataFrame:
    """Firings of threshold, absence and rate-change rules, as ``rules.counted_firings`` gives them; heartbeats start the rules.

    Matches are counted per rule and cell inside every Arrow batch before they are exchanged, in one pass for all rules.
    """
    name = F.concat(F.lit("rule:"), F.col("rule_id").cast("string"))
    cells = matches(log, rules).select("rule_id", "timestamp_ns").mapInPandas(_counts(step_s * NS), "rule_id int, end_ns long, n long, edges long")
    timed = cells.select("rule_id", F.timestamp_micros(F.expr("end_ns div 1000")).alias("ts"), F.col("end_ns").alias("timestamp_ns"), F.lit(None).cast("long").alias("id"), "n", "edges")
    # a cell's row must not move event time beyond what was seen
    timed = timed.withColumn("ts", F.col("ts") - F.expr(f"INTERVAL {step_s} SECONDS"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ids = F.explode(F.array(*[F.lit(r.id) for r in rules])).alias("rule_id")
    beat = beats.select(F.col("ts").cast("timestamp").alias("ts"), (micros * 1000).alias("timestamp_ns"), F.lit(None).cast("long").alias("id"), ids)
    trackers = {f"rule:{r.id}": Counted(r, step_s, start_s, end_s) for r in rules}
    return follow([keyed(timed, name, F.col("rule_id"), low_ns="n", high_ns="edges"), keyed(beat, name, F.col("rule_id"), rank=0)], trackers, late)


def _counts(step: int):
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ns = batch["timestamp_ns"]
            cell = (ns + step - 1) // step * step
            grouped = pd.DataFrame({"rule_id": batch["rule_id"], "end_ns": cell, "edge": (ns % step == 0).astype("int64")}).groupby(["rule_id", "end_ns"])["edge"]
            out = grouped.agg(["size", "sum"]).reset_index()
            yield out.rename(columns={"size": "n", "sum": "edges"}).astype({"n": "int64", "edges": "int64"})

    return reduce


def new_values(log: DataFrame, rule: Rule, beats: DataFrame, late: str) -> DataFrame:
    """Sightings of a field's values that were not seen within the rule's look-back before them. State per value: its last sighting."""
    value = resolve_field(rule.field)[0].cast("string")
    hits = log.where(all_of(rule.filters))
    return follow([keyed(hits, "value", value), heartbeats(beats)], {"value": NewValues(rule.baseline_sec * NS)}, late)


def site_visits(positions: DataFrame, sites: DataFrame, beats: DataFrame, late: str) -> DataFrame:
    """Enter and exit events of devices as their positions arrive; ``channel_id`` is the site. State per device: the site it is at."""
    near = near_sites(positions, sites)
    keep = F.concat_ws(",", F.transform("keep", lambda s: s.cast("string")))
    return follow([keyed(near, "visit", F.col("device"), channel_id="enter", note=keep), heartbeats(beats)], {"visit": Visits()}, late)


def _first_and_last(cell: int):
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            times = batch["timestamp_ns"].dropna().astype("int64")
            both = times.groupby(times // cell).agg(["min", "max"])
            yield pd.DataFrame({"cell": both.index, "low_ns": both["min"].to_numpy(), "high_ns": both["max"].to_numpy()})

    return reduce


def cooldown(hits: DataFrame, beats: DataFrame, rest_s: int, late: str) -> DataFrame:
    """Matches of rules, released in order of time; ``fire`` picks the firings.

    ``hits`` needs ts, rule_id, id and timestamp_ns. The state is keyed by rule and cell of time, so no group holds all matches of a rule.
    """
    cell = F.expr(f"timestamp_ns div {max(rest_s, 1) * NS}L")
    key = F.concat_ws(":", F.col("rule_id").cast("string"), cell.cast("string"))
    return follow([keyed(hits, "match", key), heartbeats(beats)], {"match": Hold()}, late)


def fire(found: DataFrame, path: str, rest_s: int):
    """Firings of each batch of released matches, by the batch operator; the last firing of each rule is carried from batch to batch.

    All matches before the watermark are released at once, so a batch holds every match of its stretch of time. The carry of a batch is
    a table of its own: a repeated batch reads the same one and overwrites its results.
    """
    spark = found.sparkSession

    def write(blocks: DataFrame, batch_id: int) -> None:
        with made_once(blocks) as batch:
            times = batch.where("NOT late").select(F.split("key", ":")[0].cast("int").alias("rule_id"), "timestamp_ns")
            carried = spark.createDataFrame([], "rule_id int, timestamp_ns long")
            if batch_id:
                carried = spark.read.schema(carried.schema).parquet(f"{path}/carry/batch={batch_id - 1}")
            kept = spaced_rows(times.unionByName(carried), "rule_id", "timestamp_ns", rest_s * NS)
            kept.join(carried, ["rule_id", "timestamp_ns"], "left_anti").write.mode("overwrite").parquet(f"{path}/fired/batch={batch_id}")
            last = spark.read.schema(carried.schema).parquet(f"{path}/fired/batch={batch_id}").unionByName(carried)
            last.groupBy("rule_id").agg(F.max("timestamp_ns").alias("timestamp_ns")).write.mode("overwrite").parquet(f"{path}/carry/batch={batch_id}")
            batch.where("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return found.writeStream.foreachBatch(write)
