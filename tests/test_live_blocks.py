"""Live rows travel and wait in blocks: whole columns give what single rows give, at a cost per block."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_scale import Handle, SimpleNamespace
from wavetrail.operators import messages as M
from wavetrail.sources import readers
from wavetrail.streaming import jobs as J
from wavetrail.streaming import live as L

MS = L.MS
clock = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)


def some_rows(dice, n, begin, end, huge):
    """Rows of a few keys with nulls, equal times and rows that come twice."""
    maybe = lambda value: value if dice.random() < 0.8 else None
    out = []
    for _ in range(n):
        plan = dice.random() < 0.2
        out.append({
            "key": f"k{dice.randrange(5)}", "timestamp_ns": dice.randrange(begin, end) * MS, "rank": 0 if plan else 1, "id": dice.randrange(-1, 40), "tgid": maybe(dice.randrange(3)),
            "uid": maybe(7), "alg": maybe(dice.randrange(3)), "key_id": maybe(dice.randrange(2)), "freq_key": maybe("155.1"), "channel_id": maybe(dice.randrange(4)),
            "power": dice.choice([None, float("nan"), -50.0, -61.0]), "base_hz": 851_000_000 * huge if plan else None, "spacing_hz": maybe(12500 * huge) if plan else None,
            "channel_num": maybe(dice.randrange(100)), "kind": dice.choice(["access_deny", "", None]), "note": maybe("a, é"),
        })
    return out + dice.sample(out, n // 10)


@pytest.mark.parametrize("huge", [1, 10**8])
@pytest.mark.parametrize("tracker", [L.Hold(), L.Rotations(), L.Sightings(), L.Sessions(3 * MS), L.Channels()], ids=lambda t: type(t).__name__)
def test_columns_give_what_single_rows_give(tracker, huge):
    dice, kept, kinds = random.Random(5), ({}, {}), set()
    for begin, end in ((0, 60), (60, 64), (70, 200), (300, 301)):
        rows, results = some_rows(dice, 120, begin, end, huge), []
        for memories, walk in zip(kept, (type(tracker).walk, L.Tracker.walk)):
            parts = [pa.Table.from_pylist(some, L._table({"key": "string", **L._ROW})) for some in (rows[:50], rows[50:])]
            found = walk(tracker, memories, L.Ready(L._joined(parts)), end * MS)
            results.append(sorted(repr(one) for part in found for one in L._findings("t", False, part).to_pylist()))
        assert results[0] == results[1] and kept[0] == kept[1]
        kinds.update(results[0])
    assert len(kinds) > 4
    assert type(tracker).walk is not L.Tracker.walk
    assert [sum(part.num_rows for part in tracker.walk(m, None, 10**6 * MS)) for m in kept] == ([5, 5] if isinstance(tracker, L.Sessions) else [0, 0])


def test_a_block_costs_one_call(spark):
    """20 000 rows of one group reach the state in two values, and come out as blocks."""
    ts = F.timestamp_millis(F.col("id") + 1)
    rows = spark.range(0, 20_000, 1, 1).select(F.col("id"), ts.alias("ts"), ((F.col("id") + 1) * MS).alias("timestamp_ns"))
    sent = L.packed(L.keyed(rows, "row", F.lit("k"), note=F.col("id").cast("string"))).toPandas()
    assert list(sent["first_ns"]) == [MS, (1 + L.BLOCK) * MS] and sent["ts"].max() == rows.agg(F.max("ts")).first()[0]
    handle, process = Handle(), L.Blocks({"row": L.Hold()})
    process.init(handle)
    late = list(process.handleInputRows(("row", 1), iter([sent]), clock(11)))
    assert handle.calls == 2 and handle.timers == {12}
    assert [f["late"].tolist() for f in late] == [[True]] and L._load(late[0]["block"][0])["id"].to_pylist() == list(range(10))
    handle.timers.clear()
    found = list(process.handleExpiredTimer(("row", 1), clock(15_000), None))
    got = [L._load(block) for frame in found for block in frame["block"]]
    assert [n for part in got for n in part["id"].to_pylist()] == list(range(10, 14_999)) and handle.timers == {15_001}
    assert len(got) == 1 and handle.calls == 4
    out = L.unpacked(spark.createDataFrame(found[0])).select("tracker", "late", "key", "finding", "id", "note")
    assert out.count() == 14_989 and tuple(out.orderBy("id").first()) == ("row", False, "k", "row", 10, "10")


def test_messages_of_other_kinds_are_not_parsed(spark):
    """What names a kind is parsed, also by an escape; the rest is kept with no payload."""
    named = ['{"nac": 1, "payload": {"type": "DenyResponse", "src_unit": 5}}', '{"payload": {"type": "Deny\\u0052esponse", "src_unit": 6}}', "{'payload': {'type': 'DenyResponse'}}"]
    texts = [*named, '{"nac": 4, "payload": {"type": "Other"}}', '{"payload": {"type": "DenyResp', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, message string").withColumn("timestamp_ns", F.lit(0))
    some, every = (readers.protocol_messages(rows, kinds=kinds).orderBy("id").collect() for kinds in (["DenyResponse"], None))
    assert [r for r in some if r.payload] == [r for r in every if r.payload and r.payload.type == "DenyResponse"] == some[:3]
    assert [r.id for r in some] == list(range(6)) and some[3].nac is None and every[3].nac == 4
    told = [[tuple(r) for r in M.message_findings(readers.protocol_messages(rows, kinds=kinds)).collect()] for kinds in (M.TELLING, None)]
    assert told[0] == told[1] and len(told[0]) == 3


def test_rows_without_a_time_are_refused(spark):
    rows = spark.createDataFrame([(1, None, None)], "id long, ts timestamp, timestamp_ns long")
    with pytest.raises(Exception, match="without a time"):
        L.packed(L.keyed(rows, "row", F.lit("k"))).collect()


def test_state_is_walked_once_a_batch(spark, tmp_path):
    """Findings and late rows go to two folders; the rows are not walked again for the second. The first row is at the first watermark, 0."""
    walked = spark.sparkContext.accumulator(0)

    class Counting(L.Tracker):
        def step(self, memory, row):
            walked.add(1)
            return [{"finding": "row"}]

    rows = spark.range(100).select("id", F.timestamp_seconds("id").alias("ts"), (F.col("id") * 10**9).alias("timestamp_ns"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    found = L.follow([L.keyed(stream, "row", F.lit("k"))], {"row": Counting()}, "10 seconds")
    with L.state_store(spark):
        J.run_to_end(L.write_findings(found, str(tmp_path)), f"{tmp_path}/checkpoint")
    ids = {r.id for r in spark.read.parquet(f"{tmp_path}/findings").collect()}
    assert ids == set(range(89)) and walked.value == 89
