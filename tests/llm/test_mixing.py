from collections import defaultdict

from check import compare, connect
from pyspark.sql import functions as F
from support import SF, WORD

from wavetrail.llm import mixing
from wavetrail.llm.registry import ORACLES, QUERIES


def test_query_equals_sql(spark):
    state, note = compare(spark, connect(SF), "op7_source_mix", SF, QUERIES, ORACLES)
    assert state == "ok", note


def fill(sizes, weights, budget):
    """Deal, cut, deal what is left again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = budget * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.remove(s)
    return target


def test_small_table(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 13)), ["a", "b", None, "é", "zz"][i % 5], i) for i in range(200)]
    rows += [(7, "one two", "b", 1), (7, "one two", "b", 1), (8, None, "a", 1), (None, "x y z", "only", 1), (900, "q " * 3000, "b", 1), (901, "", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    out = mixing.mix(df, mixing.repeating_weights(df), block=16).collect()
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5)
    by_size = {(sizes[s], round(want[s], 6)) for s in sizes}
    assert len(out) == len(rows)
    assert {(r.source_size, round(r.target, 6)) for r in out} <= by_size
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in taken.items():
        assert n == int(target) * sum((sizes[s], round(want[s], 6)) == (size, target) for s in sizes)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(5), mixing.repeating_weights(df), block=16).collect()))
    empty = df.limit(0)
    assert mixing.mix(empty, mixing.repeating_weights(empty)).count() == 0


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 6000, 9000.0), ("b", 3000, 3000.0), ("c", 50, 75.0)], "key string, source_size long, target double")
    slots = mixing.schedule(spark, sources, block=10).orderBy("position").collect()
    assert len({s.position for s in slots}) >= len(slots) - 10
    for key, words in (("a", 9000), ("b", 3000), ("c", 75)):
        own = [s for s in slots if s.key == key]
        assert sorted(s.rank for s in own) == list(range(len(own)))
        assert sum(s.stop - s.start for s in own) == words
    for n in (100, 400, 800):  # every beginning of the mix is near the shares
        assert abs(sum(s.key == "a" for s in slots[:n]) / n - 900 / 1208) < 0.02


def test_sequence_is_the_mix(spark):
    """The pieces fill the slots of the schedule without a gap or an overlap, add up to what is taken, and every beginning is near the weights."""
    rows = [(i, " ".join([f"w{i}"] * (1 + i * 7 % 23)), "abc"[i % 3], 0) for i in range(900)] + [(5000, "z " * 300, "a", 0), (5001, None, "a", 0), (None, "x y", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position int").repartition(4)
    weights, block = mixing.repeating_weights(df), 16
    pieces = mixing.mixed_sequence(df, weights, block=block).orderBy("position", "start_word").collect()
    taken, first, last, slots = defaultdict(int), {}, {}, defaultdict(list)
    for p in pieces:
        n = p.last_word - p.first_word + 1
        assert n > 0
        taken[p.doc_id] += n
        first.setdefault(p.doc_id, p.position)
        last[p.doc_id] = p.position
        slots[p.position].append(p)
    out = mixing.mix(df, weights, block=block).collect()
    for r in out:
        assert (taken.get(r.doc_id, 0), first.get(r.doc_id), last.get(r.doc_id)) == (r.taken, r.first_position, r.last_position)
    totals = defaultdict(int)
    for held in slots.values():
        assert len({p.source_key for p in held}) == 1
        at = 0
        for p in held:
            assert p.start_word == at
            at += p.last_word - p.first_word + 1
        assert at <= block
        totals[held[0].source_key] += 1
    seen = defaultdict(int)
    for n, position in enumerate(sorted(slots), 1):
        seen[slots[position][0].source_key] += 1
        assert all(abs(seen[key] - n * share / len(slots)) < 6 for key, share in totals.items())


def test_words_of_a_document_come_in_order(spark):
    """Within one pass over a stream the words of a document stand in the mix in their own order, each once."""
    df = spark.createDataFrame([(1, "w " * 100, "a"), (2, "w " * 37, "a"), (3, "w " * 50, "b")], "doc_id long, text string, source string")
    pieces = mixing.mixed_sequence(df, mixing.repeating_weights(df), block=8).orderBy("position", "start_word").collect()
    for doc, size in ((1, 100), (2, 37), (3, 50)):
        words = [w for p in pieces if p.doc_id == doc for w in range(p.first_word, p.last_word + 1)]
        assert words[:size] == list(range(min(size, len(words)))) and words[size:] == list(range(len(words[size:])))
