import random
import re
from collections import defaultdict

from support import SF, documents, given_documents

from wavetrail.llm import decontamination as dc
from wavetrail.llm.registry import QUERIES

TOKEN = re.compile(r"[A-Za-z\x80-\U0010FFFF]+|[0-9](?:[0-9]|[.,](?=[0-9]))*")


def tokens(text):
    """(canonical, slot value) token by token."""
    raw, last = [], 0
    for m in TOKEN.finditer(text or ""):
        gap = text[last : m.start()]
        opens = not raw or bool(re.search(r"[\n!.:?]", gap))
        raw.append((m.group(), opens))
        last = m.end()
    capital = [bool(re.match("[A-ZÀ-Þ]", t)) for t, _ in raw]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t, _ in raw]
    names = {low[k] for k, (_, opens) in enumerate(raw) if capital[k] and not opens}
    kind = []
    for k, (t, opens) in enumerate(raw):
        if t[0].isdigit():
            kind.append("#")
        elif capital[k] and (not opens or low[k] in names):
            kind.append("@")
        elif k and kind[-1] == "#" and low[k] in dc.UNITS:
            kind.append("%")
        else:
            kind.append("")
    out = []
    for k, (_, opens) in enumerate(raw):
        if kind[k] == "@" and k and kind[k - 1] == "@" and not opens:
            out[-1] = ("@", out[-1][1] + (low[k],))
        else:
            out.append((kind[k] or low[k], (low[k],) if kind[k] else None))
    return out


def leaks(docs, items):
    index, sizes = defaultdict(list), {}
    for item, text in set(items):
        own = tokens(text)
        w = min(8, len(own))
        places = [i for i in range(len(own) - w + 1) if w and sum(v is not None for _, v in own[i : i + w]) <= min(3, w - 1)]
        sizes[item, text] = len(places)
        for i in places:
            index[tuple(t for t, _ in own[i : i + w])].append((item, text, i, [v for _, v in own[i : i + w]]))
    out = {}
    for doc, text in set(docs):
        own = tokens(text)
        seen = defaultdict(lambda: (set(), set()))
        for w in range(1, 9):
            for i in range(len(own) - w + 1):
                for item, t, j, values in index.get(tuple(t for t, _ in own[i : i + w]), ()):
                    places, slots = seen[item, t, i - j]
                    places.add(j)
                    slots.update((a, v) for a, (_, v) in zip(values, own[i : i + w]) if a is not None)
        covered, changed = defaultdict(set), defaultdict(int)
        for (item, t, _), (places, slots) in seen.items():
            if len({a for a, _ in slots}) == len(slots):
                covered[item, t] |= places
                changed[item, t] += sum(a != b for a, b in slots)
        for (item, t), places in covered.items():
            if len(places) / sizes[item, t] >= 0.5:
                out[doc, text, item] = (len(places), round(len(places) / sizes[item, t], 9), changed[item, t])
    return out


def compare(docs, items, rows):
    want = sorted(map(repr, ((d, i, *v) for (d, _, i), v in leaks(docs, items).items())))
    assert sorted(repr((r.doc_id, r.item_id, r.n_windows, round(r.share, 9), r.changed_slots)) for r in rows) == want
    assert all(r.exact == (r.changed_slots == 0) for r in rows)
    return want


QUESTION = "On monday Alice Smith bought 12 apples for 3.50 dollars and gave 5 km of rope to Bob, then Alice Smith sold 12 of them at 7 percent more than Bob paid for the rest."


def test_changed_parameters(spark):
    other = QUESTION.replace("Alice Smith", "Carol").replace("Bob", "Dan Lee").replace("12", "1,400").replace("3.50", "9").replace("7 percent", "8 days")
    broken = QUESTION.replace("Alice Smith bought", "Carol bought").replace("12 of", "13 of")
    items = [(1, QUESTION), (1, QUESTION), (2, "short item here"), (3, None), (4, "1 2 3 4 5 6 7 8 9"), (None, "é question without any id but with enough words in it")]
    docs = [
        (1, f"Before. {QUESTION} After."), (2, f"words and {other}\nmore words"), (3, broken), (4, "nothing of the kind"), (5, None), (6, ""), (7, "a short item here b"),
        (1, f"Before. {QUESTION} After."), (None, QUESTION), (8, "9 8 7 6 5 4 3 2 1 0"), (9, "x " * 30_000 + other), (10, "so: é question without any id but with enough words in it"),
    ]
    df = documents(spark, docs).withColumnRenamed("n_chars", "item_id")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = dc.find_leaks(df, bench).collect()
    want = compare(docs, items, rows)
    hit = {(r.doc_id, r.item_id): r for r in rows}
    assert hit[1, 1].exact and hit[2, 1].changed_slots > 3 and (9, 1) in hit and (7, 2) in hit and (10, None) in hit and (None, 1) in hit
    assert (3, 1) not in hit or not hit[3, 1].exact, want
    assert dc.find_leaks(df.limit(0), bench).count() == 0
    assert dc.find_leaks(df, bench.limit(0)).count() == 0


def test_random_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "FILTER_HASHES", 40)
    rnd = random.Random(11)
    vocabulary = ["the", "of", "Bob", "Ann", "12", "3.5", "km", "and", "x.", "Where", "é", "7"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 25)))) for i in range(12)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 30)) + rnd.choice(items)[1].split() + rnd.choices(vocabulary, k=5))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(compare(docs, items, dc.find_leaks(documents(spark, docs), bench).collect())) > 60


def test_verbatim_copies_in_any_surroundings(spark):
    sentences = "The train leaves the old town at noon. The bus follows it over the long bridge. The tram waits until both have gone. The driver then closes all of the doors."
    dense = "Add 12, 7, 19, 3 and 44, then take 8, 15, 21, 9 and 2 from it."
    mixed = sentences + " " + dense
    items = [(1, sentences), (2, dense), (3, "1 2 3 4 5 6 7 8 9"), (4, ""), (5, mixed)]
    docs = [
        (1, "we read that " + sentences), (2, "See also Notes On The Transport Problem. Some text. " + sentences), (3, "so: " + dense + " Good."), (4, "a 1 2 3 4 5 6 7 8 9 b"),
        (5, dense.replace("19", "20").replace("15", "16")), (6, sentences[:40]), (7, "9 8 7 6 5 4 3 2 1"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_held(documents(spark, docs), bench).collect()
    held = {(r.doc_id, r.item_id): r for r in rows}
    assert all(held[k].held_share == 1.0 and held[k].exact for k in ((1, 1), (2, 1), (3, 2), (4, 3)))
    assert not {(5, 2), (6, 1), (7, 3)} & set(held) and all(r.n_held <= 60 for r in rows)


def test_item_held_by_both_kinds_of_windows(spark):
    # the first half copied with other names, the second verbatim where the surroundings change its template
    first = "on monday Alice sold four boxes of green tea to the shop near Bob and went back home before the rain."
    second = "The train leaves at noon. The bus follows it slowly. The tram waits for both. The driver closes doors."
    doc = first.replace("Alice", "Carol") + " she read that " + second
    bench = spark.createDataFrame([(1, first + " " + second)], "item_id long, text string")
    (row,) = dc.find_held(documents(spark, [(1, doc)]), bench, 0.7).collect()
    assert row.share < 0.7 <= row.held_share and row.changed_slots


def test_query_on_given_texts(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert compare(given_documents(), items, QUERIES["op1_decontamination"](spark, SF).collect())


def test_a_shared_prompt_makes_no_pairs(spark):
    # every item and document opens with one prompt, which is less than half of an item; a tenth of the documents hold an item
    rnd = random.Random(4)
    prompt = "please read this question with care and then answer in full words"
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    items = [(i, prompt + " " + " ".join(rnd.choices(words, k=20))) for i in range(200)]
    docs = [(i, items[i][1] if i % 10 == 0 else prompt + " " + " ".join(rnd.choices(words, k=20))) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    rows = dc.find_held(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(0, 200, 10)} and all(r.held_share == 1.0 for r in rows)
    own = dc.template_windows(dc._texts(bench, "item_id"), [8]).withColumnsRenamed({"row_id": "item_id", "row_key": "item_key", "position": "item_position", "begins": "item_begins", "ends": "item_ends", "slots": "item_slots"})
    sizes = own.groupBy("item_id", "item_key").agg({"*": "count"}).selectExpr("item_id", "item_key", "`count(1)` div 2 as item_windows", "`count(1)` div 2 as item_plain_windows")
    found = dc.template_windows(dc._texts(frame, "doc_id"), [8])
    assert dc.candidate_pairs(found, own, sizes, 0.5).count() == 20
    # where the prompt is most of the item, every pair is a hit and none is lost
    short = spark.createDataFrame([(i, prompt + f" {words[i]}") for i in range(20)], "item_id long, text string")
    assert dc.find_held(frame, short).count() == 20 * 200
