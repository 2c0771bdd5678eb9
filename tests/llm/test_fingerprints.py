import random

import numpy as np
from support import SF, documents, given_documents, sha

from wavetrail.llm import fingerprints as fp
from wavetrail.llm.batches import SYMBOLS, Totals
from wavetrail.llm.registry import QUERIES


def slow(text: str) -> str:
    """Chunks byte by byte, with a gear hash that forgets after 32 shifts."""
    data, chunks, start, h = text.encode(), set(), 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        bits = fp.HARD_BITS if size < fp.NORMAL else fp.EASY_BITS
        if size == fp.MOST or i + 1 == len(data) or (size >= fp.LEAST and h >> (32 - bits) == 0):
            own = np.frombuffer(data[start : i + 1], dtype=np.uint8)
            digest = int(Totals(SYMBOLS[own]).spans(np.array([0]), np.array([size]))[0]) >> 16
            chunks.add(f"{digest:012x}{size - 1:02x}")
            start, h = i + 1, 0
    return "".join(sorted(chunks))


def edit(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def check(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = edit(text, following)
        f, e = slow(text), slow(edited)
        want.append((doc_id, len(text), sha(edited), f, e, round(fp.likeness(f, e), 9), round(fp.likeness(f, slow(following)), 9)))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_small_table(spark):
    rnd = random.Random(2)
    rows = [(i * 3, "".join(rnd.choices("abcdeé 漢\n", k=rnd.choice([0, 1, 3, 40, 900])))) for i in range(60)]
    rows += [(9, "same"), (9, "same"), (9, None), (None, "no id é"), (None, None), (5000, "x" * 300_000)]
    df = documents(spark, rows).withColumnRenamed("n_chars", "fingerprint")
    check(rows, fp.fingerprint_documents(df).collect())
    check(rows[:1], fp.fingerprint_documents(documents(spark, rows[:1])).collect())
    assert fp.fingerprint_documents(df.limit(0)).count() == 0


def test_query_on_given_texts(spark):
    got = QUERIES["op3_fingerprints"](spark, SF).collect()
    check(given_documents(), got)
    long = [r for r in got if r.n_chars > 800]
    assert min(r.near_edited for r in long) > 0.5 and sorted(r.near_next for r in long)[len(long) // 2] == 0


def test_insertions_shift_nothing():
    rnd = random.Random(4)
    text = "".join(rnd.choices("abcdefgh ", k=20_000))
    assert fp.likeness(slow(text), slow("inserted " + text)) > 0.97
