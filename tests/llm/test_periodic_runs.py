import random
import time
import zlib

import numpy as np
import pytest
from support import SF, WORD, documents, given_documents, sha

from wavetrail.llm import periodic_runs as pr
from wavetrail.llm.registry import QUERIES


def brute(words, least=12):
    """Every maximal stretch of each lag; a stretch stays if no smaller lag is a period of it."""
    n, out = len(words), {}
    for lag in range(1, n // 2 + 1):
        i = lag
        while i < n:
            if words[i] != words[i - lag]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - lag]:
                i += 1
            if i - begin + lag >= max(least, 2 * lag):
                out.setdefault((begin - lag, i), lag)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text):
    words = edited(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words), len(gone))


def check(spark, rows, parts=3):
    df = documents(spark, rows, parts).withColumnRenamed("n_chars", "start").withColumnRenamed("lang", "period")
    got = sorted(repr(tuple(r)) for r in pr.collapse_runs(df, pr.repeat_tail).collect())
    assert got == sorted(repr(row(*r)) for r in rows)


def found(texts, least=12):
    ids = np.array([hash(w) for t in texts for w in t], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    start, end, period = pr.runs_of(ids, bounds, least)
    return sorted((int(s), int(e - s), int(q)) for s, e, q in zip(start, end, period))


@pytest.mark.parametrize("seed", range(6))
def test_symbols_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randrange(1, 4)):
            words = []
            while len(words) < rnd.randrange(1, 300):
                piece = rnd.choices("ab" if rnd.random() < 0.5 else "abcdefghij", k=rnd.randrange(1, 40))
                words += (piece * rnd.randrange(1, 6))[: rnd.randrange(1, 140)]
            texts.append(words)
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in brute(t)]
            at += len(t)
        assert found(texts) == sorted(want)


def test_fibonacci_and_neighbouring_texts():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    assert found([list(b)]) == brute(list(b)) and len(brute(list(b))) > 50
    assert found([list("ab" * 5), list("ab" * 5)]) == []  # a run never crosses texts
    assert found([list("ab" * 6), [], list("x" * 12)]) == [(0, 12, 2), (12, 12, 1)]


def test_given_and_edited_documents_equal_brute_force(spark):
    rows = [(i, t) for i, t in given_documents() if len((t or "").split()) < 1200]
    check(spark, rows)
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(given_documents())
    assert all(got[i] == row(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x " * 30), (None, None), (3, "a b c d " * 3), (3, "a b c d " * 3), (4, " \t\n\x0b\x0c\r"), (5, "é\x1cü é ü " * 9)]
    rows += [(i, "x y " * 10) for i in range(40)]
    check(spark, rows)
    assert pr.collapse_runs(documents(spark, rows).limit(0)).count() == 0
    assert sorted(tuple(r) for r in pr.find_runs(documents(spark, rows[:6])).collect() if r.doc_id) == [(3, 0, 12, 4)] * 2


def test_long_texts_take_little_time():
    """One word, two blocks of one word, words that come back at every second place: no lag is followed in vain."""
    n = 300_000
    start = time.monotonic()
    assert found([["w"] * n]) == [(0, n, 1)]
    assert found([["w"] * n + ["x"] + ["w"] * n]) == [(0, n, 1), (n + 1, n, 1)]
    assert found([(["w"] * n + ["x"]) * 2]) == [(0, n, 1), (0, 2 * n + 2, n + 1), (n + 1, n, 1)]
    bars = [w for i in range(n) for w in ("|", str(i))]
    assert found([bars]) == []
    assert found([[str(i % 1000) for i in range(n)]]) == [(0, n, 1000)]
    assert time.monotonic() - start < 60
