import random

import pytest
from support import SF, WORD, documents, given_documents, sha

from wavetrail.llm import relative_parse, repeats, suffix_dedup
from wavetrail.llm.registry import QUERIES


def by_bytes(rows):
    docs = sorted(((2**63 if i is None else i), k, i, (t or "").encode()) for k, (i, t) in enumerate(rows))
    first = {}
    for place, k, _, b in docs:
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (place, k, s))
    out = []
    for place, k, i, b in docs:
        gone = bytearray(len(b))
        seen = set()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if first[w][0] < place or w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, __import__("hashlib").sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def by_words(rows):
    docs = [((2**63 if i is None else i), i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for place, _, w in docs:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(place, first.get(key, place))
    out = []
    for place, i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < place:
                gone[s : s + 50] = [True] * 50
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(map(repr, out))


def check_both(spark, rows, parts=3):
    df = documents(spark, rows, parts).withColumnRenamed("n_chars", "place").withColumnRenamed("lang", "marks")
    assert sorted(repr(tuple(r)) for r in suffix_dedup.remove_repeats(df).collect()) == by_bytes(rows)
    assert sorted(repr(tuple(r)) for r in relative_parse.remove_copied_words(df).collect()) == by_words(rows)


@pytest.mark.parametrize("crowd", [50_000, 6])
def test_mosaics(spark, monkeypatch, crowd):
    """Texts pasted from common pieces, cut at any place, with repeats inside and periodic parts."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rnd = random.Random(3)
    vocabulary = ["a", "bc", "déf", "g", "hij", "漢", "klm\n", "no.", "p"]
    pool = [" ".join(rnd.choices(vocabulary, k=220)) for _ in range(6)] + ["ab " * 90, "z" * 330]
    rows = []
    for i in range(70):
        text = ""
        for _ in range(rnd.randrange(5)):
            piece = rnd.choice(pool)
            a = rnd.randrange(len(piece))
            text += piece[a : a + rnd.randrange(700)] + rnd.choice(["", " ", "q ", "\t"])
        rows.append((rnd.randrange(500), text))
    rows += [(7, pool[0]), (7, pool[0]), (7, pool[0] + "x"), (None, pool[1]), (None, pool[1]), (501, None), (502, ""), (503, pool[0] * 3)]
    check_both(spark, rows)


@pytest.mark.parametrize("crowd", [50_000, 20])
def test_one_trigger_many_contexts(spark, monkeypatch, crowd):
    """The same line in all documents, with other neighbours: edges decide."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rnd = random.Random(8)
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(i, " ".join(rnd.choices("abcde", k=30)) + " " + line + " " + " ".join(rnd.choices("ab", k=30))) for i in range(120)]
    check_both(spark, rows, 8)


def test_long_texts_are_cut_alike(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    rnd = random.Random(5)
    long = " ".join("".join(rnd.choices("abcdef", k=3)) for _ in range(1500))
    rows = [(1, long), (2, "other start " + long[777:4000] + long[100:900]), (3, long[3000:]), (4, long)]
    check_both(spark, rows, 2)


def test_empty_tables(spark):
    df = documents(spark, [(1, "x")]).limit(0)
    assert suffix_dedup.remove_repeats(df).count() == relative_parse.remove_copied_words(df).count() == 0


@pytest.mark.parametrize("name, brute", [("op2_suffix_dedup", by_bytes), ("op9_relative_parse", by_words)])
def test_queries_on_given_texts(spark, name, brute):
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).collect()) == brute(given_documents())
