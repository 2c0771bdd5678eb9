import random
from collections import defaultdict

import numpy as np
from check import compare, connect
from support import SF, WORD, given_documents

from wavetrail.llm import quality_rules as qr
from wavetrail.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, kept int, windows string"


def test_query_equals_sql(spark):
    state, note = compare(spark, connect(SF), "op12_quality_rules", SF, QUERIES, ORACLES)
    assert state == "ok", note


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def concentrate(x, centre, cov):
    """Mean and covariance of the nearest three quarters, whole distance classes at a time."""
    diff = x - centre
    classes = np.floor(16 * np.log(1 + np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff)))
    limit = np.sort(classes)[max(0, int(np.ceil(0.75 * len(x))) - 1)]
    own = x[classes <= limit]
    return len(own), own.mean(0), np.cov(own.T, bias=True).reshape(5, 5)


def expected(rows):
    """(base counts, failed, distance) of each row, with dense linear algebra."""
    out, groups = [None] * len(rows), defaultdict(lambda: defaultdict(list))
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, lines, repeats = c = counts(text)
        failed = n < 10 or 100 * repeats > 20 * n
        out[k] = (*c, failed, None)
        if not failed:
            x = [np.log(1 + n)] + [np.log(1 + f * v / n) for f, v in ((1, chars), (100, symbols), (100, lines), (100, repeats))]
            groups[lang][source].append((k, np.round(np.array(x) * 1024)))
    ridge = np.diag((1024 * np.array([1.0, 0.15, 0.6, 0.7, 0.7])) ** 2)
    factor = qr.CONSISTENT
    for sources in groups.values():
        x = np.array([v for own in sources.values() for _, v in own])
        bins = np.sort(x // 64, axis=0)[(len(x) + 1) // 2 - 1]
        centre, cov = bins * 64 + 32, ridge
        for _ in range(4):
            n, e, v = concentrate(x, centre, cov)
            centre, cov = e, factor * v + ridge
        p, w = e, v
        for own in sources.values():
            x, c, s = np.array([v for _, v in own]), centre, cov
            for _ in range(4):
                n, e, v = concentrate(x, c, s)
                c, s = (n * e + 50 * p) / (n + 50), factor * (n * v + 50 * w) / (n + 50) + ridge
            for k, v in own:
                out[k] = (*out[k][:6], float((v - c) @ np.linalg.inv(s) @ (v - c)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = defaultdict(list)
    for r in qr.judge(df).collect():
        got[r.doc_id].append(r)
    want = defaultdict(list)
    for row, e in zip(rows, expected(rows)):
        want[row[0]].append(e)
    assert got.keys() == want.keys()
    for i in want:
        a = sorted((tuple(r)[1:7], -1.0 if r.distance is None else r.distance, r.kept) for r in got[i])
        b = sorted((e[:6], -1.0 if e[6] is None else e[6], e[6] is not None and e[6] <= qr.CUTOFF) for e in want[i])
        for (c1, d1, k1), (c2, d2, k2) in zip(a, b, strict=True):
            assert c1 == c2 and abs(d1 - d2) <= 1e-6 * (1 + abs(d2)) and k1 == k2


def test_made_texts_equal_dense_algebra(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(500):
        lang = rnd.choice(["en", "de", None])
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8))) for _ in range(rnd.randrange(5, 120))]
        kind = rnd.random()
        if kind < 0.08:
            words = [w + "%%%" for w in words]
        elif kind < 0.16:
            words = (words[:12] * 9)[: len(words)]
        elif kind < 0.2:
            words = [w * 9 for w in words]
        elif kind < 0.3:
            words[len(words) // 2 : len(words) // 2] = words[:6]
        for j in range(7, len(words), 11):
            words[j] += "\n"
        rows.append((i, " ".join(words), lang, rnd.choice(["a", "a", "a", "b", "c", None])))
    check(spark, rows)
    kept = [e for e in expected(rows) if e[6] is not None and e[6] > qr.CUTOFF]
    assert len(kept) > 10


def test_given_documents_and_odd_rows(spark):
    check(spark, [(i, t, "en", f"src{i % 3}") for i, t in given_documents()])
    long = " ".join(f"w{i}" for i in range(100_000)) + " a b c d e a b c d e"
    rows = [(1, None, None, None), (2, "", "en", ""), (None, "a b c d e f g h i j", "en", "s"), (3, long, "fr", "s"), (3, long, "fr", "s"), (4, "é " * 10, "", None)]
    check(spark, rows)
    assert qr.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_workers(spark):
    plan = qr.judge(spark.createDataFrame([(1, "a", "en", "s", 1, "x")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
