import math
import random
import re

from check import compare, connect
from pyspark.sql import functions as F
from support import SF, documents

from wavetrail.llm import license_scan as ls
from wavetrail.llm.registry import ORACLES, QUERIES


def test_query_equals_sql(spark):
    state, note = compare(spark, connect(SF), "op8_license_scan", SF, QUERIES, ORACLES)
    assert state == "ok", note


def words(text):
    return [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]


def test_blocks_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        text = []
        for _ in range(rnd.randrange(4)):
            text += rnd.choices(["foo", "bar", "the", "of", "license"], k=rnd.randrange(80))
            notice = rnd.choice(ls.TEMPLATES)[1].split()
            text += [w for w in notice if rnd.random() < 0.88]
        rows.append((i, " ".join(text)))
    frame = documents(spark, rows).select("doc_id", ls.words_of(F.col("text")).alias("words"))
    got = {(r.doc_id, r.block, r.template): r.containment for r in ls.contained_templates(frame, ["doc_id"]).collect()}
    want = {}
    for i, text in rows:
        w = words(text)
        for start in range(0, max(0, len(w) - 49) + 1, 48):
            block = set(w[start : start + 96])
            for n, (_, t) in enumerate(ls.TEMPLATES):
                own = set(t.split())
                if len(block & own) >= math.ceil(0.8 * len(own) - 1e-9):
                    want[i, start, n] = len(block & own) / len(own)
    assert got == want and len(want) > 50


def test_places_nulls_and_ties(spark):
    a = "Under the MIT-License under the mit license! é cc by nc"
    rows = [(1, a), (1, a), (1, "other"), (2, None), (3, ""), (None, "Apache License, Version 2"), (4, "word " * 60_000 + "cc by nc")]
    df = documents(spark, rows).withColumn("words", F.lit(1)).withColumn("labels", F.lit(1))
    out = {(r.doc_id, r.n_words): r for r in ls.scan_licenses(df).collect()}
    assert ls.scan_licenses(df).count() == len(rows)
    r = out[1, 12]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 0, 9, "cc-by-nc,mit", 1.0)
    assert (out[1, 1].n_base, out[1, 1].first_word, out[1, 1].labels, out[1, 1].score) == (0, None, "", 0.0)
    assert out[2, 0].n_base == out[3, 0].n_base == 0
    assert out[None, 4].base_labels == "apache-2"
    assert out[4, 60_003].first_word == 60_000
    assert ls.scan_licenses(df.limit(0)).count() == 0
