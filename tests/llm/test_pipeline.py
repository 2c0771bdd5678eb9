import random

import corpus_pipeline as cp
from pyspark.sql import functions as F
from support import SF, WORD, documents
from test_decontamination import leaks
from test_jaccard_join import brute
from test_mixing import fill

from wavetrail.llm import batches, decontamination, jaccard_join, language_id, secret_scan
from wavetrail.llm.work import BATCH_BYTES

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def as_rows(df):
    return [tuple(r) for r in df.select(*DOCUMENT).collect()]


def key(rows):
    return sorted(map(repr, rows))


def test_stages_equal_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    start = as_rows(docs)
    verdict = {r.doc_id: r.kept for r in language_id.identify_documents(docs).collect()}
    frame = spark.createDataFrame(start, docs.schema)

    kept = as_rows(cp.language_stage(spark, frame, SF))
    assert key(kept) == key([r for r in start if verdict[r[0]]])

    similar = as_rows(cp.similar_stage(spark, spark.createDataFrame(kept, docs.schema), SF))
    component = {doc: name for doc, _, name, _ in map(eval, brute([(r[0], r[1]) for r in kept]))}
    assert key(similar) == key([r for r in kept if component[r[0]] == r[0]])

    clean = as_rows(cp.benchmark_stage(spark, spark.createDataFrame(similar, docs.schema), SF))
    hit = {doc for doc, _, _ in leaks([(r[0], r[1]) for r in similar], items)}
    assert hit and key(clean) == key([r for r in similar if r[0] not in hit])

    clean[0] = (clean[0][0], "secret: abcdefgh1 " + clean[0][1], *clean[0][2:])
    safe = as_rows(cp.secret_stage(spark, spark.createDataFrame(clean, docs.schema), SF))
    want = [(r[0], secret_scan.blanked(r[1]), *r[2:4], r[4] if secret_scan.blanked(r[1]) == r[1] else len(secret_scan.blanked(r[1]))) for r in clean]
    assert key(safe) == key(want) and want != clean

    mixed = cp.mixing_stage(spark, spark.createDataFrame(safe, docs.schema), SF).collect()
    sizes = {}
    for r in safe:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    target = fill(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(sorted(sizes))}, 1.5)
    taken = dict.fromkeys(sizes, 0)
    by_id = {r[0]: r for r in safe}
    for r in mixed:
        assert tuple(r)[:5] == by_id[r.doc_id] and 0 < r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 + 1e-6 for s in sizes)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert key(map(tuple, cp.run(spark, SF).collect())) == key(map(tuple, docs.collect()))


def test_odd_rows_pass_every_stage(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["the", "of", "and", "ander", "thing", "er"], k=30))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (50, "password=abcdefgh1 " + rows[7][1] + " end")]
    df = documents(spark, rows)
    for name, stage in cp.STAGES:
        out = stage(spark, df, SF)
        assert out.columns[:5] == DOCUMENT, name
        assert out.count() <= len(rows) and (name == "language ID" or out.count() > 0), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    kept = [r.doc_id for r in cp.similar_stage(spark, df, SF).collect()]
    assert kept.count(3) == 1 and kept.count(2) == 2  # one of them is the empty text
    assert "abcdefgh1" not in str(cp.secret_stage(spark, df, SF).filter(F.col("doc_id") == 50).collect())


def test_similar_stage_shuffles_only_texts_that_may_go_and_leaves_no_sets(spark, monkeypatch):
    from pathlib import Path

    from wavetrail.llm import jaccard_join, work

    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(40))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)] + [(None, rows[30][1]), (1000, "another text of the same id"), (2000, None)]
    df = documents(spark, rows)
    written, plain = {}, work.materialise

    def kept(frame, name):
        out = plain(frame, name)
        written[name] = [Path(f.removeprefix("file:")).parent for f in out.inputFiles()[:1]]
        return out

    merged, join = [], type(df).join

    def seen(self, other, *a, **b):
        if "text" in self.columns and a and isinstance(a[-1], str) and a[-1] == "left_anti":
            merged.append(self.count())
        return join(self, other, *a, **b)

    for module in (work, jaccard_join, cp):
        monkeypatch.setattr(module, "materialise", kept)
    monkeypatch.setattr(type(df), "join", seen)
    stayed = as_rows(cp.similar_stage(spark, df, SF))
    gone = [(1000 + i, rows[i][1] + " more") for i in range(20)] + [(None, rows[30][1])]
    assert sorted(map(repr, (r[:2] for r in stayed))) == sorted(map(repr, (r for r in rows if r not in gone)))
    assert merged and 21 <= merged[0] < 60
    assert written["jaccard-sets"] and written["jaccard-shared"]
    assert not any(f.exists() for name in ("jaccard-sets", "jaccard-shared") for f in written[name])


def test_a_sieve_lets_every_key_pass(spark, monkeypatch):
    from wavetrail.llm import work

    keys = spark.range(5000).selectExpr("CASE WHEN id > 0 THEN id * 7 END AS k")
    rows = spark.range(70000).selectExpr("CASE WHEN id > 0 THEN id END AS id", "'x' AS text")
    held = F.expr("id IS NULL OR (id % 7 = 0 AND id < 35000)")
    for most in (work.SIEVE_MOST, 1 << 15):
        monkeypatch.setattr(work, "SIEVE_MOST", most)
        out = work.sifted(rows, F.xxhash64("id"), keys, F.xxhash64("k"), "sieve")
        assert out.columns == ["id", "text", "_may"] and out.count() == 70000
        assert out.filter(held & ~F.col("_may")).isEmpty()
        assert (out.filter("_may").count() < 12000) == (most > 1 << 15)
    none = work.sifted(rows, F.xxhash64("id"), keys.limit(0), F.xxhash64("k"), "sieve")
    assert none.filter("_may").isEmpty() and none.count() == 70000


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    """One partition of 8 MB reaches Python in batches of 2 MB, not whole, and in pieces of 256 KB."""

    def strict(batch, *more):
        assert batch.nbytes < 3 << 20, batch.nbytes
        return batches.slices(batch, *more)

    def strict_pieces(offsets, *more):
        for low, high in batches.pieces(offsets, *more):
            assert high == low + 1 or offsets[high] - offsets[low] <= 1 << 18
            yield low, high

    spark.conf.unset(BATCH_BYTES)
    words = F.transform(F.sequence(F.lit(0), F.lit(150)), lambda i: F.substring(F.sha2((F.col("id") * 1000 + i).cast("string"), 256), 1, 12))
    docs = spark.range(0, 4000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"), F.lit(1962).cast("long").alias("n_chars"),
    )
    for module in (language_id, jaccard_join, decontamination, secret_scan):
        monkeypatch.setattr(module, "slices", strict)
        if hasattr(module, "pieces"):
            monkeypatch.setattr(module, "pieces", strict_pieces)
    try:
        for _, stage in cp.STAGES[:4]:
            spark.conf.unset(BATCH_BYTES)
            assert stage(spark, docs, SF).count() == 4000
        spark.conf.set(BATCH_BYTES, "1m")
        cp.secret_stage(spark, docs, SF)
        assert spark.conf.get(BATCH_BYTES) == "1m"  # a session's own limit holds
    finally:
        spark.conf.unset(BATCH_BYTES)
