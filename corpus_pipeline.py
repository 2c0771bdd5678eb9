"""A corpus in five stages: each works on all that the one before it kept, and is written before the next one reads it.

1. language ID drops documents that no language fits;
2. the n-gram Jaccard join keeps one document of each group of similar ones, the one of least id;
3. benchmark decontamination drops documents that hold a benchmark item or its template;
4. the secret scan blanks what it found, in place;
5. the mix says how many words of each document it takes; documents it takes nothing of go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm import decontamination, jaccard_join, language_id, mixing, secret_scan
from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise, sifted, small_batches

#: Stands for null in keys, so that joins are plain equi joins.
NO_ID = -(1 << 63)


def _with_key(frame: DataFrame, row_key: Column | str) -> DataFrame:
    key = F.col(row_key) if isinstance(row_key, str) else row_key
    return frame.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_key", key)


def _without(docs: DataFrame, row_key: Column, rejected: DataFrame, name: str, share: bool = False) -> DataFrame:
    """Rows whose (doc_id, row_key) is not rejected.

    The rejected keys are written first, so Spark broadcasts them only if they are few; where a share of all documents goes, those
    that may be rejected are told by a sieve, and only they are shuffled for a merge join.
    """
    keys = materialise(_with_key(rejected, "row_key").select("_id", "_key").distinct(), name)
    keyed = _with_key(docs, row_key)
    if not share:
        return keyed.join(keys, ["_id", "_key"], "left_anti").select(*docs.columns)
    sure = sifted(keyed, F.xxhash64("_id", "_key"), keys, F.xxhash64("_id", "_key"), f"{name}-sieve")
    left = sure.filter("_may").hint("merge").join(keys, ["_id", "_key"], "left_anti")
    return sure.filter("NOT _may").select(*docs.columns).unionByName(left.select(*docs.columns))


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _without(docs, language_id.row_key(), language_id.identify_documents(docs).filter("NOT kept"), "language-rejected")


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays; of rows that equal in id and text, too. Documents without words stay."""
    small_batches(spark)
    found = materialise(jaccard_join.join_similar(docs).filter("n_shingles > 0"), "similar")
    # the least id has the component's name; among texts of that id the least key stays
    first = found.filter("doc_id = component_id").groupBy(F.col("component_id").alias("_component")).agg(F.min("row_key").alias("_first"))
    placed = found.join(first, F.col("component_id") == F.col("_component"), "left")
    stays = (F.col("doc_id").isNull() & F.col("component_id").isNull()) | ((F.col("doc_id") == F.col("component_id")) & (F.col("row_key") == F.col("_first")))
    kept = _without(docs, _text_key(), placed.filter(~F.coalesce(stays, F.lit(False))), "similar-rejected", share=True)
    doubles = materialise(_with_key(found, "row_key").groupBy("_id", "_key").count().filter("count > 1").select("_id", "_key"), "similar-doubles")
    if doubles.isEmpty():
        return kept
    keyed = _with_key(kept, _text_key())
    single = keyed.join(doubles, ["_id", "_key"], "left_anti")
    return single.unionByName(keyed.join(doubles, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    leaks = decontamination.find_held(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, _text_key(), leaks, "benchmark-leaks")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, size, target (of the source) and taken, for documents of which the mix takes words."""
    mixed = mixing.mix(docs, mixing.repeating_weights(docs))
    # rows that equal in id and text are told apart by their place in a list
    lists = _with_key(mixed.filter("taken > 0"), "row_key").groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("source_key", "taken", "size", "target"))).alias("_mixed"))
    row = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(mixing.source_key(F.col("source"))))
    placed = _with_key(docs, _text_key()).withColumn("_row", row).join(lists, ["_id", "_key"])
    placed = placed.filter(F.col("_row") <= F.size("_mixed")).withColumn("_one", F.element_at("_mixed", F.col("_row")))
    return placed.select(*docs.columns, F.col("_one.size").alias("size"), F.col("_one.target").alias("target"), F.col("_one.taken").alias("taken"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", similar_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The language model, hashed sets and decoded layers have no SQL; the tests hold run() against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
