"""Language identification by fusing evidence.

Four kinds of evidence are combined by Bayes' rule: the likelihood of the text's byte trigrams, the language that the markup (or a
column) declares, the suffix of the address, and the host. Host priors are smoothed in a hierarchy, host towards suffix towards all
documents, from counts that grouped aggregation takes over every document. What a declaration is worth is learned the same way,
from how often it agrees with the text.

The trigram model has a class for every language that any document is labelled with; labels of one language that differ in case,
region or script are one. It is fitted on a bounded sample: at most ``FIT_PER_LANGUAGE`` labelled documents of each language, those of
least hash. Everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.batches import LOWER, pieces, slices, utf8
from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise

FIT_PER_LANGUAGE = 500
#: Hashed trigrams of the model, what is added to each count, and the weight of one trigram's evidence (neighbours overlap).
BUCKETS, ADDED, TEMPER = 1 << 13, 0.5, 0.1
#: Documents' worth of the wider level in a host's or suffix's prior, and of the overall share in what a declaration tells.
HOST_STRENGTH, DECLARED_STRENGTH = 10.0, 10.0
#: Documents below this posterior are rejected.
LEAST_POSTERIOR = 0.5

#: Letters, spaces and bytes of other scripts; numbers, addresses and signs say nothing about a language.
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[0x20, *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte trigram of letters and spaces, A-Z lowered; none crosses rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wordy = _WORDY[data]
    inside = (rows[:-2] == rows[2:]) & wordy[:-2] & wordy[1:-1] & wordy[2:]
    return bucket[inside].astype(np.int64), rows[:-2][inside]


def normal(label: Column) -> Column:
    """The language of a label: its first part, in lower case ('EN' and 'en-US' are 'en'); null if that is empty."""
    return F.nullif(F.lower(F.regexp_extract(label.cast("string"), "^\\s*([^\\s_-]*)", 1)), F.lit(""))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket in each, from (doc_id, text, language); rows without doc_id are not fitted."""
    rows = labelled.withColumn("language", normal(F.col("language"))).filter(F.col("language").isNotNull())
    counts = {r.language: r["count"] for r in rows.groupBy("language").count().collect()}  # one row a language
    languages = sorted(counts)
    # of n documents, those with a hash in the first 4 * FIT_PER_LANGUAGE / n of its range hold the least ones and are few
    span = 1 << 40
    limits = [F.lit(x) for name, n in counts.items() for x in (name, min(span, 4 * FIT_PER_LANGUAGE * span // n))]
    near = F.coalesce(F.try_element_at(F.create_map(*limits), F.col("language")), F.lit(0)) if limits else F.lit(0)
    hashed = rows.select("doc_id", "language", F.pmod(F.xxhash64("doc_id"), F.lit(span)).alias("hash")).filter(F.col("hash") < near)
    place = F.row_number().over(Window.partitionBy("language").orderBy("hash", "doc_id"))
    chosen = hashed.withColumn("place", place).filter(F.col("place") <= FIT_PER_LANGUAGE)
    chosen = chosen.select("doc_id", "language").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            data, offsets = utf8(batch.column(0))
            of_row = np.array(batch.column(1).to_pylist(), dtype=object)
            for low, high in pieces(offsets):
                bucket, row = trigrams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for name in set(of_row[low:high]):
                    own = np.bincount(bucket[(of_row[low:high] == name)[row]], minlength=BUCKETS)
                    counts[name] = counts[name] + own if name in counts else own
        yield _vectors(counts)

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(part, np.int64) for part in parts.column("counts").to_pylist())
        return pa.Table.from_batches([_vectors({parts.column("language")[0].as_py(): total})])

    sample = rows.join(F.broadcast(chosen), ["doc_id", "language"], "left_semi")  # at most FIT_PER_LANGUAGE ids a language
    kind = "language string, counts binary"
    found = sample.select("text", "language").mapInArrow(count, kind).groupBy("language").applyInArrow(add, kind).collect()  # one row a language
    of = {r["language"]: np.frombuffer(r["counts"], np.int64) for r in found}
    counts = np.array([of.get(name, np.zeros(BUCKETS)) + ADDED for name in languages]).reshape(len(languages), BUCKETS)
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def _vectors(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in counts.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["language", "counts"])


def _softmax(logs: np.ndarray) -> np.ndarray:
    shifted = np.exp(logs - logs.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def likelihoods(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds n_grams, likelihood (log, one per language) and by_text (the shares that these alone give) to all columns but text."""
    kept = [c for c in documents.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            grams, sums = np.zeros(n, dtype=np.int64), np.zeros((n, len(model)))
            for low, high in pieces(offsets):
                bucket, row = trigrams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                grams[low:high] = np.bincount(row, minlength=high - low)
                for k, logs in enumerate(model):
                    sums[low:high, k] = np.bincount(row, weights=logs[bucket], minlength=high - low)
            columns = [*(batch.column(c) for c in kept), pa.array(grams), _lists(sums), _lists(_softmax(TEMPER * sums))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_grams", "likelihood", "by_text"])

    types = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.mapInArrow(score, f"{types}, n_grams long, likelihood array<double>, by_text array<double>")


def _totals(rows: DataFrame, keys: list[str], values: str, docs: Column) -> DataFrame:
    """(keys, docs, counts): documents and element sums of an array per group, added up before the exchange."""
    each = rows.select(*keys, docs.alias("docs"), F.posexplode(values).alias("k", "value"))
    sums = each.groupBy(*keys, "k").agg(F.sum("docs").alias("docs"), F.sum("value").alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("k", "value")))  # one element a language
    return sums.groupBy(*keys).agg(F.max("docs").alias("docs"), F.transform(listed, lambda x: x["value"]).alias("counts"))


def _fused(languages: list[str]):
    """Posterior, best languages and fit from likelihoods, priors and what the declaration tells, one pass over each batch."""
    names = pa.array(languages, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, by_text, prior, given = (
                np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, len(languages)) for c in ("likelihood", "by_text", "prior", "given")
            )
            if not batch.num_rows:
                continue
            fused = _softmax(TEMPER * logs + np.log(prior) + np.log(given))
            grams, posterior = np.asarray(batch.column("n_grams")), fused.max(axis=1)
            mean = np.where(grams > 0, logs.max(axis=1) / np.maximum(grams, 1) + np.log(BUCKETS), 0.0)
            columns = [
                batch.column("doc_id"), batch.column("row_key"), names.take(pa.array(fused.argmax(axis=1))), names.take(pa.array(by_text.argmax(axis=1))),
                batch.column("declared"), pa.array(posterior), pa.array(mean), pa.array((posterior >= LEAST_POSTERIOR) & (mean > 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "lang", "text_lang", "declared", "posterior", "fit", "kept"])

    return run


def identify(documents: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, row_key, lang, text_lang, declared, posterior, fit, kept) for each document.

    documents: doc_id, row_key, text, declared, suffix, host; other columns are ignored. fit is the mean log likelihood of a trigram
    above a uniform one. kept is false where no language is likelier than LEAST_POSTERIOR, where the text fits the best language no
    better than chance, and for texts too short for one trigram. Null declared, suffix or host is no evidence of its own but shares the
    wider level; equal likelihoods take the first language; repeated rows are judged alike; no rows give no rows.
    """
    n = len(languages)
    # an address or host that is missing falls into its level's own group
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "row_key", F.col("text").cast("string").alias("text"), F.col("declared").cast("string").alias("declared"),
        F.coalesce(F.col("suffix").cast("string"), F.lit("")).alias("suffix"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"),
    )
    scored = materialise(likelihoods(rows, model), "language-scores")

    told = scored.filter("n_grams > 0")
    by_host = materialise(_totals(told, ["suffix", "host"], "by_text", F.lit(1)), "language-hosts")
    by_suffix = materialise(_totals(by_host, ["suffix"], "counts", F.col("docs")), "language-suffixes")
    total = _totals(by_suffix, [], "counts", F.col("docs")).first()
    docs = float(total.docs or 0)
    overall = [((c or 0.0) + 1.0) / (docs + n) for c in (total.counts or [0.0] * n)]

    def smoothed(counts: Column, number: Column, wider: Column) -> Column:
        return F.zip_with(counts, wider, lambda c, w: (c + HOST_STRENGTH * w) / (number + HOST_STRENGTH))

    suffixes = by_suffix.select("suffix", smoothed(F.col("counts"), F.col("docs"), F.array(*map(F.lit, overall))).alias("suffix_prior"))
    hosts = by_host.join(suffixes, "suffix").select("suffix", "host", smoothed(F.col("counts"), F.col("docs"), F.col("suffix_prior")).alias("host_prior"))
    of_declared = _totals(told.filter(F.col("declared").isNotNull()), ["declared"], "by_text", F.lit(1))
    declarations = of_declared.select(
        "declared",
        F.zip_with(
            "counts", F.array(*map(F.lit, [p * docs for p in overall])),
            lambda c, of_language: (c + DECLARED_STRENGTH * F.col("docs") / F.lit(max(docs, 1.0))) / (of_language + DECLARED_STRENGTH),
        ).alias("declared_given"),
    )
    # hosts and declarations are joined without a hint: broadcast if small at run time, else split where a host is hot
    joined = scored.join(hosts, ["suffix", "host"], "left").join(suffixes, "suffix", "left").join(declarations, "declared", "left")
    prior = F.coalesce("host_prior", "suffix_prior", F.array(*map(F.lit, overall)))
    given = F.coalesce("declared_given", F.array_repeat(F.lit(1.0), n))
    evidence = joined.select("doc_id", "row_key", "declared", "n_grams", "likelihood", "by_text", prior.alias("prior"), given.alias("given"))
    key_type = documents.schema["row_key"].dataType.simpleString()
    kind = f"doc_id long, row_key {key_type}, lang string, text_lang string, declared string, posterior double, fit double, kept boolean"
    return evidence.mapInArrow(_fused(languages), kind)


def document_evidence(documents: DataFrame) -> DataFrame:
    """The documents table: the lang column is the declaration, the source is the host, there is no address."""
    return documents.select(
        "doc_id", row_key(), "text", F.col("lang").cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host")
    )


def row_key() -> Column:
    return F.xxhash64("text", "lang", "source").alias("row_key")


def page_evidence(pages: DataFrame) -> DataFrame:
    """The pages table: the lang attribute of the markup, the suffix and host of the address; tags are no text."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", "(?i)<html[^>]*\\slang=[\"']?([a-z]+)", 1))
    text = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>|<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("doc_id"), F.xxhash64("url", "html").alias("row_key"), text.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), F.nullif(F.regexp_extract(host, "\\.([a-z]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
    )


def identify_documents(documents: DataFrame) -> DataFrame:
    """`identify` over a documents table, with a model fitted on its own labels; without any label nothing is known or kept."""
    languages, model = fit(documents.select("doc_id", "text", F.col("lang").cast("string").alias("language")))
    if not languages:
        languages, model = ["und"], np.full((1, BUCKETS), -np.log(BUCKETS))
    return identify(document_evidence(documents), languages, model)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents")).drop("row_key")


@query("op5b_page_languages")
def op5b_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the model of the documents, with markup, suffix and host as evidence."""
    documents = table(spark, sf_dir, "documents")
    languages, model = fit(documents.select("doc_id", "text", F.col("lang").alias("language")))
    return identify(page_evidence(table(spark, sf_dir, "pages")), languages, model).drop("row_key").withColumnRenamed("doc_id", "page_id")
