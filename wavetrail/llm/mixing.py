"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream of its documents in hashed order, cut into blocks of equally many words. The points frac(i * golden ratio),
mapped through the cumulative target shares, say which source slot i takes from, so every stretch of the mix is close to the target
weights. The slots of a source are ranked, and rank r takes block r of its stream (again from the start once the stream is
used up). A source stops at its target: its last slot is cut. `mixed_sequence` joins slots and streams: it says which words of which document
stand at which position of the mix, and what the mix takes of a document is the sum of its pieces there.

Running totals and ranks are taken in two levels (hashed buckets of a stream, stretches of slots), so no source is ordered by one
task, however large it is. The same input always gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise

#: The words of one slot.
BLOCK_WORDS = 4096
#: Buckets of a source's stream (hexadecimal digits of the hash), slots of a stretch, cells of the unit interval.
BUCKET_DIGITS, STRETCH, CELLS = 3, 1 << 16, 1024
GOLDEN = 0.6180339887498949
#: The share of all words that the mix has, and how often a source's words may repeat.
BUDGET, REPEATS = 1.5, 2
SEED = "mix"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null: sources in order of code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sources: DataFrame, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Adds `target` to (key, source_size, weight): `budget` times all words, dealt by weight, at most `repeats` times a source's words.

    What is above a source's limit is dealt again by weight among the others, until none is above.
    """
    limit = repeats * F.col("source_size")
    level = 0.0
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = limit < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, limit).otherwise(0)).alias("used"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row.weight:
            break
        higher = (budget * words - row.used) / row.weight
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def streams(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, key, size, start): where each document's words start in its source's stream."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = documents.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** BUCKET_DIGITS rows
    bases = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("digest", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(bases, ["key", "bucket"]).select("doc_id", "row_key", "key", "size", (F.col("base") + F.col("inner")).alias("start"))


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(position, key, rank, block, start, stop) of every slot, from (key, source_size, target).

    start and stop are words of the source's stream. Positions order the mix and no two slots share one; slots that the points leave out
    follow after all points, and points that a used up source would get are left out, so positions have gaps.
    """
    size, words = F.col("source_size"), F.floor("target")
    plan = (
        sources.filter((size > 0) & (words > 0))
        .withColumn("blocks", F.ceil(size / block))
        .withColumn("passes", F.floor(words / size))
        .withColumn("rest", words - F.col("passes") * size)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )
    plan = plan.withColumn("upto", F.sum("slots").over(Window.orderBy("key")))  # one row per source
    total = plan.agg(F.max("upto")).first()[0] or 0
    intervals = plan.select(
        "key", "source_size", "blocks", "passes", "rest", "slots", (F.col("upto") - F.col("slots")).alias("before"),
        ((F.col("upto") - F.col("slots")) / F.lit(float(max(total, 1)))).alias("low"), (F.col("upto") / F.lit(float(max(total, 1)))).alias("high"),
    )
    cells = intervals.select("key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("position"), ((F.col("id") + 1) * F.lit(GOLDEN)).alias("x"))
    points = points.select("position", (F.col("x") - F.floor("x")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = points.join(cells, "cell").filter((F.col("low") <= F.col("x")) & (F.col("x") < F.col("high")))
    drawn = drawn.select("position", "key", F.floor(F.col("position") / STRETCH).alias("stretch"))
    counts = drawn.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("key", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("key", "stretch").orderBy("position")) - 1
    ranked = drawn.withColumn("inner", rank).join(bases, ["key", "stretch"]).select("position", "key", (F.col("base") + F.col("inner")).alias("rank"))
    drawn_of = counts.groupBy("key").agg(F.sum("n").alias("drawn"))
    missing = (
        intervals.join(drawn_of, "key", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .filter(F.col("drawn") < F.col("slots"))
        .select("key", "before", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank"))
        .select((F.lit(total) + F.col("before") + F.col("rank")).alias("position"), "key", "rank")
    )
    start = F.col("block") * block
    stop = F.least(start + block, F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), F.col("source_size")).otherwise(F.col("rest")))
    return (
        ranked.unionByName(missing)
        .join(intervals, "key")
        .filter(F.col("rank") < F.col("slots"))
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .select("position", "key", "rank", "block", start.alias("start"), stop.alias("stop"))
    )


def _placed(documents: DataFrame, weights: DataFrame, budget: float, repeats: int) -> tuple[DataFrame, DataFrame]:
    """The documents in their streams, and the sources with their targets, both written."""
    text = F.col("text").cast("string")
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), source_key(F.col("source")).alias("key"), count_words(text).alias("size"))
    sized = materialise(sized, "mixing-sizes")
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    totals = totals.join(weights.select("key", F.col("weight").cast("double").alias("weight")), "key", "left").fillna(0.0, ["weight"])
    targets = materialise(source_targets(materialise(totals, "mixing-sources"), budget, repeats), "mixing-targets")
    return materialise(streams(sized), "mixing-streams"), targets


def _sequence(placed: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """(position, start_word, doc_id, row_key, key, start, first_word, last_word): the pieces of documents that the slots hold."""
    slots = schedule(placed.sparkSession, targets, block).select("position", "key", "block", F.col("start").alias("slot_start"), F.col("stop").alias("slot_stop"))
    end = F.col("start") + F.col("size")
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = placed.filter(F.col("size") > 0).withColumn("end", end).withColumn("block", F.explode(touched))
    low, high = F.greatest("start", "slot_start"), F.least("end", "slot_stop")
    return (
        pieces.join(slots, ["key", "block"])
        .filter(low < high)
        .select("position", (low - F.col("slot_start")).alias("start_word"), "doc_id", "row_key", "key", "start", (low - F.col("start")).alias("first_word"), (high - F.col("start") - 1).alias("last_word"))
    )


def mixed_sequence(documents: DataFrame, weights: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """(position, start_word, doc_id, row_key, source_key, first_word, last_word): the mix itself, in order of (position, start_word).

    Words first_word to last_word of a document (from 0) stand in the slot of that position from its word start_word on. Slots are full
    but for the last block of a stream and the last slot before a target. Input and odd rows as in `mix`; nothing is ordered as a whole.
    """
    placed, targets = _placed(documents, weights, budget, repeats)
    return _sequence(placed, targets, block).drop("start").withColumnRenamed("key", "source_key")


def mix(documents: DataFrame, weights: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, row_key, source_key, size, source_size, target, taken, first_position, last_position): each document's part of the mix.

    documents: doc_id, source, text; other columns are ignored. weights: key (see `source_key`) and weight, one row per source; a
    source without a weight has a target of 0. Positions are those of the first and last slot with a piece of the document, null if
    nothing is taken. Null text has size 0, null source is a source, repeated rows are documents of their own, no rows give no rows.
    """
    placed, targets = _placed(documents, weights, budget, repeats)
    taken = (
        _sequence(placed, targets, block)
        .groupBy(F.col("key").alias("taken_key"), F.col("start").alias("taken_start"))  # one document, since its size is not 0
        .agg(
            F.sum(F.col("last_word") - F.col("first_word") + 1).alias("taken"),
            F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        )
    )
    return (
        placed.join(taken, (F.col("size") > 0) & (F.col("key") == F.col("taken_key")) & (F.col("start") == F.col("taken_start")), "left")
        .join(targets.select("key", "source_size", "target"), "key")
        .select(
            "doc_id", "row_key", F.col("key").alias("source_key"), "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_position", "last_position",
        )
    )


def repeating_weights(documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(key, weight): the weights in turn, for the sources by code point, null last."""
    sources = documents.select(source_key(F.col("source")).alias("key")).distinct()
    place = F.row_number().over(Window.orderBy("key")) - 1  # one row per source
    return sources.select("key", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("weight"))


_SQL = f"""
WITH d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
        CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), s AS (
    SELECT key, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY key
), o AS (
    SELECT *, sum(2 * source_size) OVER w AS used, sum(weight) OVER () - sum(weight) OVER w AS open,
        {BUDGET} * sum(source_size) OVER () AS words, 2 * source_size / weight AS ratio
    FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, key ROWS UNBOUNDED PRECEDING)
), l AS (
    SELECT max(level) AS level FROM (
        SELECT words / (open + 0) AS level FROM (SELECT any_value(words) AS words, sum(weight) AS open FROM o)
        UNION ALL SELECT (words - used) / open FROM o WHERE open > 0 AND ratio < (words - (used - 2 * source_size)) / (open + weight)
    )
), t AS (
    SELECT key, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM s, l
), p AS (
    SELECT d.*, coalesce(sum(size) OVER (PARTITION BY key ORDER BY substr(md5('{SEED}:' || doc_id), 1, {BUCKET_DIGITS}), md5('{SEED}:' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), q AS (
    SELECT key, source_size AS n, floor(target)::BIGINT // greatest(source_size, 1) AS passes, floor(target)::BIGINT % greatest(source_size, 1) AS rest,
        (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
    FROM t WHERE source_size > 0 AND floor(target) > 0
), i AS (
    SELECT key, blocks, slots, CAST(sum(slots) OVER (ORDER BY key) AS BIGINT) AS upto, CAST(sum(slots) OVER () AS BIGINT) AS total
    FROM (SELECT *, passes * blocks + (rest + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS slots FROM q)
), x AS (
    SELECT position, y - floor(y) AS x
    FROM (SELECT range AS position, CAST(range + 1 AS DOUBLE) * CAST({GOLDEN} AS DOUBLE) AS y FROM range((SELECT coalesce(max(total), 0) FROM i)))
), r AS (
    SELECT key, position, row_number() OVER (PARTITION BY key ORDER BY position) - 1 AS rank
    FROM x JOIN i ON CAST(upto - slots AS DOUBLE) / CAST(total AS DOUBLE) <= x AND x < CAST(upto AS DOUBLE) / CAST(total AS DOUBLE)
), z AS (
    SELECT key, position, rank FROM r
    UNION ALL
    SELECT key, total + upto - slots + rank, rank
    FROM (SELECT *, unnest(range(drawn, slots)) AS rank FROM i JOIN (SELECT i.key, count(r.key) AS drawn FROM i LEFT JOIN r USING (key) GROUP BY i.key) USING (key))
), f AS (
    SELECT p.*, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
        size * (floor(target)::BIGINT // greatest(source_size, 1))
        + greatest(0, least(start + size, floor(target)::BIGINT % greatest(source_size, 1)) - start) END AS BIGINT) AS taken,
        start // {BLOCK_WORDS} AS first_rank,
        CASE WHEN rest > start THEN passes * blocks + (least(start + size, rest) - 1) // {BLOCK_WORDS}
            ELSE (passes - 1) * blocks + (start + size - 1) // {BLOCK_WORDS} END AS last_rank
    FROM p JOIN t USING (key) LEFT JOIN q USING (key)
)
SELECT doc_id, size, source_size, target, taken,
    CASE WHEN taken > 0 THEN a.position END AS first_position, CASE WHEN taken > 0 THEN b.position END AS last_position
FROM f LEFT JOIN z a ON a.key = f.key AND a.rank = first_rank LEFT JOIN z b ON b.key = f.key AND b.rank = last_rank
"""


@query("op7_source_mix", _SQL)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mix(documents, repeating_weights(documents)).drop("row_key", "source_key")
