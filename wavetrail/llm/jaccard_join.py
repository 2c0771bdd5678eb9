"""N-gram Jaccard join by vertical partitioning.

Documents are sets of distinct word shingles; equal sets are one node. Two steps narrow the nodes down without losing a link:

* Of two linked sets, at most n - ceil(t * n) shingles of one are not in the other. Of each node's shingles the first ``REACH``, in the
  order of their hashes, are looked up in those of other nodes. Each side's extra shingles may come first, so both sides decide how many
  shared ones are among the first of both (`demand`); nodes that find fewer are linked with nothing.
* The shingles of the nodes left have one global order, from rare to frequent, by exact counts over all these nodes. Linked nodes share a
  shingle among the first n - ceil(t * n) + 1 of each. Shingles that one node alone has come first and meet nothing: they are only
  counted, and a node with too many of them goes. Nodes that share such a shingle are tied together into bundles, most of which are small.

Inside a bundle the global order is cut into fragments. In each fragment the overlaps of all pairs are counted separately, as one
product of matrices, and summed per pair; between fragments, pairs that can no longer reach their threshold are struck out. Bundles
beyond ``BLOCK`` nodes (or ``BLOCK_BYTES``) are cut into blocks, stored once, and every two blocks of a bundle meet in a product of the
table of blocks with itself, which reads it again instead of shuffling a copy for each pair. Only a spanning forest of the links and
the number of links leave a task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.llm.batches import LOWER, U64, Totals, mix, pieces, slices, utf8, word_hashes, words
from wavetrail.llm.components import components
from wavetrail.llm.registry import query, table
from wavetrail.llm.work import materialise, release, sifted

#: Words of a shingle, and the least likeness in hundredths.
WORDS, PERCENT = 5, 80
#: Hundredths of a node's shingles, by hash, that are looked up in other nodes.
REACH = 30
#: Up to this size the demand is taken over all partners; from 80 on the set's own side decides: it has at most n / 10 + 2, partners n / 8.
EVERY_SIZE = 130
#: Nodes and bytes of a block (a larger set is taken alone), and shingles of a fragment.
BLOCK, BLOCK_BYTES, FRAGMENT = 1024, 8 << 20, 4096
#: Pairs of blocks that are handed to Python at once.
PAIRS = 2
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct shingles of every text, by row and hash; with fewer words the whole sequence is one."""
    data, offsets = utf8(column)
    rows_out, grams_out = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for low, high in pieces(offsets):
        part = LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, row = words(part, offsets[low : high + 1] - offsets[low])
        if len(starts) == 0:
            continue
        totals = Totals(word_hashes(part, starts, ends))
        first = np.searchsorted(row, np.arange(high - low))
        count = np.diff(np.append(first, len(row)))
        short = np.flatnonzero((count > 0) & (count < WORDS))
        grams = totals.grams(WORDS)
        whole = np.flatnonzero(row[: len(grams)] == row[WORDS - 1 :])
        rows_out += [row[whole] + low, short + low]
        grams_out += [grams[whole], totals.spans(first[short], first[short] + count[short])]
    rows, grams = np.concatenate(rows_out), np.concatenate(grams_out)
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def nodes_of(rows: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and node of every row's set: equal sets have equal nodes; an empty set has size 0."""
    first = np.searchsorted(rows, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams), dtype=U64)])
    squares = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(0x5851F42D4C957F2D)) * (grams | U64(1)), dtype=U64)])
    size = np.diff(first)
    one, two = sums[first[1:]] - sums[first[:-1]], squares[first[1:]] - squares[first[:-1]]
    return size, mix(mix(one) + mix(two + size.astype(U64))).view(np.int64)


def survey(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, size, node) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            size, node = nodes_of(*shingle_sets(batch.column("text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(size), pa.array(node)], names=["doc_id", "row_key", "size", "node"])

    return documents.mapInArrow(run, "doc_id long, row_key long, size long, node long")


def reach(size: np.ndarray) -> np.ndarray:
    """How many shingles of a set are looked up."""
    lack = size - (PERCENT * size + 99) // 100
    return np.minimum(size, lack + 1 + np.maximum(REACH * size // 100 - lack, 0))


def demand(size: np.ndarray) -> np.ndarray:
    """How many of its looked up shingles a set has, at least, among those of any set it is linked with.

    Of the o shared shingles of sets of n and m, the first reach(n) - (n - o) are looked up on one side whatever the order, the first
    reach(m) - (m - o) on the other; both beginnings are of one order, so the smaller is common.
    """

    def least(n: int) -> int:
        m = np.arange(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)
        both = -(-PERCENT * (n + m) // (100 + PERCENT))  # 100 o >= p (n + m - o)
        common = np.minimum(reach(np.array([n])) - n + both, reach(m) - m + both)
        return int(common[both <= np.minimum(n, m)].min())

    return np.array([least(n) for n in size.tolist()], dtype=np.int64)


def lookups(documents: DataFrame) -> DataFrame:
    """(key, node, weight, several): shingles to be looked up; weight counts those of the node that the row stands for.

    Shingles that several nodes of a batch have are known to be repeated: they are counted there, in one row of the node under a key of
    its own, and one row tells the other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, grams = shingle_sets(batch.column("text"))
            size, node = nodes_of(rows, grams, batch.num_rows)
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            chosen = rank < reach(size)[rows]
            _, one = np.unique(node, return_index=True)  # equal sets are looked up once
            unique = np.zeros(batch.num_rows, dtype=bool)
            unique[one] = True
            chosen &= unique[rows]
            key, of = grams[chosen].view(np.int64), node[rows[chosen]]
            order = np.argsort(key, kind="stable")
            key, of = key[order], of[order]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            last = np.ones(len(key), dtype=bool)
            last[:-1] = head[1:]
            alone = head & last
            known, times = np.unique(of[~alone], return_counts=True)
            own = mix(known.astype(U64) ^ U64(0x2545F4914F6CDD1D)).view(np.int64)
            shared = head & ~last
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[alone], key[shared], own])), pa.array(np.concatenate([of[alone], of[shared], known])),
                    pa.array(np.concatenate([np.ones(alone.sum(), np.int32), np.zeros(shared.sum(), np.int32), times.astype(np.int32)])),
                    pa.array(np.concatenate([np.zeros(alone.sum(), bool), np.ones(shared.sum() + len(known), bool)])),
                ],
                names=["key", "node", "weight", "several"],
            )

    return documents.mapInArrow(run, "key long, node long, weight int, several boolean")


def candidates(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (of node, n) that have enough repeated shingles to be linked with another."""
    key = Window.partitionBy("key")
    repeated = (F.min("node").over(key) != F.max("node").over(key)) | F.max("several").over(key)
    counts = lookups(documents).withColumn("repeated", repeated).filter("repeated").groupBy("node").agg(F.sum("weight").alias("found"))
    table = F.array(*map(F.lit, demand(np.arange(1, EVERY_SIZE + 1)).tolist()))
    larger = 1 + F.expr(f"({REACH} * n) div 100 - (n - ({PERCENT} * n + 99) div 100)")
    least = F.when(F.col("n") <= EVERY_SIZE, F.get(table, F.col("n").cast("int") - 1)).otherwise(larger)
    return nodes.join(counts, "node").filter(F.col("found") >= least).drop("found")


def shared_sets(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, n, shingles): of each node that may still be linked, the shingles that other nodes have too, in the global order.

    A shingle is one number of its frequency class and its hash, so numbers of rare shingles come first. Shingles of one node are not
    listed: n - size(shingles) says how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "shingles")):
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column("shingles")], dtype=np.int64)
            grams = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(np.asarray(batch.column("node")), size))], names=["gram", "node"])

    times = F.count("*").over(Window.partitionBy("gram"))
    rows = sets.mapInArrow(run, "gram long, node long").withColumn("times", times).filter("times > 1")
    number = F.shiftleft(F.floor(F.log2("times")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned("gram", 7))
    # a node may come twice
    listed = rows.select("node", number.alias("number")).groupBy("node").agg(F.array_sort(F.collect_set("number")).alias("shingles"))
    return listed.join(sizes.select("node", "n"), "node").filter(F.expr("n - size(shingles)") < _prefix()).select("node", "n", "shingles")


def _prefix() -> Column:
    return F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")


def bundles(found: DataFrame) -> DataFrame:
    """(node, component): nodes tied by a shingle among the first of both; found: node, n, shingles (see `shared_sets`)."""
    first = F.slice("shingles", 1, (_prefix() - (F.col("n") - F.size("shingles"))).cast("int"))
    keys = found.select("node", F.explode(first).alias("key"))
    least = F.min("node").over(Window.partitionBy("key"))
    return components(keys.withColumn("least", least).filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())


def compare(own: list[np.ndarray], other: list[np.ndarray] | None, size: np.ndarray | None = None) -> np.ndarray:
    """True for every linked pair of sets (of one list, or of two); sets hold numbers of the global order, ascending.

    size: of both lists, where sets have elements that are not listed as no other set has them. The order is cut into fragments; each
    adds its partial overlaps, and pairs that cannot be linked any more are struck out.
    """
    both = own if other is None else own + other
    listed = np.array([len(s) for s in both])
    size = listed if size is None else size
    row, token = np.repeat(np.arange(len(both)), listed), np.concatenate(both)
    tokens, column, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    left = np.bincount(row, minlength=len(both))  # shared shingles still to come
    rows, columns = np.arange(len(own)), np.arange(len(own), len(both)) if other is not None else np.arange(len(own))
    sizes = size[rows][:, None] + size[columns][None, :]
    need = -(-PERCENT * sizes // (100 + PERCENT))  # 100 o >= p (a + b - o)
    overlap = np.zeros(need.shape, dtype=np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, min(FRAGMENT, (16 << 20) // max(len(both), 1)))
    for start in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(both), width), dtype=np.float32)
        part[row[a:b], column[a:b] - start] = 1
        overlap += (part[rows] @ part[columns].T).astype(np.int64)
        left -= np.bincount(row[a:b], minlength=len(both))
        if not (overlap + np.minimum(left[rows][:, None], left[columns][None, :]) >= need).any():
            break
    linked = overlap >= need
    if other is None:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each set the least set it reaches through links of a square matrix."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def _close(nodes: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    """(a, b, degree) of the nodes b that have links in a square matrix."""
    degree = full.sum(axis=1)
    label, at = forest(full), np.flatnonzero(degree)
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[at]], pa.int64()), pa.array(nodes[at], pa.int64()), pa.array(degree[at], pa.int64())], names=["a", "b", "degree"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """((bundle, block), nodes, sizes, sets) of rows (bundle, block, node, n, shingles) that come block by block."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        lists = batch.column("shingles")
        ends, numbers = np.asarray(lists.offsets), np.asarray(lists.values)
        columns = [batch.column(c).to_pylist() for c in ("bundle", "block", "node", "n")]
        for i, (bundle, block, node, n) in enumerate(zip(*columns, strict=True)):
            if (bundle, block) != at:
                if held:
                    yield at, np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]
                held, at = [], (bundle, block)
            held.append((node, n, numbers[ends[i] : ends[i + 1]].copy()))
    if held:
        yield at, np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held]


def links_inside(members: DataFrame) -> DataFrame:
    """(a, b, degree): forests of links inside each block; degrees count its links. members: bundle, block, node, n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sizes, sets in _blocks(batches):
            if len(nodes) > 1:
                yield _close(nodes, compare(sets, None, sizes))

    return _by_block(members).mapInArrow(run, "a long, b long, degree long")


def _by_block(members: DataFrame) -> DataFrame:
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(partitions, "bundle", "block").sortWithinPartitions("bundle", "block").select("bundle", "block", "node", "n", "shingles")


def packed_blocks(members: DataFrame) -> DataFrame:
    """(bundle, block, nodes, sizes, ends, numbers): one row for each block, all its sets in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bundle, block), nodes, sizes, sets in _blocks(batches):
            ends = np.cumsum([len(s) for s in sets])
            binary = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (nodes, sizes, ends, np.concatenate(sets))]
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int64()), pa.array([block], pa.int64()), *binary], names=["bundle", "block", "nodes", "sizes", "ends", "numbers"])

    return _by_block(members).mapInArrow(run, "bundle long, block long, nodes binary, sizes binary, ends binary, numbers binary")


def links_across(blocks: DataFrame) -> DataFrame:
    """(a, b, degree): as `links_inside`, of links between every two blocks of a bundle; blocks: see `packed_blocks`.

    The table meets itself partition by partition and is read again each time: nothing is copied or shuffled.
    """
    parts = ["nodes", "sizes", "ends", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = ([np.frombuffer(batch.column(f"{c}{side}")[i].as_buffer(), dtype=np.int64) for c in parts] for side in (1, 2))
                own, other = np.split(one[3], one[2][:-1]), np.split(two[3], two[2][:-1])
                nodes, k = np.concatenate([one[0], two[0]]), len(own)
                full = np.zeros((len(nodes), len(nodes)), dtype=bool)
                full[:k, k:] = compare(own, other, np.concatenate([one[1], two[1]]))
                yield _close(nodes, full | full.T)

    one, two = (blocks.select(*[F.col(c).alias(f"{c}{side}") for c in blocks.columns]) for side in (1, 2))
    pairs = one.join(two.hint("shuffle_replicate_nl"), F.expr("bundle1 = bundle2 AND block1 < block2"))
    return pairs.select(*[f"{c}{side}" for side in (1, 2) for c in parts]).mapInArrow(run, "a long, b long, degree long")


@contextmanager
def _few_rows_at_once(spark: SparkSession):
    """Rows of several megabytes reach Python a few at a time."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(PAIRS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def member_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the set of one document of each node, by hash; other documents of a joined id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, grams = shingle_sets(batch.column("text"))
            _, node = nodes_of(rows, grams, batch.num_rows)
            keep = np.flatnonzero(node == np.asarray(batch.column("node"))).tolist()
            ends = np.searchsorted(rows, np.arange(batch.num_rows), "right").tolist()
            raw, starts = grams.tobytes(), [0, *ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.array([raw[8 * starts[i] : 8 * ends[i]] for i in keep], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def join_similar(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, n_links) of each document; n_links counts other distinct sets linked with its own.

    Two documents link when 100 * |A and B| >= PERCENT * |A or B|. documents: doc_id, text; other columns are ignored. Null and empty texts
    are linked with nothing and keep their own id; a null doc_id takes part but names no component; equal rows are linked; no rows
    give no rows. Shingles are compared by 57 bits of hash and their frequency class.
    """
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    known = materialise(survey(rows), "jaccard-survey")
    # one row of each node: the least id, of equal ids any (the text's node is compared again)
    one = known.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("chosen"), F.max("size").alias("n"))
    chosen = materialise(candidates(rows, one), "jaccard-candidates")
    # planned alike at every size: texts that may be chosen are shuffled once, the candidates are never broadcast
    likely = sifted(rows, F.xxhash64("doc_id"), chosen, F.xxhash64("chosen"), "jaccard-sieve").filter("_may")
    texts = likely.hint("merge").join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text", "node")
    found_sets = materialise(member_sets(texts), "jaccard-sets")
    shared = materialise(shared_sets(found_sets, chosen), "jaccard-shared")
    release(found_sets)
    tied = materialise(bundles(shared), "jaccard-bundles").select("node", F.col("component").alias("bundle"))
    sets = shared.join(tied, "node")
    sizes = sets.groupBy("bundle").agg(F.count("*").alias("nodes"), F.sum(8 * F.size("shingles").cast("long")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long")
    sizes = materialise(sizes.select("bundle", blocks.alias("blocks")), "jaccard-sizes")
    members = sets.join(sizes, "bundle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    found = materialise(links_inside(members), "jaccard-links")
    if not sizes.filter("blocks > 1").isEmpty():
        stored = materialise(packed_blocks(members.filter("blocks > 1")), "jaccard-blocks")
        release(shared)
        with _few_rows_at_once(documents.sparkSession):
            found = found.unionByName(materialise(links_across(stored), "jaccard-links-across"))
        release(stored)
    else:
        release(shared)
    reached = components(found.select("a", "b"))
    degrees = found.groupBy(F.col("b").alias("node")).agg(F.sum("degree").alias("n_links"))
    of_node = one.select("node", "chosen").join(reached, "node", "left").select("node", "chosen", F.coalesce("component", "node").alias("component"))
    least = of_node.groupBy("component").agg(F.min("chosen").alias("component_id"))
    named = of_node.join(least, "component").join(degrees, "node", "left").select("node", "component_id", "n_links")
    full = known.filter("size > 0").join(named, "node").select("doc_id", "row_key", F.col("size").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = known.filter("size = 0").select("doc_id", "row_key", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).drop("row_key")
