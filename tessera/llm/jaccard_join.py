"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles. Documents with one set form a class;
its representative is its least id. Every pair of classes whose sets have a Jaccard
similarity of at least the threshold is a link.

1. Each document is read once: its set's digest (the class) and ``HASHES`` MinHash values.
2. Classes that agree in all values of some band meet in a bucket. With 32 bands of 5
   values a pair at similarity 0.8 misses every bucket with probability 3e-6.
3. Within a bucket, pairs are compared value by value, a step of values at a time. With a
   uniform prior, m agreements among n values give the similarity a Beta(m + 1, n - m + 1)
   posterior; a pair whose posterior probability of reaching the threshold falls below
   ``TOLERANCE`` is dropped. What is left connects classes into candidate clusters, as a
   forest: fewer edges than classes, however many pairs.
4. The sets of clustered classes are computed from their texts, once. In each cluster the
   comparison runs again over all its pairs, and pairs that survive are verified exactly.
   Out come, for each class, its number of links, and a forest of the links, whose
   components are the groups.

Nothing emits a pair as a row. Exact copies fall together on the map side before any of
this. A bucket of more than one block's classes is not compared: all its classes are one
cluster (an edge from each to the least), so candidates cost one row for each class and
bucket. A cluster of n classes in more than one block is compared block by block, each pair
of blocks in a task of its own: no task holds more than two blocks, and each class is sent
once for each block of its cluster. So the work on one such cluster, and its shuffle, grow
with the square of n (n * n / 2048 rows): its links are as many, and they are counted.

Defined results: a null text has no shingles; a text of one to four words has one shingle,
all its words; documents without words have no links and form a class of their own (in all
respects but that they are not linked to others); null ids are earlier than other ids and
a class of null ids has a null id; repeated rows are members of one class; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._components import components
from tessera.llm._shared import known_id, map_batches, materialize, table
from tessera.llm._words import mix, slices, windows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Values that are compared in one step.
STEP = 32
TOLERANCE = 1e-6
#: Classes, and bytes of sets, of one block.
BLOCK_CLASSES, BLOCK_BYTES = 2048, 12 << 20

_SKETCH = "doc_id long, tie long, one long, two long, n_shingles int, sketch binary, bands array<long>"
_SETS = "doc_id long, tie long, grams binary"
_A, _B = np.random.RandomState(20_011).randint(1, 1 << 31, size=(2, HASHES)).astype(np.uint32)
_A |= np.uint32(1)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    for words in slices(column):
        h = words.digests(11)
        grams = mix(windows(h, n), 12)
        for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield mix(windows(h[a:b], b - a), 13 + b - a)
            else:
                yield np.zeros(0, np.uint64)


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES values of a set: the least of a*x + b over 32 bits, folded to 16."""
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (_A[:, None] * x[None, i : i + 512] + _B[:, None]).min(axis=1), out=least)
    # The low bits of a product have short cycles; mixing them in keeps values apart.
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two, sizes, sketch, bands = [], [], [], [], []
        weight = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for grams in shingle_sets(batch["text"]):
            one.append(int(mix(grams, 31).sum(dtype=np.uint64).view(np.int64)) if len(grams) else 0)
            two.append(int(mix(grams, 32).sum(dtype=np.uint64).view(np.int64)) ^ len(grams))
            sizes.append(len(grams))
            if len(grams):
                values = minhash(grams)
                keys = mix((mix(values.astype(np.uint64), 33).reshape(BANDS, ROWS) * weight).sum(axis=1) ^ np.arange(BANDS, dtype=np.uint64), 34)
                sketch.append(values.tobytes())
                bands.append(keys.view(np.int64))
            else:
                sketch.append(b"")
                bands.append(np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["tie"], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "tie", "one", "two", "n_shingles", "sketch", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([g.tobytes() for g in shingle_sets(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], grams], names=["doc_id", "tie", "grams"])


def _tail(agree: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold) under Beta(agree + 1, n - agree + 1): a binomial sum."""
    return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(agree + 1))


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, agreements that keep a pair) for each step."""
    return [(n, next(m for m in range(n + 1) if _tail(m, n, threshold) >= tolerance)) for n in range(STEP, HASHES + 1, STEP)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _survivors(sketch: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, steps: list[tuple[int, int]], threshold: float) -> np.ndarray:
    """Which of ``others`` the incremental comparison with i keeps."""
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    others = others[small >= threshold * large - 1e-9]
    agree, done = np.zeros(len(others), np.int32), 0
    for n, least in steps:
        if not len(others):
            break
        agree = agree + (sketch[others, done:n] == sketch[i, done:n]).sum(axis=1)
        keep = agree >= least
        others, agree, done = others[keep], agree[keep], n
    return others


def _pairs(side: np.ndarray | None, n: int, i: int) -> np.ndarray:
    """The partners that a block pair gives its row i of n: later rows where the two blocks
    are one (side is None), rows of the other block where they are two."""
    if side is None:
        return np.arange(i + 1, n)
    return np.flatnonzero(side == 1) if side[i] == 0 else np.zeros(0, np.int64)


def _load(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, list[str], pa.Table]:
    two = "side" in rows.column_names and rows["lo"][0] != rows["hi"][0]
    rows = rows.sort_by([("side", "ascending"), ("class", "ascending")] if two else "class")
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, HASHES)
    return sketch, rows["n_shingles"].to_numpy(), rows["side"].to_numpy() if two else None, rows["class"].to_pylist(), rows


def _candidate_forest(threshold: float, tolerance: float):
    steps = least_agreements(threshold, tolerance)

    def run(rows: pa.Table) -> pa.Table:
        sketch, sizes, _, names, _ = _load(rows)
        forest, a, b = _Forest(len(names)), [], []
        for i in range(len(names)):
            for j in _survivors(sketch, sizes, i, _pairs(None, len(names), i), steps, threshold).tolist():
                if forest.join(i, j):
                    a.append(names[i]), b.append(names[j])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return run


def _link_counts(threshold: float, tolerance: float):
    steps = least_agreements(threshold, tolerance)

    def run(rows: pa.Table) -> pa.Table:
        sketch, sizes, side, names, rows = _load(rows)
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        # Each digest of the block becomes a small number, so a set can mark a table.
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if sets else np.zeros(0, np.int32)
        mark = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int32)
        forest, links, a, b = _Forest(len(names)), np.zeros(len(names), np.int64), [], []
        for i in range(len(names)):
            others = _survivors(sketch, sizes, i, _pairs(side, len(names), i), steps, threshold)
            if not len(others):
                continue
            own = number[bounds[i] : bounds[i + 1]]
            mark[own] = 1
            n = bounds[others + 1] - bounds[others]
            ends = np.cumsum(n)
            flat = np.arange(int(ends[-1])) + np.repeat(bounds[others] - (ends - n), n)
            both = np.add.reduceat(mark[number[flat]], ends - n)
            mark[own] = 0
            # both / (|i| + |j| - both) >= threshold, in exact arithmetic but for the threshold
            linked = others[both >= threshold * (len(own) + n - both) - 1e-9]
            links[i] += len(linked)
            links[linked] += 1
            for j in linked.tolist():
                if forest.join(i, j):
                    a.append(names[i]), b.append(names[j])
        have = np.flatnonzero(links)
        return pa.table(
            {
                "class": pa.array([names[i] for i in have] + [None] * len(a), pa.string()),
                "links": pa.array(links[have].tolist() + [0] * len(a), pa.int64()),
                "a": pa.array([None] * len(have) + a, pa.string()),
                "b": pa.array([None] * len(have) + b, pa.string()),
            }
        )

    return run


def _sizes(members: DataFrame, group: str, weight: Column) -> DataFrame:
    """group, _n, _w: rows and summed weight of each group that has more than one row."""
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w")).where("_n > 1")


def _in_blocks(members: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """``members`` (group, class, ...) of the groups in ``sizes``, dealt out for pair work:
    columns lo, hi (the block pair) and side (0 for a member of lo, 1 of hi). A group of one
    block stays one task's; of k blocks, each member goes to k block pairs. Members learn
    their group's size by a join, which Spark splits where one group is large; no group is
    ever gathered whole."""
    counted = (
        members.join(sizes, group)
        .withColumn("_k", F.ceil(F.greatest(F.col("_n") / BLOCK_CLASSES, F.col("_w") / BLOCK_BYTES)).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("class"), F.col("_k")).cast("int"))
    )
    return (
        counted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("lo", F.least("_block", "_other"))
        .withColumn("hi", F.greatest("_block", "_other"))
        .withColumn("side", F.when(F.col("_block") == F.col("lo"), 0).otherwise(1))
        .drop("_n", "_w", "_k", "_block", "_other")
    )


def _same(df: DataFrame) -> DataFrame:
    return df.withColumn("class", F.concat_ws(":", F.hex("one"), F.hex("two")))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text): doc_id, class_id (the least id
    with its shingle set), n_links (classes linked to its class), group_id (the least id
    that a chain of links reaches), n_shingles, tie (a digest of the text), keep (is it the
    one of its group that a deduplication would keep?)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    read = materialize(_same(map_batches(keyed.select("doc_id", "tie", "text"), _sketches, _SKETCH)), "sketches")
    first = F.min(F.struct("doc_id", "tie")).alias("first")
    classes = materialize(
        read.where("n_shingles > 0").groupBy("class").agg(first, F.first("one").alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "classes",
    )
    # Half a class's digest stands for it in the buckets: two classes that share it both come along.
    meet = classes.select("one", F.explode("bands").alias("bucket"))
    sizes = meet.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sketched = classes.select("one", "class", "n_shingles", "sketch")
    compared = meet.join(sizes.where(F.col("_n") <= BLOCK_CLASSES), "bucket").join(sketched, "one").select("bucket", "class", "n_shingles", "sketch")
    edges = compared.groupBy("bucket").applyInArrow(_candidate_forest(threshold, tolerance), "a string, b string")
    large = meet.join(sizes.where(F.col("_n") > BLOCK_CLASSES), "bucket").join(classes.select("one", "class"), "one").select("bucket", "class")
    least = large.groupBy("bucket").agg(F.min("class").alias("a"))
    clusters = components(edges.unionAll(large.join(least, "bucket").select("a", F.col("class").alias("b"))))

    joined = classes.select("class", "first", "n_shingles", "sketch").join(clusters, F.col("class") == F.col("node")).select("class", "first.doc_id", "first.tie", "n_shingles", "sketch", "component")
    wanted = joined.select(known_id(F.col("doc_id")).alias("_id"), F.col("tie").alias("_tie"))
    texts = keyed.select(known_id(F.col("doc_id")).alias("doc_id"), "tie", "text")
    chosen = texts.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_semi").dropDuplicates(["doc_id", "tie"])
    sets = map_batches(chosen.select("doc_id", "tie", "text"), _sets, _SETS)
    s, j = sets.alias("s"), joined.withColumn("doc_id", known_id(F.col("doc_id"))).alias("j")
    whole = j.join(s, (F.col("s.doc_id") == F.col("j.doc_id")) & (F.col("s.tie") == F.col("j.tie"))).select("j.class", "component", "n_shingles", "sketch", "grams")
    dealt = _in_blocks(whole, _sizes(joined, "component", F.col("n_shingles") * 8), "component")
    found = materialize(dealt.groupBy("component", "lo", "hi").applyInArrow(_link_counts(threshold, tolerance), "class string, links long, a string, b string"), "links")
    links = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("a IS NOT NULL").select("a", "b"))

    info = (
        read.groupBy("class")
        .agg(first)
        .join(links, "class", "left")
        .join(groups, F.col("class") == F.col("node"), "left")
        .select("class", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "class").alias("component"))
    )
    least = info.groupBy("component").agg(F.min("first").alias("group_first"))
    known = info.join(least, "component").select("class", F.col("first.doc_id").alias("class_id"), "n_links", F.col("group_first.doc_id").alias("group_id"), "group_first")
    return (
        read.select("doc_id", "tie", "class", "n_shingles")
        .join(known, "class")
        .select("doc_id", "class_id", "n_links", "group_id", "n_shingles", "tie", (F.struct("doc_id", "tie").eqNullSafe(F.col("group_first")) | (F.col("n_shingles") == 0)).alias("keep"))
    )


def keep_one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents of which each group keeps one, the least id, in the columns of
    ``docs``; of equal rows one stays. Documents without words are in no group and stay."""
    kept = jaccard_join(docs, threshold, tolerance).where("keep").select(known_id(F.col("doc_id")).alias("_id"), F.col("tie").alias("_tie"))
    # Packed, so that no column of the documents meets one of these names. The join and the
    # numbering of equal rows ask for the same dealing: texts are shuffled once.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), known_id(F.col("doc_id")).alias("_own"), F.xxhash64("text").alias("_of"))
    chosen = packed.join(kept, (F.col("_own") == F.col("_id")) & (F.col("_of") == F.col("_tie")), "left_semi")
    twins = Window.partitionBy("_own", "_of").orderBy(F.lit(0))
    return chosen.withColumn("_twin", F.row_number().over(twins)).where("_twin = 1").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_id", "n_shingles")
