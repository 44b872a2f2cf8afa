"""Exact nearest vectors by cosine similarity, for batches of queries.

The batch is taken in blocks of bounded size; each is broadcast to one pass over the
vectors, in which every ``TILE`` of them is multiplied with the block at once and keeps only
its k best for each query. What is shuffled is k rows for each query and tile at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexical import top_k

#: Queries of one block: what a worker holds is this many vectors, whatever the batch.
BLOCK = 1024
#: Vectors that a block is multiplied with at once: 16 MB of similarities.
TILE = 2048
_HITS = "query_id long, doc_seq long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    width = int(column.value_lengths()[0].as_py()) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _nearest(shared, k: int, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for batch in (whole.slice(at, TILE) for whole in batches for at in range(0, len(whole), TILE)):
            batch = batch.filter(batch["embedding"].is_valid())
            if not len(batch):
                continue
            seq, similarity = batch["doc_seq"].to_numpy(), _unit(queries) @ _unit(_matrix(batch["embedding"])).T
            if digits is not None:
                similarity = np.round(similarity, digits)
            rows = [np.lexsort((seq, -s))[:k] for s in similarity]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(r) for r in rows])), pa.array(np.concatenate([seq[r] for r in rows])), pa.array(np.concatenate([s[r] for s, r in zip(similarity, rows, strict=True)]))],
                names=["query_id", "doc_seq", "score"],
            )

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 30, kind: object = None, digits: int | None = None) -> DataFrame:
    """query_id, doc_seq, score, rank: the k nearest of ``vectors`` (doc_seq, embedding,
    kind) to each of ``queries`` (query_id, embedding), ties in document order. ``kind``
    filters below the search. Vectors without length are at similarity 0."""
    if kind is not None:
        vectors = vectors.where(F.col("kind") == kind)
    sc, found, block = vectors.sparkSession.sparkContext, None, []
    plain = vectors.select(F.col("doc_seq").cast("long").alias("doc_seq"), "embedding")

    def one(rows) -> DataFrame:
        ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        return plain.mapInArrow(_nearest(sc.broadcast((ids, matrix)), k, digits), _HITS)

    for row in queries.select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found, block = one(block) if found is None else found.unionAll(one(block)), []
    if block:
        found = one(block) if found is None else found.unionAll(one(block))
    if found is None:
        found = vectors.sparkSession.createDataFrame([], _HITS)
    return top_k(found, k, [F.desc("score"), F.asc("doc_seq")])


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """A vector table after an upsert: of rows with one chunk_id the last one stays, rows
    of ``new`` (with its chunk_seq) being later than those of ``vectors``."""
    both = vectors.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in vectors.columns if c != "chunk_id"]
    last = both.groupBy("chunk_id").agg(F.max_by(F.struct(*columns), F.struct("_new", "chunk_seq")).alias("v"))
    return last.select("chunk_id", *[F.col(f"v.{c}").alias(c) for c in columns])
