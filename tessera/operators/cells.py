"""A vector table in cells: nearest vectors from the cells that are nearest to a query.

Centroids are trained by k-means on a bounded sample of the vectors (``SAMPLE`` rows, a
documented parameter); then every vector is assigned to the cell of its nearest centroid,
and the table is written with one partition a cell. A search finds each query's ``probes``
nearest centroids and reads only the cells that some query probes, as a partition filter;
within a cell a vector is compared with the queries that probe it. With all cells probed the
result is that of the exact search, which stays the way for who needs all of it.

Recall is a matter of ``probes``: :func:`recall` measures it against the exact search.
Vectors without length are in cell 0 and at similarity 0; null vectors are in no cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dense import _HITS, _matrix, _unit, BLOCK
from tessera.operators.lexical import top_k

CELLS, PROBES, ROUNDS = 32, 20, 10
#: Vectors that the centroids are trained on.
SAMPLE = 20_000


@dataclass
class CellIndex:
    """vectors (doc_seq, embedding, kind, cell) and the centroids, one row each."""

    vectors: DataFrame
    centroids: np.ndarray


def _trained(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means, started from rows spread over the sample in its order."""
    unit = _unit(sample)
    centroids = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (unit @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            own = unit[nearest == c]
            if len(own):
                centroids[c] = own.mean(axis=0)
        centroids = _unit(centroids)
    return centroids


def train(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids from a sample that the vectors' ids choose: the rows with the least digests."""
    chosen = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("doc_seq"), "doc_seq").limit(sample).select("embedding").toArrow().column(0)
    return _trained(_matrix(chosen.combine_chunks()), cells) if len(chosen) else np.zeros((1, 1))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with their cell: one pass, no shuffle."""
    known = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch["embedding"].is_valid())
            if len(batch):
                nearest = (_unit(_matrix(batch["embedding"])) @ known.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "cell"])

    kind = dict(vectors.dtypes)["kind"]
    return vectors.select(F.col("doc_seq").cast("long").alias("doc_seq"), F.col("embedding").cast("array<float>").alias("embedding"), "kind").mapInArrow(run, f"doc_seq long, embedding array<float>, kind {kind}, cell int")


def store(vectors: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE) -> CellIndex:
    """Writes ``vectors`` (doc_seq, embedding, kind) by cell, and the centroids, below ``path``."""
    spark, centroids = vectors.sparkSession, train(vectors, cells, sample)
    assign(vectors, centroids).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # as many as cells
    return CellIndex(spark.read.parquet(f"{path}/vectors"), np.array([r.centroid for r in rows]))


def _nearest(shared, k: int, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, probed = shared.value  # probed[q, c]: does query q look into cell c?
        for batch in batches:
            cell, seq, matrix = batch["cell"].to_numpy(), batch["doc_seq"].to_numpy(), _unit(_matrix(batch["embedding"]))
            out: list[tuple[np.ndarray, ...]] = []
            for c in np.unique(cell):
                asks, here = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
                similarity = queries[asks] @ matrix[here].T
                if digits is not None:
                    similarity = np.round(similarity, digits)
                for q, s in zip(asks, similarity, strict=True):
                    best = np.lexsort((seq[here], -s))[:k]
                    out.append((np.full(len(best), ids[q]), seq[here[best]], s[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "doc_seq", "score"])

    return run


def search(index: CellIndex, queries: DataFrame, k: int = 30, probes: int = PROBES, kind: object = None, digits: int | None = None) -> DataFrame:
    """query_id, doc_seq, score, rank: the k nearest of the probed cells' vectors, ties in
    document order. The queries are taken in blocks of bounded size; what a block shuffles is
    k rows for each query and batch of a cell it probes."""
    sc, centroids = index.vectors.sparkSession.sparkContext, index.centroids
    vectors = index.vectors if kind is None else index.vectors.where(F.col("kind") == kind)
    found, block = None, []

    def one(rows: list) -> DataFrame:
        ids, matrix = np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64))
        order = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes]
        probed = np.zeros((len(rows), len(centroids)), bool)
        np.put_along_axis(probed, order, True, axis=1)
        cells = [int(c) for c in np.flatnonzero(probed.any(axis=0))]
        return vectors.where(F.col("cell").isin(cells)).select("doc_seq", "embedding", "cell").mapInArrow(_nearest(sc.broadcast((ids, matrix, probed)), k, digits), _HITS)

    for row in queries.select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found, block = one(block) if found is None else found.unionAll(one(block)), []
    if block:
        found = one(block) if found is None else found.unionAll(one(block))
    if found is None:
        found = index.vectors.sparkSession.createDataFrame([], _HITS)
    return top_k(found, k, [F.desc("score"), F.asc("doc_seq")])


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the share of the exact search's rows that ``found`` has."""
    both = exact.select("query_id", "doc_seq").join(found.select("query_id", "doc_seq", F.lit(1).alias("hit")), ["query_id", "doc_seq"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
