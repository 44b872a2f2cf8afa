"""Reciprocal-rank fusion and reranking of ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.lexical import top_k

# Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
CANDIDATES, TOP_K = 30, 8

#: (query text, chunk text) -> score. A cross-encoder is plugged in as a pandas UDF.
Scorer = Callable[[Column, Column], Column]


def token_overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text has: a deterministic
    stand-in where no reranking model is at hand."""
    q = F.array_distinct(tokenize(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenize(text))) / F.size(q)).otherwise(F.lit(0.0))


def fuse(lists: DataFrame, k: int | None = CANDIDATES) -> DataFrame:
    """``lists``: query_id, list_id (0, 1, ...), id, rank. -> query_id, id, fused_score,
    dense_rank (of list 0), bm25_rank (of list 1), rank.

    An id that a list has twice counts twice, and its last rank is reported. Ties stand in
    the order in which the lists, one after the other, first name the ids.
    """
    fused = lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused_score"),
        F.max(F.when(F.col("list_id") == 0, F.col("rank"))).alias("dense_rank"),
        F.max(F.when(F.col("list_id") == 1, F.col("rank"))).alias("bm25_rank"),
        F.min(F.struct("list_id", "rank")).alias("_first"),
    )
    limit = k if k is not None else (1 << 31) - 1
    return top_k(fused, limit, [F.desc("fused_score"), F.asc("_first")]).drop("_first")


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, top: int | None = TOP_K, scorer: Scorer = token_overlap) -> DataFrame:
    """The ``top`` candidates (0 and None: the default) after reranking, with their chunk's
    columns. ``chunks``: id, text, ...; ids that it lacks are dropped. ``queries``: query_id, text."""
    columns = [c for c in chunks.columns if c not in ("id", "text")]
    joined = fused.join(chunks, "id").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    scored = joined.withColumn("rerank_score", scorer(F.col("_query"), F.col("text"))).withColumnRenamed("rank", "fused_rank")
    return top_k(scored, top or TOP_K, [F.desc("rerank_score"), F.asc("fused_rank")]).select("query_id", "rank", "id", "dense_rank", "bm25_rank", "fused_score", "rerank_score", "text", *columns)


def ranked_lists(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """The two result lists as input of :func:`fuse`."""
    one = dense.select("query_id", F.lit(0).alias("list_id"), F.col("doc_seq").alias("id"), "rank")
    return one.unionByName(lexical.select("query_id", F.lit(1).alias("list_id"), F.col("doc_seq").alias("id"), "rank"))
