"""BM25 over an inverted index, for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize

# The scorer's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class LexicalIndex:
    """postings(term, doc_seq, tf, dl), terms(term, df, idf), corpus: one row (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` dealt out again where it arrives in fewer partitions than there are cores
    (a few small files); otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def build_index(docs: DataFrame, persist: bool = True) -> LexicalIndex:
    """The index of ``docs`` (doc_seq, text).

    Texts are dealt out by doc_seq, so counting a document's terms needs no shuffle of
    tokens; the terms' document frequencies are partially summed before theirs.
    """
    dealt = docs.select("doc_seq", "text").repartition("doc_seq").select("doc_seq", tokenize(F.col("text")).alias("tokens"))
    counted = dealt.select("doc_seq", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).groupBy("doc_seq", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    if persist:
        counted = counted.persist()
    postings = counted.where("term IS NOT NULL").select("term", "doc_seq", "tf", "dl")
    # A document without tokens has one row, without a term, and counts.
    per_doc = counted.groupBy("doc_seq").agg(F.first("dl").alias("dl"))
    corpus = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(postings, with_idf(postings, corpus), corpus)


def with_idf(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Inverse document frequency; a negative one becomes EPSILON times the mean of all."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.lit(EPSILON) * F.avg("raw")).alias("floor"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated word of a query counts each time."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


#: Terms of a batch of queries that are sent to every task.
SENT = 1_000_000


def asked_of(postings: DataFrame, wanted: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``postings`` with the rows of ``wanted``, made of the terms of ``queries``, that they share
    ``keys`` with. Postings lie by document; where the batch is not too large its terms are sent to
    them, so they stay there, no common term gathers in one task, and sums for each query and
    document need no shuffle."""
    few = queries.select(F.sum(F.size(tokenize(F.col("text"))).cast("long"))).first()[0]
    return postings.join(F.broadcast(wanted) if (few or 0) <= SENT else wanted, keys)


def scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, doc_seq, score of every document that shares a term with the query.
    Only the postings of query terms take part, where their documents lie."""
    wanted = query_terms(queries).join(index.terms.select("term", "idf"), "term")
    hits = asked_of(index.postings, wanted, queries, ["term"]).crossJoin(F.broadcast(index.corpus.select("avgdl")))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_seq").agg(F.sum(F.col("qtf") * F.col("idf") * saturation).alias("score"))


def top_k(scored: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their rank, in 1, 2, ...; Spark prunes each
    partition to k rows before it shuffles."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(index: LexicalIndex, queries: DataFrame, k: int = 30, digits: int | None = None) -> DataFrame:
    """query_id, doc_seq, score, rank: the k best by score, ties in document order, of
    which those with a positive score stay. ``digits``: round scores before ranking."""
    found = scores(index, queries)
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    return top_k(found.where("score > 0"), k, [F.desc("score"), F.asc("doc_seq")])
