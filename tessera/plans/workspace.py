"""An indexed corpus: built from source files, kept as Parquet, queried in batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import collection_suffix
from tessera.operators import dense, graph, hybrid, impact, lexical, structure, tools
from tessera.schemas import CHUNKS, EDGES, NODES, VECTORS

#: (texts: id, text) -> id, embedding. A model is plugged in here; none is needed to index.
Embedder = Callable[[DataFrame], DataFrame]
#: What some embedding models expect before a query.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

_TABLES = {
    "chunks": CHUNKS,
    "nodes": NODES,
    "edges": EDGES,
    "postings": "term string, doc_seq long, tf long, dl int",
    "terms": "term string, df long, idf double",
    "corpus": "n long, avgdl double",
    "vectors": f"{VECTORS}, chunk_seq long",
    "files": "rel_path string, error string",
}


def prefixed(queries: DataFrame, model: str) -> DataFrame:
    """Queries as the named model wants them."""
    return queries.withColumn("text", F.concat(F.lit(QUERY_PREFIX), "text")) if "bge" in model.lower() else queries


def repo_id(spark: SparkSession, path: str) -> str:
    """What names a repository's tables in a store that holds many."""
    return spark.range(1).select(collection_suffix(F.lit(path))).first()[0]


@dataclass
class Workspace:
    """The tables of one index, lazily read."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self._read(name)
        raise AttributeError(name)

    @property
    def lexical_index(self) -> lexical.LexicalIndex:
        return lexical.LexicalIndex(self._read("postings"), self._read("terms"), self._read("corpus"))

    @property
    def chunks_by_id(self) -> DataFrame:
        return tools.last_wins(self.chunks, "chunk_id")

    @property
    def chunks_by_qualname(self) -> DataFrame:
        return tools.last_wins(self.chunks, "qualname")

    def search(self, queries: DataFrame, top: int | None = None, embed: Embedder | None = None, scorer: hybrid.Scorer = hybrid.token_overlap, candidates: int = hybrid.CANDIDATES) -> DataFrame:
        """Hybrid search of ``queries`` (query_id, text): chunk columns with dense_rank,
        bm25_rank, fused_score, rerank_score and rank. Without an embedder the dense list is empty."""
        found = lexical.search(self.lexical_index, queries, candidates)
        # Ranked lists name chunks by id: chunks that share one share its candidates, and the last is shown.
        named = self.chunks.select(F.col("chunk_seq").alias("doc_seq"), "chunk_id")
        lists = found.join(named, "doc_seq").select("query_id", F.lit(1).alias("list_id"), F.col("chunk_id").alias("id"), "rank")
        if embed is not None:
            asked = embed(queries.select(F.col("query_id").alias("id"), "text")).select(F.col("id").alias("query_id"), "embedding")
            near = dense.search(self.vectors.select(F.col("chunk_seq").alias("doc_seq"), "embedding", "kind"), asked, candidates)
            lists = near.join(named, "doc_seq").select("query_id", F.lit(0).alias("list_id"), F.col("chunk_id").alias("id"), "rank").unionByName(lists)
        chunks = self.chunks_by_id.withColumnRenamed("chunk_id", "id").drop("first_seq")
        return hybrid.rerank(hybrid.fuse(lists, candidates), queries, chunks, top, scorer)

    def impact(self, targets: DataFrame) -> DataFrame:
        return impact.facts_text(impact.impact_report(targets, self.chunks, self.nodes, self.edges))

    def summary(self) -> DataFrame:
        """One row: files, skipped, chunks and the counts of the graph."""
        files = self.files.agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("skipped"))
        chunks = self.chunks.agg(F.count(F.lit(1)).alias("chunks"))
        return files.crossJoin(chunks).crossJoin(graph.index_summary(self.nodes, self.edges))


def build(files: DataFrame, path: str, embed: Embedder | None = None) -> Workspace:
    """Indexes ``files`` (``SOURCE_FILES``) into ``path``, replacing what is there. The
    analysis is written once, sorted by file, and everything else is derived from it."""
    spark = files.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    parsed = save(structure.analyze(lexical.spread(files)), "analysis")
    ordered = parsed.orderBy("file_seq")
    save(parsed.select("rel_path", "error"), "files")
    chunks = save(structure.chunks(ordered), "chunks")
    good = parsed.where("error IS NULL")
    save(graph.build_edges(structure.calls(good), structure.imports(good)), "edges")
    save(graph.build_nodes(good.select("module", "file_seq"), structure.definitions(good)), "nodes")
    index = lexical.build_index(chunks.select(F.col("chunk_seq").alias("doc_seq"), "text"), persist=False)
    postings = save(index.postings.repartition("term").sortWithinPartitions("term", "doc_seq"), "postings")
    save(index.corpus.select("n", F.coalesce("avgdl", F.lit(0.0)).alias("avgdl")), "corpus")
    save(lexical.with_idf(postings, spark.read.parquet(f"{path}/corpus")), "terms")
    if embed is not None:
        vectors = embed(chunks.select(F.col("chunk_seq").alias("id"), "text")).withColumnRenamed("id", "chunk_seq")
        rows = vectors.join(chunks.select("chunk_seq", "chunk_id", "kind"), "chunk_seq").select("chunk_id", "embedding", "kind", "chunk_seq")
        save(dense.upsert(rows.limit(0), rows), "vectors")
    else:
        save(spark.createDataFrame([], _TABLES["vectors"]), "vectors")
    return Workspace(spark, path)


def load(spark: SparkSession, path: str) -> Workspace:
    """The index at ``path``; an error where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"No index found at {path}. Run `tessera index` first.")
    return Workspace(spark, path)
