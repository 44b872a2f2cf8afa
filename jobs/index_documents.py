"""Keeps a search index up to date with a folder of document files, taking only new files.

    python -m jobs.index_documents SOURCE TARGET CHECKPOINT --config jobs/index_documents.json

SOURCE is a folder (or file) of Parquet documents, to which files are added over time. A file
stream reads what the checkpoint has not seen, a bounded number of files a batch, and ends when
nothing is left. A batch writes the partition that its number names, replacing it, so a batch
that runs again after a failure leaves the same files.

TARGET/blocks/batch=B/slot=S has the postings, packed as the library's stored index has them;
TARGET/documents/batch=B a row for each document (id, digest of the text, number of tokens). A
document that comes again replaces its older version: readers take its last batch. Of several
rows with one id in a batch the one with the greatest digest counts. Rows without an id have
no name to be found by and are left out, which the log counts.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import _command
from tessera.operators import postings

log = logging.getLogger("jobs.index_documents")

BLOCKS = f"{postings.BLOCKS}, batch long"
DOCUMENTS = "doc_seq long, digest string, dl int, batch long"


def _write(batch: DataFrame, number: int, target: str, config: dict) -> None:
    """One batch's documents and postings, as the partitions of its number."""
    read = batch.select(F.col(config["id_column"]).cast("long").alias("doc_seq"), F.col(config["text_column"]).alias("text")).persist()
    try:
        last = F.row_number().over(Window.partitionBy("doc_seq").orderBy(F.desc(postings.digest(F.col("text")))))
        docs = read.where("doc_seq IS NOT NULL").withColumn("_place", last).where("_place = 1").drop("_place")
        rows = postings.blocks_of(postings.counted(docs, config["block_width"]), config["block_width"], config["slots"]).withColumn("batch", F.lit(number).cast("long"))
        known = docs.select("doc_seq", postings.digest(F.col("text")).alias("digest"), postings.length(F.col("text")).alias("dl"), F.lit(number).cast("long").alias("batch"))
        put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{target}/{name}")
        put(rows.repartition("slot").sortWithinPartitions("slot", "term", "block"), "blocks", "batch", "slot")
        put(known, "documents", "batch")  # last: what has a row here has its postings too
        written = batch.sparkSession.read.schema(DOCUMENTS).parquet(f"{target}/documents").where(F.col("batch") == number).count()
        log.info("batch %d: read %d rows, %d of them without an id; wrote %d documents to %s", number, read.count(), read.where("doc_seq IS NULL").count(), written, target)
    finally:
        read.unpersist()


def _pattern(path: str) -> str:
    """``path`` as a pattern that only it matches: file streams read folders or patterns, and
    SOURCE may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes in what is new of ``source`` and returns the whole index's postings."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(source))
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: _write(batch, number, target, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    log.info("took %d batches of what was new in %s", sum(p.numInputRows > 0 for p in query.recentProgress), source)
    return current(spark, target)


def documents(spark: SparkSession, target: str) -> DataFrame:
    """doc_seq, digest, dl, batch of each document's last version."""
    every = spark.read.schema(DOCUMENTS).parquet(f"{target}/documents")
    return every.groupBy("doc_seq").agg(F.max_by(F.struct("digest", "dl", "batch"), "batch").alias("d")).select("doc_seq", "d.*")


def current(spark: SparkSession, target: str) -> DataFrame:
    """term, doc_seq, tf, dl of the last versions."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{target}/blocks")
    rows = blocks.select("term", "batch", F.explode("docs").alias("d")).select("term", "d.doc_seq", "d.tf", "d.dl", "batch")
    return rows.join(documents(spark, target).select("doc_seq", "batch"), ["doc_seq", "batch"]).select("term", "doc_seq", "tf", "dl")


def index(spark: SparkSession, target: str, config: dict) -> postings.StoredIndex:
    """The index to search in. Where no document came twice its blocks are the stored rows."""
    width, slots = config["block_width"], config["slots"]
    return postings.StoredIndex(postings.blocks_of(current(spark, target), width, slots), documents(spark, target).select("doc_seq", "dl"), width, slots)


PATHS = (("source", "folder of Parquet documents"), ("target", "folder of the index"), ("checkpoint", "folder of the stream's checkpoint"))

if __name__ == "__main__":
    sys.exit(_command.main("index_documents", run, PATHS))
