"""Chunks as JSON files, for exchange with other tools; the workspace itself keeps Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import CHUNK


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of the ``CHUNK`` fields, in chunk order; nulls are written as nulls."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    chunks.orderBy("chunk_seq").select(*names).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``CHUNKS`` of JSON lines or of one JSON array in a file; a field that is unknown is
    ignored, one that is missing is null, and a broken record fails."""
    rows = spark.read.schema(CHUNK).option("mode", "FAILFAST").option("multiLine", path.endswith(".json")).json(path)
    return rows.select(F.monotonically_increasing_id().alias("chunk_seq"), F.concat_ws("::", "file_path", "qualname").alias("chunk_id"), "*")
