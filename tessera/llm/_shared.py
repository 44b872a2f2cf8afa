"""What the operators of this subpackage share: shared storage and table helpers."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the words of this subpackage see it: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent on a single machine, as in tests, a temporary
    folder is made, set, and removed when the process ends. A cluster without the setting
    is an error: what its machines write to folders of their own nobody else can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path of this application in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a cut in the
    lineage that outlives any executor. The write's own shuffle files go when it ends; nothing
    reads them after the cut."""
    spark = session_of(df)
    path, key = shared_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again."""
    spark = session_of(df)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def known_id(doc_id: Column) -> Column:
    """An id that joins and sorts: null as the least number."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of a row; equal rows have one digest. Maps have no hash of
    their own and take part as JSON."""

    def hashable(field) -> Column:
        c = F.col(f"`{field.name}`")
        return F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c

    return F.xxhash64(*[hashable(f) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null.

    The words are what lies between runs of white space, so they number one more
    than the runs that are left after trimming.
    """
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(
        text.isNull() | (F.length(trimmed) == 0), F.lit(0).cast("long")
    ).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).cast("long"))


#: Bytes of an Arrow batch: what a Python worker gets of (possibly very long) texts at once.
BATCH_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def release_memory() -> None:
    """Gives freed memory back: a worker that is used again would otherwise keep the most
    that any task before needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)
        if trim is not None:
            trim(0)


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, leaving no memory behind."""
    spark, key = session_of(df), "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def lean(batches: Batches) -> Batches:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(lean, schema)
