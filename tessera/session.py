"""Sessions with the settings that the engine is written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "tessera", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster use the cluster's own session, nothing here is required.

    ANSI mode, adaptive execution and Arrow are Spark's defaults. The number of shuffle
    partitions follows the cores: adaptive execution coalesces what is too small.
    """
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet in the folder which driver and executors share, the one that
    ``spark.checkpoint.dir`` names. Where a single machine does not set it, as in tests, a
    temporary folder takes its place until the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, True)
        shared = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
