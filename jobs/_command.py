"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """The settings of a JSON file, which may be anywhere Spark reads from."""
    return spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)


def main(job: str, run: Callable[..., DataFrame], paths: Sequence[tuple[str, str]], argv: Sequence[str] | None = None) -> int:
    """Parses the paths, makes the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    for name, what in paths:
        parser.add_argument(name, help=what)
    parser.add_argument("--config", required=True, help="JSON file of settings")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        config = read_config(spark, args.pop("config"))
        run(spark, *[args[name] for name, _ in paths], config)
    finally:
        spark.stop()
    return 0
