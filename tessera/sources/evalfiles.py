"""Sources of the evaluation: questions, manifest, baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import BENCHMARK_REPOS


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(QA questions, impact questions) of a JSON-lines file; blank lines are skipped, an
    unknown type or a broken line fails the job that reads it."""
    fields = "type string, id string, question string, target string, expected_qualnames array<string>, expected_keywords array<string>, expected_direct_callers array<string>, expected_tests array<string>"
    rows = spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    kind = F.when(F.col("type").isin("qa", "impact"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("Unknown question type: "), F.coalesce("type", F.lit("null")))))
    typed = rows.withColumn("type", kind)
    none = F.array().cast("array<string>")
    listed = lambda name: F.coalesce(name, none).alias(name)
    qa = typed.where("type = 'qa'").select("id", "question", listed("expected_qualnames"), listed("expected_keywords"))
    impact = typed.where("type = 'impact'").select("id", "target", listed("expected_direct_callers"), listed("expected_tests"))
    return qa, impact


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark repositories of a YAML file (a list, or a mapping with the list under ``repos``)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f)
    entries = entries["repos"] if isinstance(entries, dict) else entries
    names = [c.split()[0] for c in BENCHMARK_REPOS.split(", ")]
    return spark.createDataFrame([tuple(str(e[n]) for n in names) for e in entries], BENCHMARK_REPOS)


def choose_repos(manifest: DataFrame, names: list[str] | None) -> DataFrame:
    """The named repositories, or all; none found is an error."""
    chosen = manifest if names is None else manifest.where(F.col("name").isin(names))
    if chosen.isEmpty():
        raise ValueError(f"No matching benchmark repos: {names}")
    return chosen


def read_baseline(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
