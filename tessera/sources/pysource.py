"""``pyrepo``: a data source of the Python files below a directory.

Spark's own file sources hide names that begin with an underscore, so ``__init__.py``
would be lost. The directory walk prunes skipped and ignored directories instead of
filtering afterwards; files are read where their partition runs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.schemas import SOURCE_FILES
from tessera.sources.gitwild import Ignore

# Directories that are never source.
SKIPPED = (".git", "__pycache__", ".venv", "venv", ".mypy_cache", ".ruff_cache", ".pytest_cache")
INDEX_DIR = ".tessera"
#: Files of one partition.
FILES_PER_PARTITION = 200


def discover(root: str, index_dir: str = INDEX_DIR) -> list[str]:
    """Relative posix paths of the Python files below ``root``, sorted by path parts."""
    lines = [".git/"]
    if os.path.exists(ignore := os.path.join(root, ".gitignore")):
        with open(ignore, encoding="utf-8") as f:
            lines += f.read().splitlines()
    ignored, skipped, found = Ignore(lines), {*SKIPPED, index_dir}, []
    for folder, folders, names in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if below == "." else f"{below}/"
        folders[:] = [d for d in folders if d not in skipped and not ignored(prefix + d, directory=True)]
        found += [prefix + n for n in names if n.endswith(".py") and n not in skipped and not ignored(prefix + n)]
    return sorted(found, key=lambda p: p.split("/"))


def module_name(rel_path: str) -> str:
    """``a/b/c.py`` -> a.b.c, ``a/__init__.py`` -> a, ``__init__.py`` -> __init__."""
    parts = rel_path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] == "__init__" else parts)


def module_of(rel_path: Column) -> Column:
    """:func:`module_name` as an expression."""
    stem = F.regexp_replace(rel_path, r"\.py$", "")
    return F.translate(F.regexp_replace(stem, r"/__init__$", ""), "/", ".")


def decode(data: bytes) -> str:
    """Strict UTF-8 with universal newlines."""
    return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class _Files(InputPartition):
    first: int
    paths: Sequence[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str, index_dir: str):
        self.root, self.index_dir = root, index_dir

    def partitions(self) -> Sequence[InputPartition]:
        paths = discover(self.root, self.index_dir)
        return [_Files(i, paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [_Files(0, [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for seq, path in enumerate(partition.paths, partition.first):
            content = error = None
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = decode(f.read())
            except (UnicodeDecodeError, OSError) as x:
                error = str(x)
            yield seq, path, module_name(path), content, path.rsplit("/", 1)[-1] == "__init__.py", error


class PyRepoSource(DataSource):
    """Options: path (the root directory) and indexDir (a directory name to skip)."""

    @classmethod
    def name(cls) -> str:
        return "pyrepo"

    def schema(self) -> str:
        return SOURCE_FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("indexDir", INDEX_DIR))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PyRepoSource)


def read_repo(spark: SparkSession, root: str, index_dir: str = INDEX_DIR) -> DataFrame:
    """The Python files below ``root`` as ``SOURCE_FILES`` rows."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    register(spark)
    return spark.read.format("pyrepo").option("indexDir", index_dir).load(os.path.abspath(root))


def files_of_table(files: DataFrame, make: Callable[[Column], Column] = lambda content: content) -> DataFrame:
    """``SOURCE_FILES`` rows of a table (rel_path, content): a corpus that is no directory.
    Rows are range-sorted by path, so file_seq rises with it. A parse takes far longer than
    its bytes suggest, so the ranges are not coalesced by their size. ``make``: what turns a row's content
    into source; ranges are found in a pass of its own, which does not make it."""
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = F.col("made")  # in a step of its own, as it is used more than once
    return (
        files.select("rel_path", "content")
        .repartitionByRange(ranges, F.split("rel_path", "/"))
        .sortWithinPartitions(F.split("rel_path", "/"))
        .select(F.monotonically_increasing_id().alias("file_seq"), "rel_path", make(F.col("content")).alias("made"))
        .select(
            "file_seq",
            "rel_path",
            module_of(F.col("rel_path")).alias("module"),
            F.when(made.contains("\r"), F.regexp_replace(made, "\r\n?", "\n")).otherwise(made).alias("content"),
            (F.element_at(F.split("rel_path", "/"), -1) == "__init__.py").alias("is_package_init"),
            F.when(made.isNull(), "no content").alias("error"),
        )
    )
