"""Lookups on chunks, and the registry of tools that a language model may call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import truncate_text
from tessera.operators import trigrams
from tessera.operators.graph import last_segment

#: Names that texts are searched for without an index.
SCANNED = 64
VIEW = ("file", "qualname", "kind", "start_line", "end_line", "text")


def tool_view(chunks: DataFrame) -> DataFrame:
    """The columns that tools show."""
    return chunks.select(F.col("file_path").alias("file"), "qualname", "kind", "start_line", "end_line", "text")


def last_wins(rows: DataFrame, key: str, seq: str = "chunk_seq") -> DataFrame:
    """One row for each key: the last by ``seq``. ``first_seq`` is where the key first stood."""
    columns = [c for c in rows.columns if c not in (key, "first_seq")]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("r"), F.min(seq).alias("first_seq"))
    return out.select(key, *[F.col(f"r.{c}").alias(c) for c in columns], "first_seq")


def get_definition(chunks: DataFrame, qualnames: DataFrame) -> DataFrame:
    """target, and the tool view of the last chunk with that qualified name."""
    wanted = chunks.join(qualnames, F.col("qualname") == F.col("target"))
    return tool_view_of(last_wins(wanted, "target"))


def tool_view_of(rows: DataFrame) -> DataFrame:
    return rows.select("target", F.col("file_path").alias("file"), "qualname", "kind", "start_line", "end_line", "text")


def is_test_file(path: Column) -> Column:
    """In a directory ``tests``, or named test_*."""
    parts = F.split(path, "/")
    return F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "tests") | F.startswith(F.element_at(parts, -1), F.lit("test_"))


def test_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of test files, as a trigram index takes them."""
    return chunks.where(is_test_file(F.col("file_path"))).select("chunk_id", "chunk_seq", F.col("file_path").alias("file"), "qualname", "start_line", "text")


def find_tests(chunks: DataFrame, targets: DataFrame, index: trigrams.TrigramIndex | None = None) -> DataFrame:
    """target, file, qualname, start_line, first_seq: chunks of test files whose text has
    the target's last name, anywhere in it. Chunks are those that win by chunk_id. Texts are
    searched through their trigram index: the one given, or one made of the test chunks. For few
    names and no index given none is made, which would cost more than a look into each text."""
    named = targets.select("target", last_segment(F.col("target")).alias("name"))
    if index is None and named.count() <= SCANNED:
        names = F.broadcast(named.select("name").distinct())
        hits = test_chunks(chunks).join(names, F.contains(F.col("text"), F.col("name"))).select("name", *trigrams.OWN)
    else:
        hits = trigrams.find(index or trigrams.build(test_chunks(chunks)), named.select("name"))
    seqs = chunks.where(is_test_file(F.col("file_path"))).groupBy("chunk_id").agg(F.max("chunk_seq").alias("chunk_seq"), F.min("chunk_seq").alias("first_seq"))
    return hits.join(seqs, ["chunk_id", "chunk_seq"]).join(named, "name").select("target", "file", "qualname", "start_line", "first_seq")


def truncated(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", truncate_text(F.col("text")))


def _object(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required}


_STRING, _BOOLEAN, _INTEGER = {"type": "string"}, {"type": "boolean"}, {"type": "integer"}
#: What a model is told of each tool: name, description, JSON schema of the arguments.
TOOL_SPECS = (
    ("search_code", "Search the indexed code by words and by meaning. A good first step for open questions.", _object(["query"], query=_STRING, top_k=_INTEGER)),
    ("get_definition", "The source of a symbol whose full dotted name is known.", _object(["qualname"], qualname=_STRING)),
    ("get_callers", "Who calls a symbol, by the static call graph; transitive adds indirect callers.", _object(["qualname"], qualname=_STRING, transitive=_BOOLEAN)),
    ("get_callees", "What a symbol calls, by the static call graph.", _object(["qualname"], qualname=_STRING)),
    ("get_importers", "The modules that import a module.", _object(["module"], module=_STRING)),
    ("find_tests_for", "Tests that probably cover a symbol.", _object(["qualname"], qualname=_STRING)),
)
