"""A training-data pipeline: five stages over ``documents``, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets what
was written of it. All but the last return the columns of documents.

1. language: the documents that output codes identify. Those without letters go and those whose
   text is plainly in another language than their label; the ambiguous ones stay, and a missing
   label becomes the predicted one. The model learns from the stage's own labelled documents.
2. near_duplicates: of each group of documents linked by a Jaccard similarity of 0.8 or
   more of their five-word shingles the one with the least id stays.
3. decontamination: documents with a passage within the error budget of a benchmark item go.
4. mix: sources are mixed to their target weights; a document appears once for each copy.
5. tokens: what is left is written as wavelet shards of token ids and read back.

An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import edit_match, jaccard_join, language_id, mixing, token_shards
from tessera.llm._shared import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return edit_match.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, mixing.schedules(mixing.WEIGHTS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.read_documents(token_shards.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]

#: The stages learn, sketch and tokenize; SQL has no words for that. Tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two of them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
