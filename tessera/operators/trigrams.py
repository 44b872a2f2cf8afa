"""Substring lookup of names in texts by a trigram index of the texts' words.

A name of letters, digits and underscores stands in a text if it stands inside one of the
text's words. So the index has two tables: the words with the chunks they are in, and the
trigrams with the distinct words that contain them. A lookup intersects the trigrams' word
lists of a name, verifies the words that are left, and follows those to their chunks. What
is proportional to the texts (words and chunks) is joined by equality with few words; what is
compared letter by letter are words that have all of a name's trigrams.

A name under three letters is what some gram begins with. A name with other characters is looked up by its
longest part of letters, and verified in the text. A name without any letter, digit or
underscore has nothing to look up and is searched for in the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in a text.
NO_WORD = r"[^\p{L}\p{N}_]+"
SIZE = 3
SLOTS = 16
OWN = ("chunk_id", "chunk_seq", "file", "qualname", "start_line")
WORDS = "word string, chunk_id string, chunk_seq long, file string, qualname string, start_line int, slot int"
GRAMS = "gram string, word string, slot int"


@dataclass
class TrigramIndex:
    """words (word and a chunk's columns), grams (gram, word), texts (the chunks with text)."""

    words: DataFrame
    grams: DataFrame
    texts: DataFrame


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int").alias("slot")


def grams_of(word: Column) -> Column:
    """The distinct trigrams of a word, and what is left of it from its last two letters on: so
    every part of one or two letters begins one of them."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.substr(word, k, F.lit(SIZE))))


def build(texts: DataFrame) -> TrigramIndex:
    """The index of ``texts`` (chunk_id, chunk_seq, file, qualname, start_line, text)."""
    words = texts.select(F.explode(F.array_distinct(F.split("text", NO_WORD))).alias("word"), *OWN).where("word <> ''")
    grams = words.select("word").distinct().select(F.explode(grams_of(F.col("word"))).alias("gram"), "word")
    return TrigramIndex(words, grams, texts)


def save(index: TrigramIndex, path: str) -> TrigramIndex:
    """Writes words by a bucket of the word and grams by a bucket of the gram, sorted in it."""
    for table, key in ((index.words, "word"), (index.grams, "gram")):
        table.withColumn("slot", _slot(key)).repartition("slot").sortWithinPartitions("slot", key).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/{key}s")
    return load(index.texts.sparkSession, path, index.texts)


def load(spark: SparkSession, path: str, texts: DataFrame) -> TrigramIndex:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").drop("slot")
    return TrigramIndex(read("words", WORDS), read("grams", GRAMS), texts)


def _longest(name: Column) -> Column:
    """The longest part of letters, digits and underscores; of several the first."""
    parts = F.filter(F.split(name, NO_WORD), lambda p: p != "")
    return F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def _asked(piece: Column) -> Column:
    """The trigrams of a piece, all of which its words have; none of a shorter one."""
    n = F.length(piece)
    three = F.transform(F.sequence(F.lit(1), F.greatest(n - (SIZE - 1), F.lit(1))), lambda k: F.substr(piece, k, F.lit(SIZE)))
    return F.array_distinct(F.when(n >= SIZE, three).otherwise(F.array().cast("array<string>")))


def find(index: TrigramIndex, names: DataFrame) -> DataFrame:
    """name and a chunk's columns of every chunk whose text has a name of ``names`` (name)."""
    named = names.select("name", _longest(F.col("name")).alias("piece")).distinct()
    pieces = named.where("piece <> ''").select("piece").distinct()
    wanted = pieces.select("piece", _asked(F.col("piece")).alias("grams"))
    lists = index.grams.join(wanted.select("piece", F.size("grams").alias("need"), F.explode("grams").alias("gram")), "gram")
    having = lists.groupBy("piece", "word").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need")).where(F.col("have") == F.col("need")).select("piece", "word")
    for n in range(1, SIZE):
        begun = index.grams.select(F.left("gram", F.lit(n)).alias("piece"), "word").join(pieces.where(F.length("piece") == n), "piece")
        having = having.unionByName(begun.distinct())
    verified = having.where(F.contains(F.col("word"), F.col("piece"))).select("piece", "word")
    chunks = index.words.join(verified, "word").select("piece", *OWN).distinct()
    found = chunks.join(named, "piece")
    plain = found.where(F.col("name") == F.col("piece")).select("name", *OWN)
    keys = ["chunk_id", "chunk_seq"]
    other = found.where(F.col("name") != F.col("piece")).select("name", *OWN).join(index.texts.select(*keys, "text"), keys)
    bare = index.texts.join(named.where("piece = ''").select("name"), F.contains(F.col("text"), F.col("name")))
    return plain.unionByName(other.where(F.contains(F.col("text"), F.col("name"))).select("name", *OWN)).unionByName(bare.select("name", *OWN))
