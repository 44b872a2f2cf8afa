"""Text and vector functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word and camel-case boundaries of code tokens; file.py:line citations.
SEPARATORS = "[^a-zA-Z0-9]+"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])"
CITATION = r"(?U)([\w./\\-]+\.py):(\d+)"
#: The longest text in a tool's answer.
TEXT_LIMIT = 2000
TRUNCATED = "... [truncated]"


def tokenize(text: Column) -> Column:
    """Lower-case words, each followed by its camel-case parts that differ from it.

    ``getUser id`` -> [getuser, get, user, id]. A null text has no tokens.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")

    def parts(word: Column) -> Column:
        low = F.lower(word)
        return F.when(low == word, F.array(low)).otherwise(F.concat(F.array(low), F.filter(F.transform(F.split(word, CAMEL), F.lower), lambda p: p != low)))

    # Most prose has no camel case. Then the words are those of the lower-cased text, and no
    # function has to run for each of them. (Two letters outside ASCII have ASCII lower cases.)
    plain = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    return F.when(text.rlike("[a-z0-9][A-Z]|[\u212a\u0130]"), F.flatten(F.transform(words, parts))).otherwise(plain)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double arithmetic; null where a vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def citations(text: Column) -> Column:
    """array<struct<file, line>> of ``file.py:line`` citations, in order."""
    files, lines = (F.regexp_extract_all(text, F.lit(CITATION), F.lit(i)) for i in (1, 2))
    return F.zip_with(files, lines, lambda f, n: F.struct(f.alias("file"), n.cast("decimal(38,0)").alias("line")))


def truncate_text(text: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def collection_suffix(path: Column) -> Column:
    """What tells the indexes of two repositories apart: 12 hex digits of the path's SHA-1."""
    return F.substring(F.sha1(path), 1, 12)


def two_decimals(x: Column) -> Column:
    """Half-even, as reports print it."""
    return F.format_number(x, 2)
