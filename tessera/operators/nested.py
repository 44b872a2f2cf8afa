"""Tool answers as nested JSON: long texts cut wherever they stand, over a table.

A string under the key ``text`` is cut if it is longer than the limit, at any depth of
objects and lists; nothing else is touched. The cut works on the JSON text by expressions
alone. A scan finds the strings of a document of any depth, as JSON strings are a regular
language: a string is a quote, characters or escapes, a quote. A string followed by a colon
is a key, and the string after it is its value, so the values that may be cut are the
matches of one pattern, and only those that are too long are parsed and written anew.

What is no JSON is returned as it is, as is a null. A key is ``text`` as JSON writers write
it: one spelled with escapes is not recognized.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import TEXT_LIMIT, TRUNCATED

_STRING = r'"(?:[^"\\]|\\.)*+"'
#: A key ``text`` and a string for its value.
_VALUE = r'(?s)("text"\s*+:\s*+)(' + _STRING + r")"


def _pieces(answer: Column) -> Column:
    """The answer cut into tokens: keys ``text`` with their string values, other strings, and
    what is between strings."""
    return F.regexp_extract_all(answer, F.lit(r'(?s)"text"\s*+:\s*+' + _STRING + "|" + _STRING + r'|[^"]++|"'), F.lit(0))


def truncate_answer(answer: Column, limit: int = TEXT_LIMIT) -> Column:
    """``answer`` with every string under a key ``text`` cut to ``limit`` characters and marked."""

    def cut(piece: Column) -> Column:
        key, value = F.regexp_extract(piece, _VALUE, 1), F.regexp_extract(piece, _VALUE, 2)
        text = F.get_json_object(F.concat(F.lit('{"t":'), value, F.lit("}")), "$.t")
        short = F.to_json(F.struct(F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED)).alias("t")))
        # An escape is longer than its character: only what is long as written can be too long.
        long = F.startswith(piece, F.lit('"text"')) & (F.length(piece) > limit)
        return F.when(long, F.when(F.length(text) > limit, F.concat(key, F.regexp_extract(short, r'(?s)^\{"t":(.*)\}$', 1))).otherwise(piece)).otherwise(piece)

    whole = F.try_parse_json(answer).isNotNull() & (F.length(answer) > limit)
    return F.when(whole, F.array_join(F.transform(_pieces(answer), cut), "")).otherwise(answer)
