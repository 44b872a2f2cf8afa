"""Fill-in-the-middle texts: a document is cut at two ranks of its units and its parts are
put in another order.

A unit is a match of a pattern (a line), found left to right. The matcher reads a text
twice and stores no unit: the first pass only counts the matches, which gives the two
ranks; the second advances a lazy match iterator to the lower rank and then on to the
higher one. So the memory of a text is the text, the text that is made of it and two match
objects, however many units it has.

Ranks and form follow from a hash of the seed and the document's id, so neither the order
of rows nor their partition changes a result, and a lost task gives the same again.

Defined results: a null text is an empty one. An empty text, and one that contains a
sentinel (it could not be rebuilt), is plain: the output is the text. A null id is hashed as
the empty string. Equal rows give equal rows, each its own. Of an input only the id and
the text are read; other columns are left out, whatever their names are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import Batches, map_batches, table

# Fixed values of the contract: the unit, the sentinels, the seed and the shares in percent.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


@dataclass(frozen=True)
class Format:
    """How texts are cut and put together. rate: how many of a hundred documents are cut;
    spm_rate: how many of a hundred of those have the suffix first. No end of a sentinel may
    be the beginning of another one, so that text beside a sentinel never makes a new one."""

    unit: str = UNIT
    prefix: str = PREFIX
    suffix: str = SUFFIX
    middle: str = MIDDLE
    seed: int = SEED
    rate: int = RATE
    spm_rate: int = SPM_RATE


def count_units(unit: re.Pattern, text: str) -> int:
    """The first pass: how many units ``text`` has. Each match is dropped as the next is found."""
    return sum(1 for _ in unit.finditer(text))


def cut_places(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where the first ``low`` and the first ``high`` units of ``text`` end."""
    matches, at = unit.finditer(text), []
    for steps in (low, high - low):
        last = next(islice(matches, steps - 1, None), None) if steps else None
        at.append(last.end() if last else at[-1] if at else 0)
    return at[0], at[1]


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight hexadecimal digits of the id's digest, as numbers."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearrange(form: Format, unit: re.Pattern, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and output of one text."""
    n = count_units(unit, text)
    h = draws(form.seed, doc_id)
    if not text or any(s in text for s in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = cut_places(unit, text, low, high)
    parts = {form.prefix: text[:a], form.suffix: text[b:], form.middle: text[a:b]}
    kind = "spm" if h[3] % 100 < form.spm_rate else "psm"
    order = (form.suffix, form.prefix, form.middle) if kind == "spm" else (form.prefix, form.suffix, form.middle)
    return n, kind, a, b - a, "".join(s + parts[s] for s in order)


def fill_in_middle(docs: DataFrame, form: Format = Format(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs``: no
    shuffle, one pass over the texts, a bounded number of bytes at a time."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        unit = re.compile(form.unit)
        for batch in batches:
            rows = [(key.as_py(), *rearrange(form, unit, key.as_py(), value.as_py() or "")) for key, value in zip(batch.column(0), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def restored(output: Column, form: Column, how: Format = Format()) -> Column:
    """The text again, from an output and its form alone. A text that contains a sentinel is
    plain, so each sentinel stands once in the output of the others."""

    def after(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)

    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    middle = after(output, how.middle)
    head = before(output, how.middle)
    psm = F.concat(after(before(head, how.suffix), how.prefix), middle, after(head, how.suffix))
    spm = F.concat(after(head, how.prefix), middle, after(before(head, how.prefix), how.suffix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle text: digests of it and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same with lists of all units, which is what the operator does without.
OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS unit, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(unit) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (
  SELECT *, coalesce(array_to_string(unit[1:low], ''), '') AS p, coalesce(array_to_string(unit[low + 1:high], ''), '') AS m, coalesce(array_to_string(unit[high + 1:n], ''), '') AS s FROM ranked),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parted)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
                        ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4) END) AS restored_sha256
FROM made"""
