"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters has an error budget of k edits (a share of n). Cut into
k + 1 pieces, every text within k edits of the item holds at least one piece unchanged.
So the pieces of all items are searched in every document by one automaton, and around
each hit Myers' bit-parallel algorithm finds the least edit distance between the item and
any substring there. A document with a substring within the budget is contaminated.
An item shorter than ``WORD_CHARS`` after normalizing has its budget too (1 or 2 edits from
13 characters on), but only a substring that no word runs on over the ends of counts for it.

Items and texts are compared lower-cased with white space runs as one space.

The items are taken in blocks of bounded size (``BLOCK_CHARS`` characters), each
broadcast to a pass over the documents; a small benchmark is one block, a large one more
passes. The driver reads one block at a time and leaves it on disk as a broadcast file, so
neither its memory nor the plan grows with the benchmark. No document is shuffled.

Defined results: null and empty items match nothing; equal items each give their match; a
null or empty text matches nothing; repeated documents are each judged; empty tables give
an empty table of matches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_batches, table

#: Edits allowed in an item, as a share of its characters.
ERROR_RATE = 0.08
#: Characters below which an item is found only as whole words.
WORD_CHARS = 30
#: Characters of one block of items: what a worker holds, whatever the benchmark's size.
BLOCK_CHARS = 4_000_000
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_MATCHES = "doc_id long, item_id long, distance int, budget int, match_end long"


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length: (offset, piece)."""
    n, count = len(item), budget + 1
    cuts = [i * n // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _in_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN" and not _UNSPACED.match(c)


def _edge(text: str, at: int) -> bool:
    """Does no word run on over place ``at`` of the text?"""
    return not (0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at]))


def _distance(a: str, b: str) -> int:
    """The edit distance of two short strings as wholes."""
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        last, row = row, [j]
        for i in range(1, len(a) + 1):
            row.append(min(last[i - 1] + (a[i - 1] != c), last[i] + 1, row[i - 1] + 1))
    return row[-1]


class Pattern:
    """An item with the bit masks of Myers' algorithm."""

    def __init__(self, item_id: int | None, text: str, rate: float, whole: bool = False):
        self.item_id, self.text, self.whole = item_id, text, whole
        self.budget = int(len(text) * rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any substring of ``text``, and the end
        of the first such substring."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end, get = m, 0, self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            h_plus = minus | (full & ~(d | plus))
            h_minus = plus & d
            if h_plus & top:
                score += 1
            elif h_minus & top:
                score -= 1
            h_plus = h_plus << 1 & full
            h_minus = h_minus << 1 & full
            plus = h_minus | (full & ~(x | h_plus))
            minus = h_plus & x
            if score < best:
                best, end = score, j
        return best, end

    def search_words(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """For a short item: the least edit distance within the budget to a substring of
        text[lo:hi] whose ends no word runs over, and the end of the first such substring."""
        if self.search(text[lo:hi])[0] > self.budget:
            return None
        m, k, best = len(self.text), self.budget, None
        edges = [at for at in range(lo, min(hi, len(text)) + 1) if _edge(text, at)]
        known = set(edges)
        for begin in edges:
            for end in range(begin + m - k, begin + m + k + 1):
                if end in known and end > begin:
                    distance = _distance(self.text, text[begin:end])
                    if distance <= k and (best is None or (distance, end) < best):
                        best = (distance, end)
        return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float, word_chars: int):
        import ahocorasick

        self.patterns = [Pattern(i, t, rate, len(t) < word_chars) for i, t in ((i, normalize(t)) for i, t in items) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, pattern in enumerate(self.patterns):
            for offset, piece in pieces(pattern.text, pattern.budget):
                places.setdefault(piece, []).append((p, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> Iterator[tuple[int | None, int, int, int]]:
        """(item id, distance, budget, end) for each item found in a text."""
        text = normalize(raw)
        if not text or not self.patterns:
            return
        spans: dict[int, list[tuple[int, int]]] = {}
        ends: dict[int, int] = {}
        for last, (size, found) in self.automaton.iter(text):
            for p, offset in found:
                pattern = self.patterns[p]
                if p in ends:
                    continue
                if pattern.whole and size == len(pattern.text):  # no budget: the piece is the item
                    if _edge(text, last + 1 - size) and _edge(text, last + 1):
                        ends[p] = last + 1
                    continue
                begin = last + 1 - size - offset - pattern.budget
                spans.setdefault(p, []).append((max(0, begin), begin + len(pattern.text) + 2 * pattern.budget))
        for p in sorted(spans.keys() | ends.keys()):
            pattern, best = self.patterns[p], None
            if p in ends:
                yield pattern.item_id, 0, 0, ends[p]
                continue
            for lo, hi in _merged(spans[p]):
                if pattern.whole:
                    found = pattern.search_words(text, lo, hi)
                else:
                    distance, end = pattern.search(text[lo:hi])
                    found = (distance, lo + end) if distance <= pattern.budget else None
                if found and (best is None or found[0] < best[0]):
                    best = found
                if best and not best[0]:
                    break
            if best:
                yield pattern.item_id, best[0], pattern.budget, best[1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows with those that overlap run together: (begin, end), in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _find(shared, rate: float, word_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate, word_chars)
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for found in matcher.matches(text.as_py())]
            ids, items, distance, budget, end = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(distance, pa.int32()), pa.array(budget, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "budget", "match_end"])

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, block by block; the driver holds one block at a time (and one partition
    while it arrives)."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, word_chars: int = WORD_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, match_end (in the normalized text) for each
    document and item that matches within the budget, ``rate`` of the item's characters (below ``word_chars`` as whole words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc, found = texts.sparkSession.sparkContext, None
    for block in _blocks(benchmark, block_chars):
        one = map_batches(texts, _find(sc.broadcast(block), rate, word_chars), _MATCHES)
        found = one if found is None else found.unionAll(one)
    return found if found is not None else texts.sparkSession.createDataFrame([], _MATCHES)


def _clean(shared, rate: float, word_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate, word_chars)
        for batch in batches:
            keep = [not any(True for _ in matcher.matches(t.as_py())) for t in batch["text"]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, word_chars: int = WORD_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a match, in their own columns: one filter for each block."""
    sc, out = docs.sparkSession.sparkContext, docs
    for block in _blocks(benchmark, block_chars):
        out = map_batches(out, _clean(sc.broadcast(block), rate, word_chars), docs.schema)
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
