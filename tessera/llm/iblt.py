"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs; each has a 64-bit digest. A sketch has cells of a count, a
sum of digests and one of their check digests; a digest goes to one cell in each of three
parts. Peeling takes digests out: a cell that holds one digest gives it away, and taking
it out of its other cells may leave more such cells. A text's fingerprint is its sketch,
with cells in proportion to its paragraphs, made larger until peeling it recovers them
all. So fingerprints can be compared without their texts: the smaller sketch is made anew
at the size of the larger from the digests that it gives away, one is subtracted from the
other, and peeling the rest gives the digests that only one of two versions has; where
that gets stuck, both are made larger and the attempt is repeated. The likeness of two
versions is 1 - differing / (those of one + those of the other).

Paragraphs are lines, and sentences of lines, cut once more between equal words and after
words chosen by their own digest, so a change moves only the cuts around it. The first
``HEAD`` words of every text are paragraphs of their own, whatever its length: so a short
text has enough paragraphs to be alike in part, and two texts are cut by one rule.

For :func:`compare_versions` documents are dealt out in blocks of the order of their ids;
the first document of the block that follows is sent along, so every document meets the
one after it. Text is shuffled once. Sketches of many documents are filled, subtracted and
peeled together, as arrays.

Defined results: a null text is empty; two empty texts are alike (1.0), an empty one and
one with paragraphs are not (0.0); a repeated paragraph counts once; a null id is less than
all ids; rows with one id are ordered by a digest of the text; a lone document follows
itself; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import known_id, map_batches, partitions, session_of, table
from tessera.llm._words import mix, slices

#: One word in so many ends a paragraph by its digest; a power of two.
CUT = 8
#: Words at the beginning of a text that are paragraphs of their own.
HEAD = 16
#: Characters of documents that are compared together.
CHUNK_CHARS = 2_000_000
_PARTS = 3
_POWER = 0x9E3779B97F4A7C15 | 1
_CELL = np.dtype([("count", "<u2"), ("sum", "<u8"), ("check", "<u4")])

_DEALT = "block int, halo boolean, id long, tie long, doc_id long, text string"
_COMPARED = "doc_id long, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass
class Keys:
    """The distinct paragraph digests of some texts, those of text d at first[d]:first[d + 1]."""

    key: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)

    def take(self, rows: np.ndarray) -> Keys:
        n = self.size[rows]
        first = np.concatenate([[0], np.cumsum(n)])
        return Keys(self.key[np.arange(first[-1]) + np.repeat(self.first[:-1][rows] - first[:-1], n)], first)


def _ends(words, h: np.ndarray) -> np.ndarray:
    """For each word: does a paragraph end after it?"""
    last = words.data[words.end - 1]
    lines = np.cumsum(words.data == 0x0A)
    ends = (last == ord(".")) | (last == ord("!")) | (last == ord("?")) | (mix(h, 22) % np.uint64(CUT) == 0)
    ends |= np.arange(len(h)) - words.first[:-1][words.doc] < HEAD
    ends[:-1] |= (lines[words.start[1:]] > lines[words.end[:-1] - 1]) | (h[1:] == h[:-1])
    bounds = words.first[1:]
    ends[bounds[np.diff(words.first) > 0] - 1] = True
    return ends


def _paragraphs(column: pa.Array) -> Iterator[tuple]:
    """For each slice of documents its words, their digests, and where paragraphs begin."""
    for words in slices(column):
        h = words.digests(21)
        if len(h):
            ends = _ends(words, h)
            yield words, h, np.flatnonzero(np.concatenate([[True], ends[:-1]]))
        else:
            yield words, h, np.zeros(0, np.int64)


def paragraphs(text: str) -> list[str]:
    """The paragraphs of one text, each as its words joined by one space."""
    out = []
    for words, h, begin in _paragraphs(pa.array([text], pa.string())):
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True):
            out.append(" ".join(bytes(words.data[s:e]).decode("utf-8") for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)))
    return out


def digests(column: pa.Array) -> Keys:
    """The paragraph digests of each text of a string column, in order."""
    found, sizes = [], []
    for words, h, begin in _paragraphs(column):
        n = np.diff(np.concatenate([begin, [len(h)]]))
        docs = words.rows.stop - words.rows.start
        if not len(h):
            sizes.append(np.zeros(docs, np.int64))
            continue
        powers = np.cumprod(np.full(int(n.max()), _POWER, np.uint64))
        place = np.arange(len(h)) - np.repeat(begin, n)
        key = mix(np.add.reduceat(mix(h, 23) * powers[place], begin) + n.astype(np.uint64), 24)
        doc = words.doc[begin]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        found.append(key[new])
        sizes.append(np.bincount(doc[new], minlength=docs))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return Keys(np.concatenate(found) if found else np.zeros(0, np.uint64), first.astype(np.int64))


def _check(key: np.ndarray) -> np.ndarray:
    return (mix(key, 25) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """The sketches of some texts side by side; ``part`` cells in each of a text's parts."""

    def __init__(self, part: np.ndarray):
        self.part = part.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(_PARTS * self.part)])
        total = int(self.base[-1])
        self.counts, self.sums, self.checks = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint32)

    @staticmethod
    def of(keys: Keys, part: np.ndarray) -> Sketches:
        out = Sketches(part)
        out._add(np.repeat(np.arange(len(part)), keys.size), keys.key, np.ones(len(keys.key), np.int64))
        return out

    def _cells(self, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        part, base = self.part[doc], self.base[doc]
        n = part.astype(np.uint64)
        return np.stack([base + (key % n).astype(np.int64), base + part + ((key >> np.uint64(21)) % n).astype(np.int64), base + 2 * part + ((key >> np.uint64(42)) % n).astype(np.int64)])

    def _add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray) -> np.ndarray:
        cells = self._cells(doc, key)
        sums, checks = key * sign.astype(np.uint64), _check(key) * sign.astype(np.uint32)
        for at in cells:
            np.add.at(self.counts, at, sign)
            np.add.at(self.sums, at, sums)
            np.add.at(self.checks, at, checks)
        return cells

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.part)
        out.counts, out.sums, out.checks = self.counts - other.counts, self.sums - other.sums, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, digest, sign of what the sketches give away, and which texts' gave away
        all. Uses the sketches up."""
        owner = np.repeat(np.arange(len(self.part)), _PARTS * self.part)
        docs, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at, given = np.flatnonzero(np.abs(self.counts) == 1), 0
        while len(at) and given <= len(owner):
            sign, doc = self.counts[at], owner[at]
            key = self.sums[at] * sign.astype(np.uint64)
            own = (_check(key) == self.checks[at] * sign.astype(np.uint32)) & (self._cells(doc, key) == at).any(axis=0)
            doc, key, sign = doc[own], key[own], sign[own]
            order = np.lexsort((key, doc))  # a digest may be alone in two or three of its cells
            doc, key, sign = doc[order], key[order], sign[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            doc, key, sign = doc[new], key[new], sign[new]
            docs.append(doc), keys.append(key), signs.append(sign)
            given += len(key)
            touched = np.unique(self._add(doc, key, -sign))
            at = touched[np.abs(self.counts[touched]) == 1]
        left = (self.counts != 0) | (self.sums != 0) | (self.checks != 0)
        whole = ~np.logical_or.reduceat(left, self.base[:-1]) if len(self.part) else np.zeros(0, bool)
        return np.concatenate(docs), np.concatenate(keys), np.concatenate(signs), whole

    def texts(self) -> list[str]:
        cells = np.zeros(len(self.counts), _CELL)
        cells["count"], cells["sum"], cells["check"] = self.counts, self.sums, self.checks
        return [base64.b64encode(cells[a:b].tobytes()).decode() for a, b in zip(self.base[:-1].tolist(), self.base[1:].tolist(), strict=True)]

    @staticmethod
    def from_texts(texts: Sequence[str]) -> Sketches:
        cells = [np.frombuffer(base64.b64decode(t), _CELL) for t in texts]
        out = Sketches(np.array([len(c) // _PARTS for c in cells], np.int64))
        every = np.concatenate(cells) if cells else np.zeros(0, _CELL)
        out.counts, out.sums, out.checks = every["count"].astype(np.int64), every["sum"].astype(np.uint64), every["check"].astype(np.uint32)
        return out


def _larger(part: np.ndarray, factor: float) -> np.ndarray:
    return (np.ceil(part * factor / 4) * 4).astype(np.int64)


def fingerprints(keys: Keys) -> Sketches:
    """The sketch of each text, as large as it has to be to give all its digests away."""
    part = _larger(keys.size + 10, 0.5)
    pending = np.arange(len(part))
    while len(pending):
        whole = Sketches.of(keys.take(pending), part[pending]).peel()[3]
        pending = pending[~whole]
        part[pending] = _larger(part[pending], 1.5)
    return Sketches.of(keys, part)


def given_away(sketches: Sketches) -> Keys:
    """The digests that fingerprints hold."""
    doc, key, _, _ = sketches.minus(Sketches(sketches.part)).peel()
    order = np.lexsort((key, doc))
    return Keys(key[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sketches.part)))]))


def differing(a: Keys, b: Keys, part: np.ndarray) -> np.ndarray:
    """How many digests only one of each pair of texts has, by sketches alone; ``part``: the
    larger size of the pair's two fingerprints. Sketches grow until peeling succeeds."""
    out, part = np.zeros(len(part), np.int64), part.copy()
    pending = np.arange(len(part))
    while len(pending):
        doc, _, _, whole = Sketches.of(a.take(pending), part[pending]).minus(Sketches.of(b.take(pending), part[pending])).peel()
        out[pending] = np.bincount(doc, minlength=len(pending))
        pending = pending[~whole]
        part[pending] *= 2
    return out


def likeness(a: Keys, b: Keys, part: np.ndarray) -> np.ndarray:
    total = a.size + b.size
    return np.where(total > 0, 1.0 - differing(a, b, part) / np.maximum(total, 1), 1.0)


def compare_fingerprints(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The likeness of each pair of fingerprints, from nothing but the two."""
    of_a, of_b = Sketches.from_texts(a), Sketches.from_texts(b)
    part = np.maximum(of_a.part, of_b.part)
    return likeness(given_away(of_a), given_away(of_b), part)


def _deal(bounds: np.ndarray, after: dict[int, int]):
    """Rows with their block; those that end a block (``after``: id -> block) once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            block = np.searchsorted(bounds, ids).astype(np.int32)
            ends = np.flatnonzero(np.isin(ids, np.fromiter(after, np.int64, len(after))))
            for rows, where, halo in ((np.arange(len(ids)), block, False), (ends, np.array([after[i] for i in ids[ends].tolist()], np.int32), True)):
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array([halo] * len(rows)), part["id"], part["tie"], part["doc_id"], part["text"]], names=["block", "halo", "id", "tie", "doc_id", "text"])

    return run


def _greatest(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            ids = batch["id"].to_numpy()
            for b, i in zip(np.searchsorted(bounds, ids).tolist(), ids.tolist(), strict=True):
                most[b] = max(most.get(b, i), i)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], names=["block", "id"])

    return run


def _compared(rows: list[tuple], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """The result rows of ``pairs`` (a row of ``rows`` and the one that follows it)."""
    texts = [t for _, _, _, t in rows]
    edited = []
    for i, j in pairs:
        k = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - k] + texts[j][:k])
    own, new = digests(pa.array(texts, pa.large_string())), digests(pa.array(edited, pa.large_string()))
    sketches, new_sketches = fingerprints(own), fingerprints(new)
    strings = sketches.texts()
    i, j = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    near_edited = likeness(own.take(i), new, np.maximum(sketches.part[i], new_sketches.part))
    near_next = likeness(own.take(i), own.take(j), np.maximum(sketches.part[i], sketches.part[j]))
    columns = {
        "doc_id": pa.array([rows[a][2] for a in i.tolist()], pa.int64()),
        "n_chars": pa.array([len(texts[a]) for a in i.tolist()], pa.int64()),
        "edited": pa.array(edited, pa.string()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([strings[a] for a in i.tolist()], pa.string()),
        "edited_fingerprint": pa.array(new_sketches.texts(), pa.string()),
        "near_edited": pa.array(near_edited, pa.float64()),
        "near_next": pa.array(near_next, pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, pairs, held, size = [], [], None, 0  # held: the row whose follower comes next
    for batch in batches:
        for block, halo, doc_id, text in zip(batch["block"].to_pylist(), batch["halo"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
            follows = held is not None and rows[held][0] == block
            if halo and not follows:
                continue
            rows.append((block, halo, doc_id, text.as_py() or ""))
            size += len(rows[-1][3])
            if follows:
                pairs.append((held, len(rows) - 1))
            held = None if halo else len(rows) - 1
            if size >= CHUNK_CHARS and pairs:
                yield _compared(rows, pairs)
                rows, pairs, size = ([rows[held]] if held is not None else []), [], 0
                held = 0 if rows else None
    if pairs:
        yield _compared(rows, pairs)


def compare_versions(docs: DataFrame) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text): its fingerprint, its edited
    text (the last third replaced by the beginning of the document after it in descending
    order of ids; after the last comes the first) with digest and fingerprint, and the
    likeness of its fingerprint to the edited one and to the next document's."""
    n = 4 * partitions(session_of(docs))
    ids = docs.select(known_id(F.col("doc_id")).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"]
    bounds = np.unique(np.array(cuts or [], np.int64))
    # One row for each block reaches the driver.
    most = sorted((r["block"], r["id"]) for r in ids.mapInArrow(_greatest(bounds), "block int, id long").groupBy("block").agg(F.max("id").alias("id")).collect())
    after = {last: block for (_, last), (block, _) in zip([most[-1], *most[:-1]], most, strict=True)} if most else {}
    keyed = docs.select(known_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = map_batches(keyed, _deal(bounds, after), _DEALT).repartition(partitions(session_of(docs)), "block")
    ordered = dealt.sortWithinPartitions("block", "halo", F.col("id").desc(), "tie")
    return map_batches(ordered.select("block", "halo", "doc_id", "text"), _compare, _COMPARED)


def op9(spark, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents")).drop("edited")
