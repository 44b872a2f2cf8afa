"""Language ID by error-correcting output codes.

Every language has a codeword of bits. For each bit an n-gram classifier tells the
languages whose bit is 1 from those whose bit is 0: hashed byte n-grams with the log odds
of their pooled frequencies. A text's classifier outputs are decoded by loss: each
language's codeword is charged the logistic loss of every bit, weighted by how well that
bit's two sides are apart, and the least loss wins. A text whose two nearest codewords
are charged almost alike is flagged as ambiguous.

With few languages the code is exhaustive (every split of the languages, so each pair of
codewords differs in more than half of the bits); with more it is a fixed random code
with columns enough.

Frequencies come from a sample of the labelled texts of each language, about
``SAMPLE`` of them, chosen by a digest of the id; they are summed in tasks and by Spark,
and the driver gets one row for each language and n-gram bin. The model has a fixed size
for a given number of languages. A prediction sees the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any labelled text everything is ``und``; with one label every text with letters has that
label; repeated rows are predicted alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_batches, session_of, table
from tessera.llm._words import text_buffers

#: Labelled texts of each language that the frequencies are taken from, about.
SAMPLE = 4000
#: n-grams of so many bytes, hashed to so many bins each.
GRAMS = (1, 2, 3, 4)
BINS = 1 << 14
#: Up to so many languages the code is exhaustive.
EXHAUSTIVE = 7
UNKNOWN = "und"
#: Loss by which the second codeword must be farther for a text not to be ambiguous.
MARGIN = 0.5
#: Loss by which the predicted language must be nearer than all others to overrule a label.
CONTRADICTED = 30.0
_SLICE = 1 << 19
#: n-grams whose odds, and texts whose losses, are held at once.
_STEP, _ROWS = 1 << 16, 1 << 10

_COUNTS = "lang string, bin int, n long"
_PREDICTED = "doc_id long, lang_pred string, score double, margin double, ambiguous boolean"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits for each of n languages."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.zeros(len(bits), int), *[(bits >> i) & 1 for i in range(n - 1)]]
        return np.where(np.array(rows) > 0, 1, -1).astype(np.int8)
    rng, best = np.random.RandomState(7), None
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _cleaned(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, everything else of ASCII as single spaces, one before and
    after each text; and the texts' new bounds."""
    padded = np.insert(_LETTERS[data], np.repeat(bounds, 2)[1:-1], 0x20)
    begin = bounds[:-1] + 2 * np.arange(len(bounds) - 1)
    end = bounds[1:] + 2 * np.arange(1, len(bounds))
    space = padded == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[begin] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return padded[keep], np.stack([at[begin], at[end]])


def _codes(clean: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the bins of the n-grams, by start."""
    wide, value = clean.astype(np.uint32), None
    for n in range(1, max(GRAMS) + 1):
        value = wide if value is None else (value[:-1] << np.uint32(8)) | wide[n - 1 :]
        if n in GRAMS:
            slot = np.uint32(GRAMS.index(n) * BINS)
            yield n, ((value * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - 14)) + slot


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Parts of a string column: first row, end row, cleaned bytes, bounds (2 rows), and how
    many of the bytes stood at the end of the part before. A text of more than ``_SLICE``
    bytes comes in parts of that size, the last few bytes of each again in the next."""
    at, data = text_buffers(column)
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + _SLICE, "right")) - 1)
        if at[to] - at[row] > _SLICE:
            for clean, again in _long(data[at[row] : at[to]]):
                yield row, to, clean, np.array([[0], [len(clean)]]), again
        else:
            yield row, to, *_cleaned(data[at[row] : at[to]], at[row : to + 1] - at[row]), 0
        row = to


def _long(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The cleaned bytes of one long text in parts, and how many of each are known."""
    tail = np.array([0x20], np.uint8)
    again, overlap = 0, max(GRAMS) - 1
    for lo in range(0, len(data), _SLICE):
        part = _LETTERS[data[lo : lo + _SLICE]]
        space = part == 0x20
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= tail[-1] != 0x20
        out = np.concatenate([tail, part[keep]])
        if lo + _SLICE >= len(data) and out[-1] != 0x20:
            out = np.concatenate([out, np.array([0x20], np.uint8)])
        yield out, again
        tail = out[-overlap:]
        again = len(tail)


def _begins(bounds: np.ndarray, n: int, again: int) -> np.ndarray:
    """Where the n-grams of each text begin that no part before had."""
    return bounds[0] + max(0, again - (n - 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), object)
        for lo, hi, clean, bounds, again in _texts(batch["text"]):
            own = langs[lo:hi]
            for n, codes in _codes(clean):
                for lang in set(own):
                    mine = np.zeros(len(codes) + 1, np.int8)
                    begin = np.minimum(_begins(bounds, n, again), len(codes))
                    end = np.minimum(np.maximum(bounds[1] - (n - 1), begin), len(codes))
                    np.add.at(mine, begin[own == lang], 1)
                    np.add.at(mine, end[own == lang], -1)
                    total = counts.setdefault(lang, np.zeros(len(GRAMS) * BINS, np.int64))
                    total += np.bincount(codes[np.cumsum(mine[:-1], dtype=np.int8).astype(bool)], minlength=len(total))
    for lang, total in counts.items():
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(have), pa.string()), pa.array(have, pa.int32()), pa.array(total[have])], names=["lang", "bin", "n"])


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bins x bits: log odds of an n-gram for the bit being 1
    weight: np.ndarray  # of each bit's loss

    def sums(self, clean: np.ndarray, bounds: np.ndarray, again: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each text of a part the sum of its n-grams' log odds for each bit, and their
        number. The odds of ``_STEP`` n-grams are held at once, however many bits there are."""
        total, number = np.zeros((bounds.shape[1], self.odds.shape[1])), np.zeros(bounds.shape[1], np.int64)
        for n, codes in _codes(clean):
            begin = np.minimum(_begins(bounds, n, again), len(codes))
            end = np.minimum(np.maximum(bounds[1] - (n - 1), begin), len(codes))
            number += end - begin
            for lo in range(0, len(codes), _STEP):
                hi = min(lo + _STEP, len(codes))
                a, b = np.clip(begin, lo, hi) - lo, np.clip(end, lo, hi) - lo
                have = np.flatnonzero(b > a)
                if not len(have):
                    continue
                values = np.concatenate([self.odds[codes[lo:hi]], np.zeros((1, self.odds.shape[1]), self.odds.dtype)])
                total[have] += np.add.reduceat(values, np.stack([a[have], b[have]], axis=1).ravel(), axis=0)[::2]
        return total, number

    def outputs(self, column: pa.Array) -> np.ndarray:
        """Each text's classifier outputs."""
        total, number = np.zeros((len(column), self.odds.shape[1])), np.zeros(len(column), np.int64)
        for lo, hi, clean, bounds, again in _texts(column):
            part, n = self.sums(clean, bounds, again)
            total[lo:hi] += part
            number[lo:hi] += n
        # Neighbouring n-grams tell the same; the root keeps long texts from absurd certainty.
        return total / np.sqrt(np.maximum(number, 1))[:, None]

    def losses(self, outputs: np.ndarray) -> np.ndarray:
        """texts x languages: the weighted loss of each codeword."""
        z = outputs[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0.0, -z) * self.weight).sum(axis=2)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text, lang); rows without text or label are left out."""
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    part = F.lit(1.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(part)
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < part * (1 << 20))
    counted = map_batches(chosen.select("lang", "text"), _count, _COUNTS).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    counts = np.zeros((len(langs), len(GRAMS) * BINS))
    found = counted.toArrow()
    if found.num_rows:
        lang = np.searchsorted(np.array(langs), np.array(found["lang"].to_pylist()))
        counts[lang, found["bin"].to_numpy()] = found["n"].to_numpy()
    return fit(langs, counts)


def fit(langs: list[str], counts: np.ndarray) -> Model:
    """The model of languages x bins counts."""
    code = codewords(len(langs))
    shares = np.zeros_like(counts)
    for k in range(len(GRAMS)):
        own = slice(k * BINS, (k + 1) * BINS)
        shares[:, own] = (counts[:, own] + 0.01) / (counts[:, own].sum(axis=1, keepdims=True) + 0.01 * BINS)
    odds = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    apart = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = shares[code[:, b] > 0].mean(axis=0), shares[code[:, b] < 0].mean(axis=0)
        odds[:, b] = np.log(one) - np.log(zero)
        apart[b] = ((one - zero) * odds[:, b]).sum()
    return Model(langs, code, odds, apart / apart.sum() if len(apart) and apart.sum() > 0 else apart + 1.0 / max(1, len(apart)))


def _letters(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def _predict(shared, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            n = len(batch)
            lang, score, gap = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if model.langs:
                outputs = model.outputs(batch["text"])
                for lo in range(0, n, _ROWS):
                    loss = model.losses(outputs[lo : lo + _ROWS])
                    order = np.argsort(loss, axis=1, kind="stable")
                    best = np.take_along_axis(loss, order[:, :1], 1)
                    rows = slice(lo, lo + len(loss))
                    lang[rows] = np.array(model.langs, object)[order[:, 0]]
                    score[rows] = 1 / np.exp(len(model.langs) * (best - loss)).sum(axis=1)
                    gap[rows] = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - best[:, 0] if len(model.langs) > 1 else np.inf
            none = np.array([not _letters(t.as_py()) for t in batch["text"]], bool)
            lang[none], score[none], gap[none] = UNKNOWN, 0.0, 0.0
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(gap), pa.array(gap < margin)], names=["doc_id", "lang_pred", "score", "margin", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, ambiguous for each document of ``docs`` (doc_id, text)."""
    shared = session_of(docs).sparkContext.broadcast(model)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _predict(shared, margin), _PREDICTED)


def _accept(shared):
    predict = _predict(shared, MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(shared.value.langs)
        for batch in batches:
            ids, langs = pa.array([0] * len(batch), pa.int64()), batch["lang"].to_pylist()
            found = next(predict(iter([pa.RecordBatch.from_arrays([ids, batch["text"]], names=["doc_id", "text"])])))
            read, sure = found["lang_pred"].to_pylist(), found["margin"].to_numpy() >= CONTRADICTED
            keep = [p != UNKNOWN and (lang not in known or p == lang or not s) for p, lang, s in zip(read, langs, sure, strict=True)]
            told = pa.array([p if lang is None else lang for p, lang in zip(read, langs, strict=True)], batch["lang"].type)
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, batch.schema.field(at), told).filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents (text, lang and more) in a language that the model tells, in their own
    columns. Those that are ``und`` go, and those whose text is plainly in another language than
    their label says; the ambiguous ones stay. A missing label becomes the predicted one."""
    shared = session_of(docs).sparkContext.broadcast(model)
    return map_batches(docs, _accept(shared), docs.schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "margin")
