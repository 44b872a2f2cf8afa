"""Substring dedup by relative Lempel-Ziv parsing of documents against reference blocks.

The corpus, without its repeats, is the reference: the partitions of a distributed index
are the reference blocks, and a block holds, for each window of ``window`` words whose
digest falls to it, the one earliest place where that word sequence starts (for a repeat
inside one Arrow batch: where the batch has it first). A document is factored greedily
against all blocks: a factor begins where a window has an earlier place and takes the
longest run of words that the reference has from there, which goes on while the next
window's one place is the next word of the same text. (A later text that has a longer run in
one piece is itself a repeat in its beginning, and only its new windows are reference, so
a run may take two factors where an undivided text would give one.) Where the
reference changes or ends, the windows over that factor boundary are looked up one by one,
as every window is. So a factor is at least ``window`` words long, and every word sequence
of that length that starts earlier lies inside some factor. Words under factors are
duplicates.

Looking up every window would shuffle the corpus many times over. Each window is first
represented by its anchor, the least digest of its ``ANCHOR`` word pieces: equal windows
have equal anchors, and only about one word in eight is an anchor. Windows whose anchor
stands nowhere else cannot be repeated and are never looked up.

A document whose whole text an earlier one has is one factor of it, without any lookup.

Skew: each Arrow batch asks for an anchor or a window at most once; its further places in
the batch are known repeats and go straight to their document's partition. So a passage
that half of all documents share sends a block one row for each batch, not for each place.
Everything is bounded by a batch or by one document.

Defined results: a null text has no words; texts of fewer words than a window keep all;
a null id is earlier than every other id; of rows with one id none is earlier than the
other by its id, only by the place in the text, so repeated rows keep or lose the same
words; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import map_batches, partitions, session_of, table
from tessera.llm._words import mix, sliding, slices, whole, windows

WINDOW = 20
#: Words of the pieces among which a window has its anchor.
ANCHOR = 7
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FIRST_ID = -(1 << 63)

# Few and narrow columns, those that differ from row to row side by side: what these rows
# cost in a shuffle is most of the operator's disk. A known place is stored as -1 - place;
# ``mark`` holds a window's check digest (high half) and its start.
_ANCHORS = "route long, place int, key long"
_WINDOWS = "route long, mark long, id long, key long, known boolean, ref_id long, ref_start int"
_FACTORS = "doc_id long, n_words long, n_removed long, n_spans long, kept string, factors array<struct<start:int,length:int,ref_id:long,ref_start:int>>"


def _pieces(words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the anchor pieces (the greatest value where a piece crosses
    documents) and each window's least one, for windows of one document."""
    h = words.digests()
    pieces = mix(windows(h, anchor), 1)
    pieces[~whole(words, anchor)] = _TOP
    span = window - anchor + 1
    least = sliding(pieces, span)[: max(0, len(h) - window + 1)] if len(pieces) >= span else np.zeros(0, np.uint64)
    return pieces, least


def _text_order(order: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns that were sorted by ``order``, as they stood in the texts: there all but the
    digests compress to almost nothing."""
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [c[back] for c in columns]


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            found = []
            for words in slices(batch["text"]):
                pieces, least = _pieces(words, window, anchor)
                if not len(least):
                    continue
                span = window - anchor + 1
                least = np.where(whole(words, window), least, np.uint64(0))
                # A piece is an anchor if one of the windows over it has it as its least.
                padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
                at = np.flatnonzero((sliding(padded, span, least=False) == pieces) & (pieces != _TOP))
                doc = words.doc[at]
                found.append((pieces[at], keys[words.rows][doc], (at - words.first[doc]).astype(np.int32)))
            if not found:
                continue
            digest, key, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(digest, kind="stable")
            digest, key, place = digest[order], key[order], place[order]
            first = np.ones(len(digest), bool)
            first[1:] = digest[1:] != digest[:-1]
            known = ~first
            known[:-1] |= ~first[1:]
            columns = _text_order(order, [np.where(first, digest.view(np.int64), key), np.where(known, -1 - place, place), key])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["route", "place", "key"])

    return run


def _windows(window: int, anchor: int):
    span = window - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch["key"].to_numpy(), batch["id"].to_numpy()
            places = batch["places"]
            offsets, flat = places.offsets.to_numpy(), places.values.to_numpy()
            found = []
            for words in slices(batch["text"]):
                pieces, least = _pieces(words, window, anchor)
                if not len(least):
                    continue
                lo, hi = offsets[words.rows.start], offsets[words.rows.stop]
                per = np.diff(offsets[words.rows.start : words.rows.stop + 1])
                at = flat[lo:hi] + np.repeat(words.first[:-1], per)
                repeated = np.full(len(pieces), _TOP)
                repeated[at] = pieces[at]
                start = np.flatnonzero((sliding(repeated, span)[: len(least)] == least) & whole(words, window) & (least != _TOP))
                doc = words.doc[start]
                one, two = mix(windows(words.digests(2), window), 3), mix(windows(words.digests(4), window), 5)
                found.append((one[start], two[start], ids[words.rows][doc], keys[words.rows][doc], (start - words.first[doc]).astype(np.int32)))
            if not found:
                continue
            one, two, doc_id, key, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, doc_id, two, one))
            one, two, doc_id, key, start = (x[order] for x in (one, two, doc_id, key, start))
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            # A later place of the batch is a repeat of the batch's first; one that is not later (rows with one id) asks itself.
            later = (doc_id != doc_id[head]) | (start != start[head])
            route = np.where(later, key, one.view(np.int64))
            mark = np.where(later, np.uint64(0), two & np.uint64(0xFFFFFFFF00000000)).view(np.int64) | start.astype(np.int64)
            rows = [route, mark, doc_id, key, later, np.where(later, doc_id[head], np.int64(0)), np.where(later, start[head], np.int32(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _text_order(order, rows)], names=["route", "mark", "id", "key", "known", "ref_id", "ref_start"])

    return run


def greedy_factors(start: np.ndarray, ref_id: np.ndarray, ref_start: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, ref_id, ref_start) of the greedy parse: repeated windows in order,
    a factor going on while reference and document both step by one word."""
    if not len(start):
        return []
    go = (start[1:] == start[:-1] + 1) & (ref_id[1:] == ref_id[:-1]) & (ref_start[1:] == ref_start[:-1] + 1)
    begin = np.concatenate([[0], np.flatnonzero(~go) + 1])
    last = np.concatenate([begin[1:], [len(start)]]) - 1
    return list(zip(start[begin].tolist(), (start[last] - start[begin] + window).tolist(), ref_id[begin].tolist(), ref_start[begin].tolist(), strict=True))


def _factored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, repeats, copy_of in zip(batch["doc_id"].to_pylist(), batch["text"], batch["repeats"], batch["copy_of"].to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                factors, removed, spans, kept = [], 0, 0, words
                if copy_of is not None:
                    if len(words) >= window:
                        factors, removed, spans, kept = [(0, len(words), copy_of, 0)], len(words), 1, []
                elif repeats.is_valid and len(repeats.values):
                    s = repeats.values
                    order = np.unique(s.field("start").to_numpy(), return_index=True)[1]  # equal rows tell the same
                    factors = greedy_factors(*(s.field(x).to_numpy()[order] for x in ("start", "ref_id", "ref_start")), window)
                    cover = np.zeros(len(words) + 1, np.int64)
                    for begin, length, _, _ in factors:
                        cover[begin] += 1
                        cover[begin + length] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[1], keep.astype(np.int8)])) == -1))
                    removed, kept = int(len(words) - keep.sum()), compress(words, keep.tolist())
                out.append((doc_id, len(words), removed, spans, b" ".join(kept).decode(), factors))
            ids, n, gone, spans, kept, factors = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))
            rows = [[dict(zip(("start", "length", "ref_id", "ref_start"), f, strict=True)) for f in fs] for fs in factors]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()), pa.array(rows, kind)], names=["doc_id", "n_words", "n_removed", "n_spans", "kept", "factors"])

    return run


def _copies(docs: DataFrame) -> DataFrame:
    """key, copy_of (the least id) of documents whose whole text an earlier id has too.
    Only digests are shuffled; the least id is formed on the map side, so a text that a
    third of all documents have sends one row for each task, and the documents find it
    by a join that Spark can split."""
    digests = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return digests.join(least, "digest").where("id > copy_of").select("key", "copy_of").distinct()


def parse_corpus(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text): doc_id, n_words, n_removed,
    n_spans (maximal removed runs of words), kept (the words outside factors, joined by one
    space) and its factors.

    The texts are dealt out by document once; both joins read that one exchange.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has 1 to window words")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = _copies(docs)
    # Copies are not looked up, and what only they share does not make their first one look.
    alone = texts.join(copies.select("key"), "key", "left_anti")
    asked = map_batches(alone.select("key", "doc_id", "text"), _anchors(window, anchor), _ANCHORS)  # doc_id: the exchange stays the others' one
    shared = asked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("route"))).where("place < 0 OR n > 1")
    places = shared.groupBy("key").agg(F.collect_set(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))).alias("places"))
    looked = map_batches(texts.join(places, "key").select("key", F.coalesce("doc_id", F.lit(_FIRST_ID)).alias("id"), "text", "places"), _windows(window, anchor), _WINDOWS)
    # Dealt out by the digest alone; the check digest tells apart what shares it.
    dealt = looked.repartition(partitions(session_of(docs)), "route").withColumn("check", F.shiftright("mark", 32)).withColumn("start", F.col("mark").bitwiseAND(0x7FFFFFFF).cast("int"))
    same = Window.partitionBy("route", "check")
    earliest = F.min(F.when(~F.col("known"), F.struct("id", "start"))).over(same)
    repeats = (
        dealt.withColumn("first", earliest)
        .where("known OR first < struct(id, start)")
        .select("key", "start", F.when(F.col("known"), F.struct("ref_id", "ref_start")).otherwise(F.struct(F.col("first.id").alias("ref_id"), F.col("first.start").alias("ref_start"))).alias("ref"))
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "ref.ref_id", "ref.ref_start")).alias("repeats"))
    )
    parts = texts.join(repeats, "key", "left").join(copies, "key", "left").select("doc_id", "text", "repeats", "copy_of")
    return map_batches(parts, _factored(window), _FACTORS)


def op1(spark, sf_dir: str) -> DataFrame:
    parsed = parse_corpus(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
k AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER o AS k, count(*) OVER o AS n
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
e AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM k WHERE n = 20),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM e WHERE place > 1),
f AS (SELECT doc_id, count(*) AS n FROM (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) WHERE before IS NULL OR before < i - 1 GROUP BY doc_id),
g AS (
  SELECT x.doc_id, count(r.i) AS gone, string_agg(word, ' ' ORDER BY x.i) FILTER (r.i IS NULL) AS kept
  FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.i = r.i GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(f.n, 0) AS n_spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id)
"""
