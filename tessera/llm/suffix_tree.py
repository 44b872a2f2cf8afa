"""A probabilistic suffix tree of word contexts, trained and applied by joins.

States are contexts of up to ``depth`` words. The root is the unigram distribution with
one added to each count. A context s with c(s) occurrences and t(s) different next symbols
smooths its counts by its parent, the context without its oldest word:

    P(a | s) = (c(s, a) + t(s) P(a | parent)) / (c(s) + t(s)).

Candidates are contexts of an empirical probability of at least ``least``. The divergence
test keeps a candidate if its distribution predicts its own occurrences better than its
parent's, each occurrence being judged by all others:

    sum over a of c(s, a) ln(P'(a | s) / P(a | parent)) > 0,

P' being P without the one occurrence. Ancestors of a kept context are kept, so the kept ones
are a tree. A token is scored in the longest state that is a suffix of the words before it in
its document; its logarithm is a sum over the levels of the tree,

    log P(a) + sum over the states on the way of log t/(c + t)  [+ log(1 + c(s, a) / (t P(a | parent)))],

the last term only where a was seen after s. So a score is a sum of parts which are found
one by one, in any order and on any machine.

How it runs. Words are 64-bit digests. Counts of words and of (state, next symbol) are
tables: each level is one pass over the training texts, one aggregation, one join with the
level above it. Contexts number at most 1/least a level, whatever the corpus, and so do the
entries of probability ``hot`` or more: both go to the workers. All other counts, words and
next symbols, grow with the corpus and stay tables; what a text needs of them is one join by key
and one sum by document. The tables' rows are unique by key, so no key makes a partition of
them large; they are the hashed side of the joins, and hot keys are on the other side, which
adaptive execution splits.

Defined results: a null text is an empty one and has the one end token. A null id is hashed as
the empty string (a training document). Repeated rows are counted each in training and
scored each. Without training texts there are no states, N and V are 0 and every token
scores log10(1/1) = 0. Only the id and the text are read; other columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _words
from tessera.llm._shared import Batches, drop_table, known_id, map_batches, materialize, session_of, table

#: Longest context, in words.
DEPTH = 3
#: Least empirical probability of a context: at most 65,536 contexts a level.
LEAST = 2.0**-16
#: Entries that are at least so probable are with the workers: at most 4,194,304 a level, of
#: 16 bytes each. It moves work, not results.
HOT = 2.0**-22

#: The token after a document's last word; no digest of a word in practice.
END = np.uint64(0xE0D)
#: Base of the digests of word strings, and of those of words; both are odd.
_BASE = np.uint64(0xD1B54A32D192ED03)
_BYTES = 0x9E3779B97F4A7C15
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


@dataclass
class Contexts:
    """The contexts of one level, sorted by digest: their digests and oldest words, the
    places of their parents in the level above, and what the worker needs of each."""

    key: np.ndarray
    oldest: np.ndarray
    parent: np.ndarray
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, digest: np.ndarray) -> np.ndarray:
        return _find(self.key, digest)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in the sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _pair(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A digest of (state, next symbol)."""
    return _words.mix(symbol + state.astype(np.uint64) * _BASE)


@dataclass
class Tokens:
    """Tokens of a slice of documents, each document's words and then END."""

    symbol: np.ndarray
    doc: np.ndarray
    place: np.ndarray  # number of words before it in its document

    def context(self, at: np.ndarray, n: int) -> np.ndarray:
        """The digest of the ``n`` words before each of the places ``at``."""
        out, power = np.zeros(len(at), np.uint64), np.uint64(1)
        for k in range(1, n + 1):
            out += self.symbol[at - k] * power
            power *= _BASE
        return out


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of words' digests, and their inverses."""
    steps = np.full(n + 1, _BYTES, np.uint64), np.full(n + 1, pow(_BYTES, -1, 1 << 64), np.uint64)
    for step in steps:
        step[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _digests(words: _words.Words) -> np.ndarray:
    """A digest of each word's bytes in lower case: a difference of running sums over the
    slice, moved to the slice's beginning."""
    size = 1 << max(20, len(words.data).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_LOWER[words.data] * up[: len(words.data)], out=sums[1:])
    return _words.mix((sums[words.end] - sums[words.start]) * down[words.start] + (words.end - words.start).astype(np.uint64))


def _tokens(words: _words.Words) -> Tokens:
    n = np.diff(words.first)
    end = words.first[1:] + np.arange(len(n))
    symbol = np.full(int(n.sum()) + len(n), END, np.uint64)
    inner = np.ones(len(symbol), bool)
    inner[end] = False
    symbol[inner] = _digests(words)
    doc = np.repeat(np.arange(len(n)), n + 1)
    return Tokens(symbol, doc, np.arange(len(symbol)) - (end - n)[doc])


def _slices(column: pa.Array) -> Iterator[tuple[slice, Tokens]]:
    for words in _words.slices(column):
        with np.errstate(over="ignore"):
            yield words.rows, _tokens(words)


def crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _counts(texts: DataFrame, contexts: Contexts | None, level: int) -> DataFrame:
    """s, a, n: how often the symbol ``a`` follows the s-th context of ``level``; at the root
    without s. Each worker sums up its slices, Spark the rest."""
    spark = session_of(texts)
    known = spark.sparkContext.broadcast(contexts) if contexts is not None else None

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens in _slices(batch.column(0)):
                with np.errstate(over="ignore"):
                    if known is None:
                        a, n = np.unique(tokens.symbol, return_counts=True)
                        s = np.zeros(len(a), np.int32)
                    else:
                        at = np.flatnonzero(tokens.place >= level)
                        s = known.value.find(tokens.context(at, level))
                        at, s = at[s >= 0], s[s >= 0]
                        _, first, n = np.unique(_pair(s, tokens.symbol[at]), return_index=True, return_counts=True)
                        s, a = s[first].astype(np.int32), tokens.symbol[at[first]]
                yield pa.RecordBatch.from_arrays([pa.array(s), _signed(a), pa.array(n)], ["s", "a", "n"])

    rows = map_batches(texts.select("text"), run, "s int, a long, n long")
    return rows.groupBy(*(["s", "a"] if contexts is not None else ["a"])).agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """words (a, n) with their total and number; levels: (s, a, n, par) of the candidates,
    par being P(a | parent); contexts: the kept ones of each level with log10 t/(c + t), which
    place of the candidates each has, and their t."""

    words: DataFrame
    total: int
    distinct: int
    levels: list[DataFrame]
    contexts: list[Contexts]
    kept: list[np.ndarray]
    fresh: list[np.ndarray]
    hot: float

    @property
    def root_weight(self) -> int:
        return self.total + self.distinct + 1


def _bounded(df: DataFrame) -> dict[str, np.ndarray]:
    """A table with a proven bound, as arrays."""
    t = df.toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _states(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """One row for each context of a level: bounded, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(pa.table({"s": pa.array(np.arange(len(next(iter(columns.values()))), dtype=np.int32))} | columns)))


def train(texts: DataFrame, depth: int = DEPTH, least: float = LEAST, hot: float = HOT) -> SuffixTree:
    """The tree of ``texts`` (column text)."""
    spark = session_of(texts)
    words = materialize(_counts(texts, None, 0), "suffix-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weight, enough = total + distinct + 1, max(2.0, least * total)

    often = _bounded(words.where((F.col("n") >= enough) & (F.col("a") != int(END))))
    a = np.sort(often["a"].view(np.uint64))
    contexts, levels, tested = Contexts(a, a, np.zeros(len(a), np.int64)), [], []
    above = words.select(F.lit(0).alias("s"), "a", ((F.col("n") + 1) / weight).alias("p"))
    for level in range(1, depth + 1):
        if not len(contexts.key):
            break
        counts = materialize(_counts(texts, contexts, level), f"suffix-counts-{level}")
        found = _bounded(counts.groupBy("s").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("t")))
        c, t = np.zeros(len(contexts.key), np.int64), np.zeros(len(contexts.key), np.int64)
        c[found["s"]], t[found["s"]] = found["c"], found["t"]
        states = _states(spark, parent=contexts.parent.astype(np.int32), c=c, t=t)
        pairs = counts.join(states, "s").join(above.select(F.col("s").alias("parent"), "a", F.col("p").alias("par")).hint("shuffle_hash"), ["a", "parent"])
        pairs = materialize(pairs.select("s", "a", "n", "par"), f"suffix-level-{level}")
        once = (F.col("n") == 1).cast("long")
        others = (F.col("n") - 1 + (F.col("t") - once) * F.col("par")) / (F.col("c") - 1 + F.col("t") - once)
        gain = _bounded(pairs.join(states, "s").groupBy("s").agg(F.sum(F.col("n") * F.log(others / F.col("par"))).alias("gain")))
        levels.append(pairs)
        tested.append((contexts, c, t, set(gain["s"][gain["gain"] > 0].tolist())))
        above = pairs.join(states, "s").select("s", "a", ((F.col("n") + F.col("t") * F.col("par")) / (F.col("c") + F.col("t"))).alias("p"))
        if level < depth:
            contexts = _longer(contexts, _bounded(counts.where((F.col("n") >= enough) & (F.col("a") != int(END)))), level)
        drop_table(counts)
    return _grown(words, total, distinct, levels, tested, hot)


def _longer(contexts: Contexts, pairs: dict[str, np.ndarray], level: int) -> Contexts:
    """The frequent strings of ``level`` + 1 words: a context and the word after it. A parent
    lacks the oldest word."""
    with np.errstate(over="ignore"):
        s, a = pairs["s"], pairs["a"].view(np.uint64)
        key, oldest = contexts.key[s] * _BASE + a, contexts.oldest[s]
        order = np.argsort(key)
        key, oldest = key[order], oldest[order]
        power = np.uint64(pow(int(_BASE), level, 1 << 64))
        return Contexts(key, oldest, contexts.find(key - oldest * power))


def _grown(words: DataFrame, total: int, distinct: int, levels: list[DataFrame], tested: list, hot: float) -> SuffixTree:
    """The tree of all contexts that the test kept, and their ancestors."""
    kept: list[np.ndarray] = []
    needed: set[int] = set()
    for contexts, _, _, passed in reversed(tested):
        stay = np.array(sorted(passed | needed), np.int64)
        needed = set(contexts.parent[stay].tolist())
        kept.insert(0, stay)
    states, fresh = [], []
    for (contexts, c, t, _), stay in zip(tested, kept, strict=True):
        states.append(Contexts(contexts.key[stay], contexts.oldest[stay], contexts.parent[stay], np.log10(t[stay] / (c[stay] + t[stay]))))
        fresh.append(t[stay])
    return SuffixTree(words, total, distinct, levels, states, kept, fresh, hot)


def _gains(tree: SuffixTree) -> tuple[DataFrame, DataFrame]:
    """level, s, a, n, gain of every word and of every next symbol of a kept state (s: its
    place among the kept ones): what is added to a logarithm where it is found. First those
    that are at least so probable that the workers have them, then the others."""
    spark = session_of(tree.words)
    rows = tree.words.select(F.lit(0).alias("level"), F.lit(0).alias("s"), "a", "n", F.log10(F.col("n") + 1).alias("gain"))
    for k, (pairs, kept, t) in enumerate(zip(tree.levels, tree.kept, tree.fresh, strict=True), 1):
        if len(kept):
            states = _states(spark, old=kept.astype(np.int32), t=t).withColumnRenamed("s", "new")
            found = pairs.join(F.broadcast(states), F.col("s") == F.col("old"))
            rows = rows.unionByName(found.select(F.lit(k).alias("level"), F.col("new").alias("s"), "a", "n", F.log10(1 + F.col("n") / (F.col("t") * F.col("par"))).alias("gain")))
    often = F.col("n") >= tree.hot * tree.total
    return rows.where(often), rows.where(~often)


def _parts(docs: DataFrame, tree: SuffixTree, hot: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id, digest, level, s, a, v: for each document four sums of what the worker has (level
    -1: tokens, -2: known ones, -3: base, -4: what the tree adds), then, with level 0 or more, a row for
    each token that needs the gain of (level, s, a)."""
    shared = session_of(docs).sparkContext.broadcast((tree.contexts, hot, math.log10(tree.root_weight)))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        contexts, frequent, weight = shared.value

        def look_up(level: int, state: np.ndarray, at: np.ndarray, tokens: Tokens, asked: list) -> tuple[np.ndarray, np.ndarray]:
            """Gains of what the worker has, and which those are; the rest is asked for."""
            keys, gains = frequent[level]
            symbol = tokens.symbol[at]
            found = _find(keys, _pair(state, symbol) if level else symbol)
            rest = np.flatnonzero(found < 0)
            asked.append((tokens.doc[at[rest]], np.full(len(rest), level), state[rest], symbol[rest], np.ones(len(rest))))
            return np.where(found >= 0, gains[found] if len(gains) else 0.0, 0.0), found >= 0

        for batch in batches:
            ids, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, tokens in _slices(batch.column(2)):
                asked: list[tuple[np.ndarray, ...]] = []
                docs_here = rows.stop - rows.start
                with np.errstate(over="ignore"):
                    everywhere = np.arange(len(tokens.symbol))
                    gain, known = look_up(0, np.zeros(len(everywhere), np.int64), everywhere, tokens, asked)
                    base = gain - weight
                    tree, at = np.zeros(len(base)), everywhere
                    for level, states in enumerate(contexts, 1):
                        at = at[tokens.place[at] >= level]
                        s = states.find(tokens.context(at, level))
                        at, s = at[s >= 0], s[s >= 0]  # a longer state has its suffixes for states
                        tree[at] += states.value[s] + look_up(level, s, at, tokens, asked)[0]
                sums = [np.bincount(tokens.doc, w, docs_here) for w in (np.ones(len(everywhere)), known, base, tree)]
                every = np.arange(docs_here)
                local = [(every, np.full(docs_here, -1 - k), np.zeros(docs_here, np.int64), digests[rows].view(np.uint64), v) for k, v in enumerate(sums)]
                doc, level, s, a, v = (np.concatenate(c) for c in zip(*local, *asked, strict=True))
                order = np.argsort(doc, kind="stable")  # what is alike stands together and packs well
                doc, level, s, a, v = doc[order], level[order], s[order], a[order], v[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows][doc]), pa.array(digests[rows][doc]), pa.array(level.astype(np.int32)), pa.array(s.astype(np.int32)), _signed(a.astype(np.uint64)), pa.array(v)],
                    ["doc_id", "digest", "level", "s", "a", "v"],
                )

    return map_batches(docs, run, "doc_id long, digest long, level int, s int, a long, v double")


def score(docs: DataFrame, tree: SuffixTree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (root only) and score of every row of ``docs``."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.select(known_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    near, far = _gains(tree)
    found = _bounded(near.select("level", "s", "a", "gain"))
    hot = []
    with np.errstate(over="ignore"):
        for level in range(len(tree.contexts) + 1):
            of = found["level"] == level
            a = found["a"][of].view(np.uint64)
            keys = _pair(found["s"][of], a) if level else a
            order = np.argsort(keys)
            hot.append((keys[order], found["gain"][of][order]))
    key = F.when(F.col("level") > 0, F.xxhash64("level", "s", "a")).otherwise(F.col("a")).alias("key")
    parts = _parts(texts, tree, hot).select("doc_id", "digest", "level", key, "v")
    joined = parts.join(far.select("level", key, "gain").hint("shuffle_hash"), ["key", "level"], "left").withColumn("gain", F.col("v") * F.col("gain"))
    of = lambda level: F.sum(F.when(F.col("level") == level, F.col("v")).otherwise(0.0))
    more = lambda when: F.sum(F.when(when & F.col("gain").isNotNull(), F.col("gain")).otherwise(0.0))
    each = joined.groupBy("doc_id", "digest").agg(
        F.sum((F.col("level") == -1).cast("long")).alias("rows"),
        of(-1).alias("n_tokens"),
        (of(-2) + F.sum(F.when((F.col("level") == 0) & F.col("gain").isNotNull(), F.col("v")).otherwise(0.0))).alias("n_known"),
        (of(-3) + more(F.col("level") == 0)).alias("base_score"),
        (of(-4) + more(F.col("level") > 0)).alias("tree"),
    )
    # Equal rows came together in the sums; each has its part.
    whole = lambda c: F.round(F.col(c) / F.col("rows")).cast("long").alias(c)
    part = lambda c: (F.col(c) / F.col("rows")).alias(c)
    each = each.select("doc_id", "digest", whole("n_tokens"), whole("n_known"), part("base_score"), ((F.col("base_score") + F.col("tree")) / F.col("rows")).alias("score"))
    out = texts.select("doc_id", "digest").join(each, ["doc_id", "digest"])
    return out.select(F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "n_tokens", "n_known", "base_score", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a tree of those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = crc(F.col("doc_id")) % 7 == 2
    tree = train(docs.where(~held))
    scored = score(docs, tree)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def _level_sql(k: int) -> str:
    """Counts, states, divergence test and distributions of contexts of ``k`` words."""
    x = [f"x{j}" for j in range(1, k + 1)]
    s, up = ", ".join(x), ", ".join(x[:-1])
    frequent = " AND ".join(f"{c} IS NOT NULL" for c in x)
    above = f"JOIN (SELECT {up}, a, p FROM q{k - 1}) u USING ({up}, a)" if k > 1 else "JOIN (SELECT a, (n + 1) / w::DOUBLE AS p FROM uni, tot) u USING (a)"
    return f"""
p{k} AS MATERIALIZED (SELECT {s}, a, count(*) AS n FROM pos WHERE NOT held AND {frequent} GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT {s}, sum(n) AS c, count(*) AS t FROM p{k} GROUP BY ALL HAVING sum(n) >= (SELECT enough FROM tot)),
q{k} AS MATERIALIZED (SELECT {s}, a, n, c, t, u.p AS par, (n + t * u.p) / (c + t) AS p FROM p{k} JOIN s{k} USING ({s}) {above}),
g{k} AS (SELECT {s} FROM (SELECT {s}, sum(n * ln((n - 1 + (t - (n = 1)::INT) * par) / (c - 1 + t - (n = 1)::INT) / par)) AS gain FROM q{k} GROUP BY ALL) WHERE gain > 0)"""


#: crc32 bit by bit: for each character its code and eight shifts.
_CRC_SQL = """xor(list_reduce(
    flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: [ascii(ch)::BIGINT] || list_resize([-1::BIGINT], 8, -1))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH held AS (SELECT row_number() OVER () AS rid, doc_id, text, {_CRC_SQL} % 7 = 2 AS held FROM documents),
doc AS (
  SELECT rid, doc_id, held, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS t FROM held),
tok AS (SELECT rid, held, unnest(t) AS a, generate_subscripts(t, 1) AS place FROM doc),
pos AS MATERIALIZED (SELECT rid, held, a, {", ".join(f"lag(a, {j}) OVER here AS x{j}" for j in range(1, DEPTH + 1))} FROM tok WINDOW here AS (PARTITION BY rid ORDER BY place)),
uni AS MATERIALIZED (SELECT a, count(*) AS n FROM pos WHERE NOT held GROUP BY a),
tot AS MATERIALIZED (SELECT coalesce(sum(n), 0) AS total, coalesce(sum(n), 0) + count(*) + 1 AS w, greatest(2, {LEAST!r} * coalesce(sum(n), 0)) AS enough FROM uni),
{",".join(_level_sql(k) for k in range(1, DEPTH + 1))},
k3 AS MATERIALIZED (SELECT x1, x2, x3, c, t FROM s3 WHERE (x1, x2, x3) IN (SELECT (x1, x2, x3) FROM g3)),
k2 AS MATERIALIZED (SELECT x1, x2, c, t FROM s2 WHERE (x1, x2) IN (SELECT (x1, x2) FROM g2 UNION SELECT (x1, x2) FROM k3)),
k1 AS MATERIALIZED (SELECT x1, c, t FROM s1 WHERE x1 IN (SELECT x1 FROM g1 UNION SELECT x1 FROM k2)),
scored AS (
  SELECT rid, coalesce(uni.n, 0) > 0 AS known, log10((coalesce(uni.n, 0) + 1) / w::DOUBLE) AS base,
         coalesce(log10(k1.t / (k1.c + k1.t)::DOUBLE) + CASE WHEN q1.n IS NULL THEN 0 ELSE log10(1 + q1.n / (k1.t * q1.par)) END, 0)
         + coalesce(log10(k2.t / (k2.c + k2.t)::DOUBLE) + CASE WHEN q2.n IS NULL THEN 0 ELSE log10(1 + q2.n / (k2.t * q2.par)) END, 0)
         + coalesce(log10(k3.t / (k3.c + k3.t)::DOUBLE) + CASE WHEN q3.n IS NULL THEN 0 ELSE log10(1 + q3.n / (k3.t * q3.par)) END, 0) AS more
  FROM pos CROSS JOIN tot LEFT JOIN uni USING (a)
  LEFT JOIN k1 ON k1.x1 = pos.x1 LEFT JOIN q1 ON q1.x1 = k1.x1 AND q1.a = pos.a
  LEFT JOIN k2 ON k2.x1 = pos.x1 AND k2.x2 = pos.x2 LEFT JOIN q2 ON q2.x1 = k2.x1 AND q2.x2 = k2.x2 AND q2.a = pos.a
  LEFT JOIN k3 ON k3.x1 = pos.x1 AND k3.x2 = pos.x2 AND k3.x3 = pos.x3 LEFT JOIN q3 ON q3.x1 = k3.x1 AND q3.x2 = k3.x2 AND q3.x3 = k3.x3 AND q3.a = pos.a)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, (SELECT total FROM tot)::BIGINT AS train_tokens,
       round(sum(base), 6) AS base_score, round(sum(base + more), 6) AS score
FROM doc JOIN scored USING (rid) GROUP BY rid, doc_id, held"""
