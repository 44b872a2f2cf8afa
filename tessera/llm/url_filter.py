"""URL filters: rules first, then host word segmentation and naive Bayes.

Host labels are names run together. A unigram model of the corpus's own words splits them
by Viterbi: of all splits the one whose words are most probable, an unknown word being
the less probable the longer it is. The words are those of all pages' visible text, and the
tokens that paths of more than one host have between their separators: what many sites set
off by themselves (a language code, a section's name) is a word.

The words of the host and of the path are then scored by a multinomial naive Bayes model
with two classes. It learns from the pages themselves: a page is unwanted if its visible
text fails plain checks (too few words, words too short or too long, hardly any distinct
ones). Only pages that no rule fits are learned from, as only they are judged by the model: a
rule's verdict says nothing about what stands at other hosts. A url is so judged by what was
found at urls with the same words, before its own page is fetched.

The most frequent words of the model are broadcast, ``LEXICON`` of them at most. The others
stay a table: the substrings of the distinct host and path labels are joined with it, each
label is split again with what it holds of them, and where that changes its split, the
split goes along with the urls that have the label, so no word is lost. The naive Bayes
model has hashed bins and is broadcast. Counts are taken over all pages. Pages' texts are
never shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed; a url without words is allowed; hosts with other than letters are cut
there; a null html has no words; repeated pages are judged alike and each counts; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, session_of, table

# The rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words of the unigram model that are broadcast, and the longest word of it: that of a host label.
LEXICON, LONGEST = 50_000, 63
# A text is poor with fewer words, a mean word length outside these, or a lesser share of distinct words.
LEAST_WORDS, WORD_LENGTHS, LEAST_DISTINCT = 50, (3.0, 10.0), 0.05
#: Bins of the naive Bayes model.
BINS = 1 << 16
SMOOTHING = 0.1
_REMEMBERED = 50_000
_LETTERS = re.compile(r"[a-z]+")
_TOKENS = re.compile(r"[a-z]+|[0-9]+")

_COUNTS = "bin int, unwanted boolean, n long"
_OWN = "array<struct<label:string,words:array<string>>>"
_SPLIT = "label string, words array<string>"
_SCORED = "page_id long, host string, path string, rule string, verdict string, unwanted boolean, words string, score double"

_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Segmenter:
    """A unigram model: words and their log probabilities."""

    log_p: dict[str, float]
    total: float
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _word(self, word: str, more: Mapping[str, float] = MappingProxyType({})) -> float:
        found = self.log_p.get(word)
        if found is None:
            found = more.get(word)
        return found if found is not None else -math.log(self.total) - math.log(10) * len(word)

    def label(self, letters: str, more: Mapping[str, float] = MappingProxyType({})) -> tuple[str, ...]:
        """The most probable split; of equal ones the one whose last words are longest.
        ``more``: log probabilities of words beside the model's own."""
        best, cut = [0.0], [0]
        for j in range(1, len(letters) + 1):
            found, at = max((best[i] + self._word(letters[i:j], more), -i) for i in range(max(0, j - LONGEST), j))
            best.append(found), cut.append(-at)
        out, j = [], len(letters)
        while j:
            out.append(letters[cut[j] : j])
            j = cut[j]
        return tuple(reversed(out))

    def host(self, host: str, own: Mapping[str, Sequence[str]] = MappingProxyType({})) -> tuple[str, ...]:
        """The words of all labels; ``own``: splits of labels that have rarer words."""
        if own:
            return tuple(w for letters in _LETTERS.findall(host) for w in own.get(letters) or self.host(letters))
        found = self.memory.get(host)
        if found is None:
            if len(self.memory) >= _REMEMBERED:
                self.memory.clear()
            found = self.memory[host] = tuple(w for letters in _LETTERS.findall(host) for w in self.label(letters))
        return found


def segmenter(counts: dict[str, int], others: int = 0) -> Segmenter:
    """``others``: how often words that are not in ``counts`` stand in the texts."""
    total = float(max(1, sum(counts.values()) + others))
    return Segmenter({w: math.log(n / total) for w, n in counts.items()}, total)


def visible(html: Column) -> Column:
    """A page's text in lower case, tags left out."""
    return F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<[^>]*>", " "))


def is_poor(words: Column, letters: Column) -> Column:
    """Do the words of a page's visible text, with so many letters in all, fail the checks?"""
    n, (least, most) = F.size(words), WORD_LENGTHS
    return (n < LEAST_WORDS) | ~letters.between(least * n, most * n) | (F.size(F.array_distinct(words)) < LEAST_DISTINCT * n)


def parse(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict (of the longest rule, or null) and
    unwanted (the page's label) of ``pages``; the one time that texts are checked."""
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.split(F.trim(visible(F.col("html"))), r"\s+").alias("_split"))
    # Split and counted in steps of their own: each is computed once.
    parsed = parsed.withColumn("_words", F.array_remove("_split", "")).withColumn("_letters", F.length(F.array_join("_words", "")))
    ruled = parsed.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    unwanted = is_poor(F.col("_words"), F.col("_letters"))
    return materialize(ruled.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"), unwanted.alias("unwanted")), "urls")


def all_counts(texts: DataFrame, parsed: DataFrame) -> DataFrame:
    """word, n: how often each word stands in ``texts`` (html), and beside the first how
    many hosts of ``parsed`` (host, path) have it as a token of a path."""
    words = texts.select(F.explode(F.split(visible(F.col("html")), "[^a-z]+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    tokens = parsed.select("host", F.explode(F.split(F.lower("path"), "[^a-z]+")).alias("word")).distinct().groupBy("word").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    both = words.unionAll(tokens).where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(both, "word-counts")


def least_count(counts: DataFrame, size: int) -> int:
    """The lowest count such that the words with at least that count are no more than
    ``size``. How many words have a count tells it, so only those sums reach the driver."""
    chosen = 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"]):
        chosen += r["words"]
        if chosen > size:
            return r["n"] + 1
    return 1


def _collected(counts: DataFrame) -> dict[str, int]:
    return {r["word"]: r["n"] for r in counts.collect()}


def word_model(counts: DataFrame, size: int = LEXICON) -> tuple[Segmenter, DataFrame | None]:
    """The most frequent words as a segmenter that knows the total of all words, and the
    table of the others; None if there are none."""
    common = F.col("n") >= least_count(counts, size)
    others = counts.where(~common)
    n = others.agg(F.sum("n")).first()[0] or 0
    return segmenter(_collected(counts.where(common)), n), others if n else None


def _labels(host: Column, path: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.concat_ws("/", host, F.lower(path)), "[^a-z]+")), "")


def _resplit(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            labels, splits = [], []
            for label, found in zip(batch["label"].to_pylist(), batch["found"].to_pylist(), strict=True):
                split = model.label(label, {x["word"]: math.log(x["n"] / model.total) for x in found})
                if split != model.label(label):
                    labels.append(label), splits.append(split)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(splits, pa.list_(pa.string()))], names=["label", "words"])

    return run


def rare_splits(parsed: DataFrame, others: DataFrame, shared) -> DataFrame:
    """label, words for each distinct label of ``parsed`` (host, path) that the words of
    ``others`` (word, n) split otherwise than the broadcast model alone. The substrings carry
    a label's number, not the label, so they are linear in its length."""
    distinct = parsed.select(F.explode(_labels(F.col("host"), F.col("path"))).alias("label")).distinct()
    labels = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "label"), "url-labels")
    starts = labels.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.substr("label", i, F.lit(LONGEST)))).alias("ahead"))
    parts = starts.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda k: F.left("ahead", k))).alias("word"))
    found = parts.join(others, "word").groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    return materialize(found.join(labels, "id").select("label", "found").mapInArrow(_resplit(shared), _SPLIT), "url-splits")


def with_splits(parsed: DataFrame, splits: DataFrame | None) -> DataFrame:
    """Adds ``own``: the splits of a url's labels, null for most."""
    if splits is None or splits.isEmpty():
        return parsed.withColumn("own", F.lit(None).cast(_OWN))
    keyed = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "urls-numbered")
    own = keyed.select("row", F.explode(_labels(F.col("host"), F.col("path"))).alias("label")).join(splits, "label").groupBy("row").agg(F.collect_list(F.struct("label", "words")).alias("own"))
    return materialize(keyed.join(own, "row", "left").drop("row"), "urls-split")


def tokens(model: Segmenter, host: str, path: str, own: list[dict] | None = None) -> list[str]:
    """Distinct words of host and path, told apart; a number is one kind of word. Distinct:
    a url that repeats one segment a thousand times must not outweigh all others."""
    splits = {x["label"]: x["words"] for x in own or ()}
    out = [f"h:{w}" for w in model.host(host, splits)]
    for t in _TOKENS.findall(path.lower()):
        out += ["p:0"] if t.isdigit() else [f"p:{w}" for w in model.host(t, splits)]
    return list(dict.fromkeys(out))


def _bin(token: str) -> int:
    return zlib.crc32(token.encode()) % BINS


class _Tokens:
    """Words and bins of the urls of a batch; the bin of a word is computed once."""

    def __init__(self, model: Segmenter):
        self.model, self.bins = model, {}

    def of(self, batch: pa.RecordBatch) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The words of each url, all their bins, and the number of words of each url."""
        words = [tokens(self.model, h, p, o) for h, p, o in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), batch["own"].to_pylist(), strict=True)]
        distinct = {w for ws in words for w in ws}
        if len(self.bins) >= _REMEMBERED:
            self.bins.clear()
        self.bins.update((w, _bin(w)) for w in distinct - self.bins.keys())
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return words, np.fromiter((self.bins[w] for ws in words for w in ws), np.int64, int(sizes.sum())), sizes


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, pages = _Tokens(shared.value), np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            _, bins, sizes = own.of(batch)
            side = batch["unwanted"].to_numpy(zero_copy_only=False).astype(np.int64)
            pages += np.bincount(side, minlength=2)
            counts += np.bincount(np.repeat(side, sizes) * BINS + bins, minlength=2 * BINS).reshape(2, BINS)
        for side in (0, 1):
            have = np.flatnonzero(counts[side])
            bins, n = [-1, *have.tolist()], [int(pages[side]), *counts[side, have].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array([bool(side)] * len(bins)), pa.array(n, pa.int64())], names=["bin", "unwanted", "n"])

    return run


@dataclass
class Bayes:
    prior: float  # log odds of a page being unwanted
    odds: np.ndarray  # log odds of each bin

    def score(self, bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The probability of being unwanted of urls with so many words; 0 without words."""
        sums = np.zeros(len(sizes))
        have = np.flatnonzero(sizes)
        if len(have):
            sums[have] = np.add.reduceat(self.odds[bins], (np.cumsum(sizes) - sizes)[have])
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(self.prior + sums, -500.0, 500.0))), 0.0)


def bayes(pages: np.ndarray, counts: np.ndarray) -> Bayes:
    """From the pages and the bin counts of both classes, wanted first; ``SMOOTHING`` is
    added to the bins that either class has."""
    seen = max(1, int(np.count_nonzero(counts.sum(axis=0))))
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * seen)
    return Bayes(math.log((pages[1] + 1.0) / (pages[0] + 1.0)), np.log(share[1]) - np.log(share[0]))


def train_bayes(parsed: DataFrame, shared) -> Bayes:
    """``parsed``: host, path, own, unwanted. At most two rows for each bin reach the driver."""
    counts, pages = np.zeros((2, BINS)), np.zeros(2)
    for r in parsed.select("host", "path", "own", "unwanted").mapInArrow(_count(shared), _COUNTS).groupBy("bin", "unwanted").agg(F.sum("n").alias("n")).collect():
        if r["bin"] < 0:
            pages[int(r["unwanted"])] = r["n"]
        else:
            counts[int(r["unwanted"]), r["bin"]] = r["n"]
    return bayes(pages, counts)


def _score(shared, shared_bayes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nb = _Tokens(shared.value), shared_bayes.value
        for batch in batches:
            words, bins, sizes = own.of(batch)
            columns = [*(batch[c] for c in ("page_id", "host", "path", "rule", "verdict", "unwanted")), pa.array([" ".join(w) for w in words], pa.string()), pa.array(nb.score(bins, sizes), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "unwanted", "words", "score"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, learn_from: Column | None = None) -> DataFrame:
    """One row for each page of ``pages`` (page_id, url, html): host, path, rule, verdict,
    words (the segmented words), score (of being unwanted, 0 to 1), unwanted (the label that
    the page itself has). ``learn_from``: which pages without a rule the model learns from, all if not given."""
    sc = session_of(pages).sparkContext
    parsed = parse(pages, rules)
    model, others = word_model(all_counts(pages, parsed))
    shared = sc.broadcast(model)
    parsed = with_splits(parsed, rare_splits(parsed, others, shared) if others is not None else None)
    free = parsed.where("rule IS NULL")
    nb = sc.broadcast(train_bayes(free if learn_from is None else free.where(learn_from), shared))
    scored = parsed.mapInArrow(_score(shared, nb), _SCORED)
    judged = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "words", "score", "unwanted")


def op3(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
