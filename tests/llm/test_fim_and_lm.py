"""Fill-in-the-middle texts and suffix-tree scores against plain Python over whole tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, suffix_tree

LONG = "".join(f"line {k} of a long text\n" for k in range(20_000))
TEXTS = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb", "a\n\nb\n", "has <P> inside\nx", "<S>", "<<P", "almost <\nP>\n<", "été\n日本\n𝄞\n", "\r\nx\r\n", LONG]


def plain_fim(doc_id, text, rate=100, spm=50):
    """The same with a list of all units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(spark):
    rows = [(k * 37 + j, t) for k, t in enumerate(TEXTS) for j in range(6)]
    return rows + [(None, "no id\nat all"), (5, "twice\nthe\nsame"), (5, "twice\nthe\nsame"), (-3, "below\nzero\n")]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 100), (100, 100)])
def test_fim_equals_lists_of_units(spark, rate, spm):
    rows = fim_rows(spark)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    made = fill_middle.fill_in_middle(df, fill_middle.Format(rate=rate, spm_rate=spm)).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made)
    assert got == Counter(plain_fim(i, t, rate, spm) for i, t in rows)
    assert Counter((r.doc_id, r.again) for r in made) == Counter((i, t or "") for i, t in rows)


def test_fim_other_units_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab cd  ef"), (2, "x")], "doc_id long, text string")
    form = fill_middle.Format(unit=r"\S+\s*|\s+", prefix="<|a|>", suffix="<|b|>", middle="<|c|>")
    made = fill_middle.fill_in_middle(docs, form).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"), form)).collect()
    assert {(r.doc_id, r.n, r.again) for r in made} == {(1, 3, "ab cd  ef"), (2, 1, "x")}
    empty = fill_middle.fill_in_middle(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_fim_advances_to_a_rank_without_reading_on():
    unit = re.compile(fill_middle.UNIT)
    assert [fill_middle.cut_places(unit, "a\nbb\nccc", *r) for r in ((0, 0), (0, 3), (1, 1), (1, 2), (3, 3))] == [(0, 0), (0, 8), (2, 2), (2, 5), (8, 8)]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


class PlainTree:
    """Contexts as tuples, oldest word first."""

    def __init__(self, texts, depth=3, least=suffix_tree.LEAST):
        docs = [words_of(t) for t in texts]
        self.counts = [defaultdict(Counter) for _ in range(depth + 1)]
        for d in docs:
            for i, a in enumerate(d):
                for k in range(min(i, depth) + 1):
                    self.counts[k][tuple(d[i - k : i])][a] += 1
        self.total = sum(self.counts[0][()].values())
        self.distinct = len(self.counts[0][()])
        enough = max(2, least * self.total)
        kept = set()
        for k in range(1, depth + 1):
            for s, follow in self.counts[k].items():
                c, t = sum(follow.values()), len(follow)
                if c < enough:
                    continue
                gain = 0.0
                for a, n in follow.items():
                    par = self.prob(s[1:], a)
                    gain += n * math.log((n - 1 + (t - (n == 1)) * par) / (c - 1 + t - (n == 1)) / par)
                if gain > 0:
                    kept |= {s[j:] for j in range(k)}
        self.kept = kept

    def prob(self, s, a):
        if not s:
            return (self.counts[0][()][a] + 1) / (self.total + self.distinct + 1)
        follow = self.counts[len(s)][s]
        return (follow[a] + len(follow) * self.prob(s[1:], a)) / (sum(follow.values()) + len(follow))

    def state(self, before):
        s = ()
        for k in range(1, len(self.counts)):
            longer = tuple(before[len(before) - k :]) if len(before) >= k else None
            if longer not in self.kept:
                break
            s = longer
        return s

    def score(self, text):
        d, known = words_of(text), self.counts[0][()]
        base = sum(math.log10(self.prob((), a)) for a in d)
        return len(d), sum(known[a] > 0 for a in d), base, sum(math.log10(self.prob(self.state(d[:i]), a)) for i, a in enumerate(d))


CORPUS = ["The cat sat on the mat and the cat ran", "the cat sat on the mat", "A dog sat on the log and a dog ran", "a dog sat on the log", None, "", "the THE the", "été 日本 été 日本 été", "x " * 50, "the cat sat on the mat and the cat ran"]
ASKED = [(1, "the cat sat on the log"), (2, "unseen words only here"), (3, None), (4, ""), (5, "The Cat"), (None, "a dog ran"), (7, "a dog sat"), (7, "a dog sat"), (7, "the cat"), (8, " ".join(CORPUS[k % 4] for k in range(400)))]


def scored(spark, hot, least=suffix_tree.LEAST, depth=3):
    tree = suffix_tree.train(spark.createDataFrame([(t,) for t in CORPUS], "text string"), depth=depth, hot=hot, least=least)
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in ASKED], "doc_id long, text string, n int, digest string")
    return tree, suffix_tree.score(docs, tree).collect()


# Everything with the workers; nothing with them, so that all is joined; and half of it.
@pytest.mark.parametrize("hot,least,depth", [(0.0, 2**-16, 3), (2.0, 2**-16, 3), (0.03, 2**-16, 3), (0.03, 0.05, 3), (2.0, 2**-16, 1)])
def test_scores_equal_plain_python(spark, hot, least, depth):
    tree, got = scored(spark, hot, least, depth)
    plain = PlainTree(CORPUS, depth, least)
    assert (tree.total, tree.distinct, sum(len(c.key) for c in tree.contexts)) == (plain.total, plain.distinct, len(plain.kept))
    want = sorted(((i, *plain.score(t)) for i, t in ASKED), key=repr)
    for g, w in zip(sorted((tuple(r) for r in got), key=repr), want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4])


def test_every_state_is_a_distribution():
    plain = PlainTree(CORPUS)
    unseen = "\x00never"
    for s in [(), *plain.kept]:
        assert sum(plain.prob(s, a) for a in plain.counts[0][()]) + plain.prob(s, unseen) == pytest.approx(1)


def test_without_training_texts_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    tree = suffix_tree.train(none)
    assert (tree.total, tree.distinct, tree.contexts) == (0, 0, [])
    got = suffix_tree.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tree).collect()
    assert [tuple(r) for r in got] == [(1, 3, 0, 0.0, 0.0)]
    assert suffix_tree.score(none, suffix_tree.train(spark.createDataFrame([("a b a b a b",)], "text string"))).collect() == []


def test_held_out_rule_and_gain(spark, tmp_path):
    """Held-out documents get more probability from the tree than from the words alone."""
    spark.createDataFrame([(k, " ".join(("red fox jumps high", "blue owl flies low")[(k + j) % 2] for j in range(5))) for k in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_tree.op12(spark, str(tmp_path)).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(r.score > 0.3 * r.base_score and r.n_tokens == r.n_known == 21 for r in held)
