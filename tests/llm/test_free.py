"""The operators that run Python, against brute force, round trips and held-out accuracy."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import edit_match, iblt, jaccard_join, language_id, substring_dedup, token_shards, url_filter, wavelet
from tessera.llm import _words as W

DOCS = "doc_id long, text string, lang string, source string, key string, tie int, _doc string, id int, block int"


def docs(spark, rows):
    """(doc_id, text) rows; the further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", "k", 7, "d", 3, 4) for i, t in rows], DOCS)


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edge_rows(seed=5):
    """Copies, near copies, shared passages, nulls, blanks, ties, repeated rows, a long text."""
    r = random.Random(seed)
    base, passage = prose(r, 150), prose(r, 60)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "x ", 1)), (4, prose(r, 100) + " " + passage), (5, passage + "\n" + prose(r, 50)), (6, None), (7, ""), (8, " \t "), (9, "two words"), (10, "two\nwords")]
    rows += [(11, passage + " " + passage), (12, prose(r, 8000, 50_000)), (13, base), (13, base), (14, prose(r, 30)), (14, prose(r, 40)), (None, base + " tail"), (15, "z " * 300), (16, "é ü " + base)]
    return rows


# --- words ---------------------------------------------------------------------------


def test_word_arrays():
    r = random.Random(1)
    texts = ["".join(r.choice("ab é\n\t\x0b\x85") for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "  ", "a"]
    for size in (10, 1 << 20):
        got, digests = [], {}
        for w in W.slices(pa.array(texts), size):
            h = w.digests()
            for d in range(len(w.first) - 1):
                span = slice(w.first[d], w.first[d + 1])
                words = [bytes(w.data[s:e]) for s, e in zip(w.start[span], w.end[span])]
                got.append(words)
                for x, y in zip(words, h[span].tolist()):
                    assert digests.setdefault(x, y) == y
        assert got == [(t or "").encode().split() for t in texts] and len(set(digests.values())) == len(digests)
    h = np.arange(1, 100, dtype=np.uint64)
    for n in (1, 2, 7, 20):
        a, m = W.windows(h, n), W.mix(h)
        assert len(a) == 100 - n and W.windows(np.concatenate([h[40 : 40 + n], h]), n)[0] == a[40]
        assert (W.sliding(m, n) == [m[i : i + n].min() for i in range(100 - n)]).all()
        assert (W.sliding(m, n, least=False) == [m[i : i + n].max() for i in range(100 - n)]).all()


# --- substring dedup -------------------------------------------------------------------


def test_substring_dedup_is_exact(spark):
    rows = edge_rows()
    place = {}
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            place[key] = min(place.get(key, (order(i), k)), (order(i), k))
    want = []
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 19):
            if place[tuple(w[k : k + 20])] < (order(i), k):
                gone |= set(range(k, k + 20))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = substring_dedup.parse_corpus(docs(spark, rows)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got)
    texts = {order(i): (t or "").split() for i, t in rows if i not in (13, 14)}
    for r in got:
        for f in r.factors:
            assert f.length >= 20
            if r.doc_id in texts and f.ref_id in texts:
                own, ref = texts[r.doc_id], texts[f.ref_id]
                assert own[f.start : f.start + f.length] == ref[f.ref_start : f.ref_start + f.length]
    assert substring_dedup.parse_corpus(docs(spark, [])).count() == 0
    short = substring_dedup.parse_corpus(docs(spark, [(1, "a b c"), (2, "x a b c")]), window=3, anchor=2).collect()
    assert {r.doc_id: r.kept for r in short} == {1: "a b c", 2: "x"}


def test_greedy_factors_match_a_naive_parse(spark):
    r = random.Random(10)
    words = [f"v{k}" for k in range(30)]
    texts = [" ".join(words[:20]), " ".join(words), " ".join(words), " ".join(words[10:]) + " x " + " ".join(words[:25])]
    for _ in range(25):
        parts = [r.choice(texts).split() for _ in range(r.randint(1, 3))]
        texts.append(" ".join(x for w in parts for x in w[r.randrange(len(w)) :]))
    # One batch for each document, so that each window's place is the earliest of all.
    table = docs(spark, list(enumerate(texts)))
    place, owned = {}, [t.split() for t in texts]
    for i, w in enumerate(owned):
        for k in range(len(w) - 4):
            place.setdefault(tuple(w[k : k + 5]), (i, k))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        got = {x.doc_id: x for x in substring_dedup.parse_corpus(table, window=5, anchor=2).collect()}
    finally:
        spark.conf.set(key, before)
    for i, w in enumerate(owned):
        if len(w) >= 5 and w in owned[:i]:
            assert [tuple(f) for f in got[i].factors] == [(0, len(w), owned.index(w), 0)]
            continue
        want, k = [], 0
        while k <= len(w) - 5:
            at = place[tuple(w[k : k + 5])]
            if at >= (i, k):
                k += 1
                continue
            n = 1
            while k + n <= len(w) - 5 and place[tuple(w[k + n : k + n + 5])] == (at[0], at[1] + n) and (at[0], at[1] + n) < (i, k + n):
                n += 1
            want.append((k, n + 4, *at))
            k += n
        inside = lambda fs: sum(f[1] for f in fs)
        own = [tuple(f) for f in got[i].factors]
        if len(set(map(tuple, (w[k : k + 5] for k in range(len(w) - 4))))) == max(0, len(w) - 4):  # no repeat inside the text's own batch
            assert own == want
        else:
            assert inside(own) >= 5 * bool(want) and {x for f in own for x in range(f[0], f[0] + f[1])} == {x for f in want for x in range(f[0], f[0] + f[1])}


# --- n-gram Jaccard join ---------------------------------------------------------------


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_rows():
    r = random.Random(9)
    rows = edge_rows()
    for g in range(6):
        base = [f"g{g}w{r.randrange(80)}" for _ in range(120)]
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(120)] = f"new{r.random()}"
            rows.append((100 + g * 20 + k, " ".join(w)))
    return rows


def brute_groups(rows, threshold=0.8):
    order = lambda i: -(1 << 63) if i is None else i
    sets, first = {}, {}
    for i, t in rows:
        s = shingles(t)
        sets.setdefault(s, []).append(i)
    reps = {s: min(ids, key=order) for s, ids in sets.items()}
    classes = [s for s in sets if s]
    links, up = dict.fromkeys(sets, 0), {s: s for s in sets}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for a in range(len(classes)):
        for b in range(a):
            x, y = classes[a], classes[b]
            if len(x & y) >= threshold * len(x | y):
                links[x] += 1
                links[y] += 1
                p, q = find(x), find(y)
                if p != q:
                    up[p] = q
    for s in sets:
        first.setdefault(find(s), []).append(reps[s])
    return {s: (reps[s], links[s], min(first[find(s)], key=order)) for s in sets}


def test_jaccard_join_is_exact(spark, monkeypatch):
    rows = near_rows()
    want = brute_groups(rows)
    expected = sorted(repr((i, *want[shingles(t)])) for i, t in rows)
    assert any(n > 3 for _, n, _ in want.values())
    got = jaccard_join.jaccard_join(docs(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links, r.group_id)) for r in got) == expected
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 3)  # buckets and clusters of many blocks
    got = jaccard_join.jaccard_join(docs(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links, r.group_id)) for r in got) == expected
    assert jaccard_join.jaccard_join(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    d = docs(spark, rows)
    kept = jaccard_join.keep_one_of_each_group(d)
    assert kept.columns == d.columns and kept.schema == d.schema
    want = brute_groups(rows)
    heads = {want[shingles(t)][2] for i, t in rows if shingles(t)}
    wordless = {i for i, t in rows if not shingles(t)}
    # ids that two texts share: the one whose group it heads stays, and texts in groups of their own
    assert {r.doc_id for r in kept.collect()} == heads | wordless
    assert jaccard_join.keep_one_of_each_group(docs(spark, [(1, "a b"), (1, "a b"), (2, "a b")])).count() == 1


def test_pruning_bounds():
    steps = jaccard_join.least_agreements()
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160] and all(0 < m < 0.8 * n for n, m in steps)
    # The tail is that of the Beta posterior: for m = n = 0 the uniform prior's.
    assert jaccard_join._tail(0, 0, 0.8) == pytest.approx(0.2)


# --- decontamination ---------------------------------------------------------------------


def least_distance(p, t):
    prev, best = list(range(len(p) + 1)), len(p)
    for c in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i - 1] + (p[i - 1] != c), prev[i] + 1, cur[i - 1] + 1))
        prev, best = cur, min(best, cur[-1])
    return best


def test_myers_is_exact():
    r = random.Random(0)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, 25))) for a in (1, 0))
        assert edit_match.Pattern(0, p, 0.1).search(t)[0] == least_distance(p, t)


def leak_rows():
    r = random.Random(3)
    items = [(k, prose(r, 12)) for k in range(6)] + [(6, "short"), (7, None), (8, ""), (1, prose(r, 15))]
    rows = [(i, prose(r, 40)) for i in range(20)]
    for k, (_, t) in enumerate(items[:6]):
        cut = list(t)
        for _ in range(k * 2):  # 0, 2, 4, ... edits: the last ones are beyond the budget
            cut[r.randrange(len(cut))] = r.choice("qxz")
        rows.append((100 + k, f"{prose(r, 20)} {''.join(cut).upper()}  {prose(r, 20)}"))
    return rows + [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[1][1]), (203, "y " * 30_000 + items[2][1])], items


def test_contamination_matches_brute_force(spark):
    rows, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        for k, p in items:
            n, h = edit_match.normalize(p), edit_match.normalize(t)
            if len(n) >= edit_match.WORD_CHARS and h:
                d = least_distance(n, h[-300:] if len(h) > 9000 else h)
                if d <= int(len(n) * edit_match.ERROR_RATE):
                    want.append((i, k, d))
    for block in (edit_match.BLOCK_CHARS, 100):
        found = edit_match.find_contamination(docs(spark, rows), bench, block_chars=block).collect()
        assert sorted(repr((r.doc_id, r.item_id, r.distance)) for r in found) == sorted(map(repr, want))
        clean = edit_match.decontaminate(docs(spark, rows), bench, block_chars=block)
        assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in rows if i not in {i for i, _, _ in want})
        assert clean.schema == docs(spark, rows).schema
    assert {i for i, _, _ in want} >= {100, 101, 202, None, 203} and 105 not in {i for i, _, _ in want}
    assert edit_match.find_contamination(docs(spark, []), bench).count() == 0
    assert edit_match.find_contamination(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    """A slip within the budget of 8 % is found in short items too ("who wrote at?")."""
    items = [(0, "Who wrote it?"), (1, "cat nap"), (2, "日本の首都はどこですか。"), (3, "猫は"), (4, " "), (5, None), (6, "cat nap"), (7, "क")]
    rows = [(0, "x who  wrote IT?yes"), (1, "a concat nap, cat naps"), (2, "a Cat Nap."), (3, "問題：日本の首都はどこですか。答え"), (4, "黒猫は白い"), (5, "who wrote at?"), (6, "cat nap"), (7, "cat naps, cat nap"), (8, "कि"), (9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0), (2, 1), (2, 6), (3, 2), (4, 3), (5, 0), (6, 1), (6, 6), (7, 1), (7, 6)}
    found = edit_match.find_contamination(docs(spark, rows), bench).collect()
    assert len(found) == len(want) and all(r.distance == (r.doc_id == 5) and r.budget == (r.item_id == 0) for r in found)
    texts = dict(rows)
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(edit_match.normalize(texts[r.doc_id])[: r.match_end].endswith(edit_match.normalize(dict(items)[r.item_id])) for r in found if not r.distance)
    assert sorted(r.doc_id for r in edit_match.decontaminate(docs(spark, rows), bench).collect()) == [1, 8, 9]


def test_edited_items_of_all_lengths_match_brute_force(spark):
    """Items of 5 to 2,000 characters with edits around their budgets, against all substrings."""
    r = random.Random(11)

    def edited(t: str, n: int) -> str:
        c = list(t)
        for _ in range(n):
            at = r.randrange(len(c))
            c[at : at + 1] = r.choice(([], [r.choice("qx ")], [c[at], r.choice("qx")]))
        return "".join(c)

    def cut(t: str, n: int) -> str:
        return edit_match.normalize(t[: n + 1])[:n].strip()

    items = [(k, cut(prose(r, 2 + n // 3), n)) for k, n in enumerate([5, 8, 12, 13, 14, 18, 24, 25, 26, 27, 29, 30, 31, 50, 90, 400, 2000])]
    rows = []
    for k, t in items:
        budget = int(len(t) * edit_match.ERROR_RATE)
        for n in {0, 1, 2, budget, budget + 1}:
            around = r.choice(("{} {} {}", "{}{} {}", "{}. {}, {}"))
            rows.append((len(rows), around.format(prose(r, 3), edited(t, n), prose(r, 3))))
    rows += [(900, "What is the Capitol of Peru? asked"), (901, "xwhat is the capitol of peru?"), (902, "what  is the capital of per u?")]
    items += [(90, "what is the capital of peru?")]

    def least(item: str, text: str) -> int:
        if len(item) >= edit_match.WORD_CHARS:
            return least_distance(item, text)
        k, inside = int(len(item) * edit_match.ERROR_RATE), lambda c: c.isalnum()
        ends = [i for i in range(len(text) + 1) if not (0 < i < len(text) and inside(text[i - 1]) and inside(text[i]))]
        pairs = [text[a:b] for a in ends for b in ends if 0 < b - a <= len(item) + k]
        return min((edit_match._distance(item, x) for x in pairs if len(x) >= len(item) - k), default=len(item))

    want = set()
    for i, t in rows:
        h = edit_match.normalize(t)
        for k, p in items:
            n = edit_match.normalize(p)
            if n and (len(n) < 500 or len(h) > len(n) // 2) and (d := least(n, h)) <= int(len(n) * edit_match.ERROR_RATE):
                want.add((i, k, d))
    found = edit_match.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} == want and len(found) == len(want)
    assert {(900, 90, 1), (902, 90, 1)} <= want and not any(i == 901 and k == 90 and d == 1 for i, k, d in want)


# --- tokens ------------------------------------------------------------------------------


def test_wavelet_round_trip():
    r = np.random.RandomState(0)
    for n, v in ((0, 5), (1, 1), (2000, 7), (40_000, 49_000), (3000, 70_000)):
        x, bounds = r.randint(0, v, size=n).astype(np.uint32), np.array([0, n // 3, n // 3, n])
        s = wavelet.decode(wavelet.encode(x, bounds, [5, None, -7]))
        assert (s.decode() == x).all() and s.bounds.tolist() == bounds.tolist() and s.ids == [5, None, -7]
        assert [s.access(i) for i in range(0, n, max(1, n // 40))] == x[:: max(1, n // 40)].tolist()
        for t in set(x[:8].tolist()):
            where = np.flatnonzero(x == t).tolist()
            assert s.occurrences(t) == where and s.count(t) == len(where) and s.count(t, n // 4, n // 2) == int((x[n // 4 : n // 2] == t).sum())
        assert s.count(99_999) == 0
        with pytest.raises(IndexError):
            s.access(n)
        with pytest.raises(IndexError):
            s.select(99_999, 0)
    with pytest.raises(ValueError):
        wavelet.decode(b"nothing")


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ODD = ["don't İstanbul's ", "<|endoftext|> a<|startoftext|>b", "É́ é K ſ\x85x\xa0y 12a3 --;; é", "ÀÉ", "́abc ́", "ǅ ﬁ Ⅷ ²", "日本語 mixed", "a" * 5000, "🙂🙂 ok"]


def test_word_encoding_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_shards, "REMEMBERED", 40)
    e = token_shards.WordEncoder(vocabulary())
    texts = [t for _, t in edge_rows()] + ODD
    for _ in range(2):  # the second time some words are remembered
        ids, per = e.encode(pa.array(texts, pa.string()), 1)
        want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert per.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert len(e.known) == 40


def token_rows(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(vocabulary()), 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_shards_read_back(spark):
    rows = sorted(((i, t) for i, t in edge_rows() if i not in (13, 14)), key=lambda r: (r[0] is not None, r[0] or 0)) + list(enumerate(ODD, 50))
    shards = token_shards.write_shards(docs(spark, rows), vocabulary(), shard_tokens=500)
    got = token_shards.read_documents(shards).orderBy("start").collect()
    assert [tuple(r) for r in got] == token_rows(rows)
    one = shards.orderBy("shard").first()
    shard = token_shards.open_shard(one.path, one.root)
    assert shard.count(1) >= one.n_docs and shard.access(int(shard.bounds[1]) - 1) == 1
    assert token_shards.read_documents(token_shards.write_shards(docs(spark, []), vocabulary())).count() == 0
    twins = token_shards.read_documents(token_shards.write_shards(docs(spark, [(1, "a"), (1, "a"), (1, "b c")]), vocabulary())).collect()
    assert sorted(r.start for r in twins)[0] == 0 and sum(r.n_tokens for r in twins) == 7


# --- language ------------------------------------------------------------------------------

WORDS = {"en": "the and with from that ship water green house", "de": "der und mit von das schiff wasser grün häuser", "fr": "le et avec des que bateau l'eau verte maison", "zz": "xq zzk qpx wkz xkq zqq"}


def talk(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_language_held_out_and_edges(spark):
    r = random.Random(2)
    rows = [(i, talk(r, lang, r.randint(3, 60)), lang) for i, lang in enumerate(list(WORDS) * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ---", "de"), (1003, "the water", None), (1003, "the water", None), (1004, "der " * 60_000, "fr"), (None, "le bateau", "fr")]
    table = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, margin string")
    model = language_id.train(table.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    held = [i for i, _, _ in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[i].lang_pred == rows[i][2] for i in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[1004].lang_pred == "de" and got[None].lang_pred == "fr"
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = language_id.keep_identified(table, model)
    assert kept.columns == table.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= 240
    # A text's prediction does not depend on what stands beside it.
    alone = language_id.identify(table.where("doc_id = 7"), model).first()
    assert alone == got[7]


def test_ambiguous_texts_are_kept(spark):
    r = random.Random(4)
    rows = [(i, talk(r, lang, 40), lang) for i, lang in enumerate(list(WORDS) * 20)] + [(500 + k, t, None) for k, t in enumerate(["e", "r.", "t", "De.", "a", "E. 7"])] + [(600, "7 !", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table)
    assert any(x.ambiguous and x.doc_id < 600 for x in language_id.identify(table, model).collect())
    assert {x.doc_id for x in language_id.keep_identified(table, model).collect()} == {i for i, _, _ in rows} - {600}


def grams_of(text):
    """n, n-gram for all that the language model counts, in plain Python."""
    letters = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    clean = re.sub(b" +", b" ", b" " + letters + b" ")
    for n in language_id.GRAMS:
        slot = language_id.GRAMS.index(n) * language_id.BINS
        for k in range(len(clean) - n + 1):
            yield slot + ((int.from_bytes(clean[k : k + n], "big") * 0x9E3779B1 + n * 0x85EBCA6B) % (1 << 32) >> 18)


def test_language_outputs_losses_and_decoding(monkeypatch):
    r = random.Random(6)
    counts = np.array([[r.randint(0, 9) for _ in range(len(language_id.GRAMS) * language_id.BINS)] for _ in range(5)], float)
    model = language_id.fit(list("abcde"), counts)
    texts = [talk(r, lang, r.randint(1, 40)) + r.choice(["", "  ", " 12!", "É."]) for lang in list(WORDS) * 6] + [" lead", "x", "!?", "", None, "a  b", "  7  "]
    column = pa.array(texts, pa.string())
    for size, step in ((1 << 19, 1 << 16), (64, 16), (7, 3)):  # long texts come in parts, and sum to the same
        monkeypatch.setattr(language_id, "_SLICE", size)
        monkeypatch.setattr(language_id, "_STEP", step)
        got = model.outputs(column)
        for t, out in zip(texts, got):
            grams = list(grams_of(t))
            want = [sum(float(model.odds[g, b]) for g in grams) / max(1, len(grams)) ** 0.5 for b in range(model.odds.shape[1])]
            assert out.tolist() == pytest.approx(want, abs=1e-3)
        batch = pa.RecordBatch.from_arrays([pa.array(["a" if k % 2 else "b" for k in range(len(texts))]), column], names=["lang", "text"])
        have = {(x["lang"], x["bin"]): x["n"] for b in language_id._count(iter([batch])) for x in b.to_pylist()}
        want = {}
        for k, t in enumerate(texts):
            for g in grams_of(t):
                want["a" if k % 2 else "b", g] = want.get(("a" if k % 2 else "b", g), 0) + 1
        assert have == want
    outputs = model.outputs(column)
    for out, losses in zip(outputs, model.losses(outputs)):
        for lang, word in enumerate(model.code):
            assert losses[lang] == pytest.approx(sum(w * np.log1p(np.exp(-z * bit)) if -z * bit < 30 else w * -z * bit for z, bit, w in zip(out, word.tolist(), model.weight)))


def test_language_codes_and_few_labels(spark):
    for n in (2, 4, 7, 12):
        code = language_id.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart * 2 > code.shape[1] * (0.9 if n <= 7 else 0.5)
    table = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", "en"), (3, "?", None)], "doc_id long, text string, lang string")
    one = language_id.identify(table, language_id.train(table)).collect()
    assert [r.lang_pred for r in sorted(one)] == ["en", "en", "und"]
    none = language_id.identify(table, language_id.train(table.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(table.limit(0), language_id.train(table)).count() == 0


# --- fingerprints ------------------------------------------------------------------------


def sets(keys):
    return [frozenset(keys.key[a:b].tolist()) for a, b in zip(keys.first, keys.first[1:])]


def as_keys(groups):
    return iblt.Keys(np.array([k for g in groups for k in sorted(g)], np.uint64), np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int64))


def alike(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_sketches_peel_to_the_difference():
    r = random.Random(3)
    ours = [frozenset(r.getrandbits(64) for _ in range(r.choice([0, 1, 3, 80, 700]))) for _ in range(300)]
    others = [frozenset(list(a)[: r.randint(0, len(a))]) | frozenset(r.getrandbits(64) for _ in range(r.choice([0, 2, 90, 2000]))) for a in ours]
    a, b = as_keys(ours), as_keys(others)
    of_a, of_b = iblt.fingerprints(a), iblt.fingerprints(b)
    assert sets(iblt.given_away(of_a)) == ours
    # The published strings alone tell every difference, also where one sketch is far larger.
    got = iblt.compare_fingerprints(of_a.texts(), of_b.texts())
    assert got.tolist() == pytest.approx([alike(x, y) for x, y in zip(ours, others)])
    part = np.maximum(of_a.part, of_b.part)
    doc, key, sign, whole = iblt.Sketches.of(a, 8 * part).minus(iblt.Sketches.of(b, 8 * part)).peel()
    assert whole.all()
    for d, (x, y) in enumerate(zip(ours, others)):
        assert {k for k, s in zip(key[doc == d].tolist(), sign[doc == d]) if s > 0} == x - y and {k for k, s in zip(key[doc == d].tolist(), sign[doc == d]) if s < 0} == y - x
    # Too small a sketch gets stuck and is made larger.
    tiny = np.full(len(part), 1)
    assert not iblt.Sketches.of(a, tiny).peel()[3].all() and iblt.differing(a, b, tiny).tolist() == [len(x ^ y) for x, y in zip(ours, others)]


def test_paragraphs_are_cut_by_content():
    r = random.Random(4)
    a, b = prose(r, 200), prose(r, 200)
    assert " ".join(iblt.paragraphs(a)) == a and len(iblt.paragraphs(a)) > 5
    common = set(iblt.paragraphs(a + " " + b)) & set(iblt.paragraphs("one more " + a + " " + b))
    assert len(common) > 0.8 * len(iblt.paragraphs(a + " " + b))
    long = prose(r, 20)
    assert iblt.paragraphs(long + " First. Second!\nthird line\nfo " + long)[-1].split()[-1] == long.split()[-1]
    assert {"Second!", "x"} <= set(iblt.paragraphs(f"{long}\nSecond!\nx x x x x {long}")) and iblt.paragraphs("a b") == ["a", "b"]


def test_likeness_does_not_turn_on_length():
    """A text whose last third is replaced or left out stays alike at every length, and no length
    is a step: the mean of ten texts moves little from one length to the next."""
    r = random.Random(21)
    means = []
    for n in range(40, 400, 8):
        whole = [prose(r, 120)[:n] for _ in range(10)]
        pairs = [(t, t[: n - n // 3] + tail) for t in whole for tail in ("", "0123 456 78 9 " * (n // 42))]
        a, b = (iblt.fingerprints(iblt.digests(pa.array([p[k] for p in pairs]))).texts() for k in (0, 1))
        found = iblt.compare_fingerprints(a, b)
        assert found.min() > 0.3
        means.append(found.mean())
    assert np.abs(np.diff(means)).max() < 0.12


def test_versions(spark):
    rows = [(i, t) for i, t in edge_rows() if i not in (13, 14)] + [(20, "naïve\ntext. More."), (21, "🙂" * 10), (22, "As " * 200 + "was " * 200)]
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    got = {r.doc_id: r for r in iblt.compare_versions(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:] + texts[:1])]
    own, new = sets(iblt.digests(pa.array(texts))), sets(iblt.digests(pa.array(edited)))
    for k, (i, _) in enumerate(order):
        g = got[i]
        assert (g.n_chars, g.edited) == (len(texts[k]), edited[k])
        assert g.near_edited == pytest.approx(alike(own[k], new[k])) and g.near_next == pytest.approx(alike(own[k], own[(k + 1) % len(own)]))
        assert iblt.compare_fingerprints([g.fingerprint], [g.edited_fingerprint])[0] == g.near_edited
        assert iblt.compare_fingerprints([g.fingerprint], [got[order[(k + 1) % len(order)][0]].fingerprint])[0] == g.near_next
        words = (texts[k][: len(texts[k]) - len(texts[k]) // 3]).split()
        if len(words) > 3:  # two thirds of the text are unchanged
            assert g.near_edited > 0
    assert got[1].fingerprint == got[2].fingerprint != got[16].fingerprint
    assert iblt.compare_versions(docs(spark, [])).count() == 0
    lone = iblt.compare_versions(docs(spark, [(1, "abcdef")])).first()
    assert lone.edited == "abcdab" and lone.near_next == 1.0
    ties = iblt.compare_versions(docs(spark, [(1, "aaa"), (1, "aaa"), (1, "bbb")])).collect()
    assert len(ties) == 3


def test_versions_do_not_depend_on_the_chunks(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, prose(r, r.randint(0, 300))) for i in range(60)]
    whole = sorted(iblt.compare_versions(docs(spark, rows)).collect())
    batch = pa.RecordBatch.from_pylist([{"block": 0, "halo": False, "doc_id": i, "text": t} for i, t in reversed(rows)], pa.schema([("block", pa.int32()), ("halo", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())]))
    monkeypatch.setattr(iblt, "CHUNK_CHARS", 500)
    got = pa.Table.from_batches(iblt._compare(iter([batch]))).to_pylist()
    assert sorted(tuple(g.values()) for g in got) == [tuple(w) for w in whole if w.doc_id]


# --- urls ----------------------------------------------------------------------------------


def best_split(model, s):
    if not s:
        return 0.0, ()
    return max((best_split(model, s[:-k])[0] + model._word(s[-k:]), (*best_split(model, s[:-k])[1], s[-k:])) for k in range(1, len(s) + 1))


def test_viterbi_is_the_best_split():
    model = url_filter.segmenter({"the": 50, "cat": 20, "he": 10, "sat": 10, "thecat": 1, "at": 5, "s": 2, "cheap": 3, "pills": 3, "fr": 9, "r": 1, "f": 1, "x" * 40: 2})
    for s in ("thecat", "catsat", "hesat", "qzthe", "cheapcat", "a", "frcat", "x" * 40):
        assert sum(map(model._word, model.label(s))) == pytest.approx(best_split(model, s)[0] if len(s) < 20 else model._word(s))
    assert model.label("cheappills") == ("cheap", "pills") and model.host("www.the-cat.com")[:3] == ("www", "the", "cat") and model.label("fr") == ("fr",)


GOOD = "calm water " + " ".join(f"word{k} stone" for k in range(40))


def test_rules_and_verdicts(spark):
    urls = [
        "http://A.Example.com/en/71?x", "https://example.com/en/6", "http://b.example.net/de/8#t", "http://net/de/9", "http://x.org/es/", "http://xorg/es/", "http://cheappills.example.com/fr/1", "http://calm.example.com/fr/2",
        None, "no scheme", "http://", "x://h?q=/en/", "a://b://c/d", "http://EXAMPLE.ORG", "http://cheappills.example.com/fr/1", "http://h/" + "p/" * 5000,
    ]
    rows = [(i, u, GOOD, "h") for i, u in enumerate(urls)]
    rows += [(100 + i, f"http://calm{'water' if i % 2 else 'stone'}.example.com/fr/{i}", GOOD + " calm cheap pills pages", "h") for i in range(60)]
    rows += [(200 + i, f"http://cheap-pills{'a' * i}.example.com/fr/{i}", [None, "<p>cheap pills</p>", "pills " * 500][i % 3], "h") for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(table).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[1].rule, got[1].verdict) == ("com/en/", "block") and (got[2].rule, got[2].verdict) == ("example.net/de/8", "block")
    assert (got[3].rule, got[3].verdict) == ("net/de/", "allow") and got[4].verdict == "block" and got[5].rule is None
    # Pages at such names were poor, so the name is unwanted, also where its own page is good.
    assert got[6].rule is None and not got[6].unwanted and got[6].verdict == "block" == got[14].verdict and "h:cheap h:pills" in got[6].words and got[7].verdict == "allow"
    assert all(got[200 + i].unwanted and got[200 + i].verdict == "block" for i in range(12)) and not any(got[100 + i].unwanted or got[100 + i].verdict == "block" for i in range(60))
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (8, 9, 10))
    assert (got[11].host, got[11].path) == ("h", "") and (got[12].host, got[12].path) == ("b:", "//c/d") and got[13].host == "example.org"
    assert "p:fr" in got[7].words.split()
    assert url_filter.filter_urls(table.limit(0)).count() == 0


def brute_urls(rows):
    """Labels, splits, scores and verdicts of (page_id, url, html) rows in plain Python."""
    pages, counts, hosts = [], {}, {}
    for i, url, html in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower() if m else "", m[2] if m else "")
        rules = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        text = re.sub(r"(?s)<[^>]*>", " ", html or "").lower()
        words = text.split()
        poor = len(words) < 50 or not 3 <= sum(map(len, words)) / len(words) <= 10 or len(set(words)) < 0.05 * len(words)
        verdict = max(rules)[1] if rules else None
        pages.append((i, host, path, verdict, poor))
        for w in re.findall("[a-z]+", text):
            counts[w] = counts.get(w, 0) + (len(w) <= 63)
        for w in re.findall("[a-z]+", path.lower()):
            hosts.setdefault(w, set()).add(host)
    for w, found in hosts.items():
        if len(found) > 1:
            counts[w] = counts.get(w, 0) + len(found) - 1
    model = url_filter.segmenter(counts)
    seen, bins = ([0, 0], [{}, {}])
    split = {i: url_filter.tokens(model, host, path) for i, host, path, _, _ in pages}
    for i, _, _, verdict, unwanted in pages:
        if verdict:  # a rule fits: nothing is learned from it
            continue
        seen[unwanted] += 1
        for w in split[i]:
            b = zlib.crc32(w.encode()) % url_filter.BINS
            bins[unwanted][b] = bins[unwanted].get(b, 0) + 1
    every = len(bins[0].keys() | bins[1].keys())
    share = lambda side, b: (bins[side].get(b, 0) + url_filter.SMOOTHING) / (sum(bins[side].values()) + url_filter.SMOOTHING * every)
    out = {}
    for i, _, _, verdict, _ in pages:
        odds = np.log((seen[1] + 1) / (seen[0] + 1)) + sum(np.log(share(1, b) / share(0, b)) for b in (zlib.crc32(w.encode()) % url_filter.BINS for w in split[i]))
        score = 1 / (1 + np.exp(-odds)) if split[i] else 0.0
        out[i] = (verdict or ("block" if score > 0.5 else "allow"), score, " ".join(split[i]))
    return out


def test_query_matches_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/pages.parquet") if os.path.isdir(d) else spark.createDataFrame([(k, f"http://calmwater{k % 7}.example.org/fr/{k}", GOOD if k % 3 else "few") for k in range(50)], "page_id long, url string, html string")
    extra = spark.createDataFrame([(10_000, None, None), (10_001, "x", ""), (10_002, "http://thetheand.example.net/for-the/AND", GOOD), (10_002, "http://thetheand.example.net/for-the/AND", GOOD)], "page_id long, url string, html string")
    table.select("page_id", "url", "html").unionAll(extra).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = url_filter.op3(spark, f"file://{tmp_path}").collect()
    want = brute_urls([(r.page_id, r.url, r.html) for r in spark.read.parquet(f"file://{tmp_path}/pages.parquet").collect()])
    assert len(got) == table.count() + 4
    for r in got:
        assert (r.verdict, r.words) == (want[r.page_id][0], want[r.page_id][2]) and r.score == pytest.approx(want[r.page_id][1])


def test_rules_teach_the_model_nothing(spark):
    """Other rules change the verdicts of their own pages and the pages learned from, no label."""
    rows = [(k, f"http://calmwater{'pills' if k % 3 == 0 else ''}.example.org/fr/{k}", "few" if k % 3 == 0 else GOOD) for k in range(90)] + [(100 + k, f"http://blocked.example.org/es/{k}", GOOD) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert all(r.verdict == "block" and not r.unwanted for i, r in got.items() if i >= 100)
    assert all((r.verdict == "block") == r.unwanted == (i % 3 == 0) for i, r in got.items() if i < 100)
    half = {r.page_id: r for r in url_filter.filter_urls(pages, learn_from=F.col("page_id") % 2 == 0).collect()}
    assert all((r.verdict == "block") == (i % 3 == 0) for i, r in half.items() if i < 100 and i % 2)


def test_rare_words_split_hosts_too(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEXICON", 200)
    r = random.Random(8)
    rare = sorted({"".join(r.choice("bcdfgklmnprtvz") + r.choice("aeiou") for _ in range(4)) for _ in range(3_000)})
    pieces = [a + b for a in "bcdfgklmnprtvz" for b in "aeiou"]  # frequent words that the rare ones are made of
    text = ("calm water stone " + " ".join(pieces) + " ") * 50 + "loan " + " ".join(rare)
    hosts = [f"{a}{b}.example.com" for a, b in zip(r.sample(rare, 40), ["calm", "water", "stone", "loan"] * 10)] + ["calmwater.example.net"]
    urls = [f"http://www.{h}/{r.choice(rare)}stone/{k}" for k, h in enumerate(hosts)] + [None, f"http://{hosts[0]}/"]
    rows = [(k, u, text if k == 0 else None) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, want = {x.page_id: x for x in url_filter.filter_urls(pages).collect()}, brute_urls(rows)
    assert len(got) == len(urls) and all(x.words == want[i][2] and x.score == pytest.approx(want[i][1]) for i, x in got.items())
    assert sum(h[:8] in rare and f"h:{h[:8]}" in got[k].words.split() for k, h in enumerate(hosts)) >= 35


def test_words_are_broadcast_down_to_a_count(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "word string, n long")
    for size, words in ((10, "abcd"), (3, "abc"), (2, "a")):
        model, others = url_filter.word_model(counts, size)
        assert "".join(sorted(model.log_p)) == words and model.total == 8
        assert (others is None) == (size == 10)
