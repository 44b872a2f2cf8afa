"""Substring lookup by trigrams, and callers by bits, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, tools, trigrams

R = random.Random(11)
NAMES = ["a", "ab", "aba", "abab", "_", "x_1", "é", "éa", "a-b", "ab.b", "--", " ", "", "absent", "日本", "b a", "((a"]


def texts():
    alphabet = "aab_x1 é-.日本\n("
    return [None, "", "a", "--", "日本語 aba", "x_1"] + ["".join(R.choices(alphabet, k=R.randint(1, 40))) for _ in range(80)]


@pytest.mark.parametrize("stored", [False, True])
def test_every_name_is_found_where_it_stands(spark, tmp_path, stored):
    data = [(f"c{k}", k, "tests/t.py", f"q{k}", 1, t) for k, t in enumerate(texts())]
    chunks = spark.createDataFrame(data, "chunk_id string, chunk_seq long, file string, qualname string, start_line int, text string")
    index = trigrams.build(chunks)
    if stored:
        index = trigrams.save(index, str(tmp_path / "i"))
    got = sorted((r.name, r.chunk_seq) for r in trigrams.find(index, spark.createDataFrame([(n,) for n in NAMES], "name string")).collect())
    assert got == sorted((n, k) for n in NAMES for k, t in enumerate(texts_of(data)) if t is not None and n in t)


def texts_of(data):
    return [d[-1] for d in data]


def test_find_tests_with_a_stored_index_is_the_same(spark, tmp_path):
    rows = [(k, f"f{k % 5}::q{k}", f"{'tests/' if k % 2 else ''}f{k % 5}.py", f"q{k}", f"calls run_{k % 3} and stop()", 1) for k in range(20)]
    chunks = spark.createDataFrame(rows, "chunk_seq long, chunk_id string, file_path string, qualname string, text string, start_line int")
    targets = spark.createDataFrame([("m.run_1",), ("m.C.stop",), ("m.none",)], "target string")
    index = trigrams.save(trigrams.build(tools.test_chunks(chunks)), str(tmp_path / "i"))
    flat = lambda df: sorted(map(tuple, df.collect()))
    found = flat(tools.find_tests(chunks, targets, index))
    assert found == flat(tools.find_tests(chunks, targets)) and len(found) == 14


def test_callers_by_bits_are_those_of_a_search_from_each_target(spark):
    edges = [(k, f"n{R.randint(0, 120)}", f"n{R.randint(0, 120)}", "call", 1, R.random() < 0.8) for k in range(300)]
    df = spark.createDataFrame(edges, "edge_seq long, src string, dst string, type string, lineno int, resolved boolean")
    targets = [f"n{k}" for k in range(0, 121)] + ["nowhere"]  # more than one number has bits for
    back = {}
    for _, src, dst, _, _, ok in edges:
        if ok:
            back.setdefault(dst, set()).add(src)
    want = set()
    for t in targets:
        seen, frontier = {t}, {t}
        for depth in range(1, 4):
            frontier = {s for n in frontier for s in back.get(n, ())} - seen
            seen |= frontier
            want |= {(t, n, depth) for n in frontier}
    asked = spark.createDataFrame([(t,) for t in [*targets, targets[0]]], "target string")
    got = [tuple(r) for r in graph.reachable_callers(df, asked, 3).collect()]
    assert sorted(got) == sorted(want)
    assert sorted(got) == sorted(tuple(r) for r in graph.transitive_callers(df, asked, 3).select("target", "caller", "depth").collect())
    assert graph.reachable_callers(df, asked.where(F.lit(False))).collect() == []
