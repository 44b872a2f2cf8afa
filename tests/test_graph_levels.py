"""Searches of the call graph from many targets at once."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from test_graph import edges, goal

def shuffled(spark):
    """Bytes of all shuffles of the session so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_no_way_is_made_to_a_caller_that_was_known_before(spark):
    # Everyone calls everyone: all are found at depth 1, and the 1.7 million steps of level 2 lead to none.
    names = [f"n{i}" for i in range(120)]
    rows = [(a, b, True) for a in names for b in names if a != b]
    every, asked = edges(spark, rows).repartition(4).persist(), goal(spark, *names)
    every.count()
    before = shuffled(spark)
    got = graph.transitive_callers(every, asked)
    assert got.where("depth = 1 AND size(position) = 1").count() == got.count() == 120 * 119
    assert shuffled(spark) - before < 700_000  # 918,706 before, 522,152 now


def test_few_targets_are_numbered_in_few_groups(spark):
    asked = goal(spark, *[f"n{i}" for i in range(600)])
    got = graph._numbered(asked).select("group", "bit").collect()
    assert len({tuple(r) for r in got}) == 600 and len({r.group for r in got}) == 2


def test_more_targets_than_a_row_has_bits_for(spark):
    # A ring of 700 functions: everyone is reached by the five before it, first to last.
    rows = [(f"n{i}", f"n{(i + 1) % 700}", True) for i in range(700)]
    asked = goal(spark, *[f"n{i}" for i in range(700)])
    want = sorted((f"n{i}", f"n{(i - k) % 700}", k) for i in range(700) for k in range(1, 6))
    assert sorted(map(tuple, graph.reachable_callers(edges(spark, rows), asked).collect())) == want
    ways = graph.transitive_callers(edges(spark, rows), asked).collect()
    assert sorted((r.target, r.caller, r.depth) for r in ways) == want
    assert all(r.position == [(int(r.target[1:]) - k) % 700 for k in range(1, r.depth + 1)] for r in ways)


def test_a_block_sends_a_caller_once(spark, monkeypatch):
    # Each of 3,000 functions calls 20 that have near names, and all are asked for: six groups of targets.
    monkeypatch.setattr(graph, "FEW", 100)  # so frontiers are not sent to every task
    pick = random.Random(5)
    rows = [(f"n{i:04}", f"n{(7 * i + s) % 3000:04}", True) for i in range(3000) for s in pick.sample(range(100), 20)]
    every, asked = edges(spark, rows).repartition(4).persist(), goal(spark, *[f"n{i:04}" for i in range(3000)])
    every.count()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables too large for it
        before = shuffled(spark)
        got = {r.depth: r["count"] for r in graph.reachable_callers(every, asked, 3).groupBy("depth").count().collect()}
        sent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = {f"n{i:04}": 1 << i for i in range(3000)}
    last, want = seen, {}
    for depth in range(1, 4):
        new = dict.fromkeys(seen, 0)
        for caller, callee, _ in rows:
            new[caller] |= last[callee] & ~seen[caller]
        last, seen = new, {n: seen[n] | new[n] for n in seen}
        want[depth] = sum(bits.bit_count() for bits in new.values())
    assert got == {d: n for d, n in want.items() if n}
    assert sent < 9_000_000  # 14,398,018 before, 6,515,197 now


def test_steps_into_one_function_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "BLOCK", 50)
    rows = [(f"c{i}", "hub", True) for i in range(300)] + [("hub", f"t{i}", True) for i in range(510)] + [("c1", "c2", True), ("c1", "c2", True), ("hub", "c1", True)]
    asked = goal(spark, *[f"t{i}" for i in range(510)], "c2", "nowhere")
    assert len({r.block for r in graph._laid(edges(spark, rows).select("dst", F.col("src").alias("caller")), graph._numbered(asked)).select("block").where("dst = 'hub'").distinct().collect()}) > 1
    want = [(f"t{i}", "hub", 1) for i in range(510)] + [(f"t{i}", f"c{j}", 2) for i in range(510) for j in range(300)]
    want += [("c2", "c1", 1), ("c2", "hub", 2)] + [("c2", f"c{j}", 3) for j in range(300) if j not in (1, 2)]
    assert sorted(map(tuple, graph.reachable_callers(edges(spark, rows), asked).collect())) == sorted(want)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_a_block_sends_on_the_first_way_to_a_caller(spark, monkeypatch, few):
    # All 40 of level 1 call the targets and are called by all 300 of level 2: 12,000 ways to each, of which 300 count.
    # Blocks go through few steps at a time; the order of call sites is not that of names.
    monkeypatch.setattr(graph, "TAKEN", 50)
    monkeypatch.setattr(graph, "FEW", few)
    pick = random.Random(3)
    rows = [(f"m{i}", t, True) for i in range(40) for t in ("t1", "t2")] + [(f"c{j}", f"m{i}", True) for i in range(40) for j in range(300)]
    rows += [("top", "c7", True), ("m3", "m5", True), ("t1", "top", True), ("far", "t1", True)]
    pick.shuffle(rows)
    first = {}
    for seq, (caller, callee, _) in enumerate(rows):
        first.setdefault((callee, caller), seq)
    into = {}
    for (callee, caller), seq in first.items():
        into.setdefault(callee, []).append((seq, caller))
    want = []
    for target in ("t1", "t2"):
        level, seen = {target: ()}, {target}
        for depth in range(1, 6):
            new = {}
            for node, way in level.items():
                for seq, caller in into.get(node, ()):
                    if caller not in seen:
                        new[caller] = min(new.get(caller, (*way, seq)), (*way, seq))
            want += [(target, caller, depth, list(way)) for caller, way in new.items()]
            level, seen = new, seen | set(new)
    got = graph.transitive_callers(edges(spark, rows), goal(spark, "t1", "t2", "nowhere"))
    assert sorted((r.target, r.caller, r.depth, r.position) for r in got.collect()) == sorted(want)
