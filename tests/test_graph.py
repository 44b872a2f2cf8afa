"""Graph lookups and impact reports."""

from tessera.operators import graph, impact, structure
from tessera.sources.pysource import files_of_table


def edges(spark, rows):
    return spark.createDataFrame([(i, s, d, "call", i * 10, r) for i, (s, d, r) in enumerate(rows)], "edge_seq long, src string, dst string, type string, lineno int, resolved boolean")


def goal(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "target string")


def test_direct_callers_keep_sites_and_drop_unresolved(spark):
    e = edges(spark, [("a", "x", True), ("a", "x", True), ("b", "x", False), ("x", "x", True)])
    assert sorted(r.caller for r in graph.caller_sites(e, goal(spark, "x")).collect()) == ["a", "a", "x"]
    assert graph.direct_callers(e, goal(spark, "x", "gone")).collect()[0].callers == ["a", "x"]
    assert [r.callee for r in graph.unresolved_calls(e, goal(spark, "b")).collect()] == ["x"]
    assert graph.callees(e, goal(spark, "a")).collect()[0].callees == ["x"]


def brute(rows, target, depth=5):
    """(caller, lineno) in the order of discovery, level by level."""
    seen, frontier = {}, [target]
    for _ in range(depth):
        nxt = []
        for node in frontier:
            order, first = [], {}
            for i, (s, d, ok) in enumerate(rows):
                if d == node:
                    if s not in order:
                        order.append(s)
                    if ok:
                        first.setdefault(s, i * 10)
            # of one caller's sites the earliest resolved one counts
            for s in sorted(first, key=lambda s: first[s]):
                if s not in seen and s != target:
                    seen[s] = first[s]
                    nxt.append(s)
        frontier = nxt
    return list(seen.items())


def test_transitive_order_cycles_and_cutoff(spark):
    rows = [("c", "b", True), ("b", "a", True), ("d", "a", True), ("c", "d", True), ("a", "c", True), ("e", "c", False), ("f", "c", True), ("g", "f", True), ("h", "g", True), ("i", "h", True), ("b", "b", True)]
    got = graph.transitive_callers(edges(spark, rows), goal(spark, "a", "zzz")).orderBy("depth", "position").collect()
    assert [(r.caller, r.lineno) for r in got] == brute(rows, "a")
    assert "i" not in {r.caller for r in got} and {r.target for r in got} == {"a"}


def package(spark, files):
    a = structure.analyze(files_of_table(spark.createDataFrame(list(files.items()), "rel_path string, content string")))
    good = a.where("error IS NULL")
    chunks = structure.chunks(a.orderBy("file_seq"))
    nodes = graph.build_nodes(good.select("module", "file_seq"), structure.definitions(good))
    return chunks, nodes, graph.build_edges(structure.calls(good), structure.imports(good))


FILES = {
    "low.py": "def leaf():\n    pass\n\ndef other():\n    print('x')\n",
    "mid.py": "from low import leaf\n\ndef step():\n    leaf()\n",
    "top.py": "import mid\n\ndef go():\n    mid.step()\n\ndef other():\n    go()\n",
    "tests/test_low.py": "from low import leaf\n\ndef test_leaf():\n    leaf()\n",
}


def test_impact_report(spark):
    chunks, nodes, edges_ = package(spark, FILES)
    rows = {r.target: r for r in impact.facts_text(impact.impact_report(goal(spark, "low.leaf", "step", "other", "nothing", "print", "low"), chunks, nodes, edges_)).collect()}
    r = rows["low.leaf"]
    assert r.direct_callers == ["mid.step", "tests.test_low.test_leaf"] and r.transitive_callers == ["top.go", "top.other"]
    assert r.target_module == "low" and r.dependent_modules == ["mid", "tests.test_low"]
    assert "tests.test_low.test_leaf" in r.related_tests
    assert r.facts.startswith("Target: low.leaf\nDirect callers (2): mid.step, tests.test_low.test_leaf\n")
    assert rows["step"].resolved_target == "mid.step" and rows["step"].direct_callers == ["top.go"]
    assert rows["other"].error == "Ambiguous target 'other', matches: low.other, top.other" and rows["other"].direct_callers is None
    assert rows["nothing"].error == "Symbol 'nothing' not found in the index."
    assert rows["print"].resolved_target == "print" and rows["print"].direct_callers == []  # a node by its edge alone
    assert rows["low"].target_module == "low" and rows["low"].facts.count("none") >= 1


def test_module_target_reports_importers_of_its_parent(spark):
    chunks, nodes, edges_ = package(spark, {"pkg/__init__.py": "", "pkg/sub.py": "X = 1\n", "user.py": "from pkg import sub\nimport pkg.sub\n"})
    r = impact.impact_report(goal(spark, "pkg.sub"), chunks, nodes, edges_).first()
    assert r.target_module == "pkg" and r.dependent_modules == ["user"]


def test_nodes_merge_by_name(spark):
    _, nodes, _ = package(spark, {"a.py": "def f(): pass\n", "a/__init__.py": "class f: pass\n"})
    rows = {r.qualname: (r.kind, r.module) for r in nodes.collect()}
    assert rows["a"] == ("module", None) and rows["a.f"] == ("function", "a")
    assert len(rows) == 2
