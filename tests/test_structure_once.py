"""Nodes and edges of files that are not stored: from one parse, without a sort."""

from tessera.operators import graph, structure
from tessera.plans import code_queries
from tessera.sources.pysource import files_of_table

def parses(df):
    """How often the plan of ``df`` goes through its files."""
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


FILES = [
    ("a.py", "import os, os.path\nimport os\ndef f():\n    g(); os.path.join(f(x()))\nf()\n"),
    ("a/__init__.py", "from . import b\nimport os\nclass f:\n    def g(self):\n        self.h()\n"),
    ("b.py", "from a import f\nfrom a import g\nf(); f()\n"),
    ("c.py", "def ("),
    ("d.py", ""),
]


def test_nodes_and_edges_of_files_are_those_of_stored_parts_from_one_parse(spark):
    for files, passes in ((FILES, 2), (FILES[1:], 1)):  # the module a is two files, or one
        table = files_of_table(spark.createDataFrame(files, "rel_path string, content string"))
        analysis = structure.analyze(table, ("raw_calls", "imports", "defs"))
        good = analysis.where("error IS NULL")
        nodes, edges = graph.file_nodes(analysis), graph.file_edges(table)
        assert parses(nodes) == 1 and parses(edges) == passes
        assert " Sort [_k" not in edges._jdf.queryExecution().executedPlan().toString()
        rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
        assert rows(nodes) == rows(graph.build_nodes(good, structure.definitions(good)))
        assert rows(edges) == rows(graph.build_edges(structure.calls(good), structure.imports(good)).drop("edge_seq"))


def test_text_queries_parse_their_files_once(spark):
    for name in ("text_nodes", "text_edges"):
        df = code_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert parses(df) == 1 and " Sort [_k" not in df._jdf.queryExecution().executedPlan().toString()
