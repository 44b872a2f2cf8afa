"""Parsing, discovery, ignore rules."""

from pyspark.sql import functions as F

from tessera.functions.pystructure import chunks, import_base, symbols
from tessera.operators import structure
from tessera.sources import pysource
from tessera.sources.gitwild import Ignore

SOURCE = '''import os

LIMIT = 3


@cached
@retry(
    times=2,
)
def fetch(url):
    """Fetch it."""
    return os.get(url)


class Box:
    """A box."""

    @property
    def size(self):
        return self.measure()

    async def open(self):
        pass


if LIMIT:
    def hidden():
        pass
'''


def test_chunks_have_decorators_docstrings_and_spans():
    found = {c.qualname: c for c in chunks("m", "m.py", SOURCE)}
    assert set(found) == {"m.fetch", "m.Box", "m.Box.size", "m.Box.open", "m"}
    f = found["m.fetch"]
    assert (f.kind, f.start_line, f.end_line, f.docstring) == ("function", 6, 12, "Fetch it.")
    assert f.decorators == ["cached", "retry(\n    times=2,\n)"]
    assert f.text.startswith("@cached") and f.text.endswith("os.get(url)")
    assert found["m.Box"].docstring == "A box."
    assert found["m.Box.open"].kind == "method" and found["m.Box.open"].class_name == "Box"
    assert found["m.Box.size"].text.startswith("@property")
    assert "hidden" in found["m"].text and found["m"].start_line == 1


def test_blank_remainder_is_no_chunk_and_order_is_class_then_methods():
    names = [c.qualname for c in chunks("m", "m.py", "class A:\n    def f(self): pass\n\ndef g(): pass\n")]
    assert names == ["m.A", "m.A.f", "m.g"]


def test_docstrings_as_written():
    doc = lambda body: next(iter(chunks("m", "m.py", f"def f():\n    {body}\n"))).docstring
    assert doc('"""  x "y" """') == 'x "y"'
    assert doc('r"x"') == 'r"x'
    assert doc('"a" "b"') is None
    assert doc('("a")') is None
    assert doc("x = 1") is None


def test_duplicate_names_stay():
    assert len([c for c in chunks("m", "m.py", "def f(): pass\ndef f(): pass\n") if c.kind == "function"]) == 2


def test_definitions_by_scope():
    src = "class A:\n    class B:\n        def f(self):\n            def g(): pass\n    if x:\n        def h(self): pass\n"
    got = [(d.qualname, d.kind, d.class_name) for d in symbols("m", src).defs]
    assert got == [("m.A", "class", None), ("m.B", "class", None), ("m.B.f", "method", "B"), ("m.B.f.g", "function", None), ("m.A.h", "method", "A")]


def test_imports_and_relative_bases():
    src = "import a.b\nimport c.d as e\nfrom . import x\nfrom ..y import z as w\nfrom . import *\n"
    got = [(i.local_name, i.imported_module, i.imported_symbol) for i in symbols("p.q.r", src).imports]
    assert got == [("a", "a.b", None), ("e", "c.d", None), ("x", "p.q", "x"), ("w", "p.y", "z"), ("*", "p.q", "*")]
    assert import_base("p.q", True, 1) == "p.q"
    assert import_base("p.q", False, 1) == "p"
    assert import_base("p", False, 1) == ""
    assert symbols("p", "from .n import k").imports[0].imported_module == ".n"


def resolved(spark, files):
    table = spark.createDataFrame(list(files.items()), "rel_path string, content string")
    analysis = structure.analyze(pysource.files_of_table(table))
    return {(r.caller, r.callee, r.resolved) for r in structure.calls(analysis).collect()}


def test_call_resolution_rules(spark):
    src = (
        "import a.b\nimport k\nfrom z import k\nclass C:\n    def f(self):\n        self.g(); cls.h(); self.x.y()\n        def n():\n            self.g()\n"
        "def top():\n    self.q(); C(); C.f(); a.b.f(); k(); k.m(); (lambda: u())(); [v(i) for i in t()]\n    x()()\n@deco()\ndef late(a=dflt()): pass\n"
    )
    got = resolved(spark, {"m.py": src})
    assert ("m.C.f", "m.C.g", True) in got and ("m.C.f", "m.C.h", True) in got
    assert ("m.C.f", "self.x.y", False) in got
    assert ("m.C.f.n", "m.C.f.g", True) in got  # the parent of the caller, whatever it is
    assert ("m.top", "self.q", False) in got
    assert ("m.top", "m.C", True) in got and ("m.top", "m.C.f", True) in got
    assert ("m.top", "a.b.b.f", True) in got  # the head is what was imported, the rest follows
    assert ("m.top", "z.k", True) in got and ("m.top", "z.k.m", True) in got  # the last import of a name
    assert ("m.top", "<dynamic>", False) in got and ("m.top", "u", False) in got and ("m.top", "v", False) in got
    assert not any(c in ("deco", "dflt") for _, c, _ in got)


def test_three_part_caller_needed_for_self(spark):
    assert ("pkg.mod.f", "pkg.mod.x", True) in resolved(spark, {"pkg/mod.py": "def f(self):\n    self.x()\n"})
    assert ("mod.f", "self.x", False) in resolved(spark, {"mod.py": "def f(self):\n    self.x()\n"})


def test_ignore_rules():
    ig = Ignore(["*.log", "/build/", "docs/**/x.py", "!keep.log", "a/*.py", "# no", "", "tmp?.py", "[ab].py"])
    assert ig("d/e.log") and not ig("d/keep.log")
    assert ig("build/x.py") and not ig("src/build/x.py")
    assert ig("docs/x.py") and ig("docs/a/b/x.py")
    assert ig("a/q.py") and not ig("a/b/q.py")
    assert ig("tmp1.py") and not ig("tmp12.py") and ig("z/a.py") and not ig("z/c.py")


def test_discovery_sorted_pruned_and_decoded(spark, tmp_path):
    for name, text in {
        "b.py": "x = 1\r\ny = 2\r", "a/__init__.py": "", "a/b.py": "f()\n", "a-b.py": "", ".venv/q.py": "", "gen/z.py": "", ".gitignore": "gen/\n", "note.txt": "",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "bom.py").write_bytes(b"\xef\xbb\xbfx = 1\n")
    assert pysource.discover(str(tmp_path)) == ["a/__init__.py", "a/b.py", "a-b.py", "b.py", "bad.py", "bom.py"]
    rows = {r.rel_path: r for r in structure.analyze(pysource.read_repo(spark, str(tmp_path))).collect()}
    assert rows["bad.py"].error and rows["bom.py"].error and not rows["b.py"].error
    assert rows["b.py"].chunks[0].end_line == 2 and rows["a/__init__.py"].module == "a"


def test_module_names(spark):
    paths = ["a/b.py", "a/__init__.py", "__init__.py", "x.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(pysource.module_of(F.col("p")).alias("m")).collect()
    assert [r.m for r in got] == [pysource.module_name(p) for p in paths] == ["a.b", "a", "__init__", "x"]


def test_table_functions(spark):
    structure.register(spark)
    spark.createDataFrame([("m", "m.py", "def f():\n    g()\n")], "module string, rel_path string, content string").createOrReplaceTempView("tf_files")
    assert [r.qualname for r in spark.sql("SELECT c.* FROM tf_files, LATERAL python_chunks(module, rel_path, content) c").collect()] == ["m.f"]
    assert [(r.tag, r.qualname, r.name) for r in spark.sql("SELECT s.* FROM tf_files, LATERAL python_symbols(module, content, false) s").collect()] == [("def", "m.f", None), ("call", "m.f", "g")]


def test_calls_of_a_file_with_many_imports_and_words(spark):
    """The last import of a name counts, wherever it stands; a definition yields to it."""
    from tessera.sources.pysource import files_of_table

    text = "from a import x\ndef x():\n    y(); z.q(); x.r()\nclass y:\n    def m(self):\n        self.k(); cls.k.j(); w()\nfrom b import x\nimport z.u\n"
    files = files_of_table(spark.createDataFrame([("p/f.py", text), ("p/g.py", "def w(): pass\n"), ("p/h.py", None)], "rel_path string, content string"))
    analysis = structure.analyze(files)
    got = [(r.caller, r.callee, r.lineno, r.resolved) for r in structure.calls(analysis).orderBy("file_seq", "seq").collect()]
    assert got == [
        ("p.f.x", "p.f.y", 3, True),
        ("p.f.x", "z.u.q", 3, True),
        ("p.f.x", "b.x.r", 3, True),
        ("p.f.y.m", "p.f.y.k", 6, True),
        ("p.f.y.m", "cls.k.j", 6, False),
        ("p.f.y.m", "w", 6, False),
    ]
    assert [r.rel_path for r in analysis.where("error IS NOT NULL").collect()] == ["p/h.py"]


def test_source_of_a_text_is_made_of_all_its_lines(spark):
    from tessera.plans.code_queries import source_of

    texts = ["Ab\n\n1 2\nX y z\nlast, word", None, "", "a b c d e\nx@y.z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", source_of(F.col("text")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == ["import w_ab\nclass w_x:\n    def w_y(self):\n        self.w_z()\ndef w_last():\n    w_word()", "", "", "from w_a.w_b import w_c, w_d, w_e\nclass w_x:\n    def w_y(self):\n        self.w_z()\ndef ("]
