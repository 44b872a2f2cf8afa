"""What a worker of the structure analysis holds at once, and how calls are resolved."""

import gc

import pyarrow as pa

from tessera.functions import pystructure
from tessera.operators import structure
from tessera.schemas import FILE_ANALYSIS


def batch(texts):
    n = range(len(texts))
    return pa.RecordBatch.from_pydict(
        {"file_seq": list(n), "rel_path": [f"f{i}.py" for i in n], "module": [f"f{i}" for i in n], "content": texts, "is_package_init": [False] * len(texts), "error": pa.array([None] * len(texts), pa.string())}
    )


def test_a_batch_of_many_files_is_analyzed_a_few_at_a_time(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FILE_ANALYSIS))
    texts = ["def f(): g()\n"] * 1000 + [None] * 2 + ["x = 1\n" * 100_000, "def (", "import a\n"]
    out = list(structure._analyze(schema, ("imports",))(iter([batch(texts).set_column(5, "error", pa.array(["gone" if t is None else None for t in texts], pa.string()))])))
    assert max(map(len, out)) <= structure.FILES and len(out) > 10
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["file_seq"] for r in rows] == list(range(len(texts)))
    assert [r["error"] is None for r in rows] == [True] * 1000 + [False, False, True, False, True]
    assert rows[-1]["imports"][0]["imported_module"] == "a" and all(r["defs"] == [] == r["raw_calls"] for r in rows)


def test_calls_of_a_file_with_many_imports_are_resolved_by_looking_names_up():
    # 20,000 calls of 20,000 imported names: 400 million comparisons if each call searched all of them.
    n = 20_000
    text = "from m import " + ", ".join(f"a{i}" for i in range(n)) + "\n" + "\n".join(f"a{i}.b()" for i in range(n)) + "\nq()\n(1)()\n"
    found = pystructure.resolve("f", pystructure.symbols("f", text))
    assert [(c.callee, c.resolved) for c in found] == [(f"m.a{i}.b", True) for i in range(n)] + [("q", False), ("<dynamic>", False)]


def test_only_what_is_asked_for_is_made(monkeypatch):
    made = []
    for name in ("chunks", "resolve"):
        monkeypatch.setattr(pystructure, name, lambda *_, name=name: made.append(name) or [])
    text = "import a\ndef f():\n    b(); (lambda: c())()\nif a:\n    class g: pass\n"
    assert structure._parts_of("m", "m.py", text, False, ()) == {} == structure._parts_of("m", "m.py", "", False, ())
    found = structure._parts_of("m", "m.py", text, False, ("defs", "imports"))
    assert [d.qualname for d in found["defs"]] == ["m.f", "m.g"] and [i.local_name for i in found["imports"]] == ["a"] and not made
    whole = pystructure.symbols("m", text)
    assert (whole.defs, whole.imports) == (found["defs"], found["imports"]) and [c.raw for c in whole.raw_calls] == ["b", None, "c"]


def test_a_parse_does_not_look_for_cycles(spark, monkeypatch):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, looks = to_arrow_schema(StructType.fromDDL(FILE_ANALYSIS)), []
    parse = structure.ast.parse
    monkeypatch.setattr(structure.ast, "parse", lambda text: looks.append(gc.isenabled()) or parse(text))
    for _ in structure._analyze(schema, ("defs",))(iter([batch(["x = 1\n", "def ("])])):
        assert gc.isenabled()
    assert looks == [False, False]


def test_a_long_sum_is_walked_without_recursion():
    text = "x = " + " + ".join(f"f{i}()" for i in range(1500)) + "\n"
    assert [c.raw for c in pystructure.symbols("m", text).raw_calls] == [f"f{i}" for i in range(1500)]
