"""Tokens, BM25, vectors, fusion, workspace, command line."""

import math
import re

from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import text as T
from tessera.operators import dense, hybrid, lexical
from tessera.plans import workspace
from tessera.sources.pysource import files_of_table


def tokens(text):
    out = []
    for w in re.split("[^a-zA-Z0-9]+", text):
        if w:
            out.append(w.lower())
            out += [p.lower() for p in re.split("(?<=[a-z0-9])(?=[A-Z])", w) if p.lower() != w.lower()]
    return out


def test_tokenize(spark):
    texts = ["get_user", "parseHTTPResponse2Go", "", None, "été Ab1C x", "  __init__  ", "The K\u212aa \u0130b", "Plain Text, HERE."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokenize(F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [tokens(t or "") for t in texts]
    assert got[0].k == ["get", "user"]


DOCS = ["retry logic for retry", "parse the text", "logic of parsing", "", "the the the", None]


def bm25(query):
    toks = [tokens(d or "") for d in DOCS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    out = []
    for i, d in enumerate(toks):
        s = sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in tokens(query) if t in d)
        if s > 0:
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_bm25_matches_the_formula(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_seq long, text string")
    index = lexical.build_index(docs)
    asked = ["retry logic", "the", "the the parse", "unknown", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = lexical.search(index, queries, 10, digits=6).orderBy("query_id", "rank").collect()
    for i, q in enumerate(asked):
        assert [(r.doc_seq, r.score) for r in got if r.query_id == i] == bm25(q)
    assert lexical.build_index(docs.limit(0)).corpus.first().n == 0


def test_dense_ties_kinds_and_empty_vectors(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, None, "a")], "doc_seq long, embedding array<float>, kind string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.doc_seq, r.score, r["rank"]) for r in dense.search(v, q, 3).orderBy("rank").collect()] == [(1, 1.0, 1), (3, 1.0, 2), (2, 0.0, 3)]
    assert [r.doc_seq for r in dense.search(v, q, 2, kind="a").orderBy("rank").collect()] == [3, 2]
    assert dense.search(v, q.limit(0), 3).count() == 0
    both = v.select("embedding", F.lit([1.0, 1.0]).alias("o")).where("embedding is not null").select(T.cosine(F.col("embedding"), F.col("o")).alias("c")).collect()
    assert [None if r.c is None else round(r.c, 6) for r in both] == [0.707107, 0.707107, 0.707107, None]


def test_fusion_order_and_duplicates(spark):
    rows = [(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1), (0, 1, "c", 2), (1, 0, "x", 1), (1, 1, "y", 1), (2, 0, "d", 1), (2, 0, "d", 3)]
    got = hybrid.fuse(spark.createDataFrame(rows, "query_id long, list_id int, id string, rank int")).orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 0] == ["b", "a", "c"]
    assert [(r.id, r.dense_rank, r.bm25_rank) for r in got if r.query_id == 1] == [("x", 1, None), ("y", None, 1)]  # the dense list first
    d = next(r for r in got if r.query_id == 2)
    assert d.dense_rank == 3 and abs(d.fused_score - (1 / 61 + 1 / 63)) < 1e-12


FILES = {
    "svc.py": "def load_user(uid):\n    '''Load a user.'''\n    return fetch(uid)\n\ndef fetch(uid):\n    return uid\n",
    "tests/test_svc.py": "from svc import load_user\n\ndef test_load():\n    load_user(1)\n",
    "bad.py": "def (:\n",
}


def test_workspace_roundtrip(spark, tmp_path):
    files = files_of_table(spark.createDataFrame(list(FILES.items()), "rel_path string, content string"))
    embed = lambda t: t.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    workspace.build(files, f"file://{tmp_path}/ix", embed)
    ws = workspace.load(spark, f"file://{tmp_path}/ix")
    s = ws.summary().first()
    assert (s.files, s.skipped, s.functions_methods, s.resolved_calls) == (3, 1, 3, 2)
    asked = spark.createDataFrame([(0, "load user")], "query_id long, text string")
    plain = ws.search(asked, 3).orderBy("rank").collect()
    assert "svc.load_user" in [r.qualname for r in plain] and {r.dense_rank for r in plain} == {None} and plain[0].bm25_rank == 1
    assert any(r.dense_rank for r in ws.search(asked, 3, embed).collect())
    assert len(ws.search(asked, 0).collect()) <= 8
    assert ws.vectors.count() == ws.chunks.count()


def test_command_line(tmp_path, capsys):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert cli.main(["search", "x", "--repo", str(tmp_path)]) == 1
    assert cli.main(["index", str(tmp_path)]) == 0
    assert "Indexed 3 files (1 skipped)" in capsys.readouterr().out
    assert cli.main(["search", "load user", "--repo", str(tmp_path)]) == 0
    assert "svc.py:1 (svc.load_user)" in capsys.readouterr().out
    assert cli.main(["graph", "callers", "svc.load_user", "--repo", str(tmp_path)]) == 0
    assert "tests.test_svc.test_load\t4" in capsys.readouterr().out
    assert cli.main(["graph", "importers", "svc", "--repo", str(tmp_path)]) == 0
    assert "tests.test_svc" in capsys.readouterr().out
    assert cli.main(["impact", "load_user", "--repo", str(tmp_path)]) == 0
    assert "Target: svc.load_user" in capsys.readouterr().out
    assert cli.main(["impact", "nope", "--repo", str(tmp_path)]) == 1
    assert cli.main(["index", str(tmp_path / "missing")]) == 1


def test_chunks_as_json(spark, tmp_path):
    from tessera.operators import structure
    from tessera.sources.chunkfiles import read_chunks, write_chunks

    files = files_of_table(spark.createDataFrame(list(FILES.items()), "rel_path string, content string"))
    chunks = structure.chunks(structure.analyze(files).orderBy("file_seq")).cache()
    write_chunks(chunks, f"file://{tmp_path}/chunks")
    back = read_chunks(spark, f"file://{tmp_path}/chunks")
    assert back.columns == chunks.columns
    assert sorted(map(repr, back.drop("chunk_seq").collect())) == sorted(map(repr, chunks.drop("chunk_seq").collect()))
    (tmp_path / "one.json").write_text('[{"file_path": "a.py", "qualname": "a.f", "kind": "function", "start_line": 1, "end_line": 2, "text": "x"}]')
    row = read_chunks(spark, f"file://{tmp_path}/one.json").first()
    assert row.chunk_id == "a.py::a.f" and row.docstring is None
