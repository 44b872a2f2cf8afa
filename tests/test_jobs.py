"""The jobs: growing input, second runs, repeated rows, settings."""

import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import evaluate_repos, index_documents
from jobs.queries import EVALUATE, INDEX
from tessera.operators import lexical, postings

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def add(spark, path, data):
    spark.createDataFrame(data, DOCS).coalesce(1).write.mode("append").parquet(str(path))


def rebuilt(spark, data):
    """term, doc_seq, tf, dl of an index made from scratch."""
    return rows(postings.counted(spark.createDataFrame(data, DOCS).select(F.col("doc_id").alias("doc_seq"), "text")))


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    source, place = tmp_path / "docs", [str(tmp_path / x) for x in ("index", "checkpoint")]
    first = [(k, f"word{k % 5} shared text {k}", "a") for k in range(40)] + [(40, None, "a"), (41, "", "b")]
    add(spark, source, first)
    caplog.set_level(logging.INFO, "jobs")
    run = lambda: index_documents.run(spark, str(source), *place, INDEX)
    assert rows(run()) == rebuilt(spark, first)
    assert sum("read 42 rows" in m for m in caplog.messages) == 1
    # New documents, a new version of an old one, rows twice, no id, and one id with two texts.
    second = [(100, "new words here", "a"), (3, "another text now", "a"), (101, "twice the same", "b"), (101, "twice the same", "b"), (None, "no id", "b"), (102, "b text", "c"), (102, "a text", "c")]
    add(spark, source, second)
    caplog.clear()
    kept = max(("b text", "a text"), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    want = [r for r in first if r[0] != 3] + [(100, "new words here", "a"), (3, "another text now", "a"), (101, "twice the same", "b"), (102, kept, "c")]
    got = rows(run())
    assert got == rebuilt(spark, want)
    assert any("read 7 rows, 1 of them without an id" in m for m in caplog.messages)
    caplog.clear()
    assert rows(run()) == got and not any("read" in m for m in caplog.messages)  # nothing new, same output
    index, docs = index_documents.index(spark, place[0], INDEX), spark.createDataFrame(want, DOCS).select(F.col("doc_id").alias("doc_seq"), "text")
    queries = spark.createDataFrame([(0, "shared word1"), (1, "twice new")], "query_id long, text string")
    assert rows(postings.search(index, queries, 4, digits=6)) == rows(lexical.search(lexical.build_index(docs), queries, 4, digits=6))


def test_a_batch_that_runs_again_leaves_the_same_files(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a b a", "x"), (2, "b", "x")], DOCS)
    for _ in range(2):
        index_documents._write(batch, 0, str(tmp_path), INDEX)
    assert rows(index_documents.current(spark, str(tmp_path))) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)]


def test_small_batches_give_the_same_index(spark, tmp_path):
    data = [(k, f"t{k} and t{k % 3}", "a") for k in range(12)]
    for k in range(0, 12, 3):
        add(spark, tmp_path / "docs", data[k : k + 3])
    got = index_documents.run(spark, str(tmp_path / "docs"), str(tmp_path / "i"), str(tmp_path / "c"), INDEX | {"files_per_batch": 1})
    assert rows(got) == rebuilt(spark, data)
    assert spark.read.parquet(str(tmp_path / "i/documents")).select("batch").distinct().count() == 4


@pytest.fixture
def tables(spark, tmp_path):
    add(spark, tmp_path / "documents", [(k, f"alpha beta w{k % 4} w{k}", f"src{k % 3}") for k in range(60)] + [(90, None, None), (91, "alpha", None)])
    spark.createDataFrame([(0, "alpha w0"), (1, "beta w1 w5"), (2, "absent"), (20, "w3 w3"), (5, "")], "item_id long, text string").write.parquet(str(tmp_path / "questions"))
    return str(tmp_path / "documents"), str(tmp_path / "questions"), str(tmp_path / "out")


def test_evaluation_reruns_with_the_same_result(spark, tables):
    settings = dict(spark.conf.getAll)
    first = rows(evaluate_repos.run(spark, *tables, EVALUATE))
    files = lambda: {n: rows(spark.read.parquet(f"{tables[2]}/{n}")) for n in ("hits", "scores", "report")}
    before = files()
    assert rows(evaluate_repos.run(spark, *tables, EVALUATE)) == first and files() == before
    assert {r[-1] for r in first} == {"src0", "src1", "src2", "src5"} and len(first) == 5
    by_id = {(r[4], r[0]): r[1:4] for r in first}
    assert by_id["src2", 2] == by_id["src5", 5] == (0.0, 0.0, 0.0) and by_id["src1", 1][2] == 1.0
    assert dict(spark.conf.getAll) == settings


def test_evaluation_replaces_only_the_repositories_of_its_input(spark, tables, tmp_path):
    rows(evaluate_repos.run(spark, *tables, EVALUATE))
    before = rows(spark.read.parquet(f"{tables[2]}/hits").where("repo <> 'src1'"))
    add(spark, tmp_path / "one", [(7, "beta w1 w5", "src1")])
    spark.createDataFrame([(1, "beta w1 w5")], "item_id long, text string").write.parquet(str(tmp_path / "q1"))
    evaluate_repos.run(spark, str(tmp_path / "one"), str(tmp_path / "q1"), tables[2], EVALUATE)
    hits = spark.read.parquet(f"{tables[2]}/hits")
    assert rows(hits.where("repo <> 'src1'")) == before and [(r.query_id, r.doc_seq) for r in hits.where("repo = 'src1'").collect()] == [(1, None)]


def test_settings_files_and_command_line(spark, tables):
    read = lambda name: json.load(open(f"{HERE}/jobs/{name}.json"))
    assert read("index_documents") == INDEX and read("evaluate_repos") == EVALUATE
    command = [sys.executable, "-m", "jobs.evaluate_repos", *tables, "--config", f"{HERE}/jobs/evaluate_repos.json"]
    done = subprocess.run(command, cwd=HERE, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 62 documents" in done.stderr and "scores: 5 rows" in done.stderr
