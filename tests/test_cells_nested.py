"""Vectors in cells against the exact search, and nested truncation against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, dense, nested

R = random.Random(5)
VECTORS = "doc_seq long, embedding array<float>, kind int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def some(spark, n=400, width=8):
    centers = [[R.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    data = [(k, [x + R.gauss(0, 0.3) for x in R.choice(centers)], k % 3) for k in range(n)]
    data += [(n, [0.0] * width, 0), (n + 1, None, 0), (n + 2, data[7][1], 1), (n + 3, data[7][1], 1)]
    return spark.createDataFrame(data, VECTORS)


def test_all_cells_give_the_exact_rows(spark, tmp_path, monkeypatch):
    vectors = some(spark)
    queries = vectors.where("doc_seq % 20 = 0").select(F.col("doc_seq").alias("query_id"), "embedding").where("query_id < 400")
    index = cells.store(vectors, str(tmp_path / "i"), cells=7)
    assert index.vectors.select("cell").distinct().count() > 3
    for kind in (None, 1):
        assert rows(cells.search(index, queries, 6, probes=7, kind=kind, digits=6)) == rows(dense.search(vectors, queries, 6, kind=kind, digits=6))
    monkeypatch.setattr(cells, "BLOCK", 3)  # several blocks of queries
    assert rows(cells.search(index, queries, 6, probes=7, digits=6)) == rows(dense.search(vectors, queries, 6, digits=6))


def test_probing_reads_few_cells_and_finds_most(spark, tmp_path):
    vectors = some(spark)
    queries = vectors.where("doc_seq < 40").select(F.col("doc_seq").alias("query_id"), "embedding")
    index = cells.store(vectors, str(tmp_path / "i"), cells=12)
    exact = dense.search(vectors, queries, 10)
    assert cells.recall(exact, cells.search(index, queries, 10, probes=4)).first().recall >= 0.9
    one = cells.search(index, queries.where("query_id = 3"), 10, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_the_given_vectors(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_seq"), "embedding", F.col("label").alias("kind"))
    queries = vectors.where("doc_seq % 100 = 0").select(F.col("doc_seq").alias("query_id"), "embedding")
    found = cells.search(cells.store(vectors, str(tmp_path / "i")), queries, 10)
    share = cells.recall(dense.search(vectors, queries, 10), found).first().recall
    print(f"recall of {cells.PROBES} of {cells.CELLS} cells: {share:.3f}")
    assert share >= 0.9


def test_an_empty_table_of_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    index = cells.CellIndex(cells.assign(empty, cells.train(empty)), cells.train(empty))
    assert cells.search(index, spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<float>"), 3).collect() == []


def shortened(value, limit):
    """The same in plain Python."""
    if isinstance(value, list):
        return [shortened(v, limit) for v in value]
    if isinstance(value, dict):
        return {k: v[:limit] + "... [truncated]" if k == "text" and isinstance(v, str) and len(v) > limit else shortened(v, limit) for k, v in value.items()}
    return value


def random_json(depth):
    kind = R.randint(0, 5 if depth else 3)
    if kind <= 1:
        return "".join(R.choices('ab"\\ \n\té𝄞{}[]:,/', k=R.choice([0, 3, 9, 10, 11, 30])))
    if kind == 2:
        return R.choice([1, -2.5, True, None, 12345678901])
    if kind == 3:
        return '"text": "' + "x" * 20
    if kind == 4:
        return [random_json(depth - 1) for _ in range(R.randint(0, 3))]
    return {R.choice(["text", "texts", "a", 'te"xt', "text\\"]): random_json(depth - 1) for _ in range(R.randint(0, 4))}


def test_nested_texts_are_cut_wherever_they_stand(spark):
    values = [random_json(4) for _ in range(2000)] + [[random_json(3), {"text": random_json(2)}] for _ in range(400)] + [{"text": "y" * 50}, [{"text": {"text": "z" * 11}}], "text", ["text", "t" * 40], {"x": "text"}]
    answers = [json.dumps(v, ensure_ascii=R.random() < 0.5, indent=R.choice([None, 1])) for v in values]
    odd = [None, "", "no json", '{"text": "' + "u" * 40, '{"text": "a" "b"}' + " " * 20]
    df = spark.createDataFrame(list(enumerate(answers + odd)), "id int, answer string")
    got = [r.c for r in df.select("id", nested.truncate_answer(F.col("answer"), 10).alias("c")).orderBy("id").collect()]
    assert [json.loads(g) for g in got[: len(values)]] == [shortened(v, 10) for v in values]
    assert got[len(values) :] == odd
    assert sum(g != a for g, a in zip(got, answers + odd, strict=True)) > 40
