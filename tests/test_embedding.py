"""Vectors of texts: the hashing model, its batches, and search over them."""

import hashlib
import re

import numpy as np

from tessera.functions import embedding
from tessera.plans import workspace
from tessera.sources.pysource import files_of_table

TEXTS = ["retry logic for sockets", None, "", "Retry RETRY été 日本", "parse the text of a file", "x" * 5000]


def by_hand(text):
    out = [0.0] * embedding.WIDTH
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        d = hashlib.md5(w.encode()).digest()
        out[int.from_bytes(d[:4], "big") % embedding.WIDTH] += 1.0 if d[4] % 2 else -1.0
    return out


def test_vectors_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 5)), "id long, text string").repartition(3)
    for batch in (1, 7, 64):
        got = {r.id: list(r.embedding) for r in embedding.embed(df, batch=batch).collect()}
        assert got == {k: by_hand(t) for k, t in enumerate(TEXTS * 5)}
    assert embedding.embed(df.limit(0)).collect() == []


def test_a_model_is_loaded_once_for_many_batches(spark, tmp_path):
    folder = str(tmp_path)

    def model():
        open(f"{folder}/{len(__import__('os').listdir(folder))}-{__import__('os').getpid()}", "w").close()
        return lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)

    df = spark.createDataFrame(list(enumerate(TEXTS * 20)), "id long, text string").coalesce(1)
    got = {r.id: r.embedding[0] for r in embedding.embed(df, model, batch=2).collect()}
    assert got == {k: len(t or "") for k, t in enumerate(TEXTS * 20)}
    assert len(list(tmp_path.iterdir())) <= 2  # 60 batches


def test_hybrid_search_of_a_workspace_with_made_vectors(spark, tmp_path):
    files = [(f"x{k}.py", f"def other{k}():\n    'unrelated words {k}'\n") for k in range(4)] + [("a.py", "def retry():\n    'retry logic for sockets'\n"), ("b.py", "def parse():\n    'parse the text of a file'\n")]
    ws = workspace.build(files_of_table(spark.createDataFrame(files, "rel_path string, content string")), str(tmp_path / "i"), embed=embedding.embed)
    asked = spark.createDataFrame([(0, "retry logic")], "query_id long, text string")
    best = ws.search(asked, embed=embedding.embed).orderBy("rank").first()
    assert best.qualname == "a.retry" and best.dense_rank is not None and best.bm25_rank is not None
