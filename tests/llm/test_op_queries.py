"""The registered queries: their columns, and their rows where SQL has them."""

import hashlib
import os

import pytest

import __spark_entry__ as entry
from tessera.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
COLUMNS = {
    1: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    2: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    3: ["page_id", "host", "path", "rule", "verdict"],
    4: ["doc_id", "start", "n_tokens", "ids_crc32"],
    5: ["doc_id", "held_out", "lang_pred", "score"],
    6: ["doc_id", "class_id", "n_links"],
    7: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    8: ["doc_id", "item_id"],
    9: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    10: ["doc_id", "size", "source_size", "target", "taken"],
    11: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    12: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}
TYPES = {"bigint": ("doc_id", "n_words", "n_removed", "start", "n_tokens", "ids_crc32", "n_chars", "size", "source_size", "taken", "first_word"), "double": ("score", "target", "near_edited"), "boolean": ("held_out",)}


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 13))
    assert set(registry.SQL) <= set(registry.QUERIES) and {*registry.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_columns(spark, name):
    df = registry.QUERIES[name](spark, DIR)
    want = COLUMNS[int(name[2:].split("_")[0])]
    assert df.columns[: len(want)] == want
    kinds = dict(df.dtypes)
    assert all(kinds[c] == kind for kind, names in TYPES.items() for c in names if c in kinds)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = c.sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_digest_of_edited_text(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    got = {r.doc_id: r for r in registry.QUERIES["op9_invertible_sketch"](spark, DIR).collect()}
    for k, r in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)].text, len(r.text)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((r.text[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()
