"""The pipeline against a brute-force version of its stages, and on odd tables."""

import random

import corpus_pipeline
from tessera.llm import edit_match

from test_free import WORDS, brute_groups, least_distance, shingles, talk, token_rows
from test_native import copies_taken

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _doc string"


def table(seed=1):
    r = random.Random(seed)
    items = [(k, talk(r, "en", 14) + f" item{k}") for k in range(3)]
    rows = []
    for i in range(80):
        lang = list(WORDS)[i % 3]
        rows.append((i, talk(r, lang, r.randint(1, 90)) + f" only{i}", lang, f"s{i % 4}" if i % 9 else None))
    rows += [(100 + k, rows[k * 7 + 40][1], rows[k * 7 + 40][2], "s1") for k in range(4)]  # copies
    rows += [(110 + k, rows[k + 60][1] + " more", rows[k + 60][2], "s2") for k in range(6)]  # near copies
    rows += [(120 + k, f"{talk(r, 'en', 20)} {items[k][1].upper()} {talk(r, 'en', 20)}", "en", "s3") for k in range(3)]  # leaks
    rows += [(130, None, "en", "s1"), (131, "", "en", "s1"), (132, "12 !!", "en", "s1"), (133, "the water", None, "s0"), (3, rows[3][1], rows[3][2], rows[3][3])]
    return rows, items


def brute(rows, items):
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = brute_groups([r[:2] for r in kept])
    one, seen = [], set()
    for r in kept:
        if groups[shingles(r[1])][2] == r[0] and r[0] not in seen:
            seen.add(r[0])
            one.append(r)
    norm = [edit_match.normalize(t) for _, t in items]
    clean = [r for r in one if all(least_distance(n, edit_match.normalize(r[1])) > int(len(n) * edit_match.ERROR_RATE) for n in norm)]
    mixed = []
    copies = copies_taken([(i, t, s) for i, t, _, s in clean])
    for i, t, _, _ in clean:
        mixed += [(i, t)] * copies[i]
    return clean, mixed


def write(spark, path, rows, items):
    spark.createDataFrame([(*r, 0, "x") for r in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = table()
    d = f"file://{tmp_path}"
    write(spark, d, rows, items)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    clean, mixed = brute(rows, items)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in clean)
    assert {100, 120, 130, 131, 132}.isdisjoint({r[0] for r in clean}) and 133 in {r[0] for r in clean}
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, n, c) for i, _, n, c in token_rows(mixed))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_pipeline_on_empty_and_wordless_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("blank", [(1, None, None, None), (2, "", "en", "s"), (None, " ", "en", None)])):
        d = f"file://{tmp_path}/{name}"
        write(spark, d, rows, [])
        assert corpus_pipeline.run(spark, d).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
