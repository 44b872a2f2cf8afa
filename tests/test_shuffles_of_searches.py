"""Sums for each query and document are made where the documents' postings lie."""

import re

from tessera.operators import lexical, repos


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_summed_without_a_shuffle_by_query_and_document(spark):
    docs = spark.createDataFrame([(i, f"the word w{i % 7} of getUser") for i in range(50)], "doc_seq long, text string")
    asked = spark.createDataFrame([(1, "the w3 user"), (2, None)], "query_id long, text string")
    found = lexical.search(lexical.build_index(docs, persist=False), asked, 5)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_seq#", plan(found))
    assert [r.doc_seq for r in found.orderBy("rank").collect()] == [3, 10, 17, 24, 31]


def test_scores_of_repositories_are_summed_without_a_shuffle_by_question_and_document(spark):
    docs = spark.createDataFrame([(f"r{i % 2}", i, f"the word w{i % 7}") for i in range(50)], "repo string, doc_seq long, text string")
    asked = spark.createDataFrame([("r1", 1, "the w3"), ("r0", 2, "w4")], "repo string, query_id long, text string")
    rows = repos.postings(docs)
    for found in (repos.search(rows, asked, 3), repos.covering(rows, asked, 1.0)):
        assert not re.search(r"hashpartitioning\(repo#\d+, query_id#\d+L?, doc_seq#", plan(found))
    best = repos.search(rows, asked, 3).orderBy("repo", "rank").collect()
    assert [(r.repo, r.doc_seq) for r in best] == [("r0", 4), ("r0", 18), ("r0", 32), ("r1", 3), ("r1", 17), ("r1", 31)]
