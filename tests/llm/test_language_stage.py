"""What the pipeline's language stage does with what its model says."""

import random

import corpus_pipeline

from test_free import talk


def test_language_stage_judges_labels_and_fills_missing_ones(spark):
    r = random.Random(9)
    rows = [(i, talk(r, lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, talk(r, "de", 40), "en"), (501, talk(r, "fr", 40), None), (502, "e", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang for x in corpus_pipeline.language(spark, docs, "").collect()}
    # A German text that is labelled as English goes, one without a label is told to be French.
    assert got == {i: "fr" if i == 501 else lang for i, _, lang in rows if i != 500}
