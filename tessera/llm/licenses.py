"""Licence scans by a positional index of rare words.

Templates are licence notices, from one line to whole texts. Their words, without common
English function words, are the licence vocabulary. Over all documents the vocabulary's
document frequencies give each word's IDF. For each template whose mandatory phrases stand
in a file, the file's licence words are looked up in the template's postings; a hit votes
for the place (file position - template position), and so does a mandatory phrase. Places
of one-line notices are exact; those of longer ones are bands of a tenth of their length,
each half over the next, so that words which an edit put in or took out do not part the
votes. A place is a candidate if one of the template's highest-IDF words hits it, and
gives a label if enough of the template's words do and all its mandatory phrases stand
there. As many words count as highest-IDF as no place with enough votes can do without, so
candidates lose nothing, and what else stands in a file takes no label away. The other words
are looked up only in files that have a candidate, and vote only for candidates.

Only built-in expressions. The text is read once; what leaves the scan is one small row
for each document, in the shared folder; only documents with a mandatory phrase give
positions. Only the templates' postings (bounded by the templates) are broadcast.

Defined results: a null text has no words; a text without licence words has no label but
base ones; ties in IDF go by word; repeated rows are each judged for themselves and each
count in the frequencies; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, table
from tessera.llm.licence_texts import NOTICES

#: What separates words: ASCII but for digits and letters (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Function words carry no position votes.
FUNCTION_WORDS = frozenset("a all and any are as at be by for from in into is it of on or that the this to was with without use will work under".split())
#: Share of a template's words that have to agree on a place.
SHARE = 0.6
#: Words up to which a notice's places are exact.
EXACT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(GAP, text.lower()) if w)


#: Label, words, mandatory phrases.
TEMPLATES = tuple((label, _normal(text), phrases) for label, text, phrases in NOTICES)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, words, _ in templates for w in words} - FUNCTION_WORDS)


def key_phrases(templates=TEMPLATES) -> list[str]:
    return sorted({p for _, _, keys in templates for p in keys})


def _width(words: Sequence[str]) -> int:
    """Positions of one band of places: even, or 1 for exact places."""
    return 1 if len(words) <= EXACT else 2 * (len(words) // 10)


def _spots(words: Sequence[str], phrase: str) -> list[int]:
    parts = tuple(phrase.split())
    return [i for i in range(len(words)) if tuple(words[i : i + len(parts)]) == parts]


def _postings_of(templates) -> list[tuple[int, str, int, int, int, int]]:
    """t, word, spot, of (the template's voting words), width, sought: how many of its
    highest-IDF words have to be looked up so that no place with enough votes is missed."""
    rows = []
    for t, (_, words, _) in enumerate(templates):
        votes = [(w, i) for i, w in enumerate(words) if w not in FUNCTION_WORDS]
        of = len(votes)
        least = next(v for v in range(1, of + 1) if v / of >= SHARE)
        rows += [(t, w, i, of, _width(words), of - least + 1) for w, i in votes]
    return rows


def _needs_of(templates) -> list[tuple[int, int, int, int]]:
    """t, phrase, spot, width for each place of a mandatory phrase in a template."""
    phrases = key_phrases(templates)
    return [(t, phrases.index(p), i, _width(words)) for t, (_, words, keys) in enumerate(templates) for p in keys for i in _spots(words, p)]


def _stands(words: str) -> str:
    """A pattern for a phrase's words standing consecutively in lower-cased text."""
    return r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])" + GAP.join(re.escape(w) for w in words.split()) + r"(?:$|[\x00-\x2F\x3A-\x60\x7B-\x7F])"


def _lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else. Where a text is ASCII that is the plain function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _places(low: Column, words: Column, phrase: str, may: Column | None = None) -> Column:
    """Starts of a phrase in the array of words. Few texts have its longest word at all, and
    looking for that is far cheaper than the pattern; ``may`` tells where it can stand."""
    parts = phrase.split()
    n = F.size(words) - len(parts)

    def begins(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & (F.get(words, i + k) == part)
        return test

    has = low.contains(max(parts, key=len)) & low.rlike(_stands(phrase))
    return F.when(has if may is None else may & has, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), begins)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row for each document: row, doc_id, n_words, the starts of each base phrase, its
    distinct licence words (terms), the starts of each mandatory phrase (keys), and where
    there are some, its licence words with positions."""
    low = _lower(F.coalesce(F.col("text"), F.lit("")))
    split = docs.select("doc_id", low.alias("low"), F.split(low, GAP, -1).alias("raw"))
    first = F.when(F.element_at("raw", 1) == "", 1).otherwise(0)
    last = F.when((F.size("raw") > 1) & (F.element_at("raw", -1) == ""), 1).otherwise(0)
    words = split.select("doc_id", "low", F.slice("raw", first + 1, F.size("raw") - first - last).alias("words"))
    # Phrases' longest words are looked up too, whether they vote or not.
    asked = sorted({*vocabulary(templates), *(max(p.split(), key=len) for p in key_phrases(templates))})
    termed = words.select("doc_id", "low", "words", F.array_intersect("words", F.split(F.lit(" ".join(asked)), " ")).alias("terms"))
    keys = F.array(*[_places(F.col("low"), F.col("words"), p, F.array_contains("terms", max(p.split(), key=len))) for p in key_phrases(templates)])
    found = termed.select(
        "doc_id",
        "words",
        "terms",
        F.array(*[_places(F.col("low"), F.col("words"), p) for p, _ in base]).alias("base"),
        F.when(F.size("terms") > 0, keys).otherwise(F.array().cast("array<array<int>>")).alias("keys"),
    )
    licence = F.when(
        F.exists("keys", lambda k: F.size(k) > 0),
        F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("terms", x["word"])),
    ).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "base", "terms", "keys", licence.alias("licence"))


def idf(scanned: DataFrame) -> DataFrame:
    """word, idf over all documents of the scan; a row for each licence word they have."""
    rows = scanned.agg(F.count(F.lit(1)).alias("n"))
    df = scanned.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(rows)).select("word", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def _table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Fixed rows as a table: one literal, however many rows there are."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _postings(scanned: DataFrame, templates) -> DataFrame:
    """t, word, spot, of, width, seeks: is the word one of the template's highest-IDF words?
    A word that no document has comes first, as the rarest."""
    entries = _table(scanned.sparkSession, _postings_of(templates), "t int, word string, spot int, of int, width int, sought int")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.col("idf").desc_nulls_first(), "word", "spot"))
    return entries.join(F.broadcast(idf(scanned)), "word", "left").select("t", "word", "spot", "of", "width", (rank <= F.col("sought")).alias("seeks"))


def _bands(offset: Column, width: Column) -> Column:
    """The places that an offset votes for: (half, band)."""
    whole = F.struct(F.lit(0).alias("half"), F.floor(offset / width).alias("band"))
    half = F.struct(F.lit(1).alias("half"), F.floor((offset + width / 2) / width).alias("band"))
    return F.when(width == 1, F.array(whole)).otherwise(F.array(whole, half))


def _of(values: Sequence) -> Column:
    """The value of a row's template."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("t") + 1).cast("int"))


def _words_held(scanned: DataFrame, templates) -> tuple[DataFrame, DataFrame]:
    """Of the files that have all mandatory phrases of a template, wherever: row, t, word, at
    of their licence words, and row, t, place, phrases: how many of the phrases vote for a place."""
    spark, phrases = scanned.sparkSession, key_phrases(templates)
    stand = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(phrases.index(p)) for p in keys]).alias("needed")) for t, (_, _, keys) in enumerate(templates)])
    held = F.transform(F.filter(stand, lambda x: F.forall(x["needed"], lambda k: F.size(F.get(F.col("keys"), k)) > 0)), lambda x: x["t"])
    holding = scanned.where(F.size("licence") > 0).select("row", "licence", "keys", held.alias("held")).where(F.size("held") > 0)
    words = holding.select("row", "licence", F.explode("held").alias("t")).select("row", "t", F.explode("licence").alias("x")).select("row", "t", "x.word", "x.at")
    needed = _table(spark, _needs_of(templates), "t int, phrase int, spot int, width int")
    stands = holding.select("row", "held", F.posexplode("keys").alias("phrase", "places")).where(F.size("places") > 0).select("row", "held", "phrase", F.explode("places").alias("at"))
    voted = stands.join(F.broadcast(needed), "phrase").where(F.array_contains("held", F.col("t"))).select("row", "t", "phrase", F.explode(_bands(F.col("at") - F.col("spot"), F.col("width"))).alias("place"))
    return words, voted.groupBy("row", "t", "place").agg(F.size(F.collect_set("phrase")).alias("phrases"))


def _hits(words: DataFrame, postings: DataFrame) -> DataFrame:
    """row, t, place, spot, of: each licence word's votes by the given postings."""
    found = words.join(F.broadcast(postings), ["t", "word"])
    return found.select("row", "t", "spot", "of", F.explode(_bands(F.col("at") - F.col("spot"), F.col("width"))).alias("place"))


def candidate_places(words: DataFrame, phrases: DataFrame, postings: DataFrame, templates=TEMPLATES) -> DataFrame:
    """row, t, place of every place that can give a label: one of the template's highest-IDF
    words hits it, looked up in the postings of those words alone, and so do all its
    mandatory phrases."""
    rare = _hits(words, postings.where("seeks")).select("row", "t", "place").distinct()
    return rare.join(phrases.where(F.col("phrases") == _of([len(keys) for _, _, keys in templates])), ["row", "t", "place"]).select("row", "t", "place")


def find_licences(scanned: DataFrame, templates=TEMPLATES, postings: DataFrame | None = None) -> DataFrame:
    """row, label, score for each document and label of a template that has a place: all its
    mandatory phrases stand there, one of its highest-IDF words does, and at least ``SHARE``
    of its voting words do; score is that share. First the rare words and the phrases give the
    candidate places; then the other words of the files and templates that have one vote, and
    only for those places."""
    postings = _postings(scanned, templates) if postings is None else postings
    words, phrases = _words_held(scanned, templates)
    candidates = candidate_places(words, phrases, postings, templates)
    again = words.join(candidates.select("row", "t").distinct(), ["row", "t"], "left_semi")
    votes = _hits(again, postings).join(candidates, ["row", "t", "place"], "left_semi").groupBy("row", "t", "place").agg(F.size(F.collect_set("spot")).alias("votes"), F.max("of").alias("of"))
    return (
        votes.withColumn("score", F.col("votes") / F.col("of"))
        .where(F.col("score") >= SHARE)
        .groupBy("row", _of([label for label, _, _ in templates]).alias("label"))
        .agg(F.max("score").alias("score"))
    )


def scan_licences(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row for each document: doc_id, n_words, places (array<struct<start, label>> of
    the base phrases), found (array<struct<label, score>> of the index)."""
    scanned = materialize(scan(docs, templates, base), "licence-scan")
    found = find_licences(scanned, templates).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("found"))

    def labelled(i: int, label: str) -> Column:
        return F.transform(F.get("base", F.lit(i)), lambda x: F.struct(x.alias("start"), F.lit(label).alias("label")))

    places = F.flatten(F.array(*[labelled(i, label) for i, (_, label) in enumerate(base)]))
    return (
        scanned.select("row", "doc_id", "n_words", places.alias("places"))
        .join(found, "row", "left")
        .select("doc_id", "n_words", "places", F.coalesce("found", F.array().cast("array<struct<label:string,score:double>>")).alias("found"))
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Score: 1 if a base phrase stands, else the best share of votes, else 0."""
    done = scan_licences(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.transform("found", lambda x: x["label"])))
    return done.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEP}'), lambda x: x <> '') AS words
  FROM documents),
w AS MATERIALIZED (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
phrase(p, label, n, k, part) AS (VALUES {_sql_values([(i, label, len(p.split()), k, w) for i, (p, label) in enumerate(BASE) for k, w in enumerate(p.split())])}),
base AS (
  SELECT r, i - k AS s, p, label FROM w JOIN phrase ON word = part GROUP BY r, i - k, p, label, n HAVING count(*) = n),
keyed(p, n, k, part) AS (VALUES {_sql_values([(i, len(p.split()), k, w) for i, p in enumerate(key_phrases()) for k, w in enumerate(p.split())])}),
stands AS MATERIALIZED (
  SELECT r, p, s FROM (SELECT r, i - k AS s, p FROM w JOIN keyed ON word = part GROUP BY r, i - k, p, n HAVING count(*) = n)),
posting(t, word, spot, "of", width) AS (VALUES {_sql_values([r[:5] for r in _postings_of(TEMPLATES)])}),
needs(t, p, spot, width) AS (VALUES {_sql_values(_needs_of(TEMPLATES))}),
named(t, label, n) AS (VALUES {_sql_values([(t, label, len(keys)) for t, (label, _, keys) in enumerate(TEMPLATES)])}),
held AS MATERIALIZED (
  SELECT r, t FROM (SELECT DISTINCT r, p FROM stands) JOIN (SELECT DISTINCT t, p FROM needs) USING (p) JOIN named USING (t) GROUP BY r, t, n HAVING count(*) = n),
hits AS (
  SELECT r, t, i - spot AS place, width, spot, NULL AS p FROM w JOIN posting USING (word) JOIN held USING (r, t)
  UNION ALL SELECT r, t, s - spot, width, NULL, p FROM stands JOIN needs USING (p) JOIN held USING (r, t)),
votes AS (
  SELECT r, t, half, floor((place + half * width / 2) / width::DOUBLE) AS band, count(DISTINCT spot) AS votes, count(DISTINCT p) AS phrases
  FROM hits, (VALUES (0), (1)) h(half) WHERE half = 0 OR width > 1 GROUP BY r, t, half, band),
scored AS (
  SELECT r, label, votes / (SELECT any_value(q."of") FROM posting q WHERE q.t = votes.t)::DOUBLE AS score FROM votes JOIN named USING (t) WHERE phrases = n),
found AS (
  SELECT r, label, max(score) AS score FROM scored WHERE score >= {SHARE}::DOUBLE GROUP BY r, label),
b AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
e AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r),
f AS (SELECT r, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN e USING (r) LEFT JOIN f USING (r)
"""
