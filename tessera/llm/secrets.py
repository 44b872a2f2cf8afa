"""Secret scans: candidate spans and the corpus-wide frequency of their owners.

A scan of every whole text finds candidates: three base kinds and long mixed tokens.
Each candidate value is hashed, and for each hash the distinct repositories and owners
in the whole corpus are counted. A value that many owners have is a copied example; a
value of one owner that also looks live (letters and digits, enough different
characters) is added to the result as a span of kind ``owned``.

Only built-in expressions. The text is read once and never shuffled: the scan leaves a
small table of hits (gaps and lengths), written to the shared folder. Positions are
running sums over the hits of one row.

Defined results: a null text is empty; repeated rows are scanned each for itself, with
one owner counted once; a null owner or repository is an owner or repository of its own;
an empty table gives an empty table. Spans count code points, their end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, table

# The base patterns and the least length that each asks for.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "owned")

#: A run of hex digits or of key characters is matched whole, so asking for the least
#: length inside the pattern finds the same spans as dropping short ones afterwards.
#: For ``assign`` that is not so: a match that fails still uses up its characters.
SCANNED = {
    "assign": (ASSIGN, 1),
    "access": (r"AKIA[A-Z0-9]{14,}", 0),
    "hex": (r"[0-9a-f]{16,}", 0),
    "mixed": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0),
}
#: A value that looks live has so many characters and so many different ones.
LIVE_LENGTH, LIVE_VARIETY = 16, 8


def _hits(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, length, value_length, value>> of one kind, in text order.
    gap: code points between the match before (or the start) and this one."""
    pattern, group = SCANNED[kind]
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    pieces = F.split(text, pattern, -1)

    def hit(match: Column, gap: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("length"), F.length(value).alias("value_length"), value.alias("value"))

    zipped = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), hit)
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<kind:string,gap:int,length:int,value_length:int,value:string>>"))


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row for each document: row id, doc_id, repository, owner and all hits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64(repo.isNull(), repo).alias("repo"),
        F.xxhash64(owner.isNull(), owner).alias("owner"),
        F.concat(*[_hits(text, k) for k in SCANNED]).alias("hits"),
    )


def located(scanned: DataFrame) -> DataFrame:
    """One row for each hit with its span; ``base`` says whether it is one of the base
    kinds and long enough, start and end bound the match, value_start and value the value."""
    h = scanned.select("row", "repo", "owner", F.posexplode("hits").alias("n", "h")).select("row", "repo", "owner", "n", "h.*")
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.lit(None).cast("int")
    for kind, n in LEAST.items():
        least = F.when(F.col("kind") == kind, n).otherwise(least)
    return (
        h.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before))
        .withColumn("start", F.col("end") - F.col("length"))
        .withColumn("value_start", F.col("end") - F.col("value_length"))
        .withColumn("base", F.coalesce(F.col("value_length") >= least, F.lit(False)))
        .withColumn("digest", F.sha2("value", 256))
        .withColumn(
            "live",
            (F.col("value_length") >= LIVE_LENGTH) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_VARIETY),
        )
        .drop("value", "n", "gap")
    )


def ownership(hits: DataFrame) -> DataFrame:
    """For each live-looking candidate digest the distinct repositories and owners of the
    whole corpus. Distinct triples are formed first, on the map side too, so a value that
    is copied a million times arrives once for each repository."""
    return hits.where("live").select("digest", "repo", "owner").distinct().groupBy("digest").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, repo: Column, owner: Column, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """One row for each document: doc_id, the base spans and all spans, as arrays of
    struct<start, kind (1-based in KINDS), end>, ordered so.

    A live-looking value is ``owned`` if at most ``max_owners`` owners and ``max_repos``
    repositories have it.
    """
    scanned = materialize(scan(docs, repo, owner), "secret-hits")
    hits = located(scanned)
    wide = ownership(hits)
    owned = wide.where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("digest", F.lit(True).alias("owned"))
    marked = hits.join(owned, "digest", "left")
    number = F.lit(0)
    for i, kind in enumerate(KINDS, 1):
        number = F.when(F.col("kind") == kind, i).otherwise(number)
    base = F.when(F.col("base"), F.struct(F.col("start").alias("start"), number.alias("kind"), F.col("end").alias("end")))
    added = F.when(F.col("live") & F.col("owned"), F.struct(F.col("value_start").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("end").alias("end")))
    spans = marked.groupBy("row").agg(F.array_sort(F.collect_list(base)).alias("base_spans"), F.array_sort(F.array_union(F.collect_list(base), F.collect_set(added))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("spans", none).alias("spans"))


def op2(spark, sf_dir: str) -> DataFrame:
    """A document's source is its owner; the owner's documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))), F.col("source"))
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(source, '?') || '/' || coalesce(lang, '?') AS repo, coalesce(source, chr(1)) AS owner
  FROM documents),
p(kind, k, pattern, least) AS (VALUES
  ('assign', 1, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 12),
  ('access', 2, 'AKIA[A-Z0-9]+', 18),
  ('hex', 3, '[0-9a-f]+', 16),
  ('mixed', 0, '[A-Za-z0-9+/_-]{20,}={0,2}', 20)),
m AS (
  SELECT r, doc_id, repo, owner, kind, k, least, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS pieces
  FROM d, p),
u AS (
  SELECT r, doc_id, repo, owner, kind, k, least, unnest(found) AS f, unnest(pieces[1:len(found)]) AS gap, unnest(range(len(found))) AS n
  FROM m WHERE len(found) > 0),
v AS (
  SELECT *, sum(length(gap) + length(f)) OVER (PARTITION BY r, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS fin,
         CASE WHEN kind = 'assign' THEN regexp_extract(f, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE f END AS value
  FROM u),
w AS (
  SELECT *, k > 0 AND length(value) >= least AS base,
         length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS live
  FROM v WHERE kind <> 'hex' OR length(f) >= 16),
o AS (
  SELECT value FROM w WHERE live AND (kind <> 'access' OR base) GROUP BY value HAVING count(DISTINCT owner) <= 1 AND count(DISTINCT repo) <= 3),
s AS (
  SELECT r, k, kind, fin - length(f) AS b, fin AS e, true AS base FROM w WHERE base
  UNION ALL
  SELECT DISTINCT r, 4, 'owned', fin - length(value), fin, false FROM w WHERE live AND (kind <> 'access' OR base) AND value IN (SELECT value FROM o)),
g AS (
  SELECT r, count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS h,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e) FILTER (base) AS t,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e) AS every
  FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(t, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
