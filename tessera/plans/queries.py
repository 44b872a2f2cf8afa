"""The engine's operators as queries over the driver's tables, each with its SQL.

The tables have no Python code, so each document gives a small Python file to be analyzed;
graph operators run over a multigraph derived from ``lineitem`` (parts call parts), path
predicates over paths derived from ``documents``, and citations over locations derived from
``conversations``. Every query reads its whole
tables. Scores are rounded to 6 places before they are ranked, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embedding, text as T
from tessera.operators import cells, dense, graph, hybrid, impact, lexical, metrics, nested, postings, repos, structure, tools
from tessera.session import new_folder, read_table
from tessera.sources.pysource import files_of_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- lexical ---------------------------------------------------------------------------

WORDS = "the und licensed version que"


def tokens_sql(column: str) -> str:
    words = f"list_filter(regexp_split_to_array(coalesce({column}, ''), '[^a-zA-Z0-9]+'), lambda w: w <> '')"
    parts = r"string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')"
    return f"flatten(list_transform({words}, lambda w: list_prepend(lower(w), list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: p <> lower(w)))))"


_BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id, {tokens_sql("text")} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY term, doc_id),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT 0.25::DOUBLE * avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

_SCORED = """
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY query_id, term),
scored AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM corpus))))), 6) AS score
  FROM post JOIN terms USING (term) JOIN qt USING (term) GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("doc_seq"), "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("doc_seq").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH tok AS (SELECT unnest({tokens_sql('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM tok GROUP BY term")
def tokenize_freq(spark: SparkSession, d: str) -> DataFrame:
    docs = lexical.spread(_documents(spark, d))
    return docs.select(F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build_index(_documents(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25}, q AS (SELECT 0 AS query_id, {tokens_sql(chr(39) + WORDS + chr(39))} AS t), {_SCORED} SELECT doc_id, score, rank FROM ranked WHERE rank <= 30")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([(0, WORDS)], "query_id long, text string")
    return _hits(lexical.search(lexical.build_index(_documents(spark, d)), words, 30, digits=6)).drop("query_id")


@query(f"WITH {_BM25}, q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS t FROM benchmark), {_SCORED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(lexical.search(lexical.build_index(_documents(spark, d)), _items(spark, d), 10, digits=6))


@query(f"WITH {_BM25}, q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS t FROM benchmark), {_SCORED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def pruned_topk(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``bm25_batch_topk`` from a stored index, unpacked as far as needed."""
    index = postings.store(lexical.spread(_documents(spark, d)), new_folder(spark, "index"))
    return _hits(postings.search(index, _items(spark, d), 10, digits=6))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def updated_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of yesterday's documents brought up to date: half of them had another text, a
    tenth was not there, and some are gone since. Equal to the index of today's documents."""
    today = lexical.spread(_documents(spark, d))
    other = today.where("doc_seq % 10 <> 3").withColumn("text", F.when(F.col("doc_seq") % 2 == 0, F.reverse("text")).otherwise(F.col("text")))
    gone = today.where("doc_seq % 7 = 0").select((-1 - F.col("doc_seq")).alias("doc_seq"), "text")
    before = other.unionByName(gone)
    index = postings.store(before, new_folder(spark, "index"))
    known = before.select("doc_seq", postings.digest(F.col("text")).alias("digest"))
    found = postings.changes(known, today)
    upserts = today.join(found.where("change <> 'gone'").select("doc_seq"), "doc_seq", "left_semi")
    return postings.merged(index, upserts, found.where("change = 'gone'").select("doc_seq")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


# --- dense and hybrid ------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_seq"), "embedding", F.col("label").alias("kind"))


def _dense_sql(queries: str, k: int, kind: str = "") -> str:
    return f"""
dq AS ({queries}),
dense AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, dq {kind})
  QUALIFY rank <= {k})"""


_HUNDREDTH = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0"
_OF_ITEMS = "SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id"


def _vector_queries(vectors: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 100, searched in all vectors."""
    return vectors.where("doc_seq % 100 = 0").select(F.col("doc_seq").alias("query_id"), "embedding")


@query(f"WITH {_dense_sql(_HUNDREDTH, 10)} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return _hits(dense.search(vectors, _vector_queries(vectors), 10, digits=6))


@query(f"WITH {_dense_sql(_HUNDREDTH, 10, 'WHERE label = 3')} SELECT query_id, doc_id, score, rank FROM dense")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return _hits(dense.search(vectors, _vector_queries(vectors), 10, kind=3, digits=6))


@query(f"WITH {_dense_sql(_HUNDREDTH, 10)} SELECT query_id, doc_id, score, rank FROM dense")
def cell_topk(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``dense_topk`` from a table in cells, with all cells probed."""
    vectors = _vectors(spark, d)
    index = cells.store(vectors, new_folder(spark, "cells"))
    return _hits(cells.search(index, _vector_queries(vectors), 10, probes=cells.CELLS, digits=6))


def _hashed_sql(name: str, table: str, key: str) -> str:
    """Coordinates of the hashing model's vectors: key, c, v."""
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS c, sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM {table}) GROUP BY ALL)"""


@query(
    f"""WITH {_hashed_sql('dv', 'documents', 'doc_id')}, {_hashed_sql('qv', 'benchmark', 'item_id')},
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM dv GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(dv.v * qv.v) AS dot FROM dv JOIN qv USING (c) GROUP BY item_id, doc_id),
every AS (SELECT item_id, doc_id, round(coalesce(dot / nullif(dn.n * qn.n, 0), 0), 6) AS score FROM benchmark CROSS JOIN documents LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN dn USING (doc_id) LEFT JOIN qn USING (item_id))
SELECT item_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM every QUALIFY rank <= 10"""
)
def embedded_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents by vectors made of the texts themselves, in batches, by the hashing model."""
    vectors = embedding.embed(lexical.spread(_documents(spark, d)).withColumnRenamed("doc_seq", "id")).withColumnRenamed("id", "doc_seq")
    asked = embedding.embed(_items(spark, d).withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
    return _hits(dense.search(vectors, asked, 10, digits=6))


_FUSED = f"""
{_BM25}, q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS t FROM benchmark), {_SCORED}, {_dense_sql(_OF_ITEMS, 30)},
lists AS (SELECT query_id, 0 AS l, doc_id, rank FROM dense UNION ALL SELECT query_id, 1, doc_id, rank FROM ranked WHERE rank <= 30),
fused AS (
  SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused_score, max(CASE WHEN l = 0 THEN rank END) AS dense_rank, max(CASE WHEN l = 1 THEN rank END) AS bm25_rank
  FROM lists GROUP BY query_id, doc_id),
top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, dense_rank NULLS LAST, bm25_rank) AS rank FROM fused QUALIFY rank <= 30)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    vectors, items = _vectors(spark, d), _items(spark, d)
    near = dense.search(vectors, items.join(vectors, F.col("query_id") == F.col("doc_seq")).select("query_id", "embedding"), 30, digits=6)
    found = lexical.search(lexical.build_index(_documents(spark, d)), items, 30, digits=6)
    return hybrid.fuse(hybrid.ranked_lists(near, found))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, fused_score, dense_rank, bm25_rank, rank FROM top")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return _fused(spark, d).select("query_id", F.col("id").alias("doc_id"), F.round("fused_score", 12).alias("fused_score"), long("dense_rank"), long("bm25_rank"), long("rank"))


@query(
    f"""WITH {_FUSED},
scores AS (
  SELECT top.*, d.source, len(list_intersect(list_distinct(q.t), tok.t)) / len(list_distinct(q.t))::DOUBLE AS overlap
  FROM top JOIN tok USING (doc_id) JOIN documents d USING (doc_id) JOIN q USING (query_id)),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS place FROM scores)
SELECT query_id, place AS rank, doc_id, source, dense_rank, bm25_rank, fused_score, round(overlap, 6) AS rerank_score FROM final WHERE place <= 8"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    best = hybrid.rerank(_fused(spark, d), _items(spark, d), chunks)
    long = lambda c: F.col(c).cast("long").alias(c)
    return best.select("query_id", long("rank"), F.col("id").alias("doc_id"), "source", long("dense_rank"), long("bm25_rank"), F.round("fused_score", 12).alias("fused_score"), F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(text, doc_id) AS text FROM documents GROUP BY source")
def def_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tools.last_wins(read_table(spark, d, "documents"), "source", "doc_id").select("source", F.col("first_seq").alias("_"), "lang", "text", "doc_id").drop("_")


# --- graph -----------------------------------------------------------------------------

_EDGES = """
n AS (SELECT count(*) AS n FROM part),
edges AS MATERIALIZED (
  SELECT l_orderkey * 8 + l_linenumber AS edge_seq, 'p' || l_partkey AS src, 'p' || ((l_partkey * 7 + l_suppkey) % n) AS dst, l_linenumber AS lineno, l_returnflag <> 'R' AS resolved
  FROM lineitem, n)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "part").count()
    return lexical.spread(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_seq"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"),
        F.concat(F.lit("p"), (F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("dst"),
        F.lit("call").alias("type"),
        F.col("l_linenumber").alias("lineno"),
        (F.col("l_returnflag") != "R").alias("resolved"),
    )


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A node for each part: its brand is its module."""
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    return read_table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("qualname"), kind.alias("kind"), F.col("p_brand").alias("module"), F.lit(None).cast("string").alias("class_name"))


def _every_part(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("target"))


_TARGETS = "t AS (SELECT 'p' || p_partkey AS target FROM part)"


@query(f"WITH {_EDGES}, {_TARGETS} SELECT target, src AS caller, lineno, edge_seq FROM edges JOIN t ON dst = target WHERE resolved")
def caller_sites(spark: SparkSession, d: str) -> DataFrame:
    return graph.caller_sites(_edges(spark, d), _every_part(spark, d))


@query(f"WITH {_EDGES}, {_TARGETS} SELECT target, string_agg(DISTINCT src, ',' ORDER BY src) AS callers FROM edges JOIN t ON dst = target WHERE resolved GROUP BY target")
def direct_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_callers(_edges(spark, d), _every_part(spark, d)).select("target", F.array_join("callers", ",").alias("callers"))


@query(f"WITH {_EDGES}, {_TARGETS} SELECT target, string_agg(DISTINCT dst, ',' ORDER BY dst) AS callees FROM edges JOIN t ON src = target WHERE resolved GROUP BY target")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(_edges(spark, d), _every_part(spark, d)).select("target", F.array_join("callees", ",").alias("callees"))


@query(f"WITH {_EDGES}, {_TARGETS} SELECT target, dst AS callee, edge_seq FROM edges JOIN t ON src = target WHERE NOT resolved")
def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.unresolved_calls(_edges(spark, d), _every_part(spark, d))


_HUNDREDTH_PARTS = "goal AS (SELECT 'p' || p_partkey AS target FROM part WHERE p_partkey % 100 = 0)"


def _levels_sql(depth: int) -> str:
    """The levels of a breadth-first search, each of what the levels before did not find."""
    out = ["l0 AS (SELECT target, target AS caller, 0 AS depth, NULL::INTEGER AS lineno, []::BIGINT[] AS path FROM goal)"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT target, caller FROM l{i}" for i in range(k))
        out.append(
            f"""l{k} AS MATERIALIZED (
  SELECT target, src AS caller, {k} AS depth, arg_min(step.lineno, list_append(path, step.edge_seq)) AS lineno, min(list_append(path, step.edge_seq)) AS path
  FROM l{k - 1} f JOIN step ON dst = caller
  WHERE (target, src) NOT IN ({before}) GROUP BY target, src)"""
        )
    return ",\n".join(out)


@query(
    f"""WITH {_EDGES}, {_HUNDREDTH_PARTS},
step AS MATERIALIZED (SELECT src, dst, min(edge_seq) AS edge_seq, arg_min(lineno, edge_seq) AS lineno FROM edges WHERE resolved GROUP BY src, dst),
{_levels_sql(5)}
SELECT target, caller, depth, lineno, array_to_string(path, '>') AS path FROM ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, 6))})"""
)
def transitive_callers(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every part whose key is divisible by 100, over all call sites."""
    goal = read_table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("target"))
    found = graph.transitive_callers(_edges(spark, d), goal)
    return found.select("target", "caller", "depth", "lineno", F.array_join(F.col("position").cast("array<string>"), ">").alias("path"))


@query(
    f"""WITH {_EDGES}, {_HUNDREDTH_PARTS},
step AS MATERIALIZED (SELECT src, dst, min(edge_seq) AS edge_seq, arg_min(lineno, edge_seq) AS lineno FROM edges WHERE resolved GROUP BY src, dst),
{_levels_sql(5)}
SELECT target, caller, depth FROM ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, 6))})"""
)
def reachable_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who reaches a target in how many steps, by bits of targets at each node."""
    goal = read_table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("target"))
    return graph.reachable_callers(_edges(spark, d), goal)


_LINKS = r"""
links AS (
  SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS module, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS imported_module FROM pages)"""


def _imports(spark: SparkSession, d: str) -> DataFrame:
    pages = lexical.spread(read_table(spark, d, "pages"))
    return pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("module"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("imported_module"))


@query(f"WITH {_LINKS} SELECT module, imported_module FROM links WHERE imported_module <> ''")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(_imports(spark, d))


@query(f"WITH {_LINKS} SELECT imported_module AS target, string_agg(module, ',' ORDER BY module) AS importers FROM links WHERE imported_module <> '' GROUP BY imported_module")
def importers(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.import_edges(_imports(spark, d)).select(F.col("module").alias("src"), F.col("imported_module").alias("dst"), F.lit("import").alias("type"))
    targets = edges.select(F.col("dst").alias("target")).distinct()
    return graph.importers(edges, targets).select("target", F.array_join("importers", ",").alias("importers"))


@query(f"WITH {_EDGES} SELECT 'p' || p_partkey AS qualname FROM part UNION SELECT src FROM edges UNION SELECT dst FROM edges")
def node_universe(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_universe(_parts(spark, d), _edges(spark, d))


@query(
    f"""WITH {_EDGES}
SELECT (SELECT count(*) FROM part WHERE p_size % 3 <> 0) AS functions_methods, (SELECT count(*) FROM part WHERE p_size % 3 = 0) AS classes,
       (SELECT count(*) FROM edges WHERE resolved) AS resolved_calls, (SELECT count(*) FROM edges WHERE NOT resolved) AS unresolved_calls"""
)
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.index_summary(_parts(spark, d), _edges(spark, d))


_CHUNKS = """
chunks AS (
  SELECT doc_id AS chunk_seq, 'pkg.' || source || '.p' || doc_id AS qualname,
         CASE doc_id % 5 WHEN 0 THEN 'tests/' || source || '/doc.py' WHEN 1 THEN 'pkg/test_' || source || '.py' ELSE 'pkg/' || source || '.py' END AS file_path, text
  FROM documents)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    k, source = F.col("doc_id") % 5, F.col("source")
    path = F.when(k == 0, F.concat(F.lit("tests/"), source, F.lit("/doc.py"))).when(k == 1, F.concat(F.lit("pkg/test_"), source, F.lit(".py"))).otherwise(F.concat(F.lit("pkg/"), source, F.lit(".py")))
    name = F.concat(F.lit("pkg."), source, F.lit(".p"), F.col("doc_id"))
    docs = lexical.spread(read_table(spark, d, "documents"))
    return docs.select(F.col("doc_id").alias("chunk_seq"), F.concat_ws("::", path, name).alias("chunk_id"), path.alias("file_path"), name.alias("qualname"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "text")


@query(
    f"""WITH {_CHUNKS}, named AS (SELECT * REPLACE (regexp_replace(qualname, '[0-9]$', '') AS qualname) FROM chunks),
goal AS (SELECT DISTINCT 'pkg.' || source || '.p' || doc_id AS target FROM documents)
SELECT target, arg_max(file_path, chunk_seq) AS file, target AS qualname, 'function' AS kind, 1 AS start_line, 1 AS end_line, arg_max(text, chunk_seq) AS text
FROM named JOIN goal ON qualname = target GROUP BY target"""
)
def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents share a name, which lacks the id's last digit: the last one defines it."""
    chunks = _chunks(spark, d).withColumn("qualname", F.regexp_replace("qualname", "[0-9]$", ""))
    goal = read_table(spark, d, "documents").select(F.concat(F.lit("pkg."), F.col("source"), F.lit(".p"), F.col("doc_id")).alias("target")).distinct()
    return tools.get_definition(chunks, goal)


TESTED = ("pkg.the", "pkg.mod.para", "Einer.nicht", "licensed", "absent_word")


@query(
    f"""WITH {_CHUNKS}, goal AS (SELECT unnest({list(TESTED)}) AS target)
SELECT target, file_path AS file, qualname, chunk_seq AS first_seq FROM chunks, goal
WHERE (file_path LIKE 'tests/%' OR starts_with(parse_filename(file_path), 'test_')) AND contains(text, list_last(string_split(target, '.')))"""
)
def tests_for(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(t,) for t in TESTED], "target string")
    return tools.find_tests(_chunks(spark, d), targets).select("target", "file", "qualname", "first_seq")


CHANGED = ("p1", "p17", "src1.p1", "p999999", "src3", "nowhere")


@query(
    f"""WITH RECURSIVE {_EDGES}, {_CHUNKS}, goal AS (SELECT unnest({list(CHANGED)}) AS target),
brings AS (SELECT DISTINCT 'm' || p_size AS src, p_brand AS dst FROM part UNION SELECT DISTINCT 'app.' || lang, 'pkg.' || source FROM documents),
names AS MATERIALIZED (
  SELECT 'p' || p_partkey AS q FROM part UNION SELECT src FROM edges UNION SELECT dst FROM edges UNION SELECT qualname FROM chunks UNION SELECT src FROM brings UNION SELECT dst FROM brings),
found AS (
  SELECT target, EXISTS (SELECT 1 FROM names WHERE q = target) AS exact,
         (SELECT list_sort(list(DISTINCT qualname)) FROM chunks WHERE ends_with(qualname, '.' || target)) AS l FROM goal),
res AS (
  SELECT target, CASE WHEN exact THEN target WHEN len(l) = 1 THEN l[1] END AS resolved_target,
         CASE WHEN exact OR len(l) = 1 THEN NULL WHEN len(l) > 1 THEN 'Ambiguous target ''' || target || ''', matches: ' || array_to_string(l, ', ')
              ELSE 'Symbol ''' || target || ''' not found in the index.' END AS error FROM found),
step AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE resolved),
r AS (
  SELECT resolved_target AS g, resolved_target AS node, 0 AS depth FROM res WHERE resolved_target IS NOT NULL
  UNION SELECT g, src, depth + 1 FROM r JOIN step ON dst = node WHERE depth < 5),
direct AS (SELECT resolved_target AS g, src FROM res JOIN step ON dst = resolved_target),
beyond AS (SELECT DISTINCT g, node FROM r WHERE node <> g AND NOT EXISTS (SELECT 1 FROM direct WHERE direct.g = r.g AND direct.src = r.node)),
tests AS (
  SELECT resolved_target AS g, qualname, chunk_seq FROM chunks, res
  WHERE (file_path LIKE 'tests/%' OR starts_with(parse_filename(file_path), 'test_')) AND contains(text, list_last(string_split(resolved_target, '.'))))
SELECT target, resolved_target, error,
       CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM direct WHERE g = resolved_target), '') END AS direct_callers,
       CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM beyond WHERE g = resolved_target), '') END AS transitive_callers,
       CASE WHEN error IS NULL THEN coalesce((SELECT p_brand FROM part WHERE 'p' || p_partkey = resolved_target), regexp_extract(resolved_target, '^(.*)\\.[^.]*$', 1)) END AS target_module,
       CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM brings WHERE dst = coalesce((SELECT p_brand FROM part WHERE 'p' || p_partkey = resolved_target), regexp_extract(resolved_target, '^(.*)\\.[^.]*$', 1))), '') END AS dependent_modules,
       CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(qualname, ',' ORDER BY chunk_seq) FROM tests WHERE g = resolved_target), '') END AS related_tests
FROM res"""
)
def impact_report(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(t,) for t in CHANGED], "target string")
    # Sizes stand for modules that import brands, languages for modules that import sources.
    of_parts = read_table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_size")).alias("src"), F.col("p_brand").alias("dst"))
    of_docs = read_table(spark, d, "documents").select(F.concat(F.lit("app."), F.col("lang")).alias("src"), F.concat(F.lit("pkg."), F.col("source")).alias("dst"))
    imports = of_parts.unionAll(of_docs).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    brings = imports.select(F.lit(0).cast("long").alias("edge_seq"), "src", "dst", F.lit("import").alias("type"), F.lit(None).cast("int").alias("lineno"), F.lit(None).cast("boolean").alias("resolved"))
    report = impact.impact_report(targets, _chunks(spark, d), _parts(spark, d), _edges(spark, d).unionByName(brings))
    lists = ("direct_callers", "transitive_callers", "dependent_modules", "related_tests")
    return report.select("target", "resolved_target", "error", "target_module", *[F.array_join(c, ",").alias(c) for c in lists])


# --- evaluation ------------------------------------------------------------------------

_RETRIEVED = f"""
{_BM25}, q AS (SELECT item_id AS query_id, {tokens_sql('text')} AS t FROM benchmark), {_SCORED},
need AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
gold AS (SELECT query_id, doc_id FROM post JOIN qt USING (term) JOIN need USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n),
found AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10),
per AS (
  SELECT item_id AS query_id, (SELECT count(*) FROM found f WHERE f.query_id = item_id) AS k, (SELECT count(*) FROM gold g WHERE g.query_id = item_id) AS golden,
         (SELECT count(*) FROM found f JOIN gold g USING (query_id, doc_id) WHERE f.query_id = item_id) AS hit, (SELECT min(rank) FROM found f JOIN gold g USING (query_id, doc_id) WHERE f.query_id = item_id) AS first
  FROM benchmark)"""


@query(
    f"""WITH {_RETRIEVED}
SELECT query_id, CASE WHEN k > 0 THEN round(hit / k::DOUBLE, 6) ELSE 0 END AS precision_at_k, CASE WHEN k > 0 AND golden > 0 THEN round(hit / golden::DOUBLE, 6) ELSE 0 END AS recall_at_k,
       CASE WHEN first > 0 THEN round(1 / first::DOUBLE, 6) ELSE 0 END AS reciprocal_rank FROM per"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _retrieval_scores(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")])


def _retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """BM25's ten best against the documents that have every token of the item."""
    index, items = lexical.build_index(_documents(spark, d)), _items(spark, d)
    terms = lexical.query_terms(items)
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    have = lexical.asked_of(index.postings, terms, items, ["term"]).groupBy("query_id", "doc_seq").agg(F.count(F.lit(1)).alias("have")).join(need, "query_id").where("have = need")
    named = F.col("doc_seq").cast("string").alias("id")
    return metrics.retrieval_scores_of(items, lexical.search(index, items, 10, digits=6).select("query_id", "rank", named), have.select("query_id", named))


_NAMES = """
hits AS (
  SELECT doc_id AS query_id, unnest([1, 2, 3]) AS rank, unnest(['pkg.m' || (doc_id % 50), 'pkg.m' || (doc_id % 50) || '.C' || (doc_id % 3), 'pkg.m' || (doc_id % 7) || '.C.run']) AS id FROM documents),
gold AS (
  SELECT doc_id AS query_id, unnest(['pkg.m' || (doc_id % 10) || '.C' || (doc_id % 2) || '.f', 'pkg.m' || (doc_id % 50) || '.C1', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE 'pkg.m' || (doc_id % 50) || '0' END]) AS id
  FROM documents WHERE doc_id % 9 <> 0),
pair AS (
  SELECT DISTINCT query_id, rank, g.id AS gold FROM hits h JOIN gold g USING (query_id)
  WHERE h.id = g.id OR starts_with(h.id, g.id || '.') OR starts_with(g.id, h.id || '.'))"""


@query(
    f"""WITH {_NAMES}
SELECT doc_id AS query_id, round((SELECT count(DISTINCT rank) FROM pair p WHERE p.query_id = doc_id) / 3::DOUBLE, 6) AS precision_at_k,
       coalesce(round((SELECT count(DISTINCT gold) FROM pair p WHERE p.query_id = doc_id) / nullif((SELECT count(DISTINCT id) FROM gold g WHERE g.query_id = doc_id), 0)::DOUBLE, 6), 0) AS recall_at_k,
       coalesce(round(1 / (SELECT min(rank) FROM pair p WHERE p.query_id = doc_id)::DOUBLE, 6), 0) AS reciprocal_rank
FROM documents"""
)
def retrieval_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Dotted names, three found and three expected for each document: a name also matches
    what stands inside it, or what it stands inside of."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    m = lambda k: F.concat(F.lit("pkg.m"), F.col("query_id") % k)
    found = F.array(m(50), F.concat(m(50), F.lit(".C"), F.col("query_id") % 3), F.concat(m(7), F.lit(".C.run")))
    third = F.when(F.col("query_id") % 4 == 0, F.lit("x")).otherwise(F.concat(m(50), F.lit("0")))
    expected = F.array(F.concat(m(10), F.lit(".C"), F.col("query_id") % 2, F.lit(".f")), F.concat(m(50), F.lit(".C1")), third)
    hits = docs.select("query_id", F.posexplode(found).alias("at", "id")).select("query_id", (F.col("at") + 1).alias("rank"), "id")
    gold = docs.where("query_id % 9 <> 0").select("query_id", F.explode(expected).alias("id"))
    scored = metrics.retrieval_scores_of(docs, hits, gold)
    return scored.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")])


@query(
    f"""WITH {_RETRIEVED}
SELECT round(avg(CASE WHEN k > 0 THEN hit / k::DOUBLE ELSE 0 END), 6) AS precision_at_k, round(avg(CASE WHEN k > 0 AND golden > 0 THEN hit / golden::DOUBLE ELSE 0 END), 6) AS recall_at_k,
       round(avg(CASE WHEN first > 0 THEN 1 / first::DOUBLE ELSE 0 END), 6) AS mrr FROM per"""
)
def retrieval_macro(spark: SparkSession, d: str) -> DataFrame:
    mean = metrics.mean_retrieval(_retrieval_scores(spark, d))
    return mean.select(*[F.round(c, 6).alias(c) for c in mean.columns])


_REPO_POSTINGS = f"""
rtok AS MATERIALIZED (SELECT coalesce(source, '') AS repo, doc_id, {tokens_sql("text")} AS t FROM documents),
rcorpus AS (SELECT repo, count(*) AS n, avg(len(t)) AS avgdl FROM rtok GROUP BY repo),
rpost AS MATERIALIZED (SELECT repo, term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT repo, doc_id, len(t) AS dl, unnest(t) AS term FROM rtok) GROUP BY ALL),
rraw AS (SELECT repo, term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM rpost JOIN rcorpus USING (repo) GROUP BY repo, term),
rterms AS (SELECT repo, term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY repo) ELSE raw END AS idf FROM rraw)"""


def _of_repos(spark: SparkSession, d: str) -> DataFrame:
    """Sources stand for repositories."""
    docs = read_table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("repo"), F.col("doc_id").alias("doc_seq"), "text")
    return lexical.spread(docs)


@query(f"WITH {_REPO_POSTINGS} SELECT repo, term, df, round(idf, 6) AS idf FROM rterms")
def repo_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """The term statistics of every repository's own index, from one plan."""
    return repos.term_stats(_of_repos(spark, d)).select("repo", "term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH {_REPO_POSTINGS},
rq AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo, {tokens_sql('text')} AS t FROM benchmark),
rqt AS (SELECT repo, query_id, term, count(*) AS qtf FROM (SELECT repo, query_id, unnest(t) AS term FROM rq) GROUP BY ALL),
rscored AS (
  SELECT repo, query_id, doc_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM rpost JOIN rterms USING (repo, term) JOIN rqt USING (repo, term) JOIN rcorpus USING (repo) GROUP BY repo, query_id, doc_id)
SELECT repo, query_id, doc_id, score, row_number() OVER (PARTITION BY repo, query_id ORDER BY score DESC, doc_id) AS rank FROM rscored WHERE score > 0 QUALIFY rank <= 10"""
)
def repo_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each question in its own repository."""
    items = read_table(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo"), F.col("item_id").alias("query_id"), "text")
    found = repos.search(repos.postings(_of_repos(spark, d)), items, 10, digits=6)
    return found.select("repo", "query_id", F.col("doc_seq").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_SETS = """
g AS (SELECT source, count(*) FILTER (quality = 1) AS p, count(*) FILTER (toxic = 1) AS e, count(*) FILTER (quality = 1 AND toxic = 1) AS b FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
s AS (
  SELECT source, CASE WHEN p = 0 AND e = 0 THEN 1.0 WHEN p = 0 OR e = 0 THEN 0.0 ELSE b / p::DOUBLE END AS precision, CASE WHEN p = 0 AND e = 0 THEN 1.0 WHEN p = 0 OR e = 0 THEN 0.0 ELSE b / e::DOUBLE END AS recall FROM g),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    both = read_table(spark, d, "documents").select("doc_id", "source").join(read_table(spark, d, "labels"), "doc_id", "left")
    sets = both.groupBy("source").agg(F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("predicted"), F.collect_set(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("expected"))
    return sets.select("source", metrics.set_prf1(F.col("predicted"), F.col("expected")).alias("s"))


@query(f"WITH {_SETS} SELECT source, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def set_prf1(spark: SparkSession, d: str) -> DataFrame:
    """High quality as a prediction of toxicity, source by source."""
    return _sets(spark, d).select("source", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {_SETS}, h AS (SELECT *, source <> 'src3' AS ok FROM f)
SELECT round(avg(precision) FILTER (ok), 6) AS caller_precision, round(avg(recall) FILTER (ok), 6) AS caller_recall, round(avg(f1) FILTER (ok), 6) AS caller_f1, round(avg(f1) FILTER (ok), 6) AS test_f1,
       round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS resolution_rate FROM h"""
)
def impact_macro(spark: SparkSession, d: str) -> DataFrame:
    """The macro mean of impact questions: sources stand for questions, one is unresolved."""
    scored = _sets(spark, d).select((F.col("source") != "src3").alias("resolved"), F.col("s").alias("callers"), F.col("s").alias("tests"))
    mean = metrics.mean_impact(scored)
    return mean.select(*[F.round(c, 6).alias(c) for c in mean.columns])


KEYWORDS = ("the", "THAT", "nicht", "pour")


@query(
    f"""SELECT conv_id, turn, round(len(list_filter({list(KEYWORDS)}, lambda k: contains(lower(text), lower(k)))) / {len(KEYWORDS)}::DOUBLE, 6) AS coverage
FROM conversations WHERE role = 'assistant'"""
)
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    answers = read_table(spark, d, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", F.round(metrics.keyword_coverage(F.col("text"), F.array(*[F.lit(k) for k in KEYWORDS])), 6).alias("coverage"))


_CITED = r"""
turns AS (
  SELECT conv_id, turn, role, 'see pkg/conv_' || (conv_id % 7) || '.py:' || (turn * 3 + 1) || ' and src/conv_' || (conv_id % 5) || '.py:' || (length(text) % 40) AS said,
         'pkg/conv_' || (conv_id % 7) || '.py' AS file, turn * 3 AS lo, turn * 3 + 9 AS hi FROM conversations),
cite AS (
  SELECT conv_id, turn, unnest(regexp_extract_all(said, '([\w./\\-]+\.py):(\d+)', 1)) AS file, CAST(unnest(regexp_extract_all(said, '([\w./\\-]+\.py):(\d+)', 2)) AS BIGINT) AS line, unnest(range(2)) AS n
  FROM turns WHERE role = 'assistant'),
shown AS (SELECT conv_id, file, lo, hi FROM turns WHERE role = 'user'),
per AS (
  SELECT conv_id * 1000 + turn AS answer_id, count(*) AS citation_count,
         count(*) FILTER (EXISTS (SELECT 1 FROM shown s WHERE s.conv_id = cite.conv_id AND line BETWEEN lo AND hi AND (ends_with(s.file, cite.file) OR ends_with(cite.file, s.file)))) AS grounded_count
  FROM cite GROUP BY conv_id, turn)"""


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    """Assistants cite two made-up locations; users' turns stand for tool answers that show
    one file. Each assistant turn is an answer of its own."""
    c = read_table(spark, d, "conversations")
    file = F.concat(F.lit("pkg/conv_"), F.col("conv_id") % 7, F.lit(".py"))
    said = F.concat(F.lit("see "), file, F.lit(":"), F.col("turn") * 3 + 1, F.lit(" and src/conv_"), F.col("conv_id") % 5, F.lit(".py:"), F.length("text") % 40)
    answers = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("conv_id").alias("of"), said.alias("answer"))
    shown = F.to_json(F.struct(file.alias("file"), (F.col("turn") * 3).alias("start_line"), (F.col("turn") * 3 + 9).alias("end_line")))
    tool = c.where("role = 'user'").select(F.col("conv_id").alias("of"), F.lit("tool").alias("role"), shown.alias("content"))
    messages = answers.select(F.col("answer_id").alias("conv_id"), "of").join(tool, "of").select("conv_id", "role", "content")
    return metrics.groundedness(answers.select(F.col("answer_id").alias("conv_id"), "answer"), messages)


@query(f"WITH {_CITED} SELECT answer_id, citation_count, grounded_count FROM per")
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select(F.col("conv_id").alias("answer_id"), F.col("citation_count").cast("long").alias("citation_count"), F.col("grounded_count").cast("long").alias("grounded_count"))


@query(f"WITH {_CITED} SELECT round(avg(CASE WHEN citation_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS citation_rate, round(avg(grounded_count / citation_count::DOUBLE) FILTER (citation_count > 0), 6) AS grounded_rate FROM per")
def groundedness_macro(spark: SparkSession, d: str) -> DataFrame:
    mean = metrics.mean_groundedness(_grounded(spark, d))
    return mean.select(*[F.round(c, 6).alias(c) for c in mean.columns])


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '... [truncated]' ELSE text END AS text FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", T.truncate_text(F.col("text")).alias("text"))


_ANSWERED = """
a AS (
  SELECT conv_id, turn, length(text) AS n, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '... [truncated]' ELSE text END AS cut, text FROM conversations)"""


@query(
    f"""WITH {_ANSWERED}
SELECT conv_id, turn, 'a' AS path, cut AS value FROM a UNION ALL SELECT conv_id, turn, 'b', text FROM a UNION ALL SELECT conv_id, turn, 'c', cut FROM a UNION ALL SELECT conv_id, turn, 'd', cut FROM a
UNION ALL SELECT conv_id, turn, 'e', n::VARCHAR FROM a"""
)
def truncate_answers(spark: SparkSession, d: str) -> DataFrame:
    """Tool answers as nested JSON of each turn's text: at the top, under another name, in a list
    and deep inside. What is cut are strings named text, wherever they stand."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    text, other = F.col("text"), F.col("text").alias("title")
    answer = F.to_json(F.struct(text, other, F.array(F.struct(text, other)).alias("hits"), F.struct(F.array(F.struct(F.struct(text).alias("chunk"))).alias("rows"), F.length("text").alias("text")).alias("deep")))
    cut = nested.truncate_answer(answer)
    at = lambda path, name: F.struct(F.lit(name).alias("path"), F.get_json_object("answer", path).alias("value"))
    parts = F.array(at("$.text", "a"), at("$.title", "b"), at("$.hits[0].text", "c"), at("$.deep.rows[0].chunk.text", "d"), at("$.deep.text", "e"))
    return c.select("conv_id", "turn", cut.alias("answer")).select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", "p.path", "p.value")


_RATES = """
v AS (
  SELECT source AS repo, unnest(['retrieval.recall_at_k', 'groundedness.grounded_rate', 'correctness.keyword_coverage', 'impact.caller_f1']) AS metric,
         unnest([avg(quality), avg(toxic), avg(quality) FILTER (lang = 'en'), avg(toxic) FILTER (lang = 'en')]) AS value,
         unnest([avg(quality) FILTER (lang <> 'en'), avg(toxic) FILTER (lang = 'de'), avg(quality) FILTER (lang = 'fr'), avg(toxic) + 0.05]) AS base
  FROM documents JOIN labels USING (doc_id) GROUP BY source)"""


@query(f"WITH {_RATES} SELECT repo, metric, round(base, 6) AS baseline, round(value, 6) AS current FROM v WHERE value < base - 0.1::DOUBLE")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over four rates of each source, against the same rates of a slice of it."""
    both = read_table(spark, d, "documents").select("doc_id", "source", "lang").join(read_table(spark, d, "labels"), "doc_id")
    rate = lambda c, lang=None: F.avg(F.when(lang, F.col(c)) if lang is not None else F.col(c))
    lang = F.col("lang")

    def nested(values) -> DataFrame:
        r, g, k, f = values
        return both.groupBy(F.col("source").alias("repo")).agg(
            F.struct(r.alias("recall_at_k")).alias("retrieval"), F.struct(g.alias("grounded_rate")).alias("groundedness"), F.struct(k.alias("keyword_coverage")).alias("correctness"), F.struct(f.alias("caller_f1")).alias("impact")
        )

    now = nested([rate("quality"), rate("toxic"), rate("quality", lang == "en"), rate("toxic", lang == "en")])
    then = nested([rate("quality", lang != "en"), rate("toxic", lang == "de"), rate("quality", lang == "fr"), rate("toxic") + 0.05])
    return metrics.regressions(metrics.gated_values(now), metrics.gated_values(then)).select("repo", "metric", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"))


# --- structure -------------------------------------------------------------------------

#: Files of a small package of our own. Each document is one of them, by its id: {i} is the
#: id and {lang} the language, and as many blank lines stand in front as n_chars leaves of 7.
PACKAGE = (
    ("shop{i}/__init__.py", "from .cart import Cart\n"),
    (
        "shop{i}/cart.py",
        "import os.path\nfrom . import prices as pr\nfrom .util import *\n\n\nclass Cart:\n    '''A {lang} cart.'''\n\n    @property\n    def total(self):\n        return self.sum(pr.of(x) for x in self.items)\n\n"
        "    def sum(self, xs):\n        def inner():\n            return self.total()\n        return inner() + os.path.join('a')\n\n\n@deco({i})\ndef make():\n    return Cart().sum([])\n",
    ),
    ("shop{i}/prices.py", "async def of(x):\n    return (lambda y: fmt(y))(x)\n\n\nRATE = of(3)\n"),
    ("broken{i}.py", "def f(:\n"),
)


def _package(spark: SparkSession, d: str) -> DataFrame:
    """A file for each document, analyzed."""
    k = (F.col("doc_id") % len(PACKAGE)).cast("int")
    filled = lambda texts: F.replace(F.replace(F.get(F.array(*[F.lit(t) for t in texts]), k), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{lang}"), F.coalesce("lang", F.lit("?")))
    docs = read_table(spark, d, "documents")
    blank = F.repeat(F.lit("\n"), (F.coalesce("n_chars", F.lit(0)) % 7).cast("int"))
    return structure.analyze(files_of_table(docs.select(filled([n for n, _ in PACKAGE]).alias("rel_path"), F.concat(blank, filled([t for _, t in PACKAGE])).alias("content"))))


_FILES = "files AS (SELECT doc_id % 4 AS k, CAST(doc_id AS VARCHAR) AS i, coalesce(lang, '?') AS lang, coalesce(n_chars, 0) % 7 AS pad FROM documents)"


@query(
    f"""WITH {_FILES}, v(k, module, caller, callee, line, resolved) AS (VALUES
(1, 'shop#.cart', 'shop#.cart.Cart.total', 'shop#.cart.Cart.sum', 11, true), (1, 'shop#.cart', 'shop#.cart.Cart.total', 'shop#.prices.of', 11, true),
(1, 'shop#.cart', 'shop#.cart.Cart.sum.inner', 'shop#.cart.Cart.sum.total', 15, true), (1, 'shop#.cart', 'shop#.cart.Cart.sum', 'inner', 16, false),
(1, 'shop#.cart', 'shop#.cart.Cart.sum', 'os.path.path.join', 16, true), (1, 'shop#.cart', 'shop#.cart.make', '<dynamic>', 21, false), (1, 'shop#.cart', 'shop#.cart.make', 'shop#.cart.Cart', 21, true),
(2, 'shop#.prices', 'shop#.prices.of', '<dynamic>', 2, false), (2, 'shop#.prices', 'shop#.prices.of', 'fmt', 2, false), (2, 'shop#.prices', 'shop#.prices', 'shop#.prices.of', 5, true))
SELECT replace(module, '#', i) AS module, replace(caller, '#', i) AS caller, replace(callee, '#', i) AS callee, CAST(line + pad AS INTEGER) AS lineno, resolved FROM files JOIN v USING (k)"""
)
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return structure.calls(_package(spark, d)).select("module", "caller", "callee", "lineno", "resolved")


@query(
    f"""WITH {_FILES}, v(k, chunk_id, kind, a, b, docstring, decorators) AS (VALUES
(0, 'shop#/__init__.py::shop#', 'module', 0, 1, NULL, ''), (1, 'shop#/cart.py::shop#.cart.Cart', 'class', 6, 16, 'A @ cart.', ''), (1, 'shop#/cart.py::shop#.cart.Cart.total', 'method', 9, 11, NULL, 'property'),
(1, 'shop#/cart.py::shop#.cart.Cart.sum', 'method', 13, 16, NULL, ''), (1, 'shop#/cart.py::shop#.cart.make', 'function', 19, 21, NULL, 'deco(#)'), (1, 'shop#/cart.py::shop#.cart', 'module', 0, 18, NULL, ''),
(2, 'shop#/prices.py::shop#.prices.of', 'function', 1, 2, NULL, ''), (2, 'shop#/prices.py::shop#.prices', 'module', 0, 5, NULL, ''))
SELECT replace(chunk_id, '#', i) AS chunk_id, kind, CAST(CASE WHEN a > 0 THEN a + pad WHEN k = 2 AND pad = 0 THEN 3 ELSE 1 END AS INTEGER) AS start_line, CAST(b + pad AS INTEGER) AS end_line,
       replace(docstring, '@', lang) AS docstring, replace(decorators, '#', i) AS decorators FROM files JOIN v USING (k)"""
)
def python_chunks(spark: SparkSession, d: str) -> DataFrame:
    return structure.chunks(_package(spark, d)).select("chunk_id", "kind", "start_line", "end_line", "docstring", F.array_join("decorators", ",").alias("decorators"))


@query(
    f"""WITH {_FILES}, v(k, qualname, kind, module, class_name) AS (VALUES
(0, 'shop#', 'module', NULL, NULL), (1, 'shop#.cart', 'module', NULL, NULL), (2, 'shop#.prices', 'module', NULL, NULL), (1, 'shop#.cart.Cart', 'class', 'shop#.cart', NULL), (1, 'shop#.cart.Cart.total', 'method', 'shop#.cart', 'Cart'),
(1, 'shop#.cart.Cart.sum', 'method', 'shop#.cart', 'Cart'), (1, 'shop#.cart.Cart.sum.inner', 'function', 'shop#.cart', NULL), (1, 'shop#.cart.make', 'function', 'shop#.cart', NULL), (2, 'shop#.prices.of', 'function', 'shop#.prices', NULL))
SELECT replace(qualname, '#', i) AS qualname, kind, replace(module, '#', i) AS module, class_name FROM files JOIN v USING (k)"""
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    analysis = _package(spark, d)
    return graph.build_nodes(analysis.where("error IS NULL"), structure.definitions(analysis))


@query(
    f"""WITH {_FILES}, v(k, src, dst, type, line, resolved) AS (VALUES
(0, 'shop#', 'shop#.cart', 'import', NULL, NULL), (1, 'shop#.cart', 'os.path', 'import', NULL, NULL), (1, 'shop#.cart', 'shop#', 'import', NULL, NULL), (1, 'shop#.cart', 'shop#.util', 'import', NULL, NULL),
(1, 'shop#.cart.Cart.total', 'shop#.cart.Cart.sum', 'call', 11, true), (1, 'shop#.cart.Cart.total', 'shop#.prices.of', 'call', 11, true), (1, 'shop#.cart.Cart.sum.inner', 'shop#.cart.Cart.sum.total', 'call', 15, true),
(1, 'shop#.cart.Cart.sum', 'inner', 'call', 16, false), (1, 'shop#.cart.Cart.sum', 'os.path.path.join', 'call', 16, true), (1, 'shop#.cart.make', '<dynamic>', 'call', 21, false), (1, 'shop#.cart.make', 'shop#.cart.Cart', 'call', 21, true),
(2, 'shop#.prices.of', '<dynamic>', 'call', 2, false), (2, 'shop#.prices.of', 'fmt', 'call', 2, false), (2, 'shop#.prices', 'shop#.prices.of', 'call', 5, true))
SELECT replace(src, '#', i) AS src, replace(dst, '#', i) AS dst, type, CAST(line + pad AS INTEGER) AS lineno, resolved FROM files JOIN v USING (k)"""
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    analysis = _package(spark, d).where("error IS NULL")
    return graph.build_edges(structure.calls(analysis), structure.imports(analysis)).select("src", "dst", "type", "lineno", "resolved")


@query(f"WITH {_FILES} SELECT 'broken' || i || '.py' AS rel_path, true AS failed FROM files WHERE k = 3 UNION ALL SELECT 'shop' || i || ['/__init__.py', '/cart.py', '/prices.py'][k + 1], false FROM files WHERE k < 3")
def file_errors(spark: SparkSession, d: str) -> DataFrame:
    return _package(spark, d).select("rel_path", F.col("error").isNotNull().alias("failed"))
