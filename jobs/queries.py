"""The jobs as queries over the driver's tables, each with its SQL. A query runs its job twice
into one new folder: the second run has nothing new to take and must leave the same output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluate_repos, index_documents
from tessera.plans.queries import tokens_sql
from tessera.session import new_folder

# The settings of the jobs' files, for whoever has no file at hand.
INDEX = {"id_column": "doc_id", "text_column": "text", "files_per_batch": 64, "block_width": 16, "slots": 16}
EVALUATE = {
    "id_column": "doc_id", "repo_column": "source", "text_column": "text", "question_id_column": "item_id", "question_text_column": "text",
    "question_repo": "concat('src', item_id % 20)", "top_k": 10, "gold_share": 0.5, "digits": 6,
}


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1-index")
    for _ in range(2):
        rows = index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint", INDEX)
    return rows.select("term", F.col("doc_seq").alias("doc_id"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2-evaluate")
    for _ in range(2):
        scores = evaluate_repos.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, EVALUATE)
    return scores.select("repo", "query_id", "precision_at_k", "recall_at_k", "reciprocal_rank")


JOB1_SQL = f"""
WITH last AS (SELECT doc_id, max(coalesce(text, '')) FILTER (sha256(coalesce(text, '')) = d) AS text FROM (SELECT *, max(sha256(coalesce(text, ''))) OVER (PARTITION BY doc_id) AS d FROM documents WHERE doc_id IS NOT NULL) GROUP BY doc_id),
tok AS (SELECT doc_id, {tokens_sql("text")} AS t FROM last)
SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY term, doc_id"""

JOB2_SQL = f"""
WITH tok AS MATERIALIZED (SELECT coalesce(source, '') AS repo, doc_id, {tokens_sql("text")} AS t FROM documents),
corpus AS (SELECT repo, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY repo),
post AS MATERIALIZED (SELECT repo, term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT repo, doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT repo, term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post JOIN corpus USING (repo) GROUP BY repo, term),
terms AS (SELECT repo, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY repo) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo, {tokens_sql("text")} AS t FROM benchmark),
qt AS (SELECT repo, query_id, term, count(*) AS qtf FROM (SELECT repo, query_id, unnest(t) AS term FROM q) GROUP BY ALL),
scored AS (
  SELECT repo, query_id, doc_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM post JOIN terms USING (repo, term) JOIN qt USING (repo, term) JOIN corpus USING (repo) GROUP BY repo, query_id, doc_id),
found AS (
  SELECT repo, query_id, doc_id, row_number() OVER (PARTITION BY repo, query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10),
need AS (SELECT repo, query_id, count(*) AS n FROM qt GROUP BY ALL),
gold AS (SELECT repo, query_id, doc_id FROM post JOIN qt USING (repo, term) JOIN need USING (repo, query_id) GROUP BY repo, query_id, doc_id, n HAVING count(*) >= 0.5::DOUBLE * n),
per AS (
  SELECT q.repo, q.query_id, (SELECT count(*) FROM found f WHERE f.query_id = q.query_id AND f.repo = q.repo) AS k, (SELECT count(*) FROM gold g WHERE g.query_id = q.query_id AND g.repo = q.repo) AS golden,
         (SELECT count(*) FROM found f JOIN gold g USING (repo, query_id, doc_id) WHERE f.query_id = q.query_id AND f.repo = q.repo) AS hit,
         (SELECT min(rank) FROM found f JOIN gold g USING (repo, query_id, doc_id) WHERE f.query_id = q.query_id AND f.repo = q.repo) AS first
  FROM q)
SELECT repo, query_id, CASE WHEN k > 0 THEN round(hit / k::DOUBLE, 6) ELSE 0 END AS precision_at_k, CASE WHEN golden > 0 THEN round(hit / golden::DOUBLE, 6) ELSE 0 END AS recall_at_k,
       CASE WHEN first > 0 THEN round(1 / first::DOUBLE, 6) ELSE 0 END AS reciprocal_rank
FROM per"""

QUERIES = {"job1_index_documents": job1, "job2_evaluate_repos": job2}
SQL = {"job1_index_documents": JOB1_SQL, "job2_evaluate_repos": JOB2_SQL}
