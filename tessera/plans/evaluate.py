"""The evaluation of one or more repositories: scores, report, baseline gate."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, tools
from tessera.plans.workspace import Embedder, Workspace

RESULT = (
    "repo string, commit string, n_qa_questions long, n_impact_questions long, retrieval struct<precision_at_k:double,recall_at_k:double,mrr:double>, "
    "groundedness struct<citation_rate:double,grounded_rate:double>, correctness struct<keyword_coverage:double>, "
    "impact struct<caller_precision:double,caller_recall:double,caller_f1:double,test_f1:double,resolution_rate:double>"
)
_COLUMNS = ("P@k", "R@k", "MRR", "Citation rate", "Grounded rate", "Keyword coverage", "Caller P", "Caller R", "Caller F1", "Test F1")
_VALUES = (
    "retrieval.precision_at_k", "retrieval.recall_at_k", "retrieval.mrr", "groundedness.citation_rate", "groundedness.grounded_rate",
    "correctness.keyword_coverage", "impact.caller_precision", "impact.caller_recall", "impact.caller_f1", "impact.test_f1",
)


def impact_scores(ws: Workspace, questions: DataFrame) -> DataFrame:
    """id, resolved, callers, tests: predicted against expected sets. A target resolves only
    if it is exactly a chunk's or a graph node's name."""
    targets = questions.select("target").distinct()
    every = ws.chunks.select("qualname").unionAll(graph.node_names(ws.nodes, ws.edges))
    names = every.join(targets, F.col("qualname") == F.col("target")).select("qualname").distinct()
    callers = graph.direct_callers(ws.edges, targets)
    tests = tools.find_tests(ws.chunks, targets).groupBy("target").agg(F.collect_set("qualname").alias("tests"))
    known = questions.join(names.select(F.col("qualname").alias("target"), F.lit(True).alias("known")), "target", "left")
    none = F.array().cast("array<string>")
    score = lambda got, want: metrics.set_prf1(F.coalesce(got, none), F.coalesce(want, none))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("precision", "recall", "f1")])
    ok = F.coalesce("known", F.lit(False))
    return (
        known.join(callers, "target", "left")
        .join(tests, "target", "left")
        .select("id", ok.alias("resolved"), F.when(ok, score("callers", "expected_direct_callers")).otherwise(zero).alias("callers"), F.when(ok, score("tests", "expected_tests")).otherwise(zero).alias("tests"))
    )


def evaluate(ws: Workspace, repo: str, commit: str, qa: DataFrame, questions: DataFrame, messages: DataFrame, top: int | None = None, embed: Embedder | None = None) -> DataFrame:
    """One ``RESULT`` row. ``messages`` has the conversations that answered the questions
    (conv_id: the question's id); a question's last assistant message is its answer."""
    asked = qa.select(F.xxhash64("id").alias("query_id"), "id", F.col("question").alias("text"), "expected_qualnames", "expected_keywords")
    found = ws.search(asked.select("query_id", "text"), top, embed)
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qualname"))), lambda x: x["qualname"]).alias("retrieved"))
    scored = asked.join(listed, "query_id", "left").select(metrics.retrieval_scores(F.coalesce("retrieved", F.array().cast("array<string>")), F.col("expected_qualnames")).alias("s")).select("s.*")
    answers = messages.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("content", "turn").alias("answer"))
    own = qa.select(F.col("id").alias("conv_id"), "expected_keywords").join(answers, "conv_id", "left")
    grounded = metrics.groundedness(own.select("conv_id", "answer"), messages)
    coverage = own.select(metrics.keyword_coverage(F.coalesce("answer", F.lit("")), F.col("expected_keywords")).alias("c")).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("keyword_coverage"))
    packed = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    # Each side is one row.
    return (
        qa.agg(F.count(F.lit(1)).alias("n_qa_questions"))
        .crossJoin(questions.agg(F.count(F.lit(1)).alias("n_impact_questions")))
        .crossJoin(packed(metrics.mean_retrieval(scored), "retrieval"))
        .crossJoin(packed(metrics.mean_groundedness(grounded), "groundedness"))
        .crossJoin(packed(coverage, "correctness"))
        .crossJoin(packed(metrics.mean_impact(impact_scores(ws, questions)), "impact"))
        .select(F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), "n_qa_questions", "n_impact_questions", "retrieval", "groundedness", "correctness", "impact")
    )


def report_lines(results: DataFrame) -> DataFrame:
    """repo, line: the table rows of the report, numbers half-even to two places."""
    cells = [F.format_number(F.coalesce(F.col(v), F.lit(0.0)), 2) for v in _VALUES]
    return results.select("repo", F.concat(F.lit("| "), F.concat_ws(" | ", "repo", *cells), F.lit(" |")).alias("line"))


def render_markdown(results: DataFrame) -> str:
    rows = {r["repo"]: r["line"] for r in report_lines(results).collect()}
    full = [json.loads(x) for x in results.toJSON().collect()]
    lines = ["# Evaluation report", "", "Every metric is computed by exact comparison; no language model judges anything.", ""]
    lines += ["| " + " | ".join(("Repo", *_COLUMNS)) + " |", "|" + "---|" * (1 + len(_COLUMNS)), *rows.values(), ""]
    for r in full:
        lines += [f"## {r['repo']} (@ `{r['commit'][:12]}`)", f"- {r['n_qa_questions']} QA questions, {r['n_impact_questions']} blast-radius questions"]
        lines += [f"- {title}: {r[title.lower()]}" for title in ("Retrieval", "Groundedness", "Correctness", "Impact")] + [""]
    return "\n".join(lines)


def finish(results: DataFrame, report: Path, out: Path, baseline: Path | None, update: bool = False) -> list[str]:
    """Writes report and results; updates the baseline, or compares with it. Returns the
    messages of failed gates."""
    rows = [json.loads(x) for x in results.toJSON().collect()]
    for path, text in ((report, render_markdown(results)), (out, json.dumps(rows, indent=2)), *([(baseline, json.dumps(rows, indent=2))] if baseline and update else [])):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    if baseline is None or update or not baseline.exists():
        return []
    before = results.sparkSession.read.schema(RESULT).option("multiLine", True).json(f"file://{baseline.resolve()}")
    failed = metrics.regressions(metrics.gated_values(results), metrics.gated_values(before))
    return [r["message"] for r in failed.orderBy("message").collect()]
