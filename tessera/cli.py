"""Command line: index, search, graph, impact, eval, ask, chat."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from pathlib import Path

from pyspark.sql import functions as F

VERSION = "0.1.0"


def _index_path(repo: str) -> str:
    from tessera.sources.pysource import INDEX_DIR

    return str(Path(repo).resolve() / INDEX_DIR)


def _workspace(args):
    from tessera import session
    from tessera.plans import workspace

    return workspace.load(session.build("tessera-cli"), _index_path(args.repo))


def _provider(args):
    """A provider named module:factory, as none is built in."""
    if not args.provider or ":" not in args.provider:
        raise ValueError("a language model is needed: --provider module:factory")
    module, _, name = args.provider.partition(":")
    return getattr(importlib.import_module(module), name)()


def index(args) -> int:
    from tessera import session
    from tessera.plans import workspace
    from tessera.sources.pysource import discover, read_repo

    if not os.path.isdir(args.path):
        raise ValueError(f"Not a directory: {args.path}")
    if not discover(args.path):
        print(f"No Python files found under {args.path}")
        return 0
    ws = workspace.build(read_repo(session.build("tessera-cli"), args.path), _index_path(args.path))
    for r in ws.files.where("error IS NOT NULL").collect():
        print(f"Skipping {r['rel_path']}: {r['error']}")
    s = ws.summary().first()
    print(f"Indexed {s['files']} files ({s['skipped']} skipped)")
    for name in ("chunks", "functions_methods", "classes", "resolved_calls", "unresolved_calls"):
        print(f"  {name.replace('_', ' ')}: {s[name]}")
    print(f"  index dir: {ws.path}")
    return 0


def search(args) -> int:
    ws = _workspace(args)
    asked = ws.spark.createDataFrame([(0, args.query)], "query_id long, text string")
    rows = ws.search(asked, args.top_k).orderBy("rank").collect()
    if not rows:
        print("No results found.")
    for r in rows:
        print(f"{r['file_path']}:{r['start_line']} ({r['qualname']})  dense {r['dense_rank'] or '-'}  bm25 {r['bm25_rank'] or '-'}  fused {r['fused_score']:.4f}  rerank {r['rerank_score']:.4f}")
    return 0


def graph(args) -> int:
    from tessera.operators import graph as g

    ws = _workspace(args)
    one = ws.spark.createDataFrame([(args.symbol,)], "target string")
    if args.what == "importers":
        rows = [(r[0],) for r in g.importers(ws.edges, one).select(F.explode("importers")).collect()]
    elif args.what == "callees":
        rows = [(r["callee"], r["lineno"]) for r in g.callee_sites(ws.edges, one).orderBy("edge_seq").collect()]
    elif args.transitive:
        rows = [(r["caller"], r["lineno"]) for r in g.transitive_callers(ws.edges, one).orderBy("depth", "position").collect()]
    else:
        rows = [(r["caller"], r["lineno"]) for r in g.caller_sites(ws.edges, one).orderBy("edge_seq").collect()]
    if not rows:
        print(f"No {'importers' if args.what == 'importers' else 'resolved ' + args.what} found for {args.symbol}")
    for r in rows:
        print(*r, sep="\t")
    return 0


def impact(args) -> int:
    from tessera.agent.loop import assess

    ws = _workspace(args)
    if args.provider:
        found = assess(ws, _provider(args), args.target)
    else:
        found = ws.impact(ws.spark.createDataFrame([(args.target,)], "target string")).first().asDict() | {"risk_summary": None}
    if found["error"]:
        print(found["error"], file=sys.stderr)
        return 1
    print(found["facts"])
    print("Risk summary:", found["risk_summary"] or "(unavailable)")
    return 0


def ask(args) -> int:
    from tessera.agent.loop import Tools, chat

    print(chat(Tools(_workspace(args)), _provider(args), [], args.question)[-1]["content"])
    return 0


def chat_(args) -> int:
    from tessera.agent.loop import Tools, chat

    box, provider, history = Tools(_workspace(args)), _provider(args), []
    print("(type 'exit' or Ctrl-D to quit)")
    while True:
        try:
            said = input("you> ").strip()
        except (EOFError, KeyboardInterrupt):
            return 0
        if said.lower() in ("exit", "quit"):
            return 0
        if said:
            history = chat(box, provider, history, said)
            print("assistant>", history[-1]["content"])


def eval_(args) -> int:
    """Repositories are looked up below --repos-dir; nothing is downloaded."""
    from tessera import session
    from tessera.agent.loop import Tools, chat, messages_table
    from tessera.plans import evaluate, workspace
    from tessera.sources import evalfiles
    from tessera.sources.pysource import read_repo

    spark = session.build("tessera-cli")
    provider, results = _provider(args), None
    for r in evalfiles.choose_repos(evalfiles.read_manifest(spark, args.manifest), args.repos or None).collect():
        root = Path(args.repos_dir) / r["name"] / r["package_root"]
        ws = workspace.build(read_repo(spark, str(root)), _index_path(str(root)))
        qa, questions = evalfiles.read_questions(spark, str(Path(args.questions_dir) / f"questions_{r['name']}.jsonl"))
        answered = {q["id"]: chat(Tools(ws), provider, [], q["question"]) for q in qa.collect()}
        one = evaluate.evaluate(ws, r["name"], r["commit"], qa, questions, messages_table(ws, answered))
        results = one if results is None else results.unionByName(one)
    baseline = None if args.no_check_regression else Path(args.baseline_path)
    failed = evaluate.finish(results, Path(args.report_path), Path(args.results_path), baseline, args.update_baseline)
    for message in failed:
        print(message, file=sys.stderr)
    return 1 if failed else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Analytics over code and text corpora.")
    top.add_argument("--version", action="version", version=f"tessera {VERSION}")
    commands = top.add_subparsers(required=True)

    def add(name: str, run, *positional: str, model: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.set_defaults(run=run)
        if positional != ("path",):
            p.add_argument("--repo", default=".")
        if model:
            p.add_argument("--provider", help="module:factory of a language model")
        return p

    add("index", index, "path")
    add("search", search, "query").add_argument("--top-k", type=int, default=8)
    add("impact", impact, "target", model=True)
    add("ask", ask, "question", model=True)
    add("chat", chat_, model=True)
    g = add("graph", graph)
    g.add_argument("what", choices=("callers", "callees", "importers"))
    g.add_argument("symbol")
    g.add_argument("--transitive", action="store_true")
    e = add("eval", eval_, model=True)
    e.add_argument("--repos", nargs="*")
    for option, default in (("--manifest", "eval/repo_manifest.yaml"), ("--questions-dir", "eval"), ("--repos-dir", "repos"), ("--report-path", "docs/eval_report.md"), ("--results-path", "eval_results.json"), ("--baseline-path", "docs/eval_baseline.json")):
        e.add_argument(option, default=default)
    e.add_argument("--no-check-regression", action="store_true")
    e.add_argument("--update-baseline", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (FileNotFoundError, ValueError) as x:
        print(x, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
