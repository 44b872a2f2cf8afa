"""Metrics, gates, the tool loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.agent.loop import MAX_ROUNDS, SYSTEM, Tools, assess, chat, messages_table, shorten
from tessera.agent.models import asks, by_name, replay, row
from tessera.functions import text as T
from tessera.operators import metrics, tools
from tessera.plans import evaluate, workspace
from tessera.sources import evalfiles
from tessera.sources.pysource import files_of_table

TOOL_MESSAGE = "conv_id string, role string, content string"


def column(spark, value, expr):
    return spark.range(1).select(expr(value).alias("x")).first().x


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def test_retrieval_scores(spark):
    s = lambda got, want: tuple(column(spark, None, lambda _: metrics.retrieval_scores(strings(*got), strings(*want))))
    assert s(["a.B", "x"], ["a.B"]) == (0.5, 1.0, 1.0)
    assert s(["x", "a.B"], ["a.B.m"]) == (0.5, 1.0, 0.5)  # a class for its method
    assert s(["a.Bc"], ["a.B"]) == (0.0, 0.0, 0.0)
    assert s([], ["a"]) == (0.0, 0.0, 0.0) and s(["a"], []) == (0.0, 0.0, 0.0)
    assert s(["a"], ["a", "a", "b"]) == (1.0, 0.5, 1.0)


def test_retrieval_scores_of_tables_match_those_of_arrays(spark):
    names = ["a", "a.b", "a.b.c", "a.bc", "b", "a.b.d", "b.a"]
    r = random.Random(3)
    questions = [(k, [r.choice(names) for _ in range(r.randint(0, 4))], [r.choice(names) for _ in range(r.randint(0, 4))]) for k in range(80)]
    table = spark.createDataFrame(questions, "query_id long, got array<string>, want array<string>")
    scores = table.select("query_id", metrics.retrieval_scores(F.col("got"), F.col("want")).alias("s")).select("query_id", "s.*")
    hits = table.select("query_id", F.posexplode("got").alias("k", "id")).select("query_id", (F.col("k") + 1).alias("rank"), "id")
    of = metrics.retrieval_scores_of(table, hits, table.select("query_id", F.explode("want").alias("id")))
    assert sorted(map(tuple, of.collect())) == sorted(map(tuple, scores.collect()))


def test_set_scores_and_keywords(spark):
    p = lambda a, b: tuple(column(spark, None, lambda _: metrics.set_prf1(strings(*a), strings(*b))))
    assert p([], []) == (1.0, 1.0, 1.0) and p(["a"], []) == (0.0, 0.0, 0.0) and p([], ["a"]) == (0.0, 0.0, 0.0)
    assert p(["a", "b"], ["b"]) == (0.5, 1.0, pytest.approx(2 / 3)) and p(["a"], ["b"]) == (0.0, 0.0, 0.0)
    k = lambda t, *w: column(spark, None, lambda _: metrics.keyword_coverage(F.lit(t), strings(*w)))
    assert k("Has TIMEOUT", "timeout", "retry") == 0.5 and k("x") is None


def test_groundedness(spark):
    shown = json.dumps([{"file": "src/sessions.py", "start_line": 640, "end_line": 660}, {"file": "a.py", "start_line": 3}])
    messages = spark.createDataFrame(
        [("1", "tool", shown), ("1", "tool", "not json"), ("1", "tool", '["a"]'), ("1", "user", shown), ("2", "assistant", shown), ("3", "tool", '{"file": "x/a.py", "start_line": 7}')],
        TOOL_MESSAGE,
    )
    answers = spark.createDataFrame([("1", "see sessions.py:651 and sessions.py:999, a.py:3"), ("2", "sessions.py:650"), ("3", "a.py:7 é/a.py:8"), ("4", "nothing"), ("5", None)], "conv_id string, answer string")
    rows = {r.conv_id: (r.citation_count, r.grounded_count) for r in metrics.groundedness(answers, messages).collect()}
    assert rows == {"1": (3, 2), "2": (1, 0), "3": (2, 1), "4": (0, 0), "5": (0, 0)}
    mean = metrics.mean_groundedness(metrics.groundedness(answers, messages)).first()
    assert mean.citation_rate == 0.6 and mean.grounded_rate == pytest.approx((2 / 3 + 0 + 0.5) / 3)
    assert tuple(metrics.mean_groundedness(metrics.groundedness(answers.limit(0), messages)).first()) == (0.0, 0.0)


def test_impact_means(spark):
    one = F.struct(F.lit(1.0).alias("precision"), F.lit(0.5).alias("recall"), F.lit(0.6).alias("f1"))
    rows = spark.createDataFrame([(True,), (False,)], "resolved boolean").select("resolved", one.alias("callers"), one.alias("tests"))
    assert tuple(metrics.mean_impact(rows).first()) == (1.0, 0.5, 0.6, 0.6, 0.5)
    assert tuple(metrics.mean_impact(rows.where("NOT resolved")).first()) == (0.0, 0.0, 0.0, None, 0.0)


def test_gate_is_strict_and_skips_what_is_missing(spark):
    t = "repo string, metric string, value double"
    base = spark.createDataFrame([("r", "a.b", 0.8), ("r", "c.d", 0.5), ("old", "a.b", 1.0), ("r", "n.n", None)], t)
    now = spark.createDataFrame([("r", "a.b", 0.3), ("r", "c.d", 0.4), ("new", "a.b", 0.0), ("r", "n.n", 0.0)], t)
    assert [r.message for r in metrics.regressions(now, base).collect()] == ["r.a.b: 0.80 -> 0.30"]


def test_small_text_functions(spark):
    assert column(spark, "x" * 2001, lambda v: T.truncate_text(F.lit(v))) == "x" * 2000 + "... [truncated]"
    assert column(spark, None, lambda _: T.two_decimals(F.lit(0.125))) == "0.12"
    assert len(column(spark, "/a/b", lambda v: T.collection_suffix(F.lit(v)))) == 12
    paths = {"tests/a.py": True, "a/tests/b/c.py": True, "a/test_x.py": True, "tests.py": False, "a/testsx/y.py": False, "atest_x.py": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tools.is_test_file(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in got} == paths


def test_last_wins_keeps_first_place(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("m", 2, "c")], "qualname string, chunk_seq long, text string")
    assert {(r.qualname, r.text, r.first_seq) for r in tools.last_wins(rows, "qualname").collect()} == {("k", "b", 1), ("m", "c", 2)}


def test_questions_and_manifest(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"type": "qa", "id": "1", "question": "?", "expected_qualnames": ["a"]}\n\n{"type": "impact", "id": "2", "target": "t"}\n')
    qa, impact = evalfiles.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert qa.first().expected_keywords == [] and impact.first().target == "t"
    (tmp_path / "w.jsonl").write_text('{"type": "odd", "id": "1"}\n')
    with pytest.raises(Exception, match="Unknown question type"):
        evalfiles.read_questions(spark, str(tmp_path / "w.jsonl"))[0].collect()
    (tmp_path / "m.yaml").write_text("repos:\n  - {name: n, url: u, ref: v1, commit: abc, package_root: src}\n")
    manifest = evalfiles.read_manifest(spark, str(tmp_path / "m.yaml"))
    assert evalfiles.choose_repos(manifest, ["n"]).count() == 1
    with pytest.raises(ValueError, match="No matching"):
        evalfiles.choose_repos(manifest, ["x"])


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    long = "def helper():\n    " + "\n    ".join(f"x{i} = {i}" for i in range(600)) + "\n"
    files = {"utils.py": long, "app.py": "from utils import helper\n\ndef run():\n    helper()\n", "tests/test_u.py": "def test_helper():\n    helper()\n"}
    table = files_of_table(spark.createDataFrame(list(files.items()), "rel_path string, content string"))
    return workspace.build(table, f"file://{tmp_path_factory.mktemp('ws')}/ix")


def test_chat_calls_tools_and_stops(ws):
    box = Tools(ws)
    history = chat(box, replay(["42"]), [], "?")
    assert [m["role"] for m in history] == ["system", "user", "assistant"] and history[-1]["content"] == "42"
    history = chat(box, replay([asks("get_definition", qualname="utils.helper"), "done"]), [], "?")
    shown = json.loads(next(m for m in history if m["role"] == "tool")["content"])
    assert shown["qualname"] == "utils.helper" and shown["text"].endswith("[truncated]") and len(shown["text"]) == 2015
    asked = []
    assert chat(box, replay([asks("get_callers", qualname="utils.helper")] * 10, asked), [], "?")[-1]["role"] == "assistant" and len(asked) == MAX_ROUNDS
    bad = chat(box, replay([asks("get_callers", wrong=1), asks("magic"), "x"]), [row("system", "s")], "?")
    assert all("error" in json.loads(m["content"]) for m in bad if m["role"] == "tool")
    assert all(name in SYSTEM for name, _, _ in tools.TOOL_SPECS)


def test_tools(ws):
    box = Tools(ws)
    assert box.get_callers("utils.helper") == ["app.run"] and box.get_callers("utils.helper", True) == ["app.run"]
    assert box.get_callees("app.run") == ["utils.helper"] and box.get_importers("utils") == ["app"]
    assert [t["qualname"] for t in box.find_tests_for("utils.helper")] == ["tests.test_u.test_helper"]
    assert box.get_definition("none") is None and box.get_callers("none") == []
    assert box.search_code("helper")[0]["file"] and {s[0] for s in tools.TOOL_SPECS} == {n for n in dir(box) if n.split("_")[0] in ("get", "find", "search")}
    assert shorten({"a": ["b", {"text": "y" * 3000}]})["a"][1]["text"].endswith("[truncated]")


def test_risk_summary_only_without_error(ws):
    assert assess(ws, replay(["risky"]), "helper")["risk_summary"] == "risky"
    assert assess(ws, replay([]), "nope")["risk_summary"] is None
    with pytest.raises(ValueError, match="Unknown provider"):
        by_name("none")
    assert by_name("replay", ["a b"])([], (), 5)["content"] == "a b"


def test_evaluation_report_and_gate(spark, ws, tmp_path):
    qa = spark.createDataFrame([("q1", "where is helper", ["utils.helper"], ["help"]), ("q2", "nothing", [], [])], "id string, question string, expected_qualnames array<string>, expected_keywords array<string>")
    im = spark.createDataFrame([("i1", "utils.helper", ["app.run"], ["tests.test_u.test_helper"]), ("i2", "gone", [], [])], "id string, target string, expected_direct_callers array<string>, expected_tests array<string>")
    box = Tools(ws)
    said = {"q1": chat(box, replay([asks("get_definition", qualname="utils.helper"), "helper is utils.py:1"]), [], "?"), "q2": chat(box, replay(["no"]), [], "?")}
    result = evaluate.evaluate(ws, "demo", "0123456789abcdef", qa, im, messages_table(ws, said))
    r = result.first()
    assert r.retrieval.recall_at_k == 0.5 and tuple(r.groundedness) == (0.5, 1.0) and r.correctness.keyword_coverage == 1.0
    assert tuple(r.impact) == (1.0, 1.0, 1.0, 1.0, 0.5)
    paths = [tmp_path / n for n in ("r.md", "o.json", "b.json")]
    assert evaluate.finish(result, *paths, update=True) == [] and evaluate.finish(result, *paths) == []
    assert "| demo | 0" in paths[0].read_text() and "(@ `0123456789ab`)" in paths[0].read_text()
    better = json.loads(paths[2].read_text())
    better[0]["retrieval"]["recall_at_k"] = 0.9
    paths[2].write_text(json.dumps(better))
    assert evaluate.finish(result, *paths) == ["demo.retrieval.recall_at_k: 0.90 -> 0.50"]
