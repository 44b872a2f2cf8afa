"""Questions answered by a model with tools, and the risk summary of an impact report."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from tessera.agent.models import Model, Row, row
from tessera.functions.text import TEXT_LIMIT, TRUNCATED
from tessera.operators import graph, tools
from tessera.plans.workspace import Embedder, Workspace

MAX_ROUNDS = 6
SEARCH_RESULTS = 5
SYSTEM = (
    "The tools below read an index of one Python repository: "
    + "; ".join(f"{name} ({about.rstrip('.').lower()})" for name, about, _ in tools.TOOL_SPECS)
    + ". Answer only from what they return. Put path.py:line behind every statement about the code, with a line that a tool "
    "returned. Where the tools return nothing, the answer is that the index does not have it."
)
RISK = (
    "Below is an impact report: a symbol, its direct and transitive callers, the modules that import it, and the tests that "
    "mention it. Rate the change as low, medium or high risk. Give the reason in at most six sentences: the number of callers, "
    "those that no listed test names, and the modules a reviewer has to open. Name nothing that the report does not list."
)


def shorten(value):
    """A tool's answer with long ``text`` values cut, at any depth."""
    if isinstance(value, list):
        return [shorten(v) for v in value]
    if not isinstance(value, dict):
        return value
    cut = lambda k, v: v[:TEXT_LIMIT] + TRUNCATED if k == "text" and isinstance(v, str) and len(v) > TEXT_LIMIT else shorten(v)
    return {k: cut(k, v) for k, v in value.items()}


class Tools:
    """The tools of a workspace by name; each builds a DataFrame and returns plain values."""

    def __init__(self, ws: Workspace, embed: Embedder | None = None):
        self.ws, self.embed = ws, embed

    def _one(self, name: str):
        return self.ws.spark.createDataFrame([(name,)], "target string")

    def search_code(self, query: str, top_k: int = SEARCH_RESULTS) -> list[dict]:
        asked = self.ws.spark.createDataFrame([(0, query)], "query_id long, text string")
        found = self.ws.search(asked, top_k, self.embed).orderBy("rank")
        return [r.asDict() for r in tools.tool_view(found).collect()]

    def get_definition(self, qualname: str) -> dict | None:
        row = tools.get_definition(self.ws.chunks, self._one(qualname)).drop("target").first()
        return row.asDict() if row else None

    def _names(self, df, column: str) -> list[str]:
        row = df.first()
        return list(row[column]) if row else []

    def get_callers(self, qualname: str, transitive: bool = False) -> list[str]:
        if transitive:
            return sorted(r["caller"] for r in graph.transitive_callers(self.ws.edges, self._one(qualname)).select("caller").collect())
        return self._names(graph.direct_callers(self.ws.edges, self._one(qualname)), "callers")

    def get_callees(self, qualname: str) -> list[str]:
        return self._names(graph.callees(self.ws.edges, self._one(qualname)), "callees")

    def get_importers(self, module: str) -> list[str]:
        return self._names(graph.importers(self.ws.edges, self._one(module)), "importers")

    def find_tests_for(self, qualname: str) -> list[dict]:
        found = tools.find_tests(self.ws.chunks, self._one(qualname)).orderBy("first_seq")
        return [r.asDict() for r in found.select("file", "qualname", "start_line").collect()]

    def call(self, name: str, arguments: dict):
        if name not in {s[0] for s in tools.TOOL_SPECS}:
            return {"error": f"Unknown tool: {name}"}
        return getattr(self, name)(**arguments)

    def answer(self, call: Row) -> Row:
        """The tool's row for a call; what goes wrong becomes the content, as an error."""
        try:
            content = json.dumps(shorten(self.call(call["name"], json.loads(call["arguments"]))))
        except Exception as x:  # the model is told, the conversation goes on
            content = json.dumps({"error": str(x)})
        return row("tool", content, answers=call["id"])


def chat(box: Tools, model: Model, history: Sequence[Row], said: str) -> list[Row]:
    """One turn of the user's, answered: the history with all that was said in between. The
    model is asked ``MAX_ROUNDS`` times at most."""
    conversation = [*(history or [row("system", SYSTEM)]), row("user", said)]
    for round_ in range(1, MAX_ROUNDS + 1):
        got = model(conversation, tools.TOOL_SPECS, 1024)
        conversation.append(got)
        if not got["tool_calls"] or round_ == MAX_ROUNDS:
            break
        conversation += [box.answer(c) for c in got["tool_calls"]]
    return conversation


def assess(ws: Workspace, model: Model, target: str) -> dict:
    """The impact report of one target with the model's risk summary (None on an error)."""
    found = ws.impact(ws.spark.createDataFrame([(target,)], "target string")).first().asDict()
    found["risk_summary"] = None
    if not found["error"]:
        found["risk_summary"] = model([row("system", RISK), row("user", found["facts"])], (), 400)["content"]
    return found


def messages_table(ws: Workspace, conversations: dict[str, list[Row]]):
    """``MESSAGES`` rows of answered conversations, for the evaluation."""
    from tessera.schemas import MESSAGES

    rows = [(cid, i, m["role"], m["content"], m["tool_call_id"], [(c["id"], c["name"], c["arguments"]) for c in m["tool_calls"]]) for cid, ms in conversations.items() for i, m in enumerate(ms)]
    return ws.spark.createDataFrame(rows, MESSAGES).withColumn("turn", F.col("turn").cast("int"))
