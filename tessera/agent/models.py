"""Language models as functions.

A conversation is a list of ``MESSAGES`` rows as dicts, from which the evaluation's table is
made without another form in between. A model is any function

    model(conversation, tools, limit) -> row

of the conversation so far, the tools it may ask for (name, description, JSON schema) and
the most tokens it may answer with. It returns the assistant's row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

Row = dict
Model = Callable[[Sequence[Row], Sequence[tuple], int], Row]

_KNOWN: dict[str, Callable[..., Model]] = {}


def row(role: str, content: str, answers: str | None = None, calls: Iterable[Row] = ()) -> Row:
    """A row of a conversation; ``answers`` is the id of the tool call whose result it is."""
    return {"role": role, "content": content, "tool_call_id": answers, "tool_calls": list(calls)}


def asks(name: str, key: str = "call", **arguments) -> Row:
    """An assistant's row that asks for one tool."""
    return row("assistant", "", calls=[{"id": key, "name": name, "arguments": json.dumps(arguments)}])


def named(name: str):
    """Registers a factory of models under a name."""

    def add(factory: Callable[..., Model]) -> Callable[..., Model]:
        _KNOWN[name] = factory
        return factory

    return add


def by_name(name: str, *args, **options) -> Model:
    """A model of a registered factory; an unknown name is an error that lists the known ones."""
    if name not in _KNOWN:
        raise ValueError(f"Unknown provider {name!r}; known: {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name](*args, **options)


@named("replay")
def replay(rows: Iterable[Row | str], asked: list | None = None) -> Model:
    """A model that says what it was given, in order, and notes in ``asked`` what it saw."""
    left = iter(rows)

    def model(conversation: Sequence[Row], tools: Sequence[tuple], limit: int) -> Row:
        if asked is not None:
            asked.append(list(conversation))
        said = next(left)
        return row("assistant", said) if isinstance(said, str) else said

    return model
