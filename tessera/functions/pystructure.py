"""What one parse of a Python file yields: chunks, definitions, imports and raw calls.

Plain functions over one source text, so that a task needs nothing else; the operators
that apply them to a table are in ``tessera.operators.structure``.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator
from typing import NamedTuple

#: Nodes that neither define nor call anything, nor have parts that do.
_LEAVES = (ast.Name, ast.Constant, ast.expr_context)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Chunk(NamedTuple):
    file_path: str
    qualname: str
    kind: str
    start_line: int
    end_line: int
    text: str
    docstring: str | None
    decorators: list[str]
    class_name: str | None


class Def(NamedTuple):
    qualname: str
    kind: str
    lineno: int
    end_lineno: int
    class_name: str | None


class Import(NamedTuple):
    local_name: str
    imported_module: str
    imported_symbol: str | None
    lineno: int


class RawCall(NamedTuple):
    caller: str
    raw: str | None
    lineno: int


class _Source:
    """Slices of a text by the (line, UTF-8 column) positions that ``ast`` gives."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.encode().split(b"\n")

    def slice(self, line: int, column: int, end_line: int, end_column: int) -> str:
        if line == end_line:
            return self.lines[line - 1][column:end_column].decode()
        return b"\n".join([self.lines[line - 1][column:], *self.lines[line : end_line - 1], self.lines[end_line - 1][:end_column]]).decode()

    def of(self, node: ast.AST) -> str:
        return self.slice(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def at_sign(self, decorator: ast.expr) -> tuple[int, int]:
        """Where a decorator's ``@`` stands: before the expression, on its line as a rule."""
        line, column = decorator.lineno, decorator.col_offset
        while (at := self.lines[line - 1][:column].rfind(b"@")) < 0:
            line -= 1
            column = len(self.lines[line - 1])
        return line, at


def _strings(segment: str) -> int:
    """String literals that stand side by side in a segment."""
    count = depth = 0
    for token in tokenize.generate_tokens(io.StringIO(f"({segment})").readline):
        kind = tokenize.tok_name[token.type]
        count += depth == 0 and kind in ("STRING", "FSTRING_START", "TSTRING_START")
        depth += kind.endswith("STRING_START")
        depth -= kind.endswith("STRING_END")
    return count


def _docstring(source: _Source, body: list[ast.stmt]) -> str | None:
    """The first statement's literal as written, less its quotes; a prefix letter keeps
    the opening quotes from being stripped. Adjacent literals are no docstring."""
    if not body or not isinstance(body[0], ast.Expr):
        return None
    value = body[0].value
    literal = isinstance(value, ast.JoinedStr) or (isinstance(value, ast.Constant) and isinstance(value.value, (str, bytes)))
    if not literal or (value.lineno, value.col_offset) != (body[0].lineno, body[0].col_offset):
        return None
    text = source.of(value)
    return text.strip("\"'").strip() if _strings(text) == 1 else None


def _definition(source: _Source, node, path: str, qualname: str, kind: str, class_name: str | None = None) -> Chunk:
    marks = [source.at_sign(d) for d in node.decorator_list]
    line, column = marks[0] if marks else (node.lineno, node.col_offset)
    decorators = [source.slice(*mark, d.end_lineno, d.end_col_offset).lstrip("@").strip() for mark, d in zip(marks, node.decorator_list, strict=True)]
    text = source.slice(line, column, node.end_lineno, node.end_col_offset)
    return Chunk(path, qualname, kind, line, node.end_lineno, text, _docstring(source, node.body), decorators, class_name)


def chunks(module: str, path: str, text: str, tree: ast.Module | None = None) -> Iterator[Chunk]:
    """Top-level functions and classes, each class followed by its methods, then one chunk
    of all lines that no definition covers. ``tree``: the text's parse, if there is one
    already. Raises SyntaxError."""
    tree, source = tree or ast.parse(text), _Source(text)
    covered: set[int] = set()
    for node in tree.body:
        if isinstance(node, _FUNCTIONS):
            made = [_definition(source, node, path, f"{module}.{node.name}", "function")]
        elif isinstance(node, ast.ClassDef):
            own = f"{module}.{node.name}"
            made = [_definition(source, node, path, own, "class")]
            made += [_definition(source, m, path, f"{own}.{m.name}", "method", node.name) for m in node.body if isinstance(m, _FUNCTIONS)]
        else:
            continue
        covered.update(range(made[0].start_line, made[0].end_line + 1))
        yield from made
    lines = text.splitlines()
    rest = [n for n in range(1, len(lines) + 1) if n not in covered]
    remainder = "\n".join(lines[n - 1] for n in rest).strip()
    if remainder:
        # A comment before the first statement stands first, and what stands first is the docstring or there is none.
        docstring = None if text.lstrip().startswith("#") else _docstring(source, tree.body)
        yield Chunk(path, module, "module", rest[0], rest[-1], remainder, docstring, [], None)


def dotted(node: ast.expr) -> str | None:
    """``a.b.c`` for names and attributes of names, else None."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def import_base(module: str, is_package_init: bool, level: int) -> str:
    """The package that ``level`` leading dots stand for; empty beyond the root."""
    parts = [p for p in module.split(".") if p]
    climb = level - is_package_init
    if climb <= 0:
        return module
    return ".".join(parts[:-climb])


class Symbols(NamedTuple):
    defs: list[Def]
    imports: list[Import]
    raw_calls: list[RawCall]


def symbols(module: str, text: str, is_package_init: bool = False, tree: ast.Module | None = None, calls: bool = True) -> Symbols:
    """Definitions, imports and raw calls in the order in which they are met. Of functions
    and classes only the body is entered: decorators, defaults, annotations and bases call
    nothing. ``tree``: the text's parse, if there is one already. ``calls``: are raw calls asked
    for? Without them no expression is entered. Raises SyntaxError."""
    passed = _LEAVES if calls else (*_LEAVES, ast.expr)
    defs, imports, raw_calls = found = Symbols([], [], [])
    #: What is still to be met, last first: node, scope, and the class whose body it is directly, else None.
    ahead = [(s, module, None) for s in reversed((tree or ast.parse(text)).body)]
    while ahead:
        node, scope, owner = ahead.pop()
        kind = type(node)
        if kind is ast.Expr:
            if not calls:
                continue
            node = node.value
            kind = type(node)
        if kind is ast.Call:
            name = node.func.id if type(node.func) is ast.Name else dotted(node.func)
            raw_calls.append(RawCall(scope, name, node.lineno))
            if name is not None and not node.args and not node.keywords:
                continue
        elif kind is ast.Import:
            imports.extend(Import(a.asname or a.name.partition(".")[0], a.name, None, node.lineno) for a in node.names)
            continue
        elif kind is ast.ImportFrom:
            base = import_base(module, is_package_init, node.level) if node.level else None
            origin = (node.module or "") if base is None else base if not node.module else f"{base}.{node.module}"
            imports.extend(Import(a.asname or a.name, origin, a.name, node.lineno) for a in node.names)
            continue
        elif kind is ast.ClassDef:
            own = f"{module}.{node.name}"
            defs.append(Def(own, "class", node.lineno, node.end_lineno, None))
            ahead += [(s, own, node.name) for s in reversed(node.body)]
            continue
        elif kind in _FUNCTIONS:
            own = f"{scope}.{node.name}"
            defs.append(Def(own, "method" if owner else "function", node.lineno, node.end_lineno, owner))
            ahead += [(s, own, None) for s in reversed(node.body)]
            continue
        below = [(child, scope, owner) for child in ast.iter_child_nodes(node) if not isinstance(child, passed)]
        ahead += reversed(below)
    return found


class Call(NamedTuple):
    caller: str
    raw: str | None
    lineno: int
    callee: str
    resolved: bool


def stands_for(i: Import) -> str:
    return f"{i.imported_module}.{i.imported_symbol}" if i.imported_symbol else i.imported_module


def resolve(module: str, found: Symbols) -> list[Call]:
    """What each raw call of a file calls, by the first rule that applies:

    1. no dotted name: ``<dynamic>``, unresolved;
    2. ``self.x`` or ``cls.x``: the caller's parent's x if the caller has three parts or more, else unresolved;
    3. the head is an imported name (the file's last import of it counts): what it stands for, and the rest;
    4. the head is defined directly below the module: the module's;
    5. unresolved, as written.
    """
    names = {i.local_name: stands_for(i) for i in found.imports}
    prefix = f"{module}."
    tops = {d.qualname[len(prefix) :] for d in found.defs if d.qualname.startswith(prefix)}

    def dotted_callee(caller: str, raw: str) -> tuple[str, bool]:
        head, dot, rest = raw.partition(".")
        if head in ("self", "cls") and "." not in rest:
            return (f"{caller.rpartition('.')[0]}.{rest}", True) if caller.count(".") >= 2 else (raw, False)
        if head in names:
            return names[head] + dot + rest, True
        return (prefix + raw, True) if head in tops else (raw, False)

    calls = []
    for caller, raw, lineno in found.raw_calls:
        if raw is None:
            callee, resolved = "<dynamic>", False
        elif "." in raw:
            callee, resolved = dotted_callee(caller, raw)
        elif raw in names:
            callee, resolved = names[raw], True
        elif raw in tops:
            callee, resolved = prefix + raw, True
        else:
            callee, resolved = raw, False
        calls.append(Call(caller, raw, lineno, callee, resolved))
    return calls
