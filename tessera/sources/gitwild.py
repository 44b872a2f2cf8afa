"""Git's ignore patterns, compiled to regular expressions over relative posix paths."""

from __future__ import annotations

import re
from dataclasses import dataclass


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:[^/]+/)*"
            i += 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out += ".+"
            i += 2
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(glob):
            out += re.escape(glob[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    return out


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern[str]
    negated: bool
    directories_only: bool


def compile_rule(line: str) -> Rule | None:
    """A rule, or None for blank lines and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only = line.endswith("/")
    line = line.rstrip("/") if only else line
    if not line:
        return None
    anchored = "/" in line
    body = _translate(line.lstrip("/"))
    return Rule(re.compile(("" if anchored else "(?:.*/)?") + body), negated, only)


class Ignore:
    """The last rule that matches a path, or a directory above it, decides."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(compile_rule, lines) if r]

    def __call__(self, path: str, directory: bool = False) -> bool:
        parts = path.split("/")
        ignored = False
        for i in range(1, len(parts) + 1):
            prefix, is_dir = "/".join(parts[:i]), i < len(parts) or directory
            for rule in self.rules:
                if (is_dir or not rule.directories_only) and rule.regex.fullmatch(prefix):
                    ignored = not rule.negated
            if ignored and i < len(parts):
                return True  # what is below an ignored directory cannot be taken back
        return ignored
