"""Schemas of the engine's tables, as DDL.

``seq`` columns carry the order in which a single pass over sorted files would meet the
rows; wherever two rows tie, the lower seq comes first.
"""

from __future__ import annotations

SOURCE_FILES = "file_seq long, rel_path string, module string, content string, is_package_init boolean, error string"

CHUNK = "file_path string, qualname string, kind string, start_line int, end_line int, text string, docstring string, decorators array<string>, class_name string"
DEF = "qualname string, kind string, lineno int, end_lineno int, class_name string"
IMPORT = "local_name string, imported_module string, imported_symbol string, lineno int"
RAW_CALL = "caller string, raw string, lineno int, callee string, resolved boolean"

#: One row for each file: what its one parse found, or why there was none.
FILE_ANALYSIS = (
    "file_seq long, rel_path string, module string, error string, "
    + ", ".join(f"{name} array<struct<{fields.replace(' array<string>', ':array<string>').replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>" for name, fields in (("chunks", CHUNK), ("defs", DEF), ("imports", IMPORT), ("raw_calls", RAW_CALL)))
)

CHUNKS = f"chunk_seq long, chunk_id string, {CHUNK}"
DEFS = f"module string, seq long, {DEF}"
IMPORTS = f"module string, seq long, {IMPORT}, resolved string"
CALLS = "module string, seq long, caller string, callee string, lineno int, resolved boolean"
NODES = "qualname string, kind string, module string, class_name string"
EDGES = "edge_seq long, src string, dst string, type string, lineno int, resolved boolean"
VECTORS = "chunk_id string, embedding array<float>, kind string"

MESSAGES = "conv_id string, turn int, role string, content string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
QA_QUESTIONS = "id string, question string, expected_qualnames array<string>, expected_keywords array<string>"
IMPACT_QUESTIONS = "id string, target string, expected_direct_callers array<string>, expected_tests array<string>"
BENCHMARK_REPOS = "name string, url string, ref string, commit string, package_root string"

KINDS = ("module", "class", "function", "method")
ROLES = ("system", "user", "assistant", "tool")
