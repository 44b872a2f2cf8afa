"""Source files -> chunks, definitions, imports and resolved calls.

One parse of each file yields everything, in one row, so a file that does not parse is
missing everywhere. Names are resolved while the file is parsed, without a join or a
shuffle. A worker holds the parts of a few files at once, however many a batch brings.
"""

from __future__ import annotations

import ast
import gc
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from tessera.functions import pystructure
from tessera.schemas import CHUNK, FILE_ANALYSIS


#: What an analysis can hold of a file.
PARTS = ("chunks", "defs", "imports", "raw_calls")
#: Files, and bytes of their text, whose parts a worker holds at once; a single file may be longer.
FILES, BYTES = 64, 1 << 18


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = [n or 0 for n in pc.binary_length(batch["content"]).to_pylist()]
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (held + n > BYTES or i - begin == FILES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def _parts_of(module: str, path: str, content: str, is_package_init: bool, parts: Sequence[str]) -> dict[str, list]:
    """The parts that are asked for, of one parse. Whether a file has an error does not depend on them."""
    tree, found = ast.parse(content), {}
    if "chunks" in parts:
        found["chunks"] = list(pystructure.chunks(module, path, content, tree))
    if any(p != "chunks" for p in parts):
        symbols = pystructure.symbols(module, content, is_package_init, tree, "raw_calls" in parts)
        found |= {"defs": symbols.defs, "imports": symbols.imports}
        if "raw_calls" in parts:
            found["raw_calls"] = pystructure.resolve(module, symbols)
    return found


def _lists(column: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as lists of structs, made field by field, which is faster than row by row."""
    fields = list(kind.value_type)
    rows = list(itertools.chain.from_iterable(column))
    values = zip(*rows) if rows else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
    offsets = list(itertools.accumulate(map(len, column), initial=0))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=kind)


def _analyze(schema: pa.Schema, parts: Sequence[str]):
    def analyzed(piece: pa.RecordBatch) -> pa.RecordBatch:
        errors, columns = piece["error"].to_pylist(), {k: [] for k in PARTS}
        for i, (module, path, content, init) in enumerate(zip(*(piece[c].to_pylist() for c in ("module", "rel_path", "content", "is_package_init")), strict=True)):
            found: dict[str, list] = {}
            if errors[i] is None:
                try:
                    found = _parts_of(module, path, content, init, parts)
                except (SyntaxError, ValueError, RecursionError) as x:
                    errors[i] = f"syntax error ({x})"
            for k, column in columns.items():
                column.append(found.get(k, []) if k in parts else [])
        named = {"file_seq": piece["file_seq"], "rel_path": piece["rel_path"], "module": piece["module"], "error": pa.array(errors, pa.string())}
        named |= {k: _lists(column, schema.field(k).type) for k, column in columns.items()}
        return pa.RecordBatch.from_arrays([named[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                # A parse makes very many objects without cycles; looking for cycles among them takes as long as the parse.
                collects = gc.isenabled()
                gc.disable()
                try:
                    made = analyzed(piece)
                finally:
                    if collects:
                        gc.enable()
                yield made

    return run


def analyze(files: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """``SOURCE_FILES`` -> ``FILE_ANALYSIS``: one row for each file, with its error or its parts.
    ``parts``: those that are asked for, where not all are; the others' arrays are empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(FILE_ANALYSIS))
    return files.mapInArrow(_analyze(schema, parts), FILE_ANALYSIS)


def chunks(analysis: DataFrame) -> DataFrame:
    """``CHUNKS``. Call it on an analysis that is sorted by file: chunk_seq then rises in
    file order and, within a file, in emission order."""
    return analysis.select(F.explode("chunks").alias("c")).select(F.monotonically_increasing_id().alias("chunk_seq"), F.concat_ws("::", "c.file_path", "c.qualname").alias("chunk_id"), "c.*")


def _resolved_import(i: Column) -> Column:
    return F.when(F.coalesce(i["imported_symbol"], F.lit("")) != "", F.concat_ws(".", i["imported_module"], i["imported_symbol"])).otherwise(i["imported_module"])


def definitions(analysis: DataFrame) -> DataFrame:
    d = analysis.select("file_seq", "module", F.posexplode("defs").alias("pos", "d"))
    return d.select("file_seq", "module", F.col("pos").cast("long").alias("seq"), "d.*")


def imports(analysis: DataFrame) -> DataFrame:
    i = analysis.select("file_seq", "module", F.posexplode("imports").alias("pos", "i"))
    return i.select("file_seq", "module", F.col("pos").cast("long").alias("seq"), "i.*", _resolved_import(F.col("i")).alias("resolved"))


def calls(analysis: DataFrame) -> DataFrame:
    """``CALLS`` (with file_seq), as :func:`pystructure.resolve` resolved them within each file."""
    c = analysis.select("file_seq", "module", F.posexplode("raw_calls").alias("pos", "c"))
    return c.select("file_seq", "module", F.col("pos").cast("long").alias("seq"), "c.caller", "c.callee", "c.lineno", "c.resolved")


@udtf(returnType=CHUNK)
class PythonChunks:
    """SQL: ``SELECT c.* FROM files, LATERAL python_chunks(module, rel_path, content) c``."""

    def eval(self, module: str, rel_path: str, content: str):
        yield from pystructure.chunks(module, rel_path, content)


@udtf(returnType="tag string, qualname string, name string, origin string, symbol string, kind string, lineno int, end_lineno int, class_name string")
class PythonSymbols:
    """SQL: tagged rows (def, import, call) of a file: ``python_symbols(module, content, is_package_init)``."""

    def eval(self, module: str, content: str, is_package_init: bool):
        found = pystructure.symbols(module, content, bool(is_package_init))
        for d in found.defs:
            yield "def", d.qualname, None, None, None, d.kind, d.lineno, d.end_lineno, d.class_name
        for i in found.imports:
            yield "import", None, i.local_name, i.imported_module, i.imported_symbol, None, i.lineno, None, None
        for c in found.raw_calls:
            yield "call", c.caller, c.raw, None, None, None, c.lineno, None, None


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("python_chunks", PythonChunks)
    spark.udtf.register("python_symbols", PythonSymbols)
