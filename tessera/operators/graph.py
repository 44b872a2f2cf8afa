"""The call/import multigraph and its queries, each over a batch of targets.

Edges keep every call site. ``edge_seq`` is the order in which a pass over the files
would add them; it breaks all ties. Targets are a DataFrame with a column ``target``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import structure
from tessera.session import new_folder

MAX_DEPTH = 5


def import_edges(imports: DataFrame) -> DataFrame:
    """Distinct (module, imported_module) with a non-empty imported module."""
    return imports.where("imported_module <> ''").select("module", "imported_module").distinct()


def build_edges(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``EDGES``: call sites in file order, then the distinct import edges."""
    sites = calls.select(F.lit(0).alias("_k"), "file_seq", "seq", F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("type"), "lineno", "resolved")
    firsts = imports.where("imported_module <> ''").groupBy("module", "imported_module").agg(F.min(F.struct("file_seq", "seq")).alias("f"))
    between = firsts.select(F.lit(1).alias("_k"), "f.file_seq", "f.seq", F.col("module").alias("src"), F.col("imported_module").alias("dst"), F.lit("import").alias("type"), F.lit(None).cast("int").alias("lineno"), F.lit(None).cast("boolean").alias("resolved"))
    return sites.unionByName(between).orderBy("_k", "file_seq", "seq").select(F.monotonically_increasing_id().alias("edge_seq"), "src", "dst", "type", "lineno", "resolved")


def build_nodes(modules: DataFrame, definitions: DataFrame) -> DataFrame:
    """``NODES``: modules and definitions; of several with one name each attribute has the
    last value that was set (a module sets only its kind)."""
    of_modules = modules.select(F.col("module").alias("qualname"), "file_seq", F.lit(-1).cast("long").alias("seq"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("class_name"), F.lit(False).alias("defined"))
    of_defs = definitions.select("qualname", "file_seq", "seq", "kind", "module", "class_name", F.lit(True).alias("defined"))
    return _last_set(of_modules.unionByName(of_defs))


def _last_set(rows: DataFrame) -> DataFrame:
    at = F.struct("file_seq", "seq")
    last = lambda name, when=None: F.max_by(F.struct(name), F.when(when, at) if when is not None else at)[name].alias(name)
    return rows.groupBy("qualname").agg(last("kind"), last("module", F.col("defined")), last("class_name", F.col("defined")))


def file_nodes(analysis: DataFrame) -> DataFrame:
    """:func:`build_nodes` of an analysis (its ``defs``) that is not stored: a file is parsed once for
    its module and its definitions."""
    none = F.lit(None)
    own = F.struct(F.col("module").alias("qualname"), F.lit("module").alias("kind"), none.cast("int").alias("lineno"), none.cast("int").alias("end_lineno"), none.cast("string").alias("class_name"))
    each = analysis.where("error IS NULL").select("file_seq", "module", F.posexplode(F.concat(F.array(own), "defs")).alias("pos", "d"))
    defined = F.col("pos") > 0
    return _last_set(each.select("d.qualname", "file_seq", (F.col("pos") - 1).cast("long").alias("seq"), "d.kind", F.when(defined, F.col("module")).alias("module"), "d.class_name", defined.alias("defined")))


def file_edges(files: DataFrame) -> DataFrame:
    """src, dst, type, lineno, resolved: the edges of :func:`build_edges`, in no order, of
    ``SOURCE_FILES``. A file is parsed once; the import edges of a module that is one file's alone are made
    distinct where the file is, and only those of modules with several files are shuffled."""
    shared = files.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("module")
    empty = shared.isEmpty()
    analysis = structure.analyze(files, ("raw_calls", "imports"))
    ours = F.col("imports") if empty else F.when(F.col("shared").isNull(), F.col("imports")).otherwise(F.array())
    if not empty:
        analysis = analysis.join(sent(shared.withColumn("shared", F.lit(True))), "module", "left")
    edge = lambda src, dst, kind, lineno, resolved: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), lineno.alias("lineno"), resolved.alias("resolved"))
    bring = lambda dst: edge(F.col("module"), dst, "import", F.lit(None).cast("int"), F.lit(None).cast("boolean"))
    calls = F.transform("raw_calls", lambda c: edge(c["caller"], c["callee"], "call", c["lineno"], c["resolved"]))
    brings = F.transform(F.filter(F.array_distinct(ours["imported_module"]), lambda m: m != ""), bring)
    edges = analysis.select(F.inline(F.concat(calls, brings)))
    if empty:
        return edges
    others = structure.analyze(files.join(sent(shared), "module", "left_semi"), ("imports",))
    return edges.unionByName(import_edges(structure.imports(others)).select(bring(F.col("imported_module")).alias("e")).select("e.*"))


def node_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qualname of every node, as often as something names it: the defined ones, and the
    ends of edges (unresolved callees, external modules) that no definition stands behind."""
    return nodes.select("qualname").unionAll(edges.select("src")).unionAll(edges.select("dst"))


def node_universe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return node_names(nodes, edges).distinct()


def _resolved_calls(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'call' AND resolved")


def caller_sites(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, caller, lineno, edge_seq: a row for each resolved call site."""
    return _resolved_calls(edges).join(targets, F.col("dst") == F.col("target")).select("target", F.col("src").alias("caller"), "lineno", "edge_seq")


def _names(sites: DataFrame, name: str, out: str) -> DataFrame:
    return sites.groupBy("target").agg(F.sort_array(F.collect_set(name)).alias(out))


def direct_callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, callers: the sorted distinct callers of targets that have any."""
    return _names(caller_sites(edges, targets), "caller", "callers")


def callee_sites(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return _resolved_calls(edges).join(targets, F.col("src") == F.col("target")).select("target", F.col("dst").alias("callee"), "lineno", "edge_seq")


def callees(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return _names(callee_sites(edges, targets), "callee", "callees")


def unresolved_calls(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, callee, edge_seq: a row for each unresolved call site of a target."""
    return edges.where("type = 'call' AND NOT resolved").join(targets, F.col("src") == F.col("target")).select("target", F.col("dst").alias("callee"), "edge_seq")


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, importers: the sorted modules with an import edge to exactly that module."""
    return _names(edges.where("type = 'import'").join(targets, F.col("dst") == F.col("target")).select("target", F.col("src").alias("importer")), "importer", "importers")


def transitive_callers(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """target, caller, depth, lineno, position: callers within ``max_depth`` steps, each
    once, the target never. lineno is that of the call site that discovered the caller
    first: level by level, parents in their order, their callers in edge order.

    position is the edge_seq of each call site on the way from the target. Within a level
    that array's order is the order of discovery, so nothing ranks a target's callers in one
    task. Parallel call sites of one caller and callee are first reduced to the earliest. Who
    is found at which level is known by :func:`_levels`, as bits, so no way is made to a caller that
    was known before. Steps lie in blocks by name, and the ways into a block go on there: of all ways
    to one caller that lead through a block only the first is sent on (:func:`_ways`).
    """
    spark, numbered = edges.sparkSession, _numbered(targets)
    calls = _resolved_calls(edges).select("dst", F.col("src").alias("caller"), "edge_seq", "lineno")
    first = (F.min("edge_seq").alias("edge_seq"), F.min_by("lineno", "edge_seq").alias("lineno"))
    steps = _in_blocks(spark, calls, calls.count() * numbered.count() // WAYS, first)  # every level goes through it
    homes = steps.select(F.col("caller").alias("node"), F.col("block").alias("to")).distinct()
    none = [F.lit(None).cast("long").alias(w) for w in _WORDS]
    frontier, out = numbered.select("group", "bit", F.col("target").alias("caller"), F.array().cast("array<long>").alias("position")), None
    for depth, fresh in enumerate(_levels(steps.select("dst", "caller", "block"), numbered, max_depth), 1):
        if depth == max_depth:
            fresh = _cut(spark, fresh)  # the others are stored
        if frontier.count() <= FEW:
            into = steps.join(F.broadcast(frontier.select("group", "bit", F.col("caller").alias("dst"), "position")), "dst")
            new = into.join(sent(fresh.withColumnRenamed("node", "caller")), ["group", "caller"]).where(_has(F.col("bit")))
            ways = new.select("group", "bit", "caller", "lineno", F.array_append("position", F.col("edge_seq")).alias("position"))
        else:
            wanted = fresh.join(homes, "node").select("to", "group", "node", F.lit(None).cast("int").alias("bit"), F.lit(None).cast("array<long>").alias("position"), *_WORDS)
            # A way goes on to the blocks where its target has a new caller; there is a row for each block and group.
            open_ = F.broadcast(wanted.groupBy("to", "group").agg(*[F.bit_or(w).alias(w) for w in _WORDS]))
            front = _sent_to_blocks(frontier.withColumnRenamed("caller", "node"), steps).join(open_, ["to", "group"]).where(_has(F.col("bit"))).select("to", "group", "node", "bit", "position", *none)
            ways = front.unionByName(wanted).groupBy("to").cogroup(steps.groupBy("block")).applyInArrow(_ways(depth), "group long, bit int, caller string, lineno int, position array<long>")
        by = F.min(F.struct("position", "lineno")).alias("by")
        frontier = _cut(spark, ways.groupBy("group", "bit", "caller").agg(by).select("group", "bit", "caller", F.lit(depth).alias("depth"), "by.lineno", "by.position"))
        out = frontier if out is None else out.unionAll(frontier)
    if out is None:
        return numbered.where("false").select("target", F.col("target").alias("caller"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("lineno"), F.array().cast("array<long>").alias("position"))
    return out.join(F.broadcast(numbered) if numbered.count() <= FEW else numbered, ["group", "bit"]).select("target", "caller", "depth", "lineno", "position")


#: Steps times targets of one block, about, and steps that a task takes from ways at once.
WAYS, TAKEN = 60_000_000, 2_000_000


def _ways(depth: int):
    """What a block does with the ways of ``depth`` - 1 steps that come into it (rows with a bit) and the
    bits of the targets that its callers are new to (rows without): the first way, in the order of
    positions, to each caller and target that leads through the block."""

    def empty() -> pa.Table:
        return pa.schema([("group", pa.int64()), ("bit", pa.int32()), ("caller", pa.string()), ("lineno", pa.int32()), ("position", pa.list_(pa.int64()))]).empty_table()

    def run(mixed: pa.Table, steps: pa.Table) -> pa.Table:
        names = pc.unique(steps["dst"])
        coded = pc.dictionary_encode(steps["caller"]).combine_chunks()
        coming = pc.is_valid(mixed["bit"])
        front, asked = mixed.filter(coming), mixed.filter(pc.invert(coming))
        front = front.filter(pc.is_in(front["node"], value_set=names))
        if not len(front) or not len(asked):
            return empty()
        into = pc.index_in(steps["dst"], value_set=names).to_numpy()
        order = np.argsort(into, kind="stable")
        number = np.bincount(into, minlength=len(names))
        start = np.cumsum(number) - number
        caller, edge = coded.indices.to_numpy()[order], steps["edge_seq"].to_numpy()[order]
        at, group, bit = pc.index_in(front["node"], value_set=names).to_numpy(), front["group"].to_numpy(), front["bit"].to_numpy()
        position = front["position"].combine_chunks().flatten().to_numpy().reshape(len(front), depth - 1)
        ranked = np.lexsort((*position.T[::-1], bit, group))  # ways of one target stand together, the first first
        at, group, bit, position = at[ranked], group[ranked], bit[ranked], position[ranked]
        who, of = pc.index_in(asked["node"], value_set=coded.dictionary).to_numpy(), asked["group"].to_numpy()
        found = []
        for g in np.unique(group):
            new, mine = np.zeros((len(coded.dictionary), WORDS), np.int64), np.flatnonzero(of == g)
            for w, name in enumerate(_WORDS):
                new[who[mine], w] = asked[name].to_numpy()[mine]
            lo, hi = np.searchsorted(group, [g, g + 1])
            firsts = lo + np.flatnonzero(np.diff(bit[lo:hi], prepend=-1))  # where each target begins
            taken = np.concatenate([[0], np.cumsum(number[at[lo:hi]])])
            while len(firsts):
                ends = np.append(firsts[1:], hi)
                n = max(1, np.searchsorted(taken[ends - lo], taken[firsts[0] - lo] + TAKEN, "right"))
                rows = np.arange(firsts[0], ends[n - 1])
                firsts = firsts[n:]
                many = number[at[rows]]
                row = np.repeat(rows, many)
                step = start[at[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                to = caller[step]
                keep = (new[to, bit[row] // BITS] >> (bit[row] % BITS)) & 1 == 1
                row, step, to = row[keep], step[keep], to[keep]
                _, best = np.unique(bit[row].astype(np.int64) * len(new) + to, return_index=True)
                row, step, to = row[best], step[best], to[best]
                way = np.concatenate([position[row], edge[step][:, None]], axis=1)
                ways = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * depth + 1, depth), pa.int32()), pa.array(way.reshape(-1)))
                columns = [np.full(len(row), g), pa.array(bit[row], pa.int32()), coded.dictionary.take(pa.array(to)), steps["lineno"].take(pa.array(order[step])), ways]
                found.append(pa.table(columns, names=["group", "bit", "caller", "lineno", "position"]))
        return pa.concat_tables(found)

    return run


#: Targets that one number has a bit for, and numbers of one row.
BITS, WORDS = 63, 8
#: Targets that are numbered in one part, about.
PART = 4096
#: Targets that are sent to every task.
FEW = 1 << 16
_WORDS = [f"bits{w}" for w in range(WORDS)]


def _numbered(targets: DataFrame) -> DataFrame:
    """target, group, bit: a number below BITS * WORDS in its group for each different target.
    Numbers run within parts of bounded size, so no window is over all targets, and as
    few groups as the targets need are only partly filled."""
    named = targets.select("target").where("target IS NOT NULL").distinct()
    parts = max(1, named.count() // PART)
    at = F.row_number().over(Window.partitionBy("part").orderBy("target")) - 1
    dealt = named.withColumn("part", F.pmod(F.xxhash64("target"), F.lit(parts))).withColumn("at", at)
    group = F.floor(F.col("at") / (BITS * WORDS)) * parts + F.col("part")
    return _cut(targets.sparkSession, dealt.select("target", group.alias("group"), (F.col("at") % (BITS * WORDS)).cast("int").alias("bit")))


def _has(bit: Column) -> Column:
    """Is the bit of that number set in its row's words?"""
    word = F.get(F.array(*_WORDS), F.floor(bit / BITS).cast("int"))
    return F.call_function("shiftright", word, bit % BITS).bitwiseAND(F.lit(1)) == 1


#: Words of targets that the steps of one block pass on, about.
BLOCK = 4_000_000


def _laid(pairs: DataFrame, numbered: DataFrame) -> DataFrame:
    """The stored call steps ``pairs`` (dst, caller) as :func:`_levels` takes them. A group of targets
    sends each step at most once, so for one group they stay as they are. For more they are cut
    by name into blocks of about equal size: what a module's functions call lies in few
    blocks, and a caller gets one row from each block and group, not one for each step. Steps into one
    function may fill several blocks."""
    groups = numbered.select("group").distinct().count()
    if groups < 2:
        return pairs
    return _in_blocks(pairs.sparkSession, pairs, pairs.count() * groups // BLOCK)


def _in_blocks(spark: SparkSession, steps: DataFrame, blocks: int, once: tuple[Column, ...] = ()) -> DataFrame:
    """Stored, with a column ``block``: ranges of names, at least as many as there are cores.
    ``once``: what becomes of the rows of one step, where a step is to be there once."""
    dealt = steps.repartitionByRange(max(spark.sparkContext.defaultParallelism, blocks), "dst", "caller")
    if once:
        dealt = dealt.groupBy("dst", "caller").agg(*once)  # where they lie
    return _cut(spark, dealt.withColumn("block", F.spark_partition_id()))


def _sent_to_blocks(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """``frontier`` with ``to``: each block that can have steps into a row's node."""
    ends = steps.groupBy(F.col("block").alias("to")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))  # one row for each block
    return frontier.join(F.broadcast(ends), (F.col("node") >= F.col("lo")) & (F.col("node") <= F.col("hi"))).drop("lo", "hi")


def _united(front: pa.Table, steps: pa.Table) -> pa.Table:
    """A block's callers, each with the united bits of those that it calls, group by group."""
    names = pc.unique(front["node"])
    at = pc.index_in(steps["dst"], value_set=names).combine_chunks()
    steps, at = steps.filter(at.is_valid()), at.drop_null().to_numpy()
    callers = pc.dictionary_encode(steps["caller"]).combine_chunks()
    if not len(at):
        return pa.schema([("node", pa.string()), ("group", pa.int64()), *((w, pa.int64()) for w in _WORDS)]).empty_table()
    code = callers.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    at, starts = at[order], np.flatnonzero(np.diff(code[order], prepend=-1))
    of, group = pc.index_in(front["node"], value_set=names).to_numpy(), front["group"].to_numpy()
    bits = [front[w].to_numpy() for w in _WORDS]
    found = []
    for g in np.unique(group):
        rows, words = np.flatnonzero(group == g), []
        for w in bits:
            own = np.zeros(len(names), np.int64)
            own[of[rows]] = w[rows]
            words.append(np.bitwise_or.reduceat(own[at], starts))
        some = np.flatnonzero(np.any(words, axis=0))
        found.append(pa.table({"node": callers.dictionary.take(pa.array(some)), "group": np.full(len(some), g), **{n: w[some] for n, w in zip(_WORDS, words)}}))
    return pa.concat_tables(found)


def _reached(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """node, group and bits, not yet united, of the callers of ``frontier``."""
    few = frontier.count() <= FEW
    if few or "block" not in steps.columns:
        sent = frontier.withColumnRenamed("node", "dst")
        return steps.join(F.broadcast(sent) if few else sent, "dst").select(F.col("caller").alias("node"), "group", *_WORDS)
    return _sent_to_blocks(frontier, steps).groupBy("to").cogroup(steps.groupBy("block")).applyInArrow(_united, f"node string, group long, {', '.join(f'{w} long' for w in _WORDS)}")


def _levels(steps: DataFrame, numbered: DataFrame, max_depth: int) -> list[DataFrame]:
    """For each depth node, group and the bits of the targets that first reach it there, as
    long as there are any (the last may be empty, and is not stored). A level is one step to the
    callers and one bitwise or for each node, of what is reached and of what the node had."""
    spark, key = steps.sparkSession, ["node", "group"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % BITS)
    own = [F.when(F.floor(F.col("bit") / BITS) == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(_WORDS)]
    none = F.lit(0).cast("long")
    seen = frontier = numbered.select(F.col("target").alias("node"), "group", *own).groupBy(*key).agg(*[F.bit_or(w).alias(w) for w in _WORDS])
    levels = []
    for depth in range(1, max_depth + 1):
        reached = _reached(frontier, steps).select(*key, *_WORDS, *[none.alias(f"had_{w}") for w in _WORDS])
        had = seen.select(*key, *[none.alias(w) for w in _WORDS], *[F.col(w).alias(f"had_{w}") for w in _WORDS])
        both = reached.unionByName(had).groupBy(*key).agg(*[F.bit_or(w).bitwiseAND(F.bitwise_not(F.bit_or(f"had_{w}"))).alias(w) for w in _WORDS])
        frontier = both.where(" OR ".join(f"{w} <> 0" for w in _WORDS))
        if depth < max_depth:
            frontier = _cut(spark, frontier)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        levels.append(frontier)
    return levels


def reachable_callers(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """target, caller, depth: the rows of :func:`transitive_callers`, without the ways.

    The search goes from all targets at once. Targets are numbered, and what a level keeps is a
    row for each node and group of BITS * WORDS targets: the bits of those that reached it, so
    its rows are bounded by nodes and groups, not by pairs. A step that is there more than
    once unites the same bits again.
    """
    numbered = _numbered(targets)
    pairs = _cut(edges.sparkSession, _resolved_calls(edges).where("dst IS NOT NULL AND src IS NOT NULL").select("dst", F.col("src").alias("caller")))
    every = None
    for depth, fresh in enumerate(_levels(_laid(pairs, numbered), numbered, max_depth), 1):
        level = fresh.withColumn("depth", F.lit(depth))
        every = level if every is None else every.unionByName(level)
    if every is None:
        return numbered.where("false").select("target", F.col("target").alias("caller"), F.lit(0).alias("depth"))
    words = every.select("node", "group", "depth", F.posexplode(F.array(*_WORDS)).alias("word", "bits")).where("bits <> 0")
    asked = numbered.select("target", "group", F.floor(F.col("bit") / BITS).cast("int").alias("word"), (F.col("bit") % BITS).alias("at"))
    set_ = F.call_function("shiftright", F.col("bits"), F.col("at")).bitwiseAND(F.lit(1)) == 1
    return words.join(F.broadcast(asked) if numbered.count() <= FEW else asked, ["group", "word"]).where(set_).select("target", F.col("node").alias("caller"), "depth")


def sent(df: DataFrame) -> DataFrame:
    """``df``, marked to be sent to every task where it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A level as a table: written where the session names a shared folder, else cached
    (which recomputes what is lost)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        path = new_folder(spark, "level")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()


def index_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: functions and methods, classes, resolved and unresolved call sites."""
    n = nodes.agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions_methods"), F.count_if(F.col("kind") == "class").alias("classes"))
    e = edges.agg(F.count_if((F.col("type") == "call") & F.col("resolved")).alias("resolved_calls"), F.count_if((F.col("type") == "call") & ~F.col("resolved")).alias("unresolved_calls"))
    return n.crossJoin(e)  # one row each


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent(name: Column) -> Column:
    """What is before the last dot; the whole name where there is none."""
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
