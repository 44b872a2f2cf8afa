"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (piecewise linear). The
integral of the schedule is the source's weight in the whole mix. Targets follow from
the weights; a source is never repeated more than ``max_repeat`` times, and what a
stopped source leaves over goes to the others by weight. The documents of a source lie
one after another, in the order of a digest, on an axis of cumulative words; a document
is taken as far as that axis, repeated, lies under the target. Inverting the source's
cumulative demand over time turns the place on the axis into a training position, and
the documents are range-sorted by it.

Everything is DataFrame expressions. The running sum within a source has two levels
(digest buckets, then within a bucket), so no task holds a whole source.

Defined results: a null text has no words, a document without words is taken 0 times,
a null source is a source of its own (the last), a null id counts as the empty string in
the digest, equal rows are taken one after another, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import known_id, materialize, row_digest, table, word_count

#: A schedule is a list of (time, weight) knots from time 0 to time 1.
Schedule = Sequence[tuple[float, float]]

#: The shapes rise, fall and stay; each has mean 1, so the weight of a source is its factor.
SHAPES: tuple[Schedule, ...] = (
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)
#: Hexadecimal digits of the digest that make a bucket of a source's axis.
BUCKET_DIGITS = 3


def schedules(weights: Sequence[float], shapes: Sequence[Schedule] = SHAPES) -> list[list[tuple[float, float]]]:
    """One schedule for each weight: the shapes in turn, scaled."""
    return [[(t, w * x) for t, w in shapes[i % len(shapes)]] for i, x in enumerate(weights)]


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _areas(knots: Schedule) -> list[float]:
    """The integral of a schedule up to each knot."""
    if len(knots) < 2 or any(w < 0 for _, w in knots) or any(a >= b for (a, _), (b, _) in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule needs two knots or more, rising times and no negative weight")
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    if not out[-1] > 0:
        raise ValueError("a schedule needs weight somewhere")
    return out


def source_targets(sized: DataFrame, plans: Sequence[Schedule], share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """One row for each source of ``sized`` (source, size): its size, weight, schedule and
    target. Sources take ``plans`` in turn by code point, null last.

    With a common level L, a source gets min(weight * L, max_repeat * size). Sorted by
    the level at which they stop, the first source that its level does not reach fixes L.
    Only source rows meet in one task here, never document rows.
    """
    areas = [_areas(p) for p in plans]
    pick = lambda rows: F.element_at(F.array(*[_array(r) for r in rows]), (F.col("_turn") + 1).cast("int"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    per = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_turn", (F.row_number().over(by_source) - 1) % len(plans))
        .withColumn("weight", F.element_at(_array([a[-1] for a in areas]), (F.col("_turn") + 1).cast("int")))
        .withColumn("_ts", pick([[t for t, _ in p] for p in plans]))
        .withColumn("_ws", pick([[w for _, w in p] for p in plans]))
        .withColumn("_as", pick(areas))
        .withColumn("_cap", F.col("source_size") * float(max_repeat))
    )
    stops = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    onward = stops.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = stops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        per.withColumn("_level", level)
        .withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
        .withColumn("_found", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(everywhere)["_level"])
        .withColumn(
            "target",
            F.when(F.col("_found").isNull() | (F.col("_cap") / F.col("weight") <= F.col("_found")), F.col("_cap")).otherwise(F.col("weight") * F.col("_found")),
        )
        .select("source", "source_size", "weight", "target", "_ts", "_ws", "_as")
    )


def training_time(share: Column) -> Column:
    """The time at which a source's demand reaches ``share`` (0..1) of its target.

    Within a segment the cumulative demand is a quadratic of time; its root is written
    so that a flat segment needs no case of its own.
    """
    area = share * F.element_at("_as", -1)
    k = F.least(F.greatest(F.size(F.filter("_as", lambda x: x <= area)), F.lit(1)), F.size("_as") - 1)
    at = lambda c, i: F.element_at(F.col(c), i)
    left = area - at("_as", k)
    slope = (at("_ws", k + 1) - at("_ws", k)) / (at("_ts", k + 1) - at("_ts", k))
    below = at("_ws", k) + F.sqrt(F.greatest(at("_ws", k) * at("_ws", k) + 2 * slope * left, F.lit(0.0)))
    return F.least(at("_ts", k) + F.when(below > 0, 2 * left / below).otherwise(F.lit(0.0)), F.lit(1.0))


def plan_mix(sized: DataFrame, plans: Sequence[Schedule], share: float = 1.5, max_repeat: float = 2.0, seed: str = "") -> DataFrame:
    """``sized`` (doc_id, source, size and any further columns) with source_size, target
    and the document's first word ``_at`` on its source's axis (0 for its first word).
    """
    sized = materialize(sized, "sized-documents")  # counts words once for its three readers
    targets = source_targets(sized.select("source", "size"), plans, share, max_repeat)
    keyed = sized.withColumn("_digest", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    starts = (
        keyed.groupBy("source", "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_start", F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum"))
        .drop("_sum")
    )
    inner = Window.partitionBy("source", "_bucket").orderBy("_digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("_in", F.sum("size").over(inner) - F.col("size"))
    s, t = starts.alias("s"), targets.withColumnRenamed("source", "_source")
    return (
        placed.alias("p")
        .join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p._bucket") == F.col("s._bucket")))
        .select("p.*", "_start")
        .join(t, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_at", F.col("_start") + F.col("_in"))
        .drop("_source", "_start", "_in", "_bucket")
    )


def _taken(copy: Column) -> Column:
    """Words of one copy of a document that lie under its source's target."""
    over = F.floor(F.col("target") + 0.5).cast("long") - (copy * F.col("source_size") + F.col("_at"))
    return F.greatest(F.lit(0).cast("long"), F.least(over, F.col("size")))


def _copies(max_repeat: float) -> int:
    return max(1, int(-(-max_repeat // 1)))


def taken_words(planned: DataFrame, max_repeat: float = 2.0) -> DataFrame:
    """Adds ``taken``: the words that the mix takes of a document, repeats counted."""
    total = sum((_taken(F.lit(k)) for k in range(_copies(max_repeat))), F.lit(0).cast("long"))
    return planned.withColumn("taken", total)


def _position(copy: Column) -> Column:
    """The training time at which a copy of a document begins."""
    return training_time((copy * F.col("source_size") + F.col("_at")) / F.col("target"))


def copy_positions(planned: DataFrame, max_repeat: float = 2.0) -> DataFrame:
    """Adds ``positions``: the training position (0..1) of each copy that the mix takes,
    in order; null for a copy that it does not take."""
    return planned.withColumn("positions", F.array(*[F.when(_taken(F.lit(k)) > 0, _position(F.lit(k))) for k in range(_copies(max_repeat))]))


def training_order(planned: DataFrame, max_repeat: float = 2.0, ordered: bool = True) -> DataFrame:
    """One row for each taken copy of a document, range-sorted by training position unless
    the caller sorts: adds copy, words (its words that are taken) and position (0..1)."""
    copies = planned.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(_copies(max_repeat) - 1))))
    placed = copies.withColumn("words", _taken(F.col("copy"))).where("words > 0")
    timed = placed.withColumn("position", _position(F.col("copy")))
    return timed.orderBy("position", "_digest", "doc_id", "copy") if ordered else timed


def mix_documents(docs: DataFrame, plans: Sequence[Schedule], share: float = 1.5, max_repeat: float = 2.0, seed: str = "") -> DataFrame:
    """The mixed documents in training order, in the columns of ``docs``: a document
    appears once for each copy that is taken, with its whole text. The one copy in which
    its source's target ends is taken if the target covers half of it or more.

    Only keys and numbers are planned; the texts join the plan once. Equal rows are equal
    in every column, so one of them stands for all: each map task sends one, however many
    rows are alike, and the plan says how often it is taken.
    """
    names = docs.columns
    key = (known_id(F.col("doc_id")).alias("_id"), row_digest(docs).alias("_row"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *key)
    planned = plan_mix(sized, plans, share, max_repeat, seed)
    order = training_order(planned, max_repeat, ordered=False).where("2 * words >= size").select("_id", "_row", "copy", "_at", "position", "_digest")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), *key)
    one = packed.withColumn("_twin", F.row_number().over(Window.partitionBy("_id", "_row").orderBy(F.lit(0)))).where("_twin = 1").drop("_twin")
    return one.join(order, ["_id", "_row"]).orderBy("position", "_digest", "copy", "_at").select(*[F.col("_doc")[c].alias(c) for c in names])


#: The weights of the query's sources, in turn.
WEIGHTS = (3.0, 1.0, 2.0)


def op10(spark, sf_dir: str) -> DataFrame:
    """One row for each document, range-sorted by the training position of its first copy;
    ``position`` and ``second_position`` are null for a copy that is not taken."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed = copy_positions(taken_words(plan_mix(sized, schedules(WEIGHTS))))
    place = lambda k: F.round(F.get("positions", F.lit(k)), 9)
    return placed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "_digest", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "source", place(0).alias("position"), place(1).alias("second_position"))


def _segments_sql() -> str:
    """The segments of the query's schedules: turn, begin and end, weights there, the area
    before and that of the whole schedule."""
    rows = []
    for turn, knots in enumerate(schedules(WEIGHTS)):
        areas = _areas(knots)
        rows += [(turn, t0, t1, w0, w1, a, areas[-1]) for (t0, w0), (t1, w1), a in zip(knots, knots[1:], areas, strict=False)]
    return ", ".join("(" + ", ".join(str(r[0]) if k == 0 else f"{x!r}::DOUBLE" for k, x in enumerate(r)) + ")" for r in rows)


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
seg(turn, t0, t1, w0, w1, a0, whole) AS (VALUES {_segments_sql()}),
v AS (SELECT s.*, whole AS weight FROM s JOIN (SELECT DISTINCT turn, whole FROM seg) USING (turn)),
l AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS stop,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM v WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size, turn, weight,
         CASE WHEN f.level IS NULL OR stop <= f.level THEN cap ELSE weight * f.level END AS target
  FROM l LEFT JOIN (SELECT arg_min(level, stop) AS level FROM l WHERE stop > level) f ON true),
a AS (
  SELECT d.*, t.source_size, t.target, t.turn, t.weight,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS DOUBLE) AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, row_number() OVER () AS r FROM a),
k AS (
  SELECT c.*, copy, CAST(greatest(0, least(floor(target + 0.5) - (copy * source_size + begins), size)) AS BIGINT) AS words,
         (copy * source_size + begins) / target * weight AS area
  FROM c, (VALUES (0), (1)) n(copy)),
p AS (
  SELECT r, copy, max_by(least(t0 + CASE WHEN w0 + sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * (area - a0), 0.0::DOUBLE)) > 0
           THEN 2 * (area - a0) / (w0 + sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / (t1 - t0)) * (area - a0), 0.0::DOUBLE))) ELSE 0 END, 1.0::DOUBLE), t0) AS place
  FROM k JOIN seg USING (turn) WHERE words > 0 AND (a0 <= area OR t0 = 0) GROUP BY r, copy)
SELECT c.doc_id, c.size, CAST(c.source_size AS BIGINT) AS source_size, c.target, one.words + two.words AS taken, c.source,
       round(p0.place, 9) AS position, round(p1.place, 9) AS second_position
FROM c JOIN k one ON one.r = c.r AND one.copy = 0 JOIN k two ON two.r = c.r AND two.copy = 1
LEFT JOIN p p0 ON p0.r = c.r AND p0.copy = 0 LEFT JOIN p p1 ON p1.r = c.r AND p1.copy = 1
"""
