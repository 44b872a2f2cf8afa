"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import drop_table, materialize, partitions, session_of

ROWS_OF_A_FILE = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a string, b string) -> (node, component): the least node of each component.

    Each round every node takes the least label among itself and its neighbours, then the
    label of that label, so the distance that a label travels doubles each round. The
    rounds end when nothing changes; each is written to the shared folder. Shuffles carry
    one row for each edge end; the least label is formed on the map side, so a node with
    many edges costs no more than its edges.
    """
    both = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    # Tables of a round have files in proportion to the edges, not one for each partition.
    files = min(partitions(session_of(edges)), 1 + both.count() // ROWS_OF_A_FILE)
    both = both.unionAll(both.select("b", "a"))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node").coalesce(files), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("least"))
        of = labels.select(F.col("node").alias("through"), F.col("label").alias("jump"))
        step = materialize(hop.join(of, F.col("least") == F.col("through"), "left").select("node", F.least("least", F.coalesce("jump", "least")).alias("new"), "label").coalesce(files), "labels")
        changed = step.where("new <> label").limit(1).count()
        drop_table(labels)
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
