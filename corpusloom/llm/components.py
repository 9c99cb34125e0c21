"""Connected components of a graph in tables, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node reachable; and ``was``) of every node of ``edges`` (a, b).

    Each round a node takes the least label of its neighbours, then the label of
    its label; groups of stars and short paths end after two or three rounds and
    long paths shrink geometrically. The state is written each round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        # the label itself is a node of the same component: follow it one step further
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("hop"))
        new = low.join(hop, F.col("low") == F.col("at"), "left").select("node", F.least("low", F.coalesce("hop", "low")).alias("label"), "was")
        new = materialize(new, "labels")
        discard(labels)
        labels = new
        if labels.filter("label <> was").isEmpty():
            discard(both)
            return labels
