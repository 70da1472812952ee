"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, label): label is the least node reachable.

    Each round takes the least label among a node and its neighbours, then replaces each label by
    its own label, so a chain of length n needs about log n rounds. Every round is a written table;
    only whether a row changed reaches the driver. An empty edge table gives an empty result.
    """
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = cut(hooked.join(roots, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
