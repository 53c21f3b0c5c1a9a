"""Connected components of links, by least labels and pointer jumping on DataFrames."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm._spark import discard, written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: (a, b) of non-null ids, any order, repeats allowed. (node, component): the least id reachable.

    Each round every node takes the least label among its neighbours' and then
    its label's label; rounds grow with the logarithm of the longest path. Links
    and labels stay in the cluster, and each round's labels are written to the
    shared folder. A node with very many links is a hot key of joins only, which
    Spark can split; sums over links are partial aggregates.

    With ``rounds``, it stops after so many: nodes of one label are then connected, but
    a component may still have several labels.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for k in count(1):
        labels_now = labels.select("node", "component")
        near = both.join(labels_now.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels_now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = written(step, "labels-step")
        up = step.select(F.col("node").alias("up"), F.col("component").alias("over"))
        new = step.join(up, F.col("component") == F.col("up"), "left")
        new = written(new.select("node", "old", F.least("component", F.coalesce("over", "component")).alias("component")), "labels")
        discard(step, labels)
        if k == rounds or not new.where("component < old").limit(1).count():
            discard(both)
            return new.select("node", "component")
        labels = new
    raise AssertionError
