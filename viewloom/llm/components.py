"""Connected components: of trees by pointer doubling, of any table of links by label propagation with pointer jumping.

Both leave the rows of a hub or a large component in one key of a plain join whose result goes straight to a table, so that Spark's
own handling of skewed joins can deal them over tasks. Only counts come to the driver; a table that is superseded is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import compact, compacted, forget


def climbed(parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`parents` has node and component, at most one row per node and no cycle. The same with the root of each node as its component."""
    tree = compact(parents.select("node", "component"))
    for _ in range(most_rounds):
        above = tree.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        found = tree.join(above, "component", "left")
        found = found.select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().cast("int").alias("moved"))
        found, state = compacted(found, F.sum("moved").alias("moved"))
        forget(tree)
        tree = found.drop("moved")
        if not state.moved:
            return tree
    raise RuntimeError(f"the trees are deeper than {most_rounds} doublings")


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`links` has a and b. One row per linked node: node, component (its smallest node).

    Every round takes the least label among the neighbours, then the label of the label, so chains shorten geometrically.
    """
    edges = compact(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = compact(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        best = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        jumped = best.join(up, "component").select("node", "old", F.least("component", "higher").alias("component"))
        jumped, state = compacted(jumped, F.sum((F.col("component") != F.col("old")).cast("int")).alias("changed"))
        forget(labels)
        labels = jumped.select("node", "component")
        if not state.changed:
            forget(edges)
            return labels
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
