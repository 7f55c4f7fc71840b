"""Connected components of a graph, without collecting it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.tables import written

#: Steps that a path is shortened by in one query.
JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each node of ``links`` (a, b); component is the smallest id that can be reached.

    Each round hangs every root under its smallest neighbour, shortens the paths that this makes, and carries
    the links over to the new roots; links within a component are dropped. A round at least halves the roots
    that still have links. Its tables are written and read again, so the joins' sides are both exchanged
    and Spark can split a root that many nodes share; the labels are written once, at the end. Null ids must
    not occur; an empty input gives no rows."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("parent")), "parents")
        moved = True
        while moved:
            above = parents.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
            # JUMPS steps up, and whether one more leads further
            jumped = parents
            for _ in range(JUMPS):
                jumped = jumped.join(above, "parent").select("root", F.col("above").alias("parent"))
            jumped = written(jumped.join(above, "parent").select("root", "parent", (F.col("above") != F.col("parent")).alias("moved")), "parents")
            moved = not jumped.where("moved").isEmpty()
            parents = jumped.drop("moved")
        if labels is None:  # every node is a root of the first round
            labels = parents.select(F.col("root").alias("id"), F.col("parent").alias("component"))
        else:
            to = parents.select(F.col("root").alias("component"), "parent")
            labels = labels.join(to, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
        of_a, of_b = parents.select(F.col("root").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        moved_edges = edges.join(of_a, "a").join(of_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = written(moved_edges.where("a < b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return written(labels, "labels")
