"""Connected components by repeated contraction, with joins only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b: longs) that is not its component's smallest.

    Each node hooks on to its smallest neighbour if that is smaller; pointer doubling turns the
    resulting trees into stars; links between the stars' centres are what is left. Each pass at
    least halves the nodes of a component. Nulls and loops link nothing; repeated links count once.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = durable(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        tree = durable(edges.groupBy("a").agg(F.min("b").alias("p")), "trees")
        moved = True
        while moved:
            up = tree.select(F.col("a").alias("p"), F.col("p").alias("g"))
            jumped = durable(tree.join(up, "p", "left").select("a", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), "trees")
            moved = not jumped.where("moved").isEmpty()
            tree = jumped.select("a", "p")
        if labels is None:
            labels = tree.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            on = tree.select(F.col("a").alias("component"), "p")
            old = labels.join(on, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = durable(old.unionByName(tree.select(F.col("a").alias("node"), F.col("p").alias("component"))), "labels")
        up = tree.select(F.col("a").alias("x"), F.col("p").alias("up"))
        low = edges.join(up.withColumnRenamed("x", "a"), "a").select("b", F.col("up").alias("a"))
        both = low.join(up.withColumnRenamed("x", "b"), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        edges = durable(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
