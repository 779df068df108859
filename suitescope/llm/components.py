"""Connected components of a graph too large for the driver: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import checkpointed, forget

#: A node's neighbours are dealt to up to so many tasks, so that no task meets all of a hub's.
SALTS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links some neighbours to the least node near it: the greater ones, or the others and itself.

    Neighbours are dealt out by node and salt.  A node's least ones by salt, SALTS at most, meet to find the least of all.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    least = near.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = least.select("a", "salt", F.least("a", F.min("m").over(Window.partitionBy("a"))).alias("m"))
    both = near.join(least, ["a", "salt"])
    if large:
        out = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.where("a <> b")
    return out if large else out.distinct()  # what the large star repeats, the small one takes together


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); component: the least node reachable.

    Every round is written to the shared checkpoint folder, and the one before it deleted.  Ends when a round changes nothing.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        last, edges = edges, checkpointed(_star(_star(edges, large=True), large=False), "edges")
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components: no end")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
