"""Connected components of a table of edges, by alternating star steps.

In a large-star step every node tells its larger neighbours the smallest node
it knows, in a small-star step its smaller ones; the edges become stars whose
centres are the smallest nodes. Each step is a grouped minimum and a join, and
its result a written table, so lineage stays short and nothing but two counts
reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticode.llm.tables import written


def _told(pairs: DataFrame, smallest: DataFrame) -> DataFrame:
    return pairs.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _told(both.where("v > u"), smallest).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    return _told(down, smallest).where("u <> v").union(smallest.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge (u, v): root is the smallest
    node that edges reach. Loops and repeated edges do no harm."""
    now = written(edges.where("u <> v").distinct(), "edges")
    before, after = None, _mark(now)
    while before != after:
        now = written(_small_star(_large_star(now)), "edges")
        before, after = after, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
