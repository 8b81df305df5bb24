"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import use_shared_folder

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours below the least one: the larger neighbours of each node, or the smaller ones and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if large:
        return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of every node that has a link to another node; root is the least node of its component.

    Links may repeat and stand in either order; links to itself and links with nulls are ignored. Rounds go on until
    every edge points at a root; each is cut off by checkpoint() in the shared folder.
    """
    use_shared_folder(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a != b").distinct().checkpoint()
    mark = None
    for _ in range(MOST_ROUNDS):
        edges = _star(_star(edges, True).distinct(), False).distinct().checkpoint()
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if mark == (now["n"], now["s"]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        mark = (now["n"], now["s"])
    raise RuntimeError("components did not settle")
