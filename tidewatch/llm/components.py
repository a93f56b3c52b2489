"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, shared_folder, stored


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node that has a smaller one; a map-side aggregate."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of each node on its smallest neighbour, or on itself if it has no smaller one.

    One row for each edge. The smallest neighbours are joined, so a node with very many neighbours is never
    gathered anywhere; so they are in the small star.
    """
    joined = edges.join(_least(edges), F.col("v") == F.col("node"), "left")
    return joined.select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the smallest of them."""
    least = _least(edges)
    joined = edges.join(least, F.col("u") == F.col("node")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionAll(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one other, and nothing on a node that hangs."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    found = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return found.where("hangs > 1 OR (hangs = 1 AND holds = 1)").agg(F.count("*").alias("n")).first().n == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another.

    Alternates large and small stars until the edges are stars; the number of rounds grows
    with the logarithm of the longest chain. Each half round is written to the shared folder, so a lost
    executor costs one at most, and each is a small job. No edges give an empty table.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    old = shared_folder(spark)
    # The larger node of an edge comes first, here and after each star.
    now = stored(now, old)
    while not _settled(now):
        for star in (_large_star, _small_star):
            folder = shared_folder(spark)
            now = stored(star(now), folder)
            discard(spark, old)
            old = folder
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
