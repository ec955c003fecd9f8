"""Connected components of links between values of any type that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b): the least value that can be reached.

    Joins are by sorting: sides that shrink under the limit of a broadcast would pass through the driver in every round.
    Each round links everything to the least neighbour of its greater side, then of its lesser one: the rounds follow
    the logarithm of the longest path.  Neighbours are never gathered: both steps are a minimum and a join.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    lone = links.where("a = b").select(F.col("a").alias("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        pulled = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(pulled.where("u <> v").distinct())
        settled = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if settled:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    alone = lone.distinct().join(found.hint("merge"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(alone)
