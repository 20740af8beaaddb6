"""Connected components of a graph of any size, by alternating star contractions.

No vertex's neighbours are gathered: each contraction is an aggregation to the smallest neighbour (partial
sums before the shuffle) and a join back, whose hot keys adaptive execution splits.
"""
from pyspark.sql import DataFrame, functions as F

from filingsift.llm.tables import Tables


def _toward_smallest(edges, larger):
    """Hang a vertex's neighbours on its smallest one: the larger neighbours, or the smaller and itself."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.filter("u > v").distinct() if not larger else moved.filter("u > v")


def _unfinished(edges):
    """Whether some vertex has two edges downwards, or one both upwards and downwards."""
    ends = (edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
            .unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    found = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not found.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(edges: DataFrame, tables: Tables, name="links") -> DataFrame:
    """(u, v) pairs of ids to (id, component): the smallest id each one is connected with.

    Ids that are the smallest of their component have no row.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = tables.write(name, edges)
    while _unfinished(edges):
        edges = tables.write(name, _toward_smallest(_toward_smallest(edges, True), False))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
