"""Connected components of a graph of any size, by alternating stars over written tables."""

from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any orderable type -> (node, root): the smallest node it is connected with.

    Nodes without an edge to another node do not appear. Each round links every node to the smallest
    of its neighbourhood, first towards larger nodes, then towards smaller ones, so chains shrink
    geometrically and hubs are only ever aggregated by ``min`` (partial sums before the exchange).
    Rounds are written to the shared folder: a lost executor re-reads the last round only. Null ends
    and loops are ignored; no edges give no rows.
    """
    edges = written(edges.where("u < v or v < u").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = written(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
