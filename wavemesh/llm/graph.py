"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs). Returns id, component (the least id reachable) for every id of an edge to another.

    Alternating large and small stars: every round links the neighbours of each node to the least of them, first the
    greater ones, then the smaller; the graph becomes a star around the least node of each component in a logarithmic
    number of rounds, and never holds more edges than before. A node's neighbours are only ever summed up or joined
    with one row, so that a node with very many of them can be split over tasks."""
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = links.selectExpr("hi AS u", "lo AS v").unionByName(links.selectExpr("lo AS u", "hi AS v"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct(), "large-star")
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        down = large.join(least, "hi").where("lo <> m").selectExpr("lo AS hi", "m AS lo")
        links = stored(down.unionByName(least.selectExpr("hi", "m AS lo")).distinct(), "small-star")
    else:
        raise RuntimeError(f"components hadn't settled after {most_rounds} rounds")
    return links.selectExpr("hi AS id", "lo AS component").unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
