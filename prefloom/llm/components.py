"""Connected components of an undirected graph by alternating large-star and small-star
steps: every step is two aggregations and joins on narrow edges, written to the shared
folder; a hub's edges are reduced before they are moved and split by adaptive joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours are tied to the least of its neighbourhood;
    small star: its smaller neighbours and itself are."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the least node it reaches."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        edges = written(_star(_star(edges, True), False), "edges")
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return written(tied.union(tied.select(F.col("component").alias("node"), "component")).distinct(), "components")
