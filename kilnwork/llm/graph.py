"""Connected components of links between rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import release, saved
from .skew import salted_lookup


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (a < b) there are, and whether they are stars: every b has one a, and no b is
    an a itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("up")).union(edges.select("b", F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("hub"))
    r = nodes.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("hub") == 0)).alias("off")).first()
    return r.n or 0, not r.off


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, root (the smallest node reachable) for every node of
    an edge between different nodes. Each round links every node to the smallest neighbour, once
    over larger and once over smaller neighbours; the rounds end when the links are stars, after
    about log(n) squared of them at most. Hubs are looked up over salts. No links reach the driver,
    only their number.
    """
    edges = saved(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    n, stars = _state(edges)
    while not stars:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = salted_lookup(both.filter("v > u"), low, ["u"], "n", "v", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        release(low, edges)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = salted_lookup(large, low, ["u"], "n", "v", total=n).filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = saved(small.union(low.select("m", "u")).distinct(), "small-star")
        release(low, large)
        n, stars = _state(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
