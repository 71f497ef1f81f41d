"""Connected components of an edge table, by alternating star contractions; each step is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.llm.common import stored


def _towards_least(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """For each u of pairs(u, v): links its v (and itself) to the least of them all."""
    least = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")  # so that AQE can split a hub's pairs
    to_v = pairs.join(least, "u")
    if larger_only:
        return to_v.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return to_v.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of edges(a, b), root being the least of its component."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    before = None
    while True:  # rounds grow with the logarithm of the largest component
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _towards_least(both, True).filter("a != b").distinct()
        small = _towards_least(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        e = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
