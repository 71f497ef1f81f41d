"""Exact percentiles of groups of any size, by selection: counts by value, sums of counts by ranges of values, and a look into the ranges that hold the wanted ranks.

No task holds a group. Rows are counted by value where they are read; a group's ranges are summed up in order; only the one or two ranges
in which a rank lies are put in order. A range has a fixed width, so values with a fixed number of decimals bound what it holds:
hundredths in ranges of 1,000 are 100,000 distinct values at most, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a and b where the keys are the same, null being the same as null; both may come from one table."""
    other = b.withColumnsRenamed({k: f"_{k}_of_b" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}_of_b")) for k in keys))
    return a.join(other, same).drop(*(f"_{k}_of_b" for k in keys))


def counts_by_value(df: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    """keys, _v, _n: how often each value occurs; nulls don't count."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), *more)


def percentiles(counts: DataFrame, keys: Sequence[str], shares: dict[str, float], width: float = 1000) -> DataFrame:
    """keys and a column for each share, between the two values next to it as in a continuous percentile; counts has keys, _v and _n."""
    counts = counts.select(*keys, "_v", "_n", F.floor(F.col("_v") / width).alias("_part"))
    whole = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_k").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_k")).withColumns({"_before": before, "_all": F.sum("_k").over(whole)})
    place = {name: share * (F.col("_all") - 1) for name, share in shares.items()}
    ranks = F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))
    held = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))
    wanted = parts.filter(held).select(*keys, "_part", "_before", "_all")
    own = joined(counts, wanted, [*keys, "_part"])
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    picks = [at(f(p).cast("long")).alias(f"{side}_{name}") for name, p in place.items() for side, f in (("_lo", F.floor), ("_hi", F.ceil))]
    found = own.groupBy(*keys).agg(F.first("_all").alias("_all"), *picks)

    def between(name: str, p: Column) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(F.floor(p) == F.ceil(p), lo.cast("double")).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(name)

    return found.select(*keys, *(between(n, p) for n, p in place.items()))
