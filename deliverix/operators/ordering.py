"""Row numbers and predecessors within a group that may be very large.

A window over a whole repository or author puts the group into one task. Here a group is first cut into
chunks by its order; the work is done in chunks, and one small row for each chunk carries what the next
chunk needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Log ordinals of a chunk.
CHUNK = 1 << 18
#: Seconds of a chunk where there are no log ordinals.
SECONDS = 30 * 86400


def number_rows(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str, newest_first: bool = False) -> DataFrame:
    """Adds 0-based row numbers within keys; chunk must rise (or fall, newest_first) with the order."""
    df = df.withColumn("_chunk", chunk)
    sizes = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    by = F.desc("_chunk") if newest_first else F.asc("_chunk")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return df.withColumn("_within", within).join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_chunk", "_within", "_before")


def with_older(df: DataFrame, keys: Sequence[str], columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Adds the struct `older`: columns of the next row further down the log (log_ordinal, 0 is the newest) with the same keys.

    Rows without log_ordinal are in order of committed_at, then sha; df has these columns.
    """
    by_time = -F.floor(F.col("committed_at") / SECONDS)
    df = df.withColumn("_chunk", F.coalesce(F.floor(F.col("log_ordinal") / chunk), by_time))
    values, place = F.struct(*columns), [F.coalesce(-F.col("log_ordinal"), F.lit(0)), F.col("committed_at"), F.col("sha")]
    near = F.lag(values).over(W.partitionBy(*keys, "_chunk").orderBy(*place))
    heads = df.groupBy(*keys, "_chunk").agg(F.max_by(values, F.struct(*place)).alias("_head"))
    further = heads.withColumn("_next", F.lag("_head").over(W.partitionBy(*keys).orderBy(F.desc("_chunk")))).drop("_head").filter("_next is not null")
    joined = df.withColumn("_near", near).join(further, [*keys, "_chunk"], "left")
    return joined.withColumn("older", F.coalesce("_near", "_next")).drop("_near", "_next", "_chunk")
