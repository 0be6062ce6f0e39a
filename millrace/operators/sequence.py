"""A global running number over a table of any size, the same for every partitioning and every rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tables import cut

_PLACE_BITS = 33  # monotonically_increasing_id keeps the place within a partition in its low bits


def numbered(df: DataFrame, order: list[str | Column], name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``order``, which should tell all rows apart.

    Rows are range-partitioned by the order, sorted within each range and written; the ranges' sizes are
    added up (one row for each range, so that this window is small) and every row adds its place to what
    lies before its range. No window holds more than one range, a frequent value is split by the columns
    after it, and what a lost task writes again has the same order. Rows alike in all of ``order`` get
    neighbouring numbers in either order. Nulls come where the order puts them. An empty table stays empty.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    of_range = F.shiftright("_at", _PLACE_BITS)
    sizes = placed.groupBy(of_range.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = placed.withColumn("_range", of_range).join(F.broadcast(starts), "_range")  # a row for each partition
    return out.withColumn(name, F.col("_start") + place + F.lit(start)).drop("_at", "_range", "_start")
