"""Each row's neighbour, and its place, in a group's order, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import written


def dealt(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, _range: rows dealt by ranges of both, so that a large group is in many ranges. rows should be narrow."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.select(by, order).repartitionByRange(n, by, order).withColumn("_range", F.spark_partition_id()), "ranges")


def previous(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, previous: for each row the value of `order` of the row before it with the same `by` (nulls are a group).

    Within a range a window finds the row before; the first of a range takes the last of the group's ranges before, of
    which there is a row for each range and group. `order` must be distinct within a group.
    """
    ranges = dealt(rows, by, order)
    within = ranges.withColumn("previous", F.lag(order).over(Window.partitionBy("_range", by).orderBy(order)))
    ends = ranges.groupBy(by, "_range").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    before = ends.select(F.col(by).alias("_by"), F.col("_first"), F.lag("_last").over(Window.partitionBy(by).orderBy("_range")).alias("_before"))
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) == F.col("_first"))
    return within.join(before, same, "left").select(by, order, F.coalesce("previous", "_before").alias("previous"))


def placed(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, place: each row's place from 0 in its group's order (nulls are a group); rows of equal order are placed anyhow."""
    ranges = dealt(rows, by, order)
    counts = ranges.groupBy(by, "_range").count()
    ahead = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    within = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_range", by).orderBy(order)) - 1)
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))
    return within.join(before, same).select(by, order, (F.col("_n") + F.col("_before")).cast("long").alias("place"))
