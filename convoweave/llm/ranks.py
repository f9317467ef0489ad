"""Global positions without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.shared import stage


def with_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the row's position from 0 in the given total order.

    Rows are dealt by key range, kept in the shared folder with their range's number, and numbered inside
    their range; a range's offset is the number of rows in the ranges before it. There are as many offsets
    as ranges, never more than partitions, so they may be broadcast.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_offset") + inside - 1).cast("bigint"))
        .drop("_range", "_offset")
    )
