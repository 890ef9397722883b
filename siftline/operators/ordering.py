"""Positions of rows without one sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut


def with_position(df: DataFrame, order: list[str], to: str = "pos") -> DataFrame:
    """Consecutive positions from 0 by ``order``: rows are range-partitioned and numbered in each
    partition, then shifted by the sizes of the partitions before (one row for each partition).
    ``order`` should be unique, else equal rows are numbered in any order."""
    held = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.join(F.broadcast(shift), "_part").withColumn(to, (place + F.col("_shift")).cast("bigint")).drop("_part", "_shift")
