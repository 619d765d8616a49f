"""Totals along a global order without gathering the rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import settle


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of value over all rows before this one in the order (0 for the first).

    Rows are range-partitioned; each partition's sum goes to the driver (a number a partition) and shifts the partitions
    after it. A window over the whole order would run in a single task.
    """
    ranged = df.withColumn("__v", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = settle(ranged, "ranged")
    sums = {r["__part"]: r["s"] for r in ranged.groupBy("__part").agg(F.sum("__v").alias("s")).collect()}
    parts = sorted(sums)
    before = dict(zip(parts, accumulate([0, *(sums[p] for p in parts)])))
    shift = F.create_map(*(F.lit(x) for p in parts for x in (p, int(before[p])))) if parts else None
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce(inside, F.lit(0)) + (F.coalesce(shift[F.col("__part")], F.lit(0)) if parts else F.lit(0))
    return ranged.withColumn(name, total.cast("long")).drop("__v", "__part")


def row_numbers(df: DataFrame, order: list[str], name: str, base: int = 1) -> DataFrame:
    """df with `name`: base, base + 1, ... along the order."""
    return running_total(df, order, F.lit(1), name).withColumn(name, F.col(name) + base)
