"""Running sums in two levels, so that a group of any size is not one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Ordinals of a block.
BLOCK = 4096


def running(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of ``key`` up to this one, in the order of ``order``, whose first column is a whole number.

    Blocks of ``BLOCK`` ordinals are summed up first, then the rows of each block. ``df`` is read twice.
    """
    held = df.withColumn("__value", value.cast("long")).withColumn("__block", F.floor(F.col(order[0]) / BLOCK))
    sums = held.groupBy(key, "__block").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(key, "__block", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(f"h.{key}").eqNullSafe(F.col(f"s.{key}")) & F.col("h.__block").eqNullSafe(F.col("s.__block"))
    joined = held.alias("h").join(starts.alias("s"), same).select("h.*", "s.__start")
    return joined.withColumn(name, F.col("__start") + F.sum("__value").over(inside)).drop("__value", "__block", "__start")


def pieces(df: DataFrame, key: str, order: str, weight: Column, most: int, name: str = "piece") -> DataFrame:
    """Adds ``name``: the rows of ``key`` in the order of ``order`` are dealt into pieces of a weight of ``most``, numbered from 0, which may leave numbers out.

    A piece is what begins within one stretch of ``most``, so it exceeds that by less than its last row. Rows are sorted over ranges, whose
    weights are summed up first, so a key of any size is spread over tasks.
    """
    held = settle(df.withColumn("__weight", weight.cast("long")).repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = held.groupBy(key, "__range").agg(F.sum("__weight").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # what lies before a range goes ahead of its rows as one more row, so that rows are shuffled for one window only and not joined
    starts = sums.select(key, "__range", F.coalesce(before, F.lit(0)).alias("__weight"), F.lit(0).alias("__own"))
    upto = F.sum("__weight").over(Window.partitionBy(key, "__range").orderBy("__own", order).rowsBetween(Window.unboundedPreceding, -1))
    placed = held.withColumn("__own", F.lit(1)).unionByName(starts, allowMissingColumns=True).withColumn("__upto", upto).where("__own = 1")
    return placed.withColumn(name, F.floor(F.col("__upto") / most)).drop("__weight", "__range", "__upto", "__own")
