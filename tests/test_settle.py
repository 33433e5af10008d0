"""Settled tables leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from bandlake.session import settle


def _shuffled(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_what_was_shuffled_for_a_settled_table_is_dropped(spark):
    before, setting = _shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    sums = spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("s"))
    first = settle(sums, "sums")
    end = time.time() + 10
    while (left := _shuffled(spark) - before) and time.time() < end:  # they are dropped in the background
        time.sleep(0.1)
    assert not left
    assert settle(sums, "sums").exceptAll(first).count() == 0 and first.count() == 500  # the frame can be settled again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == setting
