import os
import time

from pyspark.sql import functions as F

from bitext import scratch


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_written_tables_keep_no_shuffle_files(spark):
    before = spark.conf.get(scratch.CLEANUP, None)
    there = _shuffle_files(spark)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")).repartition(3, "k")
    table = scratch.written(counts, "counts")
    for _ in range(50):  # removed by a thread of Spark's
        if not (left := _shuffle_files(spark) - there):
            break
        time.sleep(0.2)
    assert not left
    assert table.agg(F.count("*"), F.sum("n")).first() == (100, 10_000)
    assert counts.agg(F.sum("n")).first()[0] == 10_000  # what was written can be computed again
    assert spark.conf.get(scratch.CLEANUP, None) == before
