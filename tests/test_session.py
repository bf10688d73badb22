import time

from pyspark.sql import functions as F

from srcgraph.session import FREE_SHUFFLES, cut


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_a_cut_table_leaves_no_shuffle_files(spark):
    held = spark.conf.get(FREE_SHUFFLES, None)
    before = shuffle_files(spark)
    rows, seen = cut(spark.range(2000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(.1)
    assert not shuffle_files(spark) - before
    assert seen["n"] == 7 and rows.agg(F.sum("count")).first()[0] == 2000
    assert spark.conf.get(FREE_SHUFFLES, None) == held
