"""Stored tables: what a bucketed one keeps and leaves."""

import os
import threading
import time

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.session import shuffles_dropped, stage, stage_bucketed


def test_bucketed_table_needs_no_shuffle_on_its_key(spark, capsys):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 97).alias("key"), "id").unionByName(
        spark.createDataFrame([(5, 1), (5, 1)], "key long, id long"))
    table = stage_bucketed(rows, "bucketed-rows", "key", 6, ["key", "id"])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_rows")]
    sums = table.groupBy("key").agg(F.sum("id").alias("s"))
    sums.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sums.exceptAll(rows.groupBy("key").agg(F.sum("id").alias("s"))).count() == 0 and table.count() == 5002
    place = table.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id")))
    place.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert place.filter("n = 1").count() == 98  # 97 keys and the null one


def test_bucketed_table_of_no_rows(spark):
    empty = spark.createDataFrame([], "key long, id long")
    table = stage_bucketed(empty, "bucketed-none", "key", 4)
    assert table.count() == 0 and table.groupBy("key").count().count() == 0
    assert all(os.path.exists(f) for f in [x.replace("file:", "") for x in table.inputFiles()])


def shuffle_files(spark):
    """Shuffle blocks that the driver knows of."""
    master = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return master.shuffleStatuses().size()


def test_stored_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    rows = spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    known = shuffle_files(spark)
    table = stage(rows, "sums")
    for _ in range(50):  # they go in the background
        if shuffle_files(spark) <= known:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= known
    assert table.exceptAll(rows).count() == 0 and rows.count() == 7  # the plan can be run again
    assert spark.conf.get(setting, None) == before


def test_tables_stored_at_once_put_the_setting_back(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    first, second = threading.Event(), threading.Event()

    def one():
        with shuffles_dropped(spark):
            first.set()
            second.wait(20)
    thread = threading.Thread(target=one)
    thread.start()
    first.wait(20)
    with shuffles_dropped(spark):
        second.set()
        thread.join()
        assert spark.conf.get(setting) == "true"
    assert spark.conf.get(setting, None) == before
