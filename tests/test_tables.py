"""Written tables leave no shuffle files behind."""

import time

from skein.llm.common import discard, written
from skein.sources import tables
from skein.sources.tables import kept


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, rows = shuffle_files(spark), spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(3, "k")
    table, path = written(rows, "t", by="k")
    counts = kept(rows.groupBy("k").count(), "t")
    end = time.time() + 20
    while left := shuffle_files(spark) - before:
        assert time.time() < end, left
        time.sleep(0.2)
    assert counts.agg({"count": "sum"}).first()[0] == table.count() == 5000
    discard(spark, path)


def test_the_setting_is_put_back(spark):
    for value in (None, "false", "true"):
        spark.conf.unset(tables.RELEASE) if value is None else spark.conf.set(tables.RELEASE, value)
        kept(spark.range(3), "t")
        assert spark.conf.get(tables.RELEASE, None) == value
    spark.conf.unset(tables.RELEASE)
