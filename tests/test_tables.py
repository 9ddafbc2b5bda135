"""Swapped tables, partitioned scans of a database, events looked up by key."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dedupe
from leadloom.sources import sinks


#: The database that comes with Spark.
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def ids(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_readers_see_the_old_version_or_the_new(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert sinks.current_version(spark, path, schema).count() == 0
    sinks.swap_table(rows((1, "a"), (2, "a")), path)
    before = sinks.current_version(spark, path, schema)
    sinks.swap_table(before.withColumn("v", F.lit("b")), path)  # reads what it replaces
    assert ids(before) == [(1, "a"), (2, "a")] and ids(sinks.current_version(spark, path, schema)) == [(1, "b"), (2, "b")]
    with pytest.raises(Exception, match="boom"):
        sinks.swap_table(before.select("id", F.raise_error(F.lit("boom")).cast("string").alias("v")), path)
    assert ids(sinks.current_version(spark, path, schema)) == [(1, "b"), (2, "b")]
    assert ids(sinks.put_run(spark, rows((2, "c"), (3, "c")), path)) == [(1, "b"), (2, "c"), (3, "c")]
    assert ids(sinks.put_run(spark, rows(), path)) == [(1, "b"), (2, "c"), (3, "c")]


def test_a_database_is_read_by_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    made = spark.range(1, 101).select(F.col("id").alias("ID"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    made.write.format("jdbc").options(url=url, dbtable="leads", createTableColumnTypes="NAME VARCHAR(20)", **DERBY).save()
    got = sinks.jdbc_table(spark, url, "leads", "ID", 4, **DERBY)
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == 100
    assert "*GreaterThan(ID,90)" in got.where("ID > 90")._jdf.queryExecution().toString()
    assert sinks.jdbc_table(spark, url, "(SELECT * FROM leads WHERE ID < 0) x", "ID", 4, **DERBY).count() == 0


def test_latest_events(spark):
    log = spark.createDataFrame([("a", "k", 1, "x"), ("a", "k", 3, None), ("a", "k", 2, "y"), ("a", None, 9, "z"), ("", "k", 9, "z"), ("b", "k", 1, "w")], "type string, key string, n int, v string")
    assert sorted(tuple(r) for r in dedupe.latest_events(log, ["n"]).collect()) == [("a", "k", 3, None), ("b", "k", 1, "w")]
