"""Catalogue tables and files of several schemas."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import values
from assaykit.operators import relational, tables


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE rebuilt LOCATION '{tmp_path}/db'")
    yield "rebuilt"
    spark.sql("DROP DATABASE rebuilt CASCADE")


def test_rebuild_keeps_rows_and_takes_the_name(spark, database):
    name = f"{database}.reports"
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, None, None), (3, "é", -0.5)]
    spark.createDataFrame(rows, "id int, status string, total double").write.saveAsTable(name)
    found = tables.rebuild(spark, name, lambda old: old.withColumn("id", F.col("id").cast("long")).withColumn("started", F.lit(None).cast("timestamp")), ["status", "total"])
    assert (found.rows_a, found.rows_b, found.same) == (4, 4, True)
    assert spark.table(name).dtypes == [("id", "bigint"), ("status", "string"), ("total", "double"), ("started", "timestamp")]
    assert sorted(map(tuple, spark.table(name).drop("started").collect()), key=str) == sorted(rows, key=str)
    assert spark.table(f"{name}_backup").dtypes == [("id", "int"), ("status", "string"), ("total", "double")]
    assert not spark.catalog.tableExists(f"{name}_new")


def test_rebuild_that_loses_rows_changes_nothing(spark, database):
    name = f"{database}.t"
    spark.range(10).selectExpr("id", "id % 3 AS k").write.saveAsTable(name)
    for broken in (lambda old: old.where("id > 0"), lambda old: old.withColumn("k", F.lit(1).cast("long")), lambda old: old.union(old), lambda old: old.select(F.lit(1).alias("z"))):
        with pytest.raises(ValueError, match="stays as it is"):
            tables.rebuild(spark, name, broken)
        assert spark.table(name).count() == 10 and spark.table(name).columns == ["id", "k"]
    spark.sql(f"DROP TABLE {name}")  # broken off between the swap's two steps
    tables.rebuild(spark, name, lambda old: old.withColumn("more", F.lit("x")))
    assert spark.table(name).count() == 10 and spark.table(name).columns == ["id", "k", "more"]


def test_rebuild_of_an_empty_table(spark, database):
    name = f"{database}.none"
    spark.range(0).write.saveAsTable(name)
    assert tables.rebuild(spark, name, lambda old: old.withColumn("b", F.lit(1))).same and spark.table(name).isEmpty()


def test_files_of_several_schemas(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(path)
    spark.createDataFrame([(2, 5.0)], "id long, value double").write.mode("append").parquet(path)
    found = tables.read_versions(spark, path, ("value", "double"), ("started", "timestamp"))
    assert sorted(found.dtypes) == [("id", "bigint"), ("name", "string"), ("started", "timestamp"), ("value", "double")] and found.columns[-1] == "started"
    assert sorted(map(tuple, found.select("id", "name", "value", "started").collect())) == [(1, "a", None, None), (2, None, 5.0, None)]


def test_shown_order_of_accents_and_states(spark):
    names = ["Zebra", "élan", "Elan", "eland", None, "étude", "Apfel", "äpfel", "apfel", "z-a", "z b"]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    shown = [r.name for r in frame.orderBy(*relational.table_order("name", "string")).collect()]
    assert shown[0] is None and shown[1:4] == ["Apfel", "apfel", "äpfel"] and shown[4:8] == ["Elan", "élan", "eland", "étude"]
    rows = [(1, True, 5.0, 1.0, 9.0, None), (2, False, 50.0, 1.0, 9.0, None), (3, None, 50.0, 1.0, 9.0, "1-99"), (4, None, 50.0, 1.0, None, "1-9"), (5, None, 5.0, None, None, "<= 4"), (6, None, 5.0, None, None, "about 4"), (7, None, None, 1.0, 2.0, None)]
    s = spark.createDataFrame(rows, "id int, f boolean, v double, a double, b double, t string").select("id", values.outside_range(*map(F.col, "fvabt")).alias("s"))
    assert {r.id: r.s for r in s.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False}
