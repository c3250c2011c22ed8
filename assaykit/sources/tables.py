"""Tables as Parquet files, and the views that read them as laboratory entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, dealt over all cores where its files give fewer splits than there are: heavy expressions over a small file would
    keep one core busy. Large tables have many splits and stay as they are, unless these hold more than ``rows`` rows: small rows with
    heavy expressions would make long tasks."""
    most = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        most = max(most, -(-df.count() // rows))
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


#: Rows of a task that looks through a text made of each.
SHORT_TEXTS = 50_000


def people(spark: SparkSession, folder: str) -> DataFrame:
    """customer as persons: person_id, name, segment, tenant_id."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("tenant_id"), F.col("c_acctbal").alias("balance"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """orders as reports; status F, P, O reads processed, processing, pending."""
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("report_date"),
        status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"),
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as measurements of reports; return flag R reads abnormal."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") == "R").alias("is_abnormal"),
        F.col("l_linestatus").alias("unit"), F.col("l_shipdate").alias("taken"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """events as a person's series of named readings."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("reading_id"), F.col("ts"), F.col("user_id").alias("person_id"), F.col("event_type").alias("name"), "value", "props"
    )
