"""Other sources and sinks: JSON aliases, page texts from files, idempotent uploads, JDBC, state tables and logs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest upload in bytes.
MAX_UPLOAD = 30 * 1024 * 1024


def json_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased aliases of a JSON file ``{"biomarkers": [{"name": ..., "aliases": [...]}, ...]}``."""
    rows = spark.read.json(path, multiLine=True, schema="biomarkers array<struct<name:string,aliases:array<string>>>")
    one = rows.select(F.explode("biomarkers").alias("b"))
    return one.select(F.col("b.name").alias("name"), F.explode(F.array_append(F.coalesce("b.aliases", F.array()), F.col("b.name"))).alias("alias")).select(
        "name", F.lower("alias").alias("alias")
    ).distinct()


def page_texts(spark: SparkSession, path: str, read: Callable[[bytes], list[str]], pattern: str = "*") -> DataFrame:
    """(path, page_num, text) of documents in a folder. ``read`` turns a file's bytes into page texts; a PDF or OCR
    library is plugged in here. A document is a row, so documents are read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def pages(frames):
        for f in frames:
            rows = [(p, n, t) for p, c in zip(f.path, f.content) for n, t in enumerate(read(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_num", "text"])

    return files.mapInPandas(pages, "path string, page_num int, text string")


def valid_uploads(files: DataFrame, extension: str = ".pdf", most: int = MAX_UPLOAD) -> DataFrame:
    """binaryFile rows that may be stored, with their content's SHA-256 as file_id."""
    return files.where(F.lower("path").endswith(extension) & (F.col("length") <= most)).withColumn("file_id", F.sha2("content", 256))


def append_new(stored: DataFrame, incoming: DataFrame, key: str = "file_id") -> DataFrame:
    """Incoming rows whose key isn't stored yet, one for each key: an append that may be repeated."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of ``column``."""
    split = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **{k: str(v) for k, v in split.items()}, **options).load()


def save_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one where none has been saved yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if known else spark.createDataFrame([], schema)


def save_report(df: DataFrame, path: str) -> None:
    """A report of metrics as JSON lines, in place of the one before."""
    df.write.mode("overwrite").json(path)


def append_daily(df: DataFrame, path: str, day: str = "day") -> None:
    """Metrics log: rows are appended under their day."""
    df.write.mode("append").partitionBy(day).json(path)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str], fmt: str = "parquet") -> None:
    """Copy tables one after the other, parents first."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").format(fmt).save(f"{target}/{name}.{fmt}")


def with_column_if_missing(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
