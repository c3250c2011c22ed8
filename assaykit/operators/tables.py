"""Tables of the catalogue: backup, rebuild with another schema, verify, swap; files of several schemas read as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from .relational import same_rows


def backup(spark: SparkSession, name: str, to: str) -> Row:
    """Copy a table by CREATE TABLE AS SELECT and compare the copy, as it was written: rows_a, rows_b, same."""
    spark.sql(f"DROP TABLE IF EXISTS {to}")
    spark.sql(f"CREATE TABLE {to} USING parquet AS SELECT * FROM {name}")
    return same_rows(spark.table(name), spark.table(to)).first()


def rebuild(spark: SparkSession, name: str, build: Callable[[DataFrame], DataFrame], carried: list[str] | None = None) -> Row:
    """Give a table another schema: it is backed up, ``build`` makes its new rows from the backup, these are written beside it and
    compared in the ``carried`` columns (default: those that both have), and only then they take its name. The backup stays as
    ``<name>_backup``.

    If anything isn't as it was, nothing is swapped and a ValueError says so. A run that was broken off may be repeated: what it left
    behind is written anew, and a table that had gone already is made from its backup. Columns keep their nulls, repeated rows
    stay repeated, an empty table stays empty.
    """
    kept, new = f"{name}_backup", f"{name}_new"
    if spark.catalog.tableExists(name):
        if not (saved := backup(spark, name, kept)).same:
            raise ValueError(f"the backup of {name} has {saved.rows_b} rows of {saved.rows_a}, or other values")
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    old = spark.table(kept)
    build(old).write.format("parquet").saveAsTable(new)
    columns = carried or [c for c in old.columns if c in spark.table(new).columns]
    found = same_rows(old.select(*columns), spark.table(new).select(*columns)).first() if columns else None
    if not found or not found.same:
        raise ValueError(f"{new} has other rows than {name}, or other values in {columns}: {name} stays as it is")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    return found


def read_versions(spark: SparkSession, path: str, *added: tuple[str, str]) -> DataFrame:
    """Parquet files that were written before and after columns were added, as one table: what a file hasn't is null. Columns of
    ``added`` (name, type) that no file has yet are there too."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.selectExpr("*", *[f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in added if name not in df.columns])
