"""Result sinks: replace-table, create-only table, and header CSV export.

Tables go to a path or, with ``name``, to the catalog as well (an external
table at that path). For a table that is read while it is replaced, and for tables by
day, see ``sources.versions``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from adlens.sources import storage


def _write(df: DataFrame, mode: str, path: str, partition_by: Sequence[str], name: str | None) -> None:
    w = df.write.mode(mode).format("parquet").partitionBy(*partition_by)
    if name is None:
        w.save(path)
    else:
        w.option("path", path).saveAsTable(name)


def _same_columns(df: DataFrame, name: str) -> bool:
    have = df.sparkSession.table(name).schema
    return [(f.name, f.dataType) for f in have] == [(f.name, f.dataType) for f in df.schema]


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), name: str | None = None) -> str | None:
    """DROP IF EXISTS + CREATE TABLE AS. The new table is written whole beside the old one before
    anything changes, so a write that fails leaves the old one; ``df`` may read it.

    Without ``name``, the new folder takes the place of ``path`` by two renames. With ``name``, the
    catalog's table is switched to the new folder (``path-<id>`` from the second version on) by one
    catalog change, if it is unpartitioned and keeps its columns, else dropped and entered anew;
    the folder of the version before is returned, for its last readers, and is the caller's to delete.
    """
    spark = df.sparkSession
    written = f"{path}-{uuid.uuid4().hex[:12]}"
    if name is None:
        _write(df, "errorifexists", written, partition_by, None)
        storage.swap(spark, written, path)
        return None
    if not spark.catalog.tableExists(name):
        storage.delete(spark, path)
        _write(df, "errorifexists", path, partition_by, name)
        return None
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    before = detail["Location"]
    if not partition_by and "# Partition Information" not in detail and _same_columns(df, name):
        _write(df, "errorifexists", written, (), None)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{written}'")
        spark.catalog.refreshTable(name)
    else:
        _write(df, "errorifexists", written, partition_by, None)
        spark.sql(f"DROP TABLE {name}")
        stored = spark.read.schema(df.schema).parquet(written)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
        parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts} LOCATION '{written}'")
        if partition_by:
            spark.catalog.recoverPartitions(name)
    return before


def create_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), name: str | None = None) -> None:
    """CREATE TABLE AS without a drop: fails if ``path`` (or ``name``) already holds a table."""
    _write(df, "errorifexists", path, partition_by, name)


def export_csv(df: DataFrame, path: str) -> None:
    """Results with a header row, written by the executors; nothing is collected to the driver."""
    df.write.mode("overwrite").option("header", True).csv(path)
