"""Fact tables bucketed and sorted by user, so that per-user joins and aggregates need no shuffle.

A ``UserBuckets`` store keeps several tables in one layout: folders by partition
column (the partner's storage bucket), inside them ``buckets`` files per folder, dealt by
the hash of the user. Scans of such tables come dealt by user already: a
GROUP BY or a join on the user runs where the rows are, and predicates on the
partition column prune folders.

A user with more than ``1 / buckets`` of a table's rows would make one
bucket larger than an even share. These users (fewer than ``buckets`` a table, by counting)
and rows without a user are *heavy*: they are stored plainly beside the
buckets, for all tables of the store alike. ``even(name)`` and ``heavy(name)`` hold
disjoint users, so what is computed per user is the union of both sides.

``SPINE`` is a table of the store like the others: every combination of the spine's columns
(the user and, say, the partner) that any table holds, once. Left joins from it put several
tables together without a shuffle, which unions and full joins cannot.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.sources import storage

LAYOUT_FILE = "_layout.json"
SPINE = "spine"


class UserBuckets:
    def __init__(self, spark: SparkSession, root: str, buckets: int, user_col: str = "user_id"):
        self.spark, self.root, self.buckets, self.user_col = spark, root.rstrip("/"), buckets, user_col

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def catalog_name(self, name: str) -> str:
        return f"adlens_{name}_{hashlib.sha256(self._path(name).encode()).hexdigest()[:12]}"

    def stored(self, name: str) -> bool:
        return storage.exists(self.spark, f"{self._path(name)}/{LAYOUT_FILE}")

    def heavy_users(self, df: DataFrame) -> list:
        """The users with more than ``1 / buckets`` of the rows: fewer than ``buckets``."""
        return self._heavy_users(self._counts("", df, [self.user_col]))

    def _counts(self, name: str, df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__table", F.lit(name))

    def _heavy_users(self, counts: DataFrame) -> list:
        n = counts.groupBy("__table", self.user_col).agg(F.sum("__n").alias("__n"))
        totals = n.groupBy("__table").agg(F.sum("__n").alias("__total"))  # a row per table
        heavy = n.join(F.broadcast(totals), "__table").where(
            (F.col("__n") * self.buckets > F.col("__total")) & F.col(self.user_col).isNotNull())
        return sorted(r[0] for r in heavy.select(self.user_col).distinct().collect())

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, Sequence[str]], spine: Sequence[str] = ()) -> None:
        """Store all tables anew, with a spine of the columns ``spine`` if there are any; a user
        who is heavy in one of them is in all. Heavy users and spine come from the rows of each
        combination of user and spine columns, which are counted once and stored meanwhile."""
        by = list(dict.fromkeys([self.user_col, *spine]))
        counts = storage.keep_table(reduce(DataFrame.unionByName, [self._counts(n, df, by) for n, df in tables.items()]), "user-counts")
        if spine:
            tables = tables | {SPINE: counts.select(*spine).distinct()}
        users = self._heavy_users(counts if not spine else counts.unionByName(self._counts(SPINE, tables[SPINE], by)))
        heavy = F.col(self.user_col).isNull()
        if users:
            heavy = heavy | F.col(self.user_col).isin(users)
        for name, df in tables.items():
            self._drop(name)
            parts = list(partition_by.get(name, ()))
            df.where(heavy).write.mode("overwrite").parquet(f"{self._path(name)}-heavy")
            # one task per bucket, so one file per bucket and folder
            (df.where(~heavy).repartition(self.buckets, self.user_col)
             .write.format("parquet").mode("overwrite").partitionBy(*parts).bucketBy(self.buckets, self.user_col)
             .sortBy(self.user_col).option("path", self._path(name)).saveAsTable(self.catalog_name(name)))
            layout = {"schema": df.schema.jsonValue(), "partition_by": parts, "buckets": self.buckets, "user": self.user_col}
            storage.write_file(self.spark, f"{self._path(name)}/{LAYOUT_FILE}", json.dumps(layout).encode())
        storage.drop_table(counts)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog_name(name)}")
        storage.delete(self.spark, self._path(name))

    def _layout(self, name: str) -> dict:
        content = storage.read_file(self.spark, f"{self._path(name)}/{LAYOUT_FILE}")
        if content is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return json.loads(content)

    def even(self, name: str) -> DataFrame:
        """The rows of the users that are not heavy, dealt by user. A session whose catalog does not
        know the table yet (another application wrote it) enters it from its layout."""
        table = self.catalog_name(name)
        if not self.spark.catalog.tableExists(table):
            layout = self._layout(name)
            schema = T.StructType.fromJson(layout["schema"])
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            parts = f"PARTITIONED BY ({', '.join(layout['partition_by'])})" if layout["partition_by"] else ""
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet {parts} CLUSTERED BY ({layout['user']}) "
                f"SORTED BY ({layout['user']}) INTO {layout['buckets']} BUCKETS LOCATION '{self._path(name)}'")
            if parts:
                self.spark.catalog.recoverPartitions(table)
        return self.spark.table(table)

    def heavy(self, name: str) -> DataFrame:
        """The rows of the heavy users and those without a user."""
        return self.spark.read.schema(T.StructType.fromJson(self._layout(name)["schema"])).parquet(f"{self._path(name)}-heavy")
