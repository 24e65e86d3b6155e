"""Tables of segments behind a numbered manifest: atomic replacement, days that are added and replaced.

``path`` holds ``segment=<id>`` folders (Parquet, never changed once written) and
``_manifests/<n>.json``. A manifest names the segments that are the table, by day for
a ``DailyTable``, and the table's schema; the one with the highest number holds. A writer first
writes a segment, then creates the next manifest, which fails if another writer was
first (it then starts again from that one's manifest). So a reader sees the
table before or after a change, never between, and a write that fails leaves it as it was.
Creating a file must be exclusive in the store (HDFS, local, object stores with
conditional writes).

Segments that no manifest names any more are removed by ``vacuum``, which keeps the last
manifests, so that readers of the version before can finish.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.sources import storage

SEGMENT = "segment"


class Conflict(RuntimeError):
    """Another writer has changed the same days (or the whole table) meanwhile."""


class VersionedTable:
    """A table that is replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests ---------------------------------------------------------------
    def _versions(self) -> list[int]:
        names = storage.list_names(self.spark, f"{self.path}/_manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        if version is None:
            version = max(self._versions(), default=0)
        content = storage.read_file(self.spark, f"{self.path}/_manifests/{version}.json") if version else None
        return version, json.loads(content) if content else {"schema": None, "parts": {}}

    def _commit(self, version: int, manifest: dict) -> bool:
        return storage.create_file(self.spark, f"{self.path}/_manifests/{version + 1}.json", json.dumps(manifest).encode())

    # -- segments ----------------------------------------------------------------
    def _write(self, df: DataFrame, partition_by: Iterable[str]) -> str:
        segment = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{SEGMENT}={segment}")
        return segment

    def version(self) -> int:
        """The number of the manifest that holds (0: no table yet)."""
        return self._manifest()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was at ``version``."""
        _, m = self._manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        paths = sorted({f"{self.path}/{SEGMENT}={p}" for ps in m["parts"].values() for p in ps})
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the segment's folder is a partition column of the reader, which is not the table's
        inner = T.StructType([*schema.fields, T.StructField(SEGMENT, T.StringType())])
        return self.spark.read.schema(inner).option("basePath", self.path).parquet(*paths).select(*schema.fieldNames())

    def replace(self, df: DataFrame, partition_by: Iterable[str] = ()) -> int:
        """Replace the whole table by ``df`` (which may read it); the new version's number."""
        if SEGMENT in df.columns:
            raise ValueError(f"a column named {SEGMENT} cannot be stored")
        before = self.version()
        segment = self._write(df, partition_by)
        manifest = {"schema": df.schema.jsonValue(), "parts": {"": [segment]}}
        if not self._commit(before, manifest):
            raise Conflict(f"{self.path}: version {before + 1} was written meanwhile")
        return before + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` manifests and the segments that only those removed name.
        Segments of a writer that has not committed yet are not named either: run it when none writes."""
        versions = self._versions()
        last = versions[max(0, len(versions) - keep):]
        named = {p.split("/")[0] for v in last for ps in self._manifest(v)[1]["parts"].values() for p in ps}
        gone = [n for n in storage.list_names(self.spark, self.path)
                if n.startswith(f"{SEGMENT}=") and n.removeprefix(f"{SEGMENT}=") not in named]
        for v in versions[:max(0, len(versions) - keep)]:
            storage.delete(self.spark, f"{self.path}/_manifests/{v}.json")
        for n in gone:
            storage.delete(self.spark, f"{self.path}/{n}")
        return gone


class DailyTable(VersionedTable):
    """A table with a ``day`` column whose days are added, and replaced, one by one.

    The manifest lists the days that are covered, with and without rows, and the
    folder that holds each; only folders of the days that are read are listed and scanned.
    """

    def covered(self) -> list[dt.date]:
        return sorted(dt.date.fromisoformat(d) for d in self._manifest()[1]["parts"])

    def extend(self, build: Callable[[dt.date, dt.date], DataFrame], start: dt.date, end: dt.date,
               replace: Iterable[dt.date] = ()) -> list[dt.date]:
        """Cover every day of the range: ``build(first, last)`` gives the rows of the days in between, and
        is called for each stretch of days that are not covered yet or are in ``replace`` (late
        data), and for no other. Returns these days."""
        again = set(replace)
        _, m = self._manifest()
        wanted = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
        todo = [d for d in wanted if d in again or d.isoformat() not in m["parts"]]
        stretches: list[list[dt.date]] = []
        for d in todo:
            if stretches and d - stretches[-1][-1] == dt.timedelta(days=1):
                stretches[-1].append(d)
            else:
                stretches.append([d])
        for days in stretches:
            self._add(build(days[0], days[-1]), days, m["parts"])
        return todo

    def _add(self, df: DataFrame, days: list[dt.date], seen: dict) -> None:
        if SEGMENT in df.columns:
            raise ValueError(f"a column named {SEGMENT} cannot be stored")
        rows = df.where(F.col("day").between(F.lit(days[0]), F.lit(days[-1])))
        # rebalancing: small days share a task, a large one is split over several files
        segment = self._write(rows.hint("rebalance", "day"), ["day"])
        held = set(storage.list_names(self.spark, f"{self.path}/{SEGMENT}={segment}"))
        new = {d.isoformat(): [f"{segment}/day={d}"] if f"day={d}" in held else [] for d in days}
        while True:
            version, m = self._manifest()
            if any(m["parts"].get(d) != seen.get(d) for d in new):
                raise Conflict(f"{self.path}: another writer covers {sorted(new)}")
            if m["schema"] is not None and T.StructType.fromJson(m["schema"]) != _nullable(df.schema):
                raise ValueError(f"{self.path}: the table's columns are {m['schema']}")
            if self._commit(version, {"schema": _nullable(df.schema).jsonValue(), "parts": m["parts"] | new}):
                return

    def read(self, version: int | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The rows of the covered days, or of those in the range."""
        _, m = self._manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{SEGMENT}={p}" for d, ps in sorted(m["parts"].items()) for p in ps
                 if (start is None or d >= start.isoformat()) and (end is None or d <= end.isoformat())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        inner = T.StructType([*schema.fields, T.StructField(SEGMENT, T.StringType())])
        return self.spark.read.schema(inner).option("basePath", self.path).parquet(*paths).select(*schema.fieldNames())

    def replace(self, df: DataFrame, partition_by: Iterable[str] = ()) -> int:
        raise TypeError("days are replaced by extend(..., replace=days)")


def _nullable(schema: T.StructType) -> T.StructType:
    """The schema as Parquet files give it back: every column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
