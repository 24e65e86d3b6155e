"""Versioned and daily tables, atomic replacement, and the life of stored tables."""

import datetime as dt
import re
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from adlens.operators import daily, exposure
from adlens.params import P
from adlens.sources import sinks, storage
from adlens.sources.fixtures import TestWarehouse
from adlens.sources.versions import Conflict, DailyTable, VersionedTable
from conftest import SMOKE_DIR, rows

D = dt.date


# -- whole tables ------------------------------------------------------------------
def test_replaced_table_has_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.replace(spark.range(3)) == 1
    old = t.read()
    assert t.replace(t.read().selectExpr("id + 10 as id", "id as twin"), ["twin"]) == 2   # may read itself
    assert rows(t.read(), "id", "twin") == [(10, 0), (11, 1), (12, 2)]
    assert rows(old) == [(0,), (1,), (2,)] and rows(t.read(1)) == rows(old)                # readers of the old one finish
    assert t.replace(spark.range(0)) == 3
    assert t.read().count() == 0
    assert len(t.vacuum(keep=1)) == 2 and t.read().count() == 0
    with pytest.raises(ValueError):
        t.replace(spark.range(1).withColumnRenamed("id", "segment"))


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    bad = spark.range(3).select(F.expr("if(id = 2, raise_error('broken'), id)").cast("long").alias("id"))
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(3))
    sinks.replace_table(spark.range(3), f"{tmp_path}/p")
    name = f"kept_{uuid.uuid4().hex[:8]}"
    sinks.replace_table(spark.range(3), f"{tmp_path}/n", name=name)
    for attempt in (lambda: t.replace(bad), lambda: sinks.replace_table(bad, f"{tmp_path}/p"),
                    lambda: sinks.replace_table(bad, f"{tmp_path}/n", name=name)):
        with pytest.raises(Exception, match="broken"):
            attempt()
    for df in (t.read(), spark.read.parquet(f"{tmp_path}/p"), spark.table(name)):
        assert df.count() == 3


def test_reader_sees_the_old_or_the_new_table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.range(100))
    seen, stop = set(), threading.Event()

    def reader():
        while not stop.is_set():
            seen.add(t.read().count())

    thread = threading.Thread(target=reader)
    thread.start()
    for n in (200, 300, 400):
        t.replace(spark.range(n))
    stop.set()
    thread.join()
    assert seen <= {100, 200, 300, 400} and seen


def test_two_writers_of_one_version_conflict(spark, tmp_path, monkeypatch):
    a, b = VersionedTable(spark, f"{tmp_path}/t"), VersionedTable(spark, f"{tmp_path}/t")
    write = a._write
    monkeypatch.setattr(a, "_write", lambda *x: (b.replace(spark.range(7)), write(*x))[1])
    with pytest.raises(Conflict):
        a.replace(spark.range(5))
    assert b.read().count() == 7


def test_named_table_is_switched(spark, tmp_path):
    name = f"switched_{uuid.uuid4().hex[:8]}"
    assert sinks.replace_table(spark.range(3), f"{tmp_path}/n", name=name) is None
    before = sinks.replace_table(spark.range(5), f"{tmp_path}/n", name=name)
    assert before.endswith("/n") and spark.table(name).count() == 5
    assert spark.read.parquet(before).count() == 3                                        # the old version's readers finish
    other = spark.range(4).selectExpr("id as x", "id % 2 as y")
    sinks.replace_table(other, f"{tmp_path}/n", ["y"], name)
    assert rows(spark.table(name), "x", "y") == rows(other) and "PartitionFilters: [isnotnull(y" in \
        spark.table(name).where("y = 1")._jdf.queryExecution().executedPlan().toString()


# -- days --------------------------------------------------------------------------
def _days(spark, first, last, scale=1):
    n = (last - first).days + 1
    return spark.range(n * 3).select(F.date_add(F.lit(first), (F.col("id") % n).cast("int")).alias("day"),
                                     (F.col("id") * scale).alias("v")).where(F.col("day") != D(2024, 1, 4))


def test_days_are_added_and_replaced(spark, tmp_path):
    t, calls = DailyTable(spark, f"{tmp_path}/t"), []

    def build(a, z, scale=1):
        calls.append((a, z))
        return _days(spark, a, z, scale)

    assert t.extend(build, D(2024, 1, 2), D(2024, 1, 5)) == [D(2024, 1, d) for d in (2, 3, 4, 5)]
    assert t.covered() == [D(2024, 1, d) for d in (2, 3, 4, 5)]                            # a day without rows is covered
    assert t.extend(build, D(2024, 1, 2), D(2024, 1, 5)) == []
    t.extend(build, D(2024, 1, 1), D(2024, 1, 7))
    assert calls == [(D(2024, 1, 2), D(2024, 1, 5)), (D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 6), D(2024, 1, 7))]
    before = t.version()
    t.extend(lambda a, z: _days(spark, a, z, 100), D(2024, 1, 1), D(2024, 1, 7), replace=[D(2024, 1, 3)])
    assert rows(t.read(start=D(2024, 1, 3), end=D(2024, 1, 3)), "v") == [(0,), (100,), (200,)]
    assert t.read().count() == 18 and sorted(r.day.day for r in t.read(before).select("day").distinct().collect()) == [1, 2, 3, 5, 6, 7]
    t.extend(lambda a, z: _days(spark, a, z).where("false"), D(2024, 1, 3), D(2024, 1, 3), replace=[D(2024, 1, 3)])
    assert t.read(start=D(2024, 1, 3), end=D(2024, 1, 3)).count() == 0                     # late data may empty a day
    assert len(t.vacuum(keep=1)) == 2 and t.read().count() == 15                           # the replaced day and the empty one
    assert len(t.read(start=D(2024, 1, 6), end=D(2024, 1, 6)).inputFiles()) == 1
    with pytest.raises(ValueError):
        t.extend(lambda a, z: _days(spark, a, z).withColumn("w", F.lit(1)), D(2024, 1, 8), D(2024, 1, 8))
    with pytest.raises(TypeError):
        t.replace(spark.range(1))


def test_writers_of_the_same_day_conflict_and_of_others_do_not(spark, tmp_path):
    a, b = DailyTable(spark, f"{tmp_path}/t"), DailyTable(spark, f"{tmp_path}/t")

    def meanwhile(day):
        def build(first, last):
            b.extend(lambda x, y: _days(spark, x, y), day, day)
            return _days(spark, first, last)
        return build

    a.extend(meanwhile(D(2024, 1, 2)), D(2024, 1, 1), D(2024, 1, 1))
    assert a.covered() == [D(2024, 1, 1), D(2024, 1, 2)]
    with pytest.raises(Conflict):
        a.extend(meanwhile(D(2024, 1, 5)), D(2024, 1, 5), D(2024, 1, 6))
    assert a.covered() == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 5)]


def _scanned_days(df):
    """The ranges of days that the plan's scans are pruned to."""
    p = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[([^\]]*)", p)
    assert len(scans) == p.count("FileScan")
    return sorted({tuple(re.findall(r"day#\d+ [<>]= (2024-\d\d-\d\d)", s)) for s in scans})


@pytest.mark.parametrize("kind", ["frequency", "hours", "ab"])
def test_two_steps_equal_one_and_scan_only_new_days(spark, tmp_path, kind):
    w, scanned = TestWarehouse(spark, SMOKE_DIR), []
    scope = dict(partners=P.ab_partners, modulus=P.modulus, sentinel=P.sentinel)

    def build(a, z):
        if kind == "frequency":
            df = exposure.frequency_cells(w.displays, merchants=P.freq_merchants, start=a, end=z, sentinel=P.sentinel)
        elif kind == "hours":
            df = exposure.hourly_recency_cells(w.displays, merchants=P.hour_merchants, start=a, end=z, sentinel=P.sentinel)
        else:
            df = daily.ab_delivery_states(w.clicks, w.displays, start=a, end=z, **scope)
        scanned.append(_scanned_days(df))
        return df

    start, cut, end = D(2024, 1, 10), D(2024, 1, 14), D(2024, 1, 16)
    one, two = DailyTable(spark, f"{tmp_path}/one"), DailyTable(spark, f"{tmp_path}/two")
    one.extend(build, start, end)
    two.extend(build, start, cut)
    two.extend(build, start, end, replace=[D(2024, 1, 12)])
    assert rows(one.read()) == rows(two.read()) and one.read().count() > 0
    assert scanned[1:] == [[("2024-01-10", "2024-01-14")], [("2024-01-12", "2024-01-12")], [("2024-01-15", "2024-01-16")]]


# -- life of stored tables -----------------------------------------------------------
def test_drop_tables_leaves_results_other_applications_and_held_tables(spark):
    mine = storage.keep_table(spark.range(5), "t")
    result = storage.result_path(spark, "r")
    sinks.replace_table(mine, result)
    folder = storage._folder(spark)
    other = f"{folder.rsplit('/', 1)[0]}/another-application"
    spark.range(4).write.parquet(f"{other}/t")
    with storage.held(mine):
        assert not storage.drop_table(mine)
        assert [n.split("-")[0] for n in storage.drop_tables(spark)] == ["t"]
        assert mine.count() == 5
    assert storage.drop_tables(spark) == [] and not storage.exists(spark, folder)
    assert spark.read.parquet(result).count() == 5 and spark.read.parquet(f"{other}/t").count() == 4
    storage.delete(spark, other)


def test_sweep_removes_what_ended_applications_left(spark):
    storage.keep_table(spark.range(5), "t")
    parent = storage._folder(spark).rsplit("/", 1)[0]
    for name, until in (("ended", 1.0), ("alive", 1e12)):
        spark.range(4).write.parquet(f"{parent}/{name}/t")
        storage.write_file(spark, f"{parent}/{name}/{storage.LEASE_FILE}", b'{"until": %f}' % until)
    assert storage.sweep(spark) == ["ended"]
    names = storage.list_names(spark, parent)
    assert "alive" in names and "ended" not in names and storage._folder(spark).rsplit("/", 1)[1] in names
    storage.delete(spark, f"{parent}/alive")
