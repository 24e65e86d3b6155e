"""The skew-split previous-row lookups equal plain per-key windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from adlens.functions.sequence import CUTS, previous_in_sequence, with_segments
from conftest import rows


def _data(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.4 else rnd.randint(2, 12)   # user 1 is hot
        ts = rnd.randint(0, 10 * 86400)
        val = rnd.choice([None, None, rnd.randint(1, 99)])
        rows.append((i, user, ts, ts // 86400, val))
    return spark.createDataFrame(rows, "eid long, user long, ts long, day long, v long")


def test_lag_equals_plain_window(spark):
    df = _data(spark)
    got = previous_in_sequence(df, "user", "day", ["ts", "eid"], F.col("ts"), "prev")
    w = Window.partitionBy("user").orderBy("ts", "eid")
    exp = df.withColumn("prev", F.lag("ts").over(w))
    assert sorted(got.select("eid", "prev").collect()) == sorted(exp.select("eid", "prev").collect())


def test_last_non_null_equals_plain_window(spark):
    df = _data(spark, seed=11)
    got = previous_in_sequence(df, "user", "day", ["ts", "eid"], F.col("v"), "asof", ignore_nulls=True)
    w = Window.partitionBy("user").orderBy("ts", "eid").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("asof", F.last("v", ignorenulls=True).over(w))
    assert sorted(got.select("eid", "asof").collect()) == sorted(exp.select("eid", "asof").collect())


def test_partition_count_invariance(spark):
    df = _data(spark, seed=3)
    a = previous_in_sequence(df.repartition(1), "user", "day", ["ts", "eid"], F.col("ts"), "p")
    b = previous_in_sequence(df.repartition(13), "user", "day", ["ts", "eid"], F.col("ts"), "p")
    assert sorted(a.select("eid", "p").collect()) == sorted(b.select("eid", "p").collect())


def test_hot_hour_is_cut_by_size(spark):
    # one key holds a third of all rows in one hour, another many rows at one time
    data = [(7, 3600 * 5 + (i * 7919) % 3600, i) for i in range(2000)] + [(i % 40, 200 * i, 10_000 + i) for i in range(3500)] + \
           [(8, 99, 20_000 + i) for i in range(300)] + [(9, None, 30_000), (None, 5, 30_001)]
    df = spark.createDataFrame(data, "k long, t long, id long")
    for limit in (None, 100, 1):
        cut = with_segments(df, ["k"], "t", 3600, "seg", limit)
        assert cut.columns == ["k", "t", "id", "seg"] and cut.count() == df.count()
        sizes = {r["seg"]: r["count"] for r in cut.where("k = 7 and t is not null").groupBy("seg").count().collect()}
        hour = [n for seg, n in sizes.items() if seg // CUTS == 5]
        assert (len(hour) == 1) if limit is None else max(hour) <= max(limit, 2000 // CUTS + 8)
        got = previous_in_sequence(cut.where("k is not null and t is not null"), "k", "seg", ["t", "id"], F.col("id"), "prev")
        w = Window.partitionBy("k").orderBy("t", "id")
        want = df.where("k is not null and t is not null").withColumn("prev", F.lag("id").over(w))
        assert rows(got, "k", "id", "prev") == rows(want, "k", "id", "prev")
    assert rows(cut.where("t is null"), "id", "seg") == [(30_000, None)]
