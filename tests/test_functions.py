import datetime as dt

from pyspark.sql import functions as F

from adlens.functions import (
    ab_population, band_by_edges, classify_device, collapse_device, epoch_to_day, hour_ladder,
    matched_band,
)
from adlens.functions.bands import bucket_labels
from adlens.functions.devices import DEVICE_TYPES_KEPT


def test_hour_ladder_inclusive_edges(spark):
    vals = [(k / 24,) for k in range(1, 25)] + [(1 / 24 + 1e-9,), (0.0,), (-0.5,), (1.0000001,), (None,)]
    df = spark.createDataFrame(vals, "d double")
    got = {r.d: r.h for r in df.select("d", hour_ladder("d").alias("h")).collect()}
    for k in range(1, 25):
        assert got[k / 24] == k
    assert got[1 / 24 + 1e-9] == 2
    assert got[0.0] == 1 and got[-0.5] == 1   # the ladder has no lower bound
    assert got[1.0000001] is None and got[None] is None


def test_band_by_edges_labels_and_open_end(spark):
    edges = (2, 4)
    assert bucket_labels(edges) == ["Max2", "Max4", "Over4"]
    assert bucket_labels((1.25, 2.0)) == ["Max1.25", "Max2", "Over2"]
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (4.0,), (9.0,)], "x double")
    got = dict(df.select("x", band_by_edges("x", edges).alias("b")).collect())
    assert got == {1.0: "Max2", 2.0: "Max2", 2.5: "Max4", 4.0: "Max4", 9.0: "Over4"}


def test_matched_band_null_is_one(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,), (7,)], "m long")
    got = [r.b for r in df.select(matched_band("m").alias("b")).collect()]
    assert got == [1, 1, 2, 3, 3]


def test_population_deterministic_and_null_control(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id long")
    a = [r.p for r in df.select(ab_population("user_id", 42).alias("p")).collect()]
    b = [r.p for r in df.select(ab_population("user_id", 42).alias("p")).collect()]
    assert a == b
    assert a[-1] == "control"
    assert set(a[:-1]) <= {"exposed", "control"}
    # a different test id reshuffles at least one of many users
    many = spark.range(200).withColumnRenamed("id", "user_id")
    x = many.select(ab_population("user_id", 1).alias("a"), ab_population("user_id", 2).alias("b"))
    assert x.where(F.col("a") != F.col("b")).count() > 0
    assert 60 < many.where(ab_population("user_id", 1) == "exposed").count() < 140


def test_classify_device_one_row_per_rule(spark):
    rows = [
        ("iPad", "iOS", "Safari", "x", "web", "iPad"),
        ("iPhone", "iOS", "Safari", "x", "web", "iPhone"),
        ("Galaxy", "Android", "Chrome", "Foo MOBILE bar", "web", "Android - Smartphone"),
        ("Galaxy Tab", "Android", "Chrome", "Foo bar", "web", "Android - Tablet"),
        ("Phone", "Other", "other", "sdk", "app_android", "App - Android"),
        ("Phone", "Other", "other", "sdk", "app_ios", "App - Apple"),
        ("Phone", "Other", "Other", "sdk", "app_android", "Mobile - Other"),   # 'Other' != 'other'
        ("Mac", "Mac OS X", "SaFaRi", "x", "web", "Desktop"),                  # case-insensitive safari
        ("Other", "Windows", "Chrome", "x", "web", "Desktop"),
        (None, "Windows", "Firefox", "x", "web", "Desktop"),
        ("Unknown", "Linux", "Firefox", "x", "web", "Desktop"),
        ("Nokia", "Windows Phone", "IE", "x", "web", "Mobile - Other"),
    ]
    df = spark.createDataFrame(rows, "ua_device_family string, ua_os_family string, "
                                     "ua_browser_family string, useragent string, display_env string, exp string")
    out = df.select("exp", classify_device().alias("got")).collect()
    assert [r.got for r in out] == [r.exp for r in out]


def test_collapse_device(spark):
    df = spark.createDataFrame([(t,) for t in DEVICE_TYPES_KEPT], "device_type string")
    got = dict(df.select("device_type", collapse_device().alias("d")).collect())
    assert got == {"iPad": "Tablet", "iPhone": "Smartphone", "Android - Smartphone": "Smartphone",
                   "Android - Tablet": "Tablet", "Desktop": "Desktop"}


def test_epoch_to_day_is_utc_and_session_tz_independent(spark):
    df = spark.createDataFrame([(0,), (86399,), (86400,), (1704067207,)], "t long")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = [r.d for r in df.select(epoch_to_day("t").alias("d")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.date(1970, 1, 1), dt.date(1970, 1, 1), dt.date(1970, 1, 2), dt.date(2024, 1, 1)]
