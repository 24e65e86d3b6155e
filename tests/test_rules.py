"""First-match rules as a table; the look-back join under a hot user."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adlens.functions.rules import first_match, like_regex, rules_from
from adlens.operators import journey
from conftest import rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _case(col, rules, default):
    expr = None
    for pattern, label in rules:
        cond = F.col(col).like(pattern)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def test_rules_equal_the_case_form(spark):
    rng = random.Random(3)
    parts = ["a", "b", "ab", "%", "_", "%%", "\\%", "\\_", ".", "(", "[x]", "é", "日", "|", "\n", ";", "1", "Z"]
    rules = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))), f"l{i}") for i in range(60)] + [("", "empty"), ("%", "all")]
    texts = [None, "", "a", "%", "_", "\n", "a\nb", "x" * 500, "a;1;b", ";3;"] + [
        "".join(rng.choice("ab.([x]é日|\n;1Z%_") for _ in range(rng.randrange(8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 7, 61, 62):
        got = df.select(F.coalesce("t", F.lit("null")).alias("k"), first_match("t", rules[:n], "other").alias("a"), _case("t", rules[:n], "other").alias("b"))
        assert got.where("not a <=> b").count() == 0
    assert rows(df.select(first_match("t", [], "other").alias("x")).distinct()) == [("other",)]
    assert df.where("t = 'a'").select(first_match("t", [("b", "x")]).alias("x")).first().x is None
    nul = spark.createDataFrame([("a\x00b",)], "t string")
    assert nul.select(first_match("t", [("a_b", "x")]).alias("x")).first().x == "x"


def test_a_thousand_rules_do_not_grow_the_plan(spark):
    df = spark.range(3000).select(F.concat(F.lit("http://x/"), F.col("id"), F.lit("/end")).alias("url"))
    rules = [(f"%/{i}/%", f"rule {i}") for i in range(0, 1000, 2)] + [(f"%{i}/end", f"tail {i}") for i in range(500)]
    few, many = (df.select("url", first_match("url", r, "other").alias("label")) for r in (rules[:3], rules))
    nodes = [p.count("\n") for p in (_plan(few), _plan(many))]
    assert nodes[0] == nodes[1] and _plan(many).count("CASE WHEN") == _plan(few).count("CASE WHEN") and "LIKE" not in _plan(many)
    want = many.select(F.regexp_extract("url", "x/([0-9]+)/", 1).cast("int").alias("n"), "label").collect()

    def label(n):
        if n < 1000 and n % 2 == 0:
            return f"rule {n}"
        return next((f"tail {i}" for i in range(500) if str(n).endswith(str(i))), "other")

    assert all(r.label == label(r.n) for r in want)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("%b%", "late", 2), ("%a%", "first", 1), ("%c%", "null last", None), (None, "none", 0), ("%0%", "tie", 2)],
                                  "pattern string, label string, priority int")
    assert rules_from(table) == [("%a%", "first"), ("%0%", "tie"), ("%b%", "late"), ("%c%", "null last")]
    with pytest.raises(ValueError):
        rules_from(table, max_rules=3)
    assert like_regex("a%_\\%.") == "a[^\\x00]*[^\\x00]\\x25\\x2e"


# -- look-back ---------------------------------------------------------------------
def test_hot_user_is_spread_and_rows_stay_the_same(spark):
    day = dt.date(2024, 1, 20)
    now = 1_705_708_800
    events = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("uid"), F.lit(1).alias("partnerid"), F.lit(day).alias("day"),
        (F.lit(now) - F.col("id") * 11).alias("timestamp"), F.lit("view").alias("eventtype"),
        *[F.lit(None).cast("string").alias(c) for c in ("ua_device_family", "ua_os_family", "ua_browser_family", "useragent", "display_env")])
    buyers = spark.createDataFrame([(now - 20_000 * i, 1, u, u) for u in (1, 2, 3) for i in range(3)], "timestamp long, partner_id int, super_uid long, user_id long")

    def found(n):
        return journey.lookback_events(buyers, events, calc_date=day, rows_per_task=n)

    plain = rows(found(10**9))
    assert len(plain) > 4000 and rows(found(40)) == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        def largest(n):
            return max(r["count"] for r in found(n).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
        assert largest(10**9) > 0.5 * len(plain) > 0.4 * len(plain) > largest(40)
    finally:
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", None), ("spark.sql.adaptive.coalescePartitions.enabled", None),
                           ("spark.sql.shuffle.partitions", "4")):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
