"""Mergeable distinct counts, reach from daily states, tables bucketed by user, folded match flags."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adlens.functions.distinct import (
    bitmap_states, count_bitmaps, count_sketches, distinct_count, merge_bitmaps, sketch_states,
)
from adlens.functions.money import money_merge, money_state, money_sum
from adlens.operators import daily, exposure, identity, reach
from adlens.params import P
from adlens.plans.registry import _ab_users_of, _bucketed, _per_user
from adlens.sources.buckets import UserBuckets
from adlens.sources.fixtures import TestWarehouse
from adlens.sources.versions import DailyTable
from conftest import SMOKE_DIR, rows

D = dt.date


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- states ------------------------------------------------------------------------
def test_bitmaps_equal_count_distinct(spark):
    ids = [0, 1, -1, -32768, -32769, 32767, 32768, 32769, 10**12, 2**62, None, None]
    df = spark.createDataFrame([(d, g, i) for d in range(4) for g in "ab" for i in ids if i is None or (i + d) % 3 or g == "a"]
                               + [(0, "a", 1)] * 50 + [(1, "only null", None)], "day int, g string, id long")
    states = bitmap_states(df, "id", ["day", "g"])
    for by in (["g"], ["day"], ["day", "g"], []):
        got = rows(count_bitmaps(merge_bitmaps(states, ["day", "g"]), by, "n"))
        assert got == rows(df.groupBy(*by).agg(F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("n_rows")))
    assert rows(count_bitmaps(states.where("false"), [], "n")) == [(0, 0)]
    assert count_bitmaps(states.where("false"), ["g"], "n").count() == 0


def test_sketches_are_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.concat(F.lit("user-"), F.col("id") % 20_000).alias("id"))
    states = sketch_states(df, "id", ["day"])
    assert states.count() == 3
    (n, total), = rows(count_sketches(states, [], "n"))
    assert total == 60_000 and abs(n / 20_000 - 1) < 3 * 1.04 / 2**6
    wide, = rows(count_sketches(sketch_states(df, "id", ["day"], lg_k=15), [], "n"), "n")[0]
    assert abs(wide / 20_000 - 1) < 3 * 1.04 / 2**7.5
    assert rows(count_sketches(states.where("false"), [], "n")) == [(0, 0)]
    (near, exact), = rows(df.agg(distinct_count("id", True).alias("a"), distinct_count("id").alias("b")))
    assert exact == 20_000 and abs(near / exact - 1) < 0.05


def test_money_states_add_up_without_loss(spark):
    values = [0.1, 0.2, 0.3, 1e-9, 1e8, 2e9, 3.3e12, None, -7.25]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(9, None)], "day int, v double")
    states = df.groupBy("day").agg(*money_state("v", "v"))
    assert rows(states.agg(money_merge("v").alias("x"))) == rows(df.agg(money_sum("v").alias("x")))
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "day int, v double")
    assert str(rows(nan.groupBy("day").agg(*money_state("v", "v")).agg(money_merge("v").alias("x")))) == "[(nan,)]"


# -- reach -------------------------------------------------------------------------
def test_reach_of_a_range_reads_states_alone(spark, tmp_path):
    w = TestWarehouse(spark, SMOKE_DIR)
    table = DailyTable(spark, f"{tmp_path}/reach")
    for a, z in ((D(2024, 1, 1), D(2024, 1, 9)), (D(2024, 1, 10), D(2024, 1, 31))):
        table.extend(lambda x, y: reach.daily_reach_states(w.displays, start=x, end=y, sentinel=P.sentinel), a, z)
    who = dict(campaign_id=P.reach_campaign, client_id=P.reach_client, partner_partition=P.reach_partner % P.modulus)
    for a, z in ((D(2024, 1, 1), None), (D(2024, 1, 5), D(2024, 1, 20)), (D(2024, 1, 8), D(2024, 1, 8)), (D(2025, 1, 1), None)):
        merged = reach.reach_from_states(table.read(), start=a, end=z, **who)
        assert rows(merged) == rows(exposure.display_reach(w.displays, start=a, end=z, sentinel=P.sentinel, **who))
        assert all("/reach/" in f for f in merged.inputFiles())
    near = exposure.display_reach(w.displays, start=D(2024, 1, 1), sentinel=P.sentinel, approx=True, **who)
    exact = exposure.display_reach(w.displays, start=D(2024, 1, 1), sentinel=P.sentinel, **who)
    assert abs(near.first().unique_users - exact.first().unique_users) <= 0.05 * exact.first().unique_users


def test_estimated_reach_is_near_the_exact_one(spark):
    w = TestWarehouse(spark, "/root/testdata/sf0.01")
    exact = reach.reach_by_window(reach.daily_reach_states(w.displays, sentinel=0), P.reach_windows)
    near = reach.estimated_reach_by_window(reach.daily_reach_sketches(w.displays, sentinel=0), P.reach_windows)
    keys = ["window_start", "window_end", "campaign_id", "client_id"]
    both = exact.join(near.select(*keys, F.col("unique_users").alias("guess"), F.col("displays").alias("d")), keys).collect()
    assert len(both) == exact.count() > 30
    assert all(r.displays == r.d and abs(r.guess / r.unique_users - 1) < 0.05 for r in both)


def test_approximate_variants_return_the_same_columns(spark):
    w = TestWarehouse(spark, SMOKE_DIR)
    exact = identity.matched_cookies(w.identity, day=P.identity_day)
    near = identity.matched_cookies(w.identity, day=P.identity_day, approx=True)
    assert near.columns == exact.columns and rows(near) == rows(exact)   # sketches are exact for few ids


# -- tables bucketed by user -----------------------------------------------------------
@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_per_user_joins_need_no_exchange(spark, no_broadcast):
    store = _bucketed(TestWarehouse(spark, SMOKE_DIR))
    a6 = _plan(_per_user(store.even("displays"), store.even("clicks"), store.even("matched_transactions")))
    a23 = _plan(_ab_users_of(store, even=True))
    for p, joins in ((a6, 3), (a23, 4)):
        assert "Exchange" not in p and p.count("SortMergeJoin") == joins
        assert "PartitionFilters: [partner_partition" in p and "Bucketed: true" in p


def test_joined_measures_equal_the_union_form(spark):
    from adlens.operators import abtest
    kinds = [None, 0.0, 2.5]
    keys = "user_id long, partner_id int"
    users = range(210)
    spine = spark.createDataFrame([(u, 1) for u in users] + [(7, 2)], keys)
    e = spark.createDataFrame([(u, 1, D(2024, 1, 1), 3) for u in users if u % 2], f"{keys}, first_day_seen date, events long")
    c = spark.createDataFrame([(u, 1, 2, kinds[u % 3]) for u in users if u % 5 < 3], f"{keys}, clicks long, cr double")
    d = spark.createDataFrame([(u, 1, 2, kinds[u // 2 % 3]) for u in users if u % 4 < 2], f"{keys}, displays long, dr double")
    t = spark.createDataFrame([(u, 1, 2, kinds[u // 7 % 3]) for u in users if u % 7 < 4], f"{keys}, transactions long, order_value double")
    zero = F.lit(0).cast("bigint")
    both = c.join(d, ["user_id", "partner_id"], "full").select(
        "user_id", "partner_id", F.coalesce("clicks", zero).alias("clicks"), abtest.spend_of("cr", "dr").alias("spend"),
        F.coalesce("displays", zero).alias("displays"))
    assert rows(abtest.ab_user_measures_joined(spine, e, c, d, t, test_id=1)) == rows(abtest.ab_user_measures(e, both, t, test_id=1))


def test_bucketing_reads_each_table_three_times(spark, tmp_path):
    """Once for users and spine, once for each side."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "user_id long, partner long, part int"
    facts = spark.range(1000).select((F.col("id") % 50).alias("user_id"), (F.col("id") % 3).alias("partner"), (F.col("id") % 2).cast("int").alias("part"))
    sales = facts.where("user_id < 20")
    store = UserBuckets(spark, f"{tmp_path}/store", 8)
    store.write({"facts": facts.mapInArrow(passed, schema), "sales": sales.mapInArrow(passed, schema)},
                {"facts": ["part"], "sales": []}, spine=["user_id", "partner"])
    assert read.value == 3 * (1000 + 400)
    assert rows(store.even("facts").unionByName(store.heavy("facts")), "user_id", "partner", "part") == rows(facts)
    assert rows(store.even("spine").unionByName(store.heavy("spine"))) == rows(facts.select("user_id", "partner").distinct())


def test_heavy_users_lie_apart_and_tables_can_be_entered_again(spark, tmp_path):
    events = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None)
                                      .otherwise(F.col("id")).alias("user_id"), (F.col("id") % 2).alias("part"), F.col("id").alias("v"))
    sales = spark.createDataFrame([(i, 0, 1) for i in range(100)] + [(7, 1, 2), (None, 1, 3)], "user_id long, part long, v long")
    store = UserBuckets(spark, f"{tmp_path}/store", 8)
    assert store.heavy_users(events) == [7] and store.heavy_users(sales) == []
    store.write({"events": events, "sales": sales}, {"events": ["part"]})
    for name, df in (("events", events), ("sales", sales)):
        assert rows(store.even(name).unionByName(store.heavy(name)), "user_id", "part", "v") == rows(df)
        heavy = {r.user_id for r in store.heavy(name).collect()}
        assert heavy == {7, None}
        assert not store.even(name).where("user_id = 7 or user_id is null").count()
    spark.sql(f"DROP TABLE {store.catalog_name('events')}")
    again = UserBuckets(spark, f"{tmp_path}/store", 8).even("events")          # as a new session would
    assert "Exchange" not in _plan(again.groupBy("user_id").count())
    assert again.count() + store.heavy("events").count() == 3000
    store.write({"events": events.limit(5)}, {})
    assert store.even("events").count() + store.heavy("events").count() == 5
    with pytest.raises(FileNotFoundError):
        UserBuckets(spark, f"{tmp_path}/store", 8).heavy("nothing")


# -- states of A23 -----------------------------------------------------------------------
@pytest.mark.parametrize("rule", ["max", "latest"])
def test_order_values_from_states_keep_odd_emissions(spark, rule):
    from adlens.operators import abtest
    day = D(2024, 1, 12)
    data = []
    for u, tx, t, products in [
            (1, "a", 10, [(1.5, 2)]), (1, "a", 20, [(1.0, 1)]), (1, "b", 10, [(3.0, 1)]), (1, "b", 20, None),
            (2, "c", 10, []), (2, "d", 10, [None]), (2, None, 10, [(4.0, 1)]), (3, "e", 10, [(None, 1), (0.1, 3)]),
            (3, "e", 86400 * 2, [(0.2, 1)]), (4, "f", 10, [(2e9, 1)]), (4, "f", 10, [(0.1, 1)])]:
        d = day + dt.timedelta(days=t // 86400)
        data.append((1, 1, d, u, t, "Sales", True, tx, products))
    ev = spark.createDataFrame(data, "partner_id int, partner_partition int, day date, user_id long, unixtime long, event_name string, "
                               "persistent_user boolean, transaction_id string, products array<struct<price:double,quantity:int>>")
    scope = dict(partners=[1], modulus=3, start=day, end=day + dt.timedelta(days=5), sentinel=0)
    direct = (abtest.order_value_max if rule == "max" else abtest.order_value_latest)(ev, **scope)
    states = daily.ab_emission_states(ev, **scope)
    merged = daily.order_values_from_states(states, rule, start=scope["start"], end=scope["end"])
    assert rows(merged, *direct.columns) == rows(direct)


# -- folded flags --------------------------------------------------------------------------
def _flags_by_explode(graph, partner, day):
    x = (graph.where((F.col("day") == F.lit(day)) & (F.col("host_platform") == "EU")).select(F.explode("events").alias("e"))
         .select(F.col("e.uid").alias("uid"), F.explode("e.providers").alias("p"))
         .select("uid", "p.providertype", F.explode(F.coalesce("p.providerids", F.array(F.lit(0)))).alias("i")))
    t, i = F.col("providertype"), F.col("i")

    def flag(c):
        return F.max(F.when(c, 1).otherwise(0))

    return x.groupBy("uid").agg(
        flag(t.isin("DATA_PROVIDER", "APP_CK")).alias("platform_match"), flag((t == "PARTNER_ID") & (i == partner)).alias("client_match"),
        flag((t != "DATA_PROVIDER") & (t != "APP_CK") & ((t != "PARTNER_ID") | (i != partner))).alias("other_client_match"))


def test_match_flags_fold_nested_lists_in_one_explode(spark):
    providers = [None, [], [None], [("DATA_PROVIDER", None)], [("APP_CK", [])], [("APP_CK", [3])], [("PARTNER_ID", [1])],
                 [("PARTNER_ID", [None])], [("PARTNER_ID", [None, 2])], [("PARTNER_ID", None)], [("CRM", None)], [("CRM", [])],
                 [("CRM", [None])], [(None, [1])], [("PARTNER_ID", [1, 2]), ("APP_CK", None)], [("CRM", []), ("PARTNER_ID", [1])]]
    links = [(100 + i, p) for i, p in enumerate(providers)] + [(100, [("CRM", None)]), (None, [("CRM", None)])]
    graph = spark.createDataFrame([(1, 0, links, "EU", D(2024, 1, 30)), (2, 0, None, "EU", D(2024, 1, 30)), (3, 0, [None], "EU", D(2024, 1, 30)),
                                   (4, 0, links[:3], "US", D(2024, 1, 30))],
                                  "uid long, users long, events array<struct<uid:long,providers:array<struct<providertype:string,"
                                  "providerids:array<int>>>>>, host_platform string, day date")
    got = identity.identity_match_flags(graph, partner=1, day=D(2024, 1, 30))
    assert rows(got) == rows(_flags_by_explode(graph, 1, D(2024, 1, 30)))
    p = _plan(got)
    assert p.count("Generate explode") == 1
