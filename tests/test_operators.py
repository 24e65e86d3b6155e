
import datetime as dt

import pytest

from pyspark.sql import functions as F

from adlens.operators import abtest, exposure, funnel, identity, journey, response
from conftest import rows

D = dt.date


# -- frequency (A2/A3) ---------------------------------------------------------
def test_frequency_cells_filters_and_truncation(spark):
    disp = spark.createDataFrame([
        (1, D(2024, 1, 2), 10, "EU", 1.5, 1),
        (1, D(2024, 1, 2), 10, "EU", 1.99, 0),
        (1, D(2024, 1, 2), 10, "EU", -0.5, 1),    # truncates toward zero -> 0
        (1, D(2024, 1, 2), 10, "EU", 0.999, 0),
        (1, D(2024, 1, 2), None, "EU", 1.0, 1),   # NULL user dropped
        (1, D(2024, 1, 2), 0, "EU", 1.0, 1),      # sentinel dropped
        (1, D(2024, 1, 2), 11, "EU", None, 1),    # NULL recency dropped
        (1, D(2024, 1, 2), 12, "US", 1.0, 1),     # other platform dropped
        (3, D(2024, 1, 2), 13, "EU", 1.0, 1),     # other merchant dropped
    ], "merchant_id int, day date, user_id long, host_platform string, days_last_visit double, is_fbx int")
    cells = exposure.frequency_cells(disp, merchants=[1, 2], start=D(2024, 1, 1), end=D(2024, 1, 31),
                                     sentinel=0)
    assert rows(cells, "user_id", "days_last_visit", "total_displays", "fbx_displays") == [
        (10, 0, 2, 1), (10, 1, 2, 1)]
    avg = exposure.frequency_by_recency(cells)
    assert rows(avg) == [(0, 2.0, 1.0), (1, 2.0, 1.0)]


# -- order values (A20/A21) ---------------------------------------------------
def _sales(spark):
    def prods(*vals):
        return [(v, 1) for v in vals]
    data = [
        ("T1", 1, prods(10.0)), ("T1", 2, prods(10.0, 20.0)), ("T1", 3, prods(20.0)),  # max 30, latest 20
        ("T2", 1, prods(5.0)), ("T2", 2, []),                                          # latest empty -> gone
        ("T3", 1, None),                                                               # never has products
        ("T4", 5, prods(7.0)), ("T4", 5, None),                                        # same second
    ]
    return spark.createDataFrame(
        [(1, 1, D(2024, 1, 10), 7, t, "Sales", True, txn, p) for txn, t, p in data],
        "partner_id int, partner_partition int, day date, user_id long, unixtime long, event_name string, "
        "persistent_user boolean, transaction_id string, "
        "products array<struct<price:double,quantity:int>>")


def test_order_value_rules(spark):
    kw = dict(partners=[1], modulus=3, start=D(2024, 1, 1), end=D(2024, 1, 31), sentinel=0)
    mx = abtest.order_value_max(_sales(spark), **kw)
    lt = abtest.order_value_latest(_sales(spark), **kw)
    as_f = lambda df: {r.transaction_id: float(r.order_value) for r in df.collect()}
    assert as_f(mx) == {"T1": 30.0, "T2": 5.0, "T4": 7.0}
    assert as_f(lt) == {"T1": 20.0, "T4": 7.0}
    t = abtest.ab_transaction_measures(mx)
    assert [(r.transactions, float(r.order_value)) for r in t.collect()] == [(3, 42.0)]


# -- identity flags (A15) -----------------------------------------------------
def test_identity_flags_null_and_empty_ids(spark):
    schema = ("uid long, users long, events array<struct<uid:long, providers:array<struct<"
              "providertype:string, providerids:array<int>>>>>, host_platform string, day date")
    day = D(2024, 1, 30)
    ident = spark.createDataFrame([
        (1, 1, [(1, [("DATA_PROVIDER", None)])], "EU", day),
        (2, 0, [(2, [("PARTNER_ID", [5]), ("APP_CK", [])])], "EU", day),   # empty list contributes nothing
        (3, 1, [(3, [("PARTNER_ID", [1, 2]), ("CRM", None)])], "EU", day),
        (4, 0, [(4, [("DATA_PROVIDER", None)])], "US", day),               # other platform
    ], schema)
    got = rows(identity.identity_match_flags(ident, partner=5, day=day))
    assert got == [(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)]
    mc = rows(identity.matched_cookies(ident, day=day))
    assert mc == [(1, 1, 1), (2, 0, 1), (3, 1, 1)]


# -- funnel (A24) ---------------------------------------------------------------
def test_funnel_edges(spark):
    users = spark.createDataFrame([
        (1, D(2024, 1, 12)), (2, D(2024, 1, 11)), (3, D(2024, 1, 12)), (4, D(2024, 1, 13)),
        (5, D(2024, 1, 14)), (6, None), (7, D(2024, 1, 11))], "user_id long, first_day_seen date")

    def ev(u, day):
        ts = int(dt.datetime(day.year, day.month, day.day, 12, tzinfo=dt.timezone.utc).timestamp())
        return (1, 1, day, u, ts, True)
    site = spark.createDataFrame(
        [ev(1, D(2024, 1, 10)), ev(2, D(2024, 1, 10)), ev(4, D(2024, 1, 10)), ev(7, D(2024, 1, 7))],
        "partner_id int, partner_partition int, day date, user_id long, unixtime long, persistent_user boolean")
    out = funnel.funnel_stage(users, site, partners=[1], modulus=3, start=D(2024, 1, 11), mid_days=2,
                              sentinel=0)
    assert dict((r.user_id, r.funnel) for r in out.collect()) == {
        1: "Mid",    # gap exactly N
        2: "Lower",  # gap N-1
        3: "Mid",    # no earlier visit
        4: "Mid",    # first seen on start+N, early branch
        5: "Mid",    # first seen after start+N, late branch
        7: "Mid",    # visit before the look-back window
    }


# -- click recency (A8) -------------------------------------------------------
def test_conversion_by_click_recency_dedups_same_second(spark):
    clicks = spark.createDataFrame([
        (2, "EU", D(2024, 1, 3), 5, 100, 0.5), (2, "EU", D(2024, 1, 3), 5, 100, 0.5),
        (2, "EU", D(2024, 1, 3), 6, 200, None), (2, "EU", D(2024, 1, 3), 7, 300, 2.2)],
        "merchant_id int, host_platform string, day date, user_id long, timestamp long, days_last_visit double")
    tx = spark.createDataFrame([
        (2, "pc", 1, D(2024, 1, 4), 5, "a", 100), (2, "pc", 1, D(2024, 1, 4), 5, "a", 100),
        (2, "pc", 1, D(2024, 1, 4), 5, "b", 100), (2, "pv", 1, D(2024, 1, 4), 7, "c", 300)],
        "partner_id int, attribution_type string, deduplication_matching int, day date, user_id long, "
        "transaction_id string, click_timestamp long")
    out = response.conversion_by_click_recency(clicks, tx, partners=[2], click_start=D(2024, 1, 1),
                                               click_end=D(2024, 1, 31), trans_end=D(2024, 2, 28), sentinel=0)
    assert rows(out) == [(0, 1, 2), (2, 1, 0), (None, 1, 0)]


# -- switches and sequences (A29/A30) vs the naive row-number form ------------
def _naive_switches(events, partners, sentinel):
    kept = {"iPad", "iPhone", "Android - Smartphone", "Android - Tablet", "Desktop"}
    dev = lambda t: ("Smartphone" if t in ("iPhone", "Android - Smartphone")
                     else "Tablet" if t in ("iPad", "Android - Tablet") else "Desktop")
    rs = [dict(r, device=dev(r["device_type"])) for r in events
          if r["device_type"] in kept and r["partner_id"] in partners]
    rs.sort(key=lambda r: (r["partner_id"], r["super_uid"], -r["timestamp"], r["user_id"],
                           r["event_type"], r["device"]))
    out = []
    for a, b in zip(rs, rs[1:]):
        if a["user_id"] != b["user_id"] and a["user_id"] != sentinel:
            out.append(a)
    return out, rs


def _naive_sequences(switches, k=3):
    switches = sorted(switches, key=lambda r: (r["partner_id"], r["super_uid"], -r["timestamp"],
                                               r["user_id"], r["event_type"], r["device"]))
    res = []
    for i, r in enumerate(switches):
        buyer = (r["partner_id"], r["super_uid"])
        mx = max(s["timestamp"] for s in switches if (s["partner_id"], s["super_uid"]) == buyer)
        if r["timestamp"] != mx:
            continue
        nxt = []
        for j in range(1, k + 1):
            s = switches[i + j] if i + j < len(switches) else None
            nxt.append(s["device"] if s and (s["partner_id"], s["super_uid"]) == buyer else None)
        res.append((r["partner_id"], r["super_uid"], mx, r["device"], *nxt))
    return sorted(res, key=repr)


@pytest.mark.parametrize("scale", [1, 40000])   # same day / spread over many days
def test_cookie_switches_and_sequences_match_naive(spark, scale):
    ev = [
        # buyer (1, 10): ties at max ts, repeats, a sentinel row
        (100, 1, 10, 10, "iPhone", "Sales"), (100, 1, 10, 11, "iPad", "view"),
        (90, 1, 10, 11, "Desktop", "view"), (90, 1, 10, 11, "Desktop", "view"),
        (80, 1, 10, 0, "Desktop", "view"), (70, 1, 10, 12, "Android - Tablet", "view"),
        (60, 1, 10, 12, "App - Android", "view"),            # dropped device class
        # buyer (1, 11): one event; its user equals the next buyer's head user
        (50, 1, 11, 13, "Desktop", "Sales"),
        # buyer (1, 12): head user 13 too (adjacent buyers sharing a user)
        (40, 1, 12, 13, "iPhone", "Sales"), (30, 1, 12, 14, "Android - Smartphone", "view"),
        # partner 2, one buyer; very last row of the order
        (20, 2, 10, 15, "Desktop", "Sales"), (10, 2, 10, 16, "iPad", "view"),
        # partner 3 excluded by the partner list
        (5, 3, 10, 17, "Desktop", "Sales"),
    ]
    ev = [(t * scale, *rest) for t, *rest in ev]
    cols = ["timestamp", "partner_id", "super_uid", "user_id", "device_type", "event_type"]
    df = spark.createDataFrame(ev, "timestamp long, partner_id int, super_uid long, user_id long, "
                                   "device_type string, event_type string")
    dm = spark.createDataFrame([(i, 100 + i) for i in (1, 2, 3)], "merchant_id int, most_displayed_client_id int")
    dc = spark.createDataFrame([(100 + i,) for i in (1, 2, 3)], "client_id int")
    sw = journey.cookie_switches(df, dm, dc, partners=[1, 2], sentinel=0)
    naive, _ = _naive_switches([dict(zip(cols, r)) for r in ev], {1, 2}, 0)
    got = rows(sw, "timestamp", "partner_id", "super_uid", "user_id", "device")
    assert got == sorted(((r["timestamp"], r["partner_id"], r["super_uid"], r["user_id"], r["device"])
                          for r in naive), key=repr)
    seq = journey.device_sequence(sw)
    assert rows(seq, "partner_id", "super_uid", "timestamp_ref", "device_sale", "device_1", "device_2",
                "device_3") == _naive_sequences(naive)
    dist = journey.sequence_distribution(seq)
    assert sum(r["count"] for r in dist.collect()) == seq.count()


def test_lookback_window_and_identity_expansion(spark):
    buyers = spark.createDataFrame([(1, 7, 1000 * 86400)], "partner_id int, uid long, timestamp long")
    ident = spark.createDataFrame(
        [(7, 1, [(7, []), (8, [])], "EU", D(2024, 1, 30))],
        "uid long, users long, events array<struct<uid:long, providers:array<struct<providertype:string,"
        "providerids:array<int>>>>>, host_platform string, day date")
    full = journey.expand_identities(buyers, ident, calc_date=D(2024, 1, 30))
    # the uid lists itself, so it appears twice (self row + link)
    assert rows(full, "super_uid", "user_id") == [(7, 7), (7, 7), (7, 8)]
    t0 = 1000 * 86400
    ev = spark.createDataFrame([
        (1, 8, D(2024, 1, 29), t0 - 2592000, "view", None, "Windows", "Firefox", "x", "web"),      # edge: kept
        (1, 8, D(2024, 1, 29), t0 - 2592001, "view", "iPad", "iOS", "Safari", "x", "web"),          # too old
        (1, 8, D(2024, 1, 29), t0 + 1, "view", "iPad", "iOS", "Safari", "x", "web"),                # after sale
        (2, 8, D(2024, 1, 29), t0, "view", "iPad", "iOS", "Safari", "x", "web"),                    # other partner
        (1, 8, D(2023, 12, 1), t0 - 10, "view", "iPad", "iOS", "Safari", "x", "web"),               # outside days
    ], "partnerid int, uid long, day date, timestamp long, eventtype string, ua_device_family string, "
       "ua_os_family string, ua_browser_family string, useragent string, display_env string")
    lb = journey.lookback_events(full, ev, calc_date=D(2024, 1, 30))
    assert rows(lb, "timestamp", "user_id", "device_type") == [(t0 - 2592000, 8, "Desktop")]


def test_missing_columns_are_reported(spark):
    df = spark.createDataFrame([(1,)], "user_id long")
    with pytest.raises(ValueError, match="frequency_cells"):
        exposure.frequency_cells(df, merchants=[1], start=D(2024, 1, 1), end=D(2024, 1, 2))


def test_lazy_inputs_equal_materialized(spark):
    from adlens.sources.fixtures import TestWarehouse
    from conftest import SMOKE_DIR
    lazy, stored = TestWarehouse(spark, SMOKE_DIR, materialize=False), TestWarehouse(spark, SMOKE_DIR)
    for name in ("displays", "matched_transactions", "identity"):
        a, b = getattr(lazy, name), getattr(stored, name)
        cols = [c for c in a.columns if c not in ("events", "displayed_products")]
        assert rows(a, *cols) == rows(b, *cols), name


# -- money (A16, A19, A23) ------------------------------------------------------
def test_money_sum_keeps_small_and_odd_amounts(spark):
    from adlens.functions.money import money_sum
    total = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(money_sum("x")).first()[0]
    assert total([0.1] * 10) == 1.0
    assert total([4e-7] * 1000) == pytest.approx(4e-4, rel=1e-12)
    assert total([1e15, 1.5, None]) == 1e15 + 1.5
    assert total([None, None]) is None
    assert total([float("nan"), 1.0]) != total([float("nan"), 1.0])
    assert total([float("inf"), 1.0]) == float("inf")


def test_delivery_spend_sums_before_dividing(spark):
    displays = spark.range(1_000_000).select(
        F.lit(7).cast("long").alias("user_id"), F.lit(1).alias("merchant_id"), F.lit(1).alias("partner_partition"),
        F.lit("EU").alias("host_platform"), F.lit(D(2024, 1, 2)).alias("day"), F.lit(0.0004).alias("sum_display_revenue_local"))
    clicks = spark.createDataFrame([(1, 1, D(2024, 1, 2), 7, 2.5), (1, 1, D(2024, 1, 2), 8, None)],
                                   "partner_id int, partner_partition int, day date, user_id long, revenue_local double")
    out = abtest.ab_delivery_measures(clicks, displays, partners=[1], modulus=3, start=D(2024, 1, 1), end=D(2024, 1, 31), sentinel=0)
    assert rows(out, "user_id", "clicks", "spend", "displays") == [(7, 1, 2.9, 1_000_000), (8, 1, None, 0)]


def test_latest_order_value_null_rules(spark):
    data = [("T1", 1, [(5.0, 1)]), (None, 1, [(9.0, 1)]), ("T2", 1, [(5.0, 1)]), ("T2", 2, [None]), ("T3", 1, [(None, 1)])]
    ev = spark.createDataFrame([(1, 1, D(2024, 1, 10), 7, t, "Sales", True, txn, p) for txn, t, p in data],
                               "partner_id int, partner_partition int, day date, user_id long, unixtime long, event_name string, "
                               "persistent_user boolean, transaction_id string, products array<struct<price:double,quantity:int>>")
    kw = dict(partners=[1], modulus=3, start=D(2024, 1, 1), end=D(2024, 1, 31), sentinel=0)
    assert rows(abtest.order_value_latest(ev, **kw), "transaction_id", "order_value") == [
        ("T1", 5.0), ("T2", None), ("T3", None)]
    assert (None, 9.0) in rows(abtest.order_value_max(ev, **kw), "transaction_id", "order_value")


# -- switches for every type of buyer id (A29) ------------------------------------
@pytest.mark.parametrize("kind, ids", [
    ("long", [-5, 9, 10, 110, 2**60, -2**61]), ("decimal(10,2)", ["9", "10", "110", "-3.5", "110.25", "2"]),
    ("double", [9.0, 10.0, 110.0, -0.5, 1e18, 2.25]), ("string", ["9", "10", "110", "ab", "aa-1", ""]),
    ("long", [None, 4, 5, 6, 7, 8])])
def test_switches_with_any_buyer_id(spark, kind, ids):
    import random
    from decimal import Decimal
    rng = random.Random(len(kind))
    ids = [Decimal(i) for i in ids] if kind.startswith("decimal") else ids
    ev = [(rng.randrange(200_000), rng.choice([1, 2]), u, rng.randrange(4), rng.choice(["iPhone", "iPad", "Desktop"]), "view", n)
          for u in ids for n in range(15)]
    df = spark.createDataFrame(ev, f"timestamp long, partner_id int, super_uid {kind}, user_id long, device_type string, "
                                   "event_type string, tier int")
    dm = spark.createDataFrame([(i, 100 + i) for i in (1, 2)], "merchant_id int, most_displayed_client_id int")
    dc = spark.createDataFrame([(100 + i,) for i in (1, 2)], "client_id int")
    sw = journey.cookie_switches(df, dm, dc, partners=[1, 2], sentinel=0).cache()
    dev = {"iPhone": "Smartphone", "iPad": "Tablet", "Desktop": "Desktop"}
    order = lambda r: (r[1], r[2] is not None, r[2], -r[0], r[3], r[5], dev[r[4]]) if r[2] is not None else (
        r[1], False, 0, -r[0], r[3], r[5], dev[r[4]])
    ordered = sorted(ev, key=order)
    want = [(a[0], a[1], a[2], a[3], dev[a[4]]) for a, b in zip(ordered, ordered[1:]) if a[3] != b[3] and a[3] != 0]
    assert rows(sw, "timestamp", "partner_id", "super_uid", "user_id", "device") == sorted(want, key=repr)
    assert "tier" in sw.columns and "tier" in journey.device_sequence(sw).columns


def test_string_user_ids_with_a_string_sentinel(spark):
    disp = spark.createDataFrame([
        (1, D(2024, 1, 2), u, "EU", 1.5, 1) for u in ("a", "a", "b", "none", None)],
        "merchant_id int, day date, user_id string, host_platform string, days_last_visit double, is_fbx int")
    cells = exposure.frequency_cells(disp, merchants=[1], start=D(2024, 1, 1), end=D(2024, 1, 31), sentinel="none")
    assert rows(cells, "user_id", "total_displays") == [("a", 2), ("b", 1)]


# -- hot user in the look-back (A28) and hot buyer in the sequence (A30) -------------
def test_hot_user_in_the_lookback(spark):
    t0 = 1000 * 86400
    full = spark.createDataFrame([(t0, 1, 7, 8), (t0 - 86400, 1, 9, 8)],
                                 "timestamp long, partner_id int, super_uid long, user_id long")
    ev = spark.range(20_000).select(
        F.lit(1).alias("partnerid"), F.lit(8).cast("long").alias("uid"), F.lit(D(2024, 1, 29)).alias("day"),
        (F.lit(t0 + 1000) - F.col("id") * 200).alias("timestamp"), F.lit("view").alias("eventtype"),
        *[F.lit("x").alias(c) for c in ("ua_device_family", "ua_os_family", "ua_browser_family", "useragent", "display_env")])
    lb = journey.lookback_events(full, ev, calc_date=D(2024, 1, 30))
    ts = [t0 + 1000 - i * 200 for i in range(20_000)]
    want = {b: sum(e - 2592000 <= t <= e for t in ts) for b, e in ((7, t0), (9, t0 - 86400))}
    assert {r.super_uid: r["count"] for r in lb.groupBy("super_uid").count().collect()} == want


def test_hot_buyer_in_the_sequence(spark):
    sw = spark.range(50_000).select(
        F.expr("id div 2").alias("timestamp"), F.lit(1).alias("partner_id"), F.lit(5).cast("long").alias("super_uid"),
        F.concat(F.lit("d"), F.col("id")).alias("device"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"))
    assert rows(journey.device_sequence(sw), "timestamp_ref", "device_sale", "device_1", "device_2", "device_3") == [
        (24999, "d49998", "d49999", "d49996", "d49997"), (24999, "d49999", "d49996", "d49997", "d49994")]


# -- metamorphic: days add up -------------------------------------------
def test_user_measures_are_sums_of_their_branches(spark):
    from adlens.plans.registry import REGISTRY
    from conftest import SMOKE_DIR
    users = REGISTRY["ab_user_measures"](spark, SMOKE_DIR)
    got = users.agg(*[F.sum(c) for c in ("events", "clicks", "displays", "transactions", "spend", "order_value")]).first()
    branch = lambda name, *cols: REGISTRY[name](spark, SMOKE_DIR).agg(*[F.sum(c) for c in cols]).first()
    want = [*branch("ab_event_measures", "events"), *branch("ab_delivery_measures", "clicks", "displays")]
    tx = branch("ab_transaction_measures", "transactions", "order_value")
    want += [tx[0], branch("ab_delivery_measures", "spend")[0], tx[1]]
    assert list(got) == pytest.approx(want)


def test_cells_of_two_periods_add_up(spark):
    from adlens.params import P
    from adlens.sources.fixtures import TestWarehouse
    from conftest import SMOKE_DIR
    w = TestWarehouse(spark, SMOKE_DIR)
    cells = lambda a, b: rows(exposure.frequency_cells(w.displays, merchants=[1, 2], start=a, end=b, sentinel=0))
    mid = D(2024, 1, 14)
    assert sorted(cells(P.freq_start, mid) + cells(mid + dt.timedelta(days=1), P.freq_end), key=repr) == cells(P.freq_start, P.freq_end)


# -- items and feeds (A9, A13) and reach (A1) -----------------------------------------
def test_feeds_items_and_reach(spark):
    from adlens.operators import items
    day = D(2024, 1, 2)
    clicks = spark.createDataFrame(
        [(1, 1, day, 5, 11, 2.0), (1, 1, day, 6, 11, 3.0), (1, 1, day, 6, 12, None), (1, 1, day, 6, None, 1.0),
         (4, 1, day, 6, 13, 1.0), (1, 1, day, 6, 99, 1.0)],
        "partner_id int, partner_partition int, day date, user_id long, item_id long, revenue_local double")
    catalog = spark.createDataFrame(
        [(1, 1, 11, "e11", "http://x/promo/a"), (1, 1, 12, "e12", "http://x/b"), (4, 1, 13, "e13", "http://x/c")],
        "partnerid int, partner_partition int, sqlid long, id string, producturl string")
    feeds = response.clicks_by_feed(clicks, catalog, partner=1, partition=1, start=day, end=day, rules=[("%promo%", "p")])
    assert rows(feeds, "type", "click") == [("other", 1), ("p", 2)]
    reco = spark.createDataFrame([(1, day, "EU", [(11,), (11,)]), (1, day, "US", [(11,)]), (1, day, "EU", None), (2, day, "EU", [(11,)])],
                                 "partnerid int, day date, host_platform string, displayed_products array<struct<itemid:long>>")
    for modulus in (None, 3):
        stats = items.item_display_click_stats(reco, clicks, catalog, partners=[1], click_partitions=[1], start=day, end=day,
                                               modulus=modulus)
        assert rows(stats, "partnerid", "itemid", "external_item_id", "displays", "clicks", "revenue_local") == [
            (1, "11", "e11", 2, 2, 5.0), (1, "12", "e12", 0, 1, None), (4, "13", "e13", 0, 1, 1.0)]
    disp = spark.createDataFrame([(1, 1, day, u, 1, 101) for u in (5, 5, 6, 0, None)] + [(2, 2, day, 9, 1, 101)],
                                 "partner_id int, partner_partition int, day date, user_id long, campaign_id int, client_id int")
    reach = exposure.display_reach(disp, start=day, campaign_id=1, client_id=101, partner_partition=1, sentinel=0)
    assert rows(reach, "unique_users", "displays") == [(2, 3)]
