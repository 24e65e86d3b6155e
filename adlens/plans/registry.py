"""Named query plans over the bundled test data: ``name -> (spark, sf_dir) -> DataFrame``.

Each plan derives its inputs from the given tables (``sources.fixtures``)
and applies one analysis with the frozen parameters of ``params.P``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.predicates import partitions_for
from adlens.functions.rules import rules_from
from adlens.operators import abtest, daily, exposure, funnel, identity, items, journey, preview, reach, response
from adlens.params import P
from adlens.sources import sinks
from adlens.sources.buckets import SPINE, UserBuckets
from adlens.sources.fixtures import TestWarehouse
from adlens.sources.storage import keep_table, result_path
from adlens.sources.versions import DailyTable, VersionedTable

Plan = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Plan] = {}


def plan(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _w(spark, sf_dir) -> TestWarehouse:
    return TestWarehouse(spark, sf_dir)


# -- exposure ---------------------------------------------------------------
@plan("display_reach")
def q_display_reach(spark, sf_dir):
    w = _w(spark, sf_dir)
    return exposure.display_reach(w.displays, start=P.reach_start, campaign_id=P.reach_campaign,
                                  client_id=P.reach_client,
                                  partner_partition=P.reach_partner % P.modulus, sentinel=P.sentinel)


def _freq_cells(w, non_fbx_only=False):
    return exposure.frequency_cells(w.displays, merchants=P.freq_merchants, start=P.freq_start,
                                    end=P.freq_end, platform=P.platform, sentinel=P.sentinel,
                                    non_fbx_only=non_fbx_only)


def _hour_cells(w):
    return exposure.hourly_recency_cells(w.displays, merchants=P.hour_merchants, start=P.hour_start,
                                         end=P.hour_end, platform=P.platform, sentinel=P.sentinel)


@plan("frequency_cells")
def q_frequency_cells(spark, sf_dir):
    return _freq_cells(_w(spark, sf_dir))


@plan("frequency_by_recency")
def q_frequency_by_recency(spark, sf_dir):
    return exposure.frequency_by_recency(_freq_cells(_w(spark, sf_dir)))


@plan("frequency_by_recency_non_fbx")
def q_frequency_by_recency_non_fbx(spark, sf_dir):
    return exposure.frequency_by_recency(_freq_cells(_w(spark, sf_dir), non_fbx_only=True))


@plan("hourly_recency_cells")
def q_hourly_recency_cells(spark, sf_dir):
    return _hour_cells(_w(spark, sf_dir))


@plan("frequency_by_hour")
def q_frequency_by_hour(spark, sf_dir):
    return exposure.frequency_by_hour(_hour_cells(_w(spark, sf_dir)))


@plan("response_by_exposure_bucket")
def q_response_by_exposure_bucket(spark, sf_dir):
    w = _w(spark, sf_dir)
    return exposure.response_by_exposure_bucket(
        w.displays, w.clicks, w.matched_transactions, _freq_cells(w), partners=P.freq_merchants,
        modulus=P.modulus, start=P.freq_start, end=P.freq_end, sentinel=P.sentinel,
        edges=P.exposure_edges)


@plan("response_by_exposure_bucket_wide")
def q_response_by_exposure_bucket_wide(spark, sf_dir):
    # one cell per user and recency over the whole period: the users reach the upper buckets
    w = _w(spark, sf_dir)
    cells = _freq_cells(w).groupBy("user_id").agg(F.sum("total_displays").alias("total_displays"))
    return exposure.response_by_exposure_bucket(
        w.displays, w.clicks, w.matched_transactions, cells, partners=P.freq_merchants,
        modulus=P.modulus, start=P.freq_start, end=P.freq_end, sentinel=P.sentinel, edges=P.wide_edges)


@plan("response_by_exposure_bucket_partner")
def q_response_by_exposure_bucket_partner(spark, sf_dir):
    w = _w(spark, sf_dir)
    return exposure.response_by_exposure_bucket(
        w.displays, w.clicks, w.matched_transactions, _hour_cells(w), partners=P.hour_merchants,
        modulus=P.modulus, start=P.hour_start, end=P.hour_end, sentinel=P.sentinel,
        edges=P.hour_edges, by_partner=True)


@plan("hourly_response_detail")
def q_hourly_response_detail(spark, sf_dir):
    w = _w(spark, sf_dir)
    return exposure.hourly_response_detail(
        _hour_cells(w), w.clicks, w.matched_transactions, merchants=P.hour_merchants,
        start=P.hour_start, end=P.hour_end, platform=P.platform, sentinel=P.sentinel)


# -- response ---------------------------------------------------------------
def _recency(spark, sf_dir, partners):
    w = _w(spark, sf_dir)
    return response.conversion_by_click_recency(
        w.clicks, w.matched_transactions, partners=partners, click_start=P.click_start,
        click_end=P.click_end, trans_end=P.trans_end, platform=P.platform, sentinel=P.sentinel)


@plan("conversion_by_click_recency")
def q_conversion_by_click_recency(spark, sf_dir):
    return _recency(spark, sf_dir, P.recency_partners)


@plan("conversion_by_click_recency_multi")
def q_conversion_by_click_recency_multi(spark, sf_dir):
    return _recency(spark, sf_dir, P.recency_partners_multi)


@plan("clicks_by_feed")
def q_clicks_by_feed(spark, sf_dir):
    w = _w(spark, sf_dir)
    return response.clicks_by_feed(w.clicks, w.catalog, partner=P.feed_partner,
                                   partition=P.feed_partner % P.modulus, start=P.feed_start,
                                   end=P.feed_end, rules=P.feed_rules)


@plan("clicks_by_feed_rules")
def q_clicks_by_feed_rules(spark, sf_dir):
    # some hundred overlapping rules from the catalog itself: a type with a word, and the word alone
    w = _w(spark, sf_dir)
    p = w.table("part").select(F.lower("p_type").alias("t"), F.split("p_name", " ")[0].alias("word"), "p_partkey")
    rules = (p.select(F.concat(F.lit("%"), "t", F.lit("/"), "word", F.lit("%")).alias("pattern"),
                      F.concat("t", F.lit(" "), "word").alias("label"), "p_partkey")
             .unionByName(p.select(F.concat(F.lit("%_/"), "word", F.lit("/%")).alias("pattern"), F.col("word").alias("label"), "p_partkey"))
             .groupBy("pattern", "label").agg(F.min("p_partkey").alias("priority")))
    return response.clicks_by_feed(w.clicks, w.catalog, partner=P.feed_partner, partition=P.feed_partner % P.modulus,
                                   start=P.feed_start, end=P.feed_end, rules=rules_from(rules))


@plan("available_days")
def q_available_days(spark, sf_dir):
    return response.available_days(_w(spark, sf_dir).catalog_stats, partners=P.days_partners,
                                   start=P.days_start)


# -- items ------------------------------------------------------------------
@plan("item_display_click_stats")
def q_item_display_click_stats(spark, sf_dir):
    w = _w(spark, sf_dir)
    return items.item_display_click_stats(
        w.reco_displays, w.clicks, w.catalog, partners=P.item_partners,
        click_partitions=partitions_for(P.item_partners, P.modulus), start=P.item_start,
        end=P.item_end, platform=P.platform, modulus=P.modulus)


@plan("product_performance")
def q_product_performance(spark, sf_dir):
    w = _w(spark, sf_dir)
    return items.product_performance(
        w.catalog_stats, w.dim_catalog, w.clicks, w.matched_transactions,
        partner=P.product_partner, partition=P.product_partner % P.modulus,
        start=P.product_start, end=P.product_end, conversion_end=P.product_conv_end)


# -- identity ---------------------------------------------------------------
@plan("matched_cookies")
def q_matched_cookies(spark, sf_dir):
    return identity.matched_cookies(_w(spark, sf_dir).identity, day=P.identity_day,
                                    platform=P.platform)


@plan("performance_by_matched_cookies")
def q_performance_by_matched_cookies(spark, sf_dir):
    w = _w(spark, sf_dir)
    return identity.performance_by_matched_cookies(
        w.displays, w.clicks, w.matched_transactions, w.identity, partner=P.cookie_partner,
        partition=P.cookie_partner % P.modulus, start=P.click_start, end=P.click_end,
        trans_end=P.trans_end, identity_day=P.identity_day, platform=P.platform)


def _flags(w):
    return identity.identity_match_flags(w.identity, partner=P.overlap_partner, day=P.identity_day,
                                         platform=P.platform)


@plan("identity_match_flags")
def q_identity_match_flags(spark, sf_dir):
    return _flags(_w(spark, sf_dir))


@plan("audience_overlap")
def q_audience_overlap(spark, sf_dir):
    w = _w(spark, sf_dir)
    return identity.audience_overlap(w.displays, w.dim_client, _flags(w), partner=P.overlap_partner,
                                     end=P.identity_day, days=7, country=P.overlap_country,
                                     platform=P.platform)


# -- A/B test ---------------------------------------------------------------
def _ab_events(w):
    return abtest.ab_event_measures(w.site_events, partners=P.ab_partners, modulus=P.modulus,
                                    start=P.ab_users_start, end=P.ab_end, sentinel=P.sentinel)


def _ab_delivery(w):
    return abtest.ab_delivery_measures(w.clicks, w.displays, partners=P.ab_partners,
                                       modulus=P.modulus, start=P.ab_measures_start, end=P.ab_end,
                                       platform=P.platform, sentinel=P.sentinel)


def _order_values(w, rule: str, site_events=None, partners=None, start=None, end=None):
    fn = abtest.order_value_max if rule == "max" else abtest.order_value_latest
    return fn(site_events if site_events is not None else w.site_events,
              partners=partners or P.ab_partners, modulus=P.modulus,
              start=start or P.ab_measures_start, end=end or P.ab_end, sentinel=P.sentinel)


@plan("ab_population")
def q_ab_population(spark, sf_dir):
    users = _w(spark, sf_dir).site_events.select("user_id").distinct()
    return abtest.with_population(users, P.test_id)


@plan("ab_event_measures")
def q_ab_event_measures(spark, sf_dir):
    return abtest.with_population(_ab_events(_w(spark, sf_dir)), P.test_id)


@plan("ab_delivery_measures")
def q_ab_delivery_measures(spark, sf_dir):
    return abtest.with_population(_ab_delivery(_w(spark, sf_dir)), P.test_id)


@plan("ab_delivery_measures_small")
def q_ab_delivery_measures_small(spark, sf_dir):
    # display amounts far below a millionth
    w = _w(spark, sf_dir)
    tiny = w.displays.withColumn("sum_display_revenue_local", F.col("sum_display_revenue_local") * 1e-6)
    return abtest.ab_delivery_measures(w.clicks, tiny, partners=P.ab_partners, modulus=P.modulus,
                                       start=P.ab_measures_start, end=P.ab_end, platform=P.platform,
                                       sentinel=P.sentinel)


@plan("order_value_max")
def q_order_value_max(spark, sf_dir):
    return _order_values(_w(spark, sf_dir), "max")


@plan("order_value_latest")
def q_order_value_latest(spark, sf_dir):
    return _order_values(_w(spark, sf_dir), "latest")


@plan("ab_transaction_measures")
def q_ab_transaction_measures(spark, sf_dir):
    t = abtest.ab_transaction_measures(_order_values(_w(spark, sf_dir), "max"))
    return abtest.with_population(t, P.test_id)


def _ab_users(spark, sf_dir, rule):
    w = _w(spark, sf_dir)
    return abtest.ab_user_measures(_ab_events(w), _ab_delivery(w),
                                   abtest.ab_transaction_measures(_order_values(w, rule)),
                                   test_id=P.test_id)


@plan("ab_user_measures")
def q_ab_user_measures(spark, sf_dir):
    return _ab_users(spark, sf_dir, "max")


@plan("ab_user_measures_latest")
def q_ab_user_measures_latest(spark, sf_dir):
    return _ab_users(spark, sf_dir, "latest")


def _orders_values(spark, sf_dir, rule):
    w = _w(spark, sf_dir)
    return _order_values(w, rule, site_events=w.order_site_events, partners=P.orders_partners,
                         start=P.orders_start, end=P.orders_end)


@plan("order_value_max_orders")
def q_order_value_max_orders(spark, sf_dir):
    return _orders_values(spark, sf_dir, "max")


@plan("order_value_latest_orders")
def q_order_value_latest_orders(spark, sf_dir):
    return _orders_values(spark, sf_dir, "latest")


@plan("ab_transaction_measures_latest")
def q_ab_transaction_measures_latest(spark, sf_dir):
    t = abtest.ab_transaction_measures(_order_values(_w(spark, sf_dir), "latest"))
    return abtest.with_population(t, P.test_id)


@plan("ab_transaction_measures_orders")
def q_ab_transaction_measures_orders(spark, sf_dir):
    t = abtest.ab_transaction_measures(_orders_values(spark, sf_dir, "max"))
    return abtest.with_population(t, P.test_id)


# -- funnel -----------------------------------------------------------------
@plan("funnel_stage")
def q_funnel_stage(spark, sf_dir):
    w = _w(spark, sf_dir)
    return funnel.funnel_stage(w.test_users, w.site_events, partners=P.funnel_partners,
                               modulus=P.modulus, start=P.funnel_start, mid_days=P.funnel_mid_days,
                               sentinel=P.sentinel)


@plan("early_funnel")
def q_early_funnel(spark, sf_dir):
    w = _w(spark, sf_dir)
    return funnel.early_funnel(w.test_users, w.site_events, partners=P.funnel_partners, modulus=P.modulus,
                               start=P.funnel_start, mid_days=P.funnel_mid_days, sentinel=P.sentinel)


# -- path to purchase -------------------------------------------------------
def _buyers(w, with_dims=False):
    kw = {}
    if with_dims:
        kw = dict(dims=dict(P.p2p_dims), dim_filters=dict(P.p2p_dim_filters))
    return journey.buyers(w.site_events_rich, w.dim_merchant, w.dim_client, w.identity,
                          w.partner_status, partners=P.p2p_partners, calc_date=P.p2p_date,
                          platform=P.platform, **kw)


# The buyers are read by both branches of the identity expansion and the
# lookback, the switches' input by two branches: such inputs are stored once.
# A step that is only returned stays lazy.
def _buyers_full(w, with_dims=False):
    return journey.expand_identities(keep_table(_buyers(w, with_dims), "buyers"), w.identity, calc_date=P.p2p_date,
                                     platform=P.platform)


def _lookback(w, with_dims=False):
    return journey.lookback_events(keep_table(_buyers_full(w, with_dims), "buyers-full"), w.site_events_rich,
                                   calc_date=P.p2p_date)


def _switches(w, with_dims=False):
    return journey.cookie_switches(_lookback(w, with_dims), w.dim_merchant, w.dim_client,
                                   partners=P.p2p_partners, sentinel=P.sentinel)


@plan("buyers")
def q_buyers(spark, sf_dir):
    return _buyers(_w(spark, sf_dir))


@plan("buyers_by_dimension")
def q_buyers_by_dimension(spark, sf_dir):
    return _buyers(_w(spark, sf_dir), with_dims=True)


@plan("expand_identities")
def q_expand_identities(spark, sf_dir):
    return _buyers_full(_w(spark, sf_dir))


@plan("classify_device")
def q_classify_device(spark, sf_dir):
    ev = _w(spark, sf_dir).site_events_rich
    return journey.with_device_type(ev).select("partnerid", "uid", "timestamp", "eventtype",
                                               "device_type")


@plan("lookback_events")
def q_lookback_events(spark, sf_dir):
    return _lookback(_w(spark, sf_dir))


@plan("cookie_switches")
def q_cookie_switches(spark, sf_dir):
    return _switches(_w(spark, sf_dir))


@plan("cookie_switches_cut")
def q_cookie_switches_cut(spark, sf_dir):
    # hours of a buyer with more than a few rows are cut by size
    w = _w(spark, sf_dir)
    return journey.cookie_switches(_lookback(w), w.dim_merchant, w.dim_client, partners=P.p2p_partners,
                                   sentinel=P.sentinel, max_segment_rows=P.segment_rows)


@plan("device_sequence")
def q_device_sequence(spark, sf_dir):
    return journey.device_sequence(_switches(_w(spark, sf_dir)))


@plan("sequence_distribution")
def q_sequence_distribution(spark, sf_dir):
    return journey.sequence_distribution(journey.device_sequence(_switches(_w(spark, sf_dir))))


@plan("sequence_distribution_by_dimension")
def q_sequence_distribution_by_dimension(spark, sf_dir):
    dims = [name for name, _ in P.p2p_dims]
    seq = journey.device_sequence(_switches(_w(spark, sf_dir), with_dims=True))
    return journey.sequence_distribution(seq, dims=dims)


# -- states kept by day ---------------------------------------------------------
def _daily(spark, kind: str, build, start, end) -> DataFrame:
    """A new daily table, filled in two steps and with one day replaced, as two runs and late data would."""
    table = DailyTable(spark, result_path(spark, kind))
    table.extend(build, start, P.daily_first_step)
    table.extend(build, start, end, replace=[P.daily_late])
    return table.read(start=start, end=end)


def _reach_states(spark, sf_dir, states) -> DataFrame:
    w = _w(spark, sf_dir)
    return _daily(spark, "reach", lambda a, z: states(w.displays, start=a, end=z, sentinel=P.sentinel),
                  P.reach_first_day, P.reach_last_day)


@plan("display_reach_daily")
def q_display_reach_daily(spark, sf_dir):
    return reach.reach_from_states(
        _reach_states(spark, sf_dir, reach.daily_reach_states), start=P.reach_start, campaign_id=P.reach_campaign,
        client_id=P.reach_client, partner_partition=P.reach_partner % P.modulus)


@plan("reach_by_window")
def q_reach_by_window(spark, sf_dir):
    return reach.reach_by_window(_reach_states(spark, sf_dir, reach.daily_reach_states), P.reach_windows)


@plan("rolling_reach")
def q_rolling_reach(spark, sf_dir):
    return reach.rolling_reach(_reach_states(spark, sf_dir, reach.daily_reach_states), days=P.reach_rolling_days,
                               start=P.reach_first_day, end=P.reach_last_day)


@plan("estimated_reach_by_window")
def q_estimated_reach_by_window(spark, sf_dir):
    return reach.estimated_reach_by_window(_reach_states(spark, sf_dir, reach.daily_reach_sketches), P.reach_windows)


@plan("frequency_cells_daily")
def q_frequency_cells_daily(spark, sf_dir):
    w = _w(spark, sf_dir)
    return _daily(spark, "frequency", lambda a, z: exposure.frequency_cells(
        w.displays, merchants=P.freq_merchants, start=a, end=z, platform=P.platform, sentinel=P.sentinel),
        P.freq_start, P.freq_end)


@plan("hourly_recency_cells_daily")
def q_hourly_recency_cells_daily(spark, sf_dir):
    w = _w(spark, sf_dir)
    return _daily(spark, "hours", lambda a, z: exposure.hourly_recency_cells(
        w.displays, merchants=P.hour_merchants, start=a, end=z, platform=P.platform, sentinel=P.sentinel),
        P.hour_start, P.hour_end)


def _ab_users_daily(spark, sf_dir, rule):
    w = _w(spark, sf_dir)
    scope = dict(partners=P.ab_partners, modulus=P.modulus, sentinel=P.sentinel)
    events = _daily(spark, "ab-events", lambda a, z: daily.ab_event_states(w.site_events, start=a, end=z, **scope),
                    P.ab_users_start, P.ab_end)
    delivery = _daily(spark, "ab-delivery", lambda a, z: daily.ab_delivery_states(
        w.clicks, w.displays, start=a, end=z, platform=P.platform, **scope), P.ab_measures_start, P.ab_end)
    emissions = _daily(spark, "ab-emissions", lambda a, z: daily.ab_emission_states(w.site_events, start=a, end=z, **scope),
                       P.ab_measures_start, P.ab_end)
    return daily.ab_user_measures_from_states(events, delivery, emissions, test_id=P.test_id, rule=rule,
                                              users_start=P.ab_users_start, start=P.ab_measures_start, end=P.ab_end)


@plan("ab_user_measures_daily")
def q_ab_user_measures_daily(spark, sf_dir):
    return _ab_users_daily(spark, sf_dir, "max")


@plan("ab_user_measures_latest_daily")
def q_ab_user_measures_latest_daily(spark, sf_dir):
    return _ab_users_daily(spark, sf_dir, "latest")


# -- tables bucketed by user ------------------------------------------------------
BUCKETED = {"displays": ["partner_partition"], "clicks": ["partner_partition"], "matched_transactions": ["partner_partition"],
            "site_events": ["partner_partition"]}


def _bucketed(w: TestWarehouse) -> UserBuckets:
    """The facts bucketed by user, stored once beside the derived inputs."""
    store = UserBuckets(w.spark, f"{w.root}/by-user-{P.user_buckets}", P.user_buckets)
    if not all(store.stored(name) for name in [*BUCKETED, SPINE]):
        store.write({name: getattr(w, name) for name in BUCKETED}, BUCKETED, spine=["user_id", "partner_id"])
    return store


def _per_user(displays, clicks, sales):
    """Both users' halves of A6 at user grain."""
    cells = exposure.frequency_cells(displays, merchants=P.freq_merchants, start=P.freq_start, end=P.freq_end,
                                     platform=P.platform, sentinel=P.sentinel)
    return exposure.response_per_user(displays, clicks, sales, cells, partners=P.freq_merchants, modulus=P.modulus,
                                      start=P.freq_start, end=P.freq_end, sentinel=P.sentinel)


@plan("response_by_exposure_bucket_bucketed")
def q_response_by_exposure_bucket_bucketed(spark, sf_dir):
    store = _bucketed(_w(spark, sf_dir))
    sides = [_per_user(of("displays"), of("clicks"), of("matched_transactions")) for of in (store.even, store.heavy)]
    return exposure.by_exposure_bucket(sides[0].unionByName(sides[1]), edges=P.exposure_edges)


def _ab_users_of(store, even: bool):
    """A23 over one side's users: joined where they lie, or shuffled."""
    of = store.even if even else store.heavy
    site_events, clicks, displays = of("site_events"), of("clicks"), of("displays")
    scope = dict(partners=P.ab_partners, modulus=P.modulus, end=P.ab_end, sentinel=P.sentinel)
    delivery = dict(scope, start=P.ab_measures_start, platform=P.platform)
    seen = abtest.ab_event_measures(site_events, start=P.ab_users_start, **scope)
    sold = abtest.ab_transaction_measures(abtest.order_value_max(site_events, start=P.ab_measures_start, **scope))
    if even:
        return abtest.ab_user_measures_joined(of(SPINE), seen, *abtest.ab_delivery_sides(clicks, displays, **delivery), sold,
                                              test_id=P.test_id)
    return abtest.ab_user_measures(seen, abtest.ab_delivery_measures(clicks, displays, **delivery), sold, test_id=P.test_id)


@plan("ab_user_measures_bucketed")
def q_ab_user_measures_bucketed(spark, sf_dir):
    store = _bucketed(_w(spark, sf_dir))
    return _ab_users_of(store, True).unionByName(_ab_users_of(store, False))


# -- sinks: write the flagship result, read it back ---------------------------
def _sink(spark, kind: str) -> tuple[str, str]:
    path = result_path(spark, kind)
    return path.rsplit("/", 1)[1].replace("-", "_"), path


@plan("versioned_table")
def q_versioned_table(spark, sf_dir):
    """The flagship result behind a switched pointer, after an earlier version of it."""
    table = VersionedTable(spark, result_path(spark, "versioned"))
    result = keep_table(q_response_by_exposure_bucket(spark, sf_dir), "result")
    table.replace(result.limit(1))
    table.replace(result)
    return table.read()


@plan("replaced_table")
def q_replaced_table(spark, sf_dir):
    name, path = _sink(spark, "replaced")
    result = keep_table(q_response_by_exposure_bucket(spark, sf_dir), "result")  # computed once, written twice
    sinks.replace_table(result.limit(1), path, name=name)
    sinks.replace_table(result, path, name=name)
    return spark.table(name)


@plan("created_table")
def q_created_table(spark, sf_dir):
    name, path = _sink(spark, "created")
    sinks.create_table(q_response_by_exposure_bucket(spark, sf_dir), path, name=name)
    return spark.table(name)


@plan("exported_csv")
def q_exported_csv(spark, sf_dir):
    _, path = _sink(spark, "exported")
    result = q_response_by_exposure_bucket(spark, sf_dir)
    sinks.export_csv(result, path)
    return spark.read.option("header", True).schema(result.schema).csv(path)


# -- preview ----------------------------------------------------------------
@plan("matched_transactions_preview")
def q_matched_transactions_preview(spark, sf_dir):
    return preview.matched_transactions_preview(
        _w(spark, sf_dir).matched_transactions, day=P.preview_day, partner=P.preview_partner,
        rows=P.preview_rows)
