"""Physical-plan properties that matter at scale."""

import pytest

from adlens.operators import items, journey, response
from adlens.params import P
from adlens.plans.registry import REGISTRY, _buyers
from adlens.sources.fixtures import TestWarehouse
from adlens.sources.storage import keep_table
from conftest import SMOKE_DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _assert_plain(p: str, name: str) -> None:
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert bad not in p, f"{name}: {bad}"


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"created_table", "replaced_table", "exported_csv"}))
def test_no_python_udf_no_cartesian(spark, name):
    _assert_plain(_plan(REGISTRY[name](spark, SMOKE_DIR)), name)


def test_path_to_purchase_steps_are_plain(spark):
    w = TestWarehouse(spark, SMOKE_DIR)
    full = journey.expand_identities(_buyers(w), w.identity, calc_date=P.p2p_date)
    lookback = journey.lookback_events(full, w.site_events_rich, calc_date=P.p2p_date)
    for name, df in (("expand", full), ("lookback", lookback)):
        _assert_plain(_plan(df), name)


def test_scan_is_pruned_and_filtered(spark):
    df = REGISTRY["frequency_by_recency"](spark, SMOKE_DIR)
    p = _plan(df)
    assert "PartitionFilters: [isnotnull(day" in p
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(host_platform), In(event_type" in p
    # six of the stored table's sixteen columns; the plan's text is cut at 100 characters
    assert "ReadSchema: struct<event_type:string,partner_id:int,user_id:bigint,host_platform:string,days_last_visit:doubl" in p


def test_switches_do_not_sort_events_globally(spark):
    # the returned plan reads the stored journey (sorted once, in buyers' hours); what it still moves are
    # last rows of segments, heads and one row per range of buyers
    w = TestWarehouse(spark, SMOKE_DIR)
    full = keep_table(journey.expand_identities(_buyers(w), w.identity, calc_date=P.p2p_date), "t")
    lookback = journey.lookback_events(full, w.site_events_rich, calc_date=P.p2p_date)
    p = _plan(journey.cookie_switches(lookback, w.dim_merchant, w.dim_client, partners=P.p2p_partners, sentinel=0))
    assert p.count("Exchange SinglePartition") <= 1
    assert p.count("Exchange ") < 12


def test_sequence_limits_before_the_shuffle(spark):
    sw = keep_table(spark.createDataFrame([(1, 1, 1, "Desktop", 2, "view")], "timestamp long, partner_id int, "
                                          "super_uid long, device string, user_id long, event_type string"), "t")
    assert "WindowGroupLimit" in _plan(journey.device_sequence(sw))


def test_clicks_are_counted_before_the_catalog_join(spark):
    w = TestWarehouse(spark, SMOKE_DIR)
    p = _plan(response.clicks_by_feed(w.clicks, w.catalog, partner=1, partition=1, start=P.feed_start,
                                      end=P.feed_end, rules=P.feed_rules))
    join = next(i for i, line in enumerate(p.splitlines()) if "Join" in line)
    assert any("HashAggregate" in line for line in p.splitlines()[join:])


def test_catalog_scan_is_limited_to_buckets(spark):
    w = TestWarehouse(spark, SMOKE_DIR)
    p = _plan(items.item_display_click_stats(w.reco_displays, w.clicks, w.catalog, partners=[2], click_partitions=[2],
                                             start=P.item_start, end=P.item_end, modulus=P.modulus))
    scan = p[p.index("p_partkey"):]
    assert "% 3" in scan or "pmod" in scan
