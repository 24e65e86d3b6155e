"""Frozen query parameters used against the bundled test data.

The original scripts bind partners, dates and thresholds textually; here
they are typed values passed to the operators. These particular values are
chosen so every analysis has non-trivial output on the 2024-01 test events
(FIXTURES.md §2.3).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

D = dt.date


@dataclass(frozen=True)
class TestParams:
    sentinel: int = 0
    modulus: int = 3
    platform: str = "EU"
    # reach
    reach_start: dt.date = D(2024, 1, 10)
    reach_campaign: int = 1
    reach_client: int = 102
    reach_partner: int = 2
    reach_windows: tuple[tuple[dt.date, dt.date], ...] = (
        (D(2024, 1, 1), D(2024, 1, 7)), (D(2024, 1, 5), D(2024, 1, 18)), (D(2024, 1, 1), D(2024, 1, 31)))
    reach_rolling_days: int = 7
    reach_first_day: dt.date = D(2024, 1, 1)
    reach_last_day: dt.date = D(2024, 1, 31)
    # tables bucketed by user
    user_buckets: int = 8
    # own output kept by day: covered first up to a day, then to the end, with one day again
    daily_first_step: dt.date = D(2024, 1, 15)
    daily_late: dt.date = D(2024, 1, 12)
    # frequency / exposure (user grain)
    freq_merchants: tuple[int, ...] = (1, 2)
    freq_start: dt.date = D(2024, 1, 1)
    freq_end: dt.date = D(2024, 1, 30)
    exposure_edges: tuple[float, ...] = (1.25, 1.5, 1.75, 2.0, 2.25)
    wide_edges: tuple[float, ...] = (2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24)
    # hourly recency / exposure (partner grain)
    hour_merchants: tuple[int, ...] = (1, 2, 3, 4, 5)
    hour_start: dt.date = D(2024, 1, 5)
    hour_end: dt.date = D(2024, 1, 25)
    hour_edges: tuple[float, ...] = (1.0, 1.05, 1.1, 1.25)
    # click recency
    recency_partners: tuple[int, ...] = (2,)
    recency_partners_multi: tuple[int, ...] = (1, 2)
    click_start: dt.date = D(2024, 1, 1)
    click_end: dt.date = D(2024, 1, 20)
    trans_end: dt.date = D(2024, 1, 30)
    # feeds / catalog
    feed_partner: int = 1
    feed_start: dt.date = D(2024, 1, 1)
    feed_end: dt.date = D(2024, 1, 30)
    feed_rules: tuple[tuple[str, str], ...] = (("%economy%ring%", "a"), ("%promo%", "b"))
    days_partners: tuple[int, ...] = (1,)
    days_start: dt.date = D(2024, 1, 15)
    item_partners: tuple[int, ...] = (2,)
    item_start: dt.date = D(2024, 1, 1)
    item_end: dt.date = D(2024, 1, 15)
    product_partner: int = 3
    product_start: dt.date = D(2024, 1, 1)
    product_end: dt.date = D(2024, 1, 20)
    product_conv_end: dt.date = D(2024, 1, 30)
    # identity
    identity_day: dt.date = D(2024, 1, 30)
    cookie_partner: int = 2
    overlap_partner: int = 1
    overlap_country: str = "DK"
    # A/B test
    test_id: int = 42
    ab_partners: tuple[int, ...] = (1, 2)
    ab_users_start: dt.date = D(2024, 1, 5)
    ab_measures_start: dt.date = D(2024, 1, 10)
    ab_end: dt.date = D(2024, 1, 28)
    # funnel
    funnel_partners: tuple[int, ...] = (1, 2, 3, 4, 5)
    funnel_start: dt.date = D(2024, 1, 11)
    funnel_mid_days: int = 2
    # path to purchase
    p2p_partners: tuple[int, ...] = (1, 2, 3, 4, 5)
    p2p_date: dt.date = D(2024, 1, 30)
    p2p_dims: tuple[tuple[str, str], ...] = (("country", "client_country_name"),
                                             ("vertical", "vertical_level_1_name"),
                                             ("subvertical", "vertical_level_2_name"),
                                             ("tier", "ranking"))
    p2p_dim_filters: tuple[tuple[str, tuple[str, ...]], ...] = (("vertical_level_2_name", ("RETAIL",)),)
    segment_rows: int = 3
    # preview
    preview_day: dt.date = D(2024, 1, 10)
    preview_partner: int = 3
    preview_rows: int = 1000
    # large order variant (orders + lineitem)
    orders_partners: tuple[int, ...] = (1, 2, 3, 4, 5)
    orders_start: dt.date = D(1992, 1, 1)
    orders_end: dt.date = D(1998, 12, 31)
    extra: dict = field(default_factory=dict, compare=False)


P = TestParams()
