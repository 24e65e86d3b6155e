"""Daily states of the analyses whose own output is kept and extended day by day.

A2 and A4 have the day in their keys: a new day only adds cells, so their rows are their
states. A23 has not: what is kept per day are the parts that its measures are made of
(first event and events, clicks and displays with exact amounts, emissions of
transactions), and ``ab_user_measures_from_states`` puts any range of days together
as ``ab_user_measures`` computes it from the facts.

A day's states hold the rows of all partners in scope, so their keys are users,
partners and (for emissions) transactions; all are far fewer than the facts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.money import money_merge, money_state
from adlens.functions.predicates import day_between, not_anonymous, partner_scope
from adlens.functions.time import epoch_to_day
from adlens.operators import abtest
from adlens.operators.abtest import KEYS, sales_events, spend_of

EVENT, DELIVERY, EMISSION = "event", "delivery", "emission"


def ab_event_states(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None, start: dt.date,
                    end: dt.date, sentinel=None) -> DataFrame:
    """Per (day, user, partner): time of the first event and number of events."""
    e = site_events.where(partner_scope(partners, modulus) & F.col("persistent_user")
                          & day_between("day", start, end) & not_anonymous("user_id", sentinel))
    return e.groupBy("day", *KEYS).agg(F.min("unixtime").alias("first_time"), F.count(F.lit(1)).alias("events"))


def ab_delivery_states(clicks: DataFrame, displays: DataFrame, *, partners: Sequence[int], modulus: int | None,
                       start: dt.date, end: dt.date, platform: str = "EU", sentinel=None) -> DataFrame:
    """Per (day, user, partner): clicks, displays and exact sums of both revenues."""
    both = abtest.delivery_rows(clicks, displays, partners=partners, modulus=modulus, start=start, end=end,
                                platform=platform, sentinel=sentinel)
    return both.groupBy("day", *KEYS).agg(
        F.sum("clicks").cast("bigint").alias("clicks"), F.sum("displays").cast("bigint").alias("displays"),
        *money_state("click_revenue", "cr"), *money_state("display_revenue", "dr"))


def ab_emission_states(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None, start: dt.date,
                       end: dt.date, sentinel=None) -> DataFrame:
    """Per (day, user, partner, transaction, time): the emission's exact value and whether it had products."""
    x = sales_events(site_events, partners, modulus, start, end, sentinel).select(
        "day", *KEYS, "transaction_id", "unixtime", F.posexplode_outer("products").alias("pos", "b"))
    return x.groupBy("day", *KEYS, "transaction_id", "unixtime").agg(
        *money_state(F.col("b.price") * F.col("b.quantity"), "value"), (F.count("pos") > 0).alias("has_products"))


def order_values_from_states(emissions: DataFrame, rule: str, *, start: dt.date, end: dt.date) -> DataFrame:
    """A20 (``rule`` max) or A21 (latest) from ``ab_emission_states``."""
    e = emissions.where(day_between("day", start, end))
    if rule == "latest":
        e = e.where(F.col("transaction_id").isNotNull())
    whole = e.groupBy(*KEYS, "transaction_id", "unixtime").agg(
        money_merge("value").alias("order_value"), F.max("has_products").alias("has_products"))
    return abtest.transaction_values(whole, rule)


def ab_user_measures_from_states(events: DataFrame, delivery: DataFrame, emissions: DataFrame, *, test_id: int,
                                 rule: str, users_start: dt.date, start: dt.date, end: dt.date,
                                 n_populations: int = 2) -> DataFrame:
    """A23 over any range of covered days."""
    seen = (events.where(day_between("day", users_start, end)).groupBy(*KEYS)
            .agg(epoch_to_day(F.min("first_time")).alias("first_day_seen"), F.sum("events").alias("events")))
    delivered = (delivery.where(day_between("day", start, end)).groupBy(*KEYS)
                 .agg(F.sum("clicks").alias("clicks"), F.sum("displays").alias("displays"),
                      money_merge("cr").alias("cr"), money_merge("dr").alias("dr")))
    delivered = delivered.select(*KEYS, "clicks", spend_of("cr", "dr").alias("spend"), "displays")
    values = order_values_from_states(emissions, rule, start=start, end=end)
    return abtest.ab_user_measures(seen, delivered, abtest.ab_transaction_measures(values), test_id=test_id,
                                   n_populations=n_populations)
