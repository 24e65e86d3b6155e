"""A/B (incrementality) test measures per user."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.money import money_sum
from adlens.functions.population import ab_population
from adlens.functions.predicates import day_between, not_anonymous, partner_scope
from adlens.functions.time import epoch_to_day
from adlens.sources.schemas import require_columns

# The sales event name and the display revenue unit (per mille).
SALES = "Sales"
DISPLAY_REVENUE_DIVISOR = 1000

KEYS = ["user_id", "partner_id"]
MEASURES = ["first_day_seen", "events", "clicks", "spend", "transactions", "order_value", "displays"]


def with_population(df: DataFrame, test_id: int, n_populations: int = 2) -> DataFrame:
    """Add ``population`` (deterministic in user and test)."""
    return df.withColumn("population", ab_population("user_id", test_id, n_populations))


def ab_event_measures(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None,
                      start: dt.date, end: dt.date, sentinel=None) -> DataFrame:
    """First day seen and event count per (user, partner), persistent users."""
    e = site_events.where(partner_scope(partners, modulus) & F.col("persistent_user")
                          & day_between("day", start, end) & not_anonymous("user_id", sentinel))
    return e.groupBy(*KEYS).agg(epoch_to_day(F.min("unixtime")).alias("first_day_seen"),
                                F.count(F.lit(1)).alias("events"))


def delivery_rows(clicks: DataFrame, displays: DataFrame, *, partners: Sequence[int], modulus: int | None,
                  start: dt.date, end: dt.date, platform: str = "EU", sentinel=None) -> DataFrame:
    """The clicks and displays in scope as one table of rows with both kinds' amounts."""
    none = F.lit(None).cast("double")
    c = (clicks.where(partner_scope(partners, modulus) & day_between("day", start, end)
                      & not_anonymous("user_id", sentinel))
         .select("day", *KEYS, F.lit(1).alias("clicks"), F.col("revenue_local").alias("click_revenue"),
                 none.alias("display_revenue"), F.lit(0).alias("displays")))
    d = (displays.where((F.col("host_platform") == platform)
                        & F.col("merchant_id").isin(list(partners))
                        & day_between("day", start, end) & not_anonymous("user_id", sentinel))
         .select("day", "user_id", F.col("merchant_id").alias("partner_id"), F.lit(0).alias("clicks"),
                 none.alias("click_revenue"), F.col("sum_display_revenue_local").alias("display_revenue"),
                 F.lit(1).alias("displays")))
    return c.unionByName(d)


def spend_of(click_revenue: str, display_revenue: str) -> Column:
    """Click revenue + display revenue / 1000, of summed amounts; null only if there is neither."""
    cr, per_mille = F.col(click_revenue), F.col(display_revenue) / DISPLAY_REVENUE_DIVISOR
    return F.when(cr.isNull(), per_mille).otherwise(cr + F.coalesce(per_mille, F.lit(0.0)))


def ab_delivery_measures(clicks: DataFrame, displays: DataFrame, *, partners: Sequence[int],
                         modulus: int | None, start: dt.date, end: dt.date,
                         platform: str = "EU", sentinel=None) -> DataFrame:
    """Clicks, displays and spend (click revenue + display revenue / 1000).

    Display revenue is summed first and divided once, so no row is rounded.
    """
    rows = delivery_rows(clicks, displays, partners=partners, modulus=modulus, start=start, end=end,
                         platform=platform, sentinel=sentinel)
    both = rows.groupBy(*KEYS).agg(
        F.sum("clicks").cast("bigint").alias("clicks"), F.sum("displays").cast("bigint").alias("displays"),
        money_sum("click_revenue").alias("cr"), money_sum("display_revenue").alias("dr"))
    return both.select(*KEYS, "clicks", spend_of("cr", "dr").alias("spend"), "displays")


def ab_delivery_sides(clicks: DataFrame, displays: DataFrame, *, partners: Sequence[int], modulus: int | None,
                      start: dt.date, end: dt.date, platform: str = "EU", sentinel=None) -> tuple[DataFrame, DataFrame]:
    """A19's two sides, each aggregated where it lies: ``clicks, cr`` and ``displays, dr`` per user and partner."""
    c = (clicks.where(partner_scope(partners, modulus) & day_between("day", start, end) & not_anonymous("user_id", sentinel))
         .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("clicks"), money_sum("revenue_local").alias("cr")))
    # the displays' merchant is their partner, which also names their storage folder
    d = (displays.where((F.col("host_platform") == platform) & partner_scope(partners, modulus, partner_col="merchant_id")
                        & day_between("day", start, end) & not_anonymous("user_id", sentinel))
         .groupBy("user_id", F.col("merchant_id").alias("partner_id"))
         .agg(F.count(F.lit(1)).alias("displays"), money_sum("sum_display_revenue_local").alias("dr")))
    return c, d


SITE_EVENT_COLS = ("partner_id", "partner_partition", "day", "user_id", "unixtime", "event_name",
                   "persistent_user", "transaction_id", "products")


def sales_events(site_events: DataFrame, partners, modulus, start, end, sentinel) -> DataFrame:
    """The sales events of persistent users in scope."""
    require_columns(site_events, SITE_EVENT_COLS, "order value")
    return site_events.where(partner_scope(partners, modulus) & day_between("day", start, end)
                             & not_anonymous("user_id", sentinel) & F.col("persistent_user")
                             & (F.col("event_name") == SALES))


def order_value_max(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None,
                    start: dt.date, end: dt.date, sentinel=None) -> DataFrame:
    """Value of a transaction = max over its emissions of sum(price * quantity).

    Emissions without products vanish (inner explode).
    """
    x = (sales_events(site_events, partners, modulus, start, end, sentinel)
         .select(*KEYS, "transaction_id", "unixtime", F.explode("products").alias("b")))
    per_emission = x.groupBy(*KEYS, "transaction_id", "unixtime").agg(
        money_sum(F.col("b.price") * F.col("b.quantity")).alias("order_value"))
    return per_emission.groupBy(*KEYS, "transaction_id").agg(F.max("order_value").alias("order_value"))


def transaction_values(emissions: DataFrame, rule: str) -> DataFrame:
    """The value of each transaction from its emissions (``unixtime, order_value, has_products``): the
    largest of those with products (``max``), or the latest one's if that has products (``latest``)."""
    if rule == "max":
        return (emissions.where("has_products").groupBy(*KEYS, "transaction_id")
                .agg(F.max("order_value").alias("order_value")))
    latest = emissions.groupBy(*KEYS, "transaction_id").agg(
        F.max_by(F.struct("has_products", "order_value"), "unixtime").alias("l"))
    return latest.where(F.col("l.has_products")).select(
        *KEYS, "transaction_id", F.col("l.order_value").alias("order_value"))


def order_value_latest(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None,
                       start: dt.date, end: dt.date, sentinel=None) -> DataFrame:
    """Value of a transaction = value of its *latest* emission.

    The latest time is taken over all emissions; if the latest one carried
    no products the transaction disappears. A product list counts as soon as it has an
    element, null or not. Emissions without a transaction id have no latest emission
    to be compared with and drop. One pass: per-emission sums with an outer
    explode, then ``max_by`` on time.
    """
    x = (sales_events(site_events, partners, modulus, start, end, sentinel)
         .where(F.col("transaction_id").isNotNull())
         .select(*KEYS, "transaction_id", "unixtime", F.posexplode_outer("products").alias("pos", "b")))
    per_emission = x.groupBy(*KEYS, "transaction_id", "unixtime").agg(
        money_sum(F.col("b.price") * F.col("b.quantity")).alias("order_value"),
        (F.count("pos") > 0).alias("has_products"))
    return transaction_values(per_emission, "latest")


def ab_transaction_measures(order_values: DataFrame) -> DataFrame:
    """Distinct transactions and order value per (user, partner).

    Input rows are unique per (user, partner, transaction), so COUNT of the
    id equals COUNT(DISTINCT id) without a distinct aggregation.
    """
    return order_values.groupBy(*KEYS).agg(F.count("transaction_id").alias("transactions"),
                                           money_sum("order_value").alias("order_value"))


def ab_user_measures(event_measures: DataFrame, delivery_measures: DataFrame,
                     transaction_measures: DataFrame, *, test_id: int,
                     n_populations: int = 2) -> DataFrame:
    """One row per (user, partner, population) with the seven measures.

    The three branches are zero-filled and consolidated by one union and one
    aggregate (a single shuffle), the population computed once per row.
    """
    zero_i, zero_m, no_day = F.lit(0).cast("bigint"), F.lit(0.0), F.lit(None).cast("date")
    zeros = {"first_day_seen": no_day, "events": zero_i, "clicks": zero_i, "spend": zero_m,
             "transactions": zero_i, "order_value": zero_m, "displays": zero_i}

    def branch(df: DataFrame) -> DataFrame:
        return df.select(*KEYS, *(F.col(m) if m in df.columns else zeros[m].alias(m) for m in MEASURES))

    u = (branch(event_measures).unionByName(branch(delivery_measures))
         .unionByName(branch(transaction_measures)).groupBy(*KEYS).agg(
             F.min("first_day_seen").alias("first_day_seen"),
             *((money_sum(m) if m in ("spend", "order_value") else F.sum(m)).alias(m) for m in MEASURES[1:])))
    u = with_population(u, test_id, n_populations)
    return u.select(*KEYS, "population", *MEASURES)


def ab_user_measures_joined(spine: DataFrame, event_measures: DataFrame, click_side: DataFrame, display_side: DataFrame,
                            transaction_measures: DataFrame, *, test_id: int, n_populations: int = 2) -> DataFrame:
    """A23 for tables that are dealt by user already (``sources.buckets``): left joins from ``spine``, which holds
    every user and partner once and is dealt likewise. Nothing is shuffled: the join's key is the user, by whom
    the tables are dealt, and the partner is compared inside it, by two inequalities that Spark does not
    take for a key; a union or a full join would have to be dealt again. The same rows as ``ab_user_measures``:
    an amount is null only if its branch alone has the user, with a null amount."""
    sides = {"e": event_measures, "c": click_side, "d": display_side, "t": transaction_measures}
    j = spine.select(*KEYS)
    for mark, side in sides.items():
        right = side.withColumnsRenamed({"user_id": "__user", "partner_id": "__partner"}).withColumn(mark, F.lit(True))
        same = (F.col("partner_id") <= F.col("__partner")) & (F.col("partner_id") >= F.col("__partner"))
        j = j.join(right, (F.col("user_id") == F.col("__user")) & same, "left").drop("__user", "__partner")
    e, c, d, t = (F.col(m).isNotNull() for m in sides)
    zero = F.lit(0).cast("bigint")
    spend, value = spend_of("cr", "dr"), F.col("order_value")
    u = j.where(e | c | d | t).select(
        *KEYS, "first_day_seen", *(F.coalesce(F.col(n), zero).alias(n) for n in ("events", "clicks", "transactions", "displays")),
        F.when(e | t, F.coalesce(spend, F.lit(0.0))).otherwise(spend).alias("spend"),
        F.when(~t | e | c | d, F.coalesce(value, F.lit(0.0))).otherwise(value).alias("order_value"))
    return with_population(u, test_id, n_populations).select(*KEYS, "population", *MEASURES)
