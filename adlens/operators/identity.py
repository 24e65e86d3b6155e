"""Identity-graph analyses: matched cookies, match flags, audience overlap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.bands import matched_band
from adlens.functions.distinct import distinct_count
from adlens.functions.money import money_sum
from adlens.functions.predicates import day_between

# Provider types.
PLATFORM_PROVIDER_TYPES = ("DATA_PROVIDER", "APP_CK")
PARTNER_PROVIDER_TYPE = "PARTNER_ID"


def matched_cookies(identity: DataFrame, *, day: dt.date, platform: str = "EU", approx: bool = False) -> DataFrame:
    """Distinct linked uids (``approx``: their HLL estimate) per (uid, users) row of the graph snapshot."""
    return (identity.where((F.col("host_platform") == platform) & (F.col("day") == F.lit(day)))
            .select("uid", "users", F.explode("events").alias("e"))
            .groupBy("uid", "users")
            .agg(distinct_count("e.uid", approx).alias("matched_cookies")))


def performance_by_matched_cookies(displays: DataFrame, clicks: DataFrame, transactions: DataFrame,
                                   identity: DataFrame, *, partner: int, partition: int,
                                   start: dt.date, end: dt.date, trans_end: dt.date,
                                   identity_day: dt.date, platform: str = "EU",
                                   approx: bool = False) -> DataFrame:
    """Users banded by matched cookies (1, 2, 3+; unmatched -> 1) with
    cookies, displays, clicks, spend, transactions and order value.

    Joins fan out exactly as the original: a display repeats per clicked
    item of its impression and per ``users`` value of its identity rows.
    """
    scope = (day_between("day", start, end) & (F.col("partner_id") == partner)
             & (F.col("partner_partition") == partition))
    disp = displays.where(scope).select("impression_id", "user_id").distinct() \
        .withColumn("num_disp", F.lit(1))
    clk = (clicks.where(scope)
           .groupBy("impression_id", F.coalesce("item_id", F.lit(0)).alias("item_id"))
           .agg(F.count(F.lit(1)).alias("clicks"), money_sum("revenue_local").alias("spend")))
    mt = (transactions.where((F.col("partner_id") == partner) & day_between("day", start, trans_end)
                             & (F.col("attribution_type") == "pc"))
          .groupBy(F.col("impression_id").alias("mt_impression_id"),
                   F.coalesce("clicked_item_id", F.lit(0)).alias("mt_item_id"))
          .agg(distinct_count("transaction_id", approx).alias("transactions"),
               money_sum("order_value").alias("order_value")))
    ids = matched_cookies(identity, day=identity_day, platform=platform).drop("users")
    j = (disp.join(clk, "impression_id", "left")
         .join(mt, (F.col("mt_item_id") == F.col("item_id"))
               & (F.col("mt_impression_id") == F.col("impression_id")), "left"))
    # collapse to one row per user before the identity join, so a hot user
    # reaches that join as one row instead of all its displays
    per_user = j.groupBy("user_id").agg(
        F.sum("num_disp").alias("displays"), F.sum("clicks").alias("clicks"),
        money_sum("spend").alias("spend"), F.sum("transactions").alias("transactions"),
        money_sum("order_value").alias("order_value"))
    banded = per_user.join(ids, F.col("user_id") == F.col("uid"), "left")
    return banded.groupBy(matched_band("matched_cookies").alias("matched_cookies")).agg(
        distinct_count("user_id", approx).alias("total_cookies"),
        F.sum("displays").cast("bigint").alias("displays"),
        F.sum("clicks").alias("clicks"),
        money_sum("spend").alias("spend"),
        F.sum("transactions").alias("transactions"),
        money_sum("order_value").alias("order_value"))


def identity_match_flags(identity: DataFrame, *, partner: int, day: dt.date,
                         platform: str = "EU") -> DataFrame:
    """Per linked uid, three 0/1 flags: platform provider, this partner's
    id, any other provider. A NULL id list counts as ``[0]``; an empty list
    contributes nothing (inner explode)."""
    # The nested lists are folded where they are, in three flags a link: one explode
    # instead of three, and one row a link into the aggregate.
    def any_of(xs, test):
        return F.coalesce(F.exists(xs, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))

    def ids(p):
        return F.coalesce(p["providerids"], F.array(F.lit(0)))

    def any_id(p, test=lambda i: F.lit(True)):
        return any_of(ids(p), test)

    def foreign(p):
        t = p["providertype"]
        return ((t != PLATFORM_PROVIDER_TYPES[0]) & (t != PLATFORM_PROVIDER_TYPES[1])
                & F.when(t != PARTNER_PROVIDER_TYPE, any_id(p)).otherwise(any_id(p, lambda i: i != partner)))

    links = (identity.where((F.col("day") == F.lit(day)) & (F.col("host_platform") == platform))
             .select(F.explode("events").alias("e"))
             .select(F.col("e.uid").alias("uid"), F.col("e.providers").alias("providers")))
    flagged = links.where(any_of(F.col("providers"), any_id)).select(
        "uid",
        any_of(F.col("providers"), lambda p: p["providertype"].isin(*PLATFORM_PROVIDER_TYPES) & any_id(p)).alias("platform"),
        any_of(F.col("providers"), lambda p: (p["providertype"] == PARTNER_PROVIDER_TYPE)
               & any_id(p, lambda i: i == partner)).alias("client"),
        any_of(F.col("providers"), foreign).alias("other"))
    # MAX is idempotent: partial aggregation collapses a uid's links map-side
    return flagged.groupBy("uid").agg(F.max(F.col("platform").cast("int")).alias("platform_match"),
                                      F.max(F.col("client").cast("int")).alias("client_match"),
                                      F.max(F.col("other").cast("int")).alias("other_client_match"))


def audience_overlap(displays: DataFrame, dim_client: DataFrame, flags: DataFrame, *,
                     partner: int, end: dt.date, days: int = 7, country: str,
                     platform: str = "EU") -> DataFrame:
    """Revenue and distinct users by (current client?, vertical, match flags)
    over the trailing ``days`` days in one country. Users absent from the
    graph form NULL-flag groups."""
    d = displays.where(day_between("day", end - dt.timedelta(days=days - 1), end)
                       & (F.col("host_platform") == platform))
    c = dim_client.where(F.col("client_country_code") == country) \
        .select("client_id", "vertical_level_2_name")
    # Pre-aggregate the 7 days of displays to one row per (user, current
    # client?, vertical) before joining the per-user flags: the join sees one
    # row per user and group instead of every display (hot users included).
    per_user = (d.join(c, "client_id")
                .groupBy("user_id",
                         F.when(F.col("merchant_id") == partner, F.lit(1)).otherwise(F.lit(0))
                         .alias("current_client"),
                         "vertical_level_2_name")
                .agg(money_sum("marketplace_revenue_raw_euro").alias("revenue")))
    j = per_user.join(flags, F.col("user_id") == F.col("uid"), "left")
    # flags are per user, so a user occurs at most once per output group and
    # COUNT(DISTINCT user_id) is a plain count of the pre-aggregated rows
    return j.groupBy("current_client", "vertical_level_2_name", "platform_match", "client_match",
                     "other_client_match").agg(
        money_sum("revenue").alias("revenue"),
        F.count("user_id").alias("num_users"))
