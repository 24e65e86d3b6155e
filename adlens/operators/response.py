"""Click-side responses: conversion by click recency, clicks by feed, data days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.predicates import day_between, not_anonymous
from adlens.functions.rules import first_match


def conversion_by_click_recency(clicks: DataFrame, transactions: DataFrame, *,
                                partners: Sequence[int], click_start: dt.date,
                                click_end: dt.date, trans_end: dt.date,
                                platform: str = "EU", sentinel=None) -> DataFrame:
    """Clicks and post-click sales per whole days since last visit.

    Clicks are deduplicated to (timestamp, user, recency); each is matched to
    deduplicated post-click sales of the same user and click second. The
    join is on user and timestamp only (not partner), so with several
    partners a sale may match another partner's click, as in the original.
    NULL recency stays a group.
    """
    t = (transactions.where(F.col("partner_id").isin(list(partners))
                            & (F.col("attribution_type") == "pc")
                            & (F.col("deduplication_matching") == 1)
                            & day_between("day", click_start, trans_end)
                            & not_anonymous("user_id", sentinel))
         .select(F.col("user_id").alias("t_user"), "transaction_id",
                 F.col("click_timestamp").alias("t_ts")))
    c = (clicks.where(F.col("merchant_id").isin(list(partners)) & (F.col("host_platform") == platform)
                      & day_between("day", click_start, click_end)
                      & not_anonymous("user_id", sentinel))
         .select("timestamp", "user_id",
                 F.col("days_last_visit").try_cast("int").alias("days_last_visit"))
         .distinct())
    a = (c.join(t, (c.user_id == t.t_user) & (c.timestamp == t.t_ts), "left")
         .groupBy("timestamp", "user_id", "days_last_visit")
         .agg(F.count_distinct("transaction_id").alias("nb_transactions")))
    return a.groupBy("days_last_visit").agg(F.count(F.lit(1)).alias("nb_clicks"),
                                            F.sum("nb_transactions").alias("nb_sales"))


def feed_label(url_col: str, rules: Sequence[tuple[str, str]], default: str = "other"):
    """First LIKE pattern that matches wins, in one pass whatever the number of rules."""
    return first_match(url_col, rules, default)


def clicks_by_feed(clicks: DataFrame, catalog: DataFrame, *, partner: int, partition: int,
                   start: dt.date, end: dt.date, rules: Sequence[tuple[str, str]],
                   default: str = "other") -> DataFrame:
    """Clicks per day and feed; unmatched catalog items drop (inner join).

    Clicks are counted per (day, item) before the join, so a hot item is one row a
    day there, and the catalog side carries its label instead of the url.
    """
    cl = clicks.where(day_between("day", start, end) & (F.col("partner_id") == partner)
                      & (F.col("partner_partition") == partition)).groupBy("day", "partner_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    ca = (catalog.where((F.col("partnerid") == partner) & (F.col("partner_partition") == partition))
          .select("partnerid", "sqlid", feed_label("producturl", rules, default).alias("type")))
    j = cl.join(ca, (cl.item_id == ca.sqlid) & (cl.partner_id == ca.partnerid))
    return j.groupBy("day", "type").agg(F.sum("n").alias("click"))


def available_days(catalog_stats: DataFrame, *, partners: Sequence[int],
                   start: dt.date) -> DataFrame:
    """A10: distinct days with item statistics for the partners since ``start``."""
    return (catalog_stats.where(F.col("partner_id").isin(list(partners)) & (F.col("day") >= F.lit(start)))
            .select("day").distinct())
