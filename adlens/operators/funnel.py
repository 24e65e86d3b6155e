"""Funnel stage of test users from their last pre-test visit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.predicates import not_anonymous, partner_scope
from adlens.functions.time import epoch_to_day

# Funnel stage labels.
LOWER = "Lower"
MID = "Mid"


def last_visits(site_events: DataFrame, *, partners: Sequence[int], modulus: int | None,
                start: dt.date, mid_days: int, sentinel=None) -> DataFrame:
    """Last day seen (``max_day``) in the ``mid_days + 1`` days before ``start``."""
    return (site_events.where(partner_scope(partners, modulus) & F.col("persistent_user")
                              & (F.col("day") >= F.lit(start - dt.timedelta(days=mid_days + 1)))
                              & (F.col("day") < F.lit(start))
                              & not_anonymous("user_id", sentinel))
            .groupBy("user_id").agg(epoch_to_day(F.max("unixtime")).alias("max_day")))


def early_funnel(test_users: DataFrame, site_events: DataFrame, *, partners: Sequence[int],
                 modulus: int | None, start: dt.date, mid_days: int, sentinel=None) -> DataFrame:
    """A24, early branch with the visit it rests on: ``user_id, first_day_seen, max_day, funnel``."""
    cut = start + dt.timedelta(days=mid_days)
    early = test_users.select("user_id", "first_day_seen").where(F.col("first_day_seen") <= F.lit(cut)).distinct()
    seen = last_visits(site_events, partners=partners, modulus=modulus, start=start, mid_days=mid_days,
                       sentinel=sentinel)
    gap = F.datediff("first_day_seen", "max_day")
    return early.join(seen, "user_id", "left").select(
        "user_id", "first_day_seen", "max_day",
        F.when(gap < mid_days, F.lit(LOWER)).otherwise(F.lit(MID)).alias("funnel"))


def funnel_stage(test_users: DataFrame, site_events: DataFrame, *, partners: Sequence[int],
                 modulus: int | None, start: dt.date, mid_days: int,
                 sentinel=None) -> DataFrame:
    """``Lower`` when the last visit in the ``mid_days + 1`` days before
    ``start`` is less than ``mid_days`` days before the first day seen, else
    ``Mid``; users first seen after ``start + mid_days`` are ``Mid``. Users
    without a first day fall out of both branches.
    """
    cut = start + dt.timedelta(days=mid_days)
    early = early_funnel(test_users, site_events, partners=partners, modulus=modulus, start=start,
                         mid_days=mid_days, sentinel=sentinel).drop("max_day")
    late = test_users.where(F.col("first_day_seen") > F.lit(cut)).select("user_id", "first_day_seen").distinct()
    return early.unionByName(late.withColumn("funnel", F.lit(MID)))
