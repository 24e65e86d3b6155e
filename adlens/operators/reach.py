"""Reach over any range of days from daily states (A1 without a rescan, rolling reach).

``daily_reach_states`` reduces displays to one state per day, campaign, client and
bucket of users; the states are stored by day (``sources.daily``). Reach of a range,
of several ranges at once, or of every rolling week is then merged from the
states: a user seen on several days counts once, and no display is read again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.distinct import bitmap_states, count_bitmaps, count_sketches, sketch_states
from adlens.functions.predicates import day_between, not_anonymous
from adlens.sources.schemas import require_columns

DIMENSIONS = ["campaign_id", "client_id", "partner_partition"]
REACH_COLS = ("day", "user_id", *DIMENSIONS)


def daily_reach_states(displays: DataFrame, *, start: dt.date | None = None, end: dt.date | None = None,
                       sentinel=None) -> DataFrame:
    """Exact states (bitmaps of integer user ids) per day, campaign, client and partition."""
    require_columns(displays, REACH_COLS, "daily_reach_states")
    d = displays.where(day_between("day", start, end) & not_anonymous("user_id", sentinel))
    return bitmap_states(d, "user_id", ["day", *DIMENSIONS], "displays")


def daily_reach_sketches(displays: DataFrame, *, start: dt.date | None = None, end: dt.date | None = None,
                         sentinel=None) -> DataFrame:
    """HLL states per day, campaign, client and partition, for user ids of any type."""
    require_columns(displays, REACH_COLS, "daily_reach_sketches")
    d = displays.where(day_between("day", start, end) & not_anonymous("user_id", sentinel))
    return sketch_states(d, F.col("user_id").cast("string"), ["day", *DIMENSIONS], "displays")


def reach_from_states(states: DataFrame, *, start: dt.date, end: dt.date | None = None, campaign_id: int,
                      client_id: int, partner_partition: int) -> DataFrame:
    """A1 from stored states: the same row as ``display_reach`` over the displays."""
    s = states.where(day_between("day", start, end) & (F.col("campaign_id") == campaign_id)
                     & (F.col("client_id") == client_id) & (F.col("partner_partition") == partner_partition))
    return count_bitmaps(s, [], "unique_users", "displays")


def _in_windows(states: DataFrame, windows: Sequence[tuple[dt.date, dt.date]]) -> DataFrame:
    """Each state once per window its day lies in (windows may overlap)."""
    spans = F.array(*[F.struct(F.lit(a).alias("window_start"), F.lit(z).alias("window_end")) for a, z in windows])
    first, last = min(a for a, _ in windows), max(z for _, z in windows)
    held = F.filter(spans, lambda w: F.col("day").between(w["window_start"], w["window_end"]))
    return states.where(day_between("day", first, last)).select("*", F.inline(held))


def reach_by_window(states: DataFrame, windows: Sequence[tuple[dt.date, dt.date]]) -> DataFrame:
    """Distinct users and displays per window (inclusive days), campaign and client."""
    return count_bitmaps(_in_windows(states, windows), ["window_start", "window_end", "campaign_id", "client_id"],
                         "unique_users", "displays")


def estimated_reach_by_window(sketches: DataFrame, windows: Sequence[tuple[dt.date, dt.date]]) -> DataFrame:
    """``reach_by_window`` from HLL states; users are estimated, displays exact."""
    return count_sketches(_in_windows(sketches, windows), ["window_start", "window_end", "campaign_id", "client_id"],
                          "unique_users", "displays")


def rolling_reach(states: DataFrame, *, days: int = 7, start: dt.date, end: dt.date) -> DataFrame:
    """Distinct users and displays per campaign and client over the ``days`` days up to each day
    of the range that has displays in them; the states of a day serve ``days`` windows."""
    s = (states.where(day_between("day", start - dt.timedelta(days=days - 1), end))
         .withColumn("until", F.explode(F.expr(f"sequence(day, date_add(day, {days - 1}))")))
         .where(day_between("until", start, end)))
    return count_bitmaps(s, ["until", "campaign_id", "client_id"], "unique_users", "displays")
