"""Raw previews (full-row scan of a filtered slice with a row limit)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched_transactions_preview(transactions: DataFrame, *, day: dt.date, partner: int,
                                 rows: int = 1000) -> DataFrame:
    """Every column of one partner's matched transactions on one day, at most
    ``rows`` of them (an unordered preview: the limit is the feature)."""
    return transactions.where((F.col("day") == F.lit(day)) & (F.col("partner_id") == partner)).limit(rows)
