"""Reusable filter predicates. Apply them before any shuffle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_anonymous(col: str | Column = "user_id", sentinel=None) -> Column:
    """``user_id <> sentinel``; like SQL ``<>`` it also drops NULL users."""
    if sentinel is None:
        return _c(col).isNotNull()
    return _c(col) != F.lit(sentinel)


def day_between(col: str | Column, start: dt.date | None, end: dt.date | None) -> Column:
    """Inclusive day range; either bound may be open."""
    c = _c(col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start))
    if end is not None:
        cond = cond & (c <= F.lit(end))
    return cond


def partitions_for(partners: Iterable[int], modulus: int) -> list[int]:
    """Storage buckets holding the given partners (``pmod(partner, modulus)``)."""
    return sorted({p % modulus for p in partners})


def partner_scope(partners: Iterable[int], modulus: int | None,
                  partner_col: str = "partner_id",
                  partition_col: str = "partner_partition",
                  partitions: Iterable[int] | None = None) -> Column:
    """Partner filter plus the implied bucket filter.

    The bucket predicate is what lets a day/bucket partitioned table prune
    directories; Catalyst cannot derive it from the partner list itself.
    """
    partners = list(partners)
    cond = F.col(partner_col).isin(partners)
    if partitions is None and modulus is not None:
        partitions = partitions_for(partners, modulus)
    if partitions is not None:
        cond = cond & F.col(partition_col).isin(list(partitions))
    return cond
