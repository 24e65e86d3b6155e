"""Money sums that do not depend on the order of the rows.

Finite amounts below ``EXACT_BELOW`` are summed as DECIMAL(38,18): the shortest
decimal form of a double has at most 17 digits, so nothing of an amount down to
a tenth is rounded, and smaller ones only beyond the 18th place. Everything else
(NaN, infinite or huge amounts) is summed as DOUBLE beside it, so such rows
show in the total as they do in a plain double sum and fail no job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_TYPE = "decimal(38,18)"
EXACT_BELOW = 1e9  # a sum of 1e11 rows still fits the type


def _split(col: Column | str) -> tuple[Column, Column]:
    """The amount as DECIMAL if it is exact there, and as DOUBLE if not; null otherwise."""
    amount = (F.col(col) if isinstance(col, str) else col).cast("double")
    small = F.abs(amount) < EXACT_BELOW
    return F.when(small, amount.cast(EXACT_TYPE)), F.when(~small, amount)


def _total(exact: Column, rest: Column) -> Column:
    exact = F.sum(exact).cast("double")
    rest = F.sum(rest)
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def money_sum(col: Column | str) -> Column:
    """SUM of a money column as DOUBLE; NULL if there is no amount."""
    return _total(*_split(col))


def money_state(col: Column | str, name: str) -> list[Column]:
    """Two aggregates, ``<name>_exact`` and ``<name>_rest``: a sum that can be added to others without loss."""
    exact, rest = _split(col)
    return [F.sum(exact).cast(EXACT_TYPE).alias(f"{name}_exact"), F.sum(rest).alias(f"{name}_rest")]


def money_merge(name: str) -> Column:
    """``money_sum`` from rows that hold ``money_state`` columns."""
    return _total(F.col(f"{name}_exact"), F.col(f"{name}_rest"))
