"""Previous-row lookups per key that stay parallel when one key is hot.

A plain ``lag().over(partitionBy(user))`` sends every row of a user to one
task, so a user holding a third of all rows becomes a third of the job in a
single task. Here the ordered sequence is split by (key, day): rows look back
inside their day, and the first row of a day takes its value from a small
one-row-per-(key, day) table, itself windowed per key (at most one row per
day, so bounded by the number of days, not by the number of events).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CUTS = 256  # segments of a hot period at most


def with_segments(df: DataFrame, keys: Sequence[str], time_col: str, period: int, out: str, max_rows: int | None = None,
                  max_hot: int = 1000) -> DataFrame:
    """Add ``out``: a number per period of ``period`` units of ``time_col`` (null for a null time), monotone with time.

    With ``max_rows``, the periods of a key that hold more rows are measured and cut at 255 quantiles of their
    times, so a segment holds ``max_rows`` rows or, in a period with more than 256 times as many, a 256th of
    them. Rows of one time stay together. The ``max_hot`` heaviest periods are cut (their cut points are
    broadcast: at most ``max_hot`` rows of 255 numbers); any other has less than a ``max_hot``-th of all rows.
    ``df`` is read three times then, so store it first.
    """
    number = (F.floor(F.col(time_col) / F.lit(period)) * CUTS).cast("long")
    df = df.withColumn(out, number)
    if max_rows is None:
        return df
    same = [*keys, out]
    hot = (df.where(F.col(time_col).isNotNull()).groupBy(*same).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_rows)
           .orderBy(F.desc("__n"), *same).limit(max_hot).select(*(F.col(c).alias(f"__h_{c}") for c in same)))

    def met(side: DataFrame):
        condition = F.lit(True)
        for c in same:
            condition = condition & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
        return df.join(F.broadcast(side), condition, "left")

    found = met(hot).where(F.col(f"__h_{out}").isNotNull())
    at = F.percentile_approx(time_col, [i / CUTS for i in range(1, CUTS)], 10_000)
    cuts = found.groupBy(*same).agg(F.array_distinct(at).alias("__cuts")).select(
        *(F.col(c).alias(f"__h_{c}") for c in same), "__cuts")
    cut = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(time_col))), F.lit(0))
    return met(cuts).withColumn(out, F.col(out) + F.when(F.col("__cuts").isNotNull(), cut).otherwise(0)).select(*df.columns)


def previous_in_sequence(df: DataFrame, key: str, day: str, order: Sequence[str],
                         value: Column, out: str, ignore_nulls: bool = False) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same ``key`` in ``order``.

    ``order`` must start with a column that is monotone with ``day`` (for
    example the event time), so that day order and row order agree.

    ``ignore_nulls=False``: value of the immediately preceding row (``lag``).
    ``ignore_nulls=True``: last non-NULL value at or before the current row
    (``last(ignorenulls)`` over a running frame, i.e. an as-of lookup).
    """
    w_local = Window.partitionBy(key, day).orderBy(*order)
    tmp_local, tmp_day, tmp_prior = f"__{out}_local", f"__{out}_day", f"__{out}_prior"
    if ignore_nulls:
        local = F.last(value, ignorenulls=True).over(
            w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # latest non-NULL value of the day: max over (order..., value)
        day_agg = F.max(F.when(value.isNotNull(),
                               F.struct(*[F.col(o) for o in order], value.alias("v"))))
    else:
        local = F.lag(value).over(w_local)
        day_agg = F.max(F.struct(*[F.col(o) for o in order], value.alias("v")))
    with_local = df.withColumn(tmp_local, local)

    daily = with_local.groupBy(key, day).agg(day_agg.alias(tmp_day))
    w_days = Window.partitionBy(key).orderBy(day)
    if ignore_nulls:
        prior = F.last(F.col(f"{tmp_day}.v"), ignorenulls=True).over(
            w_days.rowsBetween(Window.unboundedPreceding, -1))
    else:
        prior = F.lag(F.col(f"{tmp_day}.v")).over(w_days)
    daily = daily.select(key, day, prior.alias(tmp_prior))

    # First rows of a day (no local predecessor) take the prior day's value.
    # A plain equi-join on (key, day) reuses the partitioning of the window
    # above, so only the small daily table moves. Rows with a NULL key get no
    # predecessor (callers filter NULL keys first).
    if ignore_nulls:
        first_of_day = F.col(tmp_local).isNull()
    else:
        first_of_day = F.row_number().over(w_local) == 1
    joined = with_local.withColumn("__first", first_of_day).join(daily, [key, day], "left")
    res = F.when(F.col("__first"), F.col(tmp_prior)).otherwise(F.col(tmp_local))
    return joined.withColumn(out, res).drop(tmp_local, tmp_prior, "__first")
