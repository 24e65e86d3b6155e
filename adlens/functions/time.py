"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 for a TIMESTAMP_NTZ (wall clock read as UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND",
                            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def epoch_to_day(col: Column | str) -> Column:
    """UTC calendar day of an epoch-seconds column.

    Same result as ``to_date(from_unixtime(x))`` with a UTC session, but
    independent of ``spark.sql.session.timeZone``.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.date_from_unix_date(F.floor(c / F.lit(86400)).cast("int"))
