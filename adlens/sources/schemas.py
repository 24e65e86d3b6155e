"""Required-column validation at operator entry (schema only, no Spark job)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Raise a clear error naming the missing input columns of ``what``."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"{what}: input lacks column(s) {missing}; has {sorted(have)}")
    return df
