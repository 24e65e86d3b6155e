"""Deterministic A/B population assignment as a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Population labels.
EXPOSED = "exposed"
CONTROL = "control"


def population_hash(user: Column | str, test_id: int | str) -> Column:
    """First 32 bits of md5("<user>:<test_id>") as a non-negative bigint."""
    u = F.col(user) if isinstance(user, str) else user
    key = F.concat(u.cast("string"), F.lit(f":{test_id}"))  # NULL user -> NULL
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def ab_population(user: Column | str, test_id: int | str, n_populations: int = 2) -> Column:
    """Bucket 0 is ``exposed``; every other bucket, and a NULL user, is ``control``."""
    h = population_hash(user, test_id)
    return F.when((h % F.lit(n_populations)) == 0, F.lit(EXPOSED)).otherwise(F.lit(CONTROL))
