"""Column-level building blocks shared by the operators (all JVM-side)."""

from adlens.functions.bands import band_by_edges, bucket_labels, hour_ladder, matched_band
from adlens.functions.devices import classify_device, collapse_device, DEVICE_TYPES_KEPT
from adlens.functions.money import money_sum
from adlens.functions.population import ab_population
from adlens.functions.predicates import (
    day_between, not_anonymous, partner_scope, partitions_for,
)
from adlens.functions.time import epoch_to_day, epoch_micros

__all__ = [
    "band_by_edges", "bucket_labels", "hour_ladder", "matched_band",
    "classify_device", "collapse_device", "DEVICE_TYPES_KEPT",
    "money_sum", "ab_population",
    "day_between", "not_anonymous", "partner_scope", "partitions_for",
    "epoch_to_day", "epoch_micros",
]
