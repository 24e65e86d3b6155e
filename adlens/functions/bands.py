"""Banding ladders expressed as CASE WHEN chains (first match wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default exposure-bucket edges and label prefixes.
DEFAULT_EXPOSURE_EDGES = (2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24)
MAX_PREFIX = "Max"
OVER_PREFIX = "Over"


def _fmt(e: float) -> str:
    return f"{e:g}"


def bucket_labels(edges: Sequence[float]) -> list[str]:
    return [f"{MAX_PREFIX}{_fmt(e)}" for e in edges] + [f"{OVER_PREFIX}{_fmt(edges[-1])}"]


def band_by_edges(col: Column | str, edges: Sequence[float] = DEFAULT_EXPOSURE_EDGES,
                  labels: Sequence[str] | None = None) -> Column:
    """``CASE WHEN x <= e1 THEN l1 ... ELSE over`` from an ascending edge list."""
    c = F.col(col) if isinstance(col, str) else col
    labels = list(labels) if labels is not None else bucket_labels(edges)
    if len(labels) != len(edges) + 1:
        raise ValueError("need len(edges) + 1 labels")
    expr = None
    for e, lab in zip(edges, labels):
        cond = c <= F.lit(float(e))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def hour_ladder(col: Column | str, bins: int = 24) -> Column:
    """Bin ``k`` for ``x <= k/bins`` (inclusive upper edges); NULL above 1.

    Built literally as a ladder instead of ``ceil(x*bins)`` so the double
    edge comparisons are exactly the SQL ones.
    """
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k in range(1, bins + 1):
        cond = c <= F.lit(k / bins)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr


def matched_band(col: Column | str, top: int = 3) -> Column:
    """``>= top -> top``, ..., ``>= 2 -> 2``, else (including NULL) ``1``."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k in range(top, 1, -1):
        cond = c >= F.lit(k)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr.otherwise(F.lit(1))
