"""Distributed connected components by alternating large and small stars.

Every round links the larger neighbours of each node to the smallest member
of its neighbourhood, then the smaller ones, until the edges are stars around the
smallest id of each component. All steps are aggregates and equi-joins, so a
node with very many neighbours is pre-aggregated map-side and its join is
split by adaptive execution; each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import keep_table


def _smallest(edges: DataFrame, of: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(of).alias("node")).agg(F.min(other).alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """``edges``: distinct (hi, lo) with hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    large = (both.join(_smallest(both, "u", "v"), F.col("u") == F.col("node"))
             .where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())
    small = large.join(_smallest(large, "hi", "lo"), F.col("hi") == F.col("node"))
    return (small.select("hi", F.col("m").alias("lo"))
            .unionByName(small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct())


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge that is not the smallest of its
    component (``component`` is the smallest node id reachable). Loops and repeated
    edges are allowed; edges with a null end are no edges; no edges give no rows."""
    now = keep_table(edges.where(F.col(a) != F.col(b))
                     .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc")
    seen = _state(now)
    while seen[0]:
        now = keep_table(_round(now), "cc")
        if (new := _state(now)) == seen:
            break
        seen = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
