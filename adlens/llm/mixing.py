"""Mixing sources to target weights by Poisson replication (operator 2, native).

Each source gets a mean repetition rate ``lambda = weight / sum(weights) *
total / rows of the source``. Each row's number of copies is a Poisson
variable with that mean, found by inverting the distribution at a uniform
number hashed from (seed, content), so the mix is reproducible and independent of
partitioning. The content is a digest of all the row's columns, so rows that
share an id, or have none, draw on their own. A rate above ``max_rate`` is the sum of
equal smaller rates, each inverted at its own hash (a sum of Poisson variables is a
Poisson variable), which keeps the distribution's table short and free of underflow.
Rows are then exploded by their counts and shuffled globally: dealt out and sorted
by a hash of (seed, content, copy).

Rows that are equal in every column cannot be told apart: m of them are one row with
m times the rate (the sum of their m Poisson variables), reduced map-side, and its
draws are dealt out before they are exploded, so no task makes all its copies.

Everything is DataFrame functions. The tables that are joined, a row per
source and a row per repeated content, are written first, so Spark broadcasts them only
if their stored size allows and joins them by a sort-merge join (with skew splitting)
beyond that. The hot source is counted map-side and is spread over all tasks by the
shuffle's hash.

Defined results: a null source is a source of its own; sources without a
weight, or with weight 0 or below, get no copies; null ids, null and empty texts are
values like others; repeated rows are replicated together, to their joint rate; an
empty table gives an empty table. The output columns ``mix_copy`` (1..count) and
``mix_key`` (the order) replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import keep_table


def hashed(digits: int, *parts: Column) -> Column:
    """The first ``digits`` hex digits of an md5 over the parts, as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the hash."""
    return hashed(13, *parts) / F.lit(float(1 << 52))


def poisson_cdf(rate: Column, tail: int = 80) -> Column:
    """P(X <= k) for k = 0 .. ``tail``; beyond it lies under 1e-25 for rates up to 16."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(tail)), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, *, source_col: str = "source", weights: dict | None = None, alpha: float = 0.5,
                 total: int | None = None, max_rate: float = 16.0) -> DataFrame:
    """One stored row per source: ``source, n, rate, splits, cdf``. Without ``weights``
    the target weight of a source is its row count to the power ``alpha``; without
    ``total`` the mix has as many rows as the input, in the mean."""
    n = keep_table(docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    n = n.withColumn("w", F.greatest(w, F.lit(0.0)))
    sums = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()  # one row
    wanted, weight = float(total if total is not None else sums["n"] or 0), float(sums["w"] or 0.0)
    share = F.lit(wanted) / F.lit(weight) if weight else F.lit(0.0)
    rates = (n.withColumn("rate", F.col("w") * share / F.col("n"))
             .withColumn("splits", F.greatest(F.ceil(F.col("rate") / max_rate), F.lit(1)).cast("int"))
             .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("splits"))))
    return keep_table(rates.select("source", "n", "rate", "splits", "cdf"), "mix-rates")


def content(columns: list[Column]) -> Column:
    """A digest of the values, as text: equal only for rows that are equal in all of them (nulls included)."""
    return F.md5(F.concat_ws(",", *(F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("")) for c in columns)).cast("binary"))


def mix_sources(docs: DataFrame, *, source_col: str = "source", seed: int = 17, weights: dict | None = None,
                alpha: float = 0.5, total: int | None = None, max_rate: float = 16.0) -> DataFrame:
    """All columns of ``docs`` plus ``mix_copy`` and ``mix_key``, one row per copy, in globally shuffled order."""
    docs = docs.drop("mix_copy", "mix_key")
    names = docs.columns
    rates = source_rates(docs, source_col=source_col, weights=weights, alpha=alpha, total=total, max_rate=max_rate).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("splits").alias("__splits"), F.col("cdf").alias("__cdf"))
    keyed = docs.withColumn("__content", content([docs[c] for c in names]))
    repeated = keep_table(keyed.groupBy(F.col("__content").alias("__of")).agg(F.count(F.lit(1)).alias("__m")).where("__m > 1"),
                          "mix-repeated")
    rated = (keyed.join(repeated, F.col("__content") == F.col("__of"), "left").drop("__of")
             .join(rates, F.col(source_col).eqNullSafe(F.col("__source"))).drop("__source"))

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(seed), F.col("__content"), j)
        return F.size(F.filter(F.col("__cdf"), lambda c: c <= u))

    kept = [*names, "__content"]
    single = rated.where("__m is null").withColumn("__count", F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col("__splits")), drawn), F.lit(0), lambda acc, n: acc + n)).where("__count > 0")
    single = single.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__count").cast("long"))).alias("mix_copy"))

    # equal rows: one of them, with the joint rate; draw j makes the copies j, j + splits, j + 2 * splits, ...
    joint = rated.where("__m is not null").dropDuplicates(["__content"]).withColumn("__rate", F.col("__rate") * F.col("__m"))
    splits = F.greatest(F.ceil(F.col("__rate") / max_rate), F.lit(1)).cast("long")
    dealt = (joint.withColumn("__splits", splits).select(*kept, "__rate", "__splits", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__splits"))).alias("__j"))
             .repartition("__content", "__j").withColumn("__cdf", poisson_cdf(F.col("__rate") / F.col("__splits")))
             .withColumn("__count", drawn(F.col("__j"))).where("__count > 0"))
    several = dealt.select(*kept, F.explode(F.transform(
        F.sequence(F.lit(0), F.col("__count") - 1), lambda i: F.col("__j") + F.col("__splits") * i)).alias("mix_copy"))

    copies = single.unionByName(several)
    return (copies.withColumn("mix_key", hashed(15, F.lit(seed), F.col("__content"), F.col("mix_copy"))).drop("__content")
            .repartition(F.col("mix_key")).sortWithinPartitions("mix_key"))
