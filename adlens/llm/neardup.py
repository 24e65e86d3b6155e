"""Embedding near-duplicates (operator 5).

Equal vectors are one class first. Each class is hashed by the signs of its
products with random hyperplanes in several tables; classes that share a
bucket in a table are compared by exact cosine in double precision. A pair that
shares buckets in several tables counts in the first. Buckets above
``block_rows`` classes are split into blocks and compared block pair by block pair, so
no task holds more than two blocks however hot a bucket is. A group emits,
per member, the number of rows it links to and one edge towards the smallest
member reachable in the group, never its pairs; distributed connected
components finish the groups.

The number of bits follows the number of classes, that of tables the wanted
recall at the threshold: the chance that a pair with exactly the threshold's
cosine shares a bucket somewhere is at least ``recall``; closer pairs have more.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths never link; equal rows link with each other; of rows that share
an id, each has the links of its own vector (vectors whose smallest id is the
same are one node); a null id takes no part (component null, not kept); an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import keep_table, ready
from adlens.llm.components import components
from adlens.llm.vectors import matrix, usable


def plan_tables(classes: int, threshold: float, recall: float, bucket: int = 8) -> tuple[int, int]:
    """Bits per table and number of tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(classes, 1) / bucket + 1))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits]).standard_normal((tables * bits, dim))


def compare(vecs: np.ndarray, sigs: np.ndarray, rows: np.ndarray, ids: np.ndarray, side: np.ndarray | None, table: int,
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one group: per member, the rows linked directly and first seen in this
    table, and the smallest id reachable by these links. With ``side`` (0/1, two
    blocks of a hot bucket), only pairs across are compared."""
    unit = vecs / np.abs(vecs).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    at = np.nonzero(linked)
    if len(at[0]):
        seen = (sigs[at[0], :table] == sigs[at[1], :table]).any(axis=1)
        linked[at[0][seen], at[1][seen]] = False
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return linked @ rows, low
        low = new


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                    recall: float = 0.995, seed: int = 5, block_rows: int = 1024) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row."""
    all_rows = ready(vectors).select(F.col(id_col).cast("long").alias("id"),
                              F.col(vec_col).cast("array<double>").alias("vec"))
    nonzero = F.exists("vec", lambda x: x != 0)
    good = usable("vec") & nonzero & F.col("id").isNotNull()
    classes = keep_table(all_rows.where(good).groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")),
                         "neardup-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                packed, sigs = [], []
                for v in b.column(1):
                    x = v.values.to_numpy(zero_copy_only=False)
                    x = x / np.abs(x).max()
                    if len(x) not in planes:
                        planes[len(x)] = hyperplanes(len(x), bits, tables, seed)
                    up = (planes[len(x)] @ x > 0).reshape(tables, bits)
                    sigs.append((up @ powers).astype("<i4"))
                    packed.append(x.astype("<f8").tobytes())
                yield pa.record_batch([b.column(0), b.column(2), pa.array(packed, pa.binary()),
                                       pa.array([s.tobytes() for s in sigs], pa.binary()),
                                       pa.array(sigs, pa.list_(pa.int32()))],
                                      names=["rep", "n", "vec", "sig", "buckets"])

    signed = keep_table(classes.select("rep", "vec", "n").mapInArrow(
        sign, "rep long, n long, vec binary, sig binary, buckets array<int>"), "neardup-signed")
    dealt = signed.select(F.length("vec").alias("size"), "rep", "n", "vec", "sig", F.posexplode("buckets").alias("t", "bucket"))
    key = ["t", "size", "bucket"]
    hot = keep_table(dealt.groupBy(*key).count().where(F.col("count") > block_rows)
                     .select(*key, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "neardup-hot")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"), (mine > j).cast("int").alias("side")))
    tasks = (dealt.join(hot, key, "left")
             .withColumn("task", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
             .select(*key, "task.x", "task.y", "task.side", "rep", "n", "vec", "sig"))
    order = [*key, "x", "y"]
    sorted_tasks = tasks.repartition(*order).sortWithinPartitions(*order)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.stack([held.column(c).to_numpy() for c in order])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(ends):
                yield from groups(held.slice(0, int(ends[-1])), np.r_[0, ends])
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            keys = np.stack([held.column(c).to_numpy() for c in order])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            yield from groups(held, np.r_[0, ends, held.num_rows])

    def groups(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, rows, side, table = (t.column(c).to_numpy() for c in ("rep", "n", "side", "t"))
        across = t.column("x").to_numpy() != t.column("y").to_numpy()
        vec, sig = t.column("vec"), t.column("sig")
        out: list[np.ndarray] = []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if z - a < 2:
                continue
            linked, low = compare(matrix(vec[a:z], "<f8"), matrix(sig[a:z], "<i4"), rows[a:z], ids[a:z],
                                  side[a:z] if across[a] else None, int(table[a]), threshold)
            hit = linked > 0
            if hit.any():
                out.append(np.stack([ids[a:z][hit], linked[hit], low[hit]]))
        if out:
            yield pa.record_batch([pa.array(x) for x in np.concatenate(out, axis=1)], names=["rep", "linked", "low"])

    found = keep_table(sorted_tasks.mapInArrow(verify, "rep long, linked long, low long"), "neardup-links")
    links = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    comps = components(found, "rep", "low")
    known = (classes.join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
             .select(F.col("vec").alias("of"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component")))
    rows = all_rows.withColumn("key", F.when(good, F.col("vec")))
    return rows.join(known, F.col("key") == F.col("of"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"))
