"""Exact top-k inner-product search on an impact-ordered index (operator 3).

Vectors are dealt into shards of bounded size by a hash of the row, queries
into blocks of bounded size; each pair of shard and block is one group. In a
group, every dimension has posting segments: the vectors whose component
falls into one of a few quantised levels. A query processes segments score at
a time, by descending quantised impact (the segment's largest possible
contribution), adding the impact to the accumulators of its vectors. What an
unprocessed segment can still add is bounded by the next impact of each
dimension, and quantisation by the width of the levels, so every accumulator
gives a lower and an upper bound of the exact score. Processing stops only
when these bounds prove that all but a few vectors cannot be among the k best;
the possible members are rescored exactly. Shards' lists meet in one ranking.

Defined results: components become ``floor(scale * x)`` with x as double;
vectors that are null, empty or hold null or non-finite components, and rows
with a null id, take no part; every other row is a candidate, also one that repeats an
id (with the same vector or another); queries are compared with candidates of their
own length; a query never finds rows of its own id; rows of a repeated query id share
one list, in which a candidate stands once for each of them; ties go to the smaller id;
an empty table gives an empty table; other columns are ignored. Equal rows travel as one
with their number. Scores are exact while they fit in a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.common import keep_table, ready
from adlens.llm.vectors import usable

_OUT = "query_id long, vec_id long, score long, n long"


class ImpactIndex:
    """Posting segments of a matrix of integers, ``levels`` per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, n: np.ndarray, levels: int = 16):
        order = np.argsort(ids, kind="stable")  # so that ties in a stable sort go to the smaller id
        self.ids, self.values, self.n = ids[order], np.ascontiguousarray(values[order]), n[order]
        low, high = self.values.min(axis=0), self.values.max(axis=0)
        width = (high - low) // levels + 1
        level = (self.values - low) // width
        self.rows: list[np.ndarray] = []  # of each segment
        dim, lo, hi = [], [], []
        for d in range(self.values.shape[1]):
            by_level = np.argsort(level[:, d], kind="stable")
            found, first = np.unique(level[by_level, d], return_index=True)
            self.rows += np.split(by_level, first[1:])
            dim += [d] * len(found)
            lo += (low[d] + found * width[d]).tolist()
            hi += np.minimum(high[d], low[d] + (found + 1) * width[d] - 1).tolist()
        self.dim, self.lo, self.hi = np.array(dim), np.array(lo), np.array(hi)
        self.starts = np.flatnonzero(np.r_[True, self.dim[1:] != self.dim[:-1]])

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in ``ids``) and exact scores of the k best rows of other ids than ``own``."""
        away = k + int(np.searchsorted(self.ids, own, side="right") - np.searchsorted(self.ids, own))
        q = query[self.dim]
        top, bottom = np.maximum(q * self.lo, q * self.hi), np.minimum(q * self.lo, q * self.hi)
        floor = np.minimum.reduceat(top, self.starts)  # of each dimension
        slack = int(np.maximum.reduceat(top - bottom, self.starts).sum())
        impact = top - floor[self.dim]
        order = np.argsort(-impact, kind="stable")
        n = len(self.ids)
        acc = np.zeros(n, dtype=np.int64)
        member = np.arange(n)
        checks = np.unique(np.linspace(0, len(order), 9).astype(int)[4:])
        at = 0
        for stop in checks:
            for s in order[at:stop]:
                if impact[s]:
                    acc[self.rows[s]] += impact[s]
            at = stop
            rest = np.zeros(len(self.starts), dtype=np.int64)  # what each dimension can still add
            np.maximum.at(rest, self.dim[order[at:]], impact[order[at:]])
            if n <= away:
                break
            least = np.partition(acc, n - away)[n - away] - slack  # k others, even if all rows of the own id are above
            member = np.flatnonzero(acc >= least - int(rest.sum()))
            if len(member) <= max(4 * k, n // 64):
                break
        member = member[self.ids[member] != own]
        score = self.values[member] @ query
        best = np.lexsort((self.ids[member], -score))[:k]
        return member[best], score[best]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
          vec_col: str = "embedding", levels: int = 16, shard_numbers: int = 1 << 20, block_queries: int = 4096,
          ) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that satisfy ``is_query``, against all rows."""
    ints = F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    v = (ready(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                        F.coalesce(is_query, F.lit(False)).alias("asks"))
         .where(F.col("id").isNotNull() & usable("vec"))
         .groupBy("id", "vec").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"))
         .select("id", "n", "asks", F.size("vec").alias("dim"), ints.alias("vec")))
    v = keep_table(v, "topk")
    n = v.agg(F.count(F.lit(1)), F.max("dim"), F.count_if(F.col("asks") > 0)).first()  # one row
    shards = max(1, -(-n[0] * (n[1] or 1) // shard_numbers))
    blocks = max(1, -(-(n[2] or 0) // block_queries))

    def part(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", "vec", F.lit(seed)), F.lit(count)).cast("int")

    every = (lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    key = ["dim", "shard", "block"]
    left = v.select("dim", part(shards, 1).alias("shard"), every(blocks).alias("block"), "id", "vec", "n")
    right = v.where("asks > 0").select("dim", every(shards).alias("shard"), part(blocks, 2).alias("block"), "id", "vec",
                                       F.col("asks").alias("n"))

    def numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = t.column("vec").combine_chunks()
        return (t.column("id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1),
                t.column("n").to_numpy())

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] for _ in range(4)]
        if a.num_rows and b.num_rows:
            index = ImpactIndex(*numbers(a), levels=levels)
            for own, q, n in zip(*numbers(b)):
                rows, score = index.search(q, own, k)
                for column, values in zip(found, (np.full(len(rows), own), index.ids[rows], score, index.n[rows] * n)):
                    column.append(values)
        return pa.table(dict(zip(("query_id", "vec_id", "score", "n"), (pa.array(np.concatenate(c)) for c in found))))

    lists = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, _OUT)
    each = lists.withColumn("of", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))))  # more than k equal ones cannot matter
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
