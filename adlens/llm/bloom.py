"""A bounded bitmap that spares a shuffle most of the rows that cannot join.

Its size is a parameter, whatever the table's: beyond its capacity it fills up
and lets everything pass, and the exact join that follows does all the work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def bitmap(longs: DataFrame, col: str, bits: int = 1 << 25) -> np.ndarray:
    """``bits`` bits as 64-bit words; at most ``bits / 64`` rows reach the driver."""
    scrambled = F.xxhash64(F.col(col))
    words = (longs.select(F.pmod(scrambled, F.lit(bits)).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64(longs: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column."""
    h = np.uint64((seed + int(_P5) + 8) % (1 << 64)) ^ (_rotl(longs.astype(np.uint64) * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def might_hold(words: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """For each number, False only if it is surely not in the bitmap."""
    bit = xxhash64(longs) & np.int64(len(words) * 64 - 1)
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1





def tagged(df: DataFrame, col: str, longs: DataFrame, id_col: str, out: str, bits: int = 1 << 22) -> DataFrame:
    """``df`` with the boolean ``out``: False only if ``col`` is null or surely not in ``longs.id_col``.
    The bitmap is joined as a broadcast table of at most ``bits / 64`` rows."""
    bit = F.pmod(F.xxhash64(F.col(id_col)), F.lit(bits))
    words = F.broadcast(longs.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("__word"))
                        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("__mask")))
    own = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    hit = F.expr("(shiftrightunsigned(__mask, cast(__bit & 63 as int)) & 1) = 1")
    return (df.withColumn("__bit", own).join(words, F.shiftright("__bit", 6) == F.col("__word"), "left")
            .withColumn(out, F.coalesce(hit, F.lit(False)) & F.col(col).isNotNull())
            .drop("__bit", "__word", "__mask"))
