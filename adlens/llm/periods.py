"""Periodic runs of words by block convolution (operator 12).

A run is a stretch of consecutive words that repeats with smallest period q
(words q apart are identical), is at least ``max(min_length, min_repeats * q)``
words long, and cannot be extended on either side.

Scale B = 1, 2, 4, ... looks for the periods B .. 2B-1. The words are cut
into aligned blocks of B. For each block the sum of squared differences to the words
d further on is computed for all d at once: one number-theoretic transform of
each block modulo a prime, the two blocks that follow combined in the
transformed domain, one inverse transform, and running sums of squares. A sum that is
zero locates an occurrence; with at least three periods and a block's width to spare, every run
holds a block that occurs one period later, so none is missed. Occurrences of
consecutive blocks at the same distance are one seed, which can grow by less than a
block on either side; growing compares the words themselves, which also proves
the run (sums are exact modulo the prime; a false zero is found out here).
Blocks that lie, with their occurrence, inside a run of a smaller period are
passed over: their distances are multiples of that period.

The texts of an Arrow slice are laid end to end, longest first, with
separators that equal nothing; scale B takes those of ``min_repeats * B`` words or more.
Work grows as n log(n)**2 and memory as the longest text.

Defined results: a null, empty or blank text has no words and no runs; repeated rows
give repeated results; a null id is carried along; an empty table gives an empty table; other
columns are ignored. The strongest run has the greatest exact length / period, then the smallest
start, then the smallest period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import by_size, ready

PRIME = 3 * 2**30 + 1   # transforms of up to 2**30 numbers; products of two residues fit 64 bits
GENERATOR = 5
_P = np.uint64(PRIME)
_WIDTH = 1 << 17        # numbers that are transformed at a time, or one block's
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}
Run = tuple[int, int, int]  # start, length, period


def _mod(x: np.ndarray) -> np.ndarray:
    q = x // _P
    q *= _P
    x -= q
    return x


def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first ``size / 2`` powers of a root of unity of order ``size``."""
    if (size, inverse) not in _ROOTS:
        w = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        t = np.ones(1, dtype=np.uint64)
        while len(t) < size // 2:
            t = np.concatenate([t, _mod(t * np.uint64(pow(w, len(t), PRIME)))])
        if size > 1 << 16:
            return t  # of very long texts only
        _ROOTS[size, inverse] = t
    return _ROOTS[size, inverse]


def transform(a: np.ndarray) -> np.ndarray:
    """Transform each column of ``a`` (rows: a power of two) in place; rows end up in bit-reversed order."""
    n, m = a.shape
    half = n // 2
    while half:
        v = a.reshape(n // (2 * half), 2, half, m)
        x, y = v[:, 0], v[:, 1]
        d = x - y
        np.minimum(d, d + _P, out=d)
        s = x + y
        np.minimum(s, s - _P, out=s)
        if half > 1:
            d *= _roots(2 * half, False)[:, None]
            _mod(d)
        v[:, 0], v[:, 1] = s, d
        half //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """Undo ``transform`` in place."""
    n, m = a.shape
    half = 1
    while half < n:
        v = a.reshape(n // (2 * half), 2, half, m)
        x, y = v[:, 0].copy(), v[:, 1]
        if half > 1:
            y = _mod(y * _roots(2 * half, True)[:, None])
        s = x + y
        np.minimum(s, s - _P, out=s)
        d = x - y
        np.minimum(d, d + _P, out=d)
        v[:, 0], v[:, 1] = s, d
        half *= 2
    a *= np.uint64(pow(n, -1, PRIME))
    return _mod(a)


def _negated(n: int) -> np.ndarray:
    """Where the row of frequency -k lies, for the row of every k, in bit-reversed order."""
    bits = n.bit_length() - 1
    k = np.arange(n)
    rev = np.zeros(n, dtype=np.int64)
    for b in range(bits):
        rev |= ((k >> b) & 1) << (bits - 1 - b)
    return rev[(-rev) % n]


def occurrences(x: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(j, d): block j of ``x`` occurs d words later, block <= d < 2 * block, for chunks of
    blocks. ``x`` holds residues and has two blocks more than are looked for."""
    size, blocks = 2 * block, len(x) // block
    squares = np.zeros(blocks * block + 1, dtype=np.uint64)
    np.cumsum(_mod(x[:blocks * block] * x[:blocks * block]), out=squares[1:])
    sums = squares[block:] - squares[:-block]            # of the squares of `block` words from each place on
    width = max(1, _WIDTH // size)
    back, sign = _negated(size), block                   # rows of even frequencies come first
    held = np.zeros((size, 0), dtype=np.uint64)          # transforms of the blocks from `at` on
    at = 0
    while at < blocks - 2:
        upto = min(blocks, at + width + 2)
        known = at + held.shape[1]
        new = np.zeros((size, upto - known), dtype=np.uint64)
        new[:block] = x[known * block:upto * block].reshape(-1, block).T
        held = np.concatenate([held, transform(new)], axis=1)
        m = upto - at - 2
        later = held[:, 1:m + 1].copy()
        later[:sign] += held[:sign, 2:]
        later[sign:] += _P - held[sign:, 2:]
        np.minimum(later, later - _P, out=later)
        later *= held[back, :m]
        inner = inverse(_mod(later))[:block]             # inner[s, j]: block j times the words block + s later
        first = np.arange(at, at + m) * block
        total = sums[first][None, :] + sums[first[None, :] + block + np.arange(block)[:, None]]
        total += (_P - inner) * np.uint64(2)
        s, j = np.nonzero(_mod(total) == 0)
        yield j + at, s + block
        held = held[:, m:]
        at += m


def _grow(x: np.ndarray, start: int, stop: int, d: int, block: int) -> tuple[int, int]:
    """The largest stretch around [start, stop) whose words equal those ``d`` later, looking ``block`` words to each side."""
    a = max(0, start - block)
    differs = np.flatnonzero(x[a:start] != x[a + d:start + d])
    start = a + int(differs[-1]) + 1 if len(differs) else a
    z = min(stop + block, len(x) - d)
    differs = np.flatnonzero(x[stop:z] != x[stop + d:z + d])
    return start, stop + int(differs[0]) if len(differs) else z


def find_runs(texts: list[np.ndarray], min_length: int = 6, min_repeats: int = 4) -> list[list[Run]]:
    """The runs of each text, given as word numbers (equal words have equal numbers, from 0), by start and period.
    ``min_repeats`` is at least 4."""
    if min_repeats < 4:
        raise ValueError("min_repeats must be 4 or more: shorter runs need not hold a block that is looked for")
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    longest = int(sizes[0]) if len(sizes) else 0
    x = np.empty(int(starts[-1]) + longest + 3, dtype=np.int64)
    x[:] = top + np.arange(len(x))                       # separators and padding: all different
    for i, at in zip(order, starts):
        x[at:at + len(texts[i])] = texts[i]
    residues = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(2654435761) % _P
    reach = np.zeros(len(x), dtype=np.int64)             # where the run that covers a word and ends last ends
    found: dict[tuple[int, int], int] = {}
    block = 1
    while longest >= max(min_length, min_repeats * block):
        upto = int(starts[np.searchsorted(-sizes, -max(min_length, min_repeats * block), side="right")])
        rows = -(-upto // block)
        seeds = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for j, d in occurrences(residues[:(rows + 2) * block], block):
            open_ = reach[j * block] < j * block + block + d
            seeds.append((j[open_], d[open_]))
        j, d = (np.concatenate(c) for c in zip(*seeds))
        by = np.lexsort((j, d))
        j, d = j[by], d[by]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)][:len(j)])
        count = np.diff(np.r_[first, len(j)])
        most = count * block + 2 * (block - 1) + d[first]
        for f, c in zip(*(a[most >= np.maximum(min_length, min_repeats * d[first])] for a in (first, count))):
            period = int(d[f])
            a, z = _grow(x, int(j[f]) * block, int(j[f] + c) * block, period, block)
            if z - a + period < max(min_length, min_repeats * period) or (a, z + period) in found:
                continue
            if (x[a:z] == x[a + period:z + period]).all():
                found[a, z + period] = period
                np.maximum(reach[a:z + period], z + period, out=reach[a:z + period])
        block *= 2
    out: list[list[Run]] = [[] for _ in texts]
    for (a, z), period in sorted(found.items()):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        out[order[k]].append((a - int(starts[k]), z - a, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run | None:
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by blanks."""
    if runs:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def _tables(batches, min_length: int, min_repeats: int) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for b in by_size(batches, "text", most_rows=1 << 14):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        texts = [(t or b"").split() for t in b.column("text").to_pylist()]
        coded = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
        runs = find_runs(coded, min_length, min_repeats)
        as_rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        best = [dict(zip(("start", "length", "period"), r)) if (r := strongest(rs)) else None for rs in runs]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(as_rows, pa.list_(run)), pa.array(best, run),
             pa.array([collapse(t, r) for t, r in zip(texts, runs)], pa.binary())],
            ["id", "n_words", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = 6, min_repeats: int = 4) -> DataFrame:
    """``id_col, n_words, runs`` (array of start, length, period by start, then period), ``best``
    (the strongest run or null) and ``collapsed`` (the text without repetitions) of every row."""
    rows = ready(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(lambda batches: _tables(batches, min_length, min_repeats),
                          f"id {kind}, n_words long, runs array<{run}>, best {run}, collapsed binary")
    return got.select(F.col("id").alias(id_col), "n_words", "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))
