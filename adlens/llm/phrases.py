"""Phrase collocations by prefix-free parsing (operator 11).

Texts (A-Z lower-cased) are cut into pieces at ``. , ; : ! ?`` and line ends,
pieces into words at blanks and tabs. Parsing cuts every piece at trigger words (whose hash
is 0 modulo ``window``), so equal passages are cut alike wherever they stand.
A chunk reaches ``max_words - 1`` words into the next one of its piece, so each phrase
lies whole in the chunk its first word belongs to; ``own`` says how many words
are the chunk's own, and overlaps count there alone. Spark groups the chunks into a
dictionary (language, chunk, own) with parse frequencies, which is stored;
everything else reads each distinct chunk once and weighs it.

Counting is level by level. A phrase that occurs ``min_count`` times consists
of shorter ones that do. Counts by 64-bit hash never fall below the true ones, so the
phrases that reach ``min_count`` that way hold all that do; they are kept as
a bitmap of fixed size, which lets false ones pass, never drops a true one, and lets all
pass when it is full. The last pass counts the phrases that pass by their
words, exactly.

A candidate has 2 to ``max_words`` words and a = f(phrase) >= ``min_count``. Cut
after k words it scores floor(1,000,000 * a * a / (f(first part) * f(rest))); the cut with the
lowest score counts, then the smallest k. A candidate goes if a longer one
holds it contiguously and has at least ``cover_percent`` of its count. Products are
decimals of 38 digits (exact for counts below 10**16).

Defined results: a null text is empty and has no words; a null language is
``und`` and shares its counts with a language of that name; a language without
candidates has no rows; repeated rows count every time; ids are not used; an empty table
gives an empty table; other columns are ignored. Ties: score, a, then phrase by bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import by_size, keep_table, ready, release_memory
from adlens.llm.words import mix

NO_LANGUAGE = "und"
BITS = 1 << 25            # of a level's bitmap: 4 MB, and at most BITS / 64 rows to the driver
_U = np.uint64
_MAP = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = [mix(np.arange(256, dtype=_U), seed) for seed in (11, 12)]
_STEP = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]
_BATCH = 8 << 20


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: maximal runs without blank and line feed."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_and(data != 32, data != 10, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash per word: the sum of its bytes' random numbers times powers of an odd step, scrambled."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, _U)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP[kind]))
    at = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    values = _BYTE[kind][data[np.repeat(starts, sizes) + within]] * powers[within]
    return mix(np.add.reduceat(values, at), kind + 1)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], sizes)], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


# -- parsing -----------------------------------------------------------------------
def _sections(blob: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """``blob`` cut after line feeds into sections of ``size`` bytes or a little more, with their offsets."""
    at = 0
    while at < len(blob):
        end = blob.find(b"\n", at + size) + 1 or len(blob)
        yield at, blob[at:end]
        at = end


def parse(blob: bytes, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of the mapped bytes ``blob`` (pieces end in line feeds): their words joined by
    blanks and ended by a line feed as bytes and offsets, their own words, and where they start in ``blob``."""
    data = np.frombuffer(blob, dtype=np.uint8)
    starts, ends = _spans(data)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    piece = np.searchsorted(breaks, starts)
    new = np.r_[True, piece[1:] != piece[:-1]]
    first = np.flatnonzero(new | (_word_hashes(data, starts, ends) % _U(window) == 0))
    after = np.r_[first[1:], n]
    piece_ends = np.r_[np.flatnonzero(new)[1:], n]
    last = np.minimum(after + overlap, piece_ends[(np.cumsum(new) - 1)[first]])
    count = last - first
    total = np.cumsum(count)
    words = np.arange(int(total[-1])) + np.repeat(first - (total - count), count)
    sizes = (ends - starts)[words] + 1
    out, offsets = _gather(np.append(data, np.uint8(10)), starts[words], sizes)
    out[offsets[1:] - 1] = 32
    chunk_ends = offsets[total]
    out[chunk_ends - 1] = 10
    return out, np.r_[0, chunk_ends], after - first, starts[first]


def _chunks(batches: Iterable[pa.RecordBatch], window: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches, "text", most_rows=1 << 14):
        texts = [(t or b"") + b"\n" for t in b.column("text").to_pylist()]
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        for at, blob in _sections(b"".join(texts).translate(_MAP), 4 << 20):
            out, offsets, own, where = parse(blob, window, overlap)
            row = np.searchsorted(begins, where + at, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row)), pa.array(own, pa.int32()), _binary(out, offsets)],
                                             ["lang", "own", "chunk"])


def chunk_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", window: int = 16,
                     overlap: int = 2) -> DataFrame:
    """``lang, own, chunk, freq`` of the distinct chunks (stored)."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    rows = ready(docs.select(lang, F.col(text_col).cast("binary").alias("text")))
    found = rows.mapInArrow(lambda batches: _chunks(batches, window, overlap), "lang string, own int, chunk binary")
    return keep_table(found.groupBy("lang", "own", "chunk").agg(F.count(F.lit(1)).alias("freq")), "phrase-chunks")


# -- counting ----------------------------------------------------------------------
class Grams:
    """The words of a batch of distinct chunks, and the phrases that are theirs."""

    def __init__(self, batch: pa.Table):
        chunk = batch.column("chunk").combine_chunks()
        self.langs = batch.column("lang").combine_chunks().dictionary_encode()
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
        self.data = np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        self.starts, self.ends = _spans(self.data)
        self.chunk = np.searchsorted(offsets - offsets[0], self.starts, side="right") - 1
        own = batch.column("own").to_numpy()
        begin = np.searchsorted(self.chunk, np.arange(len(chunk)))
        self.owned = np.arange(len(self.starts)) - begin[self.chunk] < own[self.chunk]
        self.weight = batch.column("freq").to_numpy()[self.chunk]
        self.hash = _word_hashes(self.data, self.starts, self.ends)
        codes = self.langs.indices.to_numpy()
        self.lang = codes[self.chunk]
        seeds = np.array([xxhash.xxh3_64_intdigest(v.as_py().encode("utf-8", "surrogatepass")) for v in self.langs.dictionary], dtype=_U)
        self.seed = seeds[self.lang] if len(seeds) else np.zeros(0, _U)

    def whole(self, size: int) -> np.ndarray:
        """The first words of all runs of ``size`` words inside a chunk."""
        n = max(0, len(self.starts) - size + 1)
        return np.flatnonzero(self.chunk[:n] == self.chunk[size - 1:])

    def keys(self, at: np.ndarray, size: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """A hash of language and words for the phrases of ``size`` words from ``at`` on."""
        hashes = self.hash if hashes is None else hashes
        h = self.seed[at].copy()
        for i in range(size):
            h = mix(h * _STEP[0] + hashes[at + i], size)
        return h

    def passing(self, size: int, maps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First words and keys of the chunk's own phrases of ``size`` words whose parts of one
        word less all pass, and which pass themselves if their level is known."""
        at = self.whole(size)
        at = at[self.owned[at]]
        if size > 1:
            for shift in (0, 1):
                at = at[_holds(maps[size - 1], self.keys(at + shift, size - 1))]
        keys = self.keys(at, size)
        if size in maps:
            ok = _holds(maps[size], keys)
            at, keys = at[ok], keys[ok]
        return at, keys


def _holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & _U(len(words) * 64 - 1)
    return (words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches put together to tables of about ``_BATCH`` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= _BATCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    release_memory()


def _summed(keys: np.ndarray, weight: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row per key (and per run of equal ``also`` among equal keys) and their sums of weights."""
    order = np.argsort(keys)
    if not len(order):
        return order, weight[:0]
    cut = np.ones(len(order), dtype=bool)
    cut[1:] = keys[order][1:] != keys[order][:-1]
    for other in also:
        cut[1:] |= other[order][1:] != other[order][:-1]
    first = np.flatnonzero(cut)
    return order[first], np.add.reduceat(weight[order], first)


def _key_counts(batches, size: int, maps) -> Iterator[pa.RecordBatch]:
    maps = {k: v.value for k, v in maps.items()}
    for t in _tables(batches):
        g = Grams(t)
        at, keys = g.passing(size, maps)
        rows, sums = _summed(keys, g.weight[at])
        yield pa.RecordBatch.from_arrays([pa.array(keys[rows].view(np.int64)), pa.array(sums)], ["key", "w"])


def _phrase_counts(batches, max_words: int, maps) -> Iterator[pa.RecordBatch]:
    maps = {k: v.value for k, v in maps.items()}
    names = ["lang", "size", "phrase", "w"]
    for t in _tables(batches):
        g = Grams(t)
        other = _word_hashes(g.data, g.starts, g.ends, 1)
        total = np.bincount(g.lang[g.owned], g.weight[g.owned].astype(np.float64), len(g.langs.dictionary))
        exact = total.astype(np.int64) if total.sum() < 2**52 else np.array(
            [int(g.weight[g.owned & (g.lang == c)].sum()) for c in range(len(total))], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [g.langs.dictionary, pa.array(np.zeros(len(exact), np.int32)), pa.array([b""] * len(exact), pa.binary()), pa.array(exact)], names)
        for size in range(1, max_words + 1):
            at, keys = g.passing(size, maps)
            rows, sums = _summed(keys, g.weight[at], g.keys(at, size, other))
            at = at[rows]
            spans = _gather(g.data, g.starts[at], g.ends[at + size - 1] - g.starts[at])
            yield pa.RecordBatch.from_arrays(
                [g.langs.dictionary.take(pa.array(g.lang[at])), pa.array(np.full(len(at), size, np.int32)), _binary(*spans), pa.array(sums)], names)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """BITS bits as 64-bit words, one bit set for each key."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    words = (keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out.view(_U)


def phrase_counts(chunks: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """``lang, size, phrase, f``: the exact counts of all phrases of 1 to ``max_words`` words that
    occur ``min_count`` times or more in a language, and of all its words (size 0). Stored."""
    context = chunks.sparkSession.sparkContext
    maps: dict = {}
    for size in range(1, max_words):
        known = dict(maps)
        counts = (chunks.mapInArrow(lambda batches, size=size, known=known: _key_counts(batches, size, known), "key long, w long")
                  .groupBy("key").agg(F.sum("w").alias("w")).where(F.col("w") >= min_count))
        maps[size] = context.broadcast(_bitmap(counts))
    found = (chunks.mapInArrow(lambda batches: _phrase_counts(batches, max_words, maps), "lang string, size int, phrase binary, w long")
             .groupBy("lang", "size", "phrase").agg(F.sum("w").alias("f"))
             .where((F.col("f") >= min_count) | (F.col("size") == 0)))
    return keep_table(found.withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


# -- scores ------------------------------------------------------------------------
def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
                 cover_percent: int = 50, top: int = 2000, window: int = 16) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases; numbers are long."""
    chunks = chunk_dictionary(docs, text_col, lang_col, window, max_words - 1)
    counts = phrase_counts(chunks, max_words, min_count)
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("tail"))
    big = "decimal(19,0)"
    score = F.expr(f"cast(cast(1000000 * (cast(a as {big}) * cast(a as {big})) as decimal(38,0)) div (cast(l as {big}) * cast(r as {big})) as bigint)")
    scored = (cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    inner = (candidates.where("size > 2").select("lang", "a", "words", F.explode(F.expr("sequence(2, size - 1)")).alias("n"))
             .select("lang", "a", "words", "n", F.explode(F.expr("sequence(1, size(words) - n + 1)")).alias("from"))
             .select("lang", F.expr("array_join(slice(words, from, n), ' ')").alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    covered = F.coalesce(100 * F.col("longer") >= cover_percent * F.col("a"), F.lit(False))
    left = scored.join(inner, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                            F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
