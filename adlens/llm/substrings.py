"""Substring deduplication with suffix automata of reference shards (operator 8).

A window is ``size`` consecutive words. Every word is removed that lies in a
window whose word sequence starts anywhere else in the corpus, the same
document included.

1. Candidates. In each window the smallest hash of its 8-word shingles is its
   anchor; equal windows have equal anchors. Anchors that occur once in the
   corpus rule their windows out (a map-side-combined count, and a bounded
   bitmap of the others).
2. Reference. Of equal candidate windows (by hash, counted over all rows) the
   first by (text, position) owns the content. Owned windows that follow each other are a
   reference passage, so the reference holds each repeated passage once; its
   shards are the owners' texts. Other occurrences become runs of windows that point into a shard.
3. Matching. A task builds the suffix automaton of a shard's passages and streams the
   runs that point into it, computing matching statistics: where the longest match that
   ends at a word has ``size`` words or more, the span is proven word by word.
   A shard with many runs is sent to as many tasks as its runs are split into.
4. Removal. Maximal proven spans of the runs, and of the passages they matched, are cut.

Texts are addressed by their content, so exact copies are one text with a
count: any window of a text that occurs twice is repeated.

Defined results: null texts have no words; white space is ASCII's; kept
words are joined by one blank; rows with equal ids are separate rows; a null id is an id
like others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.bloom import bitmap, might_hold
from adlens.llm.common import by_size, keep_table, ready
from adlens.llm.words import batch_hashes, windows

SHINGLE = 8


class SuffixAutomaton:
    """Of one or more sequences of words; no match runs across two of them."""

    def __init__(self, sequences: Iterable[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for i, seq in enumerate(sequences):
            for w in seq:
                last = self._extend(last, w)
            last = self._extend(last, ("end", i))

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            return cur
        q = nxt[p][w]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        link[q] = link[cur] = twin
        return cur

    def statistics(self, seq: list) -> list[int]:
        """For each word of ``seq``, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        out = []
        for w in seq:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            out.append(n)
        return out


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over every run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (size - have)], x[size - have:]) if size > have else x


def _least(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words one after the other: the hash of each 8-word shingle, the anchor of each window, and
    which windows lie inside one text."""
    shingles = windows(words, SHINGLE, 8)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[:len(words) - size + 1] == text[size - 1:]
    return shingles, _sliding(shingles, size - SHINGLE + 1, np.minimum), inside


def anchor_places(words: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Hashes at the places that are the anchor of some window."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    shingles, least, inside = _least(words, lengths, size)
    pad = np.zeros(size - SHINGLE, dtype=np.uint64)
    return shingles[_sliding(np.r_[pad, np.where(inside, least, np.uint64(0)), pad], size - SHINGLE + 1, np.maximum) == shingles]


def candidate_windows(words: np.ndarray, lengths: np.ndarray, size: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows whose anchor may be in ``repeated``."""
    if len(words) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    _, least, inside = _least(words, lengths, size)
    least = least.view(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    hit = np.repeat(might_hold(repeated, least[first]), np.diff(np.r_[first, len(least)]))
    at = np.flatnonzero(hit & inside)
    return at, windows(words, size, 35)[at] if len(at) else np.zeros(0, dtype=np.uint64)


def text_id(text: str) -> int:
    """64 bits that address a text by its content (used with its number of words)."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _texts(b: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def _anchors(docs: DataFrame, size: int) -> DataFrame:
    """``anchor`` of every hash that is an anchor in two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text"):
            h, n = np.unique(anchor_places(*batch_hashes(_texts(b), lower=False), size), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])

    counts = docs.select("text").mapInArrow(run, "anchor long, n long")
    return keep_table(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "sub-anchors")


def _candidates(docs: DataFrame, size: int, repeated: np.ndarray) -> DataFrame:
    """``tid, n, copies, pos, hash``: the candidate windows of each distinct text."""
    held = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text"):
            texts = _texts(b)
            words, lengths = batch_hashes(texts, lower=False)
            at, hashes = candidate_windows(words, lengths, size, held.value)
            start = np.cumsum(lengths) - lengths
            own = np.searchsorted(start, at, side="right") - 1
            # texts without words start where the next one does: the last of equal starts is the one with words
            some, first = np.unique(own, return_index=True)
            cuts = pa.array(np.r_[first, len(at)].astype(np.int32))
            yield pa.record_batch([
                pa.array([text_id(texts[i]) for i in some.tolist()], pa.int64()), pa.array(lengths[some]),
                pa.ListArray.from_arrays(cuts, pa.array((at - start[own]).astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(hashes.view(np.int64)))], names=["tid", "n", "pos", "hash"])

    rows = docs.select("text").mapInArrow(run, "tid long, n long, pos array<int>, hash array<long>")
    return keep_table(rows.groupBy("tid", "n").agg(F.first("pos").alias("pos"), F.first("hash").alias("hash"),
                                                   F.count(F.lit(1)).alias("copies")), "sub-candidates")


def _runs(candidates: DataFrame, size: int) -> DataFrame:
    """``tid, n, start, end, owner, owner_start``: maximal runs of repeated windows as word spans, each with the
    place of the reference it equals (its own place: it is reference, or repeated by copies of the text)."""
    each = candidates.select("tid", "n", "copies", F.explode(F.arrays_zip("pos", "hash")).alias("w")).select(
        "tid", "n", "copies", "w.pos", "w.hash")
    owners = (each.groupBy("hash").agg(F.min(F.struct("tid", "pos")).alias("owner"), F.sum("copies").alias("places"))
              .where("places > 1"))
    pointed = (each.join(owners, "hash").select(
        "tid", "n", "pos", F.col("owner.tid").alias("owner"), F.col("owner.pos").alias("owner_pos"),
        (F.col("copies") > 1).cast("int").alias("copied")).repartition("tid", "n").sortWithinPartitions("tid", "n", "pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tid, n, pos, owner, at, copied = (b.column(i).to_numpy() for i in range(6))
            cut = np.r_[True, (tid[1:] != tid[:-1]) | (n[1:] != n[:-1]) | (owner[1:] != owner[:-1])
                        | (pos[1:] != pos[:-1] + 1) | (at[1:] != at[:-1] + 1)]
            s = np.flatnonzero(cut)
            e = np.r_[s[1:], len(tid)] - 1
            yield pa.record_batch([pa.array(tid[s]), pa.array(n[s]), pa.array(pos[s]), pa.array(pos[e] + size),
                                   pa.array(owner[s]), pa.array(at[s]), pa.array(copied[s])],
                                  names=["tid", "n", "start", "end", "owner", "owner_start", "copied"])

    return keep_table(pointed.mapInArrow(
        run, "tid long, n long, start int, end int, owner long, owner_start int, copied int"), "sub-runs")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``tid, text`` of the distinct texts whose id is in ``wanted`` (tid)."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "tid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text"):
            texts = _texts(b)
            tid = np.array([text_id(t) for t in texts], dtype=np.int64)
            ok = np.flatnonzero(might_hold(held.value, tid))
            yield pa.record_batch([pa.array(tid[ok]), pa.array([texts[i] for i in ok.tolist()], pa.string())],
                                  names=["tid", "text"])

    found = docs.select("text").mapInArrow(run, "tid long, text string")
    return found.join(wanted, "tid", "left_semi").dropDuplicates(["tid"])


def _proven(docs: DataFrame, runs: DataFrame, size: int, shard_runs: int) -> DataFrame:
    """``tid, start, end``: spans proven by suffix automata, of the runs and of the passages they match."""
    own = (F.col("tid") == F.col("owner")) & (F.col("start") == F.col("owner_start"))
    pointing = runs.where(~own)
    shards = keep_table(pointing.groupBy(F.col("owner").alias("shard"))
                        .agg(F.ceil(F.count(F.lit(1)) / shard_runs).cast("int").alias("splits")), "sub-shards")
    salt = F.pmod(F.xxhash64("tid", "start"), F.col("splits")).cast("int")
    asks = (pointing.join(shards, F.col("owner") == F.col("shard"))
            .select("tid", "shard", salt.alias("salt"), F.lit(1).alias("role"), "start", "end", "owner_start"))
    passages = (runs.where(own).join(shards, F.col("tid") == F.col("shard"))
                .select("tid", "shard", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"),
                        F.lit(0).alias("role"), "start", "end", "owner_start"))
    spans = asks.unionByName(passages).groupBy("tid").agg(F.collect_list(F.struct(
        "shard", "salt", "role", "start", "end", "owner_start")).alias("spans"))
    spans = keep_table(spans, "sub-streams")
    texts = _with_text(docs, spans.select("tid"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text", most_rows=64):
            for tid, text, spans in zip(b.column("tid").to_pylist(), b.column("text"), b.column("spans").to_pylist()):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                yield pa.RecordBatch.from_pylist(
                    [{"shard": s["shard"], "salt": s["salt"], "role": s["role"], "tid": tid, "start": s["start"],
                      "owner_start": s["owner_start"], "words": b" ".join(words[s["start"]:s["end"]])} for s in spans], cuts)

    cuts = pa.schema([("shard", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("tid", pa.int64()),
                      ("start", pa.int32()), ("owner_start", pa.int32()), ("words", pa.binary())])
    order = ["shard", "salt", "role", "tid", "start"]
    streams = (spans.join(texts, "tid").mapInArrow(
        cut, "shard long, salt int, role int, tid long, start int, owner_start int, words binary")
        .repartition("shard", "salt").sortWithinPartitions(*order))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passages, automaton = None, [], None
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for row in b.to_pylist():
                if (row["shard"], row["salt"]) != key:
                    key, passages, automaton = (row["shard"], row["salt"]), [], None
                words = row["words"].split()
                if row["role"] == 0:
                    passages.append(words)
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton(passages)
                for s, e in covered(automaton.statistics(words), size):
                    out.append((row["tid"], row["start"] + s, row["start"] + e))
                    out.append((row["shard"], row["owner_start"] + s, row["owner_start"] + e))
            if out:
                tid, s, e = zip(*out)
                yield pa.record_batch([pa.array(tid, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())],
                                      names=["tid", "start", "end"])

    proven = streams.mapInArrow(match, "tid long, start int, end int")
    return proven.unionByName(runs.where("copied = 1").select("tid", "start", "end"))


def covered(statistics: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of ``size`` words or more."""
    spans: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= size:
            s = i + 1 - n
            if spans and s <= spans[-1][1]:
                spans[-1] = (min(s, spans[-1][0]), i + 1)
            else:
                spans.append((s, i + 1))
    return spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 35,
                   shard_runs: int = 4096) -> DataFrame:
    """``id, n_words, n_removed, kept`` (the kept words joined by one blank) for every row."""
    d = ready(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = bitmap(_anchors(d, size), "anchor")
    runs = _runs(_candidates(d, size, repeated), size)
    proven = _proven(d, runs, size, shard_runs)
    spans = keep_table(proven.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "sub-spans")
    held = d.sparkSession.sparkContext.broadcast(bitmap(spans, "tid"))
    id_type = d.schema["id"].dataType.simpleString()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text"):
            n, kept = [], []
            texts = _texts(b)
            tid = np.array([text_id(t) for t in texts], dtype=np.int64)
            affected = might_hold(held.value, tid)
            for t, hit in zip(texts, affected.tolist()):
                words = t.encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                kept.append(b" ".join(words))
            tids = pa.array(tid, mask=~affected)
            yield pa.record_batch([b.column(0), tids, pa.array(n, pa.int64()), pa.array(kept, pa.binary())],
                                  names=["id", "tid", "n_words", "kept"])

    rows = d.mapInArrow(untouched, f"id {id_type}, tid long, n_words long, kept binary")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "kept"):
            kept, gone = [], []
            for text, spans in zip(b.column("kept"), b.column("spans")):
                words = text.as_py().split()
                keep = np.ones(len(words), dtype=bool)
                for s in spans.as_py() or ():
                    keep[s["start"]:s["end"]] = False
                kept.append(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]))
                gone.append(int(len(words) - keep.sum()))
            yield pa.record_batch([b.column("id"), b.column("n_words"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                                  names=["id", "n_words", "n_removed", "kept"])

    schema = f"id {id_type}, n_words long, n_removed long, kept binary"
    touched = rows.where("tid is not null").join(spans, "tid", "left").select("id", "n_words", "kept", "spans")
    done = rows.where("tid is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept").unionByName(
        touched.mapInArrow(remove, schema))
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
