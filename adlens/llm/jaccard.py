"""N-gram Jaccard join by parity sketches (operator 1).

A text's set of word shingles is hashed to 64-bit numbers and dealt by value
into the parts of a sketch; a part's symbol is the XOR of its numbers. Two
sketches differ in at most as many parts as the sets have elements in their symmetric
difference, and Jaccard >= t bounds that difference by
``D = floor((1 - t) / t * size)`` for either set. Hence pigeonhole: of the first
``D + 1`` non-empty parts of the set that gets there first, one must agree,
so each text emits the symbols of its first ``D + 1`` non-empty parts as join
keys. Sketch lengths are fixed per size band (bands grow by the square root of
two); a text whose partners may lie in the next band emits there as well.

A key that more than ``hot`` texts have (a passage that many documents share) is
no use: texts skip such parts and emit their first ``D + 1`` other non-empty ones,
for which the same argument holds. A text that has too few others (a member
of a large group of near copies) emits all of them and, in a family of keys that
only such texts join on, its first ``D + 1`` parts of any kind; two texts of which
one has enough others agree in one of its others, two that have not meet in the family.

Candidates are verified: by size, by the Hamming distance of 2048-bit
parity sketches (again a lower bound of the difference), then by exact
intersection of the shingle sets.

No group is expanded into all its pairs. Equal sets are one class first. Of
the texts that share a key, each is paired with the smallest, then, where
components still differ, with the next in an order that is hashed anew for each key; what these
links connect needs no further test. In groups that still hold several components,
members of different components are compared: in small groups as pairs, in groups above
``hot`` block by block in numpy, first by bit sketches alone (2,048, then 16,384 bits), then, for members that
may link, by their sets, emitting only links that connect. Keys that occur once are dropped after a map-side-combined aggregate, and a bounded bitmap of
the others keeps the rest out of the joins.

Shingles of A-Z lower-cased words; a text with fewer words than a shingle is
one shingle; without words the set is empty and links with nothing. (A set that
falls into fewer than ``D + 1`` parts could miss a partner; for thresholds
from 0.8 the number of parts keeps the chance of that below 1e-8 at every size.)

Defined results: null texts have an empty set; of rows that share an id, each
has the component of its own text (sets whose smallest id is the same are one
node); a null id takes no part (component null); an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.bloom import bitmap, might_hold
from adlens.llm.common import by_size, drop_table, keep_table, ready, sorted_groups
from adlens.llm.components import components
from adlens.llm.words import mix, windows, word_hashes

_U = np.uint64


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = word_hashes(text or "")
    if 0 < len(w) < words:
        return windows(w, len(w), 101)
    return np.unique(windows(w, words, 101))


def band(size: int) -> int:
    return (size * size).bit_length() - 1


@cache
def parts_of(band_no: int, percent: int) -> int:
    """Parts of a band's sketches: as few as leave the largest sets of the band, in the
    mean, a fiftieth more non-empty parts than they need, and 8 more; many for small sets."""
    top = 2 ** ((band_no + 1) / 2)
    if top <= 16.1:
        return 4096 if top <= 8.1 else 64
    share = min(0.99, 1.02 * (100 - percent) / percent)
    low, high = 1e-3, 1e3  # elements per part; the non-empty share of parts per element falls with it
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - math.exp(-mid)) / mid >= share else (low, mid)
    return int(top / low) + 8


def needed(n: int, percent: int) -> int:
    """Parts of which one must agree."""
    return (100 - percent) * n // percent + 1


def part_keys(shingles: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys of the non-empty parts of a sorted shingle set, in order: a list per band in which it may meet partners."""
    n = len(shingles)
    symbols = mix(shingles, 7)
    keys = []
    for b in range(band(n), band(n * 100 // percent) + 1):
        part = ((shingles >> _U(32)) * _U(parts_of(b, percent))) >> _U(32)  # ascending, as the shingles are
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        xor = np.bitwise_xor.reduceat(symbols, first)
        keys.append(mix(xor + part[first] * _U(0x9E3779B97F4A7C15), b))
    return keys


def bit_sketch(shingles: np.ndarray, bits: int = 2048) -> np.ndarray:
    """Parity of the number of shingles at each of ``bits`` places, as signed 64-bit words."""
    odd = (np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def folded(sketch: Column, words: int = 8) -> Column:
    """A bit sketch folded to ``words`` words: the parity sketch of as many places."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(
        F.filter(sketch, lambda _, at: at % words == i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x)))


def features(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, s1, s2, sketch, keys, sizes`` of ``docs`` (id, text); s1 and s2 identify the set,
    sizes are the lengths of the lists that make up keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "text"):
            sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
            s1 = [int(mix(s, 11).sum().view(np.int64)) if len(s) else None for s in sets]
            s2 = [int(np.bitwise_xor.reduce(mix(s, 13)).view(np.int64)) if len(s) else None for s in sets]
            keys = [part_keys(s, percent) if len(s) else [] for s in sets]
            yield pa.record_batch([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()),
                pa.array(s2, pa.int64()),
                pa.array([bit_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([np.concatenate(k).view(np.int64) if k else None for k in keys], pa.list_(pa.int64())),
                pa.array([[len(x) for x in k] for k in keys], pa.list_(pa.int32()))],
                names=["id", "n", "s1", "s2", "sketch", "keys", "sizes"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, sketch array<long>, keys array<long>, sizes array<int>")


def _of_representatives(feats: DataFrame, reps: DataFrame) -> DataFrame:
    """``id, keys`` of the representatives. Only rows that a bitmap of the others' ids flags go through the join."""
    cols = ["id", "s1", "s2"]
    others = keep_table(feats.select(cols).join(reps, cols, "left_anti").select("id"), "jaccard-others")
    held = feats.sparkSession.sparkContext.broadcast(bitmap(others, "id"))

    def part(flagged: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(might_hold(held.value, b.column("id").to_numpy()) == flagged))
        return feats.select(*cols, "keys").mapInArrow(run, "id long, s1 long, s2 long, keys array<long>")

    return part(False).select("id", "keys").unionByName(part(True).join(reps, cols, "left_semi").select("id", "keys"))


def _members(feats: DataFrame, reps: DataFrame, percent: int, hot: int) -> DataFrame:
    """``family, key, id, n, size, low, low_n``: texts that share a key they emit, their number, and the one
    with the smallest id."""
    cols = ["id", "s1", "s2"]
    reps = reps.select(F.col("rep").alias("id"), "s1", "s2")
    shared = keep_table(_of_representatives(feats, reps).select("id", F.explode("keys").alias("key"))
                        .groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
                        .select("key", (F.col("texts") > hot).alias("hot")), "jaccard-keys")
    held = feats.sparkSession.sparkContext.broadcast(bitmap(shared, "key"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, sizes = b.column("keys"), b.column("sizes")
            keys, lengths = lists.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(sizes.offsets.to_numpy()))  # of each list
            start = np.cumsum(lengths) - lengths
            at = np.repeat(np.arange(len(lengths)), lengths)  # list of each key
            ok = np.flatnonzero(might_hold(held.value, keys))
            own = at[ok]
            first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
            no = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
            yield pa.record_batch([pa.array(keys[ok]), *(b.column(c).take(pa.array(row[own])) for c in ("id", "n", "s1", "s2")),
                                   pa.array(no[own].astype(np.int32)), pa.array((ok - start[own]).astype(np.int32)),
                                   pa.array(lengths[own].astype(np.int32))],
                                  names=["key", "id", "n", "s1", "s2", "list", "place", "parts"])

    likely = feats.select(*cols, "n", "keys", "sizes").mapInArrow(
        passing, "key long, id long, n long, s1 long, s2 long, list int, place int, parts int")
    # rows that repeat an id and its text only make the counts of hot parts larger, and so the lists longer
    rows = likely.join(shared, "key").join(reps, cols, "left_semi")
    of_list = Window.partitionBy(*cols, "list")
    is_hot = F.col("hot").cast("int")
    need = F.floor(F.lit(100 - percent) * F.col("n") / percent) + 1
    placed = (rows.withColumn("need", need)
              .withColumn("before", F.sum(is_hot).over(of_list.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("short", F.col("parts") - F.sum(is_hot).over(of_list) < F.col("need")))
    family = F.filter(F.array(
        F.when(~F.col("hot") & (F.col("place") - F.col("before") < F.col("need")), F.lit(0)),
        F.when(F.col("short") & (F.col("place") < F.col("need")), F.lit(1))), lambda x: x.isNotNull())
    emitted = keep_table(placed.select(F.explode(family).alias("family"), "key", "id", "n").distinct(), "jaccard-emitted")
    groups = (emitted.groupBy("family", "key").agg(F.min(F.struct("id", "n")).alias("low"), F.count(F.lit(1)).alias("size"))
              .where("size > 1").select("family", "key", "size", F.col("low.id").alias("low"), F.col("low.n").alias("low_n")))
    return keep_table(emitted.join(groups, ["family", "key"]), "jaccard-members")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` of the texts whose id is in ``ids`` (distinct)."""
    ids = keep_table(ids, "jaccard-ids")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            chosen = whole.filter(pa.array(might_hold(held.value, whole.column(0).to_numpy())))
            for b in by_size([chosen], "text"):
                sets = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column(1)]
                yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return keep_table(docs.mapInArrow(run, "id long, shingles array<long>").join(ids, "id", "left_semi"), "jaccard-sets")


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in df.columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _pruned(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bit sketches (id, n, sketch) allow a link."""
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda acc, x: acc + x)
    return (pairs.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b")
            .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                   & (apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))
            .select("a", "b"))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bit sketches, first folded, then whole, allow a link, stored."""
    near = _pruned(pairs.distinct(), sketches.select("id", "n", F.col("small").alias("sketch")), percent)
    return keep_table(_pruned(near, sketches.select("id", "n", "sketch"), percent), "jaccard-near")


def _wide(sets: DataFrame, bits: int = 1 << 14) -> DataFrame:
    """``id, n, sketch``: wide bit sketches, which still tell sets of tens of thousands of shingles apart, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                own = [np.asarray(s.values).view(_U) for s in b.column("shingles")]
                yield pa.record_batch([b.column("id"), pa.array([len(s) for s in own], pa.int64()),
                                       pa.array([bit_sketch(s, bits) for s in own], pa.list_(pa.int64()))],
                                      names=["id", "n", "sketch"])

    return keep_table(sets.mapInArrow(run, "id long, n long, sketch array<long>"), "jaccard-wide")


def _linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that link, stored."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    sizes = F.size("shingles_a") + F.size("shingles_b")
    return keep_table(near.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
                      .where(100 * common >= percent * (sizes - common)).select("a", "b").distinct(), "jaccard-links")


def may_link(comps: np.ndarray, sketches: np.ndarray, n: np.ndarray, side: np.ndarray | None,
             percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of one group, each once, that are in different components and may link,
    by sizes and bit sketches; a few rows at a time. ``side``: only pairs across count."""
    left = np.arange(len(n)) if side is None else np.flatnonzero(~side)
    right = left if side is None else np.flatnonzero(side)
    for at in range(0, len(left), 256):
        i = left[at:at + 256]
        apart = np.zeros((len(i), len(right)), dtype=np.int64)
        for w in range(sketches.shape[1]):
            apart += np.bitwise_count(sketches[i, w][:, None] ^ sketches[right, w][None, :])
        sums, small = n[i][:, None] + n[right][None, :], np.minimum(n[i][:, None], n[right][None, :])
        maybe = (apart * (100 + percent) <= (100 - percent) * sums) & (100 * small >= percent * (sums - small))
        maybe &= comps[i][:, None] != comps[right][None, :]
        if side is None:
            maybe &= i[:, None] < right[None, :]
        x, y = np.nonzero(maybe)
        yield i[x], right[y]


def connecting_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], pairs: Iterable, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs that connect their components."""
    root = {int(c): int(c) for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[max(a, b)] = min(a, b)
                    links.append((int(ids[i]), int(ids[j])))
    return links


_GROUP = ["family", "key"]
_TASK = [*_GROUP, "x", "y"]


def _block_pairs(groups: DataFrame, block: int) -> DataFrame:
    """``groups`` (family, key, size, id, comp) with a row for each pair of blocks of its group that a member is in."""
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("id"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(
        F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"), (mine > j).alias("side")))
    return (groups.select(*_GROUP, "id", "comp", F.explode(pairs).alias("t"))
            .select(*_GROUP, "t.x", "t.y", "t.side", "id", "comp"))


def _task_columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    across = t.column("x")[0].as_py() != t.column("y")[0].as_py()
    sketches = np.stack([np.asarray(s.values) for s in t.column("sketch")]).view(_U)
    return t.column("comp").to_numpy(), sketches, t.column("n").to_numpy(), np.asarray(t.column("side")) if across else None


def _links_in_large_groups(groups: DataFrame, sketches: DataFrame, percent: int, block: int, sets_of) -> DataFrame:
    """``a, b``: links that connect components within ``groups``, block pair by block pair.
    ``sets_of``: the stored shingle sets of the given ids."""

    def dealt(tasks: DataFrame) -> DataFrame:
        return tasks.repartition(*_TASK).sortWithinPartitions(*_TASK)

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, _TASK):
            some = np.zeros(t.num_rows, dtype=bool)
            for i, j in may_link(*_task_columns(t), percent):
                some[i] = some[j] = True
            yield from t.select([*_TASK, "side", "id", "comp"]).filter(pa.array(some)).combine_chunks().to_batches()

    schema = "family int, key long, x long, y long, side boolean, id long, comp long"
    sketches = sketches.select("id", "n", "sketch")
    tasks = keep_table(dealt(_block_pairs(groups, block).join(sketches, "id")).mapInArrow(hopeful, schema), "jaccard-hopeful")
    sets = sets_of(tasks.select("id").distinct())
    sketches = _wide(sets)
    tasks = keep_table(dealt(tasks.join(sketches, "id")).mapInArrow(hopeful, schema), "jaccard-hopeful")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, _TASK):
            comps, sk, n, side = _task_columns(t)
            found = connecting_links(t.column("id").to_numpy(), comps, [np.asarray(s.values) for s in t.column("shingles")],
                                     may_link(comps, sk, n, side, percent), percent)
            if found:
                a, b = zip(*found)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return keep_table(dealt(tasks.join(sketches, "id").join(sets, "id")).mapInArrow(compare, "a long, b long"), "jaccard-links")


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, with ``comp``, of those groups that the links leave in several components, stored."""
    comps = components(links)
    now = (members.join(comps, members["id"] == comps["node"], "left")
           .withColumn("comp", F.coalesce("component", "id")).drop("node", "component"))
    mixed = (now.groupBy(*_GROUP).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
             .where("c0 < c1").select(*_GROUP))
    return keep_table(now.join(mixed, _GROUP, "left_semi"), "jaccard-mixed")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       percent: int = 85, hot: int = 16, block: int = 2048) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``."""
    d = ready(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = keep_table(features(d, words, percent), "jaccard-features")
    sized = feats.where("n > 0 and id is not null")
    reps = keep_table(sized.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "jaccard-classes")
    members = _members(sized, reps, percent, hot)
    ided = d.where("id is not null")
    sized_rows = keep_table(feats.select("id", "n", "s1", "s2"), "jaccard-rows")
    sketches = keep_table(sized.select("id", "n", "sketch", folded(F.col("sketch")).alias("small")).join(members.select("id").distinct(), "id", "left_semi")
                          .distinct(), "jaccard-sketches")
    drop_table(feats)  # the wide table is done with

    def sets_of(ids: DataFrame) -> DataFrame:
        return _sets(ided, ids, words)

    def linked(pairs: DataFrame, wide: bool = True) -> DataFrame:
        near = _near(pairs, sketches, percent)
        sets = sets_of(_ends(near))
        found = _linked(_pruned(near, _wide(sets), percent) if wide else near, sets, percent)
        drop_table(sets)
        return found

    alike = 100 * F.least("n", "low_n") >= percent * F.greatest("n", "low_n")
    links = linked(members.where(F.col("id") > F.col("low")).where(alike).select(F.col("low").alias("a"), F.col("id").alias("b")), wide=False)
    mixed = _mixed(members.where("size > 2"), links)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / 4096))
    chain = Window.partitionBy(*_GROUP, "part").orderBy(F.xxhash64("id", "key"))
    follows = (mixed.withColumn("part", part).withColumn("b", F.lead("id").over(chain))
               .withColumn("comp_b", F.lead("comp").over(chain)).withColumn("low_n", F.lead("n").over(chain))
               .where("comp <> comp_b").where(alike)
               .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")))
    links = links.unionByName(linked(follows))
    mixed = _mixed(mixed.drop("comp"), links)
    small, large = mixed.where(F.col("size") <= hot), mixed.where(F.col("size") > hot)
    centre = small.select(*_GROUP, F.col("id").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"))
    pairs = small.join(centre, _GROUP).where(
        (F.col("id") > F.col("a")) & (F.col("comp") != F.col("comp_a"))
        & (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))).select("a", F.col("id").alias("b"))
    links = links.unionByName(linked(pairs)).unionByName(
        _links_in_large_groups(large, sketches, percent, block, sets_of))
    comps = components(links)
    named = keep_table(reps.join(comps, F.col("rep") == F.col("node"), "left")
                       .select("n", "s1", "s2", F.coalesce("component", "rep").alias("component")), "jaccard-named")
    rows = sized_rows.join(named, ["n", "s1", "s2"], "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                       F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
