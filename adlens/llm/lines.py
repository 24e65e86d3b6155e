"""Line dedup over levelled sorted runs of line hashes (operator 13).

A line's key is the line without blank, tab, line feed, vertical tab, form feed
and carriage return at both ends, A-Z lower-cased; only keys of ``min_chars``
code points or more count. ``LineRuns`` holds one row per key that has been seen:
its 128-bit hash and its owner, the document that keeps the line. The rows lie in
runs: tables bucketed and sorted by the hash. A batch of documents is reduced
to one row per key, merge-joined with the runs bucket by bucket (the runs
are not shuffled again), and written as a run, in which the keys of older runs are marked. A level that has
``fanout`` runs is merged into one run of the next level before the next batch.

``dedup_lines`` adds a table in ``batches`` ranges of ascending ids, so that a key's owner
is the smallest id that holds it. Only hashes and positions of lines travel
with the keys; texts are read twice and shuffled once. Hot lines: a
key's rows are pre-aggregated before the shuffle; the marks of keys that hold more
than a thousandth of a batch's lines (fewer than 1,000 keys, by counting) are
broadcast, the others are joined by hash.

Defined results: a null or empty text is one empty line; rows that share an id
are one document for ownership, and each gets a row; rows without an id are one document that
comes after all others of its batch; a key in one document alone stays,
however often it occurs there; an empty table gives an empty table; other columns are
ignored. A document that an earlier ``add`` has seen keeps the lines it owns. Equal
hashes of different keys would be one key: at 10**12 lines the chance is below 1e-14.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.llm.common import keep_table
from adlens.sources.storage import delete, table_path

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]
_TEXT = ["id", "t1", "t2"]
HOT_SHARE = 1000


def _hashes(col, a: str, b: str) -> list:
    """128 bits: two 64-bit hashes that start from different seeds."""
    return [F.xxhash64(F.lit(1), col).alias(a), F.xxhash64(F.lit(2), col).alias(b)]


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its id, the hash of its text and its lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), *_hashes(text, "t1", "t2"), F.split(text, "\n", -1).alias("lines"))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``id, t1, t2`` (the text's hash), ``pos, h1, h2`` of every line whose key counts."""
    bare = F.btrim(F.col("line"), F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    key = F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))
    each = _split(docs, id_col, text_col).select(*_TEXT, F.posexplode("lines").alias("pos", "line"))
    return each.where(F.char_length(bare) >= min_chars).select(*_TEXT, "pos", *_hashes(key, *_KEY))


class LineRuns:
    """The keys seen so far, as levelled runs in the shared folder.

    A batch's table of keys is its run: it is written as the aggregate and the merge joins leave it,
    dealt by the hash, and marks the keys that older runs hold already (``seen``)."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, keys: DataFrame) -> str:
        name = f"adlens_lines_{uuid.uuid4().hex[:12]}"
        (keys.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", table_path(self.spark, name)).saveAsTable(name))
        return name

    def _run(self, name: str) -> DataFrame:
        """The keys that the run owns."""
        return self.spark.table(name).where("not seen").select(*_KEY, "owner")

    def compact(self) -> None:
        """Merge every full level into one run of the next level (keys of runs are disjoint)."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) < self.fanout:
                continue
            merged = reduce(DataFrame.unionByName, map(self._run, self.levels[i]))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(
                merged.groupBy(*_KEY).agg(F.min("owner").alias("owner")).withColumn("seen", F.lit(False))))
            for name in self.levels[i]:
                self._forget(name)
            self.levels[i] = []

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, table_path(self.spark, name))

    def close(self) -> None:
        """Remove all runs."""
        for name in sum(self.levels, []):
            self._forget(name)
        self.levels = [[]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``line_rows``; returns ``id, t1, t2, pos`` of its lines that go (stored)."""
        self.compact()
        keys = lines.groupBy(*_KEY).agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("id").isNull()).alias("without_id"))
        held = F.lit(None).cast(dict(lines.dtypes)["id"])
        seen = F.lit(False)
        for name in sum(self.levels, []):  # merge joins: both sides are dealt by the hash already
            run = self._run(name).select(*_KEY, F.col("owner").alias(f"o_{name}"), F.lit(True).alias(f"s_{name}"))
            keys = keys.join(run, _KEY, "left")
            held, seen = F.coalesce(held, f"o_{name}"), seen | F.coalesce(f"s_{name}", F.lit(False))
        several = (F.col("first") < F.col("last")) | (F.col("first").isNotNull() & (F.col("without_id") > 0))
        name = self._write(keys.select(*_KEY, "n", seen.alias("seen"), F.coalesce(several, F.lit(False)).alias("several"),
                                       F.when(seen, held).otherwise(F.col("first")).alias("owner")))
        self.levels[0].append(name)
        marks = self.spark.table(name).where("seen or several")
        frequent = F.col("n") * HOT_SHARE > lines.count()
        hot = F.broadcast(marks.where(frequent).select(*_KEY, "owner", F.lit(True).alias("hot")))
        tried = lines.join(hot, _KEY, "left")
        goes = ~F.col("id").eqNullSafe(F.col("owner"))
        cold = (tried.where("hot is null").drop("owner", "hot")
                .join(marks.where(~frequent).select(*_KEY, "owner"), _KEY))
        out = [*_TEXT, "pos"]
        return keep_table(tried.where(F.col("hot") & goes).select(out).unionByName(cold.where(goes).select(out)), "line-drops")


def _starts(docs: DataFrame, id_col: str, batches: int) -> list:
    """The smallest ids of ``batches`` ranges of about as many rows (numbers), or of about as many ids as
    Spark's range partitioning cuts them (other types)."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    if isinstance(ids.schema["id"].dataType, T.NumericType):
        at = F.percentile_approx("id", [i / batches for i in range(batches)], 1000)  # a bounded summary per task
        return sorted(set(ids.agg(at.alias("at")).first().at or []))[1:]
    cuts = (ids.distinct().repartitionByRange(batches, "id").groupBy(F.spark_partition_id().alias("part"))
            .agg(F.min("id").alias("id")).collect())  # a row per partition
    return sorted(r.id for r in cuts)[1:]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                batches: int = 3, fanout: int = 2) -> DataFrame:
    """``id_col, n_lines, n_dropped, kept`` for every row of ``docs``; ``kept`` is the text that stays."""
    spark = docs.sparkSession
    starts = _starts(docs, id_col, batches)
    batch = F.lit(0)
    for s in starts:
        batch = batch + F.when(F.col("id").isNull() | (F.col("id") >= F.lit(s)), 1).otherwise(0)
    lines = keep_table(line_rows(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines", ["batch"])
    runs = LineRuns(spark, fanout)
    gone = [runs.add(lines.where(F.col("batch") == b).drop("batch")) for b in range(len(starts) + 1)]
    runs.close()
    dropped = gone[0]
    for g in gone[1:]:
        dropped = dropped.unionByName(g)
    # a set: rows that repeat id and text name the same positions; it is no longer than the text
    places = keep_table(dropped.groupBy(*_TEXT).agg(F.collect_set("pos").alias("gone")), "line-places")
    left = _split(docs, id_col, text_col).alias("d")
    same = (F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.t1") == F.col("p.t1")) & (F.col("d.t2") == F.col("p.t2")))
    both = left.join(places.alias("p"), same, "left").select("d.id", "lines", "gone")
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay), "\n")
    return both.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
