"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import adlens
from adlens.session import checkpoint_dir
from adlens.sources.storage import drop_table, keep_table, write_file

#: ASCII white space that separates words: blank, tab, line feed, vertical tab,
#: form feed and carriage return (``bytes.split()`` splits on exactly these).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Unless the session says otherwise: texts are long, and a batch is held by the JVM and by Python.
ARROW_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
_SHIPPED: set[str] = set()


def ready(df: DataFrame) -> DataFrame:
    """``df``, after its application's Python workers have been given this package and
    the session a size of Arrow batches (if it has none of its own)."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root, packed = Path(adlens.__file__).parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        path = f"{checkpoint_dir(spark).rstrip('/')}/adlens-{app}.zip"
        write_file(spark, path, packed.getvalue())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    if spark.conf.get(ARROW_BATCH_BYTES[0], None) is None:
        spark.conf.set(*ARROW_BATCH_BYTES)
    return df


def id_crc(id_col: str) -> F.Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def keep_memory() -> None:
    """Let a Python worker keep up to 32 MB of freed memory for its next arrays (until ``release_memory``): where
    arrays of some 100 KB come and go, asking the machine for their pages anew costs as much as the work on them."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)  # of glibc
    if option:
        option(-3, 4 << 20)   # M_MMAP_THRESHOLD
        option(-1, 32 << 20)  # M_TRIM_THRESHOLD


def release_memory() -> None:
    """Give a Python worker's freed memory back to the machine: idle workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def by_size(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 21,
            most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of bounded size: of ``most_rows`` rows and about ``most_bytes`` bytes of
    the text or binary ``column`` at most; a longer value is a slice of its own."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy())
        at, done = 0, 0
        while at < b.num_rows:
            end = min(max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right"))), at + most_rows)
            yield b.slice(at, end - at)
            at, done = end, int(ends[end - 1])
    release_memory()


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition that is sorted by them, one table each."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = np.stack([t.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:]):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, z - a))
            last = key
    if held:
        yield pa.concat_tables(held)
    del held
    release_memory()


__all__ = ["WORD", "by_size", "drop_table", "id_crc", "keep_memory", "keep_table", "read", "ready", "sorted_groups"]
