"""Tables that are written once and read again, in the shared checkpoint folder.

Everything goes through Spark's readers and writers and the Hadoop file
system of the path, so the folder can be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from adlens.session import checkpoint_dir

FOLDER = "adlens-tables"    # intermediates: a folder per application
RESULTS = "adlens-results"  # what sinks and daily tables hold; never swept
LEASE_FILE = "_lease.json"
LEASE_SECONDS = 2 * 86400   # of an application's folder, renewed while it stores tables
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # paths of the tables that keep_table returned
_HELD: Counter[str] = Counter()       # references to stored tables by results that still read them
_LEASES: dict[str, float] = {}        # when the lease of a folder ends


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def fingerprint(spark: SparkSession, path: str) -> list[str]:
    """Name, length and modification time of the file or of every file of the folder at ``path``."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return [f"{path}:absent"]
    return sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(p))


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file, replacing one that is there."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


def create_file(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a small file; False (and no change) if there is one already. Content that is seen is whole:
    the file is written beside its place and renamed to it."""
    written = f"{path}.{uuid.uuid4().hex}"
    write_file(spark, written, content)
    return publish(spark, written, path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in the folder ``path``; none if it is absent."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove the file or the folder with all that is in it."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file, or None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def publish(spark: SparkSession, written: str, final: str) -> bool:
    """Rename a finished table or file to its final path; False if another copy was first."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    source, _ = _path(spark, written)
    target, fs = _path(spark, final)
    fs.mkdirs(target.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(target), no_options)
        return True
    except Exception:
        if fs.exists(target):
            fs.delete(source, True)
            return False
        raise


def swap(spark: SparkSession, written: str, final: str) -> None:
    """Put the finished folder ``written`` in the place of ``final``, which is put aside first and
    removed last; between the two renames there is no table, and a failed one brings the old table back."""
    if not exists(spark, final):
        publish(spark, written, final)
        return
    aside = f"{final}-{uuid.uuid4().hex[:12]}"
    publish(spark, final, aside)
    try:
        if not publish(spark, written, final):
            raise RuntimeError(f"{final} was written by another application meanwhile")
    except Exception:
        if not exists(spark, final):
            publish(spark, aside, final)
        raise
    delete(spark, aside)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{FOLDER}/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A path in this application's folder of intermediates, whose lease is renewed when it is half over."""
    folder, now = _folder(spark), time.time()
    if _LEASES.get(folder, 0) < now + LEASE_SECONDS / 2:
        write_file(spark, f"{folder}/{LEASE_FILE}", json.dumps({"until": now + LEASE_SECONDS}).encode())
        _LEASES[folder] = now + LEASE_SECONDS
    return f"{folder}/{name}"


def result_path(spark: SparkSession, kind: str) -> str:
    """A new path for a result, outside the intermediates."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{RESULTS}/{kind}-{uuid.uuid4().hex[:12]}"


def keep_table(df: DataFrame, tag: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and return the stored table: cuts lineage, survives
    lost executors, and gives the optimizer the real size and columns to prune
    (and with ``partition_by`` the folders)."""
    spark = df.sparkSession
    path = table_path(spark, f"{tag}-{uuid.uuid4().hex[:12]}")
    df.write.partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


@contextmanager
def held(*stored: DataFrame) -> Iterator[None]:
    """While a result that reads these stored tables is written, they are not dropped (references are counted)."""
    paths = [_STORED[s] for s in stored]
    _HELD.update(paths)
    try:
        yield
    finally:
        _HELD.subtract(paths)


def drop_table(stored: DataFrame) -> bool:
    """Remove a table that ``keep_table`` returned; False (and no change) while a result holds it."""
    path = _STORED[stored]
    if _HELD[path] > 0:
        return False
    del _STORED[stored]
    delete(stored.sparkSession, path)
    return True


def drop_tables(spark: SparkSession) -> list[str]:
    """Remove the tables that this application has stored with ``keep_table``, but those that are held;
    the names of these are returned. Tables of other applications and results stay."""
    folder = _folder(spark)
    kept = [n for n in list_names(spark, folder) if _HELD[f"{folder}/{n}"] > 0]
    if kept:
        for n in set(list_names(spark, folder)) - {*kept, LEASE_FILE}:
            delete(spark, f"{folder}/{n}")
        return kept
    _LEASES.pop(folder, None)
    delete(spark, folder)
    parent = folder.rsplit("/", 1)[0]
    if not list_names(spark, parent):
        delete(spark, parent)
    return []


def sweep(spark: SparkSession) -> list[str]:
    """Remove the intermediates of applications whose lease is over (they ended without dropping them)."""
    parent, own = _folder(spark).rsplit("/", 1)
    over = []
    for name in list_names(spark, parent):
        lease = read_file(spark, f"{parent}/{name}/{LEASE_FILE}")
        if name != own and lease is not None and json.loads(lease)["until"] < time.time():
            delete(spark, f"{parent}/{name}")
            over.append(name)
    return over
