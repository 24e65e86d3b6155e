"""Stored tables: the shared folder, publication, keys, clean-up."""

import os

import pytest

from adlens import session
from adlens.sources import storage
from adlens.sources.fixtures import TestWarehouse
from conftest import SMOKE_DIR


def test_publish_keeps_the_first_copy(spark, tmp_path):
    for i in (1, 2):
        spark.range(i).write.parquet(f"{tmp_path}/copy{i}")
    assert storage.publish(spark, f"{tmp_path}/copy1", f"{tmp_path}/deep/final")
    assert not storage.publish(spark, f"file:{tmp_path}/copy2", f"file:{tmp_path}/deep/final")
    assert spark.read.parquet(f"{tmp_path}/deep/final").count() == 1
    assert not os.path.exists(f"{tmp_path}/copy2")


def test_second_use_reads_what_the_first_wrote(spark):
    one = TestWarehouse(spark, SMOKE_DIR)
    one.displays.count()
    path = f"{one.root}/delivery/_SUCCESS"
    before = storage.fingerprint(spark, path)
    assert TestWarehouse(spark, SMOKE_DIR).clicks.count() > 0
    assert storage.fingerprint(spark, path) == before


def test_changed_input_changes_the_key(spark, tmp_path):
    a = TestWarehouse(spark, str(tmp_path)).root
    spark.range(3).write.parquet(f"{tmp_path}/events.parquet")
    assert TestWarehouse(spark, str(tmp_path)).root != a


def test_shared_folder_is_required_off_a_local_master(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_one_stored_table_can_be_dropped(spark):
    one, two = storage.keep_table(spark.range(5), "t"), storage.keep_table(spark.range(6), "t")
    storage.drop_table(one)
    assert two.count() == 6
    with pytest.raises(KeyError):
        storage.drop_table(one)


def test_stored_tables_can_be_dropped(spark):
    kept = storage.keep_table(spark.range(5), "t")
    assert kept.count() == 5
    folder = f"{session.checkpoint_dir(spark)}/{storage.FOLDER}/{spark.sparkContext.applicationId}"
    assert storage.exists(spark, folder)
    storage.drop_tables(spark)
    assert not storage.exists(spark, folder)


def test_stored_tables_can_be_partitioned(spark):
    kept = storage.keep_table(spark.range(10).selectExpr("id", "id % 2 as part"), "t", ["part"])
    assert kept.where("part = 1").count() == 5 and len([f for f in kept.inputFiles() if "part=" in f]) > 0
    storage.drop_table(kept)
