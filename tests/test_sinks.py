import uuid

import pytest

from adlens.sources.sinks import create_table, export_csv, replace_table


def test_replace_create_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    replace_table(df, f"{tmp_path}/t", partition_by=["y"])
    replace_table(df.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    create_table(df, f"{tmp_path}/c")
    with pytest.raises(Exception):
        create_table(df, f"{tmp_path}/c")          # create-only: second run fails
    export_csv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["x", "y"] and back.count() == 2


def test_named_tables(spark, tmp_path):
    name = f"sink_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    create_table(df, f"{tmp_path}/n", partition_by=["y"], name=name)
    with pytest.raises(Exception):
        create_table(df, f"{tmp_path}/other", name=name)
    replace_table(df.limit(1), f"{tmp_path}/n", name=name)
    assert spark.table(name).count() == 1
