"""Staged tables, the shared folder and keys of rows."""

import pytest
from pyspark.sql import functions as F

from redactlake.llm import common


def test_shared_root(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf = spark.conf
        sparkContext = Context

    held = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_root(spark)
    if held is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.conf.unset("spark.checkpoint.dir")
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_root(Session)
    assert common.shared_root(spark) == common.shared_root(spark)


def test_stage_and_unstage(spark):
    table = common.stage(spark.range(5), "test")
    assert table.count() == 5
    common.unstage(table)
    fs, path = common.hadoop(spark, table._staged)
    assert not fs.exists(path)


def test_row_key(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", "b"), (1, "a/", "b")]
    df = spark.createDataFrame(rows, "id int, `x.y` string, ID_2 string").withColumn("m", F.create_map(F.lit("k"), F.col("ID_2")))
    keys = [r[0] for r in df.select(common.row_key(df, "id")).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[1] and keys[0].startswith("1/") and keys[3].startswith("/")
