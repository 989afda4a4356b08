"""The shard store: empty, null and clashing arrivals, compaction of a single file, vacuum beside a writer."""

import pytest
from pyspark.sql import functions as F

from redactlake.llm import sharding


def test_one_file_is_compacted(spark, tmp_path):
    spark.range(1000).select("id", F.lit(None).cast("string").alias("ID_x"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    store = sharding.ShardStore(spark, str(tmp_path / "s"), table.schema)
    merges = 0
    parts = sharding.arrivals(table)
    for part in parts:
        store.append(part)
        merges += store.compact()
    assert len(parts) == 16 and merges >= 4 and len(store.manifest()["runs"]) < 4
    assert sorted(r.id for r in store.read().select("id").collect()) == list(range(1000))


def test_full_tiers_merge_at_once(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema, fanout=2)
    for k in range(4):
        store.append(spark.range(k, k + 1))
    assert [len(g) for g in store.plan(store.manifest())] == [4]
    assert store.compact() == 1 and len(store.manifest()["runs"]) == 1 and store.read().count() == 4


def test_empty_arrival(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (None, "a")], "text string, TEXT_2 string")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), rows.schema)
    assert store.append(rows.limit(0))["version"] == 0
    assert store.append(rows)["version"] == 1
    assert store.append(rows.limit(0)) == store.manifest(1) and store.read().count() == 2


def test_vacuum(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s"), spark.range(1).schema, fanout=2) for _ in range(2))
    a.append(spark.range(5))
    pending = b._write(spark.range(5, 9))
    assert a.vacuum() == 0
    b._commit(b.manifest(), [*b.manifest()["runs"], pending])
    assert a.read().count() == 9
    a._write(spark.range(3))
    assert a.vacuum(age=-60.0) == 1 and a.read().count() == 9
    with pytest.raises(ValueError, match="last manifest"):
        a.vacuum(keep=0)
