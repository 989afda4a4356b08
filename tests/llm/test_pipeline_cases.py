"""The pipeline on empty tables, repeated rows, nulls in any column and clashing names."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

ROWS = [(1, "The first text of this table is plain.", "en", "a", 38), (1, "The first text of this table is plain.", "en", "a", 38), (2, "Ein anderer Text, der auch bleibt.", "de", None, None), (None, "A text without an id that stays.", "en", "b", 3), (3, None, None, None, None), (4, "", "en", "c", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in pipeline.run(spark, str(folder)).collect())


def test_cases(spark, tmp_path):
    got = run(spark, tmp_path, ROWS, [(1, None), (None, "")])
    assert [(k, ok) for k, _, ok in got] == [(0, True), (1, True), (2, True)] and all(n > 5 for _, n, _ in got)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []


def test_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("lang_pred", "score", "exact_key", "exact_sha", "near_key", "decontam_found"):
        docs = docs.withColumn(name, F.lit("own"))
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.where("decontam_found = 'own' AND score = 'own'").count() == kept.count() >= 3, name
