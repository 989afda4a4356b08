"""Which row stays of copies: repeated ids, nulls, equal rows, clashing names, maps, heavy digests."""

from redactlake.llm import exact, simhash


def test_drop_copies(spark, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY", 0.05)
    rows = [(k, "the same text " if k == 30 else "the same text", "a") for k in range(40)] + [(100 + k, f"text {k % 7}", "b") for k in range(30)] + [(7, "other", "c"), (7, "other", "c"), (7, "other", "d"), (None, "alone", "e"), (None, "alone", "e"), (200, None, None), (201, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, EXACT_KEY string").selectExpr("*", "map('k', EXACT_KEY) AS m").repartition(3)
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect())
    want = [(False, 7, "other"), (False, 30, "the same text "), *((False, 100 + k, f"text {k}") for k in range(7)), (False, 200, None), (True, 0, "alone")]
    assert kept == want
    again = exact.drop_copies(docs.repartition(5)).where("doc_id = 7").first()
    assert again.EXACT_KEY == got.where("doc_id = 7").first().EXACT_KEY
    assert exact.drop_copies(docs.limit(0)).count() == 0


def test_drop_near_copies(spark):
    long = "one two three four five six seven eight nine ten " * 20
    rows = [(1, long, "a"), (1, long, "b"), (2, long + "eleven", "c"), (3, "quite another text of other words", "d"), (None, "a third text with its own words", "e"), (None, "a third text with its own words", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_key string")
    got = simhash.drop_near_copies(docs.repartition(3))
    assert got.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert got.where("doc_id = 1").first().near_key == simhash.drop_near_copies(docs.repartition(2)).where("doc_id = 1").first().near_key
