"""A benchmark in several blocks: the same marks, whatever the rows; limits of coverage and length."""

from redactlake.llm import decontam

ITEMS = [(1, " ".join(f"one{k}" for k in range(14))), (2, " ".join(f"two{k}" for k in range(12))), (3, "short item"), (4, None), (None, " ".join(f"one{k}" for k in range(2, 13)))]
ONE, TWO = ITEMS[0][1], ITEMS[1][1]
DOCS = [(1, f"before {ONE} after", 5, "x"), (1, f"before {ONE} after", 5, "x"), (2, f"{TWO} and a short item {ONE}", 5, None), (3, "clean text", 5, "y"), (4, None, None, "z"), (None, "", 0, "z"), (5, f"word {'far ' * 5000}{TWO} end", 9, "x")]


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, n_chars long, decontam_row string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_blocks(spark):
    docs, items = tables(spark)
    whole = decontam.marks(docs, items)
    assert len(list(decontam.automata(items, block_words=13))) > 2
    assert rows(decontam.marks(docs, items, block_words=13)) == rows(whole) and whole.count() == len(DOCS)
    assert rows(decontam.clean(docs, items, block_words=13)) == rows(decontam.clean(docs, items))


def test_limits(spark):
    docs, items = tables(spark)
    for size in (13, 10_000):
        got = {r.doc_id: r for r in decontam.clean(docs, items, coverage=0.5, block_words=size).collect()}
        assert set(got) == {None, 3, 4, 5} and got[5].text == f"word {'far ' * 5000} end" and got[5].n_chars == len(got[5].text) and got[3].n_chars == 5
        assert got[5].decontam_row == "x" and got[4].text is None
        assert {r.doc_id for r in decontam.clean(docs, items, coverage=0.5, longest=11, block_words=size).collect()} == {None, 3, 4}
    assert decontam.clean(docs.limit(0), items, coverage=0.5, block_words=13).count() == 0
