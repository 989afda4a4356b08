"""Registered queries over whole tables, on rows that a filter once left out."""

import unicodedata

import duckdb
import pytest

from redactlake.plans import registry


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over one small table."""

    def run(query, name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = registry.queries()[query](spark, str(tmp_path))
        return {tuple(r) for r in got.collect()}, set(con.sql(registry.oracles()[query]).select(*map(duckdb.ColumnExpression, got.columns)).fetchall())

    return run


def test_garbled_text(both):
    odd = [chr(k) for k in (1, 0xE000, 0xFFFD, 0x378, 0x7F)]
    texts = ["long " * 500, "lo\x02ng " * 500, "l\x02\x03 " * 900, "x" * 80 + "\x01" * 20, "x" * 79 + "\x01" * 21, "\x01" * 19, "\x01" * 20, "", None]
    texts += [c * 5 + "é" * 15 for c in odd] + [c * 3 + "é" * 17 for c in odd]

    def brute(t):
        own = [c for c in t if c not in " \t\n\r\x0b\f"]
        return len(own) >= 20 and 5 * sum(ord(c) == 0xFFFD or unicodedata.category(c) in ("Co", "Cc", "Cn") for c in own) > len(own), len(own) >= 20

    want = {(k, *((None, None) if t is None else brute(t))) for k, t in enumerate(texts)}
    got, sql = both("garbled_text", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want and sql == want
    assert {k for k, plain, _ in got if plain} == {2, 4, 6, 9, 10, 11, 12, 13}


def test_markdown_tables(both):
    rows = [(1, 1, 11, 5, "R"), (1, 2, 12, 7, "A"), (2, 1, 13, 10, "N"), (3, 1, 14, 6, "R"), (3, 2, 15, 30, "R")]
    got, sql = both("markdown_tables", "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    assert got == sql == {(1, "| a\\|11 | R |\n| --- | --- |\n| a\\|12 | A |"), (2, "| a\\|13 | N |\n| --- | --- |")}


ITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"


def test_union_intervals_of_unknown_positions(both):
    item = lambda doc, part, quantity: (doc, part, 1, 1, quantity, 0.05, "A", "O")  # noqa: E731  starts at 7 * part, ends 1 + quantity later
    rows = [item(1, 1, None), item(1, 1, 4.0), item(1, 2, None), item(2, None, 3.0), item(2, 1, 9.0), item(2, 2, 1.0), item(3, 1, None), item(None, 1, 2.0)]
    got, sql = both("union_intervals", "lineitem", rows, ITEM)
    assert got == sql == {(1, 7, 12), (1, 14, None), (2, 7, 17), (2, None, None), (3, 7, None), (None, 7, 10)}


def test_subtraction_of_unknown_positions(both):
    item = lambda doc, part, quantity, zone=0: (doc, part, zone, 1, quantity, 0.05, "A", "O")
    rows = [item(None, 0, 10.0), item(None, 0, 3.0, 1), item(1, 0, None), item(1, None, 5.0)]
    rows += [item(2, 0, 40.0), item(2, 1, None, 1), item(2, 2, 2.0, 1), item(3, 0, 40.0), item(3, 1, None, 1)]
    rows += [item(4, 1, 10.0), item(4, 0, None, 1), item(5, 1, 10.0), item(5, 1, None, 1), item(6, 0, 20.0), item(6, None, 3.0, 1)]
    got, sql = both("subtract_protected", "lineitem", rows, ITEM)
    assert got == sql == {(None, 0, 11), (2, 0, 7), (2, 17, 41), (3, 0, 7), (4, 7, 18), (6, 0, 21)}


IMAGES = [(1, 5, 20, 1, None), (1, 5, 20, 2, 50.0), (2, 6, None, 1, 40.0), (2, 7, 5, 1, None), (2, 8, None, 1, 20.0), (3, 9, 20, None, 40.0), (3, 9, 20, 7, 40.0)]
IMAGES = [(*r, 0.05, "A", "O") for r in IMAGES]


def test_ocr_budget_of_unknown_size_or_place(both):
    got, sql = both("ocr_budget", "lineitem", IMAGES, ITEM)
    assert got == sql == {(1, 1, 1, "read"), (1, 2, 1, "seen"), (2, 1, 2, "read"), (2, 1, 2, "too small"), (3, None, 3, "seen"), (3, 7, 3, "read")}


def test_images_to_read_of_unknown_size_or_place(both):
    got, sql = both("images_to_read", "lineitem", IMAGES, ITEM)
    assert got == sql
    want = {(1, 1, 5, "read"), (1, 2, 5, "read"), (2, 1, 6, "read"), (2, 1, 7, "too small"), (2, 1, 8, "too small"), (3, None, 9, "seen"), (3, 7, 9, "read")}
    assert {(r[0], r[1], r[3], r[6]) for r in got} == want
