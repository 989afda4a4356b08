"""Exact dedup against a plain grouping."""

import hashlib
import random

from redactlake.llm import exact


def brute(rows):
    groups = {}
    for k, t in rows:
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append((-len(t or ""), k))
    out = []
    for sha, own in groups.items():
        keep = min(own)[1]
        out += [(k, keep, len(own), k == keep, sha) for _, k in own]
    return sorted(out)


def test_brute(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, r.choice([None, "", " ", "a b", "ab", "a  b", "é\x1c", "hot text", "hot  text", f"own {k}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for heavy in (0.001, 0.3, 2.0):  # all, some and no digests are heavy
        monkeypatch.setattr(exact, "HEAVY", heavy)
        assert sorted(tuple(x) for x in exact.annotate(docs).collect()) == brute(rows)
    kept = exact.drop_copies(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x[0] for x in brute(rows) if x[3])


def test_edges(spark):
    rows = [(7, "x", 1), (7, "x", 1), (None, "x", 2), (8, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = exact.annotate(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == [(0, 7, 3), (7, 7, 3), (7, 7, 3), (8, 8, 1)]
    assert sum(r.kept for r in got) == 2
    assert sorted(tuple(r) for r in exact.drop_copies(docs).collect()) == [(7, "x", 1), (8, "y", 3)]
    assert exact.annotate(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


def test_summary_bound():
    import pyarrow as pa

    words = ["hot"] * 50 + [f"w{k}" for k in range(100)]
    random.Random(1).shuffle(words)
    out = list(exact.misra_gries(10)([pa.RecordBatch.from_arrays([pa.array(words)], ["d"])]))[0]
    held = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert len(held) <= 10 and 50 - 150 // 11 <= held["hot"] <= 50
