"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from redactlake.llm import repeats


def brute(rows, window):
    first = {}
    for k, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - window + 1):
            s = data[p : p + window]
            first[s] = min(first.get(s, 1 << 62), k)
    out = []
    for k, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - window + 1):
            if first[data[p : p + window]] < k:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((k, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed, letters, n):
    r = random.Random(seed)
    parts = ["".join(r.choice(letters) for _ in range(r.randint(5, 160))) for _ in range(12)]
    rows = [(k, "".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 6)))) for k in range(n)]
    rows[3] = (3, None)
    rows[5] = (5, rows[9][1])
    rows[7] = (8, rows[8][1])
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abcdefé "), (3, "a")])
@pytest.mark.parametrize("chunk", [400, 1 << 20])
def test_brute(spark, seed, letters, chunk):
    rows = texts(seed, letters, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in repeats.cut_repeats(docs, chunk=chunk).collect())
    assert got == brute(rows, 50)


def test_edges(spark):
    rows = [(None, "x" * 60), (1, "x" * 60), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.cut_repeats(docs).collect()}
    assert got == {None: 60, 1: 0, 2: 0}
    assert repeats.cut_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("every", [1, 2])
def test_hot_grams(spark, monkeypatch, every):
    """Dealing some or all grams by their surroundings too changes nothing."""
    rows = texts(4, "abcdefé ", 60)
    grams = set()
    for _, t in rows:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        ranks = repeats.Ranks(raw)
        a = repeats.anchors(ranks, np.array([len(raw)]), 50, 20)[0]
        grams |= set(ranks.at(a, a + 20).tolist())
    monkeypatch.setattr(repeats, "hot_grams", lambda *a: np.array(sorted(grams)[::every], dtype=np.uint64))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in repeats.cut_repeats(docs, chunk=400).collect()) == brute(rows, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("repeats_")]


def test_hot_gram_is_found(spark):
    rows = [(k, f"{k:030d}" + "the same forty bytes in each of the texts" + f"{k * 7919:030d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = repeats.common.stage(docs.select("doc_id", "text").mapInArrow(lambda b: repeats._packed(b, 4000), "chunk string, ids binary, sizes binary, data binary"), "chunks")
    assert len(repeats.hot_grams(chunks, 50, 20)) >= 1
    assert sorted(tuple(r) for r in repeats.cut_repeats(docs, chunk=4000).collect()) == brute(rows, 50)
