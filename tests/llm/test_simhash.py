"""Tiles, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from redactlake.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, fps, radius=3):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, k in enumerate(keys):
        low[top(i)] = min(k, low.get(top(i), k))
    return [low[top(i)] for i in range(len(keys))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "É a\x1cb c\x85d \x0b e", "x " * 70000 + "tail"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 32)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = []
    for s in seeds:
        x = int(s)
        for _ in range(int(rng.integers(1, 12))):
            fps.append(x)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= 1 << int(b)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long").repartition(3)
    star = {r.u: r.v for r in simhash.stars(simhash.links(distinct)).collect()}
    got = [star.get(x, x) for x in signed]
    want = brute_components(signed, fps)
    assert got == want
    assert len(set(want)) < len(set(signed))


def test_rows(spark):
    rows = [(1, None, "n"), (2, "", "e"), (3, "a b c d", "x"), (3, "a b c d", "x"), (None, "A B C D", "x"), (5, "Other words stand here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_key string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect())
    same = f"{brute_fingerprint('a b c d'):016x}"
    other = f"{brute_fingerprint(rows[5][1]):016x}"
    assert got == [(0, same, 3), (1, "0" * 16, 1), (2, "0" * 16, 1), (3, same, 3), (3, same, 3), (5, other, 5)]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 3, 5]
    empty = docs.limit(0)
    assert simhash.classes(empty).count() == 0
