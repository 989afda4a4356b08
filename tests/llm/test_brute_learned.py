"""Toxicity scores against a plain loop over n-grams; long texts, repeated rows, clashing names, repeated ids."""

import math

import numpy as np
import pytest

from redactlake.llm import toxicity

BITS = 12
MASK = (1 << 32) - 1


def bucket(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & MASK
    x = (h + len(gram) * 0x3C6EF372) & MASK
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & MASK
    return (x ^ (x >> 13)) >> (32 - BITS)


def brute(model, text):
    scores = []
    for w in (text or "").split():
        word = toxicity.normal(w)
        if word:
            marked = f"<{word}>"
            grams = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
            scores.append(sum(float(model.score[bucket(g)]) for g in grams) / len(grams))
    if not scores:
        return model.share
    best = max((a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)) if len(scores) > 1 else scores[0]
    return 1 / (1 + math.exp(-(best + model.bias)))


TEXTS = [None, "", "...", "a", "ß x", "One two, three!", "déjà vu " * 3000, "x" * 20_000 + " end", "same same", "Same-same ?"]


def test_scores():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 2, 1 << BITS).astype(np.float32), 0.1, 0.3, BITS)
    got = model.texts(TEXTS * 2, {})
    assert got == pytest.approx([brute(model, t) for t in TEXTS] * 2, abs=1e-5)


def test_rows(spark):
    rows = [(k, t, "x", 0.5) for k, t in enumerate(TEXTS)] + [(2, "...", "y", 0.1), (None, "One", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(2), labels)
    assert np.array_equal(one.score, two.score), "the rows' order changes nothing"
    got = toxicity.score(docs, one).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
