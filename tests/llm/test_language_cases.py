"""Language ID against a plain naive Bayes, its sample, and what it accepts."""

import math
from collections import Counter

import pytest

from redactlake.llm import langid

WORDS = {"aa": "river stone bridge water", "bb": "maison arbre lune soleil", "cc": "katze hund vogel baum"}


def rows():
    out = []
    for k in range(300):
        lang = ["aa", "bb", "bb", "cc", "cc", "cc"][k % 6]
        own = WORDS[lang].split()
        out.append((k, " ".join(own[(k * j + j) % 4] for j in range(1, 3 + k % 9)), lang))
    return [*out, (None, "river", "aa"), (400, None, "aa"), (401, "", None), (402, "12 !", "bb"), (403, "x", None), (5, out[5][1], "cc")]


def buckets(text):
    cp, h = langid.hashed(text.lower(), langid.BITS)
    return [int(h[j, i]) for i in range(len(cp)) if cp[i] != 32 for j in range(3)]


def test_brute(spark):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    held = {r.doc_id for r in docs.select("doc_id").where(langid.in_fold()).collect()}
    use = [(t, lang) for k, t, lang in table if k is not None and k not in held and t is not None and lang]
    counts = {x: Counter(b for t, lang in use if lang == x for b in buckets(t)) for x in WORDS}
    size = Counter(lang for _, lang in use)
    for text in ["river lune", "katze", "stone!", "12", "ß" * 5, "", "Bridge maison " * 400]:
        own = buckets(text)
        score = {x: math.log(size[x] / len(use)) + sum(math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 2**langid.BITS)) for b in own) for x in sorted(WORDS)}
        best = max(sorted(score), key=score.get)
        (got,), (p,) = langid.score_texts([text], model)
        assert got == (best if own else "und")
        assert p == pytest.approx(1 / sum(math.exp(v - score[best]) for v in score.values()) if own else 0.0)
    many = [t for _, t, _ in table] * 3
    assert langid.score_texts(many, model) == tuple([x[0] for x in c] for c in zip(*(langid.score_texts([t], model) for t in many), strict=True))


def test_sample(spark):
    docs = spark.createDataFrame([(k, "ab" if k % 10 else "xy", "aa" if k % 10 else "bb") for k in range(4000)], "doc_id long, text string, lang string")
    assert langid.fit(docs, sample=100).langs == ["aa", "bb"]
    assert langid.fit(docs, sample=100).prior[0] == pytest.approx(math.log(0.9), abs=0.02)


def test_accept(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    kept = langid.accept(docs)
    assert kept.columns == docs.columns
    assert {401, 402, 400}.isdisjoint(r.doc_id for r in kept.collect()) and kept.where("doc_id = 5").count() == 2
    assert {r.lang for r in langid.accept(docs, languages=["bb"]).where("lang IS NOT NULL AND doc_id < 300").collect()} == {"bb"}
    assert sorted(r.doc_id for r in langid.accept(docs.where("doc_id > 400").withColumn("lang", langid.F.lit(None).cast("string"))).collect()) == [403]
