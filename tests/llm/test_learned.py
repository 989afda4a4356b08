"""Language ID and toxicity: held-out accuracy, folds and edges."""

import random

import pytest
from pyspark.sql import functions as F

from redactlake.llm import langid, toxicity
from redactlake.llm.common import in_fold

PARTS = {"en": ["th", "ing", "er", "wh", "and", "sh"], "de": ["sch", "ung", "keit", "über", "ein", "ach"], "fr": ["eau", "tion", "ré", "ou", "que", "aux"]}


def prose(r, lang, n=40):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language(spark):
    r = random.Random(2)
    rows = [(k, prose(r, lang), lang if k % 7 else None) for k in range(300) for lang in [r.choice(list(PARTS))]]
    truth = {k: max(PARTS, key=lambda x: sum(p in t for p in PARTS[x])) for k, t, _ in rows}
    rows += [(1000, None, "en"), (1001, "123 %$ ²", "en"), (None, "thing and her", "en"), (1002, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = langid.fit(docs)
    assert model.langs == sorted(PARTS)
    found = langid.predict(docs, model).withColumn("held", in_fold())
    assert found.columns[:6] == ["doc_id", "text", "lang", "score", "lang_pred", "_score"]
    got = {x.doc_id: x for x in found.collect()}
    held = [k for k in truth if got[k].held]
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.97
    assert all(0 <= x._score <= 1 for x in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "en"
    kept = langid.accept(docs, model)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == sorted([*truth, 0])
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)).langs == [] and langid.predict(docs.limit(5), langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_long_text_in_chunks(monkeypatch):
    docs_model = langid.Model(["a", "b"], langid.np.log(langid.np.random.default_rng(0).random((1 << 15, 2))), langid.np.log([0.25, 0.75]))
    text = "the quick brown fox " * 200
    whole = langid.score_texts([text], docs_model)
    monkeypatch.setattr(langid, "CHUNK", 333)
    parts = langid.score_texts([text], docs_model)
    assert parts[0] == whole[0] and parts[1] == pytest.approx(whole[1])


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 18)
    r = random.Random(4)
    bad = ["idiot", "worthless", "vequard", "vequette", "moronic"]
    rows, labels = [], []
    for k in range(500):
        ws = prose(r, r.choice(list(PARTS)), r.randint(20, 120)).split()
        toxic = k % 6 == 0
        for _ in range(3 if toxic else 0):
            ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append((k, " ".join(ws)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, prose(r, "en") + " vequorable idiiot idiots"), (None, "x")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [(k, y) for k, y in labels if got[k].held_out]
    assert sum(got[k].predicted == y for k, y in held) / len(held) > 0.95
    assert got[902].predicted == 1, "misspellings share n-grams with what was learned"
    assert got[900].score == got[901].score == model.share and got[900].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, table.limit(0))).where("score <> 0").count() == 0


def test_grams_of_words():
    one, start = toxicity.grams(["idiot", "ab", "x"])
    assert start.tolist() == [0, 5 + 4 + 3 + 2, 5 + 4 + 3 + 2 + 2 + 1]
    assert toxicity.grams(["ab"])[0].tolist() == one[start[1] : start[2]].tolist()
