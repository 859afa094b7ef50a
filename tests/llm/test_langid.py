from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import langid

WORDS = {"en": "the and of with that from this have were thing right shall".split(), "de": "der und nicht schön über ich zwischen wurde straße dass".split(), "fr": "le être était déjà avec pour très façon élève où".split()}


def make(seed, n=120):
    rnd = random.Random(seed)
    return [(seed * 1000 + i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 60))), lang) for i in range(n) for lang in [rnd.choice(list(WORDS))]]


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    rows = make(1) + [(9001, None, "en"), (9002, "", "de"), (9003, "123 ... !?", "fr"), (None, "der und nicht", None), (9004, "schön über straße " * 4000, None), (9001, None, "en")]
    docs = spark.createDataFrame([(d, t, x, 0.5) for d, t, x in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {d: x for d, t, x in rows if t and any(c.isalpha() for c in t) and x}
    assert all(by[d].lang_pred == x for d, x in truth.items())
    assert {by[d].held_out for d in truth} == {True, False}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (9001, 9002, 9003))
    assert by[None].lang_pred == "de" and by[9004].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()] == ["und"]
    none = docs.limit(0)
    assert langid.predict(none, langid.train(none)).collect() == []


def test_stretches_give_the_same_features(monkeypatch):
    text = "Les élèves étaient là, 42 fois. " * 20
    whole, cut = np.zeros(langid.BUCKETS, bool), np.zeros(langid.BUCKETS, bool)
    langid.features(text, whole)
    monkeypatch.setattr(langid, "STRETCH", 17)
    langid.features(text, cut)
    assert (whole == cut).all()


def test_scores_are_kernel_ridge_regression():
    rng = np.random.default_rng(1)
    x = rng.random((60, langid.BUCKETS)) < 0.002
    labels = ["a" if i % 3 else "b" for i in range(60)]
    x[::3, :40] = True
    model = langid.fit(x, labels, landmarks=1000)
    size = x.sum(axis=1)
    k = x.astype(float) @ x.T.astype(float) / np.sqrt(np.outer(size, size))
    own = np.diag([1 / labels.count(y) for y in labels])
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    alpha = np.linalg.solve(k @ own @ k + langid.RIDGE * k + 1e-9 * np.eye(60), k @ own @ y)
    folded = x.astype(np.float32) @ model.weights / np.sqrt(size)[:, None]
    assert np.allclose(folded, k @ alpha, atol=1e-3)
    assert (np.array(model.languages)[folded.argmax(axis=1)] == np.array(labels)).all()


def test_rare_languages_keep_their_share(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(langid, "SAMPLE_ALL", 60)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS[x]) for _ in range(20)), x) for i, x in enumerate(["en"] * 900 + ["de"] * 900 + ["fr"] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels: seen.extend(labels) or real(x, labels))
    langid.train(docs)
    free = [r.n for r in docs.filter(~langid.held_out(docs.doc_id)).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    assert [seen.count(x) for x in ("de", "en", "fr")] == [min(20, n) for n in free] and free[2] < 20
