"""The classifiers' scores, computed anew one text at a time in plain Python, and their samples under repeated rows."""

import random
from math import exp

import pytest

pytest.importorskip("tessera.llm")
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import language_id, toxicity  # noqa: E402

MASK, P = (1 << 64) - 1, 0x9E3779B97F4A7C15


def slot(points, bits):
    h = len(points)
    for p in points:
        h = (h + p) * P & MASK
    return ((h ^ h >> 29) * P & MASK) >> (64 - bits)


def runs(text, n, whole):
    """Runs of n code points, two zeros before the text and after it; whole: no inner one is a separator."""
    points = [0, 0, *[ord(c) if c.isalnum() else 0 for c in text.lower()], 0, 0]
    for k in range(len(points) - n + 1):
        run = points[k : k + n]
        if all(run[1:-1]) if whole else any(run):
            yield run


def odd_docs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("_t", "_id", "_y", "_h", "_lang", "score", "held_out", "h"):
        docs = docs.withColumn(c, docs["doc_id"])
    return docs


def corpus(seed):
    rng = random.Random(seed)
    pick = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, fr = ["house", "river", "garden", "letter", "morning"], ["maison", "rivière", "jardin", "lettre", "matin"]
    rows = [(i, pick(en if i % 2 else fr, 12) + (" snarkly" if i % 5 == 0 else ""), "en" if i % 2 else "fr") for i in range(200)]
    return rows + [(None, "river", "en"), (300, None, "en"), (301, "", None), (302, pick(en, 40_000), "en"), (303, "12 .. 3", "fr")] + rows[:2]


def test_toxicity_scores_are_those_of_plain_python(spark):
    docs = odd_docs(spark, corpus(1))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(corpus(1))
    for r in got:
        z = model["bias"] + sum(weight.get(f, 0.0) for f in {slot(x, toxicity.BITS) for x in runs(text[r.doc_id] or "", toxicity.GRAM, True)})
        assert abs(r.score - 1 / (1 + exp(-z))) < 1e-9
        assert r.predicted == (r.score >= 0.3)


def test_a_label_has_one_row_however_often_it_is_repeated(spark):
    docs = spark.createDataFrame([(1, "the women said it. gay and black")] * 3000 + [(2, f"men {i}") for i in range(500)], "doc_id long, text string")
    usable = toxicity.usable_labels(spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, toxic int"))
    rows = toxicity.training_rows(docs, usable, 10, "text", "doc_id").collect()
    ids = {r._id for r in usable.collect()}
    assert sum(r.y >= 0 for r in rows) == len(ids) and len(rows) < 100


def test_language_predictions_are_those_of_plain_python(spark):
    docs = odd_docs(spark, corpus(2))
    model = language_id.fit(docs, per_language=60)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = language_id.language_id(docs, per_language=60).collect()
    assert len(got) == len(corpus(2))
    for r in got:
        t = text[r.doc_id] or ""
        if not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = [slot(x, language_id.BITS) for n in (1, 2, 3) for x in runs(t, n, False)]
        z = [sum(float(model["w"][f, c]) for f in found) / len(found) for c in range(2)]
        best = max(z)
        assert r.lang_pred == model["langs"][z.index(best)] and abs(r.score - 1 / sum(exp(x - best) for x in z)) < 1e-4
        assert r.doc_id is None or r.doc_id > 200 or r.lang_pred == ("en" if r.doc_id % 2 else "fr")


@pytest.mark.parametrize("number", [1, 3, 4, 7])
def test_a_language_of_one_repeated_document_is_learned(spark, number):
    rows = [(number, "zorg blik maan", "xx")] * 4000 + [(i, f"the house by the river {i}", "en") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = language_id._rows(docs, "text", "doc_id", "lang").where(language_id._usable())
    langs = {r._lang for r in training.select("_lang").distinct().collect()}
    model = language_id.fit(docs, per_language=20)
    assert set(model["langs"]) == langs
    out = language_id.language_id(docs, per_language=20).where(F.col("doc_id") == number).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in out] == (["xx"] if "xx" in langs else ["en"])


def test_the_rarest_of_too_many_languages_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, "the house by the river", "en") for i in range(40)] + [(i, "la maison du jardin", "fr") for i in range(100, 140)] + [(i, "noise", f"x{i}") for i in range(200, 230)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)["langs"] == ["en", "fr"]
