"""Language identification against a loop over dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import langid

WORDS = {"de": "der und nicht größer haus straße wir", "en": "the and house street not bigger we", "xx": "\u0438 \u043d\u0435 \u0434\u043e\u043c \u0443\u043b\u0438\u0446\u0430"}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 30))) for _ in range(n)]


def grams(text):
    """Hashed 1-, 2- and 3-grams of letters; a run of anything else is one border, which is no 1-gram."""
    codes = []
    for ch in text.lower():
        if ch.isalpha():
            codes.append(ord(ch))
        elif not codes or codes[-1] != 32:
            codes.append(32)
    mask, out = (1 << 64) - 1, Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            part = codes[i : i + n]
            if n == 1 and part[0] == 32:
                continue
            g = part[0]
            for x in part[1:]:
                g = (g * 0x1F123BB5 + x) & mask
            h = ((g * 0x9E3779B97F4A7C15 + (n - 1) * 0x51ED2701) & mask) >> 40
            out[h % langid.WIDTH] += 1
    return out


def nearest(model, text):
    """Cosine to every centroid by hand; the first of equal ones."""
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0, True
    weights = {k: math.log1p(n) * float(model.idf[k]) for k, n in grams(text).items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    best, found = None, -1.0
    for name, centre in zip(model.languages, model.centroids.tolist()):
        cosine = sum(w * centre[k] for k, w in weights.items()) / norm
        if cosine > found + 1e-9:
            best, found = name, cosine
    return best, min(max(found, 0.0), 1.0), found < model.floor[best]


def test_every_text_goes_to_the_nearest_centroid(spark, documents):
    train = [(t, lang) for lang in WORDS for t in texts(lang, 60, 1)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.fit_languages(langid.training_sample(docs, F.lit(True)))
    asked = [t for lang in WORDS for t in texts(lang, 30, 2)] + ["", None, "123 !?", "the", "haus the", "ø", "zzz qqq", "  Der\n\nUND--und ", "der and der and"]
    rows = list(enumerate(asked))
    found = {r["doc_id"]: r for r in langid.identify(documents(rows), model).collect()}
    for i, t in rows:
        name, score, rejected = nearest(model, t)
        assert found[i]["lang_pred"] == name and abs(found[i]["score"] - score) < 1e-5, (t, name, found[i])
        if abs(score - model.floor.get(name, -1)) > 1e-5:
            assert found[i]["rejected"] == rejected
    assert found[93]["lang_pred"] == "en" and found[90]["lang_pred"] == "und"


@pytest.mark.parametrize("few", [10_000, 5])
def test_training_sample_is_bounded_by_language(spark, monkeypatch, few):
    monkeypatch.setattr(langid, "FEW_LANGUAGES", few)
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("dirty"), "id")).when(F.col("id") % 3 == 1, "en").alias("lang"),
    )
    rows = langid.training_sample(docs, F.lit(True), sample=200).groupBy("_lang").count().collect()
    sizes = {r["_lang"]: r["count"] for r in rows}
    assert 120 < sizes.pop("en") < 280 and len(sizes) == 1_000 and set(sizes.values()) == {1}


def test_ties_go_to_the_first_language(spark, documents):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    model = langid.fit_languages(langid.training_sample(docs, F.lit(True)))
    assert {r["lang_pred"] for r in langid.identify(documents([(1, "same words here"), (2, "words")]), model).collect()} == {"a"}
    assert np.isclose(np.linalg.norm(model.centroids, axis=1), 1).all()
