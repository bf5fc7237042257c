"""Toxicity and language: accuracy on rows not learned from, and the awkward cases."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts, documents, prose  # noqa: E402

from forgepulse.llm import language, toxicity  # noqa: E402

BAD = ["blarg", "snork", "wuzzle"]


def _labelled(rng: random.Random, n: int) -> list[tuple[str, int]]:
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(5, 60)).split(" ")
        if toxic := int(i % 5 == 0):
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "!"]))
        rows.append((" ".join(words), toxic))
    return rows


def test_toxicity_on_rows_not_learned_from(spark):
    rng = random.Random(8)
    learned = _labelled(rng, 800) + [(None, 1), ("no label", None), ("odd label", 7)]
    model = toxicity.fit(spark.createDataFrame(learned, "text string, toxic int"))
    held = _labelled(rng, 300)
    scored = toxicity.score(spark.createDataFrame(held, "text string, toxic int"), model).collect()
    assert len(scored) == 300
    assert sum(r["predicted"] != r["toxic"] for r in scored) <= 6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(8)
    model = toxicity.fit(spark.createDataFrame(_labelled(rng, 200), "text string, toxic int"))
    texts = awkward_texts()
    rows = toxicity.score(documents(spark), model).collect()
    assert len(rows) == len(texts)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[0] == scores[1]
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_toxicity_without_two_labels(spark):
    schema = "text string, toxic int"
    for rows, expected in (([("a b", 1)], 1.0), ([("a b", 0)], 0.0), ([], 0.0)):
        model = toxicity.fit(spark.createDataFrame(rows, schema))
        assert toxicity.score(documents(spark), model).first()["score"] == expected


def test_features_are_the_grams_of_the_text():
    features = toxicity.Features(bits=20, grams=(3,))
    assert len(features.of("abcd")) == 4  # ' ab', 'abc', 'bcd', 'cd '
    assert len(features.of("AbCd")) == 4 and (features.of("AbCd") == features.of("abcd")).all()
    assert len(features.of(None)) == len(features.of("")) == 0


def _spoken(rng: random.Random, tongue: str, n: int) -> str:
    parts = {"aa": ["ra", "to", "mi"], "bb": ["sch", "ung", "keit"], "cc": ["ção", "lho", "nha"]}
    return " ".join(
        "".join(rng.choice(parts[tongue]) for _ in range(rng.randrange(2, 4))) for _ in range(n)
    )


def test_language_on_rows_not_learned_from(spark):
    rng = random.Random(8)
    tongues = ["aa", "bb", "cc"]
    learned = [(_spoken(rng, t, 30), t) for t in tongues for _ in range(60)]
    learned += [(None, "aa"), ("text", None)]
    filters = language.fit(spark.createDataFrame(learned, "text string, lang string"))
    assert filters.languages == tongues
    held = [(_spoken(rng, t, 6), t) for t in tongues for _ in range(40)]
    df = spark.createDataFrame(held, "text string, lang string")
    rows = language.predict(df, filters).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 118
    assert all(0 < r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    rng = random.Random(8)
    learned = [(_spoken(rng, t, 30), t) for t in ("bb", "cc", "cc") for _ in range(20)]
    filters = language.fit(spark.createDataFrame(learned, "text string, lang string"))
    texts = [None, "", "123 !? 456", "東京", "x"]
    rows = language.predict(documents(spark, texts), filters).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == got[4][0] == "cc" and got[3][1] == 0.0
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert nothing is None
    assert language.predict(documents(spark, texts), nothing).first()["lang_pred"] == "und"
    assert language.predict(documents(spark, []), filters).count() == 0


def test_filters_hold_every_language_of_a_gram():
    """Brute force of the popcounts with sets in place of filters."""
    rng = random.Random(1)
    grams = [np.unique(np.concatenate(language.gram_hashes(_spoken(rng, t, 300)))) for t in ("aa", "bb")]
    bits = np.zeros((language.SLOTS, 1), np.uint8)
    for i, held in enumerate(grams):
        for slots in language.slots_of(held):
            bits[slots, 0] |= np.uint8(128 >> i)
    rate = np.array([(bits[:, 0] & (128 >> i) != 0).mean() for i in range(2)]) ** language.HASHES
    filters = language.Filters(["aa", "bb"], bits, rate, 0)
    text = _spoken(rng, "aa", 20) + " " + _spoken(rng, "bb", 5)
    hashes = np.concatenate(language.gram_hashes(text))
    shares = [np.isin(hashes, held).mean() for held in grams]
    predicted, score = language.predict_text(filters, text)
    assert predicted == "aa"
    assert abs(score - shares[0] / sum(shares)) < 0.01
