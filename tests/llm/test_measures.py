"""Measures and samples of the two classifiers of documents."""

import random

import numpy as np
import pytest

from scholarlake.llm import quality_classifier, toxicity

CAPITALS, STRETCHED = 9, 12


def measure(text: str, at: int) -> float:
    return toxicity.features(text, frozenset(), frozenset())[at]


def test_capitals_are_counted_over_the_whole_text():
    assert measure("ABcd " * 1000, CAPITALS) == pytest.approx(50)
    assert measure("a" * 100_000 + "B" * 300_000, CAPITALS) == pytest.approx(75)
    assert measure("ÄÖäö", CAPITALS) == pytest.approx(50)
    assert measure("", CAPITALS) == measure("123 !", CAPITALS) == 0


def test_masked_words():
    assert toxicity.MASKED.findall("id10t a*b m0r0n 2nd co2 x@y.z ab1cd2ef a1b2c") == ["id10t", "a*b", "m0r", "x@y", "ab1cd", "a1b"]


def test_every_stretched_word_counts_once():
    assert measure("sooooooo good", STRETCHED) == pytest.approx(50)
    assert measure("sooo baaad news " * 5000, STRETCHED) == pytest.approx(200 / 3)
    assert measure("see too all 1000", STRETCHED) == 0


@pytest.mark.parametrize("c", "、あ一Ａ\U00020000\U000323af\U0001f600\U0010ffff")
def test_classes_of_characters_in_all_planes(c):
    kind = quality_classifier.CLASSES[ord(c)]
    assert (bool(kind & 1), bool(kind & 2), bool(kind & 4)) == (c.isalpha(), c.isupper(), c.isdigit())


def test_no_letter_lies_beyond_the_table():
    beyond = map(chr, range(quality_classifier.LAST_LETTER, 0x110000))
    # code points assigned by a later Unicode version would show here
    assert not any(c.isalpha() or c.isdigit() or c.isspace() for c in beyond)


def test_quality_sample_is_bounded_in_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(10)] + [(10, "y" * 100_000), (11, "\n" * 5_000), (12, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)], "doc_id long, quality int")
    quality_classifier.fit(docs, labels, sample_chars=2_000)
    texts, marks = seen[0]
    assert texts == ["x" * (10 * i) for i in range(10)] + [""]
    assert np.array_equal(marks, [i % 2 for i in range(10)] + [0])
    quality_classifier.fit(docs, labels)
    assert len(seen[1][0]) == 13


def test_one_very_long_text_does_not_empty_the_quality_sample(spark):
    rows = [(i, f"plain words of document {i}\nand a second line" if i % 2 else "### $$$ !!!\n### $$$ !!!") for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, "long line of words\n" * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(60, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, sample_chars=50_000)
    found = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    assert len(found) == 61 and found[60] > 0.5 and found[1] > 0.9 and found[0] < 0.1


def plain_features(text, words, stems):
    """The dense features of a text, counted without tables, searches or regular expressions."""
    clear = "".join(" " if c in ".,;:!?\"'()[]{}«»¿¡…" else c for c in text.lower())
    tokens = clear.split()
    n, chars = max(len(tokens), 1), max(len(text), 1)
    hits = [i for i, w in enumerate(tokens) if w in words]
    stemmed = [i for i, w in enumerate(tokens) if {w[:4], w[:5]} & set(stems)]
    you = [i for i, w in enumerate(tokens) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - y) <= 5 for y in you) for i in hits + stemmed)
    letters = [c.isalpha() for c in text]
    signs = [c in "0123456789@$*" for c in text]
    masked, i = [], 0
    while i < len(text):  # letters, then signs, then letters
        j = i
        while j < len(text) and letters[j]:
            j += 1
        k = j
        while k < len(text) and signs[k]:
            k += 1
        e = k
        while e < len(text) and letters[e]:
            e += 1
        if i < j < k < e:
            masked.append(text[i:e])
            i = e
            # the next one begins at a run's start, and this one took its run whole
        else:
            i = max(j, i + 1)
    stretched, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] == text[i]:
            j += 1
        stretched += letters[i] and j - i >= 3
        i = j
    swap = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "_": "", "-": ""}
    hidden = sum((w := "".join(swap.get(c, c) for c in m.lower())) in words or w[:5] in stems for m in masked)
    capitals = sum(c.isupper() for c in text)
    return [
        100 * len(hits) / n, np.log(1 + len(hits)), len({tokens[i] for i in hits}), 100 * len(stemmed) / n, np.log(1 + len(stemmed)), len({tokens[i][:5] for i in stemmed}),
        near, 100 * len(you) / n, 100 * sum(w.isupper() for w in text.split()) / n, 100 * capitals / max(sum(letters), 1),
        100 * (text.count("!") + text.count("?")) / chars, 100 * (text.count(".") + text.count(",")) / chars, 100 * (len(masked) + stretched) / n, hidden, np.log(1 + len(tokens)),
    ]


def test_toxicity_scores_by_hand(spark):
    """Features counted a second way, each tree asked for itself, the isotonic curve by linear interpolation."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    plain, foul = [f"word{i}" for i in range(60)], ["moron", "scumbag", "id10t", "IDIOT", "sooo", "m0ron", "you", "your"]
    texts = [" ".join(rng.choice(foul if rng.random() < (0.4 if i % 3 == 0 else 0.02) else plain) + rng.choice(["", "", "!", ",", "."]) for _ in range(rng.randrange(5, 60))) for i in range(400)]
    texts += ["", "!!!", "ÄÖÜ straße 7", "a" * 5000 + " you moron", "x@y id10t, m0r0n aaa bbbb"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.trees is not None
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    bounds, steps = (np.array(x.toArray()) for x in (model.curve.boundaries, model.curve.predictions))
    from pyspark.ml.linalg import Vectors

    for i in [*rng.sample(range(400), 12), *range(400, 405)]:
        want = plain_features(texts[i], model.words, model.stems)
        assert toxicity.features(texts[i], model.words, model.stems) == pytest.approx(want)
        margin = sum(w * t.predict(Vectors.dense(want)) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True))
        assert got[i] == pytest.approx(min(1.0, max(0.0, np.interp(margin, bounds, steps))), abs=1e-6)
    assert docs.filter(F.col("doc_id").isNull()).count() == 0 and len(got) == 405
