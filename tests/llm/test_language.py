"""Cross-parsing by definition over long texts, and samples of unequal length."""

import random

import pytest

from scholarlake.llm import language_id


def phrases(text, known):
    n, at = 0, 0
    while at < len(text):
        k = at + 1
        while k < len(text) and text[at : k + 1] in known:
            k += 1
        n, at = n + 1, k
    return n


@pytest.mark.parametrize("piece", [3, 7, 1024])
def test_long_texts_are_parsed_in_one(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(2)
    samples = {k: "".join(rng.choice("abcde") for _ in range(5000)) for k in ("aa", "bb")}
    model = language_id.Model(samples, letters=3)
    texts = [samples["aa"], samples["bb"][100:], "".join(rng.choice("abcdef") for _ in range(4000)), "a", "abcde" * 300, samples["aa"][:2500] + samples["bb"][:2500]]
    got = model.phrases([model.encode(t) for t in texts])
    for k, t in enumerate(texts):
        assert got[k].tolist() == [phrases(t, samples["aa"]), phrases(t, samples["bb"])]
    assert got[0, 0] == 1


def test_a_short_sample_is_no_disadvantage(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(2000)] for k in ("aa", "bb")}
    sample = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = language_id.Model({"aa": sample("aa", 6000), "bb": sample("bb", 300)})
    for k in ("aa", "bb"):
        names, _ = model.predict([sample(k, 60) for _ in range(300)])
        assert sum(n == k for n in names) >= 270, k


def test_ties_go_to_the_smaller_name():
    model = language_id.Model({"zz": "abc abd", "mm": "abc abd"})
    assert model.predict(["abc", "abd abc", "xyz"])[0] == ["mm"] * 3


def test_combining_marks_belong_to_words():
    assert language_id.letters_only("हिन्दी में, 12!") == "हिन्दी में" and language_id.letters_only("น้ำ-ใส") == "น้ำ ใส"
    assert language_id.letters_only("ét́ A") == "ét́ a" and language_id.letters_only("́̂ 1") == ""
    model = language_id.Model({"hi": "हिन्दी में लिखा है " * 20, "mr": "मराठी मध्ये लिहिले आहे " * 20, "th": "น้ำใสไหลเย็น " * 20})
    assert model.predict(["लिखा है में", "मध्ये आहे", "น้ำเย็น", "́ 7"])[0] == ["hi", "mr", "th", "und"]
