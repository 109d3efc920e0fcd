"""Rows, letters, pages and words that an earlier round left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlake.llm import html_extraction, language_id, ngram_join, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


def test_rows_without_an_own_id_stay(spark):
    import corpus_pipeline

    a, b, c, d = map(prose, range(4))
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, near), (None, d), (None, d), (None, prose(5)), (4, None), (4, None), (None, ""), (None, "")]
    stages = dict(corpus_pipeline.STAGES)
    out = stages["ngram_join"](spark, frame(spark, rows), "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, d), (None, prose(5)), (4, None), (None, ""), (None, "")], key=str)
    # every row of a repeated or null id is mixed for itself
    pool = [(7, prose(k)) for k in range(10, 20)] + [(None, prose(k)) for k in range(20, 30)]
    mixed = stages["mixing"](spark, frame(spark, pool), "").collect()
    taken = {t: sum(r.text == t for r in mixed) for _, t in pool}
    assert len(mixed) == sum(taken.values()) == 30 and set(taken.values()) == {1, 2} or set(taken.values()) == {0, 1, 2}
    assert {r.doc_id for r in mixed} == {7, None}


def test_links_of_different_texts_under_one_id(spark):
    a, b = prose(1), prose(2)
    other = lambda t: " ".join([*t.split()[:-1], "changed"])
    df = spark.createDataFrame([(1, a), (1, b), (2, other(a)), (3, other(b))], "doc_id long, text string")
    out = ngram_join.ngram_join(df).collect()
    assert [r.n_links for r in out] == [1] * 4 and {r.class_id for r in out} == {1}


def test_letters_of_all_scripts_and_all_languages(spark):
    rng = random.Random(4)
    ranges = {"el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x628, 19), "zh": (0x4E00, 900), "zz": (0x5E00, 900)}
    texts = {}
    for k, (first, n) in ranges.items():
        words = ["".join(chr(first + rng.randrange(n)) for _ in range(3)) for _ in range(400)]
        texts[k] = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    for k in range(70):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(20)]
        texts[f"x{k:02}"] = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)]
    rows = [(n, t, k) for n, (t, k) in enumerate((t, k) for k in sorted(texts) for t in texts[k])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    out = {r.doc_id: r.lang_pred for r in language_id.predict_language(df, model).collect()}
    assert model.languages == sorted(texts) and all(out[n] == k for n, _, k in rows)
    # rare letters by definition of phrases, with a small dense table
    small = {"aa": "abcabdefgab", "bb": "xyzabgh"}
    model = language_id.Model(small, letters=2)
    for text in ("abcd", "gabxyz", "efgabq", "hgfedcba", "zabgha"):
        for g, known in enumerate(small.values()):
            n, at = 0, 0
            while at < len(text):
                k = at + 1
                while k < len(text) and text[at : k + 1] in known:
                    k += 1
                n, at = n + 1, k
            assert model.phrases([model.encode(text)])[0, g] == n


LONG = "This is a paragraph of the article with quite enough words in it to count as content of the page."


@pytest.mark.parametrize("name", ['class="layout has-sidebar"', 'id="page-with-comments"'])
def test_marked_wrappers_keep_their_text(name):
    boxes = f'<div class="sidebar">Side box</div><div id="comments"><article class="comment">{LONG[::-1]}</article></div>'
    page = f"<body><div {name}><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></article>{boxes}</div></body>"
    want = f"Head\n{LONG}\n{LONG}\nEnd."
    assert html_extraction.main_text(page) == want
    assert html_extraction.main_text(page.replace("<body>", "<body><main>")) == want
    plain = f"<body><div {name}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p><div class='sidebar'>Side</div></div></body>"
    assert html_extraction.main_text(plain) == want
    teasers = f"<main><article><p>{LONG}</p><p>{LONG}</p></article><div class='related'><article>Another one</article></div></main>"
    assert html_extraction.main_text(teasers) == f"{LONG}\n{LONG}"


def test_blocks_at_the_edges_of_a_region_stay():
    page = f"<body><div><h2><a>A</a><a>B</a></h2><h2><a>T</a></h2><h2>U</h2>{f'<p>{LONG}</p>' * 3}<h2><i>x</i></h2><h2><i>y</i></h2><h2><i>z</i></h2></div></body>"
    assert html_extraction.main_text(page) == "\n".join(["AB", "T", "U", LONG, LONG, LONG, "x", "y", "z"])
