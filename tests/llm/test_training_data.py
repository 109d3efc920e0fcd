"""Training-data operators against brute force, with nulls, empty texts, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarlake.llm import (
    ann_forest, html_extraction, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"  # key clashes with inner names
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice(["ba", "ko", "li", "tu", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    common = "this very line is shared by a good many documents here"
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), f"  {common.upper() if i % 8 else common}\t")
        rows.append([i, "\n".join(lines), "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None])
    rows[50][1] = rows[10][1]
    rows[11][1] = " ".join(rng.choice(words) for _ in range(100))
    w = rows[11][1].split(" ")
    rows[51][1] = " ".join([*w[:-1], "changed"])
    rows[60][1], rows[61][1], rows[62][1] = None, "", "  \n \t"
    rows[63][1] = " ".join(["again and again we say this same thing now"] * 20)
    return [(i, t, la, s, len(t or ""), "x") for i, t, la, s in rows] + [(None, "no id here at all " * 3, "en", "s1", 9, "x")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs, empty, rows):
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    assert gone
    want = {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t, *_ in rows}
    out = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.kept_text for r in out} == want and len(out) == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_ngram_join(docs, empty, rows):
    sets = {i: set(ngram_join.shingles(t)[0].tolist()) for i, t, *_ in rows if i is not None}
    links = {i: sum(j != i and bool(s) and len(s & o) >= 0.8 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    out = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    assert {i: r.n_links for i, r in out.items() if i is not None} == links
    assert out[50].class_id == 10 and out[51].class_id == 11 and out[60].class_id == 60 and out[None].class_id is None
    assert ngram_join.ngram_join(empty).count() == 0
    assert ngram_join.bands_for(0.8, 5, 0.9999) == 24


def test_large_group_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 16)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = ngram_join.ngram_join(df).collect()
    assert {r.n_links for r in out} == {69} and {r.class_id for r in out} == {0}


@pytest.mark.parametrize("options", [{}, {"blocks": 2, "block_tokens": 500}], ids=["few blocks", "blocks by tokens"])
def test_packing(docs, empty, rows, options):
    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    out = sorted(packing.pack(docs, path, seq_len=256, window_sequences=4, with_ids=True, **options).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = Counter()
    for r in out:
        assert r.offset == at[r.sequence_id] and r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at[r.sequence_id] += r.length
        want[r.doc_id] += r.length
    assert want == {i: len(x) for i, x in ids.items()}
    assert all(n == 256 for s, n in at.items() if s != max(at))
    # every stretch of the stream has its sources in the corpus's shares
    share, total = Counter(), sum(len(x) for x in ids.values())
    for i, _, _, s, *_ in rows:
        share[s] += len(ids[i])
    first = Counter()
    for r in out:
        if r.sequence_id < 4:
            first[r.source] += r.length
    for s, n in share.items():
        assert abs(first[s] - 1024 * n / total) < 40
    assert packing.pack(empty, path).count() == 0


def test_chunked_encoding_is_exact():
    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = ["ab", "Élan", "don't", "x9", "9", " ", "  ", "\n", "\n\n", "\t", "...", "!?", "&&&", "'s", "漢字", "ß", "\u3000", "-", "é", "\0", "\r"]
    texts = ["", " ", "  a", "a  b", "a \n b\n\nc ", "x   y", "tab\tx \t y", "x <|endoftext|> y", "<|endoftext|> a", "a b c", "é\n", "\n\n", "it's we'll\n's", "\r\n a\r", "　 x", "\n", "\nA b", "a\0b c", " \n x", "A\n", None]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    got, n = packing.encode_column(pa.array(texts), path, 1)
    for t, held, k in zip(texts, got, n, strict=True):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(held.as_py(), "<u2").tolist() == want and k == len(want), repr(t)
    assert tokenizer.encode("x <|endoftext|> y", add_special_tokens=False).ids[2] == 50256


def test_queues_of_many_sources(spark):
    """Every one of 300 sources has a queue: each is within a quantum of its share all along, and no place is taken twice."""
    rows = [(i, " ".join(["word"] * (20 + i % 7)), f"s{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, packing.default_tokenizer(), seq_len=1000, window_sequences=10).collect()
    total = Counter()
    for r in out:
        total[r.source] += r.length
    at = sorted((r.sequence_id * 1000 + r.offset, r.length, r.source) for r in out)
    place, served, grand = 0, Counter(), sum(total.values())
    quantum = 242 / -(-grand // 10_000)
    for p, n, s in at:
        assert p == place and abs(served[s] - total[s] * p / grand) <= quantum + 3  # never more than a quantum off
        place, served[s] = place + n, served[s] + n
    assert place == grand


def test_given_shares_and_dry_queues(spark):
    rows = [(i, " ".join(["word"] * 99), "big" if i % 10 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, packing.default_tokenizer(), seq_len=500, window_sequences=4, shares={"big": 3, "small": 1}).collect()
    first = Counter()
    for r in out:
        first[r.source] += r.length * (r.sequence_id < 8)
    assert abs(first["small"] - 1000) <= 3 and sum(r.length for r in out) == 400 * 100
    at = sorted((r.sequence_id * 500 + r.offset, r.length) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))


def test_quality_rules(docs, empty, rows):
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in out.values()) > 90
    assert quality_rules.judge(empty).count() == 0


def test_covariance_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.multivariate_normal(np.zeros(5), np.eye(5) + 0.5, 400) * quality_rules.SCALE * 3).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "key string, x0 long, x1 long, x2 long, x3 long, x4 long")
    fit = quality_rules.estimates(df, core=1.0, steps=1).first()
    cov = np.cov(x.T / quality_rules.SCALE, bias=True) * quality_rules.CONSISTENCY + np.diag(np.square(quality_rules.FLOOR))
    inv = np.linalg.inv(cov)
    assert all(abs(fit[f"p{i}_{j}"] - inv[i, j]) < 1e-6 for i, j in quality_rules.PAIRS)


def test_mixing(docs, empty, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:  # share, stop, share the excess again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in out:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in names)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var x="</p>"</script></head><body><nav><a href=/>Menu entry</a></nav><div class="cookie-notice">We use
    cookies</div><article><h1>Head &amp; line</h1><p><b>First para with enough words to count as content.<br><p>Second\n para of the <i>article</i> body, long enough too.</p>
    <p>Short.</p><section id="comments"><p>Reader says no.</p></section></article><aside>Side</aside><footer>Foot</footer>"""
    assert html_extraction.main_text(page) == "Head & line\nFirst para with enough words to count as content.\nSecond para of the article body, long enough too.\nShort."
    assert html_extraction.main_text(None) == html_extraction.main_text("") == ""
    assert html_extraction.main_text("just text </p></div> <p") .startswith("just text")


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 16))
    v[7] = v[3]
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] + [1.0] * 15, "x"), (903, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (904, [1.0] * 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = ann_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    n = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 20):
        s = n @ n[q]
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-s[i], i))[:5]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in got)
        hit += len(set(best) & {r.vec_id for r in got})
    assert hit >= 0.9 * 150
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_language(spark):
    rng = random.Random(1)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "pe", "xi"]}
    rows = [(i, make(kinds[k], 40), k) for i, k in enumerate(["aa", "bb"] * 30)] + [(100, None, "aa"), (101, "12 !! 3", "bb"), (102, make(kinds["bb"], 2000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict_language(df, language_id.fit(df)).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:60]) and out[102].lang_pred == "bb"
    assert (out[100].lang_pred, out[100].score, out[101].lang_pred) == ("und", 0.0, "und")
    assert language_id.predict_language(df, language_id.fit(df.limit(0))).first().lang_pred == "und"
    # phrases by definition
    model = language_id.Model({"aa": "abcabd", "bb": "xyz"})
    for text in ("abcd", "abdabc", "xyab", "q", "aqb"):
        for g, known in enumerate(("abcabd", "xyz")):
            n, at = 0, 0
            while at < len(text):
                k = at + 1
                while k < len(text) and text[at : k + 1] in known:
                    k += 1
                n, at = n + 1, k
            assert model.phrases([model.encode(text)])[0, g] == n


def test_language_sample_is_the_first_by_hash(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "concat('w', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "if(id % 10 = 0, 'bb', 'aa') AS lang")
    hashed = sorted(df.selectExpr("xxhash64(doc_id) AS h", "text", "lang").collect(), key=lambda r: r.h)
    texts = {k: " " + " ".join([r.text for r in hashed if r.lang == k][:5]) for k in ("aa", "bb")}
    model, want = language_id.fit(df, sample_docs=5), language_id.Model(texts)
    assert model.codes == want.codes and model.roots == want.roots and np.array_equal(model.table, want.table)


def test_classifiers(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    good = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(rng.choice(words).upper() + "!!" for _ in range(12)) for _ in range(4))
    rows = [(i, bad() if i % 3 == 0 else good() + (" you idiot vexo" if i % 4 == 0 else "")) for i in range(240)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0 and i % 3 != 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_classifier.score_quality(docs, quality_classifier.fit(docs, labels)).collect()}
    assert all(out[i].predicted == int(i % 3 != 0) for i in range(200, 240)) and 0 <= out[901].score <= 1 and len(out) == len(rows)
    out = {r.doc_id: r for r in toxicity.fit(docs, labels).score(docs).collect()}
    assert all(out[i].predicted == int(i % 4 == 0 and i % 3 != 0) for i in range(200, 240)) and 0 <= out[900].score <= 1
    none = labels.limit(0)
    assert quality_classifier.score_quality(docs, quality_classifier.fit(docs, none)).first().score == 0.5
    assert toxicity.fit(docs, none).score(docs).first().score == 0.5


def test_marginals_match_enumeration():
    model = quality_classifier.LineField(np.zeros((quality_classifier.MEASURES, 7)), 0.5)
    model.pull = np.array([0.7, 1.1])
    unary, counts = np.array([0.3, -1.0, 0.5, 2.0]), np.array([3, 1])
    p, _, _ = model.marginals(unary, counts)
    total, good = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        w = np.exp(np.dot(y, unary[:3]) + sum(model.pull[a] for a, b in zip(y, y[1:]) if a == b))
        total += w
        good += w * np.array(y)
    assert p[:3] == pytest.approx(good / total) and p[3] == pytest.approx(1 / (1 + np.exp(-2)))


def test_pipeline(spark, docs):
    import corpus_pipeline

    at, frames = docs.filter("doc_id is not null"), []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, ""), f"test-{name}")
        frames.append(at)
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept = {r.doc_id for r in frames[2].collect()}
    assert not {50, 51, 60, 61, 62, 63} & kept and {10, 11} <= kept
    assert all(r.n_chars == len(r.text) for r in frames[2].filter("doc_id % 4 = 0").collect())
    assert frames[4].select("doc_id").distinct().count() == frames[3].select("doc_id").distinct().count()
