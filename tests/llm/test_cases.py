"""Clashing names, empty tables, null and repeated ids, very long texts: every operator and every stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholarlake.llm import (
    ann_forest, html_extraction, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, toxicity,
)

NAMES = (
    "n_words n_upper x0 m0 p0_0 key keys n_lines kept_text n_dropped positions text_hash h1 row copies copy class band bucket seq1 grams node "
    "queue block base path n_tokens ids size target rank score label features dense _id _copies _copy _text _row _own_row _drop_id Row KEPT distance"
).split()
WORDS = [a + b + c for a in ("ba", "ko", "li") for b in ("tu", "re", "ni") for c in ("s", "m", "lo", "da")]


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    shared = "a line of over forty characters that many documents hold alike"
    out = [(i, f"{text(i, 40)}\n{shared}\n{text(i + 500, 30)}", "en", f"s{i % 3}") for i in range(30)]
    out += [(3, out[3][1], "en", "s0"), (3, text(900, 60), "en", "s0"), (None, text(901, 60), None, None), (None, text(902, 60), None, None)]
    return out + [(40, None, "en", "s1"), (41, "", "en", "s1"), (42, text(903, 60_000), "en", "s2"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.repartition(3).cache()


def with_clashes(df):
    return df.select("*", *[F.lit(n).alias(n) for n in NAMES if n.lower() not in {"row", "kept"}], F.lit("r").alias("Row"), F.lit("k").alias("KEPT"))


def values(df, columns):
    return Counter(map(str, df.select(*columns).collect()))


def test_stages_with_clashing_names(spark, docs):
    plain, extra, names = docs, with_clashes(docs), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = corpus_pipeline.materialize(stage(spark, plain, ""), "plain")
        extra = corpus_pipeline.materialize(stage(spark, extra, ""), "extra")
        assert plain.columns == docs.columns and extra.columns == with_clashes(docs).columns
        assert values(extra, docs.columns) == values(plain, docs.columns) and plain.count() > 20
        names = {n for r in extra.select(*extra.columns[len(docs.columns) :]).distinct().collect() for n in r}
        assert names == {*(n for n in NAMES if n not in ("row", "Row", "KEPT")), "r", "k"}
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, "")
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().count() * 0 + packed.agg(F.sum("length")).first()[0]
    held = values(plain, ["doc_id", "text"])
    assert any("None" in k for k in held)  # rows with a null id take part to the end


def test_stages_on_an_empty_table(spark, docs):
    at = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, ""), "empty")
        assert at.count() == 0


def test_operators_with_clashing_names(spark, docs):
    extra = with_clashes(docs)
    for run, columns in (
        (lambda d: quality_rules.judge(d), ["doc_id", "n_words", "n_dup_lines", "n_repeat_words", "kept"]),
        (lambda d: line_dedup.dedup_lines(d), ["doc_id", "kept_text", "n_lines", "n_dropped"]),
        (lambda d: ngram_join.ngram_join(d), ["doc_id", "class_id", "n_links"]),
        (lambda d: mixing.mix(d), ["doc_id", "size", "source_size", "copies"]),
    ):
        assert values(run(extra), columns) == values(run(docs), columns)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality_classifier.fit, quality_classifier.score_quality), (toxicity.fit, lambda d, m: m.score(d))):
        out = score(extra, fit(extra, with_clashes(labels))).collect()
        assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    out = language_id.predict_language(extra, language_id.fit(extra)).collect()
    assert {r.lang_pred for r in out} == {"en", "und"} and len(out) == len(rows())
    assert packing.pack(extra, packing.default_tokenizer()).select("doc_id", "doc_tokens").distinct().count() >= 34


def test_empty_tables(spark, docs):
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score_quality(none, quality_classifier.fit(none, labels)).count() == 0
    assert toxicity.fit(none, labels).score(none).count() == 0
    assert language_id.predict_language(none, language_id.fit(none)).count() == 0
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert ann_forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def mcd(x, core=0.75):
    """The estimate by its definition, in numpy: median start, steps while the determinant falls."""
    z = x / quality_rules.SCALE
    floor = np.diag(np.square(quality_rules.FLOOR))
    median = np.median(x, axis=0)
    # a double percentile of integers, like the native one
    spread = np.median(np.abs(x - median), axis=0)
    m, p, before, best = median / quality_rules.SCALE, np.diag(1 / (np.square(1.4826 * spread / quality_rules.SCALE) + np.square(quality_rules.FLOOR))), np.inf, None
    while True:
        d = np.minimum(np.round(np.einsum("ij,jk,ik->i", z - m, p, z - m) * 64), 1 << 20)
        kept = x[d <= np.percentile(d, 100 * core)]
        mean = kept.mean(0) / quality_rules.SCALE
        cov = quality_rules.CONSISTENCY * np.cov(kept.T / quality_rules.SCALE, bias=True) + floor
        now = np.linalg.slogdet(cov)[1]
        if now >= before - 1e-4:
            return best
        m, p, before, best = mean, np.linalg.inv(cov), now, (len(kept), kept.sum(0), kept.T @ kept)


def test_concentration_matches_its_definition(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.r_[rng.multivariate_normal(np.zeros(5), np.eye(5) + 0.4, 300), rng.multivariate_normal(np.full(5, 6.0), np.eye(5), 60)] * quality_rules.SCALE).astype(int)
    y = np.round(rng.standard_normal((40, 5)) * 200).astype(int)
    df = spark.createDataFrame([("g", *map(int, r)) for r in x] + [("h", *map(int, r)) for r in y], "key string, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = {r.key: r for r in quality_rules.concentrate(df).collect()}
    for key, rows_ in (("g", x), ("h", y)):
        n, first, second = mcd(rows_)
        r = got[key]
        assert r.n == n and [r[f"s{i}"] for i in range(5)] == first.tolist()
        assert all(r[f"s{i}_{j}"] == second[i, j] for i, j in quality_rules.PAIRS)


def test_kept_matches_its_definition(spark):
    rng = random.Random(8)
    data = []
    for i in range(260):
        t = "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "#"]) for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(3, 6)))
        if i % 13 == 0:
            t = t.upper().replace(" ", " ##$ ")
        data.append((i, t, "en" if i % 4 else "de", "a" if i % 3 else "b" if i % 2 else None))
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    vec = {}
    for i, t, *_ in data:
        r = out[i]
        assert r.n_symbols == sum(t.count(c) for c in quality_rules.SYMBOLS) and r.n_upper == sum(c.isupper() for c in t)
        n_lines = len([x for x in t.split("\n") if x.strip()])
        share = lambda part, whole: np.log1p(100.0 * part / max(whole, 1))
        v = [np.log(max(r.word_chars, 1) / max(r.n_words, 1)), share(r.n_symbols, r.word_chars), share(r.n_dup_lines, n_lines), share(r.n_repeat_words, r.n_words), share(r.n_upper, r.word_chars)]
        vec[i] = np.floor(np.array(v) * quality_rules.SCALE + 0.5).astype(int)
    good = [d for d in data if not out[d[0]].base_failed]
    core = {}
    for d in good:
        for k in ((), d[2:3], d[2:4]):
            core.setdefault(k, []).append(vec[d[0]])
    core = {k: mcd(np.array(v)) for k, v in core.items()}
    for i, _, lang, source in good:
        n, first, second = core[()]
        for k in ((lang,), (lang, source)):
            m = core[k]
            n, first, second = m[0] + 50, m[1] + 50 * first / n, m[2] + 50 * second / n
        mean = first / n / quality_rules.SCALE
        cov = quality_rules.CONSISTENCY * (second / n / quality_rules.SCALE**2 - np.outer(mean, mean)) + np.diag(np.square(quality_rules.FLOOR))
        z = vec[i] / quality_rules.SCALE - mean
        assert out[i].distance == pytest.approx(z @ np.linalg.inv(cov) @ z, abs=0.02)
        assert out[i].kept == (out[i].distance <= quality_rules.CUTOFF)
    assert 0 < sum(not r.kept for r in out.values()) < 60


def test_tilts_solve_the_dual(spark):
    rng = random.Random(5)
    data = [(i, text(i, rng.randint(0, 120)), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    cells = df.select("source", mixing.n_words(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = mixing.source_targets(cells, (3, 1, 2), 1.5, 2.0)
    for r in mixing.solve_tilts(cells, targets, 2.0).collect():
        sizes = np.array([len(t.split()) for _, t, s in data if s == r.source], float)
        if r.target >= 2 * sizes.sum():
            continue
        low, high = -64.0, 64.0
        for _ in range(200):  # by bisection
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * 2 / (1 + np.exp(-mid * sizes / r["mean"]))).sum() < r.target else (low, mid)
        assert r.tilt == pytest.approx(mid, abs=1e-5)


def test_mixing_takes_few_jobs_for_many_sources_and_sizes(spark):
    """10,000 sources of two documents and one of 3,000 sizes: 30 jobs at most, and what is left is below the smallest size that fits."""
    word = F.repeat(F.lit("w "), F.col("size").cast("int"))
    many = spark.range(20_000).select("id", F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("source"), (1 + F.col("id") % 7).alias("size"))
    one = spark.range(20_000, 23_000).select("id", F.lit(None).cast("string").alias("source"), (F.col("id") - 19_999).alias("size"))
    df = many.union(one).select(F.col("id").alias("doc_id"), word.alias("text"), "source")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    out = mixing.mix(df).collect()
    assert jobs() - before <= 30 and len(out) == 23_000
    by = {}
    for r in out:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for held in by.values():
        gap = round(held[0].target) - sum(r.taken for r in held)
        room = [r.size for r in held if (r.copies < 2 if gap > 0 else r.copies > 0)]
        assert gap == 0 or not room or min(room) > abs(gap)


def test_hot_lines_are_met_apart(spark, monkeypatch):
    lines = spark.range(2000).select((F.col("id") % 7).alias("h1"), F.lit(1).alias("h2"), "id")
    frequent = spark.createDataFrame([(k, 1, 280 + 10 * k, 5) for k in range(7)], "h1 long, h2 int, n long, keeper long")
    want = sorted(map(str, line_dedup.frequent_hits(lines, frequent, 7).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 6)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 300)
    assert sorted(map(str, line_dedup.frequent_hits(lines, frequent, 7).collect())) == want and len(want) == 2000


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.90: the bands find at least 0.999 of them."""
    rng = random.Random(6)
    data, pairs = [], 0
    for i in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 300))]
        v = list(w)
        for at in rng.sample(range(10, len(w) - 10), max(1, len(w) // 70)):
            v[at] = "changed" + str(i)
        a, b = set(ngram_join.shingles(" ".join(w))[0].tolist()), set(ngram_join.shingles(" ".join(v))[0].tolist())
        j = len(a & b) / len(a | b)
        if 0.8 <= j <= 0.9:
            pairs += 1
            data += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    found = ngram_join.ngram_join(spark.createDataFrame(data, "doc_id long, text string")).filter("n_links = 1").count()
    assert pairs >= 150 and found >= 0.999 * 2 * pairs


def test_hot_bands_are_met_apart(spark, docs, monkeypatch):
    want = values(ngram_join.ngram_join(docs), ["doc_id", "class_id", "n_links"])
    monkeypatch.setattr(ngram_join, "HOT_BAND", 2)
    assert values(ngram_join.ngram_join(docs), ["doc_id", "class_id", "n_links"]) == want
