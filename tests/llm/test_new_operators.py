"""Operators 11 to 13 against plain definitions, with nulls, repeats, long texts, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarlake.llm import importance_resampling as op13
from scholarlake.llm import source_audit as op12
from scholarlake.llm import substring_dedup as op11
from scholarlake.llm.words import numbered, pieces

SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["k1", "row", "kept_text", "runs", "n_words", "n", "p", "term", "docs", "number", "zero", "rank", "score", "weight", "found", "sums", "place", "eligible", "part", "item", "value", "out"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def sentence(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, long_shared = sentence(rng, 50), sentence(rng, 35)
    out = []
    for i in range(40):
        words = sentence(rng, rng.randrange(30, 200))
        if i % 4 == 0:
            words[10:10] = shared
        if i % 7 == 0:
            words += long_shared  # at the end, exactly one window
        if i == 9:
            words = words + words[:40] + ["z"] + words[:34]  # in itself; the last is one word short
        out.append((i, rng.choice([" ", "\n", "\t \r", "\x0b\f"]).join(words), rng.choice(["en", "fr"]), f"s{rng.randrange(4)}"))
    out += [out[3], (3, out[5][1], "en", "s9"), (None, out[6][1], None, None), (None, None, None, "s1"), (50, "", "xx", "t"), (51, None, "xx", "u"), (52, "one two", "xx", ""), (53, "é" * 3 + " Ünï \xa0x A9z", "en", "s1")]
    out += [(60, " ".join(sentence(rng, 900_000, 1 << 30)), "fr", "s0"), (61, "q" * 300_000, "en", "s2"), (62, "Ab" * 700 + " " + "Ab" * 700 + " cd", "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


# --- operator 11


def kept_by_definition(rows, width=35):
    texts = [re.findall("[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    windows = Counter(tuple(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = {j for i in range(len(t) - width + 1) if windows[tuple(t[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((r[0], len(t), len(gone), " ".join(w for j, w in enumerate(t) if j not in gone)))
    return Counter(out)


def test_covers_bring_any_two_positions_together():
    for period, cover in op11.COVERS.items():
        assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize("period", [7, 13])
def test_substrings_by_definition(docs, rows, period):
    short = [r for r in rows if r[0] != 60] if period == 7 else rows
    at = docs.filter("doc_id is null or doc_id <> 60") if period == 7 else docs
    got = op11.dedup_substrings(clashing(at), period=period)
    assert set(CLASHES) - {"kept_text", "n_words"} < set(got.columns)
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect())
    want = kept_by_definition(short)
    assert found == want and sum(r[2] for r in want) > 500


def test_other_widths(docs, rows):
    at = docs.filter("doc_id <> 60 and doc_id <> 61")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in op11.dedup_substrings(at, width=8, period=7).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == kept_by_definition([r for r in rows if r[0] is not None and r[0] not in (60, 61)], 8)


def test_dealt_entries_come_back(monkeypatch):
    """What a task finds twice goes once to its bin, and its positions pass through."""
    monkeypatch.setattr(op11, "FLUSH", 50)
    main = np.array([5, 7, 5, 9, 7, 5], np.uint64)
    dealer = op11.Dealer(4, "<u8")
    batches = [*dealer.add(main, main, np.arange(6) // 2, np.zeros(6, np.int64), np.arange(6)), *dealer.flush()]
    rows_ = [r for b in batches for r in b.to_pylist()]
    assert sorted(x for r in rows_ if r["hashes"] for x in np.frombuffer(r["hashes"], "<u8")) == [5, 7, 9]
    assert [r["positions"] for r in rows_ if r["hashes"] is None] == [[0, 1, 2, 4, 5]]
    assert [r["positions"] for r in rows_ if r["hashes"] and r["positions"]] == [[3]]


def test_runs():
    import pandas as pd

    (got,) = op11.covered_runs(pd.Series([np.array([3, 40, 4, 90, 3])]), 35)
    assert got.tolist() == [3, 39, 40, 75, 90, 125]  # word 39 is in no window


# --- operator 12


def audit_by_definition(rows, least=3, top=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if held[t] >= least)
        size = lambda c: sum(c.values()) + len(kept)
        p = {s: {t: 1 + 10**9 * (counts[s][t] + 1) // size(counts[s]) for t in kept} for s in {d[1] for d in own}}
        all_ = sum(counts.values(), Counter())
        q = {t: 1 + 10**9 * (all_[t] + 1) // size(all_) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in p:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found))
    return out


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_audit_by_definition(docs, rows, cells, monkeypatch):
    monkeypatch.setattr(op12, "CELLS", cells)
    some = [r for r in rows if r[0] != 60]
    got = op12.source_divergence(clashing(docs.filter("doc_id is null or doc_id <> 60")), top=20)
    assert Counter(map(tuple, got.collect())) == audit_by_definition(some, top=20)


def test_trees_add_each_correction_once(spark):
    """Rows with shared prefixes, repeated rows, and rows that are prefixes of others."""
    rng = random.Random(3)
    zero = [2, 3, 5, 7, 4]
    paths = [[(k, rng.choice([11, 12]) * zero[k], zero[k]) for k in range(5) if rng.random() < 0.6] for _ in range(60)]
    counted = Counter(tuple(p) for p in paths if p)
    df = spark.createDataFrame([("en", list(p), n) for p, n in counted.items()], "lang string, path array<struct<number:long,p:long,zero:long>>, copies long").orderBy("lang", "path")
    got = Counter()
    for r in op12.pair_corrections(df).collect():
        got[r.a, r.b] += r.value
    f, want = (lambda x, y: (x - y) ** 2 // y), Counter()
    for path, n in counted.items():
        for a, p, z in path:
            for b, q, y in path:
                if a != b:
                    want[a, b] += n * (f(p, q) - f(p, y) - f(z, q) + f(z, y))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_shares_beyond_64_bits(spark):
    n, m = 10**15, 10**16 + 7
    row = spark.range(1).select(op12.share(F.lit(n), F.lit(m)).alias("p"), op12.share(F.lit(0), F.lit(1)).alias("one")).first()
    assert (row.p, row.one) == (1 + 10**9 * (n + 1) // m, 10**9 + 1)


# --- operator 13


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: b.replace(b" ", b"_")) | st.integers(200, 1400).map(lambda n: bytes(97 + (7 * k + n) % 26 for k in range(n))), min_size=1, max_size=8))
def test_crcs(words):
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(words) + b" ", np.uint8)
    none = np.full(len(words), -1)
    assert op13.crcs(buffer, starts, sizes, none, none).tolist() == [zlib.crc32(w) for w in words]
    turned = np.roll(np.arange(len(words)), 1)
    got = op13.crcs(buffer, starts, sizes, starts[turned], sizes[turned]).tolist()
    assert got == [zlib.crc32(w + b" " + words[k]) for w, k in zip(words, turned, strict=True)]


def draw_by_definition(rows, target, buckets=10_000, seed=7, share=25):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])

    found = [features(r[1]) for r in rows]
    s, t = sum((f for _, f in found), Counter()), sum((features(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for r, (n, f) in zip(rows, found, strict=True):
        total = sum(f.values())
        weight = sum(k * gain(b) for b, k in f.items()) // total if total else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], total, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    drawn = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = len(drawn) * share // 100
    ranked = {id(x): i + 1 for i, x in enumerate(drawn[:k])}
    return Counter((*x[:4], ranked.get(id(x))) for x in out)


def test_draw_by_definition(spark, docs, rows):
    target = [rows[4][1], None, "", "w1 w2 w3 W4 w5"]
    got = op13.resample(clashing(docs), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == draw_by_definition(rows, target)


def test_places_are_gapless(spark):
    df = spark.range(10_000).select((F.col("id") % 37).alias("score"), F.col("id").alias("doc_id")).repartition(5)
    got = [r.place for r in op13.numbered_in_order(df, F.desc("score"), "doc_id").orderBy(F.desc("score"), "doc_id").collect()]
    assert got == list(range(1, 10_001))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert op11.dedup_substrings(none).count() == op12.source_divergence(none).count() == op13.resample(none, none).count() == 0
    held = docs.filter("doc_id < 30")  # 30 documents of at least 30 words and two repeated ids
    assert held.count() == 32 and op13.resample(held, none).filter("rank is not null").count() == 8


def test_words_of_pieces():
    import pyarrow as pa

    text = " ".join(f"a{i}" for i in range(500_000))
    assert b"".join(pieces(text.encode())) == text.encode() and len(list(pieces(text.encode()))) == 4
    numbers, lengths, words = numbered(pa.array([text, None, "", "a1  a2"]), op11.WORD_BYTES)
    assert lengths.tolist() == [500_000, 0, 0, 2] and [words[k] for k in numbers[-2:]] == [b"a1", b"a2"]
