"""Neighbours by prefixes: recall and share of rows ranked, ties, few rows, large components, hot prefixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlake.llm import ann_forest

SCHEMA = "vec_id long, embedding array<double>"
def query():
    return F.col("vec_id") % 20 == 0


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA).repartition(4)


def exact(v, q, k=5):
    n = v / np.abs(v).max(1)[:, None]
    n = n / np.linalg.norm(n, axis=1)[:, None]
    s = n @ n[q]
    return [i for i in sorted(range(len(v)), key=lambda i: (-round(s[i], 12), i)) if i != q][:k]


def test_recall_and_share(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 32))
    v = centres[rng.integers(0, 60, 4000)] + 0.7 * rng.standard_normal((4000, 32))
    seen, real = [], ann_forest.cosines
    monkeypatch.setattr(ann_forest, "cosines", lambda pairs: (seen.append(pairs), real(pairs))[1])
    out = ann_forest.nearest(frame(spark, v), query()).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r)
    hit = sum(len(set(exact(v, q)) & {r.vec_id for r in found[q]}) for q in range(0, 4000, 20))
    assert hit >= 0.9 * 5 * 200 and seen[0].count() <= 0.25 * 200 * 4000


def test_few_rows_and_ties(spark):
    assert [(r.rank, r.vec_id) for r in ann_forest.nearest(frame(spark, [[1, 0], [0, 1], [-1, 0.5]]), F.col("vec_id") == 0).collect()] == [(1, 1), (2, 2)]
    assert ann_forest.nearest(frame(spark, [[1, 0]]), query()).count() == 0
    # many copies and copies scaled by powers of two: ties go to the smaller id
    v = [[1.0, 2.0, 3.0]] * 30 + [[4.0, 8.0, 12.0]] * 30 + [[3.0, 2.0, 1.0]]
    out = ann_forest.nearest(frame(spark, v), F.col("vec_id").isin(0, 29, 60)).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 29, 60)}
    assert got == {0: [1, 2, 3, 4, 5], 29: [0, 1, 2, 3, 4], 60: [0, 1, 2, 3, 4]}


def test_large_components_do_not_overflow(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, 8))
    v[0] *= 1e200
    v[40] *= 1e-200
    out = ann_forest.nearest(frame(spark, v), query(), hits=10**9).collect()  # every row is ranked
    for q in (0, 40):
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in got] == exact(v, q) and got[0].score == pytest.approx(max(np.dot(v[i] / np.abs(v[i]).max(), v[q] / np.abs(v[q]).max()) / (np.linalg.norm(v[i] / np.abs(v[i]).max()) * np.linalg.norm(v[q] / np.abs(v[q]).max())) for i in range(200) if i != q))


def test_hot_prefixes_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.ones((300, 16)) + 1e-4 * rng.standard_normal((300, 16))
    want = sorted(map(str, ann_forest.nearest(frame(spark, v), query()).collect()))
    monkeypatch.setattr(ann_forest, "HOT_PREFIX", 50)
    assert sorted(map(str, ann_forest.nearest(frame(spark, v), query()).collect())) == want


def test_pairs_are_no_rows(spark, monkeypatch):
    """Rows carry lists of queries: what is ranked is linear in the rows, pairs are the share of before, and blocks and parts change no result."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((3000, 16))
    seen, real = [], ann_forest.cosines
    monkeypatch.setattr(ann_forest, "cosines", lambda rows: (seen.append(rows), real(rows))[1])
    want = sorted(map(str, ann_forest.nearest(frame(spark, v), query()).collect()))
    pairs = seen[0].agg(F.sum(F.size("queries"))).first()[0]
    assert seen[0].count() <= 3000 + 150 and 10 * 3000 < pairs <= 0.35 * 150 * 3000
    monkeypatch.setattr(ann_forest, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(ann_forest, "PART_ROWS", 500)
    monkeypatch.setattr(ann_forest, "PAIRS", 1000)
    assert sorted(map(str, ann_forest.nearest(frame(spark, v), query()).collect())) == want and len(want) == 750


def test_no_side_is_broadcast_by_its_estimate(spark, monkeypatch):
    """Files grow some thousand times as prefixes are made of them: unless a count of rows allows it, no join of the search is a broadcast."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((1500, 16))
    v[700:] = v[3] + 1e-3 * rng.standard_normal((800, 16))  # dense rows, whose longer prefixes suffice, so that queries close at several levels
    want = sorted(map(str, ann_forest.nearest(frame(spark, v), query()).collect()))
    plans, real = [], ann_forest.materialize
    monkeypatch.setattr(ann_forest, "materialize", lambda df, name: (plans.append(df), real(df, name))[1])
    monkeypatch.setattr(ann_forest, "BROADCAST_ROWS", 1)
    out = ann_forest.nearest(frame(spark, v), query())
    text = "\n".join(df._jdf.queryExecution().sparkPlan().toString() for df in [*plans, out])
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20
    assert "SortMergeJoin" in text and "Broadcast" not in text
    assert sorted(map(str, out.collect())) == want and len(want) == 375


def test_ranking_in_pieces(spark, monkeypatch):
    """More blocks and parts where there are many pairs, and the best compared piece by piece: the same rows, ties included."""
    rng = np.random.default_rng(13)
    v = rng.integers(-1, 2, (1200, 6)).astype(float)  # many equal cosines
    v[0] = 1
    v[(v == 0).all(1)] = 1
    out = ann_forest.nearest(frame(spark, v), query(), hits=10**9).collect()  # every row is ranked
    want = sorted(map(str, out))
    assert len(want) == 300 and all([r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == sorted((r.vec_id for r in out if r.query_id == q), key=lambda i: (-next(r.score for r in out if r.query_id == q and r.vec_id == i), i)) for q in (0, 20, 1180))
    for name, value in (("PAIRS", 7), ("PART_PAIRS", 2000), ("BLOCK_HITS", 500)):
        monkeypatch.setattr(ann_forest, name, value)
    assert sorted(map(str, ann_forest.nearest(frame(spark, v), query(), hits=10**9).collect())) == want
