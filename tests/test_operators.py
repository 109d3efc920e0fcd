"""Array, search and edge forms of the operators against plain definitions, and the plans that they promise."""

import json
import random
import re
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from scholarlake.functions.storage import store
from scholarlake.operators import authors, publications, refresh, resolution, serving, temporal
from scholarlake.sources import documents

PUBS = "scholar_id string, author_pub_id string, pub_year long, title string, author string, citation string, num_citations long, cites_per_year string, url_related_articles string, timestamp timestamp"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Keys of the hash exchanges of a plan."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan_of(df)))


def publication_rows(spark, seed=1, n=40):
    rng, rows = random.Random(seed), []
    for i in range(n):
        year = rng.choice([None, *range(1990, 2024)])
        cites = {rng.choice([str(rng.randrange(1980, 2030)), f" {rng.randrange(1990, 2025)}", "n/a"]): rng.choice([rng.randrange(9), str(rng.randrange(9)), None, {"x": 1}]) for _ in range(rng.randrange(40))}
        rows.append((f"A{i % 5}", f"A{i % 5}:p{i}", year, None, None, None, 3, rng.choice([json.dumps(cites)] * 9 + [None, "{broken"]), None, None))
    return spark.createDataFrame(rows, PUBS), rows


def test_series_by_definition(spark):
    df, rows = publication_rows(spark)
    got = {r.author_pub_id: [tuple(s) for s in r.series] for r in publications.citation_series(df, 2022).collect()}
    want = {}
    for r in rows:
        if r[2] is None or r[2] > 2022:
            continue
        per = Counter()
        try:
            cites = json.loads(r[7]) if r[7] else {}
        except ValueError:
            cites = {}
        for k, v in cites.items():
            if k.strip().isdigit() and not isinstance(v, dict):
                per[int(k)] += int(v or 0)
        years = [per[y] for y in range(r[2], 2023)]
        want[r[1]] = [(n, sum(years[: i + 1]), sum(years[max(0, i - 4) : i + 1])) for i, n in enumerate(years)]
    assert got == want and any(s for s in want.values())


def test_series_needs_no_exchange(spark):
    df, _ = publication_rows(spark)
    assert "Exchange" not in plan_of(publications.citation_timeline(df, 2022))


def listed_series(spark):
    """Publications listed once to three times, under different years too, and their series."""
    df, rows = publication_rows(spark, 2)
    series = publications.citation_series(df, 2022).cache()
    listed = [(r[0], r[1], r[2] + k % 2) for i, r in enumerate(rows) if r[2] is not None for k in range(1 + (i % 4 == 0) + (i % 8 == 0))]
    listed = spark.createDataFrame([*listed, ("A1", "A9:none", 2000)], "scholar_id string, author_pub_id string, pub_year long")
    return listed, series


def states(spark):
    """Both forms of the state."""
    listed, series = listed_series(spark)
    return temporal.publication_states(listed, series), temporal.publication_state(listed, publications.timeline_of(series))


def test_states_from_arrays_equal_those_from_rows(spark):
    arrays, rows = states(spark)
    columns = ["scholar_id", "author_pub_id", "pub_year", "state_year", "yearly_citations_at_state_year", "cumulative_citations_at_state_year"]
    count = lambda df, c: Counter(map(tuple, df.select(*c).collect()))
    assert count(arrays, columns) == count(rows, columns)
    recent = ["scholar_id", "author_pub_id", "state_year", "citations_last_5_years"]
    assert count(arrays, recent) == count(temporal.recent_citations(rows), recent)
    first = spark.createDataFrame([("A1", 1999)], "scholar_id string, year_of_first_pub long")
    a, b = (temporal.temporal_metrics(s, first) for s in (arrays, rows))
    assert count(a, a.columns) == count(b, a.columns) and a.count() > 50
    for f in (temporal.yearly_totals, temporal.recent_totals):
        assert count(f(arrays), f(arrays).columns) == count(f(rows), f(arrays).columns)


def test_totals_by_definition(spark):
    """k listings give k rows, sums over k x k of them, and publications count once."""
    arrays, rows = states(spark)
    got = {(r.scholar_id, r.state_year): r for r in temporal.yearly_totals(arrays).collect()}
    groups = defaultdict(list)
    for r in temporal.recent_citations(rows).collect():
        groups[r.scholar_id, r.state_year].append(r)
    for key, held in groups.items():
        copies, c, r5 = Counter(r.author_pub_id for r in held), "cumulative_citations_at_state_year", "citations_last_5_years"
        t = got[key]
        assert t.total_publications == len(copies) and t.total_citations == sum(r[c] * copies[r.author_pub_id] for r in held)
        assert t.i10_index == len({r.author_pub_id for r in held if r[c] >= 10}) and t.i10_index_5y == len({r.author_pub_id for r in held if r[r5] >= 10})


def test_one_exchange_of_states_and_no_lists(spark):
    arrays, _ = states(spark)
    first = spark.createDataFrame([("A1", 1999)], "scholar_id string, year_of_first_pub long")
    metrics = temporal.temporal_metrics(store(arrays), first)
    assert sum("state_year" in e for e in exchanges(metrics)) == 1
    assert "collect_list" not in plan_of(metrics) and "collect_set" not in plan_of(metrics)


def test_heavy_authors_by_counts(spark):
    listed, series = listed_series(spark)
    first = spark.createDataFrame([("A1", 1999)], "scholar_id string, year_of_first_pub long")
    per = Counter(r.scholar_id for r in listed.collect())
    most = sorted(per.values())[2]
    heavy = temporal.heavy_authors(listed, most)
    assert {r.scholar_id for r in heavy.collect()} == {a for a, n in per.items() if n > most} and 0 < heavy.count() < 5
    assert temporal.heavy_authors(listed, 10**6) is None and temporal.heavy_authors(listed.limit(0), 1) is None
    rows = lambda df: Counter(map(str, df.select(*sorted(df.columns)).collect()))
    want, got = (temporal.metrics_of_listings(listed, series, first, h) for h in (None, heavy))
    assert rows(got) == rows(want) and want.count() > 50
    light, apart = temporal.publication_states_apart(listed, series, heavy)
    assert rows(light.unionByName(apart)) == rows(temporal.publication_states(listed, series))


def test_a_heavy_author_is_dealt_over_tasks(spark):
    """Figures of one author of 20,000 publications by hand, and counts before every exchange."""
    state = spark.range(20_000).select(
        F.lit("A").alias("scholar_id"), F.col("id").cast("string").alias("author_pub_id"), F.lit(2020).cast("long").alias("state_year"), F.lit(1).cast("long").alias("yearly_citations_at_state_year"),
        (F.col("id") % 50).alias("cumulative_citations_at_state_year"), (F.col("id") % 20).alias("citations_last_5_years"), F.lit(0).alias("copy"), F.lit(1).alias("copies"), (F.col("id") % 20).alias("most_recent"),
    )
    first = spark.createDataFrame([("A", 1999)], "scholar_id string, year_of_first_pub long")
    metrics = temporal.counted_metrics(state, first)
    row = metrics.first()
    assert (row.h_index, row.h_index_5y, row.total_publications, row.i10_index, row.i10_index_5y) == (49, 19, 20_000, 16_000, 10_000)
    # only rows that a partial aggregation has combined are exchanged: counts by value first, by author-year after
    h = temporal.h_indices(store(state), {"h_index": "cumulative_citations_at_state_year"})
    keys = exchanges(h)
    assert all("state_year" in e for e in keys) and "_v" in keys[-1] and "partial_count" in plan_of(h).split("hashpartitioning")[-1]


def curve_and_ranks(spark, seed):
    rng = random.Random(seed)
    points = [(2000 + c, n, rng.random()) for c in range(6) for n in sorted(rng.sample(range(60), rng.randrange(1, 25)))]
    curve = spark.createDataFrame([*points, (None, 3, 0.5)], f"{authors.COHORT} long, {authors.COUNTS[1]} long, {authors.COUNTS[1]}_percentile double")
    rows = [(f"A{i % 9}", f"p{i}", 1, 0.5, 1 + rng.randrange(70), rng.choice([None, *range(1999, 2007)])) for i in range(400)]
    return curve, spark.createDataFrame(rows, f"scholar_id string, author_pub_id string, num_citations long, num_citations_percentile double, publication_rank long, {authors.COHORT} long")


def test_searched_curves_equal_all_pairs(spark):
    for seed in (1, 2):
        curve, ranked = curve_and_ranks(spark, seed)
        got, want = ({r.author_pub_id: r.num_papers_percentile for r in authors.pip_inputs(ranked, curve, m).collect()} for m in ("dense", "literal"))
        assert got == want and len(got) > 100


def test_curves_are_searched_without_a_shuffle(spark, monkeypatch):
    curve, ranked = curve_and_ranks(spark, 3)
    assert "hashpartitioning" not in plan_of(authors.pip_inputs(ranked, curve)) and "BroadcastHashJoin" in plan_of(authors.pip_inputs(ranked, curve))
    want = sorted(authors.pip_inputs(ranked, curve).collect())
    monkeypatch.setattr(authors, "BROADCAST_POINTS", 0)
    assert sorted(authors.pip_inputs(ranked, curve).collect()) == want


def resolved_by_definition(resolved, named, edges):
    known, out = defaultdict(set), {}
    for paper, _, _, who, _ in resolved:
        known[paper] |= {who} - {None}
    for paper, position, name, who, method in resolved:
        found = {a for a, n in named if n == name and any((a, k) in edges for k in known[paper])}
        out[paper, position] = (who, method) if who else (*found, "coauthor") if len(found) == 1 else (None, method)
    return out


def test_resolution_by_coauthor(spark):
    for seed in range(4):
        rng = random.Random(seed)
        named = [(f"S{i}", f"N{i % rng.choice([3, 12])}") for i in range(60)]
        edges = {(f"S{rng.randrange(60)}", rng.choice(["S1", f"S{rng.randrange(60)}"])) for _ in range(150)}
        rows = [(f"P{i // 4}", i % 4, *rng.choice([("known", f"S{rng.randrange(6)}", "local_exact"), (f"N{rng.randrange(12)}", None, "unresolved")])) for i in range(120)]
        got = resolution.resolve_by_coauthor(
            spark.createDataFrame(rows, "author_pub_id string, position long, name string, scholar_id string, method string"), spark.createDataFrame(named, "scholar_id string, name string"),
            spark.createDataFrame([*edges, *list(edges)[:5]], "primary_scholar_id string, coauthor_scholar_id string"),
        )
        assert {(r.author_pub_id, r.position): (r.scholar_id, r.method) for r in got.collect()} == resolved_by_definition(rows, named, edges)


def test_heavy_names_and_heavy_authors_are_not_expanded(spark):
    """A name of 10,000 bearers beside an author whom 3 list, and an author whom 10,000 list beside a name of 3 bearers."""
    named = spark.range(10_000).select(F.concat(F.lit("H"), F.col("id")).alias("scholar_id"), F.lit("heavy").alias("name")).union(spark.createDataFrame([(f"L{i}", "light") for i in range(3)], "scholar_id string, name string"))
    edges = named.select(F.col("scholar_id").alias("primary_scholar_id"), F.lit("K1").alias("coauthor_scholar_id")).filter("name = 'heavy' or primary_scholar_id = 'L2'")
    edges = edges.unionByName(spark.createDataFrame([("H5", "K2"), ("L0", "K2"), ("X", "K2")], "primary_scholar_id string, coauthor_scholar_id string"))
    open_ = spark.createDataFrame([("P1", 0, "heavy"), ("P2", 0, "light")], "author_pub_id string, position long, name string")
    done = spark.createDataFrame([("P1", "K2"), ("P2", "K1")], "author_pub_id string, known string")
    by_edge, by_name = resolution.coauthor_candidates(open_, done, named, edges)
    assert by_edge.count() + by_name.count() <= 6
    resolved = open_.withColumns({"scholar_id": F.lit(None).cast("string"), "method": F.lit("unresolved")}).unionByName(done.select("author_pub_id", F.lit(1).cast("long").alias("position"), F.lit("k").alias("name"), F.col("known").alias("scholar_id"), F.lit("local_exact").alias("method")))
    assert {(r.author_pub_id, r.name): r.scholar_id for r in resolution.resolve_by_coauthor(resolved, named, edges).collect()} == {("P1", "heavy"): "H5", ("P2", "light"): "L2", ("P1", "k"): "K2", ("P2", "k"): "K1"}


def test_lenient_decoding(spark):
    raw = spark.createDataFrame([("a", None, json.dumps({"data": {"scholar_id": "a", "hindex": "many", "citedby": "7"}}))], "document_id string, timestamp timestamp, data string")
    (row,) = documents.decode_authors(raw, strict=False).collect()
    assert (row.hindex, row.citedby) == (None, 7)
    pub = spark.createDataFrame([("a", None, json.dumps({"data": {"author_pub_id": "a:b:c", "bib": {"pub_year": "n.d."}, "num_citations": 2}}))], "document_id string, timestamp timestamp, data string")
    (row,) = documents.decode_publications(pub, strict=False).collect()
    assert (row.scholar_id, row.pub_year, row.num_citations) == ("a", None, 2)


def test_worklists(spark):
    day = lambda d: datetime(2024, 1, d)
    docs = spark.createDataFrame([("a", "a", day(1)), ("b", None, day(2)), ("c", "c", day(3)), ("d", "", day(4))], "document_id string, scholar_id string, timestamp timestamp")
    now = F.lit(datetime(2024, 4, 2))  # 90 days after the third of January
    stale = lambda limit, truthy=False: [r.scholar_id for r in refresh.stale_documents(docs, now, 90, limit, "scholar_id", truthy).collect()]
    assert stale(9) == ["a"] and stale(9, True) == ["a"]  # exactly at the cutoff is not stale
    later = F.lit(datetime(2025, 1, 1))
    assert [r.scholar_id for r in refresh.stale_documents(docs, later, 90, 3, "scholar_id").collect()] == ["a", "c"]  # the limit comes before null keys go
    assert [r.scholar_id for r in refresh.stale_documents(docs, later, 90, 9, "scholar_id", True).collect()] == ["a", "c"]
    live = spark.createDataFrame([("a", "Success", None), ("c", "Success", "C"), ("d", "Error", None)], "scholar_id string, status string, name string")
    assert {r.scholar_id for r in refresh.without_dead(docs.select("scholar_id"), docs.select("scholar_id"), live).collect()} == {None, "c", ""}


def test_stale_keys_and_charts(spark):
    day = lambda d: datetime(2024, 1, d)
    modified = spark.createDataFrame([("a", day(2)), ("b", day(2)), ("c", day(2))], "scholar_id string, last_modified timestamp")
    cache = spark.createDataFrame([("a", day(2)), ("b", day(1))], "key string, timestamp timestamp")
    assert sorted(r.scholar_id for r in serving.stale_keys(modified, cache).collect()) == ["b", "c"]
    served = spark.createDataFrame([("a", "p", "2020", 1, 0.25, 0.5), ("a", "q", "n.d.", 2, 0.1, 0.2)], "scholar_id string, author_pub_id string, pub_year string, publication_rank long, num_papers_percentile double, num_citations_percentile double")
    (row,) = serving.scatter_frame(served, 2025, "num_papers_percentile").collect()
    assert (row.age, row.x, row.y) == (6, 25.0, 50.0)
