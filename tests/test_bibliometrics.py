"""Hand-computed cases and equivalences of the bibliometrics operators."""

import json

import pytest
from pyspark.sql import functions as F

from scholarlake.functions.ranking import percent_rank_by
from scholarlake.operators import authors, network, publications, refresh, resolution, temporal
from scholarlake.sources import documents

PUBS = "scholar_id string, author_pub_id string, pub_year long, title string, author string, citation string, num_citations long, cites_per_year string, url_related_articles string, timestamp timestamp"


def pubs(spark, *rows):
    return spark.createDataFrame([("A", i, y, None, None, None, n, m, None, None) for i, y, n, m in rows], PUBS)


def test_percent_rank_forms_agree(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 13).alias("v")).union(spark.createDataFrame([(None, 5), (9, None)], "k long, v long"))
    a, b = (sorted(percent_rank_by(df, ["k"], {"p": "v"}, m).collect(), key=str) for m in ("window", "histogram"))
    assert a == b


def test_publication_current_bounds(spark):
    df = pubs(spark, ("a", 2000, 1, None), ("b", 2000, 2, None), ("c", 2000, 2, None), ("d", 2000, 5, None), ("e", 1950, 3, None), ("f", 1951, 3, None), ("g", 2000, 0, None), ("h", None, 4, None))
    got = {r.author_pub_id: r.num_citations_percentile for r in publications.publication_current(df, 2025).collect()}
    assert got == pytest.approx({"a": 0, "b": 1 / 3, "c": 1 / 3, "d": 1, "f": 0})


def test_timeline(spark):
    m = json.dumps({"2019": 5, "2020": 1, "2022": "4", "n/a": 7, "2031": 2})
    rows = publications.citation_timeline(pubs(spark, ("a", 2020, 9, m), ("b", 2031, 1, None), ("c", None, 1, m)), 2023).orderBy("citation_year").collect()
    assert [(r.citation_year, r.yearly_citations, r.cumulative_citations, r.age) for r in rows] == [(2020, 1, 1, 0), (2021, 0, 1, 1), (2022, 4, 5, 2), (2023, 0, 5, 3)]


@pytest.mark.parametrize("mode", ["dense", "literal"])
def test_interpolation(spark, mode):
    curve = spark.createDataFrame([(2000, 2, 0.0), (2000, 4, 0.5), (2000, 8, 1.0)], f"{authors.COHORT} long, {authors.COUNTS[1]} long, {authors.COUNTS[1]}_percentile double")
    ranked = spark.createDataFrame([("A", f"p{r}", 1, 0.5, r, 2000) for r in (1, 2, 3, 4, 6, 8, 9)], f"scholar_id string, author_pub_id string, num_citations long, num_citations_percentile double, publication_rank long, {authors.COHORT} long")
    got = {r.publication_rank: r.num_papers_percentile for r in authors.pip_inputs(ranked, curve, mode).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.25, 4: 0.5, 6: 0.75, 8: 1.0, 9: 1.0}


def test_auc(spark):
    rows = [("a", 0.0, 0.9, 1), ("a", 0.5, 0.7, 2), ("a", 1.0, 0.1, 3), ("b", 0.3, 0.2, 1), ("c", 0.0, 0.9, 1), ("c", 0.0, 0.8, 2), ("c", 0.5, 0.4, 3)]
    df = spark.createDataFrame(rows, "scholar_id string, num_papers_percentile double, num_citations_percentile double, publication_rank long")
    assert {r.scholar_id: r.pip_auc_score for r in authors.pip_auc(df).collect()} == {"a": 0.6, "c": 0.3}


def test_h_index_and_recent(spark):
    rows = [("A", f"p{i}", 2020, c) for i, c in enumerate((10, 8, 5, 4, 3))] + [("B", f"q{i}", 2020, c) for i, c in enumerate((25, 8, 5, 3, 3))] + [("C", "r", 2020, 0)]
    df = spark.createDataFrame(rows, "scholar_id string, author_pub_id string, state_year long, v long")
    assert {r.scholar_id: r.h for r in temporal.h_index(df, "v", "h").collect()} == {"A": 4, "B": 3}
    state = spark.createDataFrame([("A", "p", y, 1) for y in range(2000, 2006)], "scholar_id string, author_pub_id string, state_year long, yearly_citations_at_state_year long")
    assert [r.citations_last_5_years for r in temporal.recent_citations(state).orderBy("state_year").collect()] == [1, 2, 3, 4, 5, 5]


def test_not_in(spark):
    edges = spark.createDataFrame([("x", "X", None, "d"), (None, "N", None, "d"), ("y", "Y", None, "d")], "coauthor_scholar_id string, coauthor_name string, coauthor_affiliation string, primary_email_domain string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "scholar_id string")
    assert [r[0] for r in network.unregistered_coauthors(edges, ids("y")).collect()] == ["x"]
    assert network.unregistered_coauthors(edges, ids("y", None)).count() == 0
    assert network.unregistered_coauthors(edges, ids()).count() == 3


def test_names_tasks_and_upsert(spark):
    p = spark.createDataFrame([("1", " A B and  and C ", "u"), ("2", "D", None)], "author_pub_id string, author string, url_related_articles string")
    names = resolution.split_authors(p)
    assert [r.name for r in names.orderBy("position").collect()] == ["A B", "C"]
    known = spark.createDataFrame([("A B", "1"), ("A B", "2"), ("C", "3")], "name string, scholar_id string")
    assert {r.name: (r.scholar_id, r.method) for r in resolution.resolve_exact(names, known).collect()} == {"A B": (None, "unresolved"), "C": ("3", "local_exact")}
    assert spark.range(1).select(refresh.task_key(F.lit("AbC:x/y"))).first()[0] == "AbC__x___y"
    schema = "document_id string, timestamp timestamp, data string"
    from datetime import datetime as t

    now = spark.createDataFrame([("a", t(2020, 1, 2), "new"), ("b", t(2020, 1, 1), "b")], schema)
    more = spark.createDataFrame([("a", t(2020, 1, 1), "old"), (" ", t(2021, 1, 1), "blank"), ("c", t(2020, 1, 1), "c")], schema)
    assert {r.document_id: r.data for r in documents.upsert_documents(now, more).collect()} == {"a": "new", "b": "b", "c": "c"}


def test_decoding_is_tolerant_of_quoted_numbers(spark):
    raw = spark.createDataFrame([("a", None, json.dumps({"data": {"scholar_id": "a", "hindex": "12", "citedby": 7}})), ("b", None, "{broken"), ("c", None, json.dumps({"data": {"scholar_id": None}}))], "document_id string, timestamp timestamp, data string")
    (row,) = documents.decode_authors(raw).collect()
    assert (row.scholar_id, row.hindex, row.citedby, row.i10index) == ("a", 12, 7, None)


def test_integers_at_every_depth(spark):
    big = 1 << 62
    df = spark.createDataFrame([((big + 1, [big, -big - 1]), {"a": 7}), (None, None)], "s struct<x: long, y: array<long>>, m map<string, long>")
    one, two = documents.protect_big_integers(df, ["s", "m"]).collect()
    assert (one.s.x, one.s.y, one.m) == (f'"{big + 1}"', [str(big), f'"{-big - 1}"'], {"a": "7"}) and two.s is None and two.m is None


def test_metrics_of_an_author_year_equal_the_single_ones(spark):
    rows = [("A", f"p{i}", 2000, y, (i * y) % 7, (i * (y - 1999)) % 23) for i in range(12) for y in range(2000, 2008)] + [("A", "p3", 2000, 2003, 2, 12)]
    state = spark.createDataFrame(rows, "scholar_id string, author_pub_id string, pub_year long, state_year long, yearly_citations_at_state_year long, cumulative_citations_at_state_year long")
    first = spark.createDataFrame([("A", 2000)], "scholar_id string, year_of_first_pub long")
    got = {r.state_year: r for r in temporal.temporal_metrics(state, first).collect()}
    recent = temporal.recent_citations(state)
    for frame in (temporal.yearly_totals(recent), temporal.recent_totals(state), temporal.h_index(state, "cumulative_citations_at_state_year", "h_index"), temporal.h_index(recent, "citations_last_5_years", "h_index_5y")):
        for r in frame.collect():
            assert all(got[r.state_year][c] == r[c] for c in frame.columns)


def test_entry_has_sql_for_most():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 60
