"""What the findings of round 3 named: joins that do the whole job of their host again, and steps that must not grow with the input."""

import json
import random
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from scholarlake.operators import authors as author_views
from scholarlake.operators import incremental, publications, temporal
from scholarlake.plans import registry
from scholarlake.sources import adapters, documents, versioned
from scholarlake.sources.versioned import SortedTable

SF = "/root/testdata/sf0.001"
SQL_OF_HOST = {"jn_1_series_citations": "pub_2_citation_timeline", "jn_2_listed_current_left": "aut_1_publication_counts", "jn_5_current_stats": "aut_6_publication_rank", "jn_10_not_in": "net_2_unregistered"}


def tables():
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("join", sorted(SQL_OF_HOST))
def test_join_does_its_hosts_whole_job(spark, join):
    found = __spark_entry__.queries()[join](spark, SF)
    asked = tables().execute(__spark_entry__.oracle_sql()[SQL_OF_HOST[join]])
    columns, rows = [d[0] for d in asked.description], asked.fetchall()
    assert found.columns == columns and rows
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))


PUBS = "scholar_id string, author_pub_id string, pub_year long, cites_per_year string"


def test_series_takes_steps_of_cited_years_only(spark):
    """No entry a year is built in a step of its own, and the sums are right where a year comes while another leaves."""
    rng = random.Random(5)
    cites = lambda: {rng.choice(["", " "]) + str(rng.randrange(1985, 2026)): rng.randrange(-2, 9) for _ in range(rng.randrange(9))}
    rows = [("A", f"A:{i}", rng.randrange(1990, 2023), json.dumps(cites())) for i in range(200)] + [("A", "A:none", 2022, None), ("A", "A:five", 1990, '{"1990": 1, "1995": 2, "2000": 3}')]
    df = publications.citation_series(spark.createDataFrame(rows, PUBS), 2022)
    got = {r.author_pub_id: [tuple(s) for s in r.series] for r in df.collect()}
    for _, key, first, text in rows:
        per = dict.fromkeys(range(first, 2023), 0)
        for k, v in json.loads(text or "{}").items():
            if int(k) in per:
                per[int(k)] += v
        years = list(per.values())
        assert got[key] == [(n, sum(years[: i + 1]), sum(years[max(0, i - 4) : i + 1])) for i, n in enumerate(years)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "map_zip_with" not in plan and "array_insert" not in plan


def test_states_are_dealt_by_years_not_by_bytes(spark, monkeypatch):
    """Twice the states, twice the tasks; an author stays in one of them."""
    made = {}
    for n in (40, 80):
        pubs = spark.createDataFrame([(f"A{i % 20}", f"A{i % 20}:{i}", 1976, "{}") for i in range(n)], PUBS)
        listed = pubs.select("scholar_id", "author_pub_id", "pub_year")
        monkeypatch.setattr(temporal, "TASK_STATES", 100)
        states = temporal.publication_states(listed, publications.citation_series(pubs, 2025))
        made[n] = states.rdd.getNumPartitions()
        assert states.count() == n * 50
        held = states.select("scholar_id", temporal.F.spark_partition_id().alias("p")).distinct()
        assert held.count() == 20
    assert made == {40: 20, 80: 40}


def test_states_exchange_cited_years_only(spark):
    """The arrays of all years are made after the last exchange, and the states are those of the arrays."""
    pubs = spark.createDataFrame([(f"A{i % 3}", f"A{i % 3}:{i}", 1990 + i, json.dumps({str(1990 + i + i % 4): i, "2010": 2})) for i in range(20)], PUBS)
    listed = pubs.select("scholar_id", "author_pub_id", "pub_year").unionByName(pubs.filter("pub_year % 5 = 0").select("scholar_id", "author_pub_id", "pub_year"))
    cited, series = publications.cited_years(pubs, 2022), publications.citation_series(pubs, 2022)
    got, want = (temporal.publication_states(listed, s) for s in (cited, series))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cumulative" not in plan[plan.index("RepartitionByExpression"):]


def test_sorted_table_has_files_by_its_rows(spark, tmp_path):
    table = SortedTable(spark, str(tmp_path), "k", files=2, file_rows=50)
    rows = spark.range(1000).selectExpr("if(id % 100 = 99, null, lpad(id, 4, '0')) AS k", "id")
    table.replace(rows, datetime(2025, 1, 1))
    (part,) = table.log.latest()
    index = spark.read.parquet(part.extra).orderBy("low").collect()
    assert 15 <= len(index) <= 20 and table.read().count() == 1000
    assert index[0].low == "0000" and index[-1].high == "0998" and all(a.high < b.low for a, b in zip(index, index[1:]))
    assert [r.id for r in table.keys(["0000", "0500"]).orderBy("id").collect()] == [0, 500] and table.prefix("05").count() == 99


def test_index_of_a_sorted_table_sorts_no_rows(spark, tmp_path):
    spark.range(100).selectExpr("cast(id AS string) AS k").sort("k").write.parquet(f"{tmp_path}/t")
    ranges = SortedTable(spark, str(tmp_path), "k")._ranges(spark.read.parquet(f"{tmp_path}/t"))
    first = ranges._jdf.queryExecution().sparkPlan().toString().split("BroadcastHashJoin")[1]
    assert "SortAggregate" not in first


def test_author_documents_are_built_once(spark, monkeypatch):
    """Profiles and listings are read from one stored parse of the documents, whatever reads them."""
    built, real = [], adapters.raw_authors
    monkeypatch.setattr(adapters, "raw_authors", lambda *a: (built.append(real(*a)), built[-1])[1])
    frames = registry.Frames(spark, SF)
    assert sorted(map(repr, frames.listed.collect())) == sorted(map(repr, documents.author_publications(built[0]).collect()))
    assert sorted(map(repr, frames.authors.collect())) == sorted(map(repr, documents.decode_authors(built[0]).collect()))
    for view in (frames.listed, frames.authors):
        plan = view._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "Aggregate" not in plan


def test_author_rows_join_the_listings_once(spark):
    authors = spark.createDataFrame([(a, *[a] * 3, *[1] * 6, datetime(2025, 1, 1)) for a in "ABC"], "scholar_id string, name string, affiliation string, email_domain string, hindex long, hindex5y long, citedby long, citedby5y long, i10index long, i10index5y long, timestamp timestamp")
    # a duplicate listing, one that is not cited, one whose year is out; B has no cited one, C none
    listed = spark.createDataFrame([("A", "p", 1999), ("A", "p", 1999), ("A", "q", 1990), ("A", "r", 1940), ("B", "x", 2000)], "scholar_id string, author_pub_id string, pub_year long")
    current = spark.createDataFrame([("p", 3), ("r", 1)], "author_pub_id string, num_citations long")
    rows = author_views.author_rows(authors, listed, current, 2025)
    got = {r.scholar_id: (r.year_of_first_pub, r.total_publications, r.total_publications_with_citations) for r in rows.collect()}
    assert got == {"A": (1999, 3, 2), "B": (None, 1, 0), "C": (None, 0, 0)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_a_patch_computes_its_changes_once(spark, tmp_path):
    """What is changed and removed is read several times, from what was stored, not from its plan."""
    seen = spark.sparkContext.accumulator(0)
    table = incremental.RankedTable(spark, str(tmp_path), "k", [(["g"], {"r": "v"})])
    rows = spark.range(100).selectExpr("cast(id AS string) AS k", "id % 3 AS g", "id AS v")
    table.build(rows, datetime(2025, 1, 1))

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    changed = rows.filter("v < 10").withColumn("v", incremental.F.col("v") + 1000).mapInArrow(counted, rows.schema)
    removed = rows.filter("v between 5 and 19").mapInArrow(counted, rows.schema)
    table.patch(changed, datetime(2025, 1, 1), removed=removed)
    assert seen.value == 25
    got = {r.k: r.r for r in table.read().collect()}
    assert len(got) == 90 and got["9"] == 1.0 and {str(i) for i in range(10)} <= set(got) and "10" not in got


def test_a_bucket_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "TASK_ROWS", 50)
    table = versioned.KeyedTable(spark, str(tmp_path), "k", (), buckets=2)
    rows = spark.range(1000).selectExpr("cast(id AS string) AS k", "id")
    for _ in range(2):
        table.merge(rows, datetime(2025, 1, 1))
        files = table.read().groupBy(incremental.F.input_file_name().alias("file")).count().collect()
        assert len(files) >= 12 and max(r["count"] for r in files) <= 250 and sum(r["count"] for r in files) == 1000
