"""Serving queries and chart frames; meant for materialised tables, where their filters prune files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import SortedTable
from .authors import COUNTS
from .export import DAY
from .temporal import RANKED


def author_publications_served(details: DataFrame, inputs: DataFrame, author_id: str | None = None) -> DataFrame:
    rows = inputs if author_id is None else inputs.filter(F.col("scholar_id") == author_id)
    d = details.select("author_pub_id", "title", "author", "citation", "pub_year")
    return rows.join(d, "author_pub_id").select("scholar_id", "publication_rank", "author_pub_id", "title", "author", "citation", "pub_year", "num_citations", "num_citations_percentile", "num_papers_percentile")


def authors_with_scores(stats: DataFrame, scores: DataFrame, author_id: str | None = None) -> DataFrame:
    rows = stats if author_id is None else stats.filter(F.col("scholar_id") == author_id)
    return rows.join(scores.select("scholar_id", "pip_auc_score", "pip_auc_score_percentile"), "scholar_id", "left")


def publication_by_year(timeline: DataFrame, current_year: int, author_pub_id: str | None = None) -> DataFrame:
    """Years from publication to now; publication-year percentiles under their display names."""
    rows = timeline.filter((F.col("citation_year") >= F.col("pub_year")) & (F.col("citation_year") <= current_year))
    rows = rows if author_pub_id is None else rows.filter(F.col("author_pub_id") == author_pub_id)
    return rows.select("author_pub_id", "pub_year", "citation_year", "age", "yearly_citations", "cumulative_citations", F.col("perc_pub_year_yearly_citations").alias("perc_yearly_citations"), F.col("perc_pub_year_cumulative_citations").alias("perc_cumulative_citations"))


def author_by_year(temporal: DataFrame, author_id: str | None = None) -> DataFrame:
    """Empty for an empty id."""
    rows = temporal if author_id is None else temporal.filter((F.col("scholar_id") == author_id) & (F.lit(author_id) != ""))
    return rows.orderBy("scholar_id", "state_year") if author_id is not None else rows


def last_modified(authors: DataFrame, pubs: DataFrame) -> DataFrame:
    latest = pubs.groupBy("scholar_id").agg(F.max("timestamp").alias("_p"))
    return authors.join(latest, "scholar_id", "left").select("scholar_id", F.greatest("timestamp", "_p").alias("last_modified"))


def stale_keys(modified: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys without a cached result, or changed after it."""
    c = cache.select(F.col("key").alias("scholar_id"), F.col("timestamp").alias("_c"))
    return modified.join(c, "scholar_id", "left").filter(F.col("_c").isNull() | (F.col("last_modified") > F.col("_c"))).select("scholar_id", "last_modified")


def author_profiles(authors: DataFrame, modified: DataFrame, publications: DataFrame, stats: DataFrame) -> DataFrame:
    """One document per author: attributes, last change, publications by rank, statistics."""
    cols = [c for c in publications.columns if c not in ("scholar_id", "publication_rank")]
    lists = publications.groupBy("scholar_id").agg(F.array_sort(F.collect_list(F.struct("publication_rank", *cols))).alias("publications"))
    own = stats.select("scholar_id", F.struct(*[c for c in stats.columns if c not in ("scholar_id", "name", "affiliation", "email_domain")]).alias("stats"))
    rows = authors.select("scholar_id", "name", "affiliation", "email_domain").join(modified, "scholar_id", "left")
    return rows.join(lists, "scholar_id", "left").join(own, "scholar_id", "left")


def publication_profiles(pubs: DataFrame, by_year: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """One document per publication: attributes, last change, whether it is stale, statistics by year."""
    stats = F.array_sort(F.collect_list(F.struct("citation_year", *[c for c in by_year.columns if c not in ("author_pub_id", "pub_year", "citation_year")])))
    years = by_year.groupBy("author_pub_id").agg(stats.alias("stats"))
    stale = F.col("timestamp") < now - F.expr(f"INTERVAL {days} DAYS")
    rows = pubs.select("scholar_id", "author_pub_id", "title", "author", "citation", "pub_year", "num_citations", F.col("timestamp").alias("last_modified"), stale.alias("stale"))
    return rows.join(years, "author_pub_id", "left")


def scatter_frame(served: DataFrame, as_of_year: int, x: str = "publication_rank") -> DataFrame:
    rows = served.withColumn("year", F.col("pub_year").try_cast("bigint")).filter("year is not null")
    value = F.col(x) if x == "publication_rank" else F.col(x) * 100
    return rows.select("scholar_id", "author_pub_id", (F.lit(as_of_year).cast("bigint") - F.col("year") + 1).alias("age"), value.alias("x"), (F.col("num_citations_percentile") * 100).alias("y"))


def timeline_frame(by_year: DataFrame) -> DataFrame:
    return by_year.select("author_pub_id", F.make_date(F.col("citation_year").cast("int"), F.lit(1), F.lit(1)).alias("year"), "yearly_citations", "perc_yearly_citations", "perc_cumulative_citations")


def metric_frame(temporal: DataFrame, metrics: tuple[str, ...] = ("h_index", "total_citations", "i10_index", "h_index_5y")) -> DataFrame:
    """Long form: a row per author, year and metric."""
    unknown = set(metrics) - set(RANKED)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(f"{m}_percentile") * 100).alias("percentile")) for m in metrics])
    return temporal.select("scholar_id", "state_year", F.explode(entries).alias("e")).select("scholar_id", "state_year", "e.*")


def display_values(stats: DataFrame, as_of_year: int) -> DataFrame:
    shown = [F.round(100 * F.col(f"{c}_percentile"), 2).alias(f"{c}_shown") for c in ("hindex", "citedby", COUNTS[0])]
    return stats.select("scholar_id", *shown, (F.lit(as_of_year).cast("bigint") - F.col("year_of_first_pub") + 1).alias("years_active"))


class ServingViews:
    """The stored views that single authors and publications are served from, each sorted by the key it is asked for.

    ``refresh`` builds what is older than ``max_age``; a request opens the files that may hold
    its key and computes nothing anew.
    """

    KEYS = {"authors": "scholar_id", "publications": "scholar_id", "by_year": "author_pub_id", "temporal": "scholar_id"}

    def __init__(self, spark: SparkSession, path: str, files: int = 16):
        self.tables = {name: SortedTable(spark, f"{path}/{name}", key, files) for name, key in self.KEYS.items()}

    def refresh(self, views: dict[str, Callable[[], DataFrame]], now: datetime, max_age: timedelta = DAY) -> dict[str, bool]:
        """Which views were built anew."""
        return {name: self.tables[name].refreshed(build, max_age, now) for name, build in views.items()}

    def author(self, scholar_id: str) -> DataFrame:
        """Statistics and score of one author; of several rows the latest, of those the first by all its values."""
        rows = self.tables["authors"].keys([scholar_id])
        return rows.orderBy(F.desc_nulls_last("last_updated"), *sorted(rows.columns)).limit(1)

    def author_publications(self, scholar_id: str) -> DataFrame:
        return self.tables["publications"].keys([scholar_id]).orderBy("publication_rank")

    def publication_years(self, author_pub_id: str) -> DataFrame:
        return self.tables["by_year"].keys([author_pub_id]).orderBy("citation_year")

    def author_years(self, scholar_id: str) -> DataFrame:
        """Empty for an empty id."""
        return self.tables["temporal"].keys([scholar_id] if scholar_id else []).orderBy("state_year")
