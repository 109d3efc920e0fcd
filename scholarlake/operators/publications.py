"""Publication analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_RANKS, eligible, percent_rank_by, percent_ranks

SERIES = "array<struct<yearly:bigint,cumulative:bigint,recent:bigint>>"


def eligible_publications(pubs: DataFrame, as_of_year: int) -> DataFrame:
    """Eligible publications, in the columns of ``publication_current`` but its percentile."""
    return pubs.filter(eligible(as_of_year)).select("scholar_id", "author_pub_id", "title", "author", "pub_year", "num_citations", F.col("timestamp").alias("last_updated"))


def publication_current(pubs: DataFrame, as_of_year: int, mode: str = "histogram") -> DataFrame:
    """Eligible publications with their citation percentile among those of the same year."""
    return percent_rank_by(eligible_publications(pubs, as_of_year), ["pub_year"], {"num_citations_percentile": "num_citations"}, mode)


def zero() -> Column:
    return F.lit(0).cast("bigint")


def stepwise(pairs: Column, first: Column, last: Column) -> Column:
    """An array of (yearly, cumulative, recent) for the years ``first`` to ``last``, from (key, value) of the years with citations; ``recent`` is the sum of five years up to each.

    Sums change in a cited year and in the fifth after one; the years between are copies of one entry. So a row takes two steps
    a cited year, in order, and none for the others. Values of one year are added up.
    """
    event = lambda at, value, change: F.struct(at.alias("at"), value.alias("value"), change.alias("change"))
    come = F.transform(pairs, lambda e: event(e["key"], e["value"], e["value"]))
    leave = F.transform(F.filter(pairs, lambda e: e["key"] + 5 <= last), lambda e: event(e["key"] + 5, zero(), -e["value"]))
    entry = lambda acc, yearly: F.struct(yearly.alias("yearly"), acc["cumulative"].alias("cumulative"), acc["recent"].alias("recent"))

    def step(acc: Column, e: Column) -> Column:
        years, same = (e["at"] - acc["at"]).cast("int"), e["at"] == acc["at"]
        done = F.concat(acc["out"], F.array(entry(acc, acc["yearly"])), F.array_repeat(entry(acc, zero()), years - 1))
        return F.struct(
            e["at"].alias("at"), F.when(same, acc["yearly"] + e["value"]).otherwise(e["value"]).alias("yearly"), (acc["cumulative"] + e["value"]).alias("cumulative"),
            (acc["recent"] + e["change"]).alias("recent"), F.when(same, acc["out"]).otherwise(done).alias("out"),
        )

    # the year after the last closes the series
    events = F.concat(F.sort_array(F.concat(come, leave)), F.array(event(last + 1, zero(), zero())))
    start = F.struct(first.alias("at"), zero().alias("yearly"), zero().alias("cumulative"), zero().alias("recent"), F.array().cast(SERIES).alias("out"))
    return F.aggregate(events, start, step, lambda acc: acc["out"])


def cited_years(pubs: DataFrame, horizon_year: int) -> DataFrame:
    """scholar_id, author_pub_id, pub_year, horizon and ``pairs``: (key, value) for each year with citations from publication to the horizon.

    What a series is made of, and far smaller. Keys that are no years and nested values are skipped.
    """
    plain = lambda v: F.coalesce(F.when(~v.rlike(r"^\s*[{\[]"), v).cast("bigint"), zero())
    entries = F.coalesce(F.map_entries(F.from_json("cites_per_year", "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    pairs = F.transform(entries, lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), plain(e["value"]).alias("value")))
    last = F.lit(horizon_year).cast("bigint")
    pairs = F.filter(pairs, lambda e: e["key"].between(F.col("pub_year"), last))
    return pubs.filter(F.col("pub_year") <= horizon_year).select("scholar_id", "author_pub_id", "pub_year", last.alias("horizon"), pairs.alias("pairs"))


def citation_series(pubs: DataFrame, horizon_year: int) -> DataFrame:
    """scholar_id, author_pub_id, pub_year and ``series``: a (yearly, cumulative, recent) for each year from publication to the horizon.

    The map of citations lies in the publication's own row, so nothing is shuffled, and the work is linear in
    cited years. Keys of one year are added up.
    """
    series = stepwise(F.col("pairs"), F.col("pub_year"), F.lit(horizon_year).cast("bigint"))
    return cited_years(pubs, horizon_year).select("scholar_id", "author_pub_id", "pub_year", series.alias("series"))


def citation_timeline(pubs: DataFrame, horizon_year: int) -> DataFrame:
    """One row per year from publication to the horizon, with yearly and running citations."""
    return timeline_of(citation_series(pubs, horizon_year))


def timeline_of(series: DataFrame) -> DataFrame:
    """One row per year of each series."""
    rows = series.select("scholar_id", "author_pub_id", "pub_year", F.posexplode("series").alias("_age", "_s"))
    age = F.col("_age").cast("bigint")
    return rows.select(
        "scholar_id", "author_pub_id", "pub_year", age.alias("age"), (F.col("pub_year") + age).alias("citation_year"), F.col("_s.yearly").alias("yearly_citations"), F.col("_s.cumulative").alias("cumulative_citations"),
    )


def timeline_percentiles(timeline: DataFrame, mode: str = "histogram", bound: int = BROADCAST_RANKS) -> DataFrame:
    """Ranks among publications of the same year in each citation year, and among all of the same age, counted in one pass."""
    kinds = ("yearly_citations", "cumulative_citations")
    specs = [(["pub_year", "citation_year"], {f"perc_pub_year_{k}": k for k in kinds}), (["age"], {f"perc_age_{k}": k for k in kinds})]
    return percent_ranks(timeline, specs, mode, bound=bound)
