"""Author analytics over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_RANKS, percent_rank_by
from ..functions.storage import store
from .publications import stepwise, zero

#: An author with more listings than this has them dealt over many tasks.
HEAVY_LISTINGS = 100_000
#: So many such authors at most; their ids are broadcast.
HEAVY_AUTHORS = 100_000
#: About so many states (author x publication x year) make one task, whatever the size of the table.
TASK_STATES = 500_000
YEAR = ["scholar_id", "state_year"]
RANKED = ["total_publications", "total_citations", "total_recent_citations_5y", "h_index", "h_index_5y", "i10_index", "i10_index_5y"]


def listings(listed: DataFrame) -> DataFrame:
    """(scholar_id, author_pub_id, years): a row per listed publication, with the year of each listing; duplicates are few."""
    return listed.groupBy("scholar_id", "author_pub_id").agg(F.array_sort(F.collect_list("pub_year")).alias("years"))


def _repeated_recent(yearly: Column, at: Column, copies: Column) -> Column:
    """The sum of the five rows up to row ``at`` of the series in which each year stands ``copies`` times."""
    place = lambda d: F.floor((at - d) / copies).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(4)), zero(), lambda a, d: a + F.coalesce(F.when(at >= d, F.get(yearly, place(d))), zero()))


def heavy_authors(listed: DataFrame, most: int = HEAVY_LISTINGS) -> DataFrame | None:
    """(scholar_id) of authors with more than ``most`` listings; none, as usual, gives None.

    The bound rises with the table, so that at most HEAVY_AUTHORS ids are broadcast.
    """
    counts = store(listed.groupBy("scholar_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    total = counts.agg(F.sum("n")).first()[0]
    return None if total is None else F.broadcast(counts.filter(F.col("n") > total // HEAVY_AUTHORS).select("scholar_id"))


def publication_states_apart(listed: DataFrame, series: DataFrame, heavy: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The states of the authors that fit a task each, and those of ``heavy`` ones, which stay dealt by publication."""
    if heavy is None:
        return publication_states(listed, series), None
    light = publication_states(listed.join(heavy, "scholar_id", "left_anti"), series)
    return light, publication_states(listed.join(heavy, "scholar_id", "left_semi"), series, by_author=False)


def state_tasks(series: DataFrame) -> int:
    """How many tasks the years of ``series`` are dealt to; at least one a core. Reads the years of publication, or one leaf of the arrays."""
    length = F.col("horizon") - F.col("pub_year") + 1 if "horizon" in series.columns else F.size("series.yearly")
    years = series.agg(F.sum(length)).first()[0] or 0
    return max(series.sparkSession.sparkContext.defaultParallelism, -(-years // TASK_STATES))


def publication_states(listed: DataFrame, series: DataFrame, by_author: bool = True) -> DataFrame:
    """Author x publication x year from the arrays of ``series``: a join of publications, then rows of years.

    A publication listed k times has k rows a year, as a join of listings has; ``copy`` counts
    them from 0, ``copies`` is k. citations_last_5_years is the sum of five *rows*, and ``most_recent`` the largest of the k sums of a year.
    Publications are dealt by author before their years are expanded, so author-years need no exchange of the many rows;
    without ``by_author`` they stay dealt by publication, and counts of their rows meet instead. A task's share is
    measured in years, of which the bytes of packed arrays tell little: there are as many tasks as TASK_STATES asks for.
    ``series`` may also be ``cited_years``: its arrays are then made where the states are, and only cited years are exchanged.
    """
    tasks, key = state_tasks(series), ["scholar_id", "author_pub_id"]
    held = [c for c in ("horizon", "pairs", "series") if c in series.columns]
    arrays = series.select(*key, F.col("pub_year").alias("_from"), *held).repartition(tasks, *key)
    rows = listings(listed).repartition(tasks, *key).join(arrays, key)
    rows = rows.repartition(tasks, "scholar_id") if by_author else rows
    if "pairs" in held:
        rows = rows.select(*key, "years", "_from", stepwise(F.col("pairs"), F.col("_from"), F.col("horizon")).alias("series"))
    rows = rows.select("*", F.size("years").alias("copies"), F.posexplode("years").alias("copy", "pub_year"))
    # sums over repeated rows are arrays of their own, null for the usual single listing
    yearly, places = F.transform("series", lambda s: s["yearly"]), F.sequence(F.lit(0), F.size("series") - 1)
    recent = lambda age, copy: _repeated_recent(F.col("_yearly"), age * F.col("copies") + copy, F.col("copies"))
    repeated = lambda values: F.when(F.col("copies") > 1, F.transform(places, values))
    rows = rows.withColumn("_yearly", F.when(F.col("copies") > 1, yearly)).select(
        "scholar_id", "author_pub_id", "pub_year", "copy", "copies", "_from", "series", repeated(lambda age: recent(age, F.col("copy"))).alias("_recent"),
        repeated(lambda age: F.array_max(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda copy: recent(age, copy)))).alias("_most"),
    )
    # arrays made here are never empty; a plain explode would have them made below the exchange too, to filter by their size
    explode = F.posexplode_outer if "pairs" in held else F.posexplode
    rows = rows.select("scholar_id", "author_pub_id", "pub_year", "copy", "copies", "_from", "_recent", "_most", explode("series").alias("_age", "_s"))
    return rows.select(
        "scholar_id", "author_pub_id", "pub_year", (F.col("_from") + F.col("_age")).cast("bigint").alias("state_year"),
        F.col("_s.yearly").alias("yearly_citations_at_state_year"), F.col("_s.cumulative").alias("cumulative_citations_at_state_year"),
        F.coalesce(F.get("_recent", "_age"), "_s.recent").alias("citations_last_5_years"), "copy", "copies", F.coalesce(F.get("_most", "_age"), "_s.recent").alias("most_recent"),
    )


def publication_state(listed: DataFrame, timeline: DataFrame) -> DataFrame:
    """The same from rows of years, as the view has it, for a timeline that is not at hand as arrays. Duplicated listings stay duplicated."""
    t = timeline.select("scholar_id", "author_pub_id", F.col("citation_year").alias("state_year"), F.col("yearly_citations").alias("yearly_citations_at_state_year"), F.col("cumulative_citations").alias("cumulative_citations_at_state_year"))
    return listed.select("scholar_id", "author_pub_id", "pub_year").join(t, ["scholar_id", "author_pub_id"])


def recent_citations(state: DataFrame) -> DataFrame:
    """Adds citations_last_5_years per publication, unless the state has it from its arrays."""
    if "citations_last_5_years" in state.columns:
        return state
    w = Window.partitionBy("scholar_id", "author_pub_id").orderBy("state_year").rowsBetween(-4, 0)
    return state.withColumn("citations_last_5_years", F.sum("yearly_citations_at_state_year").over(w))


def _with_copies(state: DataFrame) -> DataFrame:
    """The state with its copies numbered; a state from arrays has them."""
    if "copy" in state.columns:
        return state
    same = Window.partitionBy("scholar_id", "author_pub_id", "state_year")
    recent = recent_citations(state)
    return recent.withColumns({
        "copies": F.count(F.lit(1)).over(same), "copy": F.row_number().over(same.orderBy("citations_last_5_years")) - 1, "most_recent": F.max("citations_last_5_years").over(same),
    })


def _ranked(state: DataFrame, value: str, out: str) -> DataFrame:
    return state.withColumn(out, F.row_number().over(Window.partitionBy(*YEAR).orderBy(F.desc(value))))


def _h(value: str, rank: str) -> Column:
    """max(min(rank, value)) over positive values; null without any."""
    return F.max(F.when(F.col(value) > 0, F.least(F.col(rank).cast("bigint"), value)))


def h_indices(state: DataFrame, values: dict[str, str]) -> DataFrame:
    """An h-index per author-year for each ``{out: value}``, from how many rows have each positive value.

    Counts combine before any exchange, and no list or ranking of publications is made. Citations of
    an author-year have at most sqrt(2 x their sum) different values, so what is ordered stays small.
    """
    entries = F.array(*[F.struct(F.lit(out).alias("_m"), F.col(value).alias("_v")) for out, value in values.items()])
    counts = state.select(*YEAR, F.inline(entries)).filter("_v > 0").groupBy(*YEAR, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    larger = Window.partitionBy(*YEAR, "_m").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_r", F.sum("_n").over(larger))
    return ranked.groupBy(*YEAR).agg(*[F.max(F.when(F.col("_m") == out, F.least("_r", "_v"))).alias(out) for out in values])


def h_index(state: DataFrame, value: str, out: str) -> DataFrame:
    return h_indices(state, {out: value})


def _totals() -> list[Column]:
    """Sums and counts that need no list of publications: the first copy stands for its publication, and rows of k copies meet in k x k rows."""
    c, one = F.col("cumulative_citations_at_state_year"), F.col("copy") == 0
    return [
        F.count_if(one).alias("total_publications"), F.sum(c * F.col("copies")).alias("total_citations"),
        F.count_if(one & (c >= 10)).alias("i10_index"), F.count_if(one & (F.col("most_recent") >= 10)).alias("i10_index_5y"),
    ]


def yearly_totals(recent: DataFrame) -> DataFrame:
    """Counts and sums per author-year; every row counts as often as its publication is listed."""
    return _with_copies(recent).groupBy(*YEAR).agg(*_totals())


def recent_totals(state: DataFrame) -> DataFrame:
    """The author's citations of the five years up to each year: a range window over yearly sums."""
    sums = state.groupBy(*YEAR).agg(F.sum("yearly_citations_at_state_year").alias("_y"))
    return sums.select(*YEAR, _five_years().alias("total_recent_citations_5y"))


def _five_years() -> Column:
    return F.coalesce(F.sum("_y").over(Window.partitionBy("scholar_id").orderBy("state_year").rangeBetween(-4, 0)), F.lit(0))


def temporal_metrics(state: DataFrame, first: DataFrame) -> DataFrame:
    """All metrics of an author-year in one exchange of the states: both rankings and the sums share its partitioning.

    No list of publications is built, so an author-year may hold any number; equal to the single operators above joined.
    """
    c, r = "cumulative_citations_at_state_year", "citations_last_5_years"
    slim = _with_copies(state).select(*YEAR, "yearly_citations_at_state_year", c, r, "copy", "copies", "most_recent")
    ranked = _ranked(_ranked(slim, c, "_c"), r, "_r")
    years = ranked.groupBy(*YEAR).agg(*_totals(), F.sum("yearly_citations_at_state_year").alias("_y"), _h(c, "_c").alias("h_index"), _h(r, "_r").alias("h_index_5y"))
    return _finished(years, first)


def counted_metrics(state: DataFrame, first: DataFrame) -> DataFrame:
    """The same from sums and counts of values alone, which combine in the tasks that hold the rows: for authors too large for one."""
    state = _with_copies(state)
    totals = state.groupBy(*YEAR).agg(*_totals(), F.sum("yearly_citations_at_state_year").alias("_y"))
    h = h_indices(state, {"h_index": "cumulative_citations_at_state_year", "h_index_5y": "citations_last_5_years"})
    return _finished(totals.join(h, YEAR, "left"), first)


def metrics_of_listings(listed: DataFrame, series: DataFrame, first: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """All metrics of all author-years: usual authors in one exchange of their publications, ``heavy`` ones by counts."""
    light, apart = publication_states_apart(listed, series, heavy)
    metrics = temporal_metrics(light, first)
    return metrics if apart is None else metrics.unionByName(counted_metrics(apart, first))


def _finished(years: DataFrame, first: DataFrame) -> DataFrame:
    rows = years.withColumn("total_recent_citations_5y", _five_years()).join(first, "scholar_id", "left")
    filled = ["total_recent_citations_5y", "h_index", "h_index_5y", "i10_index", "i10_index_5y"]
    return rows.select(*YEAR, "year_of_first_pub", "total_publications", "total_citations", *[F.coalesce(m, F.lit(0)).alias(m) for m in filled])


def author_temporal(metrics: DataFrame, mode: str = "histogram", bound: int = BROADCAST_RANKS) -> DataFrame:
    return percent_rank_by(metrics, ["year_of_first_pub", "state_year"], {f"{m}_percentile": m for m in RANKED}, mode, bound=bound)
