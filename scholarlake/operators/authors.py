"""Author analytics as of now: counts, cohort percentiles, interpolated productivity and the PiP-AUC score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import eligible, percent_rank_by
from ..functions.storage import store
from ..sources.documents import METRICS

COHORT = "year_of_first_pub"
COUNTS = ["total_publications", "total_publications_with_citations"]


def listed_with_citations(listed: DataFrame, current: DataFrame, as_of_year: int) -> DataFrame:
    """Listed publications of eligible years, with their citations where they have any (left join; duplicated listings stay)."""
    cited = current.select("author_pub_id", "num_citations")
    return listed.filter(eligible(as_of_year, citations=False)).join(cited, "author_pub_id", "left")


def listed_and_cited(listed: DataFrame, current: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Listed publications that are among the current, cited ones."""
    rows = listed if as_of_year is None else listed.filter(eligible(as_of_year, citations=False))
    return rows.join(current.select("author_pub_id"), "author_pub_id")


def _counts() -> list[Column]:
    return [F.count("author_pub_id").alias(COUNTS[0]), F.count(F.when(F.col("num_citations") > 0, F.col("author_pub_id"))).alias(COUNTS[1])]


def publication_counts(listed: DataFrame, current: DataFrame, as_of_year: int) -> DataFrame:
    rows = listed_with_citations(listed, current, as_of_year)
    return rows.groupBy("scholar_id").agg(*_counts())


def first_cited_year(listed: DataFrame, current: DataFrame, as_of_year: int | None = None) -> DataFrame:
    return listed_and_cited(listed, current, as_of_year).groupBy("scholar_id").agg(F.min("pub_year").alias(COHORT))


def author_rows(authors: DataFrame, listed: DataFrame, current: DataFrame, as_of_year: int) -> DataFrame:
    """Profiles with counts and first year of their listings: those of ``publication_counts`` and ``first_cited_year``, from one join of the listings."""
    rows = listed.filter(eligible(as_of_year, citations=False)).join(current.select("author_pub_id", "num_citations", F.lit(True).alias("_met")), "author_pub_id", "left")
    own = rows.groupBy("scholar_id").agg(*_counts(), F.min(F.when(F.col("_met"), F.col("pub_year"))).alias(COHORT))
    rows = authors.join(own, "scholar_id", "left")
    return rows.select(
        "scholar_id", "name", "affiliation", "email_domain", *METRICS, COHORT, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.col("timestamp").alias("last_updated")
    )


def author_current(rows: DataFrame, mode: str = "histogram") -> DataFrame:
    return percent_rank_by(rows, [COHORT], {f"{m}_percentile": m for m in (*METRICS, *COUNTS)}, mode)


def productivity_curve(stats: DataFrame) -> DataFrame:
    return stats.select(COHORT, COUNTS[1], f"{COUNTS[1]}_percentile").distinct()


def publications_of_cohorts(current: DataFrame, stats: DataFrame) -> DataFrame:
    """Current publications with their author's cohort and number of cited publications."""
    return current.select("scholar_id", "author_pub_id", "num_citations", "num_citations_percentile").join(stats.select("scholar_id", COHORT, COUNTS[1]), "scholar_id")


def ranked_publications(current: DataFrame, stats: DataFrame) -> DataFrame:
    """Rank within the author, best percentile first; ties by id."""
    order = Window.partitionBy("scholar_id").orderBy(F.desc("num_citations_percentile"), "author_pub_id")
    rows = publications_of_cohorts(current, stats)
    return rows.withColumn("publication_rank", F.row_number().over(order).cast("bigint"))


#: Points of all curves are broadcast up to so many (some 30 bytes each); beyond it the same join is shuffled.
BROADCAST_POINTS = 1_000_000


def _points_up_to(curve: Column, rank: Column) -> Column:
    """How many points of a sorted curve have a count of at most ``rank``: binary search."""
    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["lo"] < at["hi"]) & (F.get(curve, middle)["n"] <= rank)
        return F.struct(F.when(right, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(curve) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(curve).alias("hi")), step)["lo"]


def pip_inputs(ranked: DataFrame, curve: DataFrame, mode: str = "dense") -> DataFrame:
    """The number-of-papers percentile at each rank, between the curve's points of the author's cohort.

    ``dense`` brings each cohort's curve as one sorted array to the publications, which are not
    shuffled, and searches it; ``literal`` pairs every publication with every point.
    """
    points = curve.filter(F.col(COHORT).isNotNull()).select(COHORT, F.col(COUNTS[1]).alias("lo"), F.col(f"{COUNTS[1]}_percentile").alias("p"))
    keep = ["scholar_id", "author_pub_id", "num_citations", "num_citations_percentile", "publication_rank"]
    r = F.col("publication_rank")
    if mode == "literal":
        d = ranked.join(points, COHORT).withColumn("d", r - F.col("lo"))
        near = d.groupBy(*keep).agg(
            F.min_by("p", F.when(F.col("d") >= 0, F.col("d"))).alias("pp"), F.min(F.when(F.col("d") >= 0, F.col("d"))).alias("pd"),
            F.max_by("p", F.when(F.col("d") < 0, F.col("d"))).alias("np"), F.min(F.when(F.col("d") < 0, -F.col("d"))).alias("nd"),
        )
        near = near.withColumns({"pp": F.when(F.col("pd").isNotNull(), F.col("pp")), "np": F.when(F.col("nd").isNotNull(), F.col("np"))})
        x = F.when(F.col("pp").isNull(), 0.0).when(F.col("np").isNull(), 1.0).otherwise((F.col("np") * F.col("pd") + F.col("pp") * F.col("nd")) / (F.col("pd") + F.col("nd")))
        return near.select(*keep, x.alias("num_papers_percentile")).distinct()
    curves = store(points.groupBy(F.col(COHORT).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col("lo").alias("n"), "p"))).alias("_curve")))
    size = curves.agg(F.coalesce(F.sum(F.size("_curve")), F.lit(0))).first()[0]
    rows = ranked.join(F.broadcast(curves) if size <= BROADCAST_POINTS else curves, F.col(COHORT) == F.col("_c"))
    # the place is computed in a projection of its own, once per row
    rows = rows.select(*keep, "_curve", _points_up_to(F.col("_curve"), r).alias("_at"))
    before, after = F.get("_curve", F.col("_at") - 1), F.get("_curve", F.col("_at"))
    below, above = r - before["n"], after["n"] - r
    x = F.when(F.col("_at") == 0, 0.0).when(after.isNull(), 1.0).otherwise((after["p"] * below + before["p"] * above) / (below + above))
    return rows.select(*keep, x.alias("num_papers_percentile"))


def pip_auc(inputs: DataFrame) -> DataFrame:
    """Trapezoids between neighbouring points, summed in rank order; one point alone gives no row."""
    order = Window.partitionBy("scholar_id").orderBy("num_papers_percentile", "publication_rank")
    x, y = F.col("num_papers_percentile"), F.col("num_citations_percentile")
    rows = inputs.select("scholar_id", "publication_rank", x, y, F.lag(x).over(order).alias("px"), F.lag(y).over(order).alias("py")).filter("px is not null and py is not null")
    area = (x - F.col("px")) * (y + F.col("py")) / 2
    areas = F.array_sort(F.collect_list(F.struct("num_papers_percentile", "publication_rank", area.alias("area"))))
    total = F.aggregate(areas, F.lit(0.0), lambda a, s: a + s["area"])
    return rows.groupBy("scholar_id").agg(F.round(total, 4).alias("pip_auc_score"))


def auc_percentile(auc: DataFrame, stats: DataFrame, mode: str = "histogram") -> DataFrame:
    rows = auc.join(stats.select("scholar_id", COHORT), "scholar_id")
    return percent_rank_by(rows, [COHORT], {"pip_auc_score_percentile": "pip_auc_score"}, mode).select("scholar_id", COHORT, "pip_auc_score", "pip_auc_score_percentile")
