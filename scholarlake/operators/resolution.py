"""Author name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def similar_authors(names: DataFrame, authors: DataFrame, most: int = 10) -> DataFrame:
    """Candidates per name, defaults filled in; at most ``most``, most cited first."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    order = Window.partitionBy("name").orderBy(F.desc(F.coalesce("citedby", F.lit(0))), "scholar_id")
    rows = names.select("name").distinct().join(authors, "name").withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    return rows.select("name", text("affiliation"), text("email_domain"), F.coalesce("citedby", F.lit(0)).alias("citedby"), text("scholar_id"), F.col("position").cast("bigint").alias("position"))


def split_authors(pubs: DataFrame) -> DataFrame:
    """(author_pub_id, position, name) of publications that carry related articles."""
    names = F.filter(F.transform(F.split("author", " and "), lambda x: F.trim(x)), lambda x: x != "")
    rows = pubs.filter(F.col("url_related_articles").isNotNull()).select("author_pub_id", F.posexplode(names).alias("position", "name"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


def resolve_exact(names: DataFrame, authors: DataFrame) -> DataFrame:
    """A name that exactly one author document has is that author; any other is unresolved."""
    known = authors.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.first("scholar_id").alias("_id"))
    rows, one = names.join(known, "name", "left"), F.col("_n") == 1
    method = F.when(one, "local_exact").otherwise("unresolved")
    return rows.select("author_pub_id", "position", "name", F.when(one, F.col("_id")).alias("scholar_id"), method.alias("method"))


def coauthor_candidates(open_: DataFrame, done: DataFrame, authors: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(author_pub_id, name, candidate) of candidates who list a resolved author of the paper, by two ways.

    From a resolved author, ``by_edge`` goes to those who list that author; or, ``by_name``, from the
    paper's open names to all who bear them. Of each resolved author of a paper the way with
    fewer rows is taken: those who list the author, against the bearers of the paper's open
    names. So neither a name of many bearers nor an author whom many list is expanded where the other is few.
    """
    listed = edges.select(F.col("primary_scholar_id").alias("candidate"), F.col("coauthor_scholar_id").alias("known")).distinct()
    named = authors.select("name", F.col("scholar_id").alias("candidate")).distinct()
    open_names = open_.select("author_pub_id", "name").distinct()
    bearers = open_names.join(named.groupBy("name").agg(F.count(F.lit(1)).alias("bearers")), "name").groupBy("author_pub_id").agg(F.sum("bearers").alias("bearers"))
    listing = listed.groupBy("known").agg(F.count(F.lit(1)).alias("listing"))
    # papers without open names, and authors whom nobody lists, go here
    ways = done.distinct().join(bearers, "author_pub_id").join(listing, "known")
    few = F.col("listing") <= F.col("bearers")
    by_edge = ways.filter(few).select("author_pub_id", "known").join(listed, "known").select("author_pub_id", "candidate").distinct().join(named, "candidate")
    others = ways.filter(~few).select("author_pub_id", "known")
    by_name = open_names.join(others.select("author_pub_id").distinct(), "author_pub_id").join(named, "name").join(others, "author_pub_id").join(listed, ["candidate", "known"], "left_semi")
    columns = ["author_pub_id", "name", "candidate"]
    return by_edge.select(*columns), by_name.select(*columns)


def resolve_by_coauthor(resolved: DataFrame, authors: DataFrame, edges: DataFrame) -> DataFrame:
    """Opt-in: an ambiguous name is its one candidate who lists a resolved author of the paper as coauthor."""
    open_ = resolved.filter("scholar_id is null").select("author_pub_id", "position", "name")
    done = resolved.filter("scholar_id is not null").select("author_pub_id", F.col("scholar_id").alias("known"))
    by_edge, by_name = coauthor_candidates(open_, done, authors, edges)
    single = by_edge.unionByName(by_name).groupBy("author_pub_id", "name").agg(F.countDistinct("candidate").alias("_n"), F.min("candidate").alias("_c")).filter("_n = 1")
    rows = resolved.join(single, ["author_pub_id", "name"], "left")
    hit = F.col("scholar_id").isNull() & F.col("_c").isNotNull()
    return rows.select("author_pub_id", "position", "name", F.when(F.col("scholar_id").isNull(), F.col("_c")).otherwise(F.col("scholar_id")).alias("scholar_id"), F.when(hit, "coauthor").otherwise(F.col("method")).alias("method"))


def resolution_arrays(resolved: DataFrame) -> DataFrame:
    """One array per publication, in author order."""
    entries = F.array_sort(F.collect_list(F.struct("position", "name", "scholar_id", "method")))
    return resolved.groupBy("author_pub_id").agg(F.transform(entries, lambda x: x.dropFields("position")).alias("author_resolutions"))


def resolution_totals(resolved: DataFrame) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count("scholar_id")
    return resolved.agg(F.countDistinct("author_pub_id").alias("pubs"), n.alias("authors"), hit.alias("resolved"), (n - hit).alias("unresolved"), F.round(100 * hit / n, 1).alias("percent"))
