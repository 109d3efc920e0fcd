"""Author and publication documents made from star-schema tables, so that decoding runs on every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2025-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(key: str) -> Column:
    """A fixed UTC time up to 199 days before the epoch."""
    return F.to_timestamp(F.date_sub(F.lit(EPOCH).cast("date"), (F.col(key) % 200).cast("int")))


def _pub_year() -> Column:
    return F.when(F.col("o_orderkey") % 101 == 0, None).when(F.col("o_orderkey") % 211 == 0, 1949).otherwise(F.year("o_orderdate"))


def _author_pub_id() -> Column:
    return F.concat(F.lit("C"), F.col("o_custkey"), F.lit(":P"), F.col("o_orderkey"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in fields.items()]).alias("data")))


def raw_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by order once: both counts and the join take the rows where they lie
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    cites = lines.groupBy("l_orderkey").agg(
        F.floor(F.sum("q") / 10).alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("string"), F.floor(F.col("q") / 10)))).alias("m")
    )
    # both sides are large: a broadcast, where statistics are low, would leave the documents to the few splits of orders
    o = table(spark, sf_dir, "orders").join(cites.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    related = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("/related/"), key))
    data = _json(
        author_pub_id=_author_pub_id(), bib=F.struct(F.concat(F.lit("Title "), key).alias("title"), F.col("o_orderpriority").alias("author"), F.concat(F.lit("Journal "), F.col("o_orderstatus")).alias("citation"), _pub_year().cast("string").alias("pub_year")),
        num_citations=F.coalesce("n", F.lit(0)), cites_per_year=F.col("m"), url_related_articles=related,
    )
    return o.select(_author_pub_id().alias("document_id"), stamp("o_orderkey").alias("timestamp"), data.alias("data"))


def author_metric(i: int) -> Column:
    """Small modular functions of the key, for the six profile metrics."""
    return F.when(F.col("c_custkey") % 89 != 0, F.col("c_custkey") * (i + 3) % (17 + 10 * i))


def raw_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .documents import METRICS

    pubs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(
        _author_pub_id().alias("author_pub_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("num_citations"),
        F.lit(True).alias("filled"), F.struct(_pub_year().cast("string").alias("pub_year")).alias("bib"),
    ))).alias("publications"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(pubs.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left")
    scholar = F.concat(F.lit("C"), F.col("c_custkey"))
    data = _json(
        scholar_id=scholar, name=F.col("c_name"), affiliation=F.col("n_name"), email_domain=F.lower("r_name"),
        **{m: author_metric(i) for i, m in enumerate(METRICS)}, publications=F.col("publications"),
    )
    return a.select(scholar.alias("document_id"), stamp("c_custkey").alias("timestamp"), data.alias("data"))


def raw_network_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered suppliers as authors, whoever shares an order with them as coauthors."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    s = s.select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), "s_name", "n_name")
    on = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = on.alias("a").join(on.select("l_orderkey", F.col("l_suppkey").alias("other")).alias("b"), "l_orderkey").filter("l_suppkey <> other and l_suppkey % 2 = 0")
    pairs = pairs.select("l_suppkey", "other").distinct()
    other = s.select(F.col("s_suppkey").alias("other"), F.struct(F.col("id").alias("scholar_id"), F.col("s_name").alias("name"), F.col("n_name").alias("affiliation")).alias("c"))
    lists = pairs.join(other, "other").groupBy("l_suppkey").agg(F.sort_array(F.collect_list("c")).alias("coauthors"))
    rows = s.filter("s_suppkey % 2 = 0").join(lists, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    data = _json(scholar_id=F.col("id"), name=F.col("s_name"), affiliation=F.col("n_name"), email_domain=F.col("n_name"), coauthors=F.col("coauthors"))
    return rows.select(F.col("id").alias("document_id"), stamp("s_suppkey").alias("timestamp"), data.alias("data"))


def resolution_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(publications, authors): orders whose author string lists suppliers, suppliers under partly shared names."""
    name = lambda key: F.concat(F.lit("Supplier "), (F.col(key) % 70).cast("string"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: F.concat(F.lit("Supplier "), (x["l_suppkey"] % 70).cast("string"))), " and ")
    pubs = lines.select(F.concat(F.lit("P"), F.col("l_orderkey")).alias("author_pub_id"), names.alias("author"), F.when(F.col("l_orderkey") % 7 != 0, F.lit("/r")).alias("url_related_articles"))
    authors = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("scholar_id"), name("s_suppkey").alias("name"))
    return pubs, authors


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("document_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("data"), "event_id")
