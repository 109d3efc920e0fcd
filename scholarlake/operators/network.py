"""Co-author network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registered ids are checked by broadcast up to so many bytes (an id's own and ID_BYTES); beyond it they are shuffled.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 64


def not_registered(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Edges whose coauthor is not in ``registered`` (scholar_id); NOT IN semantics: a null id in it empties the result.

    What NOT IN gives depends on whether ``registered`` is empty or holds a null, so it is counted first.
    """
    n, nulls, size = registered.agg(F.count(F.lit(1)), F.count_if(F.col("scholar_id").isNull()), F.coalesce(F.sum(F.octet_length("scholar_id") + ID_BYTES), F.lit(0))).first()
    key = edges["coauthor_scholar_id"]
    if n == 0:
        return edges
    if nulls:
        return edges.filter(F.lit(False))
    ids = registered.select(F.col("scholar_id").alias("_id")).distinct()
    return edges.filter(key.isNotNull()).join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, key == F.col("_id"), "left_anti")


def unregistered_coauthors(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Coauthors who are not registered, counted per name, affiliation and domain."""
    rows = not_registered(edges, registered)
    return rows.groupBy("coauthor_scholar_id", "coauthor_name", "coauthor_affiliation", "primary_email_domain").agg(F.count(F.lit(1)).alias("coauthor_count"))


def top_unregistered(counted: DataFrame, count: int, oversample: int = 100) -> DataFrame:
    totals = counted.groupBy("coauthor_scholar_id", "coauthor_name").agg(F.sum("coauthor_count").alias("total_count"))
    return totals.orderBy(F.desc("total_count"), "coauthor_scholar_id", "coauthor_name").limit(max(count * oversample, 1))


def seeded_order(key: str, seed: int) -> Column:
    """A digest that other engines compute alike, so that a sample can be repeated there."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_ids(df: DataFrame, key: str, count: int, seed: int = 0, random: bool = False) -> DataFrame:
    """Up to ``count`` distinct non-null ids, uniformly; by seeded hash, so that reruns agree, or at random."""
    ids = df.select(key).dropna().dropDuplicates()
    return ids.orderBy(F.rand(seed) if random else seeded_order(key, seed), key).limit(count)
