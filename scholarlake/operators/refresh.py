"""Refresh worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import sample_ids


def stale_documents(docs: DataFrame, now: Column, days: int, limit: int, key: str, truthy: bool = False) -> DataFrame:
    """Oldest first; the limit comes before rows without the key go."""
    old = docs.filter(F.col("timestamp") < now - F.expr(f"INTERVAL {days} DAYS")).orderBy("timestamp", "document_id").limit(limit)
    present = F.col(key).isNotNull()
    return old.filter(present & (F.col(key) != "") if truthy else present).select(F.col(key), "timestamp")


def authors_to_refresh(docs: DataFrame, now: Column, count: int, days: int = 90, over: int = 100, seed: int = 0) -> DataFrame:
    return sample_ids(stale_documents(docs, now, days, count * over, "scholar_id"), "scholar_id", count, seed)


def refresh_worklist(requested: DataFrame, sampled: DataFrame, authors: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Ids to refresh with what is known of each: unknown, empty or known with name and number of publications."""
    ids = requested.select("scholar_id").union(sampled.select("scholar_id")).distinct()
    if fallback is not None and ids.isEmpty():
        ids = fallback.select("scholar_id")
    a = authors.select("scholar_id", "name", "n_publications", F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("n_publications").isNull() & F.col("name").isNull(), "empty").otherwise("known")
    return ids.join(a, "scholar_id", "left").select("scholar_id", status.alias("status"), "name", F.coalesce("n_publications", F.lit(0)).alias("n_publications"))


def worklist_totals(worklist: DataFrame) -> DataFrame:
    return worklist.groupBy("status").agg(F.count(F.lit(1)).alias("ids"), F.sum("n_publications").alias("publications"))


def task_key(id_: Column) -> Column:
    return F.replace(F.replace(id_, F.lit(":"), F.lit("__")), F.lit("/"), F.lit("___"))


def new_tasks(ids: DataFrame, key: str, pending: DataFrame) -> DataFrame:
    """Distinct task keys that are not pending."""
    return ids.select(task_key(F.col(key)).alias("task_key")).dropna().dropDuplicates().join(pending.select("task_key"), "task_key", "left_anti")


def publication_tasks(listed: DataFrame, refreshed: DataFrame, pending: DataFrame, skip: bool = False) -> DataFrame:
    rows = listed.join(refreshed.select("scholar_id").distinct(), "scholar_id", "left_semi")
    return new_tasks(rows.filter(F.lit(not skip)), "author_pub_id", pending)


def dead_authors(stale: DataFrame, liveness: DataFrame) -> DataFrame:
    """Stale ids whose check succeeded without finding a name."""
    return stale.join(liveness.filter((F.col("status") == "Success") & (F.coalesce("name", F.lit("")) == "")), "scholar_id").select("scholar_id").distinct()


def without_dead(docs: DataFrame, stale: DataFrame, liveness: DataFrame) -> DataFrame:
    """Stale documents whose check succeeded without finding a name are removed."""
    return docs.join(dead_authors(stale, liveness), "scholar_id", "left_anti")
