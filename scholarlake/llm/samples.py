"""Bounded samples of labelled rows, for models that are fitted on the driver or on a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label): the ``rows`` labelled documents that come first in hash order.

    At most ``rows`` ids are broadcast. A doc_id with several labels or texts counts once.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = materialize(ids, "sample-ids")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialize(found.groupBy("doc_id", "label").agg(F.max("text").alias("text")), "sample")
