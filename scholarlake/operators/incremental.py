"""Statistics that are patched from changed keys: stored rows and stored counts of their values, no full rebuild."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_RANKS, Specs, patched_counts, ranks_of, value_counts, with_ranks
from ..functions.storage import store
from ..sources.versioned import KeyedTable


class RankedTable:
    """Rows by key in buckets, and beside them how often each value of each ranked metric occurs in its group.

    A change of some keys reads their stored rows (from their buckets), takes their values off the counts and
    puts the new ones on. Percent ranks follow from the counts when rows are read,
    so unchanged rows have new ranks without having been touched.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, specs: Specs, buckets: int = 16):
        # without order columns a new row always takes the place of the old one
        self.rows, self.spark, self.key, self.specs = KeyedTable(spark, path, key, (), buckets, deleted="_gone"), spark, key, specs

    def counts(self) -> DataFrame:
        """(m, g0, ..., v, n) of the stored rows."""
        return self.spark.read.parquet(self.rows.attached())

    def build(self, rows: DataFrame, now: datetime) -> None:
        """The first content."""
        self._commit(rows.withColumn("_gone", F.lit(False)), value_counts(rows, self.specs), now)

    def _commit(self, rows: DataFrame, counts: DataFrame, now: datetime) -> None:
        folder = self.rows.log.new_folder()
        counts.write.parquet(folder)
        # one commit makes rows and counts valid: a run lost before it has changed nothing
        self.rows.merge(rows, now, attached=folder)

    def stored(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets."""
        return self.rows.read_keys(keys)

    def patch(self, changed: DataFrame, now: datetime, removed: DataFrame | None = None) -> None:
        """Replaces the rows of the keys of ``changed`` and drops those of ``removed``; new keys are added."""
        # each is read five times or more: by the old rows, the counts and the merge
        changed = store(changed)
        removed = None if removed is None else store(removed.select(self.key).distinct())
        gone = changed.select(self.key) if removed is None else changed.select(self.key).unionByName(removed)
        old = store(self.stored(gone))
        counts = patched_counts(self.counts(), old, changed, self.specs)
        rows = changed.withColumn("_gone", F.lit(False))
        if removed is not None:
            left = old.join(removed, self.key, "left_semi").join(changed.select(self.key), self.key, "left_anti")
            rows = rows.unionByName(left.withColumn("_gone", F.lit(True)))
        self._commit(rows, counts, now)

    def read(self, keys: DataFrame | None = None, bound: int = BROADCAST_RANKS) -> DataFrame:
        """All rows, or those of some keys, with their percent ranks."""
        rows = self.rows.read() if keys is None else self.stored(keys)
        ranks = store(ranks_of(self.counts()))
        return with_ranks(rows, ranks, self.specs, bound)


def changed_since(current: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``current`` that ``stored`` lacks or has otherwise: what a refresh of stale keys has to patch."""
    digest: Column = F.xxhash64(*columns)
    old = stored.select(F.col(key).alias("_key"), digest.alias("_old"))
    return current.join(old, current[key] == F.col("_key"), "left").filter(F.col("_old").isNull() | (F.col("_old") != digest)).select(*current.columns)
