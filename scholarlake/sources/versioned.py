"""Tables as committed versions in a shared folder: buckets of a keyed table, and files sorted by key.

A write goes to a folder of its own; then one small file, the commit, names the folders that make
up the table. Readers take the latest commit, so they never see half a table, and a
writer that was lost has changed nothing. One writer at a time is assumed for a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.storage import store
from .documents import LAST_CHAR, latest_snapshot

#: A file of a sorted table holds about so many rows, which one task sorts.
FILE_ROWS = 500_000
#: A task of a merge writes about so many rows.
TASK_ROWS = 250_000
COMMIT = "version long, committed_at timestamp, part int, folder string, extra string, schema string, epochs map<string, long>"


class CommitLog:
    """The commits below ``path``: each a file of a row per part of the table, numbered upwards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> list[Row]:
        try:
            commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
            newest = commits.agg(F.max("version")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [] if newest is None else sorted(commits.filter(F.col("version") == newest).collect(), key=lambda r: r.part)

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def commit(self, parts: dict[int, tuple[str, str | None]], schema: T.StructType, now: datetime, epochs: dict[str, int] | None = None) -> int:
        """Makes ``parts`` (part -> folder, extra folder) the table. A table of no rows has the one part -1."""
        before = self.latest()
        version = before[0].version + 1 if before else 0
        known = (before[0].epochs if before else None) or {}
        rows = [(version, now, k, folder, index, schema.json(), {**known, **(epochs or {})}) for k, (folder, index) in sorted(parts.items() or {-1: ("", None)}.items())]
        # one file: it is there as a whole or not at all; what a lost writer left of this number is not a commit
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version:012d}")
        return version

    def fresh(self, max_age: timedelta, now: datetime) -> bool:
        """Whether the last commit is younger than ``max_age``."""
        rows = self.latest()
        return bool(rows) and now - rows[0].committed_at < max_age

    def expire(self, keep: int = 2) -> list[str]:
        """Removes all but the last ``keep`` commits and the folders that only they name; returns those folders."""
        commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        rows = commits.select("version", F.explode(F.array("folder", "extra")).alias("folder")).distinct().collect()
        newest = max(r.version for r in rows)
        held = {r.folder for r in rows if r.version > newest - keep}
        gone = sorted({r.folder for r in rows} - held - {None, ""})
        for folder in [f"{self.path}/commits/{v:012d}" for v in {r.version for r in rows} if v <= newest - keep] + gone:
            remove(self.spark, folder)
        return gone


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


class KeyedTable:
    """One row per key, in buckets by hash of the key: a merge rewrites the buckets that its keys fall into.

    The row with the largest ``order`` columns wins, a new one over an equal old one. A true
    ``deleted`` column marks a key as gone: the row stays as a tombstone, so that an older
    update does not bring the key back, and a later one does.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", order: Sequence[str] = ("timestamp",), buckets: int = 16, deleted: str | None = None):
        self.log, self.spark, self.key, self.order, self.buckets, self.deleted = CommitLog(spark, path), spark, key, tuple(order), buckets, deleted

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, parts: list[Row], schema: T.StructType) -> DataFrame:
        folders = [f"{r.folder}/bucket={r.part}" for r in parts if r.part >= 0]
        return self.spark.read.schema(schema).parquet(*folders) if folders else empty(self.spark, schema)

    def read(self, tombstones: bool = False) -> DataFrame | None:
        """The table; None before the first commit."""
        parts = self.log.latest()
        if not parts:
            return None
        rows = self._rows(parts, T.StructType.fromJson(json.loads(parts[0].schema)))
        return rows if tombstones else self._live(rows)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.filter(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted) if self.deleted else rows

    def read_keys(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys, from the buckets that may hold them."""
        parts = self.log.latest()
        if not parts:
            return None
        asked = keys.select(self.key).distinct()
        touched = {r[0] for r in asked.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        rows = self._rows([r for r in parts if r.part in touched], T.StructType.fromJson(json.loads(parts[0].schema)))
        return self._live(rows.join(asked, self.key, "left_semi"))

    def read_key(self, value: str) -> DataFrame | None:
        """The row of one key."""
        return self.read_keys(self.spark.range(1).select(F.lit(value).alias(self.key)))

    def attached(self) -> str | None:
        """The folder that the last merge named beside its rows."""
        parts = self.log.latest()
        return parts[0].extra if parts else None

    def merge(self, updates: DataFrame, now: datetime, writer: str | None = None, epoch: int | None = None, attached: str | None = None) -> bool:
        """Merges the updates; False where nothing was written: no valid row, or an epoch of ``writer`` that is in the table already.

        ``attached`` is a folder that becomes valid with the merge, by the same commit.
        """
        parts = self.log.latest()
        if writer is not None and parts and (parts[0].epochs or {}).get(writer, -1) >= epoch:
            return False
        valid = updates.filter(F.length(F.trim(F.col(self.key))) > 0)
        sizes = dict(valid.groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1))).collect())  # at most ``buckets`` numbers
        touched = sorted(sizes)
        if not touched:
            return False
        old = [r for r in parts if r.part in touched]
        new = valid.withColumn("_new", F.lit(1))
        stored = self._rows(old, valid.schema)
        both = new if not old else stored.withColumn("_new", F.lit(0)).unionByName(new)
        # a bucket is written by as many tasks as its rows ask for, a file each
        rows = sum(sizes.values()) + (stored.count() if old else 0)
        parts_of = max(1, -(-rows // (len(touched) * TASK_ROWS)))
        part = F.pmod(F.shiftright(F.xxhash64(self.key), 32), F.lit(parts_of))
        merged = latest_snapshot(both, self.key, *self.order, "_new").drop("_new")
        folder = self.log.new_folder()
        merged.withColumn("bucket", self._bucket()).repartition(len(touched) * parts_of, "bucket", part).write.partitionBy("bucket").parquet(folder)
        kept = {r.part: (r.folder, attached) for r in parts if r.part >= 0} | {k: (folder, attached) for k in touched}
        self.log.commit(kept, valid.schema, now, {writer: epoch} if writer is not None else None)
        return True


class SortedTable:
    """A table in files that hold disjoint ranges of ``key``, sorted, with an index of each file's range.

    A read by prefix, range or keys opens the files that may hold them, and the row
    groups in those; the index is read by Spark, only the chosen names come to the driver.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, files: int = 16, file_rows: int = FILE_ROWS):
        self.log, self.spark, self.key, self.files, self.file_rows = CommitLog(spark, path), spark, key, files, file_rows

    def replace(self, df: DataFrame, now: datetime) -> None:
        """``files`` files, or as many as hold ``file_rows`` rows each: a task sorts one, however large the table is."""
        folder, index = self.log.new_folder(), self.log.new_folder()
        # written once, as sampling the ranges would compute it a second time
        df = store(df)
        files = max(self.files, -(-df.count() // self.file_rows))
        df.repartitionByRange(files, self.key).sortWithinPartitions(self.key).write.parquet(folder)
        self._ranges(self.spark.read.schema(df.schema).parquet(folder)).coalesce(1).write.parquet(index)
        self.log.commit({0: (folder, index)}, df.schema, now)

    def _ranges(self, stored: DataFrame) -> DataFrame:
        """(file, low, high) of each file: it is sorted, so its first and last key; only their places are aggregated, which needs no sort of all rows."""
        rows = stored.select(self.key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at")).filter(F.col(self.key).isNotNull())
        ends = rows.groupBy("file").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        ends = rows.join(F.broadcast(ends), "file").filter((F.col("_at") == F.col("_first")) | (F.col("_at") == F.col("_last")))
        return ends.groupBy("file").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"))

    def refreshed(self, build: Callable[[], DataFrame], max_age: timedelta, now: datetime) -> bool:
        """Builds and stores the table anew unless it is younger than ``max_age``; whether it did."""
        if self.log.fresh(max_age, now):
            return False
        self.replace(build(), now)
        return True

    def _at(self, chosen: Column | None) -> DataFrame:
        (part,) = self.log.latest()
        schema = T.StructType.fromJson(json.loads(part.schema))
        if chosen is None:
            return self.spark.read.schema(schema).parquet(part.folder)
        files = [r.file for r in self.spark.read.parquet(part.extra).filter(chosen).select("file").collect()]
        return self.spark.read.schema(schema).parquet(*files) if files else empty(self.spark, schema)

    def read(self) -> DataFrame:
        return self._at(None)

    def between(self, low, high) -> DataFrame:
        key = F.col(self.key)
        return self._at((F.col("high") >= low) & (F.col("low") <= high)).filter((key >= low) & (key <= high))

    def prefix(self, prefix: str) -> DataFrame:
        return self.between(prefix, prefix + LAST_CHAR)

    def keys(self, values: Sequence[str]) -> DataFrame:
        """Rows of some keys; for a table of many, join ``read()``."""
        held = F.exists(F.lit(list(values)), lambda v: (v >= F.col("low")) & (v <= F.col("high"))) if values else F.lit(False)
        return self._at(held).filter(F.col(self.key).isin(list(values)))
